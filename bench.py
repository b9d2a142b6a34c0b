"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up, the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from seqframe.plans.queries import QUERIES
from seqframe.session import local_session

HEADLINE = [
    "support_rows", "support_join", "group_profile", "fill_forward", "contig_stats", "n50_stats",
    "best_hits", "multi_contig_hits", "query_hits", "extract_intervals", "extract_hits",
    "translate_codons", "symbol_frequencies", "markov_train", "markov_score", "pssm_scan",
    "pssm_top_hits", "matrix_power", "seed_exact", "seed_scored", "extend_ungapped",
    "pairwise_pearson", "read_fasta", "linkage_single", "linkage_complete", "linkage_average_vectors",
    "leaf_order", "read_blastn_report", "read_blastp_report", "report_best_hits", "write_query_hits",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "seqframe-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

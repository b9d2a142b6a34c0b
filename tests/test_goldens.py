"""Published sample outputs, in the folder that SEQFRAME_GOLDENS names; skipped without it.

clusters/matrix.txt with single.gtr, complete.gtr and average.gtr; markov/sequences.fa with order3.txt
(a dump of the model of order 3).
"""

import os

import pytest
from pyspark.sql import functions as F

from seqframe import sources
from seqframe.operators import linkage, markov

FOLDER = os.environ.get("SEQFRAME_GOLDENS", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="SEQFRAME_GOLDENS names no folder")


@pytest.mark.parametrize("kind", ["single", "complete", "average"])
def test_heights_of_the_trees(spark, kind):
    matrix = sources.read_matrix(spark, f"{FOLDER}/clusters/matrix.txt")
    # names may repeat, so a row is called by its place
    rows = matrix.withColumn("name", F.monotonically_increasing_id())
    got = getattr(linkage, f"linkage_{kind}")(linkage.leaves(rows, "name", "vec")).orderBy("step").collect()
    with open(f"{FOLDER}/clusters/{kind}.gtr") as f:
        want = [float(line.split("\t")[3]) for line in f.read().splitlines() if line.strip()]
    assert len(got) == len(want)
    assert sorted(r.sim for r in got) == pytest.approx(sorted(want), abs=1e-9)


def test_model_dump(spark):
    path = f"{FOLDER}/markov/sequences.fa"
    with open(path, encoding="latin-1") as f:
        last = [line[1:].rstrip() for line in f if line.startswith(">")][-1]
    # the published model was made without the last record
    seqs = sources.read_fasta(spark, path).filter(F.rtrim("header") != last)
    lines = markov.dump_model(markov.markov_train(seqs, "seq", 3), 3)
    got = [r.line.replace("\x01", " ").split() for r in lines.orderBy("sort_key").collect()]
    with open(f"{FOLDER}/markov/order3.txt", encoding="latin-1") as f:
        want = [line.replace("\x01", " ").split() for line in f.read().splitlines()]
    counted = [w for w in want if len(w) == 2 and w[-1].isdigit()]
    assert counted and sorted(g for g in got if len(g) == 2) == sorted(counted)

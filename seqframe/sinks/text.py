"""Text outputs in the formats of the analyses.

The parts of an ordered output, in the order of their names, are the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def write_lines(df: DataFrame, line: Column, path: str, order: list | None = None) -> None:
    """One column as text lines, in order if one is given."""
    rows = df.orderBy(*order) if order else df
    rows.select(line.alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True,
                order: list | None = None) -> None:
    """Delimited table with a header row; quotes inside a value stay as they are."""
    rows = df.orderBy(*order) if order else df
    rows.write.csv(path, sep=sep, header=header, nullValue="", emptyValue="", escapeQuotes=False)


def write_fasta(df: DataFrame, path: str, header: Column, seq: str = "seq",
                order: list | None = None) -> None:
    """FASTA records: ``>`` and the header, then the sequence on one line."""
    write_lines(df, F.concat(F.lit(">"), header, F.lit("\n"), F.col(seq)), path, order)


def interval_header() -> Column:
    return F.format_string("%s | start=%d | end=%d", "id", "start", "end")


def hit_header() -> Column:
    return F.concat_ws("|", F.element_at(F.split("file", "/"), -1), "id",
                       *[F.col(c).cast("string") for c in ("length", "start", "end")])


def write_gtr(tree: DataFrame, path: str) -> None:
    """Tree table: node, left, right, similarity; names end in X."""
    named = [F.concat(F.col(c), F.lit("X")) for c in ("node", "left", "right")]
    write_lines(tree, F.concat_ws("\t", *named, F.col("sim").cast("string")), path, ["step"])


def write_cdt(leaf_rows: DataFrame, order: DataFrame, samples: list[str], path: str) -> None:
    """Clustered data table: two header rows, then the leaves in tree order."""
    spark = leaf_rows.sparkSession
    heads = spark.createDataFrame([  # fixed values: the words of both header rows
        (-1, "\t".join(["GID", "CLID", "NAME", "GWEIGHT", *samples])),
        (0, "\t".join(["EWEIGHT", "", "", "", *["1"] * len(samples)])),
    ], "position long, value string")
    gene = F.concat(F.lit("GENE"), F.col("_l.leaf"))
    rows = leaf_rows.alias("_l").join(order.alias("_o"), gene == F.col("_o.leaf")).select(
        "_o.position",
        F.concat_ws("\t", F.concat(gene, F.lit("X")), "name", "name", F.lit("1"),
                    F.array_join(F.col("vec").cast("array<string>"), "\t")).alias("value"))
    write_lines(heads.unionByName(rows), F.col("value"), path, ["position"])


def hit_line() -> Column:
    return F.format_string("%9s %6.1f %6d %s", "name", "score", "start", "window")


def write_hits(hits: DataFrame, path: str) -> None:
    """Scored windows: name, score, start, window, best first."""
    write_lines(hits, hit_line(), path, [F.desc("score"), F.desc("start"), F.asc("name")])


def score_line(score: str, fields: list[str]) -> Column:
    return F.concat_ws("\t", F.format_string("%6.1f", score),
                       *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def write_scores(df: DataFrame, score: str, fields: list[str], path: str,
                 order: list | None = None) -> None:
    """Score table: score with one decimal, then annotation fields."""
    write_lines(df, score_line(score, fields), path, order)


def _opening() -> Column:
    return F.concat_ws(",", "query_name", "query_description", F.col("query_length").cast("string"))


def write_query_hits(queries: DataFrame, subjects: DataFrame, path: str) -> None:
    """One comma-joined line per query of a report, four fields per subject, in report order.

    A line is no longer than the block of its query in the report.
    """
    fields = F.concat_ws(",", "name", "description", F.col("length").cast("string"), "expect")
    listed = subjects.groupBy("file", "query").agg(
        F.array_sort(F.collect_list(F.struct("subject", fields.alias("fields")))).alias("hits"))
    joined = queries.join(listed, ["file", "query"], "left")
    line = F.concat_ws(",", _opening(), F.transform(F.coalesce("hits", F.array()), lambda h: h["fields"]))
    write_lines(joined, line, path, ["file", "query"])


def write_nohits(queries: DataFrame, path: str) -> None:
    """One comma-joined line per query without hits (see ``query_nohits``), in report order."""
    write_lines(queries, _opening(), path, ["file", "query"])


def write_multi_contig(rows: DataFrame, path: str) -> None:
    """One line per gene: the gene, then contig and e-value of each of its contigs.

    Every value ends with a tab, so a gene with very many contigs is many rows of one line.
    """
    firsts = rows.groupBy("gene").agg(F.min(F.struct("contig", "evalue")).alias("first"))
    value = F.concat_ws("\t", "contig", "evalue")
    own = F.struct("contig", "evalue")
    joined = rows.join(firsts, "gene")
    # the first row is the head of its line, rows equal to it follow
    again = joined.filter(own == F.col("first")).groupBy("gene", "contig", "evalue").agg(F.count(F.lit(1)).alias("n"))
    again = again.filter("n > 1").select("gene", "contig", "evalue", F.explode(F.sequence(F.lit(2), F.col("n"))))
    others = joined.filter(own > F.col("first")).select("gene", "contig", "evalue").unionByName(again.drop("col")).select(
        "gene", "contig", F.lit(1).alias("place"), value.alias("value"))
    heads = firsts.select("gene", "first.*").select(
        "gene", "contig", F.lit(0).alias("place"), F.concat(F.lit("\n"), "gene", F.lit("\t "), value).alias("value"))
    lines = heads.unionByName(others).orderBy("gene", "place", "contig")
    lines.select("value").write.option("lineSep", "\t").text(path)


def write_support(report: DataFrame, tools: DataFrame, path: str) -> None:
    """Gene row, a line with its tools, and their number. A gene has as many tools as there are."""
    columns = ["miRNA", "gene", "unigene", "type", "tissue", "chromosome", "ch_start", "ch_end",
               "description"]
    named = tools.groupBy("gene").agg(
        F.array_sort(F.collect_list(F.concat(F.col("tool").cast("string"), F.lit(", ")))).alias("tools"))
    text = F.concat(
        F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]),
        F.lit("\nTools: "), F.array_join("tools", ""), F.lit("\tTool Count: "), F.col("tool_count").cast("string"),
        F.lit("\n"))
    write_lines(report.join(named, "gene"), text, path, [F.desc("tool_count"), "gene"])


STATISTICS = {  # fixed values, column: printed name
    "n": "No of Sequences", "total_length": "Total Sequence Length", "gc_total": "GC Total",
    "gc_percent": "GC Perc", "avg_length": "Avg Contig Size", "min_length": "Min Contig Size",
    "max_length": "Max Contig Size", "n50_count": "Total N50 contigs", "n50": "N50ContigSize",
    "n50_avg": "N50Avg",
}


def statistics_lines(stats: DataFrame, file: str = "file") -> DataFrame:
    """Rows (file, place, line) with one ``name = value`` line per metric."""
    metrics = F.array(*[
        F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"{name} = "), F.col(c).cast("string")).alias("line"))
        for i, (c, name) in enumerate(STATISTICS.items())])
    return stats.select(file, F.inline(metrics))


def write_statistics(stats: DataFrame, path: str, file: str = "file") -> None:
    """One statistics report per input file."""
    statistics_lines(stats, file).orderBy(file, "place").select(
        F.col(file), F.col("line").alias("value")).write.partitionBy(file).text(path)


def save_model(model: DataFrame, path: str) -> None:
    model.select("context", "symbol", F.col("n").cast("long").alias("n")).write.parquet(path)


def write_dump(lines: DataFrame, path: str) -> None:
    write_lines(lines, F.col("line"), path, ["sort_key"])


def write_alignment(blocks: DataFrame, keys: list[str], path: str) -> None:
    """Printable alignments, blocks in order."""
    text = F.concat_ws("\n", "query_line", "bar_line", "target_line", F.lit(""))
    write_lines(blocks, text, path, [*keys, "block_no"])

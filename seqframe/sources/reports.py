"""Text reports of sequence searches.

Reports are read line by line. What a line belongs to (query, subject) is found in the batch of lines it is
read in, and carried over the borders of batches, so a query may have any number of hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.scan import fill_forward
from ..session import cut_lineage
from .records import read_records

# Line formats of the reports. Names of subjects and contigs are those of one data set;
# other reports pass their own patterns.
NO_HITS = "***** No hits"
QUERY = r"^Query=\s*(\w+)\W*(.*)$"
SUBJECT = r"^>\s?Contig(\d+)\.revised\.gene(\d+)\.protein\W*(.*)$"
LENGTH = r"Length\s*=\s*(\d+)"
EXPECT = r"Expect\s*=\s*([^\s,]+)"
CONTIG = r"^Query= (VCU\d+contig\d+)"
SUMMARY = r"\[gene=([^\]]*)\].*\.{3}\s+(\d[\d.]*(?:[eE]\+?\d+)?)\s+(\S.*)$"
DESCRIPTION = r"^>\s?lcl.*\[gene=([^\]]*)\]\s+\[protein=(.*)$"
HIT = r"sb:(\d+)\sse:(\d+)\b"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_records(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))


def _found(pattern: str, group: int, column: str = "value") -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def _by_section(lines: DataFrame, needed: list[str]) -> DataFrame:
    """Sections of a report: (file, query, section, text, next, what was found in it, owner).

    ``lines`` has rows (file, split, row, value, head, query, ...): a line with ``head`` starts a section, one with ``query``
    that of a query; the columns behind are what was found in a line, null if nothing. ``section`` is the place of the
    head, ``query`` that of the last query line of the file, ``text`` the head and ``next`` the line after it; of what is found
    the first counts. ``owner`` is true if the ``needed`` columns were found for the query, null if that is to be looked up.

    Lines become sections where they are read, batch by batch, whatever the length of a section. Only what crosses the
    border of a batch is looked up, in a table with one row per batch.
    """
    found = [c for c in lines.columns if c not in ("file", "split", "row", "value", "head", "query")]

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in batches:
            n = len(lines)
            if not n:
                continue
            number = np.arange(n)
            file, split = lines["file"], lines["split"].to_numpy()
            row = lines["row"].to_numpy()
            head, query = (lines[c].to_numpy(zero_copy_only=False) for c in ("head", "query"))
            # a run: the lines of one split in this batch
            first = np.r_[True, pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (split[1:] != split[:-1])]
            run = np.maximum.accumulate(np.where(first, number, 0))
            begins = head | first
            start, inside = np.flatnonzero(begins), np.cumsum(begins) - 1
            end, headed = np.r_[start[1:], n], head[start]

            def firsts(valid: np.ndarray) -> np.ndarray:
                """The first of the lines of each section, -1 if none."""
                at, out = np.flatnonzero(valid)[::-1], np.full(len(start), -1)
                out[inside[at]] = at
                return out

            def taken(column: pa.Array, at: np.ndarray) -> pa.Array:
                return column.take(pa.array(at, mask=at < 0))

            at = {c: firsts(lines[c].is_valid().to_numpy(zero_copy_only=False)) for c in found}
            asked = np.maximum.accumulate(np.where(query, number, -1))[start]
            asked = np.where(asked >= run[start], asked, -1)
            fit = np.ones(len(start), bool)
            for c in needed:
                fit &= at[c][inside[asked]] >= 0
            after = start + headed
            yield pa.RecordBatch.from_pydict({
                "file": file.take(pa.array(start)), "split": pa.array(split[start]), "run": pa.array(row[run[start]]),
                "section": pa.array(row[start], mask=~headed), "query": pa.array(row[asked], mask=asked < 0),
                "open": pa.array(np.r_[first[start[1:]], True]), "owner": pa.array(fit, mask=asked < 0),
                "text": taken(lines["value"], np.where(headed, start, -1)),
                "next": taken(lines["value"], np.where(after < end, after, -1)),
                **{c: taken(lines[c], at[c]) for c in found}})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema if f.name in found)
    parts = cut_lineage(lines.mapInArrow(sections, (
        "file string, split long, run long, section long, query long, open boolean, owner boolean, text string, next string"
        + (f", {kinds}" if kinds else ""))), "report-sections")

    def place(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.struct("split", F.col(column).alias("row")))

    # one row per run: the section and the query that it begins in
    before = Window.partitionBy("file").orderBy("split", "run").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(parts.filter("open").select("file", "split", "run", *[
        F.last(place(c), True).over(before).alias(f"_{c}") for c in ("section", "query")]), "carried")
    values = ["next", *found]
    spot = F.struct("split", "run")
    rest = parts.filter(F.col("section").isNull()).join(carried, ["file", "split", "run"]).groupBy(
        "file", F.col("_section").alias("section")).agg(*[
            F.min_by(c, F.when(F.col(c).isNotNull(), spot)).alias(f"_{c}") for c in values])
    headed = parts.filter(F.col("section").isNotNull()).withColumns({"section": place("section"), "query": place("query")})
    ended = headed.filter("open").join(rest, ["file", "section"], "left").withColumns(
        {c: F.coalesce(c, f"_{c}") for c in values}).drop(*[f"_{c}" for c in values])
    whole = headed.filter(~F.col("open")).unionByName(ended)
    far = whole.filter(F.col("query").isNull()).join(carried.drop("_section"), ["file", "split", "run"]).withColumn(
        "query", F.col("_query")).drop("_query")
    return whole.filter(F.col("query").isNotNull()).unionByName(far).select(
        "file", "query", "section", "text", *values, "owner")


def _sections(spark: SparkSession, path: str | list[str], subject: str) -> DataFrame:
    """Query and subject blocks with what was found in them, and what they lack (``reason``); ``owner`` is true if
    their query lacks nothing."""
    is_query = F.col("value").startswith("Query=")
    lines = _lines(spark, path).select(
        "file", "split", "row", "value", (is_query | F.col("value").startswith(">")).alias("head"), is_query.alias("query"),
        F.when(is_query & F.col("value").rlike(QUERY), True).alias("named"),
        _found(LENGTH, 1).cast("long").alias("length"), _found(EXPECT, 1).alias("expect"),
        F.when(F.col("value").contains(NO_HITS), True).alias("no_hits"))
    text = F.col("text")
    kind = F.when(F.col("section") == F.col("query"), F.lit("query")).otherwise(F.lit("subject"))
    named = F.when(kind == "query", F.col("named").isNotNull()).otherwise(text.rlike(subject))
    reason = (F.when(~named, F.lit("no name")).when(F.col("length").isNull(), F.lit("no length"))
              .when((kind == "subject") & F.col("expect").isNull(), F.lit("no e-value")))
    judged = _by_section(lines, ["named", "length"]).filter(F.col("query").isNotNull()).select(
        "file", "query", "section", kind.alias("kind"), text.alias("text"), "next", "length", "expect",
        F.coalesce("no_hits", F.lit(False)).alias("no_hits"), reason.alias("reason"), "owner")
    # subjects far behind their query: one query per border at most
    far = judged.filter((F.col("kind") == "subject") & F.col("owner").isNull())
    asked = far.select("file", "query").distinct()
    fit = judged.filter((F.col("kind") == "query") & F.col("reason").isNull()).select("file", "query").join(
        asked, ["file", "query"], "left_semi").withColumn("_fit", F.lit(True))
    return judged.filter((F.col("kind") == "query") | F.col("owner").isNotNull()).unionByName(
        far.drop("owner").join(fit, ["file", "query"], "left").withColumn(
            "owner", F.coalesce("_fit", F.lit(False))).drop("_fit"))


def read_blastn_report(spark: SparkSession, path: str | list[str], subject: str = SUBJECT,
                       digits: int = 3) -> tuple[DataFrame, DataFrame]:
    """Queries and subjects of nucleotide reports.

    queries: (file, query, query_name, query_description, query_length, no_hits); the
    description takes in the line after it. subjects: (file, query, subject, name,
    description, length, expect) with the first length and e-value after the name.
    ``query`` and ``subject`` are places in the file.

    ``subject`` is the pattern of a subject line: its last group is the description, the ones
    before it are the parts of the name, joined by points; parts that are numbers are padded to
    ``digits``. A query without a name or length is left out together with its subjects, and so
    is a subject without name, length or e-value: ``blastn_skipped`` counts them.
    """
    return _report(_sections(spark, path, subject), subject, digits)


def _report(sections: DataFrame, subject: str, digits: int) -> tuple[DataFrame, DataFrame]:
    whole, text = sections.filter(F.col("reason").isNull()), F.col("text")
    spill = F.when(F.col("next").rlike(LENGTH), F.lit("")).otherwise(F.coalesce("next", F.lit("")))
    queries = whole.filter(F.col("kind") == "query").select(
        "file", "query", F.regexp_extract(text, QUERY, 1).alias("query_name"),
        F.trim(F.concat(F.regexp_extract(text, QUERY, 2), F.lit(" "), spill)).alias("query_description"),
        F.col("length").alias("query_length"), "no_hits")

    def padded(part: Column) -> Column:  # never cut
        return F.when(part.rlike(r"^\d+$"), F.lpad(part, F.greatest(F.length(part), F.lit(digits)), F.lit("0"))
                      ).otherwise(part)

    groups = re.compile(subject).groups
    subjects = whole.filter((F.col("kind") == "subject") & F.col("owner")).select(
        "file", "query", F.col("section").alias("subject"),
        F.concat_ws(".", *[padded(F.regexp_extract(text, subject, i)) for i in range(1, groups)]).alias("name"),
        F.regexp_extract(text, subject, groups).alias("description"), "length", "expect")
    return queries, subjects


def blastn_skipped(spark: SparkSession, path: str | list[str], subject: str = SUBJECT) -> DataFrame:
    """What ``read_blastn_report`` leaves out: (file, kind, reason, n), kind query or subject."""
    sections = _sections(spark, path, subject)
    lost = sections.filter((F.col("kind") == "subject") & F.col("reason").isNull() & ~F.col("owner"))
    return (
        sections.filter(F.col("reason").isNotNull()).select("file", "kind", "reason")
        .unionByName(lost.select("file", "kind", F.lit("query skipped").alias("reason")))
        .groupBy("file", "kind", "reason").agg(F.count(F.lit(1)).alias("n")))


def blastp_summary(spark: SparkSession, path: str | list[str], contig: str = CONTIG) -> DataFrame:
    """Summary lines of protein reports: (contig, gene, bits, evalue, place).

    ``contig`` is the pattern of the lines that name a contig, in its first group. Every query line
    ends the contig before it; lines under a query that names none are left out. Bit scores may have
    decimals. E-values stay text. ``place`` orders lines over all files.
    """
    is_query = F.col("value").startswith("Query=")
    lines = _lines(spark, path).select(
        "file", "split", F.struct("file", "split", "row").alias("place"),
        F.when(is_query | F.col("value").rlike(contig), F.regexp_extract("value", contig, 1)).alias("contig"),
        _found(SUMMARY, 1).alias("gene"), F.regexp_extract("value", SUMMARY, 2).try_cast("double").alias("bits"),
        F.regexp_extract("value", SUMMARY, 3).alias("evalue"))
    used = lines.filter(F.col("contig").isNotNull() | F.col("gene").isNotNull())
    owned = fill_forward(used, "contig", "file", "place", F.col("split"))
    return owned.filter(F.col("gene").isNotNull() & (F.col("contig") != "")).select(
        "contig", "gene", "bits", "evalue", "place")


def blastp_descriptions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Gene descriptions of protein reports: (gene, description, place).

    A description without its closing bracket runs on over the next line.
    """
    is_query = F.col("value").startswith("Query=")
    lines = _lines(spark, path).select(
        "file", "split", "row", "value", (is_query | F.col("value").startswith(">")).alias("head"), is_query.alias("query"))
    head = _by_section(lines, []).filter(F.col("text").rlike(DESCRIPTION))
    text = F.regexp_extract("text", DESCRIPTION, 2)
    rest = F.regexp_extract("next", r"^(.*?)\]", 1)
    whole = F.when(F.rtrim(text).endswith("]"), F.regexp_replace(text, r"\]\s*$", "")).otherwise(
        F.concat(text, rest))
    return head.select(
        F.regexp_extract("text", DESCRIPTION, 1).alias("gene"), whole.alias("description"),
        F.struct("file", "section.split", "section.row").alias("place"))


def read_bp_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Condensed hits (file, id, start, end): ``SUB:`` names the subject of the lines below."""
    lines = _lines(spark, path).select(
        "file", "split", F.struct("split", "row").alias("place"),
        _found(r"SUB:(\w\S*)", 1).alias("id"), F.col("value").rlike(HIT).alias("hit"),
        F.regexp_extract("value", HIT, 1).try_cast("long").alias("start"),
        F.regexp_extract("value", HIT, 2).try_cast("long").alias("end"))
    used = lines.filter(F.col("id").isNotNull() | F.col("hit"))
    named = fill_forward(used, "id", "file", "place", F.col("split"))
    return named.filter("hit").select("file", "id", "start", "end")

"""Documents to packed training sequences: the stages, each over all that the one before kept.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents
(doc_id, text, lang, source, n_chars); other columns are dropped at the first stage. A null id stays with
its row as long as no decision about another row depends on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqframe.llm import crossparse, decontaminate, packing, radix, simhash
from seqframe.llm.blocks import folder
from seqframe.llm.queries import remainder, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Languages whose documents stay (values of lang); None: all that the labelled documents teach.
WANTED: list[str] | None = None


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id (null included) is among ``ids``, a column ``kept_id`` without repeats."""
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages ``WANTED``, as op3 predicts them.

    Texts that are null or have no letter are in no language. The model learns from the labelled rows of these
    documents, as op3 does; if there are none, all texts with a letter stay.
    """
    docs = docs.select(COLUMNS)
    model = crossparse.fit(docs.filter(remainder("doc_id", 5) != 0))
    judged = crossparse.predict(docs, model, COLUMNS)
    if not model.texts:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    wanted = F.col("lang_pred") != crossparse.UNKNOWN
    if WANTED is not None:
        wanted = F.col("lang_pred").isin(WANTED)
    return judged.filter(wanted).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows that repeat an id are one document and stay or go together; rows without an id stay if no
    row with an id is in their group.
    """
    found = simhash.near_copies(docs)
    ids = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"))
    return _kept(docs, ids.distinct())


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat 50-byte strings of documents with smaller ids.

    A character that a cut goes through leaves with the bytes cut; n_chars is that of the text left.
    A null text becomes an empty one.
    """
    spans = radix.repeated_spans(docs, keep=["lang", "source", "n_chars"], as_text=True)
    return spans.select(
        "doc_id", F.col("kept").alias("text"), "lang", "source",
        F.when(F.size("starts") > 0, F.char_length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates (the rule of op9)."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = found.groupBy("doc_id").agg(F.max("contaminated").alias("any")).filter(~F.col("any"))
    return _kept(docs, ids.select(F.col("doc_id").alias("kept_id")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in a training sequence (the columns of op5)."""
    return packing.packed(docs, tokenizer_path(), keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]

STAGES: list[Stage] = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats),
    ("benchmark", benchmark), ("sequences", sequences),
]

#: Suffix automata, fingerprints and tokenizers have no SQL: tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    home = folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{home}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

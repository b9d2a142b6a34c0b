"""One query per operator over the everyday tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import sinks, sources
from ..functions import (
    contig_id, orf_header, pearson, protein_header,
)
from ..functions import constants as K
from ..operators import (
    align, extract, hits, kgrams, linkage, markov, matrix, profile, pssm, scan, seeds, similarity,
    support, tree,
)
from ..operators.kgrams import pieces
from ..operators.scan import number_rows
from ..session import cut_lineage, scratch_path
from ..sinks import text as text_sinks
from ..sources.records import read_records
from . import search, views
from .views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MIRNA, TISSUE = "R", "MACHINERY"
WORD = 11
MARKOV_ORDER = 3
PSSM_INFORMATION, PSSM_ABOVE = 1.0, 4.0
SIMILAR = 0.3


def query_as(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def query(fn: Query) -> Query:
    return query_as(fn.__name__)(fn)


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def text_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number: the parts of an ordered output are read in the order of their names."""
    rows = number_rows(read_records(spark, path), [F.col("file"), F.col("split"), F.col("row")], "line")
    return rows.select("line", "value")


# --- relational support -----------------------------------------------------------------

@query
def support_rows(spark, d):
    return support.support_rows(*views.target_tables(spark, d), MIRNA, TISSUE)


@query
def support_join(spark, d):
    return support.support_join(*views.target_tables(spark, d), MIRNA, TISSUE)


@query
def support_tools(spark, d):
    return support.support_tools(support_join(spark, d), views.targets(spark, d), MIRNA)


# --- profiles and statistics ------------------------------------------------------------

def zeroed_events(spark, d):
    return table(spark, d, "events").select(
        "event_id", "event_type", "user_id",
        F.when(F.col("value") < 1, 0.0).otherwise(F.col("value")).alias("value"))


@query
def group_profile(spark, d):
    out = profile.group_profile(zeroed_events(spark, d), "event_type", "user_id", "value", "event_id")
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query
def fill_forward(spark, d):
    marked = table(spark, d, "events").select(
        "event_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("mark"))
    return scan.fill_forward(marked, "mark", "event_type", "event_id",
                             F.floor(F.col("event_id") / 100_000))


@query
def contig_stats(spark, d):
    out = profile.contig_stats(views.document_dna(spark, d), "source", "seq")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_length", "gc_percent")})


@query
def n50_stats(spark, d):
    out = profile.n50_stats(views.document_dna(spark, d), "source", "seq")
    return out.withColumn("n50_avg", F.round("n50_avg", 6))


# --- hits -------------------------------------------------------------------------------

@query
def best_hits(spark, d):
    return hits.best_hits(views.event_hits(spark, d), views.event_descriptions(spark, d), "line_no", 20.0)


@query
def multi_contig_hits(spark, d):
    return hits.multi_contig_hits(views.event_hits(spark, d), "line_no", 5.0)


def customer_orders(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("query"), "c_name", "c_acctbal")
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("query"), "o_orderkey", "o_totalprice")
    return customers, orders


@query
def query_hits(spark, d):
    return hits.query_hits(*customer_orders(spark, d), "query")


@query
def query_nohits(spark, d):
    customers, orders = customer_orders(spark, d)
    return hits.query_nohits(customers, orders.filter(F.col("o_totalprice") > 400_000), "query")


# --- cutting ----------------------------------------------------------------------------

def label_requests(spark, d):
    start = F.col("doc_id") % 40 + 1
    return table(spark, d, "labels").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), start.alias("start"),
        (start + 20 + F.col("quality") * 30).alias("end"))


@query
def extract_intervals(spark, d):
    return extract.extract_intervals(
        views.document_fasta(spark, d), label_requests(spark, d), ["doc_id"]).drop("header")


@query
def extract_intervals_pieces(spark, d):
    """The same from records in pieces of 1,000 letters."""
    parts = pieces(views.document_fasta(spark, d), ["doc_id", "header"], "seq", 0, 1000, keep_empty=True)
    return extract.extract_intervals_pieces(parts, label_requests(spark, d), "doc_id").drop("header")


def label_hits(spark, d):
    start, end = F.col("doc_id") % 40 + 1, F.col("doc_id") % 40 + 61
    odd = F.col("doc_id") % 2 == 1
    return table(spark, d, "labels").join(
        table(spark, d, "documents").select("doc_id", F.col("source").alias("file")), "doc_id"
    ).select("file", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"),
             F.when(odd, end).otherwise(start).alias("start"),
             F.when(odd, start).otherwise(end).alias("end"))


def fasta_by_source(spark, d):
    return views.document_fasta(spark, d).select(F.col("source").alias("file"), "header", "seq")


@query
def extract_hits(spark, d):
    return extract.extract_hits(label_hits(spark, d), fasta_by_source(spark, d))


@query
def extract_hits_complemented(spark, d):
    return extract.extract_hits(label_hits(spark, d), fasta_by_source(spark, d), complemented=True)


# --- k-grams and Markov models ----------------------------------------------------------

@query_as("kgrams")
def kgram_rows(spark, d):
    return kgrams.kgrams(views.benchmark_dna(spark, d), ["item_id"], "seq", MARKOV_ORDER)


@query_as("translate_codons")
def codon_translation(spark, d):
    return views.document_proteins(spark, d).select("doc_id", F.col("seq").alias("protein"))


@query
def symbol_frequencies(spark, d):
    out = markov.symbol_frequencies(views.document_dna(spark, d), "seq")
    return out.select("symbol", "n", rounded("frequency", 9), rounded("log_p", 9))


@query
def distinct_symbols(spark, d):
    return markov.markov_train(views.document_proteins(spark, d), "seq", 0).select("symbol").distinct()


@query
def markov_train(spark, d):
    return markov.markov_train(views.document_dna(spark, d), "seq", MARKOV_ORDER)


@query
def markov_train_protein(spark, d):
    return markov.markov_train(views.document_proteins(spark, d), "seq", 1)


@query
def markov_logq(spark, d):
    return markov.markov_logq(markov_train(spark, d)).withColumn("log_q", F.round("log_q", 9))


@query
def model_stats(spark, d):
    return markov.model_stats(markov_train(spark, d))


@query
def markov_score(spark, d):
    docs = views.document_dna(spark, d)
    model = markov.markov_train(views.benchmark_dna(spark, d), "seq", MARKOV_ORDER)
    out = markov.markov_score(docs, "doc_id", "seq", markov.markov_logq(model),
                              markov.symbol_frequencies(docs, "seq"), MARKOV_ORDER)
    return out.select("doc_id", rounded("score"))


@query
def markov_score_pieces(spark, d):
    """The same of records in pieces of 1,000 letters, which are scored 256 letters at a time."""
    docs = views.document_dna(spark, d)
    model = markov.markov_train(views.benchmark_dna(spark, d), "seq", MARKOV_ORDER)
    out = markov.markov_score_pieces(pieces(docs, ["doc_id"], "seq", 0, 1000, keep_empty=True), "doc_id", markov.markov_logq(model),
                                     markov.symbol_frequencies(docs, "seq"), MARKOV_ORDER, size=256)
    return out.select("doc_id", rounded("score"))


@query
def markov_score_protein(spark, d):
    docs = views.document_proteins(spark, d)
    model = markov.markov_train(views.benchmark_proteins(spark, d), "seq", 1)
    background = markov.symbol_frequencies(docs, "seq", K.AMINO_ACIDS)
    out = markov.markov_score(docs, "doc_id", "seq", markov.markov_logq(model), background, 1)
    return out.select("doc_id", rounded("score"))


@query
def dump_model(spark, d):
    return markov.dump_model(markov_train(spark, d), MARKOV_ORDER).select("line")


# --- headers ----------------------------------------------------------------------------

@query_as("parse_orf_header")
def orf_headers(spark, d):
    key = F.col("o_orderkey").cast("string")
    place = F.col("o_custkey").cast("string")
    strand = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<-"), place)).otherwise(
        F.concat(place, F.lit("->")))
    ortholog = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("ORTH:3e-"), place, F.lit(" "))
                      ).otherwise(F.lit(""))
    header = F.concat(F.lit("orf"), key, F.lit(" ("), key, F.lit(" nt) "), strand, F.lit(" "),
                      ortholog, F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", orf_header(header).alias("h")).select(
        "o_orderkey", "h.*")


@query_as("parse_contig_header")
def contig_headers(spark, d):
    """Length statistics of the contigs of each header id."""
    header = F.concat(F.lit("ctg"), (F.col("doc_id") % 50).cast("string"), F.lit(" [organism="), "source", F.lit("]"))
    named = views.document_dna(spark, d).select(F.trim(contig_id(header)).alias("contig"), "seq")
    out = profile.contig_stats(named, "contig", "seq")
    return out.select("contig", "n", "total_length", "gc_total")


@query_as("parse_protein_header")
def protein_headers(spark, d):
    header = F.concat(F.lit("tr|P"), F.col("p_partkey").cast("string"), F.lit("|P_X "), F.col("p_name"),
                      F.lit(" OS="), F.col("p_type"), F.lit(" GN="), F.translate("p_brand", "#", "g"),
                      F.lit(" PE=3 SV=1"))
    return table(spark, d, "part").select("p_partkey", protein_header(header).alias("h")).select(
        "p_partkey", "h.*")


# --- position weights -------------------------------------------------------------------

@query
def pssm_counts(spark, d):
    return pssm.pssm_counts(views.order_motifs(spark, d))


@query
def pssm_information(spark, d):
    return pssm.pssm_information(pssm_counts(spark, d)).select("position", rounded("information", 9))


@query
def pssm_logodds(spark, d):
    return pssm.pssm_logodds(pssm_counts(spark, d)).select(
        "position", "symbol", rounded("log_odds", 9))


def date_weights(spark, d):
    counts = cut_lineage(pssm_counts(spark, d), "counts")
    wanted = pssm.informative(pssm.pssm_information(counts), PSSM_INFORMATION).select("position")
    return pssm.pssm_logodds(counts).join(wanted, "position")


@query
def pssm_scan(spark, d):
    out = pssm.pssm_scan(views.document_dna(spark, d), ["doc_id"], "seq", date_weights(spark, d), 8,
                         PSSM_ABOVE)
    return out.withColumn("score", F.round("score", 6))


@query
def pssm_top_hits(spark, d):
    scored = pssm.pssm_scan(views.document_dna(spark, d), ["doc_id"], "seq", date_weights(spark, d), 8)
    return pssm.top_windows(scored.withColumn("score", F.round("score", 6)), ["doc_id"])


# --- matrices ---------------------------------------------------------------------------

@query
def matrix_power(spark, d):
    flow = cut_lineage(views.nation_flow(spark, d), "flow")
    return matrix.matrix_power(flow, 5).select("i", "j", rounded("value", 9))


@query
def substitution_scores(spark, d):
    flow = cut_lineage(views.nation_flow(spark, d), "flow")
    return matrix.substitution_scores(flow, views.nation_share(spark, d))


# --- seeds and alignments ---------------------------------------------------------------

BENCH, DOCS = ("item_id", "seq"), ("doc_id", "seq")


@query
def seed_exact(spark, d):
    return seeds.seed_exact(views.benchmark_dna(spark, d), views.document_dna(spark, d), BENCH, DOCS, WORD)


@query
def seed_scored(spark, d):
    return seeds.seed_scored(
        views.benchmark_proteins(spark, d), views.document_proteins(spark, d), BENCH, DOCS,
        views.class_scores(spark), 3, 8)


@query
def seed_runs(spark, d):
    return seeds.seed_runs(seed_exact(spark, d), WORD)


@query
def extend_ungapped(spark, d):
    return seeds.extend_ungapped(
        seed_runs(spark, d), views.benchmark_dna(spark, d), views.document_dna(spark, d), BENCH, DOCS)


@query
def align_seeds(spark, d):
    return align.align_seeds(
        seed_runs(spark, d), views.benchmark_dna(spark, d), views.document_dna(spark, d), BENCH, DOCS)


@query
def align_protein_seeds(spark, d):
    queries, targets = views.benchmark_proteins(spark, d), views.document_proteins(spark, d)
    scores = views.class_scores(spark)
    found = seeds.seed_scored(queries, targets, BENCH, DOCS, scores, 3, 11)
    return align.align_seeds(found.withColumn("length", F.lit(3)), queries, targets, BENCH, DOCS, scores,
                             gap_open=K.PROTEIN_GAP_OPEN, gap_extend=K.PROTEIN_GAP_EXTEND)


@query
def format_alignment(spark, d):
    """Documents against their own reverse, with one letter shown as a gap."""
    pairs = views.document_dna(spark, d).select(
        "doc_id", F.translate("seq", "G", "-").alias("query_hit"), F.reverse("seq").alias("target_hit"),
        F.lit(0).alias("q_start"), F.lit(4).alias("t_start"))
    return align.format_alignment(pairs, ["doc_id"])


@query
def search_assemblies(spark, d):
    genes = views.benchmark_dna(spark, d).select(F.col("item_id").alias("gene"), "seq")
    return search.search_assemblies(fasta_by_source(spark, d), genes, WORD, 20)


def assembly_folder(spark, d):
    """A file of assemblies for each source, in lines of 60 letters, and files of other kinds beside them."""
    path = scratch_path(spark, "assemblies")
    lines = F.array_join(F.regexp_extract_all("seq", F.lit("(?s).{1,60}"), F.lit(0)), "\n")
    records = views.document_fasta(spark, d).select(
        "source", "doc_id", F.concat(F.lit(">"), "header", F.lit("\n"), lines).alias("value"))
    placed = records.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id")
    placed.write.partitionBy("source").text(path)
    placed.write.partitionBy("source").mode("append").csv(path)
    return f"{path}/*"


def by_source(found):
    return found.withColumn("file", F.regexp_extract("file", "source=([^/]+)", 1))


@query
def search_folder(spark, d):
    """Hits from the files of a folder, those whose names fit a pattern, by pieces of their records."""
    genes = views.benchmark_dna(spark, d).select(F.col("item_id").alias("gene"), "seq")
    return by_source(search.search_folder(spark, assembly_folder(spark, d), genes, "*.txt", WORD, 20)[1])


@query
def folder_statistics(spark, d):
    genes = views.benchmark_dna(spark, d).select(F.col("item_id").alias("gene"), "seq")
    out = by_source(search.search_folder(spark, assembly_folder(spark, d), genes, "*.txt", WORD, 20)[0])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_length", "gc_percent", "n50_avg")})


@query
def assembly_statistics(spark, d):
    out = search.assembly_statistics(fasta_by_source(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_length", "gc_percent", "n50_avg")})


# --- similarity and clustering ----------------------------------------------------------

@query
def pairwise_pearson(spark, d):
    out = similarity.pairwise_pearson(views.embedding_vectors(spark, d), "vec_id", "vec", SIMILAR)
    return out.withColumn("sim", F.round("sim", 6))


def many_blocks(vectors: DataFrame) -> tuple[int, int]:
    """Rows of a block so that there are sixteen blocks or more, and half of the rows: what the operators do by
    themselves with more rows than a few of their largest blocks, and than one task merges."""
    rows = vectors.count()
    return max(1, min(similarity.LARGEST_BLOCK, rows // 16)), min(linkage.FINISH, rows // 2)


@query
def pairwise_pearson_bounded(spark, d):
    """As ``pairwise_pearson``, by pairs of blocks whose bound reaches the threshold."""
    vectors = views.embedding_vectors(spark, d)
    out = similarity.pairwise_pearson(vectors, "vec_id", "vec", SIMILAR, many_blocks(vectors)[0])
    return out.withColumn("sim", F.round("sim", 6))


@query
def neighbour_pearson(spark, d):
    """r of each vector and the next one, by the raw-sum formula."""
    vectors = views.embedding_vectors(spark, d)
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("next"))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round(pearson(F.col("vec"), F.col("next")), 6).alias("r"))


def embedding_leaves(spark, d):
    return linkage.leaves(views.embedding_vectors(spark, d), "vec_id", "vec")


def brand_leaves(spark, d):
    return linkage.leaves(views.part_vectors(spark, d), "brand", "vec")


@query
def linkage_single(spark, d):
    return linkage.linkage_single(embedding_leaves(spark, d)).withColumn("sim", F.round("sim", 6))


@query
def linkage_complete(spark, d):
    return linkage.linkage_complete(embedding_leaves(spark, d)).withColumn("sim", F.round("sim", 6))


@query
def linkage_complete_rounds(spark, d):
    """As ``linkage_complete``, by bounded rounds until half of the clusters are left."""
    leaf_rows = embedding_leaves(spark, d)
    return linkage.linkage_complete(leaf_rows, *many_blocks(leaf_rows)).withColumn("sim", F.round("sim", 6))


@query
def linkage_average(spark, d):
    return linkage.linkage_average(brand_leaves(spark, d)).withColumn("sim", F.round("sim", 6))


@query
def linkage_average_vectors(spark, d):
    return linkage.linkage_average(embedding_leaves(spark, d)).withColumn("sim", F.round("sim", 6))


@query
def leaf_order(spark, d):
    return tree.leaf_order(cut_lineage(linkage_single(spark, d), "tree"))


# --- readers and writers: written from the tables, read back ---------------------------

@query
def read_fasta(spark, d):
    path = scratch_path(spark, "fasta")
    sinks.write_fasta(views.document_fasta(spark, d), path, F.col("header"))
    return sources.read_fasta(spark, path).select("header", "seq")


@query
def read_fasta_pieces(spark, d):
    """Sizes and first letters of records that were read line by line."""
    path = scratch_path(spark, "fasta")
    fasta = views.document_fasta(spark, d)
    lines = F.array_join(F.regexp_extract_all("seq", F.lit("(?s).{1,60}"), F.lit(0)), "\n")
    sinks.write_fasta(fasta.withColumn("seq", lines), path, F.col("header"))
    pieces = sources.read_fasta_pieces(spark, path)
    return pieces.groupBy("header").agg(
        F.sum(F.length("piece")).alias("n"), F.count_if(F.length("piece") > 0).alias("n_pieces"),
        F.max_by(F.right("piece", F.lit(3)), "offset").alias("last"))


@query
def read_fasta_first(spark, d):
    """First record of each file of a folder, one file per source."""
    path = scratch_path(spark, "fasta")
    fasta = views.document_fasta(spark, d).select(
        "source", "doc_id", F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"))
    fasta.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy(
        "source").text(path)
    return sources.first_record(sources.read_fasta(spark, f"{path}/*")).select("header", "seq")


@query_as("write_fasta")
def write_interval_fasta(spark, d):
    path = scratch_path(spark, "intervals")
    sinks.write_fasta(extract_intervals(spark, d), path, text_sinks.interval_header(), "fragment")
    return text_of(spark, path)


@query
def write_hit_fasta(spark, d):
    path = scratch_path(spark, "hits")
    sinks.write_fasta(extract_hits(spark, d), path, text_sinks.hit_header(), "fragment")
    return text_of(spark, path)


@query
def read_intervals(spark, d):
    path = scratch_path(spark, "requests")
    sinks.write_table(label_requests(spark, d), path)
    return sources.read_intervals(spark, path)


@query
def read_matrix(spark, d):
    path = scratch_path(spark, "matrix")
    vectors = views.embedding_vectors(spark, d)
    width = vectors.select(F.size("vec")).first()[0]
    sinks.write_table(vectors.select("vec_id", *[F.col("vec")[i].alias(f"s{i}") for i in range(width)]), path)
    return sources.read_matrix(spark, path).select(
        F.col("name").cast("long").alias("vec_id"), F.posexplode("vec").alias("sample", "value")
    ).withColumn("value", F.round("value", 6))


@query
def read_substitutions(spark, d):
    path = scratch_path(spark, "substitutions")
    wide = views.nation_flow(spark, d).groupBy("i").pivot("j", list(range(25))).agg(
        F.max(F.round(F.col("value") * 10000, 3))).na.fill(0.0)
    sinks.write_table(wide, path)
    return sources.read_substitutions(spark, path).select(
        F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), rounded("value", 7))


@query
def read_tracking(spark, d):
    path = scratch_path(spark, "tracking")
    blank = F.lit("-")
    place = F.concat((F.col("user_id") % 7).cast("string"), F.lit(":100-200"))
    kind = F.col("event_id") % 10
    value = F.when(kind == 3, "NA").when(kind == 4, "-").when(kind == 5, "").otherwise(F.col("value").cast("string"))
    sinks.write_table(table(spark, d, "events").select(
        F.col("event_id").alias("tracking_id"), *[blank.alias(f"c{i}") for i in range(1, 6)],
        place.alias("locus"), *[blank.alias(f"c{i}") for i in range(7, 10)],
        value.alias("fpkm")), path)
    return sources.read_tracking(spark, path).select(
        F.col("gene").cast("long").alias("gene"), F.col("chr").cast("int").alias("chr"), "value")


@query
def tracking_profile(spark, d):
    rows = read_tracking(spark, d)
    out = profile.group_profile(rows, "chr", "gene", "value", "gene")
    return out.withColumn("avg_value", F.round("avg_value", 6)).orderBy("chr")


@query
def read_motifs(spark, d):
    path = scratch_path(spark, "motifs")
    motifs = views.order_motifs(spark, d)
    sinks.write_lines(motifs, F.concat(F.col("name").cast("string"), F.lit("  "), F.lower("motif")), path)
    return sources.read_motifs(spark, path).select(F.col("name").cast("long").alias("name"), "motif")


def write_nucleotide_report(spark, d, damaged=False):
    """Customers as queries, their orders as subjects, in the layout of a BLASTN report.

    A block has a customer's orders of one run of 20000 order numbers, so its size is bounded. In a
    damaged report some blocks lack a name, a length or an e-value.
    """
    customers, orders = customer_orders(spark, d)
    order, odd = F.col("o_orderkey"), F.lit(damaged)
    subject = F.concat(
        F.when(odd & (order % 11 == 0), F.lit(">another  ")).otherwise(
            F.format_string(">Contig%d.revised.gene%d.protein  ", order % 200, order)),
        F.format_string("part of %d\n\n            Length = %d\n\n Score = 20.3 bits (10)", order, F.col("query") + 100),
        F.when(odd & (order % 7 == 0), F.lit("")).otherwise(
            F.concat(F.lit(", Expect = 2e-"), F.lpad((order % 90 + 10).cast("string"), 3, "0"))),
        F.lit("\n Identities = 10/10\n"))
    run = F.floor(F.col("o_orderkey") / 20_000)
    blocks = customers.join(orders, "query", "left").groupBy("query", "c_name", run.alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", subject.alias("s")))).alias("s"))
    found = F.when(F.col("run").isNull(), F.lit("\n ***** No hits found *****\n")).otherwise(
        F.array_join(F.transform("s", lambda x: x["s"]), "\n"))
    name = F.concat(F.lit("Query= q"), F.col("query").cast("string"), F.lit(" "), F.translate("c_name", "#", " "))
    size = F.concat(F.lit("\n\nLength="), (F.col("query") * 3).cast("string"))
    text = F.concat(F.when(odd & (F.col("query") % 10 == 0), F.lit("Query= ")).otherwise(name), F.lit("\nsecond line"),
                    F.when(odd & (F.col("query") % 10 == 1), F.lit("")).otherwise(size), F.lit("\n\n"), found)
    path = scratch_path(spark, "blastn")
    sinks.write_lines(blocks, text, path)
    return path


@query_as("read_blastn_report")
def read_blastn_queries(spark, d):
    queries, _ = sources.read_blastn_report(spark, write_nucleotide_report(spark, d))
    return queries.select("query_name", "query_description", "query_length", "no_hits").distinct()


@query
def read_blastn_subjects(spark, d):
    queries, subjects = sources.read_blastn_report(spark, write_nucleotide_report(spark, d))
    return hits.query_hits(queries, subjects, ["file", "query"], False).select(
        "query_name", "name", "description", "length", "expect")


@query
def report_skipped(spark, d):
    """Blocks that a reader of a damaged report leaves out."""
    skipped = sources.blastn_skipped(spark, write_nucleotide_report(spark, d, damaged=True))
    return skipped.groupBy("kind", "reason").agg(F.sum("n").alias("n"))


@query
def read_damaged_subjects(spark, d):
    _, subjects = sources.read_blastn_report(spark, write_nucleotide_report(spark, d, damaged=True))
    return subjects.select("name", "description", "length", "expect")


@query
def write_query_hits(spark, d):
    """All queries of the report, one line each, with all fields of their subjects."""
    path = scratch_path(spark, "allhits")
    sinks.write_query_hits(*sources.read_blastn_report(spark, write_nucleotide_report(spark, d)), path)
    return text_of(spark, path)


@query
def write_nohits(spark, d):
    """Queries of the whole report that have no subject."""
    path = scratch_path(spark, "nohits")
    queries, subjects = sources.read_blastn_report(spark, write_nucleotide_report(spark, d))
    sinks.write_nohits(hits.query_nohits(queries, subjects, ["file", "query"]), path)
    return text_of(spark, path)


def write_protein_report(spark, d):
    """Users as contigs, event types as genes, in the layout of a BLASTP report.

    A block has a user's events of one run of 1000 event numbers, so its size is bounded.
    """
    bits = F.when(F.col("event_id") % 2 == 1, F.lit(".5")).otherwise(F.lit(""))
    summary = F.format_string("lcl|x%d [gene=%s] [protein=some pro...   %d%s  %de-%s",
                              "event_id", "event_type", F.col("event_id") % 900 + 50, bits,
                              F.col("event_id") % 9 + 1, F.lpad((F.col("event_id") % 190).cast("string"), 3, "0"))
    head = F.format_string("> lcl|x%d [gene=%s] [protein=%s kind of\nprotein %d]\nLength=100\n",
                           "event_id", "event_type", "event_type", F.col("event_id") % 10)
    lines = table(spark, d, "events").select(
        F.floor(F.col("event_id") / 1000).alias("run"), F.col("user_id").alias("u"), "event_id",
        summary.alias("s"), head.alias("h"))
    blocks = lines.groupBy("run", "u").agg(F.array_sort(F.collect_list(F.struct("event_id", "s", "h"))).alias("l"))
    text = F.concat(
        F.lit("Query= VCU"), F.col("u").cast("string"), F.lit("contig"), F.col("u").cast("string"),
        F.lit("\n\nLength=300\nSequences producing:\n\n"),
        F.array_join(F.transform("l", lambda x: x["s"]), "\n"), F.lit("\n\n"),
        F.array_join(F.transform("l", lambda x: x["h"]), "\n"))
    path = scratch_path(spark, "blastp")
    sinks.write_lines(blocks, text, path, ["run", "u"])
    return path


@query_as("read_blastp_report")
def read_blastp_summary(spark, d):
    rows = sources.blastp_summary(spark, write_protein_report(spark, d))
    return hits.high_scoring(rows, F.col("bits")).select("contig", "gene", "bits", "evalue")


@query
def read_blastp_descriptions(spark, d):
    texts = sources.blastp_descriptions(spark, write_protein_report(spark, d))
    return texts.groupBy("gene", "description").agg(F.count(F.lit(1)).alias("n"))


@query
def report_best_hits(spark, d):
    """From report text to the best-hit table."""
    path = write_protein_report(spark, d)
    found = hits.high_scoring(sources.blastp_summary(spark, path), F.col("bits"))
    return hits.best_hits(found, sources.blastp_descriptions(spark, path), "place", 1e-50)


@query
def read_bp_hits(spark, d):
    path = scratch_path(spark, "bp")
    lines = F.concat(
        F.lit("SUB:"), F.col("id"), F.lit(" x\n"),
        F.format_string("sc:10 sb:%d se:%d end\nsc:11 sb:%d se:%d end", "start", "end",
                        F.col("start") + 5, F.col("end") + 5))
    sinks.write_lines(label_hits(spark, d), lines, path)
    return sources.read_bp_hits(spark, path).select("id", "start", "end")


@query
def read_tables(spark, d):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    counts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
              for n, t in sources.read_tables(spark, names, d).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query
def load_model(spark, d):
    path = scratch_path(spark, "model")
    sinks.save_model(markov_train(spark, d), path)
    return sources.load_model(spark, path)


@query
def write_dump(spark, d):
    path = scratch_path(spark, "dump")
    sinks.write_dump(markov.dump_model(markov_train(spark, d), MARKOV_ORDER), path)
    return lines_of(spark, path)


@query
def write_table(spark, d):
    path = scratch_path(spark, "profile")
    sinks.write_table(group_profile(spark, d).withColumn("avg_value", F.format_string("%.4f", "avg_value")),
                      path, order=["event_type"])
    return lines_of(spark, path)


@query
def write_hits(spark, d):
    path = scratch_path(spark, "windows")
    top = pssm_top_hits(spark, d).withColumn("name", F.concat(F.lit("D"), F.col("doc_id").cast("string")))
    sinks.write_hits(top, path)
    return lines_of(spark, path)


@query
def write_scores(spark, d):
    """Model score of each document with the fields of a header, best first."""
    path = scratch_path(spark, "scores")
    heads = table(spark, d, "documents").select("doc_id", protein_header(F.concat(
        F.lit("tr|D"), F.col("doc_id").cast("string"), F.lit("|D_X text "), F.col("lang"), F.lit(" OS="), F.col("source"),
        F.lit(" GN=g"), F.col("n_chars").cast("string"), F.lit(" PE=3 SV=1"))).alias("h")).select("doc_id", "h.*")
    scored = markov_score(spark, d).join(heads, "doc_id")
    fields = [c for c in heads.columns if c != "doc_id"]
    sinks.write_scores(scored, "score", ["doc_id", *fields], path, [F.desc("score"), F.asc("doc_id")])
    return lines_of(spark, path)


@query
def write_statistics(spark, d):
    path = scratch_path(spark, "stats")
    sinks.write_statistics(assembly_statistics(spark, d).withColumns(
        {c: F.format_string("%.3f", c) for c in ("avg_length", "gc_percent", "n50_avg")}), path)
    return spark.read.text(path).select("file", "value")


@query
def write_best_hits(spark, d):
    """Best hits as a tab file, by contig and gene."""
    path = scratch_path(spark, "best")
    sinks.write_table(best_hits(spark, d).withColumn("evalue", F.format_string("%.4f", "evalue")), path,
                      header=False, order=["contig", "gene"])
    return lines_of(spark, path)


@query
def write_support_rows(spark, d):
    """The join of the four tables as a tab file."""
    path = scratch_path(spark, "rows")
    sinks.write_table(support_rows(spark, d), path, header=False, order=["refseq", "tool", "unigene"])
    return text_of(spark, path)


@query
def write_support(spark, d):
    path = scratch_path(spark, "support")
    sinks.write_support(cut_lineage(support_join(spark, d)), support_tools(spark, d), path)
    return lines_of(spark, path)


@query
def write_multi_contig(spark, d):
    """The line of each gene; it may be very long, so the check reads it by its tabs."""
    path = scratch_path(spark, "contigs")
    contig = F.col("contig").cast("string")
    rows = multi_contig_hits(spark, d).select(
        "gene", F.lpad(contig, F.greatest(F.length(contig), F.lit(5)), F.lit("0")).alias("contig"),  # never cut
        F.format_string("%.4f", "evalue").alias("evalue"))
    sinks.write_multi_contig(rows, path)
    fields = number_rows(read_records(spark, path, "\t"), [F.col("file"), F.col("split"), F.col("row")], "field")
    return fields.select("field", "value")


@query
def write_alignment(spark, d):
    path = scratch_path(spark, "alignment")
    sinks.write_alignment(format_alignment(spark, d), ["doc_id"], path)
    return lines_of(spark, path)


@query
def write_gtr(spark, d):
    path = scratch_path(spark, "gtr")
    merges = linkage.linkage_single(brand_leaves(spark, d))
    sinks.write_gtr(merges.withColumn("sim", F.round("sim", 4)), path)
    return lines_of(spark, path)


@query
def write_cdt(spark, d):
    path = scratch_path(spark, "cdt")
    leaves = brand_leaves(spark, d)
    order = tree.leaf_order(cut_lineage(linkage.linkage_complete(leaves)))
    sinks.write_cdt(leaves, order, [f"m{m}" for m in range(1, 13)], path)
    return lines_of(spark, path)


@query
def write_gtr_vectors(spark, d):
    """The tree of all embeddings."""
    path = scratch_path(spark, "gtr")
    merges = linkage.linkage_single(embedding_leaves(spark, d))
    sinks.write_gtr(merges.withColumn("sim", F.format_string("%.4f", "sim")), path)
    return lines_of(spark, path)


@query
def write_cdt_vectors(spark, d):
    """All embeddings in the order of their tree."""
    path = scratch_path(spark, "cdt")
    leaves = embedding_leaves(spark, d)
    order = tree.leaf_order(cut_lineage(linkage.linkage_complete(leaves)))
    width = leaves.agg(F.max(F.size("vec"))).first()[0] or 0
    shown = leaves.withColumn("vec", F.transform("vec", lambda x: F.format_string("%.6f", x)))
    sinks.write_cdt(shown, order, [f"e{i}" for i in range(1, width + 1)], path)
    return lines_of(spark, path)

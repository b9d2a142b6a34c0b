from conftest import rows
from seqframe.operators.hits import best_hits, multi_contig_hits, query_hits, query_nohits
from seqframe.operators.support import support_join, support_rows, support_tools

HITS = [  # contig, gene, e-value text, line
    ("c1", "g1", "0.0   ", 1), ("c1", "g2", "7e-059", 2), ("c1", "g2", "1e-10", 3), ("c2", "g1", "e-105", 4),
    ("c2", "g3", "1e-50", 5), ("c3", "g3", "2e-70", 6), ("c3", "g3", "3e-80", 7), ("c4", "g1", "0.5", 8)]


def test_best_hits(spark):
    hits = spark.createDataFrame(HITS, "contig string, gene string, evalue string, n int")
    texts = spark.createDataFrame([("g1", "old", 1), ("g1", "new", 2)], "gene string, description string, n int")
    assert rows(best_hits(hits, texts, "n", 1e-50)) == [
        ("c1", "g1", "new", "0.0   "), ("c2", "g1", "new", "e-105"), ("c3", "g3", None, "3e-80")]


def test_multi_contig_counts_rows_and_lists_all(spark):
    hits = spark.createDataFrame(HITS, "contig string, gene string, evalue string, n int")
    assert rows(multi_contig_hits(hits, "n", 1e-50, 1)) == [
        ("g1", 2, "c1", "0.0   "), ("g1", 2, "c2", "e-105"), ("g1", 2, "c4", "0.5"),
        ("g3", 2, "c2", "1e-50"), ("g3", 2, "c3", "3e-80")]


def test_queries_with_and_without_hits(spark):
    queries = spark.createDataFrame([("q1", 5), ("q2", 6)], "query string, n int")
    subjects = spark.createDataFrame([("q1", "s1"), ("q1", "s2")], "query string, subject string")
    assert rows(query_hits(queries, subjects, "query")) == [
        ("q1", 5, "s1"), ("q1", 5, "s2"), ("q2", 6, None)]
    assert rows(query_hits(queries, subjects, "query", False)) == [("q1", 5, "s1"), ("q1", 5, "s2")]
    assert rows(query_nohits(queries, subjects, "query")) == [("q2", 6)]


def tables(spark):
    genes = spark.createDataFrame(
        [("NM1", "1", 10, 20, "kinase"), ("NM2", "2", 30, 40, None), ("NM3", "3", 1, 2, "x")],
        "refseq string, chromosome string, ch_start int, ch_end int, description string")
    expression = spark.createDataFrame(
        [("Hs1", "t", "liver"), ("Hs2", "t", "liver"), ("Hs3", "t", "brain")], "gene string, type string, tissue string")
    targets = spark.createDataFrame(
        [("m", g, t) for g in ("NM1", "NM2", "NM3") for t in ("A", "B", "C", "A")] + [
            ("m", "NM1", "D"), ("other", "NM1", "E"), ("miRNA", "NM1", "F")], "miRNA string, gene string, tool string")
    mapping = spark.createDataFrame(
        [("Hs1", "NM1"), ("Hs2", "NM2"), ("Hs3", "NM3")], "unigene string, refseq string")
    return genes, expression, targets, mapping


def test_support(spark):
    t = tables(spark)
    found = rows(support_rows(*t, "m", "liver"))
    assert len(found) == 9 and {r[1] for r in found} == {"NM1", "NM2"}
    report = support_join(*t, "m", "liver")
    assert [tuple(r) for r in report.collect()] == [
        ("m", "NM1", "Hs1", "t", "liver", "1", 10, 20, "kinase", 4),
        ("m", "NM2", "Hs2", "t", "liver", "2", 30, 40, "NULL", 3)]
    assert rows(support_tools(report, t[2], "m").select("gene", "tool")) == [
        ("NM1", "A"), ("NM1", "B"), ("NM1", "C"), ("NM1", "D"), ("NM2", "A"), ("NM2", "B"), ("NM2", "C")]
    assert support_join(*t, "miRNA", "liver", 1).count() == 0

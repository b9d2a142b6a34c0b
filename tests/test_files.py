import glob

import pytest
from pyspark.sql import functions as F

from conftest import rows
from seqframe import sinks, sources
from seqframe.sources import reports
from seqframe.plans.search import search_assemblies, search_folder, search_hits
from seqframe.sinks import text


def content(path):
    return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_fasta(spark, lines_file):
    lines_file("a/x.fsa", ">one desc\r\nacgt\r\nAC\r\n>two\nGG\n\n>empty\n>last\nTT")
    lines_file("a/y.fsa", ">other\nA\n")
    folder = lines_file("a/z.txt", ">no\nC\n").rsplit("/", 1)[0]
    got = sources.read_fasta(spark, folder, "*.fsa")
    assert rows(got.select("header", "seq")) == sorted(
        [("one desc", "ACGTAC"), ("two", "GG"), ("empty", ""), ("last", "TT"), ("other", "A")], key=repr)
    assert [r.header for r in got.filter(F.col("file").endswith("x.fsa")).orderBy("split", "row").collect()] == [
        "one desc", "two", "empty", "last"]
    assert rows(sources.first_record(got).select("header")) == [("one desc",), ("other",)]


def test_fasta_split_inside_records(spark, lines_file):
    records = [(f"h{i}", "ACGT" * (i % 50)) for i in range(400)]
    path = lines_file("big.fa", "".join(f">{h}\n{s}\n" for h, s in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = sources.read_fasta(spark, path)
        assert [(r.header, r.seq) for r in got.orderBy("split", "row").collect()] == records
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables(spark, lines_file):
    path = lines_file("i.txt", "AccessionID\tStart\tEnd\nABC\t14\t30\t\nX\t1\t2\n\n")
    assert rows(sources.read_intervals(spark, path)) == [("ABC", 14, 30), ("X", 1, 2)]
    path = lines_file("m.txt", "gene\ts1\ts2\na\t1.5\t-2\nb\t0\t3\n")
    assert rows(sources.read_matrix(spark, path)) == [("a", [1.5, -2.0]), ("b", [0.0, 3.0])]
    path = lines_file("p.txt", "Aacid\tA\tR\nA\t9867\t2\nR\t1\t9913\n")
    assert sorted((r.i, r.j, round(r.value, 4)) for r in sources.read_substitutions(spark, path).collect()) == [
        ("A", "A", 0.9867), ("A", "R", 0.0002), ("R", "A", 0.0001), ("R", "R", 0.9913)]
    head = "\t".join(["tracking_id"] + ["x"] * 9 + ["FPKM"])
    path = lines_file("t.txt", head + "\ng1" + "\t-" * 5 + "\t3:1-5" + "\t-" * 3 + "\t2.5\ng2" + "\t-" * 9 + "\t0\n")
    assert rows(sources.read_tracking(spark, path).select("gene", "chr", "value")) == [("g1", "3", 2.5), ("g2", None, 0.0)]


def test_motifs(spark, lines_file):
    path = lines_file("m.txt", "71-urt  attaA\n71-x\tACGTT\n#\n")
    assert rows(sources.read_motifs(spark, path)) == [("71-urt", "ATTAA"), ("71-x", "ACGTT")]
    with pytest.raises(ValueError):
        sources.read_motifs(spark, lines_file("bad.txt", "a  ACGT\nb  ACG\n"))


NUCLEOTIDE = """BLASTN 2.2.28+
Some preamble Length=1

Query= all0001 unknown
protein

Length=173

>Contig12.revised.gene3.protein  first
            Length = 400

 Score = 22, Expect = 2e-017
 Score = 20, Expect = 5.0
>Contig1234.revised.gene7.protein
Length= 50

 Score = 9, Expect = 0.1

Query= all0002 nothing here

Length=99

 ***** No hits found *****

Query= broken
no length
>Contig1.revised.gene1.protein x
Query= all0003 last
Length=5
"""


@pytest.mark.parametrize("size", ["134217728", "60"])
def test_nucleotide_report(spark, lines_file, tmp_path, size):
    path = lines_file("r.txt", NUCLEOTIDE)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        queries, subjects = sources.read_blastn_report(spark, path)
        assert rows(queries.select("query_name", "query_description", "query_length", "no_hits")) == [
            ("all0001", "unknown protein", 173, False), ("all0002", "nothing here", 99, True), ("all0003", "last", 5, False)]
        assert rows(subjects.select("name", "description", "length", "expect")) == [
            ("012.003", "first", 400, "2e-017"), ("1234.007", "", 50, "0.1")]
        out = str(tmp_path / f"out{size}")
        sinks.write_query_hits(queries, subjects, out)
        assert content(out) == (
            "all0001,unknown protein,173,012.003,first,400,2e-017,1234.007,,50,0.1\n"
            "all0002,nothing here,99\nall0003,last,5\n")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_runs_without_subjects_are_read_by_many_tasks(spark, lines_file):
    """No record is longer than a line, wherever a split ends; a length far behind its name is found."""
    many = "".join(f"Query= all{i:05d} d{i}\n{'more' if i % 3 else 'Length=7'}\n\nLength={i + 10}\n ***** No hits found\n" for i in range(2000))
    tail = "Query= far x\n" + "filler\n" * 3000 + "Length=9\n>Contig1.revised.gene2.protein y\n" + "filler\n" * 3000 + "Length=8, Expect = 3\n"
    path = lines_file("many.txt", many + tail)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = reports._lines(spark, path)
        assert lines.rdd.getNumPartitions() > 30 and lines.agg(F.max(F.length("value"))).first()[0] < 60
        queries, subjects = sources.read_blastn_report(spark, path)
        got = {r.query_name: (r.query_description, r.query_length, r.no_hits) for r in queries.collect()}
        assert got == {"far": ("x filler", 9, False), **{
            f"all{i:05d}": (f"d{i} more" if i % 3 else f"d{i}", i + 10 if i % 3 else 7, True) for i in range(2000)}}
        assert rows(subjects.select("name", "length", "expect")) == [("001.002", 8, "3")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


PROTEIN = """Query= VCU014contig00001

lcl|x [gene=SERP1] [protein=ribosomal...   512  0.0   
lcl|x [gene=SERP2] [protein=weak...   99  1e-3
lcl|x [gene=SERP2] [protein=S1...   120  5e-085

> lcl|x [gene=SERP1] [protein=ribosomal protein]
Length=5
> lcl|x [gene=SERP2] [protein=S1 RNA
 binding] more
Query= VCU014contig00002
lcl|y [gene=SERP1] [protein=r...  1000  2e-129
"""


@pytest.mark.parametrize("size", ["134217728", "70"])
def test_protein_report(spark, lines_file, size):
    path = lines_file("p.txt", PROTEIN)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        summary = sources.blastp_summary(spark, path).orderBy("place").drop("place")
        assert [tuple(r) for r in summary.collect()] == [
            ("VCU014contig00001", "SERP1", 512, "0.0   "), ("VCU014contig00001", "SERP2", 99, "1e-3"),
            ("VCU014contig00001", "SERP2", 120, "5e-085"), ("VCU014contig00002", "SERP1", 1000, "2e-129")]
        assert rows(sources.blastp_descriptions(spark, path).drop("place")) == [
            ("SERP1", "ribosomal protein"), ("SERP2", "S1 RNA binding")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bp_hits(spark, lines_file):
    path = lines_file("h.bp", "x sb:1 se:2 end\nSUB:Seq1 foo\n sc:1 sb:5 se:9 end\n sb:9 se:5 end\nSUB:Seq2\nsb:3 se:4 z\n")
    assert rows(sources.read_bp_hits(spark, path).drop("file")) == [
        ("Seq1", 5, 9), ("Seq1", 9, 5), ("Seq2", 3, 4), (None, 1, 2)]


def test_ragged_writers(spark, tmp_path):
    hits = spark.createDataFrame([("g1", 2, "c2", "1e-60"), ("g1", 2, "c1", "0.0  "), ("g2", 3, "c9", "1")],
                                 "gene string, n_below long, contig string, evalue string")
    sinks.write_multi_contig(hits, str(tmp_path / "m"))
    assert content(tmp_path / "m") == "\ng1\t c1\t0.0  \tc2\t1e-60\t\ng2\t c9\t1\t"
    report = spark.createDataFrame([("m", "G", "u", "t", "ti", "1", 1, 2, "d", 2)],
                                   "miRNA string, gene string, unigene string, type string, tissue string, "
                                   "chromosome string, ch_start int, ch_end int, description string, tool_count long")
    tools = spark.createDataFrame([("G", 2, "B"), ("G", 2, "A")], "gene string, tool_count long, tool string")
    sinks.write_support(report, tools, str(tmp_path / "s"))
    assert content(tmp_path / "s") == "m\tG\tu\tt\tti\t1\t1\t2\td\nTools: A, B, \tTool Count: 2\n\n"


def test_line_writers(spark, tmp_path):
    windows = spark.createDataFrame([("a", 1.26, 5, "ACG"), ("b", 7.0, 1, "TTT")],
                                    "name string, score double, start int, window string")
    sinks.write_hits(windows, str(tmp_path / "h"))
    assert content(tmp_path / "h") == "        b    7.0      1 TTT\n        a    1.3      5 ACG\n"
    sinks.write_scores(windows, "score", ["name", "start"], str(tmp_path / "s"), ["name"])
    assert content(tmp_path / "s") == "   1.3\ta\t5\n   7.0\tb\t1\n"
    cuts = spark.createDataFrame([("id", 2, 4, "ACG")], "id string, start int, end int, fragment string")
    sinks.write_fasta(cuts, str(tmp_path / "f"), text.interval_header(), "fragment")
    assert content(tmp_path / "f") == ">id | start=2 | end=4\nACG\n"


def test_tree_files(spark, tmp_path):
    merges = spark.createDataFrame([(1, "NODE1", "GENE2", "GENE1", 0.5)], "step long, node string, left string, right string, sim double")
    sinks.write_gtr(merges, str(tmp_path / "g"))
    assert content(tmp_path / "g") == "NODE1X\tGENE2X\tGENE1X\t0.5\n"
    leaf_rows = spark.createDataFrame([(1, "a", [1.0, 2.5]), (2, "b", [0.0, -1.0])], "leaf long, name string, vec array<double>")
    order = spark.createDataFrame([("GENE2", 1), ("GENE1", 2)], "leaf string, position long")
    sinks.write_cdt(leaf_rows, order, ["s1", "s2"], str(tmp_path / "c"))
    assert content(tmp_path / "c") == (
        "GID\tCLID\tNAME\tGWEIGHT\ts1\ts2\nEWEIGHT\t\t\t\t1\t1\n"
        "GENE2X\tb\tb\t1\t0.0\t-1.0\nGENE1X\ta\ta\t1\t1.0\t2.5\n")


def test_model_round_trip(spark, tmp_path):
    model = spark.createDataFrame([("A", "C", 3), ("", "A", 1)], "context string, symbol string, n long")
    sinks.save_model(model, str(tmp_path / "m"))
    assert rows(sources.load_model(spark, str(tmp_path / "m"))) == rows(model)


def test_search_finds_both_strands(spark):
    gene = "ACGTTGCAAGTCCGATTACA"
    back = gene[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assemblies = spark.createDataFrame([
        ("f1", "s1 [organism=x]", "TTTT" + gene + "GGGG"), ("f2", "s1 [organism=y]", "CC" + back + "TT")],
        "file string, header string, seq string")
    genes = spark.createDataFrame([("g", gene)], "gene string, seq string")
    assert rows(search_hits(assemblies, genes, 11, 20)) == [
        ("f1", "s1", "g", 5, 24, 20), ("f2", "s1", "g", 22, 3, 20)]
    assert {r.fragment for r in search_assemblies(assemblies, genes, 11, 20, complemented=True).collect()} == {gene}


def test_search_of_a_folder_by_pieces(spark, lines_file):
    """Files by pattern, records over many lines, hits over line ends, on both strands; files without hits have statistics."""
    gene = "ACGTTGCAAGTCCGATTACAGGTTCA"
    back = gene[::-1].translate(str.maketrans("ACGT", "TGCA"))
    bent = gene[:13] + "T" + gene[13:]

    def lines(seq):
        return "\n".join(seq[i:i + 7] for i in range(0, len(seq), 7))

    one = lines_file("in/a.fsa", f">s1 [organism=x]\n{lines('TTTT' * 30 + gene + 'GGGG')}\n>s2\n{lines('CC' + bent.lower())}\n")
    lines_file("in/b.fsa", f">s1\r\n{lines('CC' + back + 'TT')}\r\n>s3\n>s4\n{lines('ACAC' * 9)}\n")
    lines_file("in/c.fsa", f">only\n{lines('GATTACA')}\n")
    lines_file("in/d.txt", f">s1\n{gene}\n")
    genes = spark.createDataFrame([("g", gene)], "gene string, seq string")
    folder = one.rpartition("/")[0]
    statistics, hits_found = search_folder(spark, folder, genes, "*.fsa", 9, 15, complemented=True)
    got = sorted((r.file.rpartition("/")[2], r.id, r.start, r.end, r.fragment) for r in hits_found.collect())
    assert got == [("a.fsa", "s1", 121, 146, gene), ("a.fsa", "s2", 3, 29, bent), ("b.fsa", "s1", 28, 3, gene)]
    assert {r.file.rpartition("/")[2]: r.n50 for r in statistics.collect()} == {"a.fsa": 150, "b.fsa": 36, "c.fsa": 7}
    whole = sources.read_fasta(spark, folder, "*.fsa").select("file", "header", "seq")
    assert rows(search_assemblies(whole, genes, 9, 15, complemented=True)) == rows(hits_found)


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_lines_become_sections_where_they_are_read(spark, lines_file, monkeypatch, batch):
    """A row per section, and one more per batch of lines at most; only what crosses a border is looked up."""
    path = lines_file("r.txt", NUCLEOTIDE)
    kept = {}
    monkeypatch.setattr(reports, "cut_lineage", lambda df, label="step": kept.setdefault(label, df.localCheckpoint()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        queries, subjects = sources.read_blastn_report(spark, path)
        assert rows(queries.select("query_name", "query_description", "query_length", "no_hits")) == [
            ("all0001", "unknown protein", 173, False), ("all0002", "nothing here", 99, True), ("all0003", "last", 5, False)]
        assert rows(subjects.select("name", "description", "length", "expect")) == [
            ("012.003", "first", 400, "2e-017"), ("1234.007", "", 50, "0.1")]
        lines = NUCLEOTIDE.splitlines()
        batches, heads = -(-len(lines) // int(batch)), sum(x.startswith(("Query=", ">")) for x in lines)
        assert kept["carried"].count() == batches
        assert kept["report-sections"].count() <= heads + batches
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

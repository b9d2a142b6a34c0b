import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_archives_search import check_packing, plain_contamination
from test_dedup import plain_near, plain_repeats
from test_models import EN, FR, sentences

import __spark_entry__ as entry
import corpus_pipeline
from seqframe.llm import crossparse, queries

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, docs, items, extra=""):
    schema = SCHEMA + extra
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def corpus(rng):
    texts = [(t, "en") for t in sentences(EN, 40, rng, 8, 90)] + [(t, "fr") for t in sentences(FR, 30, rng, 8, 90)]
    passage = " ".join(sentences(EN, 4, rng, 25, 30))
    items = [(i, " ".join(rng.choice(EN.split()) for _ in range(15))) for i in range(5)] + [(9, None)]
    for i in range(8):
        texts.append((texts[i][0] + " " + passage + " " + texts[-i - 1][0], "en"))
        words = texts[20 + i][0].split() * 8
        texts.append((" ".join(words), "en"))
        texts.append((" ".join(words[:-1] + ["changed"]), "en"))
        texts.append((texts[i][0], "en"))
    texts += [(f"before {t} after", "en") for _, t in items[:4]] + [(None, "en"), ("", None), ("12 %", "fr"), ("É" * 90, None)]
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)], items


def as_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_every_stage_equals_the_plain_version(spark, tmp_path):
    import hashlib

    docs, items = corpus(random.Random(10))
    sf = folder(spark, tmp_path, docs, items)
    frames, df = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, sf).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        frames[name] = df
    model = crossparse.fit(spark.read.parquet(f"{sf}/documents.parquet").filter(queries.remainder("doc_id", 5) != 0))
    expected = [d for d in docs if model.predict([d[1]])[0] != ["und"]]
    assert len(expected) == len(docs) - 3
    assert sorted(as_rows(frames["language"])) == sorted(expected)

    near = {i for i, _, low in plain_near([d[:2] for d in expected]) if i == low}
    expected = [d for d in expected if d[0] in near]
    assert len(near) <= len(docs) - 8 and sorted(as_rows(frames["near_duplicates"])) == sorted(expected)

    cut = {r[0]: r for r in plain_repeats([d[:2] for d in expected], 50)}
    got = {r[0]: r for r in as_rows(frames["repeats"])}
    assert set(got) == set(cut) and any(r[2] for r in cut.values())
    for d in expected:
        key, _, removed, _, digest = cut[d[0]]
        if not removed:
            assert got[key] == d
        elif d[1].isascii():
            assert hashlib.sha256(got[key][1].encode()).hexdigest() == digest
        assert got[key][2:4] == d[2:4] and (got[key][4] == len(got[key][1]))

    judged = {r[0]: r[4] for r in plain_contamination([r[:2] for r in got.values()], items, 13)}
    expected = [r for r in got.values() if not judged[r[0]]]
    assert any(judged.values()) and sorted(as_rows(frames["benchmark"])) == sorted(expected)

    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces = frames["sequences"].collect()
    check_packing(pieces, 4096)
    for r in expected:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2]
        own = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == r[0])
        assert own == [(at, len(ids[at:at + 4096]), zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes()))
                       for at in range(0, len(ids), 4096)]
    assert {p.doc_id for p in pieces} == {r[0] for r in expected}


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null ids, repeated rows, other columns with names that the stages use."""
    big = (1 << 60) + 1
    docs = [(None, "the and of to in that is was", "en", None, None, 1, "x"), (big, "the and of to in É", "en", "s", 17, 2, "y"),
            (big, "the and of to in É", "en", "s", 17, 2, "y"), (7, "la le les des une dans", "fr", "s", None, 3, None)]
    sf = folder(spark, tmp_path, docs, [(None, None)], ", kept_id long, component_id string")
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())
    assert got == {None: 1, big: 2, 7: 1}


def test_empty_tables_pass_all_stages(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_columns_on_whole_tables(spark, name):
    rows = entry.queries()[name](spark, TABLES)
    table = {"op1": "pages", "op6": "pages", "op10": None, "op5": None, "op12": None}.get(name.split("_")[0], "documents")
    if table:
        assert rows.count() == spark.read.parquet(f"{TABLES}/{table}.parquet").count()
    else:
        assert rows.count() > 0


def test_language_keeps_the_wanted_languages(spark, monkeypatch):
    texts = [(t, "en") for t in sentences(EN, 40, random.Random(3), 8, 90)] + \
        [(t, "fr") for t in sentences(FR, 30, random.Random(4), 8, 90)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(corpus_pipeline, "WANTED", ["fr"])
    kept = [r.lang for r in corpus_pipeline.language(spark, docs, TABLES).collect()]
    assert kept == ["fr"] * 30

import hashlib
import random

import numpy as np
import pytest

from seqframe.llm import doubling, queries

SCHEMA = "doc_id long, text string, n_words double, kept string, longest int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in rows], SCHEMA)


def plain(rows, width):
    """Removed words and longest window of each row, by comparing all windows; ids in any order, null last."""
    words = [(1 << 63 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first, count = {}, {}
    length = width
    for i, w in words:
        for j in range(len(w) - width + 1):
            key = tuple(w[j:j + width])
            first[key] = min(first.get(key, (1 << 64, 0)), (i, j))
    longest = [0] * len(rows)
    while True:
        count = {}
        for _, w in words:
            for j in range(len(w) - length + 1):
                key = tuple(w[j:j + length])
                count[key] = count.get(key, 0) + 1
        more = False
        for n, (_, w) in enumerate(words):
            if any(count[tuple(w[j:j + length])] > 1 for j in range(len(w) - length + 1)):
                longest[n], more = length, True
        if not more:
            break
        length *= 2
    out = []
    for (i, _), (key, w), most in zip(rows, words, longest):
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j:j + width])] < (key, j):
                gone[j:j + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), most, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), r.longest,
                    hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=repr)


def some_rows(seed, n=70):
    rng = random.Random(seed)
    letters = ["a", "b", "É", "ǘ", " x", "c.", "A"]
    passages = [[rng.choice(letters) + str(rng.randrange(30)) for _ in range(rng.randrange(4, 220))] for _ in range(5)]
    rows = []
    for i in rng.sample(range(300), n):
        w = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a:a + rng.randrange(1, 250)] + [f"only{rng.random()}"] * rng.randrange(2)
        rows.append((i, rng.choice(["", " ", "\n\t"]) + rng.choice([" ", "\x0b", "  ", "\r\n"]).join(w)))
    return rows


@pytest.mark.parametrize("width,seed", [(20, 1), (6, 2), (2, 3)])
def test_equal_to_the_plain_version(spark, width, seed):
    rows = some_rows(seed) + [(900, None), (901, ""), (902, " \n"), (903, "z " * 19), (904, "z " * 60), (None, "z " * 20)]
    got = found(doubling.repeated_passages(frame(spark, rows).repartition(5), width=width))
    assert got == plain(rows, width)
    assert sum(r[2] for r in got) > 0 and max(r[3] for r in got) > width


def test_blocks_slices_and_second_keys_change_nothing(spark, monkeypatch):
    """Also one passage in most texts, and texts longer than a slice and a block."""
    rows = some_rows(7) + [(1000 + i, "hot " + " ".join(f"h{j}" for j in range(40)) + f" t{i}") for i in range(60)]
    rows.append((5000, " ".join(f"h{j % 40}" for j in range(3000))))
    monkeypatch.setattr(doubling, "SLICE", 37)
    monkeypatch.setattr(doubling, "check_type", lambda size: np.uint16)
    monkeypatch.setattr(doubling.B.batches, "__defaults__", (900,))
    assert found(doubling.repeated_passages(frame(spark, rows).repartition(4))) == plain(rows, 20)


def test_rows_of_one_id_are_laid_over_each_other(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(3, passage), (3, passage), (3, "before " + passage), (4, passage)]
    got = {(r.doc_id, r.n_words): [*zip(r.starts, r.ends)] for r in
           doubling.repeated_passages(frame(spark, rows).repartition(3)).collect()}
    assert got == {(3, 25): [], (3, 26): [(1, 26)], (4, 25): [(0, 25)]}


def test_no_rows(spark):
    assert doubling.repeated_passages(frame(spark, [])).count() == 0


def test_false_matches_need_wide_keys():
    assert doubling.check_type(10 ** 6) is None
    assert doubling.check_type(10 ** 14) == np.uint64 or doubling.check_type(10 ** 14) == np.uint32


def test_query_is_the_operator_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, d, "documents").collect()]
    want = {(a, b, c, e) for a, b, c, _, e in plain(rows, 20)}
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in
           queries.QUERIES["op13_substring_dedup"](spark, d).collect()}
    assert got == want and len(got) == len(rows)

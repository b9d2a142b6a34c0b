import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqframe.llm import components, radix, simhash

SCHEMA = "doc_id long, text string, score double, component_id long, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 7, 1) for i, t in rows], SCHEMA)


# --- repeated windows -----------------------------------------------------------------

def plain_repeats(rows, width):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - width + 1):
            w = b[j:j + width]
            first[w] = min(first.get(w, 1 << 63), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if first[b[j:j + width]] < i:
                cover[j:j + width] = b"\1" * width
        runs = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((i, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found_repeats(spans):
    return sorted((r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends)), len(r.starts),
                   hashlib.sha256(bytes(r.kept)).hexdigest()) for r in spans.collect())


@pytest.mark.parametrize("width", [50, 20])
def test_repeats_equal_the_plain_version(spark, width):
    rng = random.Random(width)
    base = ["".join(rng.choice("ab é") for _ in range(300)) for _ in range(4)]
    rows = [(i, "word " * i) for i in range(8)]
    for i in range(60):
        x = rng.randrange(200)
        rows.append((100 + rng.randrange(50), rng.choice(["", "zz", "q" * 70]) + rng.choice(base)[x:x + rng.randrange(10, 100)]
                     + rng.choice(base)[:rng.randrange(120)] + rng.choice(base)[-rng.randrange(1, 90):]))
    rows += [(900, None), (901, ""), (902, "a" * 500), (903, "a" * 49), (904, "a" * 50), (5, "a" * 60), (5, "a" * 60)]
    rng.shuffle(rows)
    got = found_repeats(radix.repeated_spans(frame(spark, rows).repartition(5), width=width))
    assert got == plain_repeats(rows, width)


def test_repeats_of_long_texts_over_chunks_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(radix, "CHUNK", 2000)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(4000))) + shared[i * 7:i * 50 + 400])
            for i in range(20)]
    got = found_repeats(radix.repeated_spans(frame(spark, rows).repartition(6)))
    assert got == plain_repeats(rows, 50) and sum(r[2] for r in got) > 0


def test_repeats_without_rows_or_ids(spark):
    assert radix.repeated_spans(frame(spark, [])).count() == 0
    rows = radix.repeated_spans(frame(spark, [(None, "x" * 60), (3, "x" * 60)])).collect()
    assert {r.doc_id: len(r.kept) for r in rows} == {3: 60, None: 0}


# --- components -----------------------------------------------------------------------

def plain_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(5, 3), (3, 5), (3, 4), (9, -8)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 50)],
])
def test_components(spark, links):
    got = components.components(spark.createDataFrame(links, "x long, y long"))
    assert {r.node: r.root for r in got.collect()} == plain_components(links)


# --- fingerprints ---------------------------------------------------------------------

def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = plain_components(links + [(i, i) for i in range(len(rows))])
    low = {}
    for i, (key, _) in enumerate(rows):
        low[root[i]] = min(low.get(root[i], key), key)
    return sorted((key, prints[i], low[root[i]]) for i, (key, _) in enumerate(rows))


def test_near_copies_equal_the_plain_version(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(300)] + ["É", "Ä b", "MiXed"]
    rows = [(1000, None), (999, ""), (998, " \n\t"), (5, "one two"), (6, "ONE  two"), (7, "one two three four")]
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([3, 30, 400]))]
        for _ in range(rng.choice([1, 1, 4])):
            rows.append((rng.randrange(10, 900), " ".join(text)))
            text[rng.randrange(len(text))] = rng.choice(words)
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id)
                 for r in simhash.near_copies(frame(spark, rows)).collect())
    assert got == plain_near(rows)
    assert simhash.near_copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cell_rows", [4096, 20])
def test_links_join_all_close_fingerprints(spark, monkeypatch, cell_rows):
    """Chains, clusters and cells that are cut into blocks."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    rng = random.Random(cell_rows)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([0, 1, 3, 4, 5])):
                x ^= 1 << b
    prints = np.array(sorted(prints), np.uint64)
    near = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4]
    rows = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    got = simhash.links(rows).collect()
    place = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    links = [(place[r.a], place[r.b]) for r in got]
    assert all(int(prints[i] ^ prints[j]).bit_count() <= 4 for i, j in links)
    assert plain_components(links) == plain_components(near)


def test_embedding_bounds_the_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in a], np.uint64)
    x, y = simhash.cells(a, 4), simhash.cells(a ^ flips, 4)
    assert x.shape[1] == 70 and (x == y).any(axis=1).all()


def test_fingerprint_bits_are_those_of_spark(spark):
    text = "alpha beta gamma delta"
    h = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert plain_fingerprint(text) == h % (1 << 64)

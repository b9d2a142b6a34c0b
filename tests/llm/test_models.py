import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from seqframe.llm import compression, crossparse, interpolation

EN = "the and of to in that is was for with as on are this have from by not but what all were when we there can"
FR = "le la les des une dans est pour que qui sur avec pas plus par son ses mais nous vous être cette ont été"


def sentences(words, n, rng, low=3, high=30):
    own = words.split()
    return [" ".join(rng.choice(own) + rng.choice(["", "", rng.choice(own)]) for _ in range(rng.randrange(low, high)))
            for _ in range(n)]


# --- deleted interpolation ------------------------------------------------------------

def plain_scores(rows, training, held):
    split = [["\n" if i == len(w) else x for i, x in enumerate([*w, ""])]
             for w in (re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
                       for _, t in rows)]

    def counted(pick):
        single, pair = Counter(), Counter()
        for tokens, p in zip(split, pick):
            if p:
                single.update(tokens)
                pair.update(zip(["\n", *tokens], tokens))
        return single, pair

    def estimates(tokens, single, pair):
        n, v = sum(single.values()), len(single)
        for context, token in zip(["\n", *tokens], tokens):
            c = single[context]
            yield (pair[context, token] / c if c else 0.0, single[token] / max(n, 1), (single[token] + 1) / (n + v + 1), c)

    def bucket(c):
        return min(int(math.log2(c)) + 1, interpolation.BUCKETS - 1) if c else 0

    def ratio(x, base):
        reach = interpolation.STEP * interpolation.REACH
        return int(np.clip(np.round(interpolation.STEP * np.log2(x / base)), -reach, reach)) + reach + 1 if x else 0

    kept = counted([t and not h for t, h in zip(training, held)])
    cells = Counter()
    whole = counted(training)
    for tokens, t, h in zip(split, training, held):
        if t and h:
            single = kept[0]
            n, v = sum(single.values()), len(whole[0])
            for context, token in zip(["\n", *tokens], tokens):
                c, base = single[context], (single[token] + 1) / (n + v + 1)
                cells[bucket(c), ratio(kept[1][context, token] / c if c else 0, base), ratio(single[token] / max(n, 1), base)] += 1
    weights = interpolation.learn(pd.DataFrame([(*k, n) for k, n in cells.items()], columns=["bucket", "after", "single", "n"]))
    out = []
    for (key, _), tokens, t in zip(rows, split, training):
        found = list(estimates(tokens, *whole))
        score = sum(math.log10(np.dot(weights[bucket(c)] if whole[0] else [0, 0, 1], (a, s, b))) for a, s, b, c in found)
        out.append((key, t, len(tokens), sum(whole[0][x] > 0 for x in tokens), sum(whole[0].values()),
                    round(sum(math.log10(b) for _, _, b, _ in found), 6), round(score, 6)))
    return sorted(out, key=repr)


def scored(spark, rows, training, held):
    frame = spark.createDataFrame([(k, t, bool(a), bool(b), 1.0) for (k, t), a, b in zip(rows, training, held)],
                                  "doc_id long, text string, a boolean, b boolean, score double").repartition(3)
    got = interpolation.score(frame, F.col("a"), F.col("b")).collect()
    return sorted([(*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in got], key=repr)


def test_scores_equal_the_plain_version(spark):
    rng = random.Random(2)
    rows = list(enumerate(sentences(EN, 60, rng))) + [(90, None), (91, ""), (92, " \t"), (93, "The THE the É"),
                                                      (None, "the of"), (3, "the of"), (3, "the of")]
    training = [rng.random() < 0.8 for _ in rows]
    held = [rng.random() < 0.2 for _ in rows]
    got = scored(spark, rows, training, held)
    assert got == plain_scores(rows, training, held)


def test_pairs_raise_the_score_of_unseen_texts(spark):
    rng = random.Random(12)
    chains = [w.split() for w in ("the big dog ran home", "a small cat sat here", "we all saw it there")]
    rows = [(i, " ".join(w for _ in range(9) for w in rng.choice(chains))) for i in range(120)]
    got = scored(spark, rows, [i % 7 != 2 for i in range(120)], [i % 7 == 3 for i in range(120)])
    unseen = [r for r in got if not r[1]]
    assert unseen and all(r[6] > 0.5 * r[5] for r in unseen)


def test_scores_without_training(spark):
    rows = [(1, "a b"), (2, None)]
    got = scored(spark, rows, [False, False], [False, False])
    assert [r[2:5] for r in got] == [(3, 0, 0), (1, 0, 0)] and all(r[5] == r[6] for r in got)
    assert scored(spark, [], [], []) == []


def test_probabilities_add_up(spark):
    """Over all words after one context, the unknown one included."""
    rng = random.Random(5)
    rows = list(enumerate(sentences("a b c d", 40, rng)))
    words = sorted({w for _, t in rows for w in t.split()})
    asked = [(1000 + i, w) for i, w in enumerate([*words, "zz"])] + [(999, "")]
    got = scored(spark, rows + asked, [True] * len(rows) + [False] * len(asked), [i % 5 == 0 for i in range(len(rows))]
                 + [False] * len(asked))
    # P(word | start) = P(text) / P(end | word) <= 1 in sum; the texts alone must stay below 1
    assert 0 < sum(10 ** r[6] for r in got if r[0] is not None and r[0] >= 999) < 1


# --- cross parsing --------------------------------------------------------------------

def test_phrases_equal_the_plain_parse():
    rng = random.Random(3)
    samples = {"en": " ".join(sentences(EN, 30, rng)), "fr": " ".join(sentences(FR, 30, rng))}
    model = crossparse.Model(samples).build()

    def spelled(text):
        return bytes(model.letters.codes(text)).decode("latin-1")

    def plain(text, sample):
        n = total = 0
        for at in range(0, len(text), crossparse.PIECE):
            part, i = text[at:at + crossparse.PIECE], 0
            while i < len(part):
                j = i + 1
                while j < len(part) and part[i:j + 1] in sample:
                    j += 1
                i, total = j, total + 1
        return total

    texts = sentences(EN, 20, rng) + sentences(FR, 20, rng) + ["qqq zzz", "x", "The!! 12 der", " ".join(sentences(EN, 300, rng))]
    got, sizes = model.phrases(texts)
    for t, counts, size in zip(texts, got.T, sizes):
        assert size == len(spelled(t))
        expected = [plain(spelled(t), spelled(s)) for s in model.texts.values()]
        assert counts.tolist() == expected


def test_languages(spark):
    rng = random.Random(4)
    rows = [(i, t, "en") for i, t in enumerate(sentences(EN, 150, rng, 10, 40))]
    rows += [(1000 + i, t, "fr") for i, t in enumerate(sentences(FR, 150, rng, 10, 40))]
    rows += [(2000, None, "en"), (2001, "", "fr"), (2002, "12 !!", None), (2003, "the and of that is", None),
             (2004, "des une dans est pour " * 4000, "en"), (2003, "the and of that is", None)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows],
                                 "doc_id long, text string, lang string, score double, lang_pred string")
    model = crossparse.fit(docs.filter("doc_id % 5 != 0 and doc_id < 2000"))
    got = {r.doc_id: r for r in crossparse.predict(docs, model, ["doc_id"]).collect()}
    assert crossparse.predict(docs, model, ["doc_id"]).count() == len(rows)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if i < 2000 and i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in range(2000, 2005)] == ["und", "und", "und", "en", "fr"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2000].score == 0


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = crossparse.fit(docs)
    assert [r.lang_pred for r in crossparse.predict(docs, model, ["doc_id"]).collect()] == ["und", "und"]
    assert crossparse.predict(docs.limit(0), model, ["doc_id"]).count() == 0


# --- compression ----------------------------------------------------------------------

def test_quality(spark):
    rng = random.Random(6)
    good, bad = sentences(EN, 300, rng, 20, 60), [s.upper().replace(" ", "!! ") for s in sentences(EN, 100, rng, 20, 60)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]
    docs = spark.createDataFrame([(i, t, 0.1, y) for i, t, y in rows] + [(5000, None, 0.1, 1), (5001, "", 0.1, 1),
                                 (5002, good[0] * 500, 0.1, 0)], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (7, None, 0), (9999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = compression.fit(docs, labels.filter("doc_id is null or doc_id % 4 != 2"))
    got = {r.doc_id: r.score for r in compression.score(docs, model, ["doc_id"]).collect()}
    held = [(got[i] >= 0.7, y == 1) for i, _, y in rows if i % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert got[5000] == got[5001] and 0 <= got[5000] <= 1 and got[5002] >= 0.7


def plain_quality(rows, texts):
    """Scores of ``texts`` by loops: labelled ``rows`` (id, text, y) in the order of the hash of their id, two dictionaries of
    the first of each label, sizes of blocks with either, and a curve that descends to where its gradient is zero."""
    def place(i):
        first = xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
        h = xxhash.xxh64(struct.pack("<i", 4), seed=first).intdigest()
        return h - (1 << 64) if h >> 63 else h

    own = {y: [t for _, t in sorted({(place(i), t) for i, t, z in rows if z == y})][:1600] for y in (0, 1)}
    cut = {y: min(400, max(1, len(t) * 2 // 3)) for y, t in own.items()}

    def pieces(text):
        data = text.encode()
        return [data[i:i + 2048] for i in range(0, len(data), 2048)]

    dictionary = {y: zstandard.train_dictionary(32_768, [p for t in own[y][:cut[y]] for p in pieces(t)], level=3) for y in own}

    def sizes(text, y):
        tool = zstandard.ZstdCompressor(level=3, dict_data=dictionary[y], write_content_size=False, write_checksum=False,
                                        write_dict_id=False)
        return sum(len(tool.compress(p)) for p in pieces(text))

    def features(text):
        if not text:
            return 0.0, 1.0
        good, bad = sizes(text, 1), sizes(text, 0)
        return (bad - good) / (bad + good), min(good, bad) / len(text.encode())

    found = [(features(t), y, Counter(z for _, _, z in rows)[y] / len(rows) / len(own[y][cut[y]:]))
             for y in own for t in own[y][cut[y]:]]
    low = float(np.quantile([f[1] for f, y, _ in found if y == 1], 0.1))
    x = np.array([(f[0], min(f[1], low), 1.0) for f, _, _ in found])
    y, w = np.array([y for _, y, _ in found]), np.array([w for *_, w in found]) * len(found)
    scale = np.append(np.abs(x[:, :2]).max(axis=0), 1.0)
    at, x = np.zeros(3), x / scale
    step = 1 / ((w[:, None] * x ** 2).sum() / 4 + 0.01)
    ahead, t = at, 1.0
    for _ in range(60_000):  # descent with momentum
        gradient = x.T @ (w * (1 / (1 + np.exp(-(x @ ahead))) - y)) + [1e-2, 1e-2, 1e-6] * ahead
        after, t_after = ahead - step * gradient, (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, at, t = after + (t - 1) / t_after * (after - at), after, t_after
    a, b, c = at / scale
    return [1 / (1 + math.exp(-(a * f[0] + b * min(f[1], low) + c))) for f in map(features, texts)]


def test_quality_is_that_of_the_plain_version(spark):
    """Repeated rows, empty, null and very long texts, and a label that says two things, too."""
    rng = random.Random(8)
    mixed = lambda: [" ".join(rng.choices([EN, FR.upper()], [w, 1 - w])[0].split()[rng.randrange(20)] for _ in range(90))
                     for w in [rng.uniform(0.35, 1)] * 2]
    rows = [(i, t, 1) for i, t in enumerate(t for _ in range(75) for t in mixed())]
    rows += [(1000 + i, t.swapcase(), 0) for i, t in enumerate(t for _ in range(60) for t in mixed())]
    rows += [(i, t, 1 - y) for i, t, y in rows[::20]]
    other = [None, "", "a", rows[0][1] * 40, rows[-1][1] * 400, "é" * 5000]
    docs = {i: t for i, t, _ in rows} | {5000 + i: t for i, t in enumerate(other)}
    table = spark.createDataFrame([*docs.items(), (5003, other[3])], "doc_id long, text string")
    model = compression.fit(table, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    got = sorted((r.doc_id, r.score) for r in compression.score(table, model, ["doc_id"]).collect())
    want = dict(zip(docs, plain_quality(rows, docs.values())))
    assert [i for i, _ in got] == sorted([*docs, 5003])
    assert [s for _, s in got] == pytest.approx([want[i] for i, _ in got], abs=1e-3)


@pytest.mark.parametrize("labels, expected", [([], 0.5), ([(1, 1), (2, 1)], 0.999), ([(1, 0), (2, 0)], 0.001)])
def test_quality_without_both_labels(spark, labels, expected):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    model = compression.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [round(r.score, 6) for r in compression.score(docs, model, ["doc_id"]).collect()] == [expected] * 2
    assert compression.score(docs.limit(0), model, ["doc_id"]).count() == 0

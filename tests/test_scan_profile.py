import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from seqframe.operators.profile import contig_stats, group_profile, n50_stats
from seqframe.operators.scan import fill_forward, number_rows, running_total, with_next


def test_group_profile_ties_and_zero_groups(spark):
    df = spark.createDataFrame([
        ("1", "a", 5.0, 1), ("1", "b", 5.0, 2), ("1", "c", 0.0, 3), ("1", "d", 2.0, 4), ("1", "e", 2.0, 5),
        ("2", "z", 0.0, 6), ("2", "y", 0.0, 7), ("X", "n", -1.0, 8)], "chr string, id string, v double, no int")
    got = {r.chr: tuple(r)[1:] for r in group_profile(df, "chr", "id", "v", "no").collect()}
    assert got["1"] == (5, 4, 2.0, 5.0, 3.5, "d", "a")
    assert got["2"] == (2, 0, None, None, None, None, None)
    assert got["X"] == (1, 1, -1.0, -1.0, -1.0, "n", "n")


def brute_n50(lengths):
    total, taken = sum(lengths), []
    for size in sorted(lengths, reverse=True):
        if sum(taken) < total / 2:
            taken.append(size)
    return (len(taken), min(taken, default=None), sum(taken) / len(taken) if taken else None)


def test_n50_and_stats_against_loop(spark):
    rng = random.Random(1)
    files = {f"f{i}": [rng.choice([0, 1, 5, 5, 9, 30, 5000]) for _ in range(rng.randint(1, 40))] for i in range(12)}
    files["empty"] = [0, 0]
    files["one"] = [7]
    df = spark.createDataFrame([(f, "GcAT" * (n // 4) + "A" * (n % 4)) for f, ns in files.items() for n in ns],
                               "file string, seq string")
    got = {r.file: tuple(r)[1:] for r in n50_stats(df, "file", "seq").collect()}
    for f, ns in files.items():
        count, low, mean = brute_n50(ns)
        assert got[f][:2] == (count, low)
        assert got[f][2] == (None if mean is None else pytest.approx(mean))
    stats = {r.file: r for r in contig_stats(df, "file", "seq").collect()}
    for f, ns in files.items():
        assert (stats[f].n, stats[f].total_length, stats[f].min_length, stats[f].max_length) == (
            len(ns), sum(ns), min(ns), max(ns))
        assert stats[f].gc_total == sum(2 * (n // 4) for n in ns)
    assert stats["empty"].gc_percent is None


def test_fill_forward_across_buckets(spark):
    data = [("a", i, v) for i, v in enumerate([None, 1, None, None, None, None, 2, None, None])]
    data += [("b", i, None) for i in range(5)] + [("b", 5, 9)]
    df = spark.createDataFrame(data, "g string, i int, v int")
    got = {(r.g, r.i): r.v for r in fill_forward(df, "v", "g", "i", F.floor(F.col("i") / 2)).collect()}
    assert [got["a", i] for i in range(9)] == [None, 1, 1, 1, 1, 1, 2, 2, 2]
    assert [got["b", i] for i in range(6)] == [None] * 5 + [9]


def test_running_total_and_next_and_numbers(spark):
    df = spark.createDataFrame([("g", i, i * i) for i in range(50)], "g string, i int, v long")
    got = {r.i: r.t for r in running_total(df, "v", "g", F.col("i"), F.floor(F.col("i") / 7), "t").collect()}
    assert got == {i: sum(j * j for j in range(i)) for i in range(50)}
    bucketed = df.withColumn("b", F.floor(F.col("i") / 7))
    following = {r.i: r.n for r in with_next(bucketed, "v", "g", "b", "i", "n").collect()}
    assert following == {i: (i + 1) ** 2 if i < 49 else None for i in range(50)}
    numbered = number_rows(df, [F.desc("v")], "no")
    assert rows(numbered.select("i", "no")) == sorted(((49 - n, n + 1) for n in range(50)), key=repr)

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import align


def test_shifts_by_blocks_equal_all_differences(spark):
    rnd = random.Random(18)
    old = [(g, k) for g in "ab" for k in rnd.sample(range(-3000, 30_000), 900)]
    new = [(g, k + (37 if g == "a" else 0)) for g, k in old if rnd.random() < 0.7] + [("a", rnd.randrange(30_000)) for _ in range(500)]
    o, n = (spark.createDataFrame(x, "g string, k long") for x in (old, new))
    for reach in (50, 6000):
        want = {}
        for g in "ab":
            a, b = {k for h, k in old if h == g}, {k for h, k in new if h == g}
            hits = Counter(y - x for x in a for y in b if 0 <= y - x < reach)
            shift = min(hits, key=lambda s: (-hits[s], s))
            want[g] = (shift, hits[shift], len(a))
        assert {r.g: (r.shift, r.hits, r.n) for r in align.best_shift(o, n, ["g"], "k", reach).collect()} == want


def test_correlation_equals_differences():
    rnd = np.random.default_rng(1)
    a, b = np.unique(rnd.integers(0, 4096, 3000)), np.unique(rnd.integers(0, 6000, 5000))
    few, align.PAIRS = align.PAIRS, 0
    try:
        by_correlation = align.shift_hits(a, b, 2000)
    finally:
        align.PAIRS = few
    apart = (b[None, :] - a[:, None]).ravel()
    assert by_correlation.tolist() == np.bincount(apart[(apart >= 0) & (apart < 2000)], minlength=2000).tolist()


def test_a_dense_run_of_keys(spark):
    """A run of 300,000 keys meets 2,000 shifts without a row for each pair."""
    o = spark.range(300_000).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    r = align.best_shift(o, o.withColumn("k", F.col("k") + 1234), ["g"], "k", 2000).first()
    assert (r.shift, r.hits, r.n) == (1234, 300_000, 300_000)


def test_pairing_in_rounds_equals_one_after_the_other(spark):
    rnd = random.Random(19)
    rows = {(g, rnd.randrange(40), rnd.randrange(40)): rnd.choice([0.5, 0.7, 0.9]) for g in (1, 2, 3) for _ in range(300)}
    used, want = set(), set()
    for g, o in sorted({k[:2] for k in rows}):
        free = sorted((-s, n) for (h, p, n), s in rows.items() if (h, p) == (g, o) and (g, n) not in used)
        if free:
            used.add((g, free[0][1]))
            want.add((g, o, free[0][1], -free[0][0]))
    df = spark.createDataFrame([(*k, s) for k, s in rows.items()], "parent long, old long, new long, score double")
    for most in (10**6, 260, 20):
        assert {tuple(r) for r in align.one_to_one(df, ["parent"], "parent long, old long, new long, score double", most).collect()} == want


def test_similar_sets_are_all_pairs_that_reach_the_similarity(spark):
    rnd = random.Random(20)
    side = lambda: {i: {int(rnd.random() ** 2 * 30) for _ in range(rnd.randrange(1, 9))} for i in range(60)}
    a, b = side(), side()
    frame = lambda d, k: spark.createDataFrame([("g" if i % 2 else "h", i, m) for i, s in d.items() for m in s], f"g string, {k} long, m int")
    for least in (0.3, 0.6, 1.0):
        got = {(r.a_key, r.b_key): (r.shared, r.a_size, r.b_size) for r in align.similar_sets(frame(a, "a_key"), frame(b, "b_key"), ["g"], "m", least).collect()}
        assert got == {(i, j): (len(s & t), len(s), len(t)) for i, s in a.items() for j, t in b.items() if i % 2 == j % 2 and s & t and len(s & t) / len(s | t) >= least - 1e-9}


def test_walks_carry_their_shift(spark):
    df = spark.createDataFrame([([1, 5, 9, 40], [3, 7, 30, 12]), ([], [1]), ([2], [])], "o array<bigint>, n array<bigint>")
    got = [[tuple(x) for x in r.leaves] for r in align.greedy_leaves(df, "o", "n").collect()]
    assert got == [[(1, 3), (5, 7), (9, 12)], [], []]


def test_few_pairs_of_sets_meet_whole(spark, monkeypatch):
    """Sets of a hundred of two thousand members: at a low bound nearly all share a first member, hardly any enough of them."""
    rnd = random.Random(21)
    rows = [(i, m) for i in range(120) for m in rnd.sample(range(2000), 100)] + [(i + 1000, m) for i in range(5) for m in range(5000, 5100 + i)]
    df = spark.createDataFrame(rows, "k long, m long")
    kept = []
    own = align.stored
    monkeypatch.setattr(align, "stored", lambda x: kept.append(own(x)) or kept[-1])
    got = {(r.a_key, r.b_key) for r in align.jaccard_pairs(df, df, "k", "m", 0.15, half=True).collect()}
    assert got == {(1000 + i, 1000 + j) for i in range(5) for j in range(i + 1, 5)}
    assert kept[-1].count() < 100  # of 7,875
    monkeypatch.setattr(align, "LISTED", 2)
    assert {(r.a_key, r.b_key) for r in align.jaccard_pairs(df, df, "k", "m", 0.15).where("a_key < b_key").collect()} == got


def test_many_small_blocks_are_counted_together(spark, monkeypatch):
    """Keys far apart: a block is a row among others, no group of its own."""
    rnd = random.Random(22)
    old = [(g, rnd.randrange(-(10**8), 10**8)) for g in (1, 2, None) for _ in range(400)]
    new = [(g, k + 5) for g, k in old] + [(1, k + 7) for g, k in old[:100]]
    o, n = (spark.createDataFrame(x, "g int, k long") for x in (old + old[:50], new))
    found = align.best_shift(o, n, ["g"], "k", 100)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    want = {(g, 5, 400, 400) for g in (1, 2)}
    assert {tuple(r) for r in found.select("g", "shift", "hits", "n").collect()} == want
    monkeypatch.setattr(align, "PAIRS", 3)
    assert {tuple(r) for r in align.best_shift(o, n, ["g"], "k", 100).select("g", "shift", "hits", "n").collect()} == want

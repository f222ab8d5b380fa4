import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import align, joins, scan, sequence
from palimpsest.operators.scan import running


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    one = [("all", i, rnd.choice([None, 1, 2, 3])) for i in rnd.sample(range(10_000), 900)]
    return [*one, *((g, i, rnd.choice([None, 5])) for g in ("a", "b", None) for i in rnd.sample(range(100), 20))]


def plain(rows, n):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        values = [r[2] for r in own]
        for i, r in enumerate(own):
            real = [v for v in values[: i + 1] if v is not None]
            later = [v for v in values[i + 1 :] if v is not None]
            out[r[:2]] = (sum(real), real[-1] if real else None, later[0] if later else None, values[i - n] if i >= n else None, values[i + n] if i + n < len(own) else None)
    return out


@pytest.mark.parametrize("most", [10, 300, 10**6])
def test_running_values_equal_plain_loops_whatever_the_ranges(spark, rows, most):
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(3)
    v = F.col("v")
    for n in (1, 7):
        got = running(df, ["g"], [F.col("k")], sums={"s": v}, lasts={"l": v}, nexts={"n": v}, shifts={"b": (v, n), "f": (v, -n)}, most=most)
        assert {(r.g, r.k): (r.s, r.l, r.n, r.b, r.f) for r in got.collect()} == plain(rows, n)
    back = running(df, ["g"], [F.desc("k")], sums={"s": F.lit(1)}, most=most).collect()
    assert {(r.g, r.k): r.s for r in back} == {(g, k): sum(1 for x in rows if x[0] == g and x[1] >= k) for g, k, _ in rows}


def test_one_group_of_all_rows_lies_in_many_tasks(spark):
    df = spark.range(40_000).select(F.lit("all").alias("g"), ((F.col("id") * 7919) % 40_000).alias("k"))
    out = running(df, ["g"], [F.col("k")], sums={"s": F.lit(1)}, most=4000)
    assert out.where("s <> k + 1").count() == 0
    # ranges are even, so no task sees more than its share
    ranged = df.repartitionByRange(40, "g", "k").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert ranged < 4000


def test_ordered_operators_agree_however_groups_are_cut(spark, rows):
    df = spark.createDataFrame([(g or "none", k, v) for g, k, v in rows], "g string, k int, v int")
    anchors = df.where("v IS NOT NULL AND k % 3 = 0").select("g", "k", (F.col("k") % 2).alias("a"))
    spans = anchors.select("g", F.col("k").alias("lo"), (F.col("k") + 4).alias("hi"), F.col("k").alias("name")).where("lo % 6 = 0")
    by, order = ["g"], [F.col("k")]

    def all_of(most):
        return [
            sequence.islands(df, by, "k", 9, most),
            sequence.with_previous(df, by, order, "v", 3, most),
            sequence.last_before(df, by, order, F.col("v"), "x", most),
            sequence.first_after(df, by, order, F.col("v"), "x", most),
            sequence.from_end(df, by, [F.desc("k")], most=most),
            sequence.running_label(df, by, order, F.col("v") == 1, F.col("k").cast("string"), ".", most=most),
            sequence.depth_blocks(df, by, order, F.col("k") % 2, F.lit(1) - F.col("k") % 2, most),
            sequence.leading_block(df, by, [F.desc("k")], F.col("v") == 3, most),
            sequence.tiles(df, by, "k", most),
            sequence.cumulative(df, by, order, "v", most=most),
            align.as_of(df, anchors, by, "k", "a", most=most),
            align.bracketed(df, anchors, by, "k", "a", most=most),
            joins.containing(df, spans, by, "k", "lo", "hi", ["name"], most),
            align.gap_fill(df, df.withColumn("k", F.col("k") + F.col("k") % 1), anchors.where("k % 2 = 0").select("g", F.col("k").alias("old_at"), F.col("k").alias("new_at")), by, "k", "v", most),
        ]

    for cut, whole in zip(all_of(100), all_of(10**6)):
        key = lambda r: repr(tuple(r))
        names = sorted(whole.columns)
        assert sorted(map(key, cut.select(names).collect())) == sorted(map(key, whole.select(names).collect()))
        assert whole.count()


def test_as_of_and_bracketed_on_equal_keys(spark):
    rows = spark.createDataFrame([("g", k) for k in (0, 1, 2, 3, 4, 5, 6)], "g string, k int")
    anchors = spark.createDataFrame([("g", 1, 7), ("g", 3, 7), ("g", 5, 8)], "g string, k int, a int")
    for most in (3, 100):
        told = align.bracketed(align.as_of(rows, anchors, ["g"], "k", "a", most=most), anchors, ["g"], "k", "a", most=most).orderBy("k").collect()
        assert [r.as_of for r in told] == [None, 7, 7, 7, 7, 8, None]
        assert [r.bracketed for r in told] == [None, 7, 7, 7, None, 8, None]


def test_ranges_follow_the_rows_and_not_a_small_limit(spark, monkeypatch):
    """A limit of ten rows cuts a group, but not into hundreds of tasks that each tell the driver of themselves."""
    asked = []
    kind = type(spark.range(1))
    own = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *c: asked.append(n) or own(self, n, *c))
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    out = scan.running(df, ["g"], [F.col("k")], sums={"s": F.lit(1)}, shifts={"b": (F.col("k"), 2)}, most=10).collect()
    assert {tuple(r) for r in out} == {("g", i, i + 1, i - 2 if i > 1 else None) for i in range(5000)}
    assert asked == [scan.FEW]

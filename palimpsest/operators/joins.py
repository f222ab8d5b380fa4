"""Joins of special shapes: prefix closures, intervals, look-ups with defaults, recursive paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import MOST, running
from .staged import staged


def present_by_prefix(requested: DataFrame, value: str, corpus: DataFrame, items: Column, sep: str) -> DataFrame:
    """The requested values that equal some prefix of a corpus row's items."""
    from ..functions.text import prefixes

    seen = corpus.select(F.explode(prefixes(items, sep)).alias(value)).distinct()
    return requested.join(seen, value, "left_semi")


def present_or_parent(requested: DataFrame, value: str, seen: DataFrame, parent: Column) -> DataFrame:
    """The requested values that seen (a column of the same name) has, or whose parent it has; found_by tells which."""
    held = seen.select(F.col(value).alias("__v")).distinct()
    asked = requested.withColumn("__parent", parent)
    own = asked.join(held.withColumn("__own", F.lit(True)), F.col(value) == F.col("__v"), "left").drop("__v")
    both = own.join(held.withColumn("__up", F.lit(True)), F.col("__parent") == F.col("__v"), "left").drop("__v")
    by = F.when(F.col("__own"), "value").when(F.col("__up"), "parent")
    return both.withColumn("found_by", by).where("found_by IS NOT NULL").select(*requested.columns, "found_by")


def containing(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, names: list[str], most: int = MOST) -> DataFrame:
    """points with names from the interval of their group that holds them (start inclusive, end exclusive), null without one.

    Intervals of a group don't overlap: the last start at or below a point is found in one ordered pass.
    """
    own = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), *names)
    both = points.withColumns({"__i": F.lit(None).cast(intervals.select(own.alias("x")).schema["x"].dataType), "__is": F.lit(0)}).unionByName(
        intervals.select(*by, F.col(start).alias(at), own.alias("__i"), F.lit(1).alias("__is")), allowMissingColumns=True
    )
    out = running(both, by, [F.col(at), F.desc("__is")], lasts={"__last": F.col("__i")}, most=most).where("__is = 0")
    inside = F.col(at) < F.col("__last.e")
    return out.select(*points.columns, *(F.when(inside, F.col(f"__last.{n}")).alias(n) for n in names))


def with_default(df: DataFrame, crosswalk: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with name: the crosswalk's value of key, or the key itself."""
    return df.join(crosswalk.select(key, F.col(value).alias(name)), key, "left").withColumn(name, F.coalesce(name, key))


def with_fallback(df: DataFrame, exact: DataFrame, loose: DataFrame, key: str, loose_key: str, value: str) -> DataFrame:
    """df with value: by key, else by loose_key."""
    a = exact.select(key, F.col(value).alias("__exact"))
    b = loose.select(loose_key, F.col(value).alias("__loose"))
    return df.join(a, key, "left").join(b, loose_key, "left").withColumn(value, F.coalesce("__exact", "__loose")).drop("__exact", "__loose")


def parent_paths(nodes: DataFrame, node: str, parent: str, label: str, sep: str = ".") -> DataFrame:
    """Each node's labels from the root down, joined by sep, and depth; a cycle's walk ends where it would repeat.

    Pointers are doubled: each round hangs what is known of a node's next ancestor onto
    its own walk, so rounds grow with the logarithm of the longest chain, and none is cut
    short. A node with a null id is left out; of several rows of one node the least by parent and label
    counts; a null label is empty.
    """
    one = F.struct(F.col(parent).alias("up"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
    known = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(one).alias("x"))
    walks = staged(known.select("node", F.col("x.up").alias("next"), F.array("node").alias("seen"), F.array("x.label").alias("labels")))
    while not walks.where("next IS NOT NULL").isEmpty():
        beyond = walks.select(F.col("node").alias("next"), F.col("next").alias("__next"), F.col("seen").alias("__seen"), F.col("labels").alias("__labels"))
        # of what lies beyond, as much as the walk hasn't met
        again = F.array_position(F.transform("__seen", lambda x: F.array_contains("seen", x)), True)
        fresh = F.when(F.col("__seen").isNull(), 0).when(F.arrays_overlap("seen", "__seen"), again - 1).otherwise(F.size("__seen")).cast("int")
        more = lambda own, other: F.concat(F.col(own), F.when(F.col("__seen").isNull(), F.slice(own, 1, 0)).otherwise(F.slice(other, F.lit(1), fresh)))
        ends = F.when(fresh == F.size("__seen"), F.col("__next"))
        walks = staged(walks.join(beyond, "next", "left").select("node", ends.alias("next"), more("seen", "__seen").alias("seen"), more("labels", "__labels").alias("labels")))
    return walks.select(F.col("node").alias(node), F.array_join(F.reverse("labels"), sep).alias("path"), F.size("labels").alias("depth"))


def zipped(df: DataFrame, keep: list[str], a: str, b: str) -> DataFrame:
    """The places of two arrays of one length: keep, place (from 0), a_value, b_value; rows of other lengths give none."""
    same = df.where(F.size(a) == F.size(b))
    return same.select(*keep, F.posexplode(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))).alias("place", "z")).select(*keep, "place", F.col("z.x").alias("a_value"), F.col("z.y").alias("b_value"))


def call_arguments(calls: DataFrame, roles: DataFrame, function: str, args: str, names: list[str]) -> DataFrame:
    """calls with, for each of names, the argument at the place that roles gives for the function (from 0; null if there is none)."""
    found = calls.join(roles.select(function, *(F.col(n).alias(f"__{n}") for n in names)), function)
    return found.select(*calls.columns, *(F.get(F.col(args), F.col(f"__{n}")).alias(n) for n in names))

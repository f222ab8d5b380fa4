"""Which entries are looked at, what kind a name is of, and one plan from routes to resolvers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import route


def allowed(name: Column | str, allow: list[str], deny: list[str]) -> Column:
    """Whether a name starts with one of allow, if there are any, and with none of deny."""
    n = F.col(name) if isinstance(name, str) else name
    one_of = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(n, p))
    return (one_of(allow) if allow else F.lit(True)) & (~one_of(deny) if deny else F.lit(True))


def kind_of(name: Column | str, kinds: dict[str, str], at: str = "end") -> Column:
    """The kind of the longest suffix (at="end"), prefix ("start") or part ("anywhere") that the name has; null without one. kinds is a configured list."""
    n = F.col(name) if isinstance(name, str) else name
    has = {"end": F.endswith, "start": F.startswith, "anywhere": F.contains}[at]
    out = F.lit(None).cast("string")
    for affix in sorted(kinds, key=lambda a: (len(a), a)):
        out = F.when(has(n, F.lit(affix)), kinds[affix]).otherwise(out)
    return out


def family_of(name: Column | str) -> Column:
    """A name's first two parts at underscores."""
    n = F.col(name) if isinstance(name, str) else name
    return F.substring_index(n, "_", 2)


def routed(entries: DataFrame, anchored: DataFrame, skip: list[str], shapes: list[tuple[str, str]], resolvers: dict[str, DataFrame]) -> DataFrame:
    """entries: name, value. Adds route, new_value, confidence and status by one join.

    anchored names have their value told (name, new_value); names of the families in skip stay; else the
    shape of the value decides (see paths.shapes), static without one. resolvers: per route, name,
    new_value and confidence. status: anchored, skipped, static, migrated, unchanged or unresolved.
    """
    told = anchored.select("name", F.col("new_value").alias("__anchored"))
    j = entries.join(told, "name", "left")
    rules = [("anchor", F.col("__anchored").isNotNull()), ("skip", ~allowed("name", [], skip))]
    j = route(j, [*rules, *((k, F.col("value").rlike(p)) for k, p in shapes)], "static")
    every = None
    for k, df in resolvers.items():
        one = df.select(F.lit(k).alias("route"), "name", F.col("new_value").alias("__told"), F.col("confidence").cast("double").alias("__c"))
        every = one if every is None else every.unionByName(one)
    if every is None:
        j = j.withColumns({"__told": F.lit(None).cast("string"), "__c": F.lit(None).cast("double")})
    else:
        j = j.join(every, ["route", "name"], "left")
    r = F.col("route")
    value = F.when(r == "anchor", F.col("__anchored")).when(r.isin("skip", "static"), F.col("value")).otherwise(F.col("__told"))
    status = (
        F.when(r == "anchor", "anchored").when(r == "skip", "skipped").when(r == "static", "static")
        .when(F.col("__told").isNull(), "unresolved").when(F.col("__told") == F.col("value"), "unchanged").otherwise("migrated")
    )
    confidence = F.when(r.isin("anchor", "skip", "static"), 1.0).otherwise(F.col("__c"))
    return j.select(*entries.columns, "route", value.alias("new_value"), confidence.alias("confidence"), status.alias("status"))

"""Resolution by keys: maps from groups, guarded lookups, votes and ranks.

Every choice among ties has an explicit total order, every lookup an explicit status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_map(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and value for the keys with exactly one distinct non-null value."""
    return df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min(value).alias(value), F.max(value).alias("__other")).where(F.col(value) == F.col("__other")).drop("__other")


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    picked = F.min_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*order))
    return df.groupBy(*key).agg(picked.alias("__row")).select(*key, "__row.*")


def last_wins(df: DataFrame, key: list[str], value: str, order: list[Column]) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def unique_both_ways(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new joined on keys that occur once on each side; other columns come from both."""
    once = lambda df: df.groupBy(*key).agg(F.count("*").alias("__n"), *(F.min(c).alias(c) for c in df.columns if c not in key)).where("__n = 1").drop("__n")
    return once(old).join(once(new), key)


def two_hop(entries: DataFrame, backward: DataFrame, forward: DataFrame, value: str = "value", path: str = "path") -> DataFrame:
    """entries' old values to their path, if just one, and that path's new value; status tells what came of it.

    backward: old value and path, many to many. forward: path and new_value, one each.
    """
    paths = backward.groupBy(value).agg(F.min(path).alias(path), F.max(path).alias("__other"))
    found = entries.join(paths, value, "left").join(forward, path, "left")
    status = (
        F.when(F.col(path).isNull(), "not_found_in_old")
        .when(F.col(path) != F.col("__other"), "ambiguous_path")
        .when(F.col("new_value").isNull(), "path_removed_in_new")
        .when(F.col("new_value") == F.col(value), "unchanged")
        .otherwise("migrated")
    )
    return found.withColumn("status", status).withColumn("new_value", F.when(F.col("status").isin("unchanged", "migrated"), F.col("new_value"))).drop("__other")


def agreed(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key: value if all its rows agree, n (rows) and n_values."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(value).alias("n_values"), F.min(value).alias("__v")).select(*key, "n", "n_values", F.when(F.col("n_values") == 1, F.col("__v")).alias(value))


def specific_over_generic(df: DataFrame, key: list[str], specific: Column) -> DataFrame:
    """Rows that are specific, or whose key has no specific row."""
    has = F.max(F.when(specific, 1).otherwise(0)).over(Window.partitionBy(*key))
    return df.withColumn("__has", has).where(specific | (F.col("__has") == 0)).drop("__has")


def provenance(df: DataFrame, key: list[str], source: str) -> DataFrame:
    """One row per key with its distinct sources, sorted and joined by commas."""
    return df.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.count("*").alias("n"))


def votes(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key: the value with the most rows (the least of several), its votes and all votes."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("__n"))
    top = counts.groupBy(*key).agg(F.max("__n").alias("votes"), F.sum("__n").alias("total"))
    return counts.join(top, key).where(F.col("__n") == F.col("votes")).groupBy(*key, "votes", "total").agg(F.min(value).alias(value)).select(*key, value, "votes", "total")


def supermajority(df: DataFrame, key: list[str], value: str, percent: int = 60) -> DataFrame:
    """votes, where the winner has at least percent of them; else value is null."""
    v = votes(df, key, value)
    return v.withColumn(value, F.when(F.col("votes") * 100 >= F.col("total") * percent, F.col(value)))


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered by rank; Spark keeps k rows per key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def partition_by_presence(df: DataFrame, other: DataFrame, key: list[str], present: str, absent: str, name: str = "status") -> DataFrame:
    """df with name: present if other has the key, else absent."""
    known = other.select(*key).distinct().withColumn("__known", F.lit(1))
    return df.join(known, key, "left").withColumn(name, F.when(F.col("__known").isNotNull(), present).otherwise(absent)).drop("__known")

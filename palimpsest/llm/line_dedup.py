"""Removal of lines that many sites share.

Every line is known by two 64-bit hashes. A HyperLogLog sketch of the sites per
line merges in the shuffle's partial aggregation; its estimate settles lines far
from the threshold, and lines near it get an exact count of distinct sites. Of a
boilerplate line, the first occurrence by document stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: log2 of a sketch's registers: a relative standard error of 1.04 / 64.
LG_REGISTERS = 12


def _lines(df: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """One row per non-blank line: k and th (document), site, at (its place), a and b (its hashes)."""
    docs = df.select(
        F.col(key).alias("k"),
        F.xxhash64(F.col(text)).alias("th"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line"),
    )
    return docs.where(F.trim("line") != "").select("k", "th", "site", "at", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit("second")).alias("b"))


def boilerplate(df: DataFrame, min_sites: int, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Hashes a, b of the lines on at least min_sites distinct sites, and first: the occurrence that stays.

    Lines whose estimate is further than three standard errors from min_sites are settled by it alone.
    """
    lines = _lines(df, key, text, site)
    place = F.struct("k", "th", "at")
    sketches = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sketch"), F.min(place).alias("first"))
    margin = max(1.0, 3 * 1.04 / 2 ** (LG_REGISTERS / 2) * min_sites)
    spread = stored(
        sketches.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin),
        "line-spread",
    )
    sure = spread.where(F.col("sites") > min_sites + margin).select("a", "b", "first")
    near = spread.where(F.col("sites") <= min_sites + margin)
    exact = (
        lines.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
        .groupBy("a", "b").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    )
    out = stored(sure.unionByName(near.join(exact, ["a", "b"]).select("a", "b", "first")), "boilerplate")
    discard(spread)
    return out


def without_boilerplate(df: DataFrame, min_sites: int = 8, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """df with text freed of boilerplate lines, and n_lines and n_removed (long; columns of these names are replaced).

    A line is boilerplate if at least min_sites distinct sites have it; its first
    occurrence, by key and place, stays. Blank lines are never removed. A null text
    stays null with no lines; a null site is a site of its own; null keys come first.
    Rows with one key and text count as one document: they keep the same lines.
    """
    df = df.drop(*(c for c in ("n_lines", "n_removed") if c not in (key, text, site)))
    marks = boilerplate(df, min_sites, key, text, site)
    hits = (
        _lines(df, key, text, site).join(marks, ["a", "b"])
        .where(~F.col("first").eqNullSafe(F.struct("k", "th", "at")))
        .groupBy("k", "th").agg(F.collect_set("at").alias("__gone"))
    )
    hits = hits.select(F.col("k").alias("__k"), F.col("th").alias("__th"), "__gone")
    joined = df.withColumn("__own", F.xxhash64(F.col(text))).join(hits, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__own") == F.col("__th")), "left")
    parts = F.split(F.col(text), "\n", -1)
    gone = F.coalesce(F.size("__gone"), F.lit(0))
    stay = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("__gone", s["i"]))
    n_lines = F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0))
    return (
        joined.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long"))
        .withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(gone).cast("long"))
        .withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda s: s["x"]), "\n")))
        .drop("__own", "__k", "__th", "__gone")
    )


def summary(df: DataFrame, key: str = "doc_id", text: str = "text") -> list[Column]:
    """What the query returns per document; the digest is that of the text that is left."""
    return [F.col(key), F.col("n_lines"), F.col("n_removed"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5")]

"""Coverage, agreement and status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agreement_ratios(df: DataFrame, by: list[str], both: Column, equal: Column) -> DataFrame:
    """Per group: n, both_changed, agree among those, and their ratio (over one at least), to six places."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(both).alias("both_changed"), F.count_if(both & equal).alias("agree"))
    return counts.withColumn("ratio", F.round(F.col("agree") / F.greatest("both_changed", F.lit(1)), 6))


def status_counts(df: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), status).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, resolved: Column, eligible: Column, by: list[str] | None = None) -> DataFrame:
    """Resolved among eligible rows, and their share to six places."""
    counts = df.groupBy(*(by or [])).agg(F.count_if(eligible).alias("eligible"), F.count_if(eligible & resolved).alias("resolved"))
    return counts.withColumn("coverage", F.round(F.col("resolved") / F.greatest("eligible", F.lit(1)), 6))

"""Operators over ordered rows: islands, neighbours, enclosing rows, frames and running states.

All take the partition and a total order. Running values come from scan.running, which
spreads a large group over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import MOST, running


def _over(by: list[str], order: list[Column]):
    return Window.partitionBy(*by).orderBy(*order)


def islands(df: DataFrame, by: list[str], value: str, gap: int, most: int = MOST) -> DataFrame:
    """df with island: the number of the run in which neighbours differ by at most gap."""
    d = running(df, by, [F.col(value)], shifts={"__previous": (F.col(value), 1)}, most=most)
    new = F.when(F.col(value) - F.col("__previous") > gap, 1).otherwise(0)
    return running(d, by, [F.col(value)], sums={"island": new}, most=most).drop("__previous")


def with_previous(df: DataFrame, by: list[str], order: list[Column], column: str, n: int, most: int = MOST) -> DataFrame:
    """df with previous_1 to previous_n of column."""
    return running(df, by, order, shifts={f"previous_{i}": (F.col(column), i) for i in range(1, n + 1)}, most=most)


def last_before(df: DataFrame, by: list[str], order: list[Column], marked: Column, name: str, most: int = MOST) -> DataFrame:
    """df with name: marked's last non-null value at or before the row."""
    return running(df, by, order, lasts={name: marked}, most=most)


def first_after(df: DataFrame, by: list[str], order: list[Column], marked: Column, name: str, most: int = MOST) -> DataFrame:
    """df with name: marked's first non-null value after the row."""
    return running(df, by, order, nexts={name: marked}, most=most)


def from_end(df: DataFrame, by: list[str], descending: list[Column], name: str = "from_end", most: int = MOST) -> DataFrame:
    """df with name: 1 for the last row of its partition."""
    return running(df, by, descending, sums={name: F.lit(1)}, most=most)


def frame(df: DataFrame, by: list[str], order: list[Column], column: str, before: int, after: int, sep: str, name: str = "context") -> DataFrame:
    """df with name: column of the rows from before to after around each, joined by sep."""
    return df.withColumn(name, F.array_join(F.collect_list(column).over(_over(by, order).rowsBetween(-before, after)), sep))


def running_label(df: DataFrame, by: list[str], order: list[Column], resets: Column, piece: Column, sep: str, name: str = "label", most: int = MOST) -> DataFrame:
    """df with name: the pieces since the last reset, joined by sep; null where there are none."""
    d = running(df, by, order, sums={"__segment": F.when(resets, 1).otherwise(0)}, most=most).withColumn("__piece", piece)
    inner = Window.partitionBy(*by, "__segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.nullif(F.array_join(F.collect_list("__piece").over(inner), sep), F.lit(""))).drop("__segment", "__piece")


def depth_blocks(df: DataFrame, by: list[str], order: list[Column], opens: Column, closes: Column, most: int = MOST) -> DataFrame:
    """df with depth before the row and after it, from the numbers that the row opens and closes."""
    d = running(df, by, order, sums={"depth_after": opens - closes}, most=most)
    return d.withColumn("depth", F.col("depth_after") - (opens - closes))


def leading_block(df: DataFrame, by: list[str], descending: list[Column], breaks: Column, most: int = MOST) -> DataFrame:
    """The rows from the end backwards up to the first that breaks."""
    return running(df, by, descending, sums={"__broken": F.when(breaks, 1).otherwise(0)}, most=most).where("__broken = 0").drop("__broken")


def tiles(df: DataFrame, by: list[str], start: str, most: int = MOST) -> DataFrame:
    """df with end: the next row's start less one, null for the last."""
    return running(df, by, [F.col(start)], shifts={"end": (F.col(start) - 1, -1)}, most=most)


def cumulative(df: DataFrame, by: list[str], order: list[Column], size: str, name: str = "offset", most: int = MOST) -> DataFrame:
    """df with name: the sum of size before the row."""
    return running(df, by, order, sums={name: F.col(size)}, most=most).withColumn(name, F.col(name) - F.coalesce(F.col(size), F.lit(0)))

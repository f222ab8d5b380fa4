"""Versions: folders ordered by the integers in their names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators.scan import MOST, running


def version_key(label: str) -> tuple[int, ...]:
    return tuple(map(int, re.findall(r"\d+", label))) or (0,)


def ordered_versions(labels: list[str]) -> list[str]:
    return sorted(labels, key=lambda x: (version_key(x), x))


def placed(labels: DataFrame, label: str, name: str = "place", most: int = MOST) -> DataFrame:
    """label and its place, from 1, in the order of ordered_versions."""
    rows = labels.select(label, natural_key(label).alias("__key"), F.lit(0).alias("__all"))
    return running(rows, ["__all"], [F.col("__key"), F.col(label)], sums={name: F.lit(1)}, most=most).select(label, F.col(name).cast("int").alias(name))


def list_versions(spark: SparkSession, root: str) -> list[str]:
    """The folders under root, through the file system that Spark reads it by; hidden ones are left out."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return ordered_versions([s.getPath().getName() for s in found if s.isDirectory() and not s.getPath().getName().startswith(".")])


def resolve(labels: list[str], wanted: str | None) -> str | None:
    """None, '' or latest: the last; else that name; else the last that it is a prefix of."""
    labels = ordered_versions(labels)
    if not wanted or wanted == "latest":
        return labels[-1] if labels else None
    return wanted if wanted in labels else next((x for x in reversed(labels) if x.startswith(wanted)), None)


def previous(labels: list[str], label: str) -> str | None:
    """The greatest version strictly below."""
    below = [x for x in ordered_versions(labels) if version_key(x) < version_key(label)]
    return below[-1] if below else None

"""Sinks: rewritten entry files, keep lists, JSON reports, verified sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .entries import ENTRY


def rewritten(lines: DataFrame, resolved: DataFrame) -> DataFrame:
    """lines (file, line_no, line, name, value) with entries' quoted values replaced by resolved's applied; other lines stay as they are."""
    j = lines.join(resolved.select("name", "applied"), "name", "left")
    head = F.regexp_extract("line", r'^(\s*[A-Za-z_][A-Za-z0-9_]*\s*=\s*")', 1)
    tail = F.regexp_extract("line", r'^\s*[A-Za-z_][A-Za-z0-9_]*\s*=\s*"[^"]*(".*)$', 1)
    change = F.col("line").rlike(ENTRY) & F.col("applied").isNotNull() & (F.col("applied") != F.col("value"))
    return j.select("file", "line_no", F.when(change, F.concat(head, "applied", tail)).otherwise(F.col("line")).alias("line"))


def write_text(lines: DataFrame, path: str) -> None:
    """The lines in order as one text file per input file, in a folder of its own: a file of entries is one task's work."""
    whole = lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    whole.write.partitionBy("file").mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_keep_list(verdicts: DataFrame, path: str) -> None:
    """The names of files in a tier, in the order of their rank; a keep list is a configuration file, so it is one file."""
    verdicts.where("tier <> 'dropped'").coalesce(1).sortWithinPartitions("rank", "name").select("name").write.mode("overwrite").text(path)


def verified(df: DataFrame, original: str, again: str) -> DataFrame:
    """Only the rows whose round trip is exact."""
    return df.where(F.col(original).eqNullSafe(F.col(again)))


@dataclass(frozen=True)
class Gate:
    """Shares that rows must reach before they are published: of resolved among eligible ones, and of agreeing among compared ones; and how many may stay unresolved."""

    eligible: Column
    resolved: Column
    compared: Column | None = None
    agree: Column | None = None
    least_coverage: float = 0.0
    least_agreement: float = 0.0
    most_unresolved: int | None = None


class NotPublished(Exception):
    """A gate that wasn't passed, with what was measured."""

    def __init__(self, why: str, measured: dict):
        super().__init__(f"{why}: {measured}")
        self.measured = measured


def publish(df: DataFrame, path: str, gate: Gate) -> dict:
    """Writes df as Parquet under path, if it passes the gate, and returns what was measured.

    The measures come with the write itself. Rows are written beside path and moved there only after they have
    passed; else they are removed, NotPublished is raised, and what was there before stays.
    """
    spark, beside = df.sparkSession, f"{path.rstrip('/')}__unpublished"
    seen = Observation()
    compared, agree = (F.lit(False) if c is None else c for c in (gate.compared, gate.agree))
    measures = [F.count("*").alias("rows"), F.count_if(gate.eligible).alias("eligible"), F.count_if(gate.eligible & gate.resolved).alias("resolved"), F.count_if(compared).alias("compared"), F.count_if(compared & agree).alias("agree")]
    df.observe(seen, *measures).write.mode("overwrite").parquet(beside)
    measured = dict(seen.get)
    measured["coverage"] = measured["resolved"] / max(1, measured["eligible"])
    measured["agreement"] = measured["agree"] / measured["compared"] if measured["compared"] else 1.0
    measured["unresolved"] = measured["eligible"] - measured["resolved"]
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    why = None
    if measured["coverage"] < gate.least_coverage:
        why = "coverage"
    elif measured["agreement"] < gate.least_agreement:
        why = "agreement"
    elif gate.most_unresolved is not None and measured["unresolved"] > gate.most_unresolved:
        why = "unresolved"
    if why:
        fs.delete(source, True)
        raise NotPublished(why, measured)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise NotPublished("could not be moved", measured)
    return measured

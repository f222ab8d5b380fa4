"""Corpora of text files in versions: scans, keep lists, and an index of which file mentions what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .entries import read_lines


def corpus(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """version, file, line_no, line of the text files in a folder per version. Bytes that aren't UTF-8 are replaced."""
    parts = [read_lines(spark, path).withColumn("version", F.lit(v)) for v, path in folders.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("version", "file", "line_no", "line")


def kept(lines: DataFrame, names: list[str]) -> DataFrame:
    """The named files' lines with file_ord, a name's place in the configured list; names without a file are skipped."""
    order = lines.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, file_ord int")
    return lines.join(F.broadcast(order), "file")


def mentions(lines: DataFrame, pattern: str) -> DataFrame:
    """version, file, token: the distinct matches of a pattern; built once, it prunes files for every later needle."""
    return lines.select("version", "file", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("token")).distinct()


def mentioning(lines: DataFrame, index: DataFrame, needle: Column) -> DataFrame:
    """The lines of files that mention a token; all lines of a version in which no file does."""
    hit = index.where(needle).select("version", "file").distinct()
    seen = hit.select("version").distinct().withColumn("__seen", F.lit(1))
    d = lines.join(hit.withColumn("__hit", F.lit(1)), ["version", "file"], "left").join(seen, "version", "left")
    return d.where("__hit = 1 OR __seen IS NULL").drop("__hit", "__seen")


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _summed(*of: Column) -> Column:
    """A digest of a group's rows that doesn't depend on their order: their number, and two sums of hashes."""
    return F.sha1(F.concat_ws("|", F.count("*").cast("string"), *(F.coalesce(F.sum(F.xxhash64(F.lit(seed), *of).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2))))


def cached(df: DataFrame, root: str, key: Column, files: DataFrame) -> DataFrame:
    """df as Parquet under root, in a folder named by the digest of key over files; read back if it is there already.

    The digest is a sum of hashes, so that no list of files is gathered and their order plays no part.
    """
    spark = df.sparkSession
    name = files.select(key.alias("k")).agg(_summed(F.col("k")).alias("h")).first().h
    path, fs = _folder(spark, f"{root}/{name}/_SUCCESS")
    if not fs.exists(path):
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    return spark.read.schema(df.schema).parquet(f"{root}/{name}")


def fingerprints(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """version, file and digest: equal for equal lines, whatever their order of arrival."""
    return lines.groupBy(*(by or ["version", "file"])).agg(_summed(F.col("line_no"), F.col("line")).alias("digest"))


def refreshed(lines: DataFrame, root: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What derive makes of lines (version, file, line_no, line), file by file, from a cache under root in which only new and changed files are derived again.

    derive's rows must have version and file. A manifest holds the digest of each file that the cache is of; each run writes one of its own,
    and the greatest counts. Rows are stored by version and file with their digest: a changed file's folder alone is written again, and rows of files that are gone, or of an
    earlier state, don't count, as the manifest doesn't name them.
    """
    spark, keys = lines.sparkSession, ["version", "file"]
    folder, fs = _folder(spark, f"{root}/manifest")
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(folder) else []
    now = f"{root}/manifest/{max(numbers, default=0) + 1:08d}"
    fingerprints(lines).write.mode("overwrite").parquet(f"{root}/pending")
    told = spark.read.parquet(f"{root}/pending")
    fresh = told
    if numbers:
        fresh = told.join(spark.read.parquet(f"{root}/manifest/{max(numbers):08d}"), [*keys, "digest"], "left_anti")
    rows = derive(lines.join(fresh.select(keys), keys, "left_semi")).join(fresh, keys)
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(f"{root}/rows")
    told.write.parquet(now)
    kind = {f.name: f.dataType for f in lines.schema.fields}
    held = spark.read.schema(rows.select(*(c for c in rows.columns if c not in keys), *keys).schema).parquet(f"{root}/rows")
    held = held.withColumns({k: F.col(k).cast(kind[k]) for k in keys})
    return held.join(spark.read.parquet(now), [*keys, "digest"], "left_semi").drop("digest")

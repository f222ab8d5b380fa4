"""Line-based sources: entries, crosswalks, name lists and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = r'^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"([^"]*)"'
POLICY = "tiers array<struct<name:string,globs:array<string>,least:map<string,bigint>>>"


def parsed_entries(lines: DataFrame, line: str) -> DataFrame:
    """The lines that are entries, with name and value."""
    return lines.where(F.col(line).rlike(ENTRY)).withColumns({"name": F.regexp_extract(line, ENTRY, 1), "value": F.regexp_extract(line, ENTRY, 2)}).drop(line)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0) and line of text files; a file is one task's row, as its lines are numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\u0085\u2028\u2029]")).alias("line_no", "line")).where("NOT (line = '' AND line_no = 0)")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a file of entries; name and value are null on other lines."""
    lines = read_lines(spark, path)
    found = F.col("line").rlike(ENTRY)
    return lines.withColumns({"name": F.when(found, F.regexp_extract("line", ENTRY, 1)), "value": F.when(found, F.regexp_extract("line", ENTRY, 2))})


def crosswalk(lines: DataFrame, line: str) -> DataFrame:
    """source and target of lines parted by ':', else '=', else ','; others are left out. Numbers may be hexadecimal."""
    from ..functions.binary import literal

    sep = F.when(F.contains(line, F.lit(":")), ":").when(F.contains(line, F.lit("=")), "=").when(F.contains(line, F.lit(",")), ",")
    cut = lambda c: F.split(F.col(line), c, 2)
    parts = F.when(sep == ":", cut(":")).when(sep == "=", cut("=")).when(sep == ",", cut(","))
    return lines.withColumn("__p", parts).withColumns({"source": literal(F.get("__p", F.lit(0))), "target": literal(F.get("__p", F.lit(1)))}).where("source IS NOT NULL AND target IS NOT NULL").drop("__p", line)


def name_list(lines: DataFrame, line: str) -> DataFrame:
    """Distinct names, one a line; what follows # is a comment."""
    return lines.select(F.trim(F.regexp_replace(line, "#.*$", "")).alias("name")).where("name <> ''").distinct()


def tier_rules(spark: SparkSession, path: str) -> list[tuple[str, Column]]:
    """The tiers of a JSON policy as rules for route(): any glob on the lower-cased name and all least values must hold."""
    from ..functions.text import glob_to_regex

    rows = spark.read.schema(POLICY).json(path, multiLine=True).select(F.posexplode("tiers").alias("i", "t")).orderBy("i").select("t.*").collect()
    out = []
    for r in rows:
        rule = F.lower("name").rlike("|".join(map(glob_to_regex, r.globs)))
        for column, least in (r.least or {}).items():
            rule = rule & (F.col(column) >= least)
        out.append((r.name, rule))
    return out

"""Sets of patches: reading them, the health of their patterns across versions, repaired sets and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary

#: The fields of a patch (fixed names of the JSON format).
SCHEMA = (
    "patch_name string, script_name string, pattern string, offset int, bytes_to_patch string, dev boolean, category string, "
    "values array<struct<id:int, pattern:string, offset:int, bytes_to_read:int>>"
)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """patch (its place in the file) and the patch's fields, of JSON files each with an array of patches; fields that aren't there are null."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{SCHEMA.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(' array', ':array')}>>").alias("all"))
    return whole.select(F.posexplode("all").alias("patch", "p")).select("patch", "p.*")


def injected(category: str, first: str) -> Column:
    """Whether a patch injects whole functions: of that category, its bytes begin with first and hold neither templates nor wildcards."""
    b = F.coalesce(F.col("bytes_to_patch"), F.lit(""))
    begins = F.startswith(F.upper(F.regexp_replace(b, " ", "")), F.lit(first.upper()))
    return (F.coalesce(F.col("category"), F.lit("")) == category) & ~F.contains(b, F.lit("{")) & ~F.contains(b, F.lit("?")) & begins


def _expression(pattern: Column) -> Column:
    """binary.wildcard for a column of patterns."""
    pairs = F.filter(F.split(F.trim(pattern), r"\s+"), lambda p: p != "")
    return F.concat(F.lit("(?s)"), F.array_join(F.transform(pairs, lambda p: F.when(p.rlike(r"^\?+$"), ".").otherwise(F.concat(F.lit("\\x"), F.upper(F.lpad(p, 2, "0"))))), ""))


def patch_health(patches: DataFrame, programs: DataFrame) -> DataFrame:
    """patch, script, n_old, n_new, status and values (id, n_old, n_new, status), of patches with a script and a pattern.

    programs: script, version (old or new), code. A pattern that is found well but has a value whose pattern isn't is BROKEN.
    A script without a program counts no match. Each program meets the patterns of its own script alone.
    """
    some = patches.where("coalesce(script_name, '') <> '' AND coalesce(pattern, '') <> ''")
    main = some.select("patch", F.col("script_name").alias("script"), F.lit(-1).alias("at"), F.lit(None).cast("int").alias("id"), "pattern")
    own = some.select("patch", F.col("script_name").alias("script"), F.posexplode("values").alias("at", "v")).select("patch", "script", "at", F.col("v.id").alias("id"), F.coalesce("v.pattern", F.lit("")).alias("pattern"))
    asked = main.unionByName(own).withColumn("expression", _expression(F.col("pattern")))
    met = asked.join(programs.select("script", "version", F.decode("code", "ISO-8859-1").alias("text")), "script", "left")
    n = F.when(F.col("pattern") != "", F.coalesce(F.regexp_count("text", F.col("expression")), F.lit(0))).otherwise(0)
    side = lambda v: F.sum(F.when(F.col("version") == v, n).otherwise(0)).cast("long")
    each = met.groupBy("patch", "script", "at", "id").agg(side("old").alias("n_old"), side("new").alias("n_new")).withColumn("status", binary.health(F.col("n_old"), F.col("n_new")))
    first = lambda c: F.max(F.when(F.col("at") < 0, F.col(c)))
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "id", "n_old", "n_new", "status")))), lambda v: F.struct(v["id"].alias("id"), v["n_old"].alias("n_old"), v["n_new"].alias("n_new"), v["status"].alias("status")))
    out = each.groupBy("patch", "script").agg(first("n_old").alias("n_old"), first("n_new").alias("n_new"), first("status").alias("s"), F.bool_and((F.col("at") < 0) | (F.col("status") == "OK")).alias("sound"), values.alias("values"))
    return out.select("patch", "script", "n_old", "n_new", F.when((F.col("s") == "OK") & ~F.col("sound"), "BROKEN").otherwise(F.col("s")).alias("status"), "values")


def repaired(patches: DataFrame, code: DataFrame) -> DataFrame:
    """patches with bytes_to_patch replaced by code's (patch, code) bytes, as pairs of digits, where there are any."""
    return patches.join(code.select("patch", binary.hex_text("code").alias("__new")), "patch", "left").withColumn("bytes_to_patch", F.coalesce("__new", "bytes_to_patch")).drop("__new")


def write_patches(patches: DataFrame, path: str) -> None:
    """One JSON array of the patches in their order, in a folder. A set is a file's content: it is one row."""
    fields = [c for c in patches.columns if c != "patch"]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("patch", F.struct(*fields).alias("p")))), lambda x: x["p"])
    patches.agg(F.to_json(rows).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def audit_report(audit: DataFrame) -> DataFrame:
    """script, place and line of a text report of an audit (script, kind, old, new, confidence): a head per script, then what changed and what needs review, each once, with how often."""
    counted = audit.groupBy("script", "kind", "old", "new", "confidence").agg(F.count("*").alias("n"))
    review = F.col("confidence") == "review"
    changed = counted.where(review | (F.col("old") != F.col("new")))
    shown = F.concat(F.lit("  "), "kind", F.lit(" "), F.col("old").cast("string"), F.when(review, "  needs review").otherwise(F.concat(F.lit(" -> "), F.col("new").cast("string"))), F.lit("  x"), F.col("n").cast("string"))
    body = changed.select("script", F.when(review, 1).otherwise(2).alias("part"), "kind", "old", shown.alias("line"))
    heads = counted.groupBy("script").agg(F.sum("n").alias("n"), F.sum(F.when(review, F.col("n")).otherwise(0)).alias("r"))
    head = heads.select("script", F.lit(0).alias("part"), F.lit("").alias("kind"), F.lit(None).cast("bigint").alias("old"), F.concat("script", F.lit(": "), F.col("n").cast("string"), F.lit(" operands, "), F.col("r").cast("string"), F.lit(" need review")).alias("line"))
    from pyspark.sql import Window

    both = head.unionByName(body)
    return both.select("script", F.row_number().over(Window.partitionBy("script").orderBy("part", "kind", "old", "line")).alias("place"), "line")

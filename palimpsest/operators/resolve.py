"""The cascade: a route per entry, resolvers in order of trust, guards, repairs and policies.

A resolver is a function of the unresolved entries that returns name, new_value and
confidence for those it can tell. Each sees only what the ones before left over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staged import staged

Resolver = Callable[[DataFrame], DataFrame]


def route(df: DataFrame, rules: list[tuple[str, Column]], otherwise: str, name: str = "route") -> DataFrame:
    """df with the name of the first rule that holds."""
    out = F.lit(otherwise)
    for label, condition in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return df.withColumn(name, out)


def cascade(entries: DataFrame, resolvers: list[tuple[str, Resolver]], guard: Column | None = None) -> DataFrame:
    """entries (name, value) with new_value, method, confidence and status.

    What each resolver told is kept, as what it left over is read by all that follow.
    A resolution must pass the guard, a condition on value and new_value. status:
    migrated_ and the method, unchanged if the value stays, or unresolved.
    """
    left, done = entries, []
    for label, resolver in resolvers:
        told = resolver(left).select("name", "new_value", "confidence")
        found = left.join(told, "name").where(F.col("new_value").isNotNull() & (guard if guard is not None else F.lit(True)))
        found = staged(found)
        if found.isEmpty():
            continue
        done.append(found.withColumn("method", F.lit(label)))
        left = staged(left.join(found.select("name"), "name", "left_anti"))
    rest = left.withColumns({"new_value": F.lit(None).cast(entries.schema["value"].dataType), "confidence": F.lit(None).cast("double"), "method": F.lit(None).cast("string")})
    out = rest
    for d in done:
        out = out.unionByName(d.withColumn("confidence", F.col("confidence").cast("double")))
    status = F.when(F.col("new_value").isNull(), "unresolved").when(F.col("new_value") == F.col("value"), "unchanged").otherwise(F.concat(F.lit("migrated_"), F.col("method")))
    return out.withColumn("status", status)


def family_repair(resolved: DataFrame, family: str, old_root: str, new_root: str, least: int = 3) -> DataFrame:
    """resolved with fixed_root and repaired: rows whose old root is their family's most common but whose new root isn't take the most common new root.

    Families of fewer than least rows, or without new roots, stay.
    """
    from .keyed import votes

    some = resolved.where(F.col(new_root).isNotNull())
    size = some.groupBy(family).agg(F.count("*").alias("__size"))
    old = votes(some, [family], old_root).select(family, F.col(old_root).alias("__old"))
    new = votes(some, [family], new_root).select(family, F.col(new_root).alias("__new"))
    j = resolved.join(size, family, "left").join(old, family, "left").join(new, family, "left")
    off = (F.col("__size") >= least) & (F.col(old_root) == F.col("__old")) & (F.col(new_root) != F.col("__new"))
    repaired = F.coalesce(off, F.lit(False))
    return j.withColumn("repaired", repaired).withColumn("fixed_root", F.when(F.col("repaired"), F.col("__new")).otherwise(F.col(new_root))).drop("__size", "__old", "__new")


#: An array's value: root with its field, stride and what follows; and a root's field, a scalar's value.
_ARRAY = r"^([A-Za-z]+_[0-9]+\.f_[0-9]+)\[[A-Za-z_]\w*(?: /\*([0-9]+)\*/)?\](.*)$"
_SCALAR = r"^([A-Za-z]+_[0-9]+)\.f_([0-9]+)$"
_FIRST = r"^\.f_([0-9]+)(.*)$"


def repair_families(resolved: DataFrame, least: int = 3, near: int = 200) -> DataFrame:
    """resolved (name, family, value, new_value) with fixed_value and repair: null, or root, number or next.

    A family is what names begin with, such as actor_. Of those with at least least arrays that were told, stride and all, on both sides:
    root: an array on the family's most common old root but another new root takes the most common new root and stride, and its first leaf moves
    as the nearest leaf below it, of those members that agree, did (that above, where none is below). number: family_..._number, a scalar,
    moves as the root did, unless what was told is as near as near. next: FAMILY_NEXT becomes the new stride. Of equally common ones the least counts.
    """
    from .align import as_of
    from .keyed import votes

    part = lambda c, i: F.regexp_extract(c, _ARRAY, i)
    told = resolved.where(F.col("value").rlike(_ARRAY) & F.col("new_value").rlike(_ARRAY) & (part("value", 2) != "") & (part("new_value", 2) != ""))
    arrays = staged(told.select("name", "family", part("value", 1).alias("old_root"), part("value", 3).alias("leaf"), part("new_value", 1).alias("new_root"), part("new_value", 2).alias("new_stride"), part("new_value", 3).alias("new_leaf")))
    size = arrays.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("family")
    most = lambda c: votes(arrays, ["family"], c).select("family", F.col(c).alias(f"most_{c}"))
    families = staged(size.join(most("old_root"), "family").join(most("new_root"), "family").join(most("new_stride"), "family"))

    first = lambda c: F.nullif(F.regexp_extract(c, _FIRST, 1), F.lit("")).cast("long")
    a = arrays.join(families, "family")
    agree = a.where("old_root = most_old_root AND new_root = most_new_root").select("family", first("leaf").alias("at"), first("new_leaf").alias("to")).where("at IS NOT NULL AND to IS NOT NULL")
    pairs = staged(agree.groupBy("family", "at").agg(F.max(F.col("to") - F.col("at")).alias("shift")))
    lowest = agree.groupBy("family").agg(F.min(F.struct("at", "to")).alias("p")).select("family", (F.col("p.to") - F.col("p.at")).alias("first_shift"))
    off = a.where("old_root = most_old_root AND new_root <> most_new_root").withColumn("at", first("leaf"))
    moved = as_of(off, pairs, ["family"], "at", "shift", "shift", beyond=True).join(lowest, "family", "left")
    leaf = F.when(F.col("at").isNull(), F.col("leaf")).otherwise(F.concat(F.lit(".f_"), (F.col("at") + F.coalesce("shift", "first_shift", F.lit(0))).cast("string"), F.regexp_extract("leaf", _FIRST, 2)))
    fixes = moved.select("name", F.concat("most_new_root", F.lit("[i /*"), "most_new_stride", F.lit("*/]"), leaf).alias("fixed"), F.lit("root").alias("how"))

    field = lambda c: F.nullif(F.regexp_extract(c, r"^[A-Za-z]+_[0-9]+\.f_([0-9]+)", 1), F.lit("")).cast("long")
    scalars = resolved.where(F.endswith("name", F.lit("_number")) & F.col("value").rlike(_SCALAR)).join(families, "family")
    to = F.regexp_extract("value", _SCALAR, 2).cast("long") + field("most_new_root") - field("most_old_root")
    far = scalars.withColumn("to", to).where(F.abs(field("new_value") - F.col("to")) > near)
    fixes = fixes.unionByName(far.select("name", F.concat(F.regexp_extract("value", _SCALAR, 1), F.lit(".f_"), F.col("to").cast("string")).alias("fixed"), F.lit("number").alias("how")))
    strides = resolved.where(F.col("value").rlike("^[0-9]+$")).select("name").join(families.select(F.concat(F.regexp_replace("family", "_+$", ""), F.lit("_NEXT")).alias("name"), F.col("most_new_stride").alias("fixed")), "name")
    fixes = fixes.unionByName(strides.select("name", "fixed", F.lit("next").alias("how")))
    j = resolved.join(fixes, "name", "left")
    return j.select(*resolved.columns, F.coalesce("fixed", "new_value").alias("fixed_value"), F.col("how").alias("repair"))


def apply_policy(resolved: DataFrame, min_confidence: float, safe: Column) -> DataFrame:
    """resolved with applied (the value to write) and action: unchanged, safe_update, review_needed or unresolved."""
    action = F.when(F.col("new_value").isNull(), "unresolved").when(F.col("new_value") == F.col("value"), "unchanged").when(safe & (F.col("confidence") >= min_confidence), "safe_update").otherwise("review_needed")
    return resolved.withColumn("action", action).withColumn("applied", F.when(F.col("action") == "safe_update", F.col("new_value")).otherwise(F.col("value")))

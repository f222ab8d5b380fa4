"""What is tried for an entry whose semantic path tells nothing: structure, helper keys, loose identity, fuzzy context, in this order of trust.

A value never moves to another base, and a told value that is the old one in another spelling is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, paths
from .extract import Grammar, labels
from .joins import with_fallback
from .keyed import unique_map
from .resolve import cascade

#: A call that hands a key and a value to a helper, and the value among its second argument.
HELPER = r"\b(?:func|helper)_[0-9]+\s*\((.*)\)\s*;"
VALUE = r"\*?([A-Za-z]+_[0-9]+(?:\.f_[0-9]+|\[[^\]]+\])+)"


def base_of(value: Column | str) -> Column:
    return paths.root_of(value)


def same_base(old: Column | str = "value", new: Column | str = "new_value") -> Column:
    """The guard: a value stays within its base."""
    return base_of(old) == base_of(new)


def helper_keys(lines: DataFrame, by: list[str], keep: DataFrame | None = None, call: str = HELPER, grammar: Grammar | None = None) -> DataFrame:
    """key and value for keys that calls of helpers give one value alone: the first argument is the key, a literal or what a label holds there, the second has the value.

    keep: the files that are looked at, all without it. A value's last index is an iteration's, and left out.
    """
    g, own = grammar or Grammar(), lines if keep is None else lines.join(keep, by, "left_semi")
    found = own.where(F.col("line").rlike(call)).select(*by, "line_no", paths.split_arguments(F.regexp_extract("line", call, 1)).alias("args")).where(F.size("args") > 1)
    asked = found.select(*by, "line_no", F.col("args")[0].alias("arg"), F.regexp_extract(F.col("args")[1], VALUE, 1).alias("value")).where("value <> ''")
    literal = F.nullif(F.regexp_extract("arg", r'^\s*"([^"]+)"\s*$', 1), F.lit(""))
    asked = asked.withColumns({"key": literal, "label": F.nullif(F.regexp_extract("arg", r"^\s*&?(\w+)\s*$", 1), F.lit(""))})
    # what a label holds at a call: its last change before
    changes = labels(own, g, by)
    both = asked.where("key IS NULL AND label IS NOT NULL").select(*by, "label", "line_no", "value", F.lit(None).cast("string").alias("text"), F.lit(1).alias("__call"))
    both = both.unionByName(changes.select(*by, "label", "line_no", F.lit(None).cast("string").alias("value"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("__call")))
    from .sequence import last_before

    held = last_before(both, [*by, "label"], [F.col("line_no"), F.col("__call")], F.col("text"), "key").where("__call = 1 AND key <> ''")
    every = asked.where("key IS NOT NULL").select("key", "value").unionByName(held.select("key", "value"))
    return unique_map(every.select("key", paths.without_iteration(paths.canonical("value")).alias("value")), ["key"], "value")


def by_helper(entries: DataFrame, old_keys: DataFrame, new_keys: DataFrame, key_of: Column) -> DataFrame:
    """name, new_value, confidence: the entry's key (an expression over name and value), else the key whose old value the entry has, in the new map."""
    named = new_keys.select(F.col("key").alias("__key"), F.col("value").alias("new_value"))
    known = old_keys.join(new_keys.select("key", F.col("value").alias("new_value")), "key").groupBy(F.col("value").alias("__old")).agg(F.min("new_value").alias("new_value"), F.max("new_value").alias("__o")).where("new_value = __o").drop("__o")
    asked = entries.select("name", "value", key_of.alias("__key"), paths.without_iteration(paths.canonical("value")).alias("__old"))
    told = with_fallback(asked, named, known, "__key", "__old", "new_value").where("new_value IS NOT NULL")
    return told.select("name", paths.in_notation_of(paths.canonical("new_value"), paths.canonical("value")).alias("new_value"), F.lit(0.9).alias("confidence"))


def changed(told: DataFrame, entries: DataFrame) -> DataFrame:
    """What is told of entries and passes the base guard, if it is another value than the old one, however it is written."""
    j = told.join(entries.select("name", "value"), "name").where(same_base() & (paths.canonical("new_value") != paths.canonical("value")))
    return j.select(*told.columns)


def resolve_fallbacks(entries: DataFrame, structural: Callable[[DataFrame, bool], DataFrame], helper: Callable[[DataFrame], DataFrame], mapped: tuple[DataFrame, DataFrame], fuzzy: Callable[[DataFrame], DataFrame], struct_families: list[str]) -> DataFrame:
    """entries (name, value) with new_value, method, confidence and status, see resolve.cascade: structural, helper, loose, fallback.

    structural(entries, scalar_only) tells name, new_value, phase: all of entries whose name begins with one of struct_families,
    of the others only what has no array step. helper(entries) and fuzzy(entries) tell name, new_value, confidence. mapped: backward
    and forward mappings, whose loose identity may also tell that a value stays as it is.
    """
    inside = F.lit(False)
    for f in struct_families:
        inside = inside | F.startswith("name", F.lit(f))

    def by_structure(left: DataFrame) -> DataFrame:
        told = structural(left.where(inside), False).unionByName(structural(left.where(~inside), True))
        return changed(told.where("new_value IS NOT NULL").select("name", "new_value", F.lit(0.95).alias("confidence")), left)

    def by_identity(left: DataFrame) -> DataFrame:
        told = extract.loose_resolve(left, *mapped).join(left.select("name", "value"), "name")
        stays = F.array_join(paths.loose(paths.canonical("new_value")), " ") == F.array_join(paths.loose(paths.canonical("value")), " ")
        return told.where(same_base()).select("name", F.when(stays, F.col("value")).otherwise(F.col("new_value")).alias("new_value"), F.lit(0.85).alias("confidence"))

    return cascade(
        entries,
        [
            ("structural", by_structure),
            ("helper", lambda left: changed(helper(left), left)),
            ("loose", by_identity),
            ("fallback", lambda left: changed(fuzzy(left), left)),
        ],
    )

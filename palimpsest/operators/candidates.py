"""Candidates for a value's new place: from files of the same name, equal paths and like contexts; and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .similarity import bag, band, bound, common, line_similarity
from .staged import staged

#: Shares of the line and of its near and wide context in a score, bonuses for an equal signature, an equal depth and shared anchors, and bounds.
LINE, NEAR, WIDE = 0.25, 0.45, 0.20
SIGNATURE, DEPTH, ANCHORS = 0.08, 0.04, 0.12
MOST, LEAST, LEAST_LINE = 0.99, 0.72, 0.58


def candidate_files(matches: DataFrame, files: DataFrame, preference: DataFrame) -> DataFrame:
    """name, file and source_rank: the new files to look into: preferred ones of the match's kind (0), then the file of the same name (1).

    matches: name, kind, file. files: file. preference: kind, file.
    """
    asked = matches.join(preference.select("kind", F.col("file").alias("__f")), "kind").select("name", F.col("__f").alias("file"), F.lit(0).alias("source_rank"))
    every = asked.unionByName(matches.select("name", "file", F.lit(1).alias("source_rank")))
    return every.join(files.select("file").distinct(), "file", "left_semi").groupBy("name", "file").agg(F.min("source_rank").alias("source_rank"))


def by_path(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, new_value and n: of the values in the same file under an equal, not empty path the least, and how many there are.

    old: name, file, path (array). new: file, path, value.
    """
    held = new.where(F.size("path") > 0).groupBy("file", "path").agg(F.min("value").alias("new_value"), F.count_distinct("value").alias("n"))
    return old.where(F.size("path") > 0).select("name", "file", "path").join(held, ["file", "path"]).select("name", "new_value", "n")


def context_scores(old: DataFrame, new: DataFrame, signature, distance: Column, steps: list[tuple[int, float]]) -> DataFrame:
    """a, b and confidence: the ids of old and new rows whose contexts are alike.

    Both: id, file, kind, value, line, near and wide (the lines around, masked and joined), assigns, returns, bare (the value is a
    root alone); old: anchors (array), new: tokens (array) as well. Lines are compared within a file
    and kind, if the statement is of the same kind and, where the old context has anchors, one is
    shared. Pairs come from a join by anchor; without anchors, from one by the class of the line's length
    or by the signature. signature: a function of a value's column;
    distance: between the roots a.value and b.value; steps: its bonus. A score is capped at MOST; below LEAST it is
    no candidate, nor is a line less alike than LEAST_LINE with another signature.

    Ids meet, texts come back for those that the guards leave. Then bounds from lengths and characters prune, first the
    line's, then the score's; only what they leave is matched, the line first, and the contexts where the line's
    own similarity still allows the score.
    """
    own = ["id", "file", "kind", "value", "assigns", "returns", "bare", F.length("line").alias("n"), signature(F.col("value")).alias("sig")]
    a = staged(old.select(*own, F.array_distinct("anchors").alias("anchors")))
    b = staged(new.select(*own, F.array_distinct("tokens").alias("tokens")))
    left = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns if c != "tokens"))
    same = (F.col("a_file") == F.col("b_file")) & (F.col("a_kind") == F.col("b_kind"))
    guards = (~F.col("a_assigns") | F.col("b_assigns")) & (~F.col("a_returns") | F.col("b_returns")) & (~F.col("a_bare") | F.col("b_bare"))

    tokens = b.select(F.col("file").alias("t_file"), F.col("kind").alias("t_kind"), F.col("id").alias("t_id"), F.explode("tokens").alias("t"))
    asked = left.where(F.size("a_anchors") > 0).select("a_id", "a_file", "a_kind", F.size("a_anchors").alias("anchors"), F.explode("a_anchors").alias("t"))
    hits = asked.join(tokens, (F.col("a_file") == F.col("t_file")) & (F.col("a_kind") == F.col("t_kind")) & (asked["t"] == tokens["t"])).groupBy("a_id", F.col("t_id").alias("b_id")).agg((F.count("*") / F.max("anchors")).alias("share"))
    plain = left.where(F.size("a_anchors") == 0)
    by_length = plain.withColumn("band", F.explode(F.array(*(band(F.col("a_n"), LEAST_LINE) + i for i in (-1, 0, 1))))).join(right.withColumn("__band", band(F.col("b_n"), LEAST_LINE)), same & (F.col("band") == F.col("__band")))
    by_form = plain.join(right, same & (F.col("a_sig") == F.col("b_sig")))
    free = by_length.select("a_id", "b_id").unionByName(by_form.select("a_id", "b_id")).distinct().withColumn("share", F.lit(0.0))

    met = hits.unionByName(free).join(left.drop("a_anchors"), "a_id").join(right, "b_id").where(guards)
    texts = lambda df, x: df.select(F.col("id").alias(f"{x}_id"), *(c for t in ("line", "near", "wide") for c in (F.col(t).alias(f"{x}_{t}"), bag(t).alias(f"{x}_{t}_bag"))))
    met = met.join(texts(old, "a"), "a_id").join(texts(new, "b"), "b_id")
    limit = lambda t: bound(common(f"a_{t}_bag", f"b_{t}_bag"), F.length(f"a_{t}"), F.length(f"b_{t}"))
    equal = F.col("a_sig") == F.col("b_sig")
    depth = lambda v: F.regexp_count(v, F.lit(r"\.f_"))
    bonus = F.when(equal, SIGNATURE).otherwise(0.0) + F.when(depth(F.col("a_value")) == depth(F.col("b_value")), DEPTH).otherwise(0.0) + ANCHORS * F.least("share", F.lit(1.0)) + text.proximity(distance, F.lit(0), steps)
    slack = 1e-6  # similarities are rounded to six places
    told = met.withColumns({"equal": equal, "bonus": bonus, "line_most": limit("line"), "near_most": limit("near"), "wide_most": limit("wide")})
    told = told.where((F.col("line_most") >= LEAST_LINE - slack) | F.col("equal")).where(F.col("bonus") + LINE * F.col("line_most") + NEAR * F.col("near_most") + WIDE * F.col("wide_most") >= LEAST - slack)
    told = told.withColumn("line", line_similarity("a_line", "b_line")).where((F.col("line") >= LEAST_LINE) | F.col("equal"))
    told = told.where(F.col("bonus") + LINE * F.col("line") + NEAR * F.col("near_most") + WIDE * F.col("wide_most") >= LEAST - slack)
    told = told.withColumn("near", line_similarity("a_near", "b_near")).where(F.col("bonus") + LINE * F.col("line") + NEAR * F.col("near") + WIDE * F.col("wide_most") >= LEAST - slack)
    score = F.col("bonus") + LINE * F.col("line") + NEAR * F.col("near") + WIDE * line_similarity("a_wide", "b_wide")
    out = told.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(F.least(score, F.lit(MOST)), 6).alias("confidence"))
    return out.where(F.col("confidence") >= LEAST)


def by_context(old: DataFrame, new: DataFrame, signature, distance: Column, steps: list[tuple[int, float]]) -> DataFrame:
    """Candidates of a line's context: name, value, confidence, line_no; see context_scores, whose columns but id both sides have, old name and new line_no as well."""
    a = old.withColumn("id", F.xxhash64("name", "file", "value", "line"))
    b = new.withColumn("id", F.xxhash64("file", "line_no", "value"))
    told = context_scores(a, b, signature, distance, steps)
    out = told.join(a.select(F.col("id").alias("a"), "name"), "a").join(b.select(F.col("id").alias("b"), "value", "line_no"), "b")
    return out.groupBy("name", "value").agg(F.max("confidence").alias("confidence"), F.min_by("line_no", F.struct(-F.col("confidence"), "line_no")).alias("line_no"))


def ranked(candidates: DataFrame, name: str, reasons: list[str], distance: Column, last: list[str] | None = None) -> DataFrame:
    """candidates with rank: by the reason's place in the list (others last), source_rank, confidence, distance, value, and then the columns last."""
    from pyspark.sql import Window

    place = F.array_position(F.array(*map(F.lit, reasons)), F.col("reason"))
    order = [F.when(place == 0, len(reasons) + 1).otherwise(place), F.asc("source_rank"), F.desc("confidence"), distance.asc_nulls_last(), F.asc("value"), *(last or [])]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy(*order)))

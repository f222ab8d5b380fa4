"""Fuzzy resolution end to end: where an entry's value stands in the old corpus, what may stand for it in the new one, merged and ordered.

Matches of a value with a semantic path are all taken; without any, they are pruned to
those whose surroundings tell most. Three generators look into the target files of a match:
equal semantic path, equal shape of path, alike context. What they tell of a name is
merged by value, and values are ordered by reason, source, confidence and distance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import paths
from .candidates import context_scores
from .scan import running
from .staged import staged

#: Reasons in order of trust; the first is followed by the path, all others rank behind these.
SEMANTIC = "semantic path match"
REASONS = ["exact path still present", "same path shape in same file", "context match in same file", "exact local token still present", "same local shape in same file"]
#: Confidences of an exact and of a like shape, of global and of local values.
SHAPE = {"global": (0.97, 0.8), "local": (0.88, 0.76)}


@dataclass
class Notation:
    """How values are written, what anchors a line, and how much near roots count."""

    value: str = r"\b(?:Root|[a-z]?Local)_[0-9]+(?:\[[^\]]*\]|\.f_[0-9]+)*"
    part: str = r"^\w+|\[[^\]]*\]|\.f_[0-9]+"
    local: str = r"^[a-z]?Local_"
    anchors: tuple[str, ...] = (r"\bRoot_[0-9]+(?:\.f_[0-9]+)+", r"\b[a-z]?Local_[0-9]+", r"\b[A-Z_]{4,}::[A-Z_]+\b", r'"[^"]{2,32}"')
    steps: list[tuple[int, float]] = field(default_factory=lambda: [(0, 0.18), (5000, 0.16), (50000, 0.10), (250000, 0.05)])
    near: int = 2
    wide: int = 6
    matches: int = 12


def root_number(value: Column) -> Column:
    return F.regexp_extract(value, r"_([0-9]+)", 1).cast("long")


def shape(value: Column) -> Column:
    """A path whose indices may have any name or number; strides count."""
    return F.regexp_replace(F.regexp_replace(value, r"\[[^\]]*?\s*(/\*\s*[0-9]+\s*\*/)\]", "[$1]"), r"\[[^\]/]+\]", "[]")


def signature(value: Column) -> Column:
    """A path's form without any number."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"_[0-9]+", ""), r"\[[^\]]+\]", "[idx]"), r"\.f\b", ".f")


def mentions(lines: DataFrame, n: Notation) -> DataFrame:
    """version, file, line_no, place, value (canonical), whole, kind: each value of a line and each of its beginnings that ends with a part."""
    found = lines.select("version", "file", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(f"({n.value})"), F.lit(1))).alias("place", "raw"))
    parts = found.withColumn("parts", F.regexp_extract_all("raw", F.lit(f"({n.part})"), F.lit(1)))
    cut = parts.select("version", "file", "line_no", "place", F.size("parts").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", F.lit(1), i), ""))).alias("i", "value"))
    return cut.select("version", "file", "line_no", "place", paths.canonical("value").alias("value"), (F.col("i") + 1 == F.col("n")).alias("whole"), F.when(F.col("value").rlike(n.local), "local").otherwise("global").alias("kind"))


def contexts(lines: DataFrame, at: DataFrame, n: Notation) -> DataFrame:
    """Of lines those that at names (version, file, line_no), with near and wide, the lines around each, and tokens, the anchors among the wide ones. Files that at doesn't name aren't looked into."""
    w = Window.partitionBy("version", "file").orderBy("line_no")
    around = lambda r: F.collect_list("line").over(w.rowsBetween(-r, r))
    held = lines.join(at.select("version", "file").distinct(), ["version", "file"], "left_semi")
    out = held.withColumns({"near": around(n.near), "wide": around(n.wide)}).join(at, ["version", "file", "line_no"], "left_semi")
    found = F.concat(*(F.regexp_extract_all(F.array_join("wide", "\n"), F.lit(f"({p})"), F.lit(1)) for p in n.anchors))
    return out.withColumn("tokens", F.array_distinct(found))


def _described(rows: DataFrame) -> DataFrame:
    """rows (value, line, near, wide) as context_scores takes them."""
    masked = lambda c: F.array_join(F.transform(c, lambda x: text.normal_line(x, F.col("value"))), "\n")
    assigns = F.contains("line", F.lit("=")) & ~F.contains("line", F.lit("=="))
    return rows.withColumns({"assigns": assigns, "returns": F.startswith(F.trim("line"), F.lit("return ")), "bare": ~F.contains("value", F.lit("[")) & ~F.contains("value", F.lit(".f_")), "near": masked("near"), "wide": masked("wide"), "line": text.normal_line("line", F.col("value"))})


def old_matches(entries: DataFrame, found: DataFrame, lines: DataFrame, semantic: DataFrame, files: DataFrame, n: Notation) -> DataFrame:
    """name, value, kind, file, line_no, path and source_rank (from 0): the matches that are followed.

    All those with a semantic path, if a name has any. Else, of more than n.matches, those whose file is in the new corpus, one for
    each different line of a file, by anchors, file and line, both from the last; if none has such a file, the first ones.
    What surrounds a line is only looked at where a name has no path, and once for each form of line.
    """
    at = found.where("version = 'old'").select("file", "line_no", "value")
    routes = semantic.where("version = 'old' AND size(path) > 0").select("file", "line_no", "path")
    told = staged(entries.join(at.join(routes.select("file", "line_no").distinct(), ["file", "line_no"], "left_semi").distinct().join(routes, ["file", "line_no"]), "value"))
    with_path = running(told, ["name"], [F.col("file"), F.col("line_no")], sums={"source_rank": F.lit(1)})
    untold = staged(entries.join(told.select("name").distinct(), "name", "left_anti"))
    m = staged(untold.join(at.join(untold.select("value").distinct(), "value", "left_semi").distinct(), "value").withColumn("path", F.lit(None).cast(semantic.schema["path"].dataType)))
    m = m.join(m.groupBy("name").agg(F.count("*").alias("n")), "name")
    w = Window.partitionBy("name")
    few = m.where(F.col("n") <= n.matches).withColumn("source_rank", F.row_number().over(w.orderBy("file", "line_no")))

    many = m.where(F.col("n") > n.matches)
    seen = many.join(files, "file", "left_semi").join(lines.where("version = 'old'").select("file", "line_no", "line"), ["file", "line_no"])
    one = staged(seen.withColumn("__form", text.normal_line("line", F.col("value"))).groupBy("name", "file", "__form").agg(F.min_by(F.struct(*many.columns), "line_no").alias("m")).select("m.*"))
    around = contexts(lines, one.select(F.lit("old").alias("version"), "file", "line_no").distinct(), n).select("file", "line_no", "tokens")
    rank = [F.desc(F.size(F.array_remove("tokens", F.col("value")))), F.desc("file"), F.asc("line_no")]
    best = one.join(around, ["file", "line_no"]).withColumn("source_rank", F.row_number().over(w.orderBy(*rank))).where(F.col("source_rank") <= n.matches)
    none = many.join(one.select("name").distinct(), "name", "left_anti").withColumn("source_rank", F.row_number().over(w.orderBy("file", "line_no"))).where(F.col("source_rank") <= n.matches)
    columns = ["name", "value", "kind", "file", "line_no", "path", (F.col("source_rank") - 1).cast("int").alias("source_rank")]
    out = with_path.select(columns)
    for x in (few, best, none):
        out = out.unionByName(x.select(columns))
    return staged(out)


def generate(matches: DataFrame, found: DataFrame, lines: DataFrame, semantic: DataFrame, preferred: DataFrame, n: Notation) -> DataFrame:
    """name, old_value, value, confidence, reason, file, line_no, source_rank and place (the order in which they come): all candidates.

    Target files are that of the match's name, then preferred ones in their order. In the first that
    has the match's semantic path, its values and the old value itself are taken, and later files are not looked into.
    Contexts are only made of the lines whose matches ask for them and of those in the files that these ask.
    """
    new = found.where("version = 'new'")
    files = new.select("file").distinct()
    asked = matches.select("name", F.col("value").alias("old_value"), "kind", "path", "source_rank", F.col("file").alias("old_file"), F.col("line_no").alias("old_line"))
    targets = asked.withColumns({"file": F.col("old_file"), "ord": F.lit(0)}).unionByName(asked.join(preferred.select("name", "file", (F.col("ord") + 1).alias("ord")), "name"))
    key = [*asked.columns, "file"]
    targets = staged(targets.join(files, "file", "left_semi").groupBy(*key).agg(F.min("ord").alias("ord")))

    # the last whole value of a line on the path
    told = new.where("whole").groupBy("file", "line_no").agg(F.max_by("value", "place").alias("value")).join(semantic.where("version = 'new'").select("file", "line_no", "path"), ["file", "line_no"])
    by_path = staged(targets.where("path IS NOT NULL").join(told, ["file", "path"]))
    match = ["name", "source_rank", "old_file", "old_line"]
    stops = by_path.groupBy(*match).agg(F.min("ord").alias("stop"))
    reason = F.concat(F.lit(f"{SEMANTIC}: "), F.array_join("path", "/"))
    out = [by_path.join(stops, match).where("ord = stop").select("name", "old_value", "value", F.lit(1.0).alias("confidence"), reason.alias("reason"), "file", "line_no", "source_rank", F.struct("source_rank", "ord", F.lit(0).alias("g"), "line_no").alias("place"))]

    open_ = targets.join(stops, match, "left").where("stop IS NULL OR ord <= stop")
    of_line = new.withColumn("shape", shape(F.col("value"))).groupBy("file", "line_no", "shape").agg(F.min_by("value", F.struct("place", F.length("value"))).alias("value"))
    alike = open_.withColumn("shape", shape(F.col("old_value"))).join(of_line, ["file", "shape"]).withColumn("same", F.col("value") == F.col("old_value")).where("stop IS NULL OR ord < stop OR same")
    local = F.col("kind") == "local"
    sure = F.when(local, F.when(F.col("same"), SHAPE["local"][0]).otherwise(SHAPE["local"][1])).otherwise(F.when(F.col("same"), SHAPE["global"][0]).otherwise(SHAPE["global"][1]))
    why = F.when(local, F.when(F.col("same"), REASONS[3]).otherwise(REASONS[4])).otherwise(F.when(F.col("same"), REASONS[0]).otherwise(REASONS[1]))
    out.append(alike.select("name", "old_value", "value", sure.alias("confidence"), why.alias("reason"), "file", "line_no", "source_rank", F.struct("source_rank", "ord", F.lit(1).alias("g"), "line_no").alias("place")))

    look = staged(open_.where("stop IS NULL OR ord < stop"))
    theirs = new.where("whole").join(look.select("file", "kind").distinct(), ["file", "kind"], "left_semi").select("file", "line_no", "kind", "value").distinct()
    at = look.select(F.lit("old").alias("version"), F.col("old_file").alias("file"), F.col("old_line").alias("line_no")).unionByName(theirs.select(F.lit("new").alias("version"), "file", "line_no"))
    around = staged(contexts(lines, at.distinct(), n))
    lines_of = around.where("version = 'old'").select(F.col("file").alias("old_file"), F.col("line_no").alias("old_line"), "line", "near", "wide", "tokens")
    # a line is compared once for a value and a file, whatever the names that ask for it
    old = look.select("old_file", "old_line", "old_value", "kind", "file").distinct().join(lines_of, ["old_file", "old_line"]).withColumnRenamed("old_value", "value")
    old = old.withColumns({"id": F.xxhash64("old_file", "old_line", "value", "file"), "anchors": F.array_remove("tokens", F.col("value"))})
    there = theirs.join(around.where("version = 'new'").select("file", "line_no", "line", "near", "wide", "tokens"), ["file", "line_no"])
    there = staged(there.withColumn("id", F.xxhash64("file", "line_no", "value")))
    old = staged(old)
    told = context_scores(_described(old), _described(there), signature, root_number(F.col("a_value")) - root_number(F.col("b_value")), n.steps)
    scored = told.join(old.select(F.col("id").alias("a"), "old_file", "old_line", F.col("value").alias("old_value"), "file"), "a").join(there.select(F.col("id").alias("b"), "line_no", "value"), "b").drop("a", "b")
    like = look.join(scored, ["old_file", "old_line", "old_value", "file"])
    out.append(like.select("name", "old_value", "value", "confidence", F.lit(REASONS[2]).alias("reason"), "file", "line_no", "source_rank", F.struct("source_rank", "ord", F.lit(2).alias("g"), "line_no").alias("place")))
    return staged(out[0].unionByName(out[1]).unionByName(out[2]))


def merge(found: DataFrame, n: Notation) -> DataFrame:
    """name, old_value, new_value, confidence, reason, source_rank, mentions, file, line_no and rank: what generate found, a row for each name and value.

    The best confidence, with a bonus for up to three further mentions, at most 1; reasons as they came. Ranked by reason
    (several reasons rank last, but that of a path), source, confidence, distance of the roots, value.
    """
    key = ["name", "old_value", "value"]
    by_reason = found.groupBy(*key, "reason").agg(F.max("confidence").alias("confidence"), F.min("source_rank").alias("source_rank"), F.min("place").alias("place"), F.count("*").alias("n"), F.max(F.struct("confidence", F.struct(-F.col("place.source_rank"), -F.col("place.ord"), -F.col("place.g"), -F.col("place.line_no")).alias("early"), "file", "line_no")).alias("best"))
    merged = by_reason.groupBy(*key).agg(
        F.round(F.least(F.max("confidence") + 0.02 * F.least(F.sum("n") - 1, F.lit(3)), F.lit(1.0)), 6).alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "reason"))), lambda x: x["reason"]), "; ").alias("reason"),
        F.min("source_rank").alias("source_rank"), F.sum("n").alias("mentions"), F.max("best").alias("best"),
    )
    place = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    trust = F.when(F.startswith("reason", F.lit(SEMANTIC)), 0).when(place > 0, place).otherwise(len(REASONS) + 1)
    near = F.abs(F.coalesce(root_number(F.col("value")), F.lit(0)) - F.coalesce(root_number(F.col("old_value")), F.lit(0)))
    w = Window.partitionBy("name").orderBy(trust, "source_rank", F.desc("confidence"), near, "value")
    return merged.select("name", "old_value", F.col("value").alias("new_value"), "confidence", "reason", "source_rank", "mentions", "best.file", "best.line_no", F.row_number().over(w).alias("rank"))


def resolve(entries: DataFrame, lines: DataFrame, semantic: DataFrame | None = None, preferred: DataFrame | None = None, notation: Notation | None = None) -> DataFrame:
    """All candidates for entries (name, value) in the order of trust; see merge.

    lines: version ('old' or 'new'), file, line_no, line. semantic: version, file, line_no, path (array): what lines add
    to. preferred: name, file, ord: files to look into besides that of the same name. Values are read in their canonical
    form, in lines and entries alike, and told in it.
    """
    n, spark = notation or Notation(), entries.sparkSession
    semantic = semantic if semantic is not None else spark.createDataFrame([], "version string, file string, line_no long, path array<string>")
    preferred = preferred if preferred is not None else spark.createDataFrame([], "name string, file string, ord int")
    lines = lines.withColumn("line", paths.canonical_within("line", n.value))
    asked = staged(entries.select("name", paths.canonical("value").alias("value")).withColumn("kind", F.when(F.col("value").rlike(n.local), "local").otherwise("global")))
    found = staged(mentions(lines, n))
    files = lines.where("version = 'new'").select("file").distinct()
    matches = old_matches(asked, found, lines, semantic, files, n)
    return merge(generate(matches, found, lines, semantic, preferred, n), n)


def safe(old_value: Column, new_value: Column, reason: Column, confidence: Column, rules: list[tuple[str, float]], steps: list[tuple[int, float]] | None = None) -> Column:
    """Whether a candidate may be written without review.

    rules: beginnings of reasons with the least confidence for each. Other reasons: a bare root that context alone found
    at 0.995 or more, whose number is as near as 5,000.
    """
    told = F.lit(False)
    for start, least in rules:
        told = told | (F.startswith(reason, F.lit(start)) & (confidence >= least))
    told = told | F.startswith(reason, F.lit(SEMANTIC)) | (reason == REASONS[0])
    bare = ~F.contains(old_value, F.lit("[")) & ~F.contains(old_value, F.lit(".f_"))
    near = text.proximity(root_number(old_value), root_number(new_value), steps or Notation().steps) >= 0.16
    return told | ((confidence >= 0.995) & near & bare & (reason == REASONS[2]))

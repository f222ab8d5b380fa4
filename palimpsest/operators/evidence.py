"""Evidence from lines, blocks and calls: measures, shared scans, kinds of statements, gates, states and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def measures(df: DataFrame, key: str, text: str, counts: dict[str, str], stub_below: int, stub_unless: str) -> DataFrame:
    """key, a count of matches per named pattern, n (characters) and stub: short and without a match of stub_unless."""
    each = [F.regexp_count(text, F.lit(p)).cast("long").alias(name) for name, p in counts.items()]
    n = F.length(text).cast("long")
    return df.select(key, *each, n.alias("n"), ((n < stub_below) & ~F.col(text).rlike(stub_unless)).alias("stub"))


def present_words(df: DataFrame, key: str, tokens: Column, wanted: list[str], name: str = "word") -> DataFrame:
    """Which of a configured list of words each row holds: one scan for all, key and word once each."""
    held = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    return df.select(key, F.explode(held).alias(name))


def most_specific(df: DataFrame, key: str, anchors: list[Column], hits: DataFrame, anchor: str = "anchor") -> DataFrame:
    """key and anchor: the first of a row's anchors, most specific first, that hits has; rows without any have none."""
    asked = df.select(key, F.posexplode(F.array(*anchors)).alias("__at", anchor)).where(F.col(anchor).isNotNull())
    found = asked.join(hits.select(anchor).distinct(), anchor, "left_semi")
    return found.groupBy(key).agg(F.min_by(anchor, "__at").alias(anchor))


def statement_kinds(line: Column) -> list[Column]:
    """assigns (an equals sign, no comparison), returns and calls, as conditions on a line."""
    return [
        (F.contains(line, F.lit("=")) & ~F.contains(line, F.lit("=="))).alias("assigns"),
        F.startswith(F.trim(line), F.lit("return ")).alias("returns"),
        line.rlike(r"^\s*\w+\(.*\);\s*$").alias("calls"),
    ]


def gated(df: DataFrame, by: list[str], conditions: list[Column], name: str = "gated") -> DataFrame:
    """by and whether each condition holds on some row of the block."""
    all_of = F.lit(True)
    for c in conditions:
        all_of = all_of & F.coalesce(F.bool_or(c), F.lit(False))
    return df.groupBy(*by).agg(all_of.alias(name))


def single_in_each(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, n_old and n_new distinct values, and value: new's, where both sides have exactly one."""
    side = lambda df, s: df.groupBy(key).agg(F.count_distinct(value).alias(f"n_{s}"), F.min(value).alias(f"__{s}"))
    both = side(old, "old").join(side(new, "new"), key)
    return both.select(key, F.when((F.col("n_old") == 1) & (F.col("n_new") == 1), F.col("__new")).alias(value), "n_old", "n_new")


def shape_matches(old: DataFrame, new: DataFrame, shape: str, key: str) -> DataFrame:
    """Shapes on both sides: n_old, n_new, old_key and new_key, the least of each side (the match, where both numbers are one). Never all pairs of a shape."""
    side = lambda df, s: df.groupBy(shape).agg(F.count("*").alias(f"n_{s}"), F.min(key).alias(f"{s}_key"))
    return side(old, "old").join(side(new, "new"), shape)


def overridden(df: DataFrame, key: str, fixed: DataFrame, value: str) -> DataFrame:
    """df with value replaced by fixed's (key, value), a configured table, where it has one, and overridden."""
    j = df.join(fixed.select(key, F.col(value).alias("__fixed")), key, "left")
    return j.withColumn("overridden", F.col("__fixed").isNotNull()).withColumn(value, F.coalesce("__fixed", value)).drop("__fixed")


def preferred(counts: DataFrame, by: str, item: str, n: str, preference: DataFrame, most: int) -> DataFrame:
    """The most items of each by: those that preference (by, item, ord) names first, in its order, then by n; rank."""
    from .keyed import top_k

    j = counts.join(preference.select(by, item, "ord"), [by, item], "left")
    return top_k(j, [by], [F.asc_nulls_last("ord"), F.desc(n), F.asc(item)], most).drop("ord")


def by_access(accesses: DataFrame, by: list[str], container: str, at: str) -> DataFrame:
    """Containers of each group by how often they are accessed, the earlier first of equals: by, container, n, rank."""
    counted = accesses.groupBy(*by, container).agg(F.count("*").alias("n"), F.min(at).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "__first", container)
    return counted.select(*by, container, "n", F.row_number().over(w).alias("rank"))


def weighted_score(hits: DataFrame, by: list[str], field: str, weights: DataFrame, kinds: tuple[int, int]) -> DataFrame:
    """by, score (the weights of all hits, to six places) and kinds (distinct weighted fields), where these lie within the bounds. weights: field, weight."""
    j = hits.groupBy(*by, field).agg(F.count("*").alias("n")).join(weights.select(field, "weight"), field)
    out = j.groupBy(*by).agg(F.round(F.sum(F.col("weight") * F.col("n")), 6).alias("score"), F.count("*").alias("kinds"))
    return out.where(F.col("kinds").between(*kinds))


def state_statistics(assigned: DataFrame, variable: str, state: str, setters: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """variable, states (distinct constants), top (the greatest) and names (all, in order, comma-joined).

    Constants also count that are passed to a function that sets the variable: setters (function, variable), calls (function, state).
    """
    rows = assigned.select(variable, state)
    if setters is not None and calls is not None:
        rows = rows.unionByName(calls.join(setters, "function").select(variable, state))
    seen = F.array_sort(F.collect_set(state))
    return rows.groupBy(variable).agg(F.count_distinct(state).alias("states"), F.max(state).alias("top"), F.array_join(seen.cast("array<string>"), ",").alias("names"))


def cooccurrences(lines: DataFrame, by: list[str], line: str, groups: dict[str, list[str]], at: str | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """by and, per named group of needles, the lines that hold all of them; of lines first to last alone if at is given."""
    if at:
        lines = lines.where(F.col(at) >= first) if last is None else lines.where(F.col(at).between(first, last))

    def all_of(needles: list[str]) -> Column:
        out = F.lit(True)
        for x in needles:
            out = out & F.contains(line, F.lit(x))
        return out

    return lines.groupBy(*by).agg(*(F.count_if(all_of(needles)).alias(name) for name, needles in groups.items()))


def longest_run(rows: DataFrame, by: list[str], at: str, value: str, k: int = 1) -> DataFrame:
    """Per group in order of at: runs of equal values: value and longest of the longest (the first of several), runs, after (the k-th value after it), last and previous (the last two values)."""
    w = Window.partitionBy(*by).orderBy(at)
    held = rows.select(*by, at, value).withColumn("__brk", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    held = held.withColumn("__run", F.sum("__brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__after", F.lead(value, k).over(w))
    runs = held.groupBy(*by, "__run").agg(F.count("*").alias("n"), F.min(value).alias("v"), F.max_by("__after", at).alias("after"), F.max(at).alias("end"), F.max_by(value, at).alias("z"))
    best = F.max_by(F.struct("v", "n", "after"), F.struct("n", -F.col("__run")))
    ends = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("end", "n", "z")))), 1, 2)
    # the last two values: of the last run if it has two, else of the last two runs
    previous = F.when(F.get("__ends", F.lit(0))["n"] > 1, F.get("__ends", F.lit(0))["z"]).otherwise(F.get("__ends", F.lit(1))["z"])
    out = runs.groupBy(*by).agg(best.alias("b"), F.count("*").alias("runs"), ends.alias("__ends"))
    return out.select(*by, F.col("b.v").alias(value), F.col("b.n").alias("longest"), "runs", F.col("b.after").alias("after"), F.get("__ends", F.lit(0))["z"].alias("last"), previous.alias("previous"))

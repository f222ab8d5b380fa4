"""Which variable of a file plays a role: told by weighted fields, by its place among a call's arguments, by its states, by gates.

Weights, bounds and rules are the caller's; each operator returns file, value, confidence or score, one per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import first_wins


def root_role(accesses: DataFrame, sizes: DataFrame, weights: DataFrame, bounds: tuple[int, int], base: float = 0.92, per_score: float = 0.05, per_field: float = 0.02, most: float = 0.999) -> DataFrame:
    """file, value, score, fields and confidence: of the roots whose size lies within the bounds that with the greatest score, then most weighted fields, then size, then name.

    accesses: file, root, field, a row each; sizes: file, root, size; weights: field, weight. A score is the sum of the weights of all accesses.
    """
    fits = sizes.where(F.col("size").between(*bounds)).select("file", "root", "size")
    each = accesses.groupBy("file", "root", "field").agg(F.count("*").alias("n")).join(weights.select("field", "weight"), "field").join(fits, ["file", "root"])
    scored = each.groupBy("file", "root", "size").agg(F.round(F.sum(F.col("weight") * F.col("n")), 6).alias("score"), F.count("*").alias("fields"))
    best = first_wins(scored, ["file"], [-F.col("score"), -F.col("fields"), -F.col("size"), F.col("root")])
    confidence = F.least(base + F.col("score") * per_score + F.col("fields") * per_field, F.lit(most))
    return best.select("file", F.col("root").alias("value"), "score", "fields", F.round(confidence, 6).alias("confidence"))


def best_by_value(found: DataFrame, value: str = "value") -> DataFrame:
    """Of several files' finds of one value the one of the greatest confidence, the least file of several."""
    return first_wins(found, [value], [-F.col("confidence"), F.col("file")])


def argument_role(calls: DataFrame, worker: Column, rule: Column, least: Column) -> DataFrame:
    """calls (file, args: array of (kind, root)) with value: the argument of kind u that stands where rule says, seen from the worker's.

    Kinds are letters: u, p and others. after_run: right after at least least p that follow the worker; second_after_run: the
    second of the u right after such a run; last: the last u after the worker; previous: the last u before it. Null where it isn't there.
    """
    at = F.array_position(F.transform("args", lambda a: a["root"]), worker)
    kinds = F.array_join(F.transform("args", lambda a: a["kind"]), "")
    before, after = F.substr(kinds, F.lit(1), at.cast("int") - 1), F.substr(kinds, at.cast("int") + 1)
    run = F.length(F.regexp_extract(after, "^(p*)", 1))
    ends = lambda pattern: F.regexp_extract(after, pattern, 1)
    place = (
        F.when((rule == "after_run") & (run >= least) & (ends("^(p*u)") != ""), at + run + 1)
        .when((rule == "second_after_run") & (run >= least) & (ends("^(p*uu)") != ""), at + run + 2)
        .when((rule == "last") & F.contains(after, F.lit("u")), at + F.length(F.regexp_extract(after, "^(.*u)", 1)))
        .when((rule == "previous") & F.contains(before, F.lit("u")), F.length(F.regexp_extract(before, "^(.*u)", 1)))
    )
    return calls.withColumn("value", F.when(at > 0, F.get("args", place.cast("int") - 1)["root"]))


def state_role(switches: DataFrame, states: DataFrame, preferred: DataFrame, least: int = 8, weights: tuple[float, float, float, float] = (5.0, 1.5, 0.15, 0.01), most_uses: int = 25, bonus: float = 250.0) -> DataFrame:
    """file, value and score: of the variables that are switched on and have at least least states the one of the greatest score, the last by name of several.

    switches: file, variable, function, cases and uses (of the rest of the function); states: file, variable, state (a constant
    assigned), a row each; preferred: file, function. weights: of a state, a case, a use (most_uses at most count) and the greatest state.
    """
    own = states.groupBy("file", "variable").agg(F.count_distinct("state").alias("states"), F.max("state").alias("top")).where(F.col("states") >= least)
    told = preferred.select("file", "function").distinct().withColumn("__p", F.lit(bonus))
    j = switches.join(own, ["file", "variable"]).join(told, ["file", "function"], "left")
    score = F.col("states") * weights[0] + F.col("cases") * weights[1] + F.least("uses", F.lit(most_uses)) * weights[2] + F.col("top") * weights[3] + F.coalesce("__p", F.lit(0.0))
    best = j.withColumn("score", F.round(score, 6)).groupBy("file").agg(F.max(F.struct("score", "variable")).alias("b"))
    return best.select("file", F.col("b.variable").alias("value"), F.col("b.score").alias("score"))


def gate_role(lines: DataFrame, variable: str, line: str, near: list[str]) -> DataFrame:
    """file, value and blocks: the variable with most blocks in which it is checked, set and reset beside a line that holds all of near; the least by name of several.

    lines: file, block, variable (that the line holds) and the line.
    """
    name = F.col(variable)
    checked = F.col(line).rlike(r"^\s*if\b") & F.contains(F.col(line), name)
    sets = lambda to: F.contains(F.col(line), F.concat(name, F.lit(f" = {to};")))
    beside = F.lit(True)
    for x in near:
        beside = beside & F.contains(F.col(line), F.lit(x))
    blocks = lines.groupBy("file", "block").agg(F.bool_or(beside).alias("near"))
    gates = lines.groupBy("file", "block", variable).agg(F.bool_or(checked).alias("c"), F.bool_or(sets(1)).alias("s"), F.bool_or(sets(0)).alias("r")).where("c AND s AND r")
    held = gates.join(blocks.where("near"), ["file", "block"], "left_semi").groupBy("file", variable).agg(F.count("*").alias("blocks"))
    return first_wins(held, ["file"], [-F.col("blocks"), F.col(variable)]).select("file", F.col(variable).alias("value"), "blocks")

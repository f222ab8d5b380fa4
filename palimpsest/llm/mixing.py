"""Mixing sources to target weights by budgets that run down a tree of domain, language and source.

A node's capacity is what its leaves hold times the epochs allowed. From the root
down, a parent's budget is dealt to its children in proportion to their weights; a
child that can't take its share gets its capacity, and what is left over is dealt
again among its siblings. So a shortage reaches other parents only where a whole
subtree is exhausted. All budgets are integers: shares are rounded down.

Each leaf then fills its budget: whole epochs first, then a prefix, in the order of
that epoch's seeded hash. The order is found by two levels of sums: over 4,096
buckets of the hash, then within a bucket, so a large leaf is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEVELS = ("domain", "lang", "source")
_WIDE = "decimal(38,0)"


def _deal(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children: parent's columns, child, weight, cap and the parent's budget. Adds share, the child's budget."""
    order = [F.col("cap").cast("double") / F.col("weight"), F.col(child)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rank = Window.partitionBy(*parent).orderBy(*order)
    whole = Window.partitionBy(*parent)
    wide = lambda c: F.col(c).cast(_WIDE)
    d = (
        children.withColumn("__left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(after))
        .withColumn("__n", F.row_number().over(rank))
        .withColumn("__full", wide("cap") * wide("__weights") <= wide("__left") * wide("weight"))
    )
    d = d.withColumn("__first", F.min(F.when(~F.col("__full"), F.struct("__n", "__left", "__weights"))).over(whole))
    dealt = F.expr("cast(__first.__left as decimal(38,0)) * weight div __first.__weights").cast("long")
    return d.withColumn("share", F.when(F.col("__full"), F.col("cap")).otherwise(dealt)).drop("__left", "__weights", "__n", "__full", "__first")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], total: Column, max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens (long). Adds budget (long), the leaf's tokens to take.

    weights: per level, the positive integer weight of a name; 1 where it isn't
    given. total: the tokens wanted, over a row with the sum of all tokens in
    column tokens. Leaves without tokens get nothing.
    """

    def weight(level: str) -> Column:
        out = F.lit(1)
        for name, w in weights.get(level, {}).items():
            out = F.when(F.col(level) == name, w).otherwise(out)
        return out

    some = leaves.where("tokens > 0").withColumn("cap", F.col("tokens") * max_epochs)
    node = some.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    node = node.withColumn("one", F.lit(1)).withColumn("tokens", F.sum("tokens").over(Window.partitionBy("one")))
    dealt = _deal(node.withColumn("budget", total.cast("long")).withColumn("weight", weight("domain")), ["one"], "domain")
    dealt = dealt.select("domain", F.col("share").alias("budget"))
    langs = some.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(dealt, "domain").withColumn("weight", weight("lang"))
    dealt = _deal(langs, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    ends = some.join(dealt, ["domain", "lang"]).withColumn("weight", weight("source"))
    return _deal(ends, ["domain", "lang"], "source").select(*LEVELS, "tokens", F.col("share").alias("budget"))


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    """A document's place in an epoch's order: hexadecimal digits that any SQL engine can compute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], total: Column, max_epochs: int, seed: int, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """docs: key, domain, lang, source, n_tokens (long). Returns key, the leaf, n_tokens, epoch (int) and take (long).

    One row for each time that a document is drawn; take is the number of its first
    tokens to use, less than n_tokens only for the document in which the leaf's
    budget ends. Null names form a name of their own, the empty string; documents without
    tokens are never drawn; repeated keys are drawn one by one, in the order of
    their tokens. order: the column whose hash is the order, if not the key. The budgets
    of the domains, which are few names, are dealt in one task.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS]
    counted = docs.select(F.col(key).alias("k"), F.col(order or key).alias("o"), *names, F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    rows = stored(counted.where("n_tokens > 0"), "token-counts")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, weights, total, max_epochs)
    plan = plan.select(*LEVELS, F.expr("cast(budget div tokens as int)").alias("full"), F.expr("budget % tokens").alias("rest"))
    # the leaves are counted by their names; Spark broadcasts the plan only below its own limit
    at = rows.join(plan, list(LEVELS)).withColumn("h", order_hash(seed, F.col("full"), F.col("o"))).withColumn("bucket", F.substring("h", 1, 3))
    own = [*LEVELS, "bucket"]
    sums = at.groupBy(*own).agg(F.sum("n_tokens").alias("in_bucket"))
    over = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*own, F.coalesce(F.sum("in_bucket").over(over), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*own).orderBy("h", "k", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = at.join(starts, own).withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("before")))
    drawn = placed.withColumn("part", part.cast("long")).withColumn("times", F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0)).where("times > 0")
    epoch = F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch")
    return drawn.select("*", epoch).select(
        F.col("k").alias(key), *LEVELS, "n_tokens", "epoch", F.when(F.col("epoch") < F.col("full"), F.col("n_tokens")).otherwise(F.col("part")).alias("take")
    )

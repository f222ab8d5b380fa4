"""Matching by context: rare anchors, weighted votes, multiset overlaps and line similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, met
from .staged import staged, stored


def tokens_of(df: DataFrame, key: str, tokens) -> DataFrame:
    """key and token: each of a row's tokens once, without any shuffle."""
    return df.select(key, F.explode(F.array_distinct(tokens)).alias("token"))


def rare(rows: DataFrame, most: int) -> DataFrame:
    """rows (key, token) with df, a token's rows, for tokens of at most so many; this bounds the joins that follow."""
    freq = rows.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    return rows.join(freq, "token")


def anchor_vote(old: DataFrame, new: DataFrame, old_key: str, new_key: str, most: int = 25) -> DataFrame:
    """Each old row's best new row by shared rare tokens: a token counts one over its frequencies on both sides. Adds votes to six places, and score.

    old, new: see tokens_of. Of new, only tokens that are rare in old are counted at all.
    """
    a = staged(rare(old, most))
    b = rare(staged(new.join(a.select("token").distinct(), "token", "left_semi")), most)
    met = a.select(old_key, "token", F.col("df").alias("fa")).join(b.select(new_key, "token", F.col("df").alias("fb")), "token")
    scores = met.groupBy(old_key, new_key).agg(F.count("*").alias("shared"), F.round(F.sum(1.0 / (F.col("fa") * F.col("fb"))), 6).alias("score"))
    best = F.min_by(F.struct(F.col(new_key), "shared", "score"), F.struct((-F.col("score")).alias("s"), F.col(new_key).alias("k")))
    return scores.groupBy(old_key).agg(best.alias("b")).select(old_key, "b.*")


def multiset_overlap(old: DataFrame, new: DataFrame, by: list[str], old_key: str, new_key: str, near: bool = False) -> DataFrame:
    """Per pair within by: the sum over shared tokens of the lesser count over the token's frequency in new, to six places.

    near: keys are numbers, and a thousandth over one and their distance is added, which decides between equals.
    """
    freq = new.groupBy(*by, "token").agg(F.count("*").alias("f"))
    met = old.select(*by, old_key, "token", F.col("n").alias("na")).join(new.select(*by, new_key, "token", F.col("n").alias("nb")), [*by, "token"]).join(freq, [*by, "token"])
    bonus = 0.001 / (1 + F.abs(F.col(old_key) - F.col(new_key))) if near else F.lit(0.0)
    return met.groupBy(*by, old_key, new_key).agg(F.sum(F.least("na", "nb") / F.col("f")).alias("__s")).withColumn("score", F.round(F.col("__s") + bonus, 6)).drop("__s")


def _best_of_block(old: pa.Table, new: pa.Table, first: int, places: int, near: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of old rows, places of new rows and parts: for each old row those that may have its best score, of equal ones the first.

    old: key, t (token numbers, rare ones first), f (their frequencies), n. new: the same; its rows come by key. Tokens are met as best_overlap says.
    """
    many = lambda x: x.value_lengths().to_numpy().astype(np.int64)
    flat = lambda x: x.flatten().to_numpy()
    held, asked = ({c: x[c].combine_chunks() for c in ("t", "f", "n")} for x in (new, old))
    counts, sizes = many(held["t"]), many(asked["t"])
    row, t, n = np.repeat(np.arange(len(counts)), counts), flat(held["t"]), flat(held["n"])
    by_row = np.lexsort((t, row))
    row_t, row_n, row_end = t[by_row], n[by_row], np.cumsum(counts)
    by_token = np.argsort(t, kind="stable")
    t, row, n = t[by_token], row[by_token], n[by_token]
    tokens, f, na = flat(asked["t"]), flat(asked["f"]), flat(asked["n"])
    low, high, end = np.searchsorted(t, tokens), np.searchsorted(t, tokens, "right"), np.cumsum(sizes)
    slack = 2 * 10.0**-places
    keys = [x["key"].to_numpy().astype(float) for x in (old, new)] if near else None
    out = []
    for i in range(len(sizes)):
        own = slice(end[i] - sizes[i], end[i])
        lo, lengths, fo, no, to = low[own], high[own] - low[own], f[own], na[own], tokens[own]
        if not lengths.any():
            continue
        at_most = np.concatenate([np.cumsum((no / fo)[::-1])[::-1], [0.0]])
        up_to = first
        while True:
            k = int(np.searchsorted(fo, up_to, "right"))
            some, best = lengths[:k], -1.0
            if some.any():
                at = np.repeat(lo[:k] - np.cumsum(some) + some, some) + np.arange(int(some.sum()))
                rows, which = np.unique(row[at], return_inverse=True)
                part = np.bincount(which, np.minimum(n[at], np.repeat(no[:k], some)) / np.repeat(fo[:k], some))
                best = part.max()
            if k == len(fo) or at_most[k] + slack + (0.001 if near else 0.0) < best:
                break
            up_to *= max(first, 2)
        may = part + at_most[k] + slack + (0.001 if near else 0.0) >= best
        rows, part = rows[may], part[may]
        if lengths[k:].any():
            for j, r in enumerate(rows.tolist()):
                has = slice(row_end[r] - counts[r], row_end[r])
                found = np.minimum(np.searchsorted(row_t[has], to[k:]), counts[r] - 1)
                both = row_t[has][found] == to[k:]
                part[j] += (np.minimum(row_n[has][found], no[k:]) / fo[k:])[both].sum()
        score = part + 0.001 / (1 + np.abs(keys[1][rows] - keys[0][i])) if near else part
        rows, part, score = (x[score >= score.max() - slack] for x in (rows, part, score))
        _, once = np.unique(score, return_index=True)
        out.append((np.full(len(once), i), rows[once], part[once]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def best_overlap(old: DataFrame, new: DataFrame, by: list[str], old_key: str, new_key: str, near: bool = False, places: int = 6, first: int = 16, block: int = BLOCK) -> DataFrame:
    """by, old_key, new_key, score: of all that share a token with an old row, that of the greatest multiset_overlap, the least new_key of several.

    old, new: by, key, token, n; a key's tokens are distinct. A row and its tokens are one row; each side of a group is cut into blocks
    of about so many tokens, and each block of old rows meets each of new ones in one task, so that pairs arise there and none is shuffled: what
    is shuffled are the rows, as often as the other side has blocks. Small groups share a task. Within it tokens are met rare ones first: those in at most first rows of new
    within by, then in at most first times as many, and so on. Each new row met has a part of its score; what all
    tokens to come could add to one not yet met is known from old alone. Where that is less than the best part, no more are met: those
    that may still win get the rest of their score, by their own tokens. So a token that all rows hold makes
    pairs only where nothing rarer decides. The score is that of multiset_overlap, and the choice the same.
    """
    freq = stored(new.groupBy(*by, "token").agg(F.count("*").alias("f")).withColumn("__t", F.monotonically_increasing_id()))

    def listed(df: DataFrame, k: str) -> DataFrame:
        each = df.select(*by, k, "token", F.col("n").cast("long").alias("n")).join(freq, [*by, "token"])
        rows = each.groupBy(*by, k).agg(F.sort_array(F.collect_list(F.struct("f", "__t", "n"))).alias("x"))
        return stored(rows.select(*by, k, *(F.col(f"x.{c}").alias(x) for c, x in (("__t", "t"), ("f", "f"), ("n", "n")))))

    a, b = listed(old, old_key), listed(new, new_key)
    every = met(a, b, by, old_key, new_key, "t", lambda x, y: _best_of_block(x, y, first, places, near), "part double", block)
    bonus = 0.001 / (1 + F.abs(F.col(old_key) - F.col(new_key))) if near else F.lit(0.0)
    scored = every.withColumn("score", F.round(F.col("part") + bonus, places))
    best = F.min_by(F.struct(new_key, "score"), F.struct((-F.col("score")).alias("s"), F.col(new_key).alias("k")))
    return scored.groupBy(*by, old_key).agg(best.alias("b")).select(*by, old_key, "b.*")


def merge_candidates(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """candidates: key, value, confidence, reason, source_rank, and place, by which they came. One row per key and value: the best confidence with a bonus for further mentions, at most 1, and all reasons as they came.

    Numbered by rank: confidence, then the source's rank, then the value.
    """
    from pyspark.sql import Window

    # first by reason, so that no value's mentions are gathered
    of_reason = candidates.groupBy(key, value, "reason").agg(F.max("confidence").alias("confidence"), F.min("source_rank").alias("source_rank"), F.min("place").alias("place"), F.count("*").alias("mentions"))
    merged = of_reason.groupBy(key, value).agg(
        F.round(F.least(F.max("confidence") + 0.02 * F.least(F.sum("mentions") - 1, F.lit(3)), F.lit(1.0)), 6).alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "reason"))), lambda x: x["reason"]), "; ").alias("reason"),
        F.min("source_rank").alias("source_rank"),
        F.sum("mentions").alias("mentions"),
    )
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "source_rank", value)))

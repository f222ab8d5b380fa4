"""Alignment of two versions' keys: signatures, overlaps, shifts, interpolation and gap fill.

Range conditions always come with an equality: a group, or buckets of the range's
width, so that no join compares everything with everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import MOST, running
from .staged import staged, stored


def ordinals(df: DataFrame, by: list[str], key: str, name: str = "ordinal", buckets: int = 1024) -> DataFrame:
    """df with the place (from 1) of each row's key, an integer, in its group: places within a range of keys, after the sums of the ranges before.

    A group of any size is so spread over many tasks.
    """
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    at = df.withColumn("__b", F.floor((F.col(key) - lo) / F.lit(max(1, -(-(hi - lo + 1) // buckets)))))
    sums = at.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(key))
    return at.join(starts, [*by, "__b"]).withColumn(name, (F.col("__start") + inside).cast("int")).drop("__b", "__start")


def signature_ordinal(old: DataFrame, new: DataFrame, group: str, member: str) -> DataFrame:
    """Groups (integers) with equal non-empty member sets, the k-th of old with the k-th of new: old_key, new_key, signature, ordinal."""

    def side(df: DataFrame, name: str) -> DataFrame:
        sets = df.where(F.col(member).isNotNull()).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(member)), ",").alias("signature"))
        return ordinals(staged(sets), ["signature"], group).withColumnRenamed(group, name)

    return side(old, "old_key").join(side(new, "new_key"), ["signature", "ordinal"])


def overlaps(a: DataFrame, b: DataFrame, group: str, member: str) -> DataFrame:
    """Pairs of groups that share members: a_key, b_key, shared, a_size, b_size. Joined by member, so only overlapping pairs arise."""
    rows = lambda df, k: df.select(F.col(group).alias(k), F.col(member).alias("m")).distinct()
    left, right = rows(a, "a_key"), rows(b, "b_key")
    shared = left.join(right, "m").groupBy("a_key", "b_key").agg(F.count("*").alias("shared"))
    sizes = lambda df, k: df.groupBy(f"{k}_key").agg(F.count("*").alias(f"{k}_size"))
    return shared.join(sizes(left, "a"), "a_key").join(sizes(right, "b"), "b_key")


def jaccard_pairs(a: DataFrame, b: DataFrame, group: str, member: str, above: float, half: bool = False) -> DataFrame:
    """overlaps with jaccard, to six places, strictly above a bound; with half only the pairs whose a_key is below b_key."""
    rows = lambda df, k: df.select(F.col(group).alias(k), F.col(member).alias("m")).distinct()
    found = similar_sets(rows(a, "a_key"), rows(b, "b_key"), [], "m", above, half).where(F.col("jaccard") > above)
    return found.withColumn("jaccard", F.round("jaccard", 6))


#: Keys that a list of those which hold a member has, about.
LISTED = 256


def similar_sets(a: DataFrame, b: DataFrame, by: list[str], member: str, least: float, half: bool = False) -> DataFrame:
    """by, a_key, b_key, shared, a_size, b_size, jaccard: all pairs of sets within by whose Jaccard similarity is at least that (over 0).

    a: by, a_key, member; b: by, b_key, member; rows are distinct. half: only pairs whose a_key is below b_key. With members in one order, rare
    ones first, similar sets share one among the first ones of each: as many as may be lacking, and one. Sets meet by these
    alone, if their sizes allow. What they share of these is counted, and a pair goes on if that and all that either set has behind its
    first ones could be enough; only then do whole sets meet. Members travel to a set's place as lists of keys, and pairs arise there.
    """
    sized = lambda df, k: df.join(df.groupBy(*by, f"{k}_key").agg(F.count("*").alias(f"{k}_size")), [*by, f"{k}_key"])
    a, b = stored(sized(a, "a")), stored(sized(b, "b"))
    counts = a.select(*by, member).unionByName(b.select(*by, member)).groupBy(*by, member).agg(F.count("*").alias("__n"))
    behind = lambda k: (F.ceil(F.col(f"{k}_size") * least - 1e-9) - 1).cast("long")

    def first(df: DataFrame, k: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by, f"{k}_key").orderBy("__n", member))
        return df.join(counts, [*by, member]).withColumn("__at", place).where(F.col("__at") <= F.col(f"{k}_size") - behind(k)).drop("__at")

    part = F.pmod(F.xxhash64("b_key"), F.ceil(F.col("__n") / LISTED))
    lists = first(b, "b").groupBy(*by, member, part.alias("__part")).agg(F.collect_list(F.struct("b_key", "b_size")).alias("__list"))
    sizes = lambda x: (F.col("a_size") >= x["b_size"] * least - 1e-9) & (x["b_size"] >= F.col("a_size") * least - 1e-9) & ((x["b_key"] > F.col("a_key")) if half else F.lit(True))
    near = first(a, "a").join(lists, [*by, member]).select(*by, "a_key", "a_size", F.filter("__list", sizes).alias("__list")).where(F.size("__list") > 0)
    each = near.repartition(*by, "a_key").select(*by, "a_key", "a_size", F.explode("__list").alias("x")).select(*by, "a_key", "a_size", "x.*")
    enough = F.col("__c") + F.greatest(behind("a"), behind("b")) >= (F.col("a_size") + F.col("b_size")) * (least / (1 + least)) - 1e-6
    met = stored(each.groupBy(*by, "a_key", "b_key", "a_size", "b_size").agg(F.count("*").alias("__c")).where(enough).select(*by, "a_key", "b_key"))
    # a pair's members meet again, whole
    shared = met.join(a, [*by, "a_key"]).join(b, [*by, "b_key", member]).groupBy(*by, "a_key", "b_key", "a_size", "b_size").agg(F.count("*").alias("shared"))
    j = F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared"))
    return shared.withColumn("jaccard", j).where(F.col("jaccard") >= least - 1e-9).select(*by, "a_key", "b_key", "shared", "a_size", "b_size", "jaccard")


#: Places of a block of keys at least, pairs that are counted one by one, and pairs of a block that is counted together with others.
PLACES, PAIRS, SMALL = 4096, 1 << 21, 1 << 14


def shift_hits(old: np.ndarray, new: np.ndarray, reach: int) -> np.ndarray:
    """For each shift below reach, how many of old's places it moves onto places of new; by differences where few, else by correlation."""
    if len(old) * len(new) <= PAIRS:
        apart = (new[None, :] - old[:, None]).ravel()
        return np.bincount(apart[(apart >= 0) & (apart < reach)], minlength=reach)[:reach]
    size = 1 << int(max(old.max(), new.max()) + reach + 1).bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[old], y[new] = 1, 1
    return np.rint(np.fft.irfft(np.fft.rfft(y) * np.conj(np.fft.rfft(x)), size)[:reach]).astype(np.int64)


def _hits(olds: pa.Array, news: pa.Array, starts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shift and hits of blocks, each a list of old and of new places: all differences of small blocks at once, large ones by shift_hits."""
    a, b = olds.flatten().to_numpy(), news.flatten().to_numpy()
    many_a, many_b = (x.value_lengths().fill_null(0).to_numpy().astype(np.int64) for x in (olds, news))
    first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    found = []
    large = many_a * many_b > SMALL
    for i in np.flatnonzero(large).tolist():
        y = b[first_b[i] : first_b[i] + many_b[i]] - starts[i]
        y = y[y >= 0]
        if len(y):
            hits = shift_hits(a[first_a[i] : first_a[i] + many_a[i]] - starts[i], y, reach)
            shifts = np.flatnonzero(hits)
            found.append((np.full(len(shifts), i), shifts, hits[shifts]))
    small = np.flatnonzero(~large & (many_a * many_b > 0))
    ends = np.cumsum((many_a * many_b)[small])
    # some blocks at a time, so that the differences have a bounded number
    for some in np.split(small, np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS))) if len(small) else []:
        times = (many_a * many_b)[some]
        row = np.repeat(some, times)
        within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        apart = b[first_b[row] + within % many_b[row]] - a[first_a[row] + within // many_b[row]]
        near = (apart >= 0) & (apart < reach)
        pairs, hits = np.unique(row[near] * reach + apart[near], return_counts=True)
        found.append((pairs // reach, pairs % reach, hits))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def best_shift(old: DataFrame, new: DataFrame, by: list[str], key: str, reach: int) -> DataFrame:
    """Per group: the shift 0 <= shift < reach that maps most old keys onto new ones (the least of several), hits, and n old keys.

    Keys are cut into blocks of reach places at least; a block of old keys, one row, meets the new ones that it may move to, and
    hits are counted for all shifts together, many small blocks at once, so that neither rows nor memory grow with reach times the keys.
    """
    width = max(reach, PLACES)
    names = [f"__{i}" for i in range(len(by) + 1)]
    k = F.col("k")
    side = lambda df: df.select(*(F.col(c).alias(n) for c, n in zip(by, names)), F.col(key).cast("long").alias("k")).where("k IS NOT NULL")
    blocks = lambda df, at, name: df.withColumn(names[-1], at).groupBy(*names).agg(F.collect_set("k").alias(name))
    left = blocks(side(old), F.floor(k / width), "olds")
    right = blocks(side(new), F.explode(F.array_distinct(F.array(F.floor((k - reach + 1) / width), F.floor(k / width)))), "news")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            olds, news = batch.column("olds"), batch.column("news")
            row, shifts, hits = _hits(olds, news, batch.column(names[-1]).to_numpy() * width, reach)
            # a row without a shift tells how many old keys there are
            row = np.concatenate([row, np.arange(len(batch))])
            told = pa.concat_arrays([pa.array(shifts, pa.int64()), pa.nulls(len(batch), pa.int64())])
            counted = pa.concat_arrays([pa.array(hits, pa.int64()), olds.value_lengths().cast(pa.int64())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in names[:-1]), told, counted], names=[*names[:-1], "shift", "hits"])

    kinds = ", ".join([*(f"{n} {old.schema[c].dataType.simpleString()}" for n, c in zip(names, by)), "shift bigint", "hits bigint"])
    counted = left.join(right, names, "left").mapInArrow(run, kinds).withColumnsRenamed(dict(zip(names, by)))
    hits = counted.groupBy(*by, "shift").agg(F.sum("hits").alias("hits"))
    best = F.min(F.when(F.col("shift").isNotNull(), F.struct((-F.col("hits")).alias("m"), "shift")))
    out = hits.groupBy(*by).agg(best.alias("b"), F.max(F.when(F.col("shift").isNull(), F.col("hits"))).alias("n")).where("b IS NOT NULL")
    return out.select(*by, F.col("b.shift").alias("shift"), (-F.col("b.m")).alias("hits"), "n")


def aligned(old: DataFrame, new: DataFrame, by: list[str], key: str, reach: int) -> DataFrame:
    """Old keys whose image under their group's best shift exists, if at least half of the group (and one) has one: new_key."""
    best = best_shift(old, new, by, key, reach).where(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    moved = old.select(*by, key).distinct().join(best.select(*by, "shift"), by).withColumn("new_key", F.col(key) + F.col("shift"))
    return moved.join(new.select(*by, F.col(key).alias("new_key")).distinct(), [*by, "new_key"], "left_semi").select(*by, key, "new_key", "shift")


def _among(rows: DataFrame, anchors: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """rows and anchors together: __anchor is an anchor's value, __is 1 for anchors, which stand before rows of the same key."""
    return rows.withColumn("__anchor", F.lit(None).cast(anchors.schema[value].dataType)).withColumn("__is", F.lit(0)).unionByName(
        anchors.select(*by, key, F.col(value).alias("__anchor")).withColumn("__is", F.lit(1)), allowMissingColumns=True
    )


def as_of(rows: DataFrame, anchors: DataFrame, by: list[str], key: str, value: str, name: str = "as_of", most: int = MOST, beyond: bool = False) -> DataFrame:
    """rows with name: the value of the group's greatest anchor at or below key, null below the least; and above the greatest, unless beyond is set."""
    anchor = F.col("__is") == 1
    # an anchor's own value may be null, so that there is one is told apart
    lasts = {"__last": F.col("__anchor"), "__at": F.when(anchor, F.col(key))}
    out = running(_among(rows, anchors, by, key, value), by, [F.col(key), F.desc("__is")], lasts=lasts, nexts={"__more": F.when(anchor, True)}, most=most).where("__is = 0")
    if beyond:
        return out.withColumn(name, F.col("__last")).drop("__anchor", "__is", "__last", "__more", "__at")
    return out.withColumn(name, F.when(F.col("__more") | (F.col("__at") == F.col(key)), F.col("__last"))).drop("__anchor", "__is", "__last", "__more", "__at")


def bracketed(rows: DataFrame, anchors: DataFrame, by: list[str], key: str, value: str, name: str = "bracketed", most: int = MOST) -> DataFrame:
    """rows with name: the nearest anchors' value if those at or below and at or above key agree, else null."""
    order, anchor = [F.col(key), F.desc("__is")], F.col("__is") == 1
    out = running(_among(rows, anchors, by, key, value), by, order, lasts={"__below": F.col("__anchor"), "__at": F.when(anchor, F.struct(F.col(key).alias("k"), F.col("__anchor").alias("v")))}, nexts={"__above": F.col("__anchor")}, most=most).where("__is = 0")
    above = F.when(F.col("__at.k") == F.col(key), F.coalesce(F.col("__at.v"), F.col("__above"))).otherwise(F.col("__above"))
    return out.withColumn(name, F.when(F.col("__below") == above, F.col("__below"))).drop("__anchor", "__is", "__below", "__at", "__above")


def nearest(rows: DataFrame, targets: DataFrame, by: list[str], at: str, window: int, target: str) -> DataFrame:
    """rows with target (of the nearest target row within window places, the earlier of two) and distance; null where none is near."""
    width = F.lit(window)
    left = rows.withColumn("__b", F.explode(F.array(*(F.floor(F.col(at) / width) + i for i in (-1, 0, 1)))))
    right = targets.select(*by, F.col(at).alias("__at"), F.col(target)).withColumn("__b", F.floor(F.col("__at") / width))
    near = left.join(right, [*by, "__b"]).where(F.abs(F.col("__at") - F.col(at)) <= window)
    best = near.groupBy(*by, at).agg(F.min(F.struct(F.abs(F.col("__at") - F.col(at)).alias("distance"), F.col("__at").alias("place"), F.col(target).alias("t"))).alias("b"))
    return rows.join(best.select(*by, at, F.col("b.t").alias(target), F.col("b.distance").alias("distance")), [*by, at], "left")


def greedy_leaves(groups: DataFrame, old: str, new: str, ahead: int = 25) -> DataFrame:
    """groups: sorted arrays old and new. Adds leaves: (o, n) by a walk that carries its shift.

    Each old key is looked for at the shift so far, then up to ahead places further; a hit sets the shift. What is tried
    follows from the hit before, so a row is one walk, linear in its keys.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("o", T.LongType()), T.StructField("n", T.LongType())])))
    def walk(olds: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(olds, news):
            there, shift, hits = set(b if b is not None else ()), 0, []
            for o in a if a is not None else ():
                found = next((o + shift + i for i in range(ahead + 1) if o + shift + i in there), None)
                if found is not None:
                    shift = found - o
                    hits.append({"o": int(o), "n": int(found)})
            out.append(hits)
        return pd.Series(out)

    return groups.withColumn("leaves", walk(old, new))


def gap_fill(old: DataFrame, new: DataFrame, anchors: DataFrame, by: list[str], at: str, label: str, most: int = MOST) -> DataFrame:
    """Rows between consecutive anchors whose gaps are of one length, matched by place if their labels agree.

    anchors: by, old_at, new_at. Returns by, old_at, new_at, label. A row finds its gap in
    one ordered pass, so gaps may be of any width.
    """
    from .joins import containing

    gaps = running(anchors.select(*by, "old_at", "new_at"), by, [F.col("old_at")], shifts={"__next_old": (F.col("old_at"), -1), "__next_new": (F.col("new_at"), -1)}, most=most)
    gaps = gaps.where(F.col("__next_old") - F.col("old_at") == F.col("__next_new") - F.col("new_at"))
    spans = gaps.select(*by, (F.col("old_at") + 1).alias("__start"), F.col("__next_old").alias("__end"), (F.col("new_at") - F.col("old_at")).alias("__shift"))
    o = containing(old.select(*by, F.col(at).alias("old_at"), label), spans, by, "old_at", "__start", "__end", ["__shift"], most).where("__shift IS NOT NULL")
    n = new.select(*by, F.col(at).alias("new_at"), F.col(label).alias("__label"))
    moved = o.withColumn("new_at", F.col("old_at") + F.col("__shift"))
    return moved.join(n, [*by, "new_at"]).where(F.col(label) == F.col("__label")).select(*by, "old_at", "new_at", label)


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """One group's pairing: old keys in their order take their best new key that is free."""
    rows = frame.sort_values(["old", "score", "new"], ascending=[True, False, True])
    used, keep, served = set(), [], None
    for i, (o, n) in enumerate(zip(rows["old"].tolist(), rows["new"].tolist())):
        if o != served and n not in used:
            used.add(n)
            keep.append(i)
            served = o
    return rows.iloc[keep]


def one_to_one(candidates: DataFrame, by: list[str], schema: str, most: int = 100_000) -> DataFrame:
    """Greedy pairing within each group: candidates (old, new, score) in the order of old take their best free new (the least of several).

    Groups of more than most rows are paired in rounds over all of them: a new key never goes to a later old key than the first
    whose best it is, so such rows go; a pair that is the old key's best, and has no earlier row for its new key, stands. What the
    rounds leave in groups that have become small, and small groups, are one fold each. The choice is that of one old key after the other.
    """
    columns = candidates.columns
    sizes = lambda df: df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*by)
    crowded = sizes(candidates)
    if crowded.isEmpty():
        return candidates.groupBy(*by).applyInPandas(_fold, schema).select(columns)
    crowded = staged(crowded)
    done = []
    small = candidates.join(crowded, by, "left_anti")
    left = staged(candidates.join(crowded, by, "left_semi"))
    while True:
        best = left.groupBy(*by, "old").agg(F.max(F.struct("score", (-F.col("new")).alias("m"))).alias("b")).select(*by, "old", (-F.col("b.m")).alias("new"))
        asked = best.groupBy(*by, "new").agg(F.min("old").alias("__asks"))
        first = left.groupBy(*by, "new").agg(F.min("old").alias("__first"))
        marked = left.join(best.withColumn("__best", F.lit(True)), [*by, "old", "new"], "left").join(asked, [*by, "new"], "left").join(first, [*by, "new"])
        marked = staged(marked.withColumn("__stands", F.coalesce(F.col("__best") & (F.col("old") == F.col("__first")), F.lit(False))))
        stands = staged(marked.where("__stands").select(columns))
        done.append(stands)
        rest = marked.where("NOT __stands AND (__asks IS NULL OR old <= __asks)").select(columns)
        left = staged(rest.join(stands.select(*by, "old"), [*by, "old"], "left_anti").join(stands.select(*by, "new"), [*by, "new"], "left_anti"))
        again = staged(sizes(left))
        small = small.unionByName(left.join(again, by, "left_anti"))
        if again.isEmpty():
            break
        left = staged(left.join(again, by, "left_semi"))
    out = small.groupBy(*by).applyInPandas(_fold, schema).select(columns)
    for d in done:
        out = out.unionByName(d)
    return out

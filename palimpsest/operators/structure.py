"""Structural resolution: roots of one base matched by their children, scalars by aligned runs, strides refreshed.

A profile has a row per base and root: base, root, stride, children (sorted array of fields).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import align, blocks
from .paths import without_strides
from .sequence import islands
from .staged import staged, stored

#: Roots: how far children may move together, the fewest children, the least share of them that must meet.
REACH, LEAST_CHILDREN, LEAST_SHARE = 12, 4, 0.6


def profiles(paths: DataFrame) -> DataFrame:
    """paths: base, root, stride, perhaps stride2, child. One row per base and root; a stride is the most frequent, the least of several."""
    from .keyed import votes

    out = paths.groupBy("base", "root").agg(F.array_sort(F.collect_set("child")).alias("children"))
    names = [c for c in ("stride", "stride2") if c in paths.columns]
    for c in names:
        out = out.join(votes(paths.where(F.col(c).isNotNull()), ["base", "root"], c).select("base", "root", c), ["base", "root"], "left")
    return out.select("base", "root", *names, "children")


def by_delta(old: DataFrame, new: DataFrame, by: list[str], key: str, children: str, reach: int = REACH, block: int = blocks.BLOCK) -> DataFrame:
    """Per old key: the new key and the shift of at most reach by which most of its children meet that key's; by, key, new_key, delta, hits, share.

    Rows with all their children meet in blocks, where a row's hits are counted at once (see blocks.met), so that neither children that are near
    nor hits are shuffled. Keys with fewer than LEAST_CHILDREN on either
    side, or of which less than LEAST_SHARE meet, get none; ties go to the nearest shift, then the least key.
    """
    known = F.filter(F.col(children).cast("array<bigint>"), lambda c: c.isNotNull()).alias("c")
    big = lambda df, k: stored(df.where(F.size(children) >= LEAST_CHILDREN).select(*by, F.col(key).alias(k), F.size(children).alias("size"), known))
    hits = blocks.met(big(old, "o"), big(new, "n"), by, "o", "n", "c", lambda x, y: _moved(x, y, reach), "o_n bigint, delta bigint, hits bigint", block)
    order = F.struct((-F.col("hits")).alias("h"), F.abs("delta").alias("d"), F.col("delta").alias("s"), F.col("n").alias("k"))
    best = hits.groupBy(*by, "o", "o_n").agg(F.min_by(F.struct("n", "delta", "hits"), order).alias("x"))
    out = best.select(*by, F.col("o").alias(key), F.col("x.n").alias("new_key"), F.col("x.delta").alias("delta"), F.col("x.hits").alias("hits"), F.round(F.col("x.hits") / F.col("o_n"), 6).alias("share"))
    return out.where(F.col("share") >= LEAST_SHARE)


#: Pairs of near children that are counted at once.
PAIRS = 1 << 21


def _moved(old: pa.Table, new: pa.Table, reach: int, most: int = PAIRS) -> tuple[np.ndarray, ...]:
    """Places of old and of new rows, size, shift and hits: for each old row of a block that meets any, the new row and the shift by_delta prefers.

    Many rows of many groups are counted together, as long as they have about most pairs of near children.
    """
    rows, children = [], []
    for x in (old, new):
        lists = x["c"].combine_chunks()
        rows.append(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy().astype(np.int64)))
        children.append(lists.flatten().to_numpy())
    groups, of_old = np.unique(old["__g"].to_numpy(), return_inverse=True)
    known = new["__g"].to_numpy()
    of_new = np.searchsorted(groups, known)
    known = (of_new < len(groups)) & (groups[np.minimum(of_new, len(groups) - 1)] == known) if len(groups) else known < known
    kept = known[rows[1]]
    (a_row, n_row), (a, c) = (rows[0], rows[1][kept]), (children[0], children[1][kept])
    out = []
    if len(a) and len(c):
        # groups stand apart in one order of children, as many as 64 bits allow
        lowest, width = int(min(a.min(), c.min())), 2 * reach + 1
        span = int(max(a.max(), c.max())) - lowest + 2 * width
        together = max(1, (1 << 62) // span)
        a_group, c_group = of_old[a_row], of_new[n_row]
        for g in range(0, len(groups), together):
            mine, theirs = (slice(*np.searchsorted(x, [g, g + together])) for x in (a_group, c_group))
            apart = lambda x, of: x if together == 1 else (of - g) * span + (x - lowest)  # noqa: E731, B023
            here, there, n = apart(a[mine], a_group[mine]), apart(c[theirs], c_group[theirs]), n_row[theirs]
            in_order = np.argsort(there, kind="stable")
            there, n, row = there[in_order], n[in_order], a_row[mine]
            first = np.searchsorted(there, here - reach)
            times = np.searchsorted(there, here + reach, "right") - first
            # cut between rows
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            upto = np.cumsum(times)[starts] - times[starts] if len(starts) else starts
            cuts = starts[np.flatnonzero(np.diff(upto // most)) + 1]
            for some in np.split(np.arange(len(here)), cuts):
                out.append(_preferred(row[some], here[some], first[some], times[some], there, n, reach))
    place, key, shift, hits = np.concatenate([np.zeros((0, 4), np.int64), *out]).T
    return place, key, old["size"].to_numpy().astype(np.int64)[place], shift, hits


def _preferred(row: np.ndarray, here: np.ndarray, first: np.ndarray, times: np.ndarray, there: np.ndarray, n: np.ndarray, reach: int) -> np.ndarray:
    """Row, new row, shift and hits of rows whose children each meet so many of there from first on."""
    at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
    if not len(at):
        return np.zeros((0, 4), np.int64)
    width, low = 2 * reach + 1, n[at].min()
    of = (int(n[at].max()) - int(low) + 1) * width
    told, hits = np.unique((np.repeat(row, times) - row[0]) * of + (n[at] - low) * width + (there[at] - np.repeat(here, times) + reach), return_counts=True)
    mine, shift, key = told // of + row[0], told % width - reach, told % of // width + low
    order = np.lexsort((key, shift, np.abs(shift), -hits, mine))
    order = order[np.diff(mine[order], prepend=-1) > 0]
    return np.stack([mine[order], key[order], shift[order], hits[order]], axis=1)


def match_roots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles' roots matched within their base by four phases, each over what the ones before left: base, root, new_root, phase.

    signature: equal children, the k-th with the k-th. similar: the best Jaccard above 0.6.
    same: the same number. delta: children that moved together.
    """
    signed = lambda df, k: df.where(F.size("children") > 0).select("base", F.col("root").alias(k), F.array_join("children", ",").alias("sig"))
    nth = lambda df, k: align.ordinals(signed(df, k), ["base", "sig"], k, "i")
    done = nth(old, "root").join(nth(new, "new_root"), ["base", "sig", "i"]).select("base", "root", "new_root", F.lit("signature").alias("phase"))

    def left(o: DataFrame, n: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
        return staged(o.join(told, ["base", "root"], "left_anti")), staged(n.join(told.select("base", F.col("new_root").alias("root")), ["base", "root"], "left_anti"))

    # what a phase told, and what it left, is read by all that follow
    done = staged(done)
    o, n = left(old, new, done)
    pairs = _jaccard(o, n)
    similar = align.one_to_one(pairs, ["base"], "base string, old bigint, new bigint, score double")
    similar = staged(similar.select("base", F.col("old").alias("root"), F.col("new").alias("new_root"), F.lit("similar").alias("phase")))
    o, n = left(o, n, similar)
    same = staged(o.select("base", "root").join(n.select("base", "root"), ["base", "root"]).select("base", "root", F.col("root").alias("new_root"), F.lit("same").alias("phase")))
    o, n = left(o, n, same)
    moved = by_delta(o, n, ["base"], "root", "children")
    return done.unionByName(similar).unionByName(same).unionByName(moved.select("base", "root", F.col("new_key").alias("new_root"), F.lit("delta").alias("phase")))


def _jaccard(old: DataFrame, new: DataFrame) -> DataFrame:
    rows = lambda df, k: df.select("base", F.col("root").cast("long").alias(f"{k}_key"), F.explode("children").alias("c")).distinct()
    found = align.similar_sets(rows(old, "a"), rows(new, "b"), ["base"], "c", 0.6)
    return found.select("base", F.col("a_key").alias("old"), F.col("b_key").alias("new"), F.col("jaccard").alias("score")).where("score > 0.6")


def resolve_arrays(entries: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """entries: name, base, root, stride, leaf. Adds new_root, new_stride (the old one if unknown), new_leaf and phase.

    The leaf moves by the walk over the root's children where the root's number changed, else it stays.
    """
    roots = match_roots(old, new)
    both = roots.join(old.select("base", "root", F.col("children").alias("oc")), ["base", "root"]).join(new.select("base", F.col("root").alias("new_root"), F.col("children").alias("nc"), F.col("stride").alias("ns")), ["base", "new_root"])
    walked = align.greedy_leaves(both.withColumns({"oc": F.col("oc").cast("array<bigint>"), "nc": F.col("nc").cast("array<bigint>")}), "oc", "nc")
    j = entries.join(walked, ["base", "root"], "left")
    hit = F.get(F.transform(F.filter("leaves", lambda x: x["o"] == F.col("leaf")), lambda x: x["n"]), F.lit(0))
    moved = F.when(F.col("root") != F.col("new_root"), F.coalesce(hit, F.col("leaf"))).otherwise(F.col("leaf"))
    return j.select(*entries.columns, "new_root", F.coalesce("ns", "stride").alias("new_stride"), F.when(F.col("new_root").isNotNull(), moved).alias("new_leaf"), "phase")


def aligned_fields(old: DataFrame, new: DataFrame, gap: int = 64, reach: int = 1200) -> DataFrame:
    """base, field, new_field: runs of old fields, cut where neighbours lie over gap apart, each moved by the shift below reach that meets most of new's fields; those that meet one."""
    o = islands(old.select("base", "field").distinct(), ["base"], "field", gap).withColumn("run", F.concat_ws("|", "base", "island"))
    width = F.lit(reach)
    span = o.groupBy("base", "run").agg(F.min("field").alias("lo"), F.max("field").alias("hi"))
    span = span.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") + reach) / width))))
    n = new.select("base", "field").distinct().withColumn("b", F.floor(F.col("field") / width))
    near = n.join(span, ["base", "b"]).where((F.col("field") >= F.col("lo")) & (F.col("field") < F.col("hi") + reach)).select("run", "field")
    moved = align.aligned(o.select("run", "field"), near, ["run"], "field", reach)
    return moved.join(o.select("base", "run", "field"), ["run", "field"]).select("base", "field", F.col("new_key").alias("new_field"))


def resolve_scalars(entries: DataFrame, old: DataFrame, new: DataFrame, anchors: DataFrame, gap: int = 64, reach: int = 1200) -> DataFrame:
    """entries (name, base, field) that can be told: name, new_field and phase.

    old, new: base and field of scalars. aligned: the field's run, cut where neighbours lie over gap apart, moves by
    the shift that meets most of new's fields, and the image isn't the field itself. bracketed: the anchors (base, field, shift)
    next below and above agree on a shift; nothing is told beyond them.
    """
    moved = aligned_fields(old, new, gap, reach).withColumnRenamed("new_field", "__moved")
    known = anchors.groupBy("base", "field").agg(F.min("shift").alias("shift"))
    asked = entries.select("base", "field").distinct().join(known.select("base", "field"), ["base", "field"], "left_anti")
    between = align.bracketed(asked, known, ["base"], "field", "shift", "__shift").where("__shift IS NOT NULL")
    j = entries.join(moved, ["base", "field"], "left").join(between, ["base", "field"], "left")
    hit = F.col("__moved").isNotNull() & (F.col("__moved") != F.col("field"))
    out = j.select("name", F.when(hit, F.col("__moved")).otherwise(F.col("field") + F.col("__shift")).alias("new_field"), F.when(hit, "aligned").otherwise("bracketed").alias("phase"))
    return out.where("new_field IS NOT NULL")


#: A path's parts: base, first field and the rest; of the rest, one or two array steps and what follows; of that, a sub-array's field and step, or a field, and what follows.
_HEAD = r"^([A-Za-z]+_[0-9]+)\.f_([0-9]+)(.*)$"
_STEPS = r"^\[(\w+) /\*([0-9]+)\*/\](?:\[(\w+) /\*([0-9]+)\*/\])?(.*)$"
_SUB = r"^\.f_([0-9]+)\[(\w+) /\*([0-9]+)\*/\](.*)$"
_LEAF = r"^\.f_([0-9]+)(.*)$"


def resolve_paths(values: DataFrame, arrays: tuple[DataFrame, DataFrame], subs: tuple[DataFrame, DataFrame], scalars: tuple[DataFrame, DataFrame], conservative: bool = False, scalar_only: bool = False, reach: int = 1200) -> DataFrame:
    """values (name, value) with new_value and phase, null where nothing is told.

    arrays, old and new: base, root, stride, stride2, child. subs: base, root, sub, stride, leaf. scalars: base, field.
    A known root moves as match_roots tells, its strides become the new ones, and its first leaf moves along if the root
    was matched by a shift of its children; a sub-array within it is matched likewise by its leaves. A root that
    isn't an array's moves as resolve_scalars tells. conservative: only paths whose strides alone change;
    scalar_only: no path with an array step. reach: how far scalars may move.
    """
    old, new = staged(profiles(arrays[0])), staged(profiles(arrays[1]))
    roots = staged(match_roots(old, new))
    part = lambda c, pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    number = lambda c, pattern, i: part(c, pattern, i).cast("long")
    v = values.select("name", "value", part("value", _HEAD, 1).alias("base"), number("value", _HEAD, 2).alias("root"), F.regexp_extract("value", _HEAD, 3).alias("rest"))
    v = v.withColumn("tail", F.when(F.col("rest").rlike(_STEPS), F.regexp_extract("rest", _STEPS, 5)).otherwise(F.col("rest")))
    v = v.withColumns({"sub": number("tail", _SUB, 1), "leaf": number("tail", _LEAF, 1)})
    strides = new.select("base", F.col("root").alias("new_root"), F.col("stride").alias("n1"), F.col("stride2").alias("n2"))
    moved = roots.where("phase = 'delta'").join(old.select("base", "root", F.col("children").cast("array<bigint>").alias("oc")), ["base", "root"]).join(new.select("base", F.col("root").alias("new_root"), F.col("children").cast("array<bigint>").alias("nc")), ["base", "new_root"])
    leaves = align.greedy_leaves(moved, "oc", "nc").select("base", "root", F.explode("leaves").alias("l")).select("base", "root", F.col("l.o").alias("leaf"), F.col("l.n").alias("new_leaf"))
    # sub-arrays are matched within their old root, by the old root's name on both sides
    within = lambda root: F.concat_ws("|", "base", root).alias("base")
    rows = lambda df, root: df.select(within(root), F.col("sub").alias("root"), "stride", F.lit(None).cast("bigint").alias("stride2"), F.col("leaf").alias("child"))
    new_subs = subs[1].withColumnRenamed("root", "new_root").join(roots.select("base", "root", "new_root"), ["base", "new_root"])
    so, sn = staged(profiles(rows(subs[0], "root"))), staged(profiles(rows(new_subs, "root")))
    matched = match_roots(so, sn).join(sn.select("base", F.col("root").alias("new_root"), F.col("stride").alias("ns")), ["base", "new_root"])
    matched = matched.select(F.col("base").alias("inside"), F.col("root").alias("sub"), F.col("new_root").alias("new_sub"), "ns")
    j = v.join(roots, ["base", "root"], "left").join(strides, ["base", "new_root"], "left").join(leaves, ["base", "root", "leaf"], "left")
    j = j.withColumn("inside", F.concat_ws("|", "base", "root")).join(matched, ["inside", "sub"], "left")
    anchors = roots.select("base", F.col("root").alias("field"), (F.col("new_root") - F.col("root")).alias("shift"))
    alone = staged(j.where(F.col("base").isNotNull() & F.col("new_root").isNull() & ~F.startswith("rest", F.lit("["))).select("name", "base", F.col("root").alias("field")))
    told = resolve_scalars(alone, scalars[0], scalars[1], anchors, reach=reach).select("name", F.col("new_field").alias("__field"), F.col("phase").alias("__phase"))
    j = j.join(told, "name", "left")
    text = lambda c: c.cast("string")
    step = lambda index, stride: F.concat(F.lit("["), index, F.lit(" /*"), text(stride), F.lit("*/]"))
    r = lambda i: F.regexp_extract("rest", _STEPS, i)
    first = step(r(1), F.coalesce(text(F.col("n1")), r(2)))
    second = F.when(r(3) != "", step(r(3), F.coalesce(text(F.col("n2")), r(4)))).otherwise("")
    steps = F.when(F.col("rest").rlike(_STEPS), F.concat(first, second)).otherwise("")
    s = lambda i: F.regexp_extract("tail", _SUB, i)
    inner = F.concat(F.lit(".f_"), text(F.coalesce("new_sub", "sub")), step(s(2), F.coalesce(text(F.col("ns")), s(3))), s(4))
    ending = F.when(F.col("sub").isNotNull(), inner).when(F.col("new_leaf").isNotNull(), F.concat(F.lit(".f_"), text(F.col("new_leaf")), F.regexp_extract("tail", _LEAF, 2))).otherwise(F.col("tail"))
    head = lambda c: F.concat(F.col("base"), F.lit(".f_"), text(F.col(c)))
    made = F.when(F.col("new_root").isNotNull(), F.concat(head("new_root"), steps, ending)).when(F.col("__field").isNotNull(), F.concat(head("__field"), "rest"))
    if scalar_only:
        made = F.when(~F.contains("value", F.lit("[")), made)
    if conservative:
        made = F.when(without_strides("value") == without_strides(made), made)
    return j.withColumn("new_value", made).select("name", "value", "new_value", F.when(F.col("new_value").isNotNull(), F.coalesce("phase", "__phase")).alias("phase"))


def propagate_strides(pairs: DataFrame, entries: DataFrame, names: str = "(?i)next|size|settings", percent: int = 60) -> DataFrame:
    """pairs: two arrays of strides, old and new. entries: name, value (integers). Adds new_value: where the name fits and the pairs of strides agree on another value.

    The k-th strides of lists of one length vote; the winner needs percent of all votes.
    """
    from .joins import zipped
    from .keyed import supermajority

    votes = supermajority(zipped(pairs, [], "old", "new").select(F.col("a_value").alias("value"), F.col("b_value").alias("to")), ["value"], "to", percent).select("value", "to")
    fits = F.col("name").rlike(names) & F.col("to").isNotNull() & (F.col("to") != F.col("value"))
    return entries.join(votes, "value", "left").withColumn("new_value", F.when(fits, F.col("to")).otherwise(F.col("value"))).drop("to")

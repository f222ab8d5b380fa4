"""Running values over ordered rows, in groups of any size: a segmented scan in two levels.

A group of few rows is one window. The rows of larger groups are cut, by group
and order, into ranges of similar size wherever a group lies; windows run within ranges, one row of
state per range is carried over the ranges before (or after) it, and rows add what
their range is handed. The states are associative: sums, last and next values, and the
rows at the ranges' edges for neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staged import staged

#: Rows from which on a group is cut, and how many ranges such a number of rows makes.
MOST, CUTS = 1_000_000, 4
#: Ranges that a smaller limit may make.
FEW = 64


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


def _inside(df: DataFrame, by: list[str], order: list[Column], sums: list[str], lasts: list[str], nexts: list[str], shifts: dict[str, tuple[str, int]]) -> DataFrame:
    """df with __at (the place from 1) and, per payload column c, __sum_c, __last_c and __next_c; per shift its name. All within by."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"__at": F.row_number().over(w)} | {f"__sum_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums} | {f"__last_{c}": F.last(c, ignorenulls=True).over(upto) for c in lasts})
    if shifts:
        out = out.withColumns({name: F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w) for name, (c, n) in shifts.items()})
    if nexts:
        # backwards: a frame that ends behind each row would be read again for each
        back = Window.partitionBy(*by).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"__next_{c}": F.last(c, ignorenulls=True).over(back) for c in nexts})
    return out


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    shifts: dict[str, tuple[Column, int]] | None = None,
    most: int = MOST,
) -> DataFrame:
    """df with columns that follow from the rows before or after, in a total order within by.

    sums: the sum up to and with the row, nulls as nothing; lasts: the last value that isn't null, at
    or before the row; nexts: the first such value after it; shifts: the value so many rows
    before, or after where negative. Groups of more than most rows are spread over tasks. Null keys
    are a group.
    """
    sums, lasts, nexts, shifts = sums or {}, lasts or {}, nexts or {}, shifts or {}
    pay = {f"__{kind}{i}": c for kind, d in (("s", sums), ("l", lasts), ("n", nexts)) for i, c in enumerate(d.values())}
    pay |= {f"__h{i}": c for i, (c, _) in enumerate(shifts.values())}
    rows = df.withColumns(pay)
    named = lambda letter, d: [f"__{letter}{i}" for i in range(len(d))]
    s, n, t = named("s", sums), named("l", lasts), named("n", nexts)
    told = {name: (f"__h{i}", k) for i, (name, (_, k)) in enumerate(shifts.items())}

    def final(out: DataFrame) -> DataFrame:
        values = {name: F.col(f"__sum_{c}") for name, c in zip(sums, s)} | {name: F.col(f"__last_{c}") for name, c in zip(lasts, n)} | {name: F.col(f"__next_{c}") for name, c in zip(nexts, t)}
        own = [c for c in df.columns if c not in values and c not in told]
        return out.select(*own, *(v.alias(k) for k, v in values.items()), *told)

    crowded = df.groupBy(*by).agg(F.count("*").alias("__rows")).where(F.col("__rows") > most)
    total = crowded.agg(F.sum("__rows")).first()[0]
    if not total:
        return final(_inside(rows, by, order, s, n, t, told))

    crowded = staged(crowded)
    apart = _same("r", "c", by)
    few = final(_inside(rows.alias("r").join(crowded.alias("c"), apart, "left_anti"), by, order, s, n, t, told))
    many = rows.alias("r").join(crowded.alias("c"), apart, "left_semi")
    # each range is a task, and tells the driver of itself: their number follows the rows, but beyond FEW only as fast as for groups of MOST
    ranges = min(-(-total * CUTS // most), max(-(-total * CUTS // MOST), FEW))
    ranged = many.repartitionByRange(int(ranges), *by, *order).withColumn("__range", F.spark_partition_id())
    inner = staged(_inside(ranged, [*by, "__range"], order, s, n, t, told))

    # a range's state, and what it is handed by those before or after it
    states = [F.count("*").alias("__n"), *(F.sum(c).alias(c) for c in s)]
    states += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c) for c in n] + [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c) for c in t]
    per = inner.groupBy(*by, "__range").agg(*states)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum(c).over(before).alias(f"__c{c}") for c in s] + [F.last(c, ignorenulls=True).over(before).alias(f"__c{c}") for c in n] + [F.last(c, ignorenulls=True).over(after).alias(f"__c{c}") for c in t]
    handed = staged(per.select(*by, "__range", "__n", *carry))
    out = inner.alias("r").join(handed.alias("c"), _same("r", "c", [*by, "__range"])).select("r.*", "__n", *(f"__c{c}" for c in [*s, *n, *t]))
    out = out.withColumns({f"__sum_{c}": F.col(f"__sum_{c}") + F.coalesce(f"__c{c}", F.lit(0)) for c in s} | {f"__last_{c}": F.coalesce(f"__last_{c}", f"__c{c}") for c in n} | {f"__next_{c}": F.coalesce(f"__next_{c}", f"__c{c}") for c in t})
    if told:
        # neighbours across ranges: among the rows at the ranges' edges all are adjacent that are so in the group
        reach = max(abs(k) for _, k in told.values())
        edge = (F.col("__at") <= reach) | (F.col("__at") > F.col("__n") - reach)
        w = Window.partitionBy(*by).orderBy("__range", "__at")
        moved = {f"__e{name}": F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w) for name, (c, k) in told.items()}
        edges = out.where(edge).select(*by, "__range", "__at", *{c for c, _ in told.values()}).withColumns(moved).select(*by, "__range", "__at", *moved)
        out = out.alias("r").join(edges.alias("c"), _same("r", "c", [*by, "__range", "__at"]), "left").select("r.*", *moved)
        near = lambda k: F.col("__at") <= k if k >= 0 else F.col("__at") > F.col("__n") + k
        out = out.withColumns({name: F.when(near(k), F.col(f"__e{name}")).otherwise(F.col(name)) for name, (_, k) in told.items()})
    return few.unionByName(final(out))

"""Rows of two sides, each with a list, that meet within groups block by block, so that pairs arise in tasks and none is shuffled."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staged import stored

#: Members of all lists of a block of one side, about; groups of fewer than an eighth are dealt out together.
BLOCK = 1 << 21


def met(a: DataFrame, b: DataFrame, by: list[str], a_key: str, b_key: str, listed: str, run: Callable[[pa.Table, pa.Table], list], kinds: str, block: int = BLOCK) -> DataFrame:
    """by, a_key, b_key and what run tells (kinds) of pairs of rows within by.

    a, b: by, key, the array listed and other columns; both are read more than once. Each side of a group is cut by key into blocks of about so many
    members, and each block of a meets each of b in one task; what is shuffled are the rows, as often as the other side has blocks. Small groups
    share a task. run takes a block of each: key, __g (a number of the group) and the other columns, in the order of __g, b's also of key; it returns
    places in a, places in b and a column for each of kinds.
    """
    sizes = lambda df, name: df.groupBy(*by).agg(F.sum(F.size(listed)).alias(name))
    groups = sizes(a, "__a").join(sizes(b, "__b"), by).withColumns({"__g": F.monotonically_increasing_id(), "__as": F.ceil(F.col("__a") / block), "__bs": F.ceil(F.col("__b") / block)})
    groups = stored(groups)
    alone = F.greatest("__a", "__b") > block // 8
    shared = groups.agg(F.sum(F.when(~alone, F.col("__a") + F.col("__b")))).first()[0] or 0
    place = F.when(alone, F.col("__g")).otherwise(-1 - F.pmod(F.xxhash64("__g"), F.lit(1 + shared // max(1, block // 8))))
    cell = ["__c", "__i", "__j"]

    def dealt(df: DataFrame, k: str, parts: str, others: str, at: tuple[str, str]) -> DataFrame:
        more = [c for c in df.columns if c not in (*by, k)]
        out = df.join(groups, by).withColumns({"__c": place, at[0]: F.pmod(F.xxhash64(k), F.col(parts))})
        out = out.withColumn(at[1], F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(others) - 1, F.lit(0)))))
        # aliased anew: both sides have these from one table
        return out.select(*(F.col(c).alias(c) for c in [*cell, "__g"]), *(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col(k).alias("key"), *more)

    told = [k.split()[0] for k in kinds.split(", ")]
    names = [*(f"__by{i}" for i in range(len(by))), "__a", "__b", *told]

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("__g", "ascending")])
        right = right.sort_by([("__g", "ascending"), ("key", "ascending")])
        i, j, *rest = run(left, right)
        left = left.take(pa.array(i))
        return pa.table([*(left[f"__by{x}"] for x in range(len(by))), left["key"], right["key"].take(pa.array(j)), *map(pa.array, rest)], names=names)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, [*(kind(a, c) for c in by), kind(a, a_key), kind(b, b_key)])), kinds])
    both = dealt(a, a_key, "__as", "__bs", ("__i", "__j")).groupBy(*cell).cogroup(dealt(b, b_key, "__bs", "__as", ("__j", "__i")).groupBy(*cell))
    return both.applyInArrow(pairs, schema).withColumnsRenamed(dict(zip(names, [*by, a_key, b_key])))

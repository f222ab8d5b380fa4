"""Line similarity by filter and verify: cheap upper bounds first, the matching itself only for pairs that they let through.

The similarity is Ratcliff-Obershelp's: twice the matched characters over all characters, where
the longest common block is matched first, then what lies before and after it. It is at
most twice the smaller length over both lengths, and at most twice the common
characters, each counted as often as both texts have it, over both lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Classes that characters fall into: fewer than there are characters, so a bound may be too high, never too low.
CLASSES = 64


@F.pandas_udf(T.DoubleType())
def line_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings, to six places; the built-in edit distance isn't equivalent."""
    return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, x, y).ratio(), 6) for x, y in zip(a, b)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def bag(texts: pd.Series) -> pd.Series:
    """How many characters of each class a text has."""
    count = lambda t: np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % CLASSES, minlength=CLASSES).astype(np.int32)
    return pd.Series([None if t is None else count(t) for t in texts])


def common(a: Column | str, b: Column | str) -> Column:
    """How many characters two bags share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)


def bound(shared: Column, a_length: Column, b_length: Column) -> Column:
    """The similarity of texts of these lengths at most, if so many characters are matched; 1 for two empty texts."""
    total = a_length + b_length
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


def band(length: Column, least: float) -> Column:
    """The class of a length: texts that may reach the similarity lie in one class or in neighbouring ones. Equal texts have equal lengths."""
    if least >= 1:
        return length.cast("long")
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / math.log((2 - least) / least) + 1e-9)


def _members(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """by, id, member, place, n: a text's characters with their number within it, such as e2, in the order of how few texts have them; of these, as many as a similar text must share one of."""
    letters = F.split("text", "")
    numbered = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return rows.select(*by, "id", "n", F.explode(numbered).alias("member"))


def similar_pairs(a: DataFrame, b: DataFrame, by: list[str], least: float) -> DataFrame:
    """by, a_id, b_id, similarity: all pairs within by of texts that aren't empty whose similarity is at least that, between 0 and 1.

    a, b: by, id, text; null texts meet nothing. Two texts share at least least / (2 - least) of either's characters,
    the second e being another than the first; so with these in an order of rarity, they share one among the
    first ones of each. Pairs come from a join by such a character and the class of lengths, must
    pass both bounds, and are then matched, each pair of different texts once. What stands behind the first character that two texts
    share is all that they may share besides it.
    """
    share = least / (2 - least)
    side = lambda df: df.where("text <> ''").select(*by, "id", "text", F.length("text").alias("n"))
    a, b = side(a), side(b)
    texts = a.select(*by, F.col("text").alias("id"), "text", "n").unionByName(b.select(*by, F.col("text").alias("id"), "text", "n")).distinct()
    members = _members(texts, by, least)
    ranks = members.groupBy("member").agg(F.count("*").alias("texts"))
    told = members.join(ranks, "member").groupBy(*by, "id", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "member"))).alias("m"))
    first = F.slice("m.member", F.lit(1), F.col("n") - F.ceil(F.col("n") * share - 1e-9).cast("int") + 1)
    entered = told.select(*by, F.col("id").alias("text"), "n", F.posexplode(first).alias("at", "member")).withColumn("band", band(F.col("n"), least))

    met = entered.select(*by, F.col("text").alias("a_text"), F.col("n").alias("a_n"), "member", F.col("at").alias("a_at"), F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band"))
    met = met.join(a.select(*by, F.col("text").alias("a_text")).distinct(), [*by, "a_text"], "left_semi")
    with_b = entered.select(*by, F.col("text").alias("b_text"), F.col("n").alias("b_n"), "member", F.col("at").alias("b_at"), "band").join(b.select(*by, F.col("text").alias("b_text")).distinct(), [*by, "b_text"], "left_semi")
    # the place of the first shared character passes for any pair that reaches the similarity, whether or not later ones do
    in_band = bound(F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")), F.col("a_n"), F.col("b_n")) >= least - 1e-9
    pairs = met.join(with_b, [*by, "member", "band"]).where(in_band).select(*by, "a_text", "b_text").distinct()
    scored = verified(pairs, least)
    out = scored.join(a.select(*by, F.col("text").alias("a_text"), F.col("id").alias("a_id")), [*by, "a_text"]).join(b.select(*by, F.col("text").alias("b_text"), F.col("id").alias("b_id")), [*by, "b_text"])
    return out.select(*by, "a_id", "b_id", "similarity")


def verified(pairs: DataFrame, least: float, a: str = "a_text", b: str = "b_text") -> DataFrame:
    """pairs with similarity, of those that reach it; only pairs whose common characters allow that are matched."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = np.full(len(f), -1.0)
            for i, (x, y) in enumerate(zip(f[a], f[b])):
                m = SequenceMatcher(None, x, y)
                if m.real_quick_ratio() >= least - 1e-9 and m.quick_ratio() >= least - 1e-9:
                    told[i] = round(m.ratio(), 6)
            out = f.assign(similarity=told)
            yield out[told >= least]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{fields}, similarity double")

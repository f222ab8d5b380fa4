"""Bytes, bits and literals, and scans of bytes for patterns with wildcards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hex_bytes(text: Column | str) -> Column:
    """Hexadecimal digits, perhaps with blanks, as bytes."""
    return F.unhex(F.regexp_replace(_c(text), r"\s+", ""))


def hex_text(data: Column | str) -> Column:
    """Bytes as pairs of digits with blanks between."""
    return F.rtrim(F.regexp_replace(F.hex(_c(data)), "(..)", "$1 "))


def _reversed(data: Column, n: int) -> Column:
    return F.concat(*(F.substring(data, i, 1) for i in range(n, 0, -1)))


def integer(data: Column | str, start: int | Column, n: int, big: bool = False) -> Column:
    """The unsigned number in n <= 8 bytes from start, counted from 1; of eight bytes, the bit pattern. Little-endian unless big."""
    part = F.substr(_c(data), start if isinstance(start, Column) else F.lit(start), F.lit(n))
    return F.conv(F.hex(part if big else _reversed(part, n)), 16, -10 if n == 8 else 10).cast("long")


def signed(x: Column, bits: int) -> Column:
    return F.when(x >= 1 << bits - 1, x - (1 << bits)).otherwise(x)


def with_integer(data: Column | str, start: int, n: int, value: Column) -> Column:
    """data with value written over n bytes from start, little-endian."""
    data = _c(data)
    new = _reversed(F.unhex(F.lpad(F.hex(value), 2 * n, "0")), n)
    return F.concat(F.substring(data, 1, start - 1), new, F.substring(data, start + n, 1 << 30))


def literal(text: Column | str) -> Column:
    """An integer literal: 0x, 0b or 0o before its digits tell the base; null if it is none."""
    t = F.lower(F.trim(_c(text)))
    of = lambda base: F.conv(F.substring(t, 3, 64), base, 10).try_cast("long")
    return F.when(t.rlike("^0x[0-9a-f]+$"), of(16)).when(t.rlike("^0b[01]+$"), of(2)).when(t.rlike("^0o[0-7]+$"), of(8)).otherwise(t.try_cast("long"))


def rotate_left(x: Column | str, k: int) -> Column:
    """The 64 bits of x rotated by k."""
    k %= 64
    return F.shiftleft(_c(x), k).bitwiseOR(F.shiftrightunsigned(_c(x), 64 - k)) if k else _c(x)


def float_of_bits(x: Column | str) -> Column:
    """The 32-bit float with the bits of a number, as a double: sign, exponent and fraction by arithmetic."""
    bits = _c(x).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(0xFF))
    fraction = bits.bitwiseAND(F.lit(0x7FFFFF)).cast("double")
    sign = F.when(bits >= 1 << 31, -1.0).otherwise(1.0)
    size = F.when(exponent == 0, fraction * 2.0**-149).when(exponent < 255, (fraction + 8388608.0) * F.pow(F.lit(2.0), exponent - 150))
    return sign * size.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def wildcard(pattern: str) -> str:
    """Hexadecimal byte pairs and ? as an expression over bytes decoded one to one."""
    return "(?s)" + "".join("." if set(p) == {"?"} else f"\\x{int(p, 16):02X}" for p in pattern.split())


def count_bytes(data: Column | str, pattern: str) -> Column:
    """Non-overlapping matches of a wildcard pattern in bytes."""
    return F.regexp_count(F.decode(_c(data), "ISO-8859-1"), F.lit(wildcard(pattern)))


def positions(data: Column | str, pattern: str) -> Column:
    """Where, from 0, the non-overlapping matches of a wildcard pattern begin in bytes."""
    import re

    parts = [b"." if set(p) == {"?"} else re.escape(bytes([int(p, 16)])) for p in pattern.split()]
    find = re.compile(b"".join(parts), re.DOTALL).finditer

    @F.pandas_udf("array<int>")
    def found(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [m.start() for m in find(v)] for v in values])

    return found(_c(data))


def health(n_old: Column, n_new: Column) -> Column:
    """What became of a pattern that should be found once on each side."""
    return F.when(n_old == 0, "NOT_IN_OLD").when(n_old > 1, "AMBIG_OLD").when(n_new == 1, "OK").when(n_new == 0, "BROKEN").otherwise("AMBIG_NEW")


def pattern_health(corpus: DataFrame, text: str, patterns: DataFrame, mask: list[bool], is_old: Column) -> DataFrame:
    """pattern, n_old, n_new, status of patterns of words: how often each stands in the texts of either side.

    patterns: pattern and words, an array as long as mask; where mask is false any word fits. A text's
    sequences of words and the patterns meet in one join by the words that count, so patterns may be as many as texts.
    """
    own = lambda words, i: F.concat_ws("\x00", *(F.get(words, i + k) for k, fixed in enumerate(mask) if fixed))
    asked = patterns.where(F.size("words") == len(mask)).select("pattern", own(F.col("words"), F.lit(0)).alias("__k"))
    words = F.split(F.col(text), r"\s+")
    n = F.size("__w") - len(mask) + 1
    each = corpus.select(is_old.alias("old"), words.alias("__w")).where(n > 0).select("old", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: own(F.col("__w"), i))).alias("__k"))
    counted = each.join(asked.select("__k").distinct(), "__k", "left_semi").groupBy("__k").agg(F.count_if(F.col("old")).alias("n_old"), F.count_if(~F.col("old")).alias("n_new"))
    found = asked.join(counted, "__k", "left").na.fill(0, ["n_old", "n_new"])
    return found.select("pattern", "n_old", "n_new", health(F.col("n_old"), F.col("n_new")).alias("status"))


def long_pattern_health(corpus: DataFrame, key: str, text: str, patterns: DataFrame, mask: list[bool], is_old: Column) -> DataFrame:
    """pattern, n_old, n_new, status of patterns of words of any length; where mask is false any word fits, and words beyond mask count.

    patterns: pattern and words. Places where a pattern's first words stand come from a join by these; only their texts are
    looked at again, word by word. Patterns shorter than mask are TOO_SHORT.
    """
    own = lambda words, i: F.concat_ws("\x00", *(F.get(words, i + k) for k, fixed in enumerate(mask) if fixed))
    asked = patterns.where(F.size("words") >= len(mask)).select("pattern", own(F.col("words"), F.lit(0)).alias("__k"), F.slice("words", F.lit(len(mask) + 1), F.size("words")).alias("__rest"))
    held = corpus.select(F.col(key).alias("__key"), is_old.alias("old"), F.split(F.col(text), r"\s+", -1).alias("__w"))
    n = F.size("__w") - len(mask) + 1
    each = held.where(n > 0).select("__key", "old", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: own(F.col("__w"), i))).alias("__at", "__k"))
    met = each.join(asked, "__k")
    # the texts of such places, once each, and the words that follow there
    there = held.join(met.select("__key", "old").distinct(), ["__key", "old"], "left_semi")
    after = F.slice("__w", F.col("__at") + len(mask) + 1, F.size("__rest"))
    same = F.when(F.size("__rest") == 0, True).otherwise(after == F.col("__rest"))
    found = met.join(there, ["__key", "old"]).where(same).groupBy("pattern").agg(F.count_if(F.col("old")).alias("n_old"), F.count_if(~F.col("old")).alias("n_new"))
    out = patterns.select("pattern", (F.size("words") < len(mask)).alias("__short")).join(found, "pattern", "left").na.fill(0, ["n_old", "n_new"])
    return out.select("pattern", "n_old", "n_new", F.when(F.col("__short"), "TOO_SHORT").otherwise(health(F.col("n_old"), F.col("n_new"))).alias("status"))

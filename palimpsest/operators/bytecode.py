"""Programs of variable-length instructions: decoding, segmentation, fingerprints, address maps and operand remaps.

The instruction set is a table given by the caller: opcode, mnemonic, operand kinds.
Kinds: u8, u16, s16, u24, u32, f32, rel16 (from the next instruction), native (a byte of
counts, then a big-endian index), enter (parameters, variables, a named tail), leave, switch (a
counted list of cases).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import containing
from .scan import running
from .staged import staged

Table = dict[int, tuple[str, str]]
SIZES = {"": 0, "u8": 1, "u16": 2, "s16": 2, "rel16": 2, "u24": 3, "u32": 4, "f32": 4, "native": 3, "leave": 2}
ROW = "script string, version string, seq int, offset int, op int, mnemonic string, kind string, operands binary, value bigint"


def operand_size(kind: str, code: bytes, at: int) -> int:
    """Bytes of the operands that start at a place; enter and switch say so themselves."""
    if kind == "enter":
        return 4 + (code[at + 3] if at + 3 < len(code) else 0)
    if kind == "switch":
        return 1 + 6 * (code[at] if at < len(code) else 0)
    return SIZES[kind]


def operand_value(kind: str, operands: bytes, after: int) -> int | None:
    """An operand as a number; a jump's is its target, a native's its index, an enter's its parameters."""
    if kind == "u24":
        return int.from_bytes(operands, "little")
    if kind in ("u8", "u16", "u32"):
        return int.from_bytes(operands, "little")
    if kind in ("s16", "rel16"):
        return struct.unpack("<h", operands)[0] + (after if kind == "rel16" else 0)
    if kind == "native":
        return int.from_bytes(operands[1:3], "big")
    return operands[0] if kind in ("enter", "leave", "switch") else None


def disassemble(code: bytes, table: Table) -> list[tuple[int, int, str, str, bytes, int | None]]:
    """(offset, op, mnemonic, kind, operands, value) of each instruction; an unknown or cut one is an error."""
    out, at = [], 0
    while at < len(code):
        if code[at] not in table:
            raise ValueError(f"no instruction {code[at]:#04x} at {at}")
        name, kind = table[code[at]]
        n = operand_size(kind, code, at + 1)
        if at + 1 + n > len(code):
            raise ValueError(f"instruction at {at} is cut off")
        operands = code[at + 1 : at + 1 + n]
        out.append((at, code[at], name, kind, operands, operand_value(kind, operands, at + 1 + n)))
        at += 1 + n
    return out


def switch_cases(operands: bytes, offset: int) -> list[tuple[int, int]]:
    """(value, target) of each case; targets count from the end of the case."""
    out = []
    for i in range(operands[0]):
        value, jump = struct.unpack_from("<Ih", operands, 1 + 6 * i)
        out.append((value, offset + 2 + 6 * (i + 1) + jump))
    return out


def instructions(programs: DataFrame, table: Table) -> DataFrame:
    """programs: script, version, code (binary). One row per instruction; a program is one row's work, as each instruction's place follows from those before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROW.split(", ")]
        for frame in frames:
            for script, version, code in zip(frame["script"], frame["version"], frame["code"]):
                rows = [(script, version, i, *r) for i, r in enumerate(disassemble(bytes(code or b""), table))]
                yield pd.DataFrame(rows, columns=names).astype({"value": "Int64"})

    return programs.select("script", "version", "code").mapInPandas(run, ROW)


def assemble(rows: DataFrame) -> DataFrame:
    """Instructions back to each program's bytes: script, version, code."""
    one = F.concat(F.unhex(F.lpad(F.hex("op"), 2, "0")), F.col("operands"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", one.alias("b"))))
    joined = F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["b"])), ""))
    return rows.groupBy("script", "version").agg(joined.alias("code"))


def in_functions(rows: DataFrame) -> DataFrame:
    """rows with idx, the function each stands in: from an enter to the next; what stands before the first goes."""
    w = Window.partitionBy("script", "version").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("idx", (F.count_if(F.col("kind") == "enter").over(w) - 1).cast("int")).where("idx >= 0")


def _function() -> list[Column]:
    leave = F.col("kind") == "leave"
    returns = F.max_by(F.when(leave, F.conv(F.hex(F.substring("operands", 2, 1)), 16, 10).cast("int")), F.when(leave, F.col("seq")))
    return [F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.min("offset").alias("start_offset"), F.min_by("value", "seq").cast("int").alias("params"), returns.alias("returns")]


def functions(rows: DataFrame) -> DataFrame:
    """The functions that tile each program: script, version, idx, start_seq, end_seq, start_offset, params, returns (of the last leave)."""
    return in_functions(rows).groupBy("script", "version", "idx").agg(*_function())


def fingerprints(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """functions with natives (the hashes called, in order), constants (u32 and f32, sorted) and strict and loose prints.

    hashes: script, version, index and hash of natives. Rows know their function, so one
    aggregate gives all.
    """
    by = ["script", "version"]
    told = in_functions(rows).join(hashes.select(*by, F.col("index").cast("long").alias("value"), "hash"), [*by, "value"], "left")
    natives = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "native", F.struct("seq", F.coalesce("hash", "value").alias("h"))))), lambda x: x["h"].cast("string")), ",")
    constants = F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind").isin("u32", "f32"), F.hex("operands")))), ",")
    out = told.groupBy(*by, "idx").agg(*_function(), natives.alias("natives"), constants.alias("constants"))
    loose = F.concat_ws("|", F.col("params").cast("string"), F.coalesce(F.col("returns").cast("string"), F.lit("-")), "natives")
    return out.withColumn("loose", loose).withColumn("strict", F.concat_ws("|", "loose", "constants"))


def address_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """Functions of two versions by tiers: old_idx, new_idx, tier. old and new: script, idx, start_seq, end_seq, params, returns, strict, loose.

    strict and loose prints must be unique on both sides; then what lies between two
    consecutive matches at equal distances, if parameters, returns and about the length agree.
    """
    own = lambda df, s: df.select("script", F.col("idx").alias(f"{s}_idx"), "strict", "loose", "params", "returns", (F.col("end_seq") - F.col("start_seq")).alias(f"{s}_len"))
    o, n = staged(own(old, "old")), staged(own(new, "new"))

    def tier(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
        once = lambda d, c: d.groupBy("script", by).agg(F.count("*").alias("c"), F.min(c).alias(c)).where("c = 1").drop("c")
        return once(a, "old_idx").join(once(b, "new_idx"), ["script", by]).select("script", "old_idx", "new_idx", F.lit(by).alias("tier"))

    strict = tier(o, n, "strict")
    left = lambda d, c: d.join(strict.select("script", c), ["script", c], "left_anti")
    loose = tier(left(o, "old_idx"), left(n, "new_idx"), "loose")
    known = staged(strict.unionByName(loose))
    # a function finds its gap in one ordered pass, however wide that is
    gaps = running(known, ["script"], [F.col("old_idx")], shifts={"o2": (F.col("old_idx"), -1), "n2": (F.col("new_idx"), -1)}).where("o2 - old_idx = n2 - new_idx")
    spans = gaps.select("script", (F.col("old_idx") + 1).alias("lo"), F.col("o2").alias("hi"), (F.col("new_idx") - F.col("old_idx")).alias("shift"))
    places = containing(o.select("script", "old_idx"), spans, ["script"], "old_idx", "lo", "hi", ["shift"]).where("shift IS NOT NULL").select("script", "old_idx", (F.col("old_idx") + F.col("shift")).alias("new_idx"))
    a = o.select("script", "old_idx", "old_len", F.col("params").alias("pa"), F.col("returns").alias("ra"))
    b = n.select("script", "new_idx", "new_len", F.col("params").alias("pb"), F.col("returns").alias("rb"))
    alike = F.col("pa").eqNullSafe(F.col("pb")) & F.col("ra").eqNullSafe(F.col("rb")) & (F.abs(F.col("old_len") - F.col("new_len")) <= F.greatest(F.lit(6.0), F.greatest("old_len", "new_len") * 0.35))
    filled = places.join(a, ["script", "old_idx"]).join(b, ["script", "new_idx"]).where(alike).select("script", "old_idx", "new_idx", F.lit("positional").alias("tier"))
    return known.unionByName(filled.join(known, ["script", "old_idx"], "left_anti"))


def mined_strides(rows: DataFrame, roots: list[str], field: str, array: str) -> DataFrame:
    """script, version, root, field and stride: of an array step that follows a field that follows a root, the most frequent, the first of several.

    roots, field and array name the instructions.
    """
    by = ["script", "version"]
    each = _array_steps(rows, roots, field, array).where("root IS NOT NULL").groupBy(*by, "root", "field", F.col("value").alias("stride")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return each.groupBy(*by, "root", "field").agg(F.max_by("stride", F.struct("n", -F.col("first"))).alias("stride"))


def _array_steps(rows: DataFrame, roots: list[str], field: str, array: str) -> DataFrame:
    """The array instructions, with root and field where these stand right before them."""
    w = Window.partitionBy("script", "version").orderBy("seq")
    back = lambda c, n: F.lag(c, n).over(w)
    told = rows.withColumns({"__m1": back("mnemonic", 1), "__m2": back("mnemonic", 2), "__v1": back("value", 1), "__v2": back("value", 2)})
    known = (F.col("__m1") == field) & F.col("__m2").isin(roots)
    return told.where(F.col("mnemonic") == array).select(*rows.columns, F.when(known, F.col("__v2")).alias("root"), F.when(known, F.col("__v1")).alias("field"))


def remap_audit(rows: DataFrame, old_natives: DataFrame, new_natives: DataFrame, calls: DataFrame, spans: DataFrame | None = None, strides: tuple[DataFrame, DataFrame] | None = None, names: tuple[list[str], str, str] | None = None) -> DataFrame:
    """What each native, call or stride operand of old rows becomes: script, seq, kind, old, new, confidence.

    natives: script, index, hash. calls: script, old_address, new_address, tier. A native
    goes by its hash, a call by the map; what can't be told has a null new and review. spans: script, old_base,
    new_base, length: calls into the span move with it (internal). strides: old and new mined_strides; names: those it was mined by.
    A stride that is its place's old one takes the new one; another that isn't the new one either needs review.
    """
    o = old_natives.select("script", F.col("index").cast("long").alias("value"), "hash")
    n = new_natives.groupBy("script", "hash").agg(F.max("index").cast("long").alias("new"))
    natives = rows.where("kind = 'native'").join(o, ["script", "value"], "left").join(n, ["script", "hash"], "left").select("script", "seq", "kind", F.col("value").alias("old"), "new", F.when(F.col("new").isNull(), "review").otherwise("exact").alias("confidence"))
    m = calls.select("script", F.col("old_address").cast("long").alias("value"), F.col("new_address").cast("long").alias("new"), "tier")
    called = rows.where("mnemonic = 'CALL'").select("script", "seq", "value")
    moved = None
    if spans is not None:
        at = called.join(spans.select("script", F.col("old_base").cast("long").alias("lo"), F.col("new_base").cast("long").alias("to"), F.col("length").cast("long").alias("size")), "script", "left")
        inside = F.coalesce((F.col("value") >= F.col("lo")) & (F.col("value") < F.col("lo") + F.col("size")), F.lit(False))
        moved = at.where(inside).select("script", "seq", F.lit("call").alias("kind"), F.col("value").alias("old"), (F.col("value") - F.col("lo") + F.col("to")).alias("new"), F.lit("internal").alias("confidence"))
        called = at.where(~inside).select("script", "seq", "value")
    external = called.join(m, ["script", "value"], "left").select("script", "seq", F.lit("call").alias("kind"), F.col("value").alias("old"), "new", F.coalesce("tier", F.lit("review")).alias("confidence"))
    out = natives.unionByName(external)
    if moved is not None:
        out = out.unionByName(moved)
    if strides and names:
        side = lambda df, c: df.select("script", "root", "field", F.col("stride").alias(c))
        steps = _array_steps(rows, *names).where("root IS NOT NULL").join(side(strides[0], "__o"), ["script", "root", "field"], "left").join(side(strides[1], "__n"), ["script", "root", "field"], "left")
        other = F.col("__n").isNotNull() & (F.col("__n") != F.col("value"))
        taken = F.col("__o").eqNullSafe(F.col("value"))
        new = F.when(~F.coalesce(other, F.lit(False)), F.col("value")).when(taken, F.col("__n"))
        out = out.unionByName(steps.select("script", "seq", F.lit("stride").alias("kind"), F.col("value").alias("old"), new.alias("new"), F.when(new.isNull(), "review").otherwise("exact").alias("confidence")))
    return out


def remapped(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """rows with the operands of natives, calls and strides written anew, where the audit tells a new value."""
    from ..functions.binary import with_integer

    j = rows.join(audit.where("new IS NOT NULL").select("script", "seq", "new"), ["script", "seq"], "left")
    big = F.unhex(F.lpad(F.hex("new"), 4, "0"))
    native = F.concat(F.substring("operands", 1, 1), big)
    written = F.when(F.col("kind") == "native", native).when(F.col("kind") == "u24", with_integer("operands", 1, 3, F.col("new"))).when(F.col("kind") == "u16", with_integer("operands", 1, 2, F.col("new")))
    return j.withColumn("operands", F.when(F.col("new").isNotNull(), F.coalesce(written, "operands")).otherwise(F.col("operands"))).select(*rows.columns)

"""Symbolic listings of programs: rendering, tokenising and two-pass assembly.

A line is a label and a colon, a mnemonic and arguments between commas, each if there; what
follows ; outside quotes is a comment. Arguments by kind: numbers (0x, 0o and 0b tell their base); f32 a
decimal; rel16 a label or an offset; native its byte of counts and its index; enter
parameters, variables and a quoted name; leave two numbers; switch value:target for each
case, a target being a label or an offset. Any operands can be given raw, as # and digits.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary
from .bytecode import SIZES, Table

_LABEL = re.compile(r"^\s*([A-Za-z_]\w*):\s*(.*)$", re.S)
_PIECE = re.compile(r'"(?:\\.|[^"\\])*"|[^,;"]+|[,;]')
_NUMBERS = {"u8": (1, False), "u16": (2, False), "s16": (2, True), "rel16": (2, True), "u24": (3, False), "u32": (4, False)}


def _cases() -> Column:
    """Of a switch: (value, target) of each case; targets count from the end of the case."""
    at = lambda i: i * 6 + 2
    case = lambda i: F.struct(binary.integer("operands", at(i), 4).alias("value"), (F.col("offset") + 2 + (i + 1) * 6 + binary.signed(binary.integer("operands", at(i) + 4, 2), 16)).alias("target"))
    n = binary.integer("operands", 1, 1)
    some = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), case)
    return F.when(n > 0, some).otherwise(F.slice(some, 1, 0))


def listing(rows: DataFrame) -> DataFrame:
    """script, version, seq, text: one line per instruction, a label before those that a jump or a case of the program targets."""
    by = ["script", "version"]
    starts = rows.select(*by, "offset")
    jumps = rows.where("kind = 'rel16'").select(*by, F.col("value").alias("offset"))
    cases = rows.where("kind = 'switch' AND length(operands) > 1").select(*by, F.explode(_cases()).alias("c")).select(*by, F.col("c.target").cast("long").alias("offset"))
    named = jumps.unionByName(cases).distinct().join(starts, [*by, "offset"], "left_semi").withColumn("label", F.concat(F.lit("L"), F.col("offset")))
    # jumps to where no instruction starts are shown by their offsets
    target = lambda x: F.when(F.array_contains("__labels", x.cast("long")), F.concat(F.lit("L"), x)).otherwise(x.cast("string"))
    u8 = lambda i: binary.integer("operands", i, 1).cast("string")
    name = F.decode(F.expr("substring(operands, 5)"), "ISO-8859-1")
    plain = name.rlike("^[ !#-\\[\\]-~]*$")  # printable, neither quotes nor backslashes
    shown = (
        F.when(F.col("kind") == "", "")
        .when(F.col("kind") == "rel16", target(F.col("value")))
        .when(F.col("kind").isin("u8", "u16", "s16", "u24", "u32"), F.col("value").cast("string"))
        .when(F.col("kind") == "native", F.concat_ws(", ", u8(1), F.col("value").cast("string")))
        .when(F.col("kind") == "leave", F.concat_ws(", ", u8(1), u8(2)))
        .when((F.col("kind") == "enter") & plain, F.concat_ws(", ", u8(1), binary.integer("operands", 2, 2).cast("string"), F.concat(F.lit('"'), name, F.lit('"'))))
        .when((F.col("kind") == "switch") & (F.length("operands") > 1), F.array_join(F.transform(_cases(), lambda c: F.concat(c["value"], F.lit(":"), target(c["target"]))), ", "))
        .otherwise(F.concat(F.lit("#"), F.hex("operands")))
    )
    # only instructions that target something need their program's labels
    held = named.groupBy(*by).agg(F.collect_set("offset").alias("__labels"))
    j = rows.join(named, [*by, "offset"], "left").join(held, by, "left")
    return j.select(*by, "seq", F.concat(F.coalesce(F.concat("label", F.lit(": ")), F.lit("")), F.rtrim(F.concat("mnemonic", F.lit(" "), shown))).alias("text"))


def tokenize(line: str) -> tuple[str | None, str | None, list[str]]:
    """(label, mnemonic, arguments) of a line; what follows ; is a comment."""
    pieces: list[str] = [""]
    for m in _PIECE.finditer(line):
        if m[0] == ";":
            break
        if m[0] == ",":
            pieces.append("")
        else:
            pieces[-1] += m[0]
    m = _LABEL.match(pieces[0])
    label, first = (m[1], m[2]) if m else (None, pieces[0])
    name, _, rest = first.strip().partition(" ")
    return label, name or None, [a.strip() for a in [rest, *pieces[1:]] if a.strip()]


def _size(kind: str, args: list[str]) -> int:
    if args and args[0].startswith("#"):
        return 1 + len(args[0][1:]) // 2
    if kind == "enter":
        return 5 + len(args[2][1:-1]) if len(args) > 2 else 5
    return 2 + 6 * len(args) if kind == "switch" else 1 + SIZES[kind]


def _packed(value: int, n: int, signed: bool, where: str) -> bytes:
    try:
        return value.to_bytes(n, "little", signed=signed)
    except OverflowError:
        raise ValueError(f"{where}: {value} is out of range") from None


def assemble_text(text: str, table: Table) -> bytes:
    """A listing's bytes. First all labels get their offsets, then operands are written and checked.

    An unknown mnemonic, a label defined twice or not at all, a wrong number of arguments and a number out of range are errors.
    """
    ops = {name: (op, kind) for op, (name, kind) in table.items()}
    items, labels, at = [], {}, 0
    for line in (text or "").splitlines():
        label, name, args = tokenize(line)
        if label:
            if label in labels:
                raise ValueError(f"label {label} is there twice")
            labels[label] = at
        if name:
            if name not in ops:
                raise ValueError(f"no mnemonic {name}")
            start, at = at, at + _size(ops[name][1], args)
            items.append((name, args, start, at))

    def place(arg: str, where: str) -> int:
        if arg in labels:
            return labels[arg]
        if re.match("[A-Za-z_]", arg):
            raise ValueError(f"{where}: no label {arg}")
        return number(arg, where)

    def number(arg: str, where: str) -> int:
        try:
            return int(arg, 0)
        except ValueError:
            raise ValueError(f"{where}: {arg} is no number") from None

    out = bytearray()
    for name, args, start, after in items:
        op, kind = ops[name]
        out.append(op)
        if args and args[0].startswith("#"):
            out += bytes.fromhex(args[0][1:])
            continue
        wanted = {"": 0, "native": 2, "enter": 3, "leave": 2, "switch": len(args)}.get(kind, 1)
        if len(args) != wanted:
            raise ValueError(f"{name} takes {wanted} arguments, not {len(args)}")
        if kind == "f32":
            out += struct.pack("<f", float(args[0]))
        elif kind == "native":
            out += _packed(number(args[0], name), 1, False, name) + _packed(number(args[1], name), 2, False, name)[::-1]
        elif kind == "leave":
            out += _packed(number(args[0], name), 1, False, name) + _packed(number(args[1], name), 1, False, name)
        elif kind == "enter":
            tail = args[2][1:-1].encode("latin-1")
            out += _packed(number(args[0], name), 1, False, name) + _packed(number(args[1], name), 2, False, name) + _packed(len(tail), 1, False, name) + tail
        elif kind == "switch":
            out += _packed(len(args), 1, False, name)
            for i, case in enumerate(args):
                value, _, target = case.partition(":")
                out += _packed(number(value.strip(), name), 4, False, name) + _packed(place(target.strip(), name) - (start + 2 + 6 * (i + 1)), 2, True, name)
        elif kind:
            n, signed = _NUMBERS[kind]
            value = place(args[0], name) - after if kind == "rel16" else number(args[0], name)
            out += _packed(value, n, signed, name)
    return bytes(out)


def assembled(listings: DataFrame, table: Table) -> DataFrame:
    """listings: script, version, text (a whole program). Returns script, version, code."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"script": f["script"], "version": f["version"], "code": [assemble_text(t, table) for t in f["text"]]})

    return listings.select("script", "version", "text").mapInPandas(run, "script string, version string, code binary")

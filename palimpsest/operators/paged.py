"""Decoding one program over many tasks: where instructions begin, told page by page.

Where an instruction ends follows from its own bytes alone, so each page tells, for every offset at which it may be
entered, where one leaves it: pointers over its offsets are doubled until all lead outside. Over the pages, the
offsets that are really met are found by doubling such leaps. Then each page is decoded from its first instruction, and
instructions are numbered by the pages' counts. A program of any size is so many pages' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytecode import ROW, SIZES, Table, operand_size, operand_value
from .scan import running
from .staged import staged

#: Bytes of a page, and more than the longest instruction has.
PAGE, LONGEST = 1 << 16, 2048
#: Bytes and pages of a task, about, and rows that are handed on together.
TASK_BYTES, TASK_PAGES, ROWS = 1 << 22, 512, 1 << 14


def next_offsets(code: np.ndarray, table: Table, n: int) -> np.ndarray:
    """For each of the first n offsets, where the next instruction would begin; -1 where none can begin."""
    op = code[:n].astype(np.int64)
    fixed = np.full(256, -1, np.int64)
    for o, (_, kind) in table.items():
        fixed[o] = {"enter": -2, "switch": -3}.get(kind, 1 + SIZES.get(kind, 0))
    size = fixed[op]
    padded = np.concatenate([code, np.zeros(8, np.uint8)]).astype(np.int64)
    at = np.arange(n)
    size = np.where(size == -2, 5 + padded[at + 4], np.where(size == -3, 2 + 6 * padded[at + 1], size))
    return np.where(size < 0, -1, at + size)


def leaps(code: np.ndarray, table: Table, n: int) -> np.ndarray:
    """For each offset of a page of n bytes, the first offset at or beyond n that decoding from there leads to; -1 where it fails."""
    ahead = next_offsets(code, table, n)
    while True:
        inside = (ahead >= 0) & (ahead < n)
        if not inside.any():
            return ahead
        ahead = np.where(inside, ahead[np.where(inside, ahead, 0)], ahead)


def pages(programs: DataFrame, page: int = PAGE) -> DataFrame:
    """script, version, size, page, bytes: programs cut into pages, each with what the longest instruction may reach beyond it."""
    size = F.length("code")
    cut = programs.where(size > 0).select("script", "version", "code", size.cast("long").alias("size"), F.explode(F.sequence(F.lit(0), ((size - 1) / page).cast("int"))).alias("page"))
    return cut.select("script", "version", "size", "page", F.substring(F.col("code"), F.col("page") * page + 1, F.lit(page + LONGEST)).alias("bytes"))


def dealt(df: DataFrame, tasks: int) -> DataFrame:
    """Pages over so many tasks, however few bytes they have: decoding costs time, not bytes."""
    return df.repartition(tasks, "script", "version", "page")


def instructions(programs: DataFrame, table: Table, page: int = PAGE) -> DataFrame:
    """programs: script, version, code (binary). One row per instruction, as bytecode.instructions tells, numbered from 0; an unknown or cut one is an error."""
    key = ["script", "version"]
    programs = staged(programs)
    size = F.length("code")
    many, total = programs.agg(F.sum(F.ceil(size / page)), F.sum(size)).first()
    tasks = max(1, -(-int(many or 0) // TASK_PAGES), -(-int(total or 0) // TASK_BYTES))
    held = staged(dealt(pages(programs, page), tasks))

    def entrances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(told: list[tuple[int, np.ndarray]], f: pd.DataFrame) -> pd.DataFrame:
            many = [len(ends) for _, ends in told]
            start = np.repeat(f["page"].to_numpy().astype(np.int64)[[i for i, _ in told]] * page, many)
            at, to = start + np.concatenate([np.arange(n) for n in many]), np.concatenate([ends for _, ends in told])
            which = np.repeat([i for i, _ in told], many)
            return pd.DataFrame({"script": f["script"].to_numpy()[which], "version": f["version"].to_numpy()[which], "at": at, "to": np.where(to < 0, -1, start + to)})

        for f in frames:
            told, n = [], 0
            for i, (number, data) in enumerate(zip(f["page"], f["bytes"])):
                code = np.frombuffer(bytes(data), np.uint8)
                told.append((i, leaps(code, table, min(page, len(code)))[: LONGEST if number else 1]))
                n += len(told[-1][1])
                if n >= ROWS:
                    yield rows(told, f)
                    told, n = [], 0
            if told:
                yield rows(told, f)

    jump = staged(held.mapInPandas(entrances, f"script {_kind(held, 'script')}, version {_kind(held, 'version')}, at long, to long").where("to >= 0"))
    # the offsets at which pages are entered: each round doubles how far leaps go
    met = staged(held.select(*key).distinct().withColumn("at", F.lit(0).cast("long")))
    while not jump.isEmpty():
        there = met.join(jump, [*key, "at"]).select(*key, F.col("to").alias("at"))
        met = staged(met.unionByName(there).distinct())
        second = jump.select(*key, F.col("at").alias("to"), F.col("to").alias("__to"))
        jump = staged(jump.join(second, [*key, "to"]).select(*key, "at", F.col("__to").alias("to")))

    first = met.withColumn("page", F.floor(F.col("at") / page).cast("int"))
    names = [c.split()[0] for c in ROW.split(", ")]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held_back = []
            for r in f.itertuples():
                code, base, rows = bytes(r.bytes), r.page * page, []
                at, end = r.at - base, min(page, r.size - base)
                while at < end:
                    if code[at] not in table:
                        raise ValueError(f"no instruction {code[at]:#04x} at {base + at}")
                    name, kind = table[code[at]]
                    n = operand_size(kind, code, at + 1)
                    if base + at + 1 + n > r.size:
                        raise ValueError(f"instruction at {base + at} is cut off")
                    operands = code[at + 1 : at + 1 + n]
                    rows.append((r.script, r.version, len(rows), base + at, code[at], name, kind, operands, operand_value(kind, operands, base + at + 1 + n), r.page))
                    at += 1 + n
                held_back += rows
                if len(held_back) >= ROWS:
                    yield framed(held_back)
                    held_back = []
            if held_back:
                yield framed(held_back)

    framed = lambda rows: pd.DataFrame(rows, columns=[*names, "page"]).astype({"value": "Int64"})

    # told anew where pages go, as a join would gather small ones in few tasks
    entered = dealt(held.join(first, [*key, "page"]), tasks)
    told = staged(entered.mapInPandas(decode, f"{ROW}, page int"))
    counts = running(told.groupBy(*key, "page").agg(F.count("*").alias("n")), key, [F.col("page")], sums={"upto": F.col("n")})
    return told.join(counts, [*key, "page"]).withColumn("seq", (F.col("seq") + F.col("upto") - F.col("n")).cast("int")).select(*names)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def register(spark, table: Table, name: str = "decode_program") -> None:
    """Makes SELECT ... FROM programs, LATERAL decode_program(code) known to SQL: offset, op, mnemonic, kind, operands and value of each instruction."""
    from pyspark.sql.functions import udtf

    from .bytecode import disassemble

    class Decode:
        def eval(self, code: bytes):
            yield from disassemble(bytes(code or b""), table)

    spark.udtf.register(name, udtf(Decode, returnType="offset int, op int, mnemonic string, kind string, operands binary, value bigint"))

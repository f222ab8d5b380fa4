"""One scan for any number of fixed strings, which are a table: occurrences within texts, not whole tokens alone.

A needle is told by an anchor: of its windows of eight bytes (a shorter needle is one window) that
which fewest needles share. Texts' windows are read as numbers, batch by batch, and
meet a bitmap of all anchors, whose size is bounded; what passes goes with its surroundings
to a join by the anchor, where needle and place are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staged import staged

#: Bytes of an anchor at most, bits of the number of places in the bitmap, and rows given back at once.
WIDTH, MOST_BITS, ROWS = 8, 27, 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """All windows of so many bytes as numbers."""
    n = max(0, len(data) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def _slots(keys: np.ndarray, width: int, bits: int) -> np.ndarray:
    x = (keys ^ keys >> np.uint64(29)) * _MIX + np.uint64(width) * _MIX
    return ((x ^ x >> np.uint64(32)) * _MIX) >> np.uint64(64 - bits)


def anchored(needles: DataFrame, needle: str = "needle") -> DataFrame:
    """needle, bytes, width, anchor (long) and offset: each different needle that isn't null or empty, with its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, widths, keys, offsets = [], [], [], []
            for name in batch.column(0).to_pylist():
                data = np.frombuffer(name.encode(), np.uint8)
                width = min(WIDTH, len(data))
                found = windows(data, width)
                names += [name] * len(found)
                widths += [width] * len(found)
                keys.append(found.view(np.int64))
                offsets += range(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(widths, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(offsets, pa.int32())], names=["needle", "width", "anchor", "offset"])

    own = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    each = staged(own.mapInArrow(run, "needle string, width int, anchor bigint, offset int"))
    shared = each.groupBy("width", "anchor").agg(F.count_distinct("needle").alias("n"))
    best = each.join(shared, ["width", "anchor"]).groupBy("needle").agg(F.min_by(F.struct("width", "anchor", "offset"), F.struct("n", "offset")).alias("b"))
    return best.select("needle", F.encode("needle", "UTF-8").alias("bytes"), "b.*")


def _bitmap(told: DataFrame, widths: list[int], bits: int) -> np.ndarray:
    """A bit for each anchor's slot; built by aggregation, so that no list of anchors is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, anchor = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            slot = np.zeros(len(width), np.int64)
            for w in widths:
                slot[width == w] = _slots(anchor[width == w], w, bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 15), pa.array(slot & 0x7FFF)], names=["piece", "at"])

    pieces = told.select("width", "anchor").mapInArrow(run, "piece bigint, at bigint").groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
    table = np.zeros(max(1, (1 << bits) >> 15) << 12, np.uint8)
    for piece, held in zip(pieces.column(0).to_pylist(), pieces.column(1).to_pylist()):
        table[piece << 12 : piece + 1 << 12] = np.frombuffer(held, np.uint8)
    return table


def occurrences(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str = "needle") -> DataFrame:
    """key, needle and at: every place, in bytes from 0, where a needle stands in a row's text, overlapping ones too.

    Null and empty texts and needles have none; equal needles count once.
    """
    told = staged(anchored(needles, needle))
    size = told.agg(F.count("*").alias("n"), F.max(F.length("bytes")).alias("longest"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    kind = texts.schema[key].dataType
    if not size["n"]:
        return texts.select(F.col(key), F.lit("").alias("needle"), F.lit(0).cast("long").alias("at")).where("false")
    bits, longest, widths = min(MOST_BITS, max(16, size["n"].bit_length() + 6)), size["longest"], size["widths"]
    held = texts.sparkSession.sparkContext.broadcast(_bitmap(told, widths, bits))
    schema = pa.schema([("key", _arrow(texts, key)), ("width", pa.int32()), ("anchor", pa.int64()), ("place", pa.int64()), ("lo", pa.int64()), ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(1).cast(pa.large_binary())):
                raw = value.as_py()
                if not raw:
                    continue
                data, name = np.frombuffer(raw, np.uint8), batch.column(0)[i]
                for w in widths:
                    found = windows(data, w)
                    slot = _slots(found, w, bits).astype(np.int64)
                    hit = np.flatnonzero(held.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    for p, a in zip(hit.tolist(), found[hit].view(np.int64).tolist()):
                        lo = max(0, p - longest + w)
                        rows.append((name, w, a, p, lo, raw[lo : p + longest]))
                        if len(rows) >= ROWS:
                            yield _out(rows, schema)
                            rows = []
            yield _out(rows, schema)

    passed = texts.select(key, text).mapInArrow(run, f"key {kind.simpleString()}, width int, anchor bigint, place bigint, lo bigint, around binary")
    met = passed.join(told, ["width", "anchor"]).withColumn("at", F.col("place") - F.col("offset"))
    inside = (F.col("at") >= F.col("lo")) & (F.substring(F.col("around"), (F.col("at") - F.col("lo") + 1).cast("int"), F.length("bytes")) == F.col("bytes"))
    return met.where(inside).select(F.col("key").alias(key), "needle", "at")


def _arrow(df: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[key].dataType)


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    keys = pa.array([x.as_py() for x in columns[0]], schema.field(0).type)
    return pa.RecordBatch.from_arrays([keys, *(pa.array(list(c), f.type) for c, f in zip(columns[1:], list(schema)[1:]))], schema=schema)


def counted(found: DataFrame, key: str) -> DataFrame:
    """key, needle, n and first: how often and where first."""
    return found.groupBy(key, "needle").agg(F.count("*").alias("n"), F.min("at").alias("first"))

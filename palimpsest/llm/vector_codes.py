"""Compression of vectors to short codes: per part of a vector, the index of the nearest entry of a codebook.

Vectors become integers and lie as columnar blocks in the shared folder: per block the
keys, the labels and, for each part, a matrix with a row per dimension. A round of
learning sends the codebooks to all blocks; there distances accumulate dimension by
dimension, np.add.at sums the members of each entry as 64-bit integers, and the tensors of
sums and counts merge in a tree. All arithmetic is on integers, so neither the order
of merging nor a task that runs again changes a result. What the driver
holds are codebooks and one tensor of their size, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by_hot_key, small_batches, stored

SCALE = 1024
#: Vectors of a block, vectors whose distances to all entries are held at once, and tensors that one task merges.
BLOCK, AT_ONCE, FAN_IN = 8192, 1024, 32


def boundaries(dimension: int, parts: int) -> list[int]:
    """Where parts begin and end: equal, or as equal as the dimension allows."""
    return [dimension * i // parts for i in range(parts + 1)]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components alone."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~odd)


def quantised(flat: np.ndarray, dimension: int) -> np.ndarray:
    """Components as integers floor(1024 * x); such beyond what 64-bit distances can hold are refused."""
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    most = math.isqrt((1 << 63) // (4 * max(1, dimension))) - 1
    if len(scaled) and np.abs(scaled).max() > most:
        raise ValueError(f"components beyond {most / SCALE:.0f} give distances that 64 bits can't hold")
    return scaled.astype(np.int64)


def blocks(df: DataFrame, key: str, vector: str, label: str, dimension: int, parts: int) -> DataFrame:
    """ids, labels (arrays) and parts (an array of matrices' bytes, dimension by dimension) for each block of vectors of this dimension."""
    small_batches(df.sparkSession)
    cuts = boundaries(dimension, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                some = batch.slice(k, BLOCK)
                flat = quantised(pc.list_flatten(some.column(2)).to_numpy(zero_copy_only=False), dimension)
                columns = np.ascontiguousarray(flat.reshape(some.num_rows, dimension).T)
                held = [columns[lo:hi].astype("<i8").tobytes() for lo, hi in zip(cuts, cuts[1:])]
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([held], pa.list_(pa.binary()))], names=["ids", "labels", "parts"])

    kinds = [df.schema[c].dataType.simpleString() for c in (key, label)]
    rows = df.where(F.size(vector) == dimension).select(F.col(key), F.col(label), F.col(vector))
    return rows.mapInArrow(run, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, parts array<binary>")


def first_entries(df: DataFrame, key: str, vector: str, dimension: int, entries: int) -> np.ndarray:
    """The integer vectors of the first rows by key (null last), ties by components: entries x dimension."""
    rows = df.where(F.size(vector) == dimension).select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    return quantised(np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dimension).ravel(), dimension).reshape(len(rows), dimension)


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector of a part (columns: dimension x vectors) the nearest entry of book (entries x dimension), the first of those, and the squared distance."""
    width, n = columns.shape
    codes, errors = np.empty(n, np.int64), np.empty(n, np.int64)
    # integers of 32 bits are faster, where distances fit
    span = int(max(np.abs(columns).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * span * span * max(1, width) < 1 << 31 else np.int64
    columns, book = columns.astype(kind), book.astype(kind)
    for k in range(0, n, AT_ONCE):
        some = columns[:, k : k + AT_ONCE]
        distance = np.zeros((some.shape[1], len(book)), kind)
        for d in range(width):
            apart = some[d][:, None] - book[:, d][None, :]
            distance += apart * apart
        best = distance.argmin(axis=1)
        codes[k : k + AT_ONCE] = best
        errors[k : k + AT_ONCE] = distance[np.arange(len(best)), best]
    return codes, errors


def _matrices(row_parts, cuts: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(p, "<i8").reshape(hi - lo, -1) if hi > lo else None for p, lo, hi in zip(row_parts, cuts, cuts[1:])]


def refined(held: RDD, books: list[np.ndarray], cuts: list[int]) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, and entries become the floor of their members' means; unused ones stay."""
    told = held.context.broadcast(books)
    entries = len(books[0])

    def nothing() -> tuple[list[np.ndarray], np.ndarray]:
        return [np.zeros((b.shape[1], entries), np.int64) for b in books], np.zeros((len(books), entries), np.int64)

    def add(total, row_parts):
        sums, counts = total = total or nothing()
        for p, columns in enumerate(_matrices(row_parts, cuts)):
            if columns is None:
                continue
            codes, _ = nearest(columns, told.value[p])
            for d in range(len(columns)):
                np.add.at(sums[p][d], codes, columns[d])
            np.add.at(counts[p], codes, 1)
        return total

    def merge(a, b):
        if not a or not b:
            return a or b
        for x, y in zip(a[0], b[0]):
            x += y
        a[1][:] += b[1]
        return a

    depth = max(2, math.ceil(math.log(max(2, held.getNumPartitions()), FAN_IN)))
    sums, counts = held.treeAggregate(None, add, merge, depth) or nothing()
    told.unpersist()
    return [np.where(c[:, None] > 0, s.T // np.maximum(c, 1)[:, None], book) for s, c, book in zip(sums, counts, books)]


class Codebooks:
    """What codes stand for: books[p] is entries x width of part p, in integers."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()

    def decode(self, codes: DataFrame, code: str = "code", into: str = "vector") -> DataFrame:
        """codes with the vectors that they stand for, an array of doubles, in a column that replaces one of that name; a null code gives null."""
        told = codes.sparkSession.sparkContext.broadcast(self.books)
        kept = codes.drop(into)
        at = kept.columns.index(code)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spelled = batch.column(at).to_pylist()
                index = np.frombuffer(bytes.fromhex("".join(c for c in spelled if c is not None)), np.uint8).reshape(-1, len(told.value))
                found = iter(np.concatenate([b[index[:, p]] for p, b in enumerate(told.value)], axis=1) / SCALE)
                vectors = pa.array([None if c is None else next(found) for c in spelled], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, into])

        fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        return kept.mapInArrow(run, f"{fields}, `{into}` array<double>")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks]:
    """A DataFrame with key, label, code, error (long) for each usable vector, and the codebooks, learnt from all of them.

    Vectors that are null or hold null or non-finite components go. The dimension is
    the one that most vectors have, the least of several; vectors of another one stay with
    a null code and error. A codebook starts with the parts of the first rows by key, null
    keys last, rows of one key by their components; with fewer rows than entries it is
    smaller. Repeated rows count as often as they occur, labels may be null, other
    columns play no part whatever their names, and a table without usable vectors gives no
    rows and empty codebooks. Components of vectors beyond the range that 64-bit distances
    allow (about 185,000 for 64 dimensions) are an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so a codebook has 1 to 256 entries")
    spark = df.sparkSession
    rows = usable(df.select(key, label, vector), vector)
    usual = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dimension = usual[0]["d"] if usual else 0
    cuts = boundaries(dimension, parts)
    kept = stored(blocks(rows, key, vector, label, dimension, parts), "vector-blocks")
    start = first_entries(rows, key, vector, dimension, entries)
    books = [start[:, lo:hi] for lo, hi in zip(cuts, cuts[1:])]
    held = kept.select("parts").rdd.map(lambda r: r["parts"])
    for _ in range(rounds if usual else 0):
        books = refined(held, books, cuts)

    told = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                digits, errors = np.full((len(ids), parts), 0, np.uint8), np.zeros(len(ids), np.int64)
                for p, columns in enumerate(_matrices(batch.column(2)[i].as_py(), cuts)):
                    if columns is not None:
                        codes, apart = nearest(columns, told.value[p])
                        digits[:, p] = codes
                        errors += apart
                spelled = digits.tobytes().hex()
                codes = [spelled[k : k + 2 * parts] for k in range(0, len(spelled), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(errors)], names=["id", "label", "code", "error"])

    kinds = [df.schema[c].dataType.simpleString() for c in (key, label)]
    coded = kept.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code string, error bigint")
    others = rows.where(F.size(vector) != dimension).select(F.col(key).alias("id"), F.col(label).alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    out = stored(coded.unionByName(others), "vector-codes")
    discard(kept)
    return out.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error"), Codebooks(books)


def with_label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes with label_error (long), the errors' sum over equal labels, null being one of them."""
    named = codes.withColumn("__label", F.when(F.col(label).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(label).cast("string"))))
    sums = named.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return joined_by_hot_key(named, sums, "__label", "n").drop("__label", "n")

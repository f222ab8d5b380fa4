"""A stored index of which file holds which three characters in a row, which prunes files for any substring or expression.

An expression is translated into alternatives, each a set of trigrams that a line must hold for it to match. A file
stays if it has all of some alternative's; an expression that asks for no trigram prunes nothing. Files are never dismissed wrongly, and those that stay are searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alternatives of an expression beyond which it prunes nothing.
MOST = 64


def _of(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _joined(left: list[frozenset[str]], right: list[frozenset[str]]) -> list[frozenset[str]]:
    every = {a | b for a, b in product(left, right)}
    return list(every) if len(every) <= MOST else [frozenset()]


def _sequence(parsed) -> list[frozenset[str]]:
    """The alternatives of a sequence of parsed parts; characters that follow one another make trigrams together."""
    out, run = [frozenset()], ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name == "SUBPATTERN" and not value[1] and not value[2] and all(str(o) == "LITERAL" for o, _ in value[3]):
            run += "".join(chr(v) for _, v in value[3])
            continue
        inner = [frozenset()]
        if name == "BRANCH":
            inner = [c for part in value[1] for c in _sequence(part)]
        elif name == "SUBPATTERN" and not value[1] and not value[2]:
            inner = _sequence(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _sequence(value[2])
        elif name == "ATOMIC_GROUP":
            inner = _sequence(value)
        # what stands between parts its neighbours, but for places such as line ends, which have no characters
        out = _joined(out, [_of(run)])
        run = ""
        out = _joined(out, inner)
    return _joined(out, [_of(run)])


def alternatives(pattern: str, literal: bool = False) -> list[frozenset[str]]:
    """Sets of trigrams of which a matching line holds one whole; an empty set says nothing. Flags within a pattern say nothing either."""
    if literal:
        return [_of(pattern)]
    parsed = re._parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return [frozenset()]
    found = _sequence(parsed)
    return [frozenset()] if frozenset() in found else found


def code(trigram: str) -> int:
    """Three characters as one number."""
    x, y, z = map(ord, trigram)
    return x << 42 | y << 21 | z


#: Characters of lines whose trigrams are told at once, about.
CHARACTERS = 1 << 20


def _of_files(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """version, file and trigram of lines (version, file, line); of lines that follow one another in a file, each trigram once."""
    lines = [x or "" for x in batch.column(2).to_pylist()]
    lengths = np.array([len(x) for x in lines], np.int64)
    same = lambda c: pc.equal(c.slice(1), c.slice(0, len(c) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
    begins = np.concatenate([[True], ~(same(batch.column(0)) & same(batch.column(1)))])
    pieces = (np.cumsum(lengths) - lengths) // CHARACTERS
    for lo, hi in zip(*(np.searchsorted(pieces, np.unique(pieces), side) for side in ("left", "right"))):
        c = np.frombuffer("".join(lines[lo:hi]).encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(c) < 3:
            continue
        row = np.repeat(np.arange(lo, hi), lengths[lo:hi])
        inside = row[:-2] == row[2:]
        # what stands on one line, by the runs of lines of one file
        found, run = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inside], np.cumsum(begins)[row[:-2]][inside]
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        held = [np.unique(x) for x in np.split(found, starts[1:])] if len(found) else []
        at = pa.array(np.repeat(row[:-2][inside][starts], [len(h) for h in held]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([*held, np.zeros(0, np.int64)]))], names=["version", "file", "trigram"])


def build(lines: DataFrame, path: str) -> None:
    """The index of lines (version, file, line): version, file, trigram (see code). Each part of it is in the order of trigrams, so that a look-up reads few pages."""
    rows = lines.select("version", "file", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from _of_files(batch)

    kinds = [rows.schema[c].dataType.simpleString() for c in ("version", "file")]
    found = rows.mapInArrow(run, f"version {kinds[0]}, file {kinds[1]}, trigram long").distinct()
    found.sortWithinPartitions("trigram").write.mode("overwrite").parquet(path)


def files(spark: SparkSession, path: str, patterns: dict[str, tuple[str, bool]], every: DataFrame) -> DataFrame:
    """name, version and file: which of every (version, file) may hold what each named pattern (expression or literal) asks for."""
    asked = [(name, i, code(t)) for name, (p, literal) in patterns.items() for i, c in enumerate(alternatives(p, literal)) for t in c]
    sizes = [(name, i, len(c)) for name, (p, literal) in patterns.items() for i, c in enumerate(alternatives(p, literal)) if c]
    free = [name for name, (p, literal) in patterns.items() if frozenset() in alternatives(p, literal)]
    # patterns are configuration, so are their trigrams: they go to the scan as a filter
    index = spark.read.parquet(path).where(F.col("trigram").isin(sorted({t for *_, t in asked})))
    wanted = spark.createDataFrame(asked, "name string, alternative int, trigram long")
    needed = spark.createDataFrame(sizes, "name string, alternative int, needed long")
    found = index.join(wanted, "trigram").groupBy("version", "file", "name", "alternative").agg(F.count("*").alias("n"))
    held = found.join(needed, ["name", "alternative"]).where("n = needed").select("name", "version", "file").distinct()
    whole = every.select("version", "file").distinct()
    for name in free:
        held = held.unionByName(whole.select(F.lit(name).alias("name"), "version", "file"))
    return held


def search(lines: DataFrame, path: str, patterns: dict[str, tuple[str, bool]]) -> DataFrame:
    """name and the lines (version, file, line_no, line) that match each named pattern; lines of files that can't match aren't looked at."""
    spark = lines.sparkSession
    may = files(spark, path, patterns, lines)
    match = F.lit(False)
    for name, (p, literal) in patterns.items():
        match = match | ((F.col("name") == name) & (F.contains("line", F.lit(p)) if literal else F.col("line").rlike(p)))
    return lines.join(may, ["version", "file"]).where(match).select("name", "version", "file", "line_no", "line")

"""A modified Kneser-Ney model of order four over unfolded characters, whose tables grow with the corpus.

Spark counts the n-grams of every order exactly, by their code points; a distinct text
counts once. Per n-gram one row holds its count and, as a context, what follows it.
The rows lie in a table by hash (see lookup), which all languages share; scoring looks
n-grams up there and holds a fixed number of results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, run_dir, stored
from .lookup import KEEPERS, Table, table, write_table

ORDER, BITS = 4, 21
LOW = (1 << BITS) - 1
#: What stands before a text's first character.
PAD = "\n" * (ORDER - 1)
#: Characters or bytes of text worked on at once, and log2 of the results held by a worker.
SLICE, RESULTS_BITS = 1 << 21, 20
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, ORDER + 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of a row: the n-gram's count; as a context, the sum of its followers' counts and how many have 1, 2, more. In a row of discounts: n-grams of counts 1 to 4.
VALUES = ["c", "t", "n1", "n2", "n3"]


def seed(lang: str | None) -> int:
    """A language's number; null is a language of the empty name."""
    return int.from_bytes(hashlib.md5((lang or "").encode()).digest()[:8], "little")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _key(language: np.ndarray, kind: int, chars: list[np.ndarray]) -> np.ndarray:
    x = language + _FACTORS[ORDER + kind]
    for c, f in zip(chars, _FACTORS):
        x = x + c.astype(np.uint64) * f
    return _mixed(x)


def slices(texts: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of about SLICE characters: which texts, their code points with PAD before each, where each begins (its PAD), and which places are a text's own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + len(PAD)
        if held >= SLICE or i == len(texts) - 1:
            own = texts[start : i + 1]
            points = np.frombuffer((PAD + PAD.join(own)).encode("utf-32-le", "surrogatepass"), "<u4")
            at = np.cumsum([0] + [len(t) + len(PAD) for t in own[:-1]])
            real = np.ones(len(points), bool)
            for k in range(len(PAD)):
                real[at + k] = False
            yield slice(start, i + 1), points, at, real
            start, held = i + 1, 0


def parts_of(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Where the slices of about most bytes begin, and their rows: what is made of a part is all that is held at once."""
    at = 0
    for part in byte_slices(texts, most):
        yield at, len(part)
        at += len(part)


def counted(points: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams that end at real places: the first two and the last two code points, packed, and counts."""
    alphabet = np.flatnonzero(np.bincount(points))
    if len(alphabet) > 1 << 16:
        half = len(points) // 2
        parts = [counted(points[:half], real[:half]), counted(points[half - len(PAD) :], np.concatenate([np.zeros(len(PAD), bool), real[half:]]))]
        return tuple(np.concatenate(x) for x in zip(*parts))
    code = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    code[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    c = code[points]
    n = len(points) - len(PAD)
    key = c[:n]
    for k in range(1, ORDER):
        key = key << np.uint64(16) | c[k : k + n]
    key = np.sort(key[real[len(PAD) :]])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    found = key[first]
    chars = [alphabet[(found >> np.uint64(16 * (ORDER - 1 - k)) & np.uint64(0xFFFF)).astype(np.int64)] for k in range(ORDER)]
    return chars[0] << BITS | chars[1], chars[2] << BITS | chars[3], np.diff(np.append(first, len(key)))


def fit(df: DataFrame, text: str, lang: str, same, repeated: str) -> str:
    """Count the n-grams of every distinct text by language and write the model's table; returns its folder.

    repeated: a table of how many rows have the same text, by the column same, where
    more than one has; each of c such rows counts 1/c. Null and empty texts count nothing.
    """
    folder = run_dir(df.sparkSession, "perplexity")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(at, n) for batch in batches for at, n in parts_of(batch.column(1), SLICE)):
            copies = np.maximum(table(repeated).find(batch.column(2).to_numpy().view(np.uint64))[0], 1)
            groups: dict[tuple, list[str]] = {}
            for name, t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), copies.tolist()):
                if t:
                    groups.setdefault((name, n), []).append(t)
            for (name, n), texts in groups.items():
                for _, points, _, real in slices(texts):
                    a, b, m = counted(points, real)
                    l = np.full(len(a), np.uint64(seed(name))).view(np.int64)
                    for k in range(0, len(a), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (l, a, b, m / n)], names=["l", "a", "b", "n"])

    parts = df.select(F.col(lang).cast("string"), F.col(text), same).mapInArrow(count, "l bigint, a bigint, b bigint, n double")
    counts = stored(parts.groupBy("l", "a", "b").agg(F.round(F.sum("n")).cast("bigint").alias("n")), "n-grams")
    rows, written = None, [counts]
    for k in range(ORDER, 0, -1):
        more = counts.selectExpr(
            "l",
            f"""inline(array(
            struct({k} AS k, a, b, n AS c, 0L AS t, 0L AS n1, 0L AS n2, 0L AS n3),
            struct({k - 1} AS k, shiftright(a, {BITS}) AS a, shiftleft(a & {LOW}L, {BITS}) | shiftright(b, {BITS}) AS b, 0L AS c, n AS t, bigint(n = 1) AS n1, bigint(n = 2) AS n2, bigint(n > 2) AS n3),
            struct({10 + k} AS k, 0L AS a, 0L AS b, bigint(n = 1) AS c, bigint(n = 2) AS t, bigint(n = 3) AS n1, bigint(n = 4) AS n2, 0L AS n3)))""",
        )
        rows = rows.unionByName(more) if rows else more
        if k > 1:
            shorter = counts.selectExpr("l", f"a & {LOW if k == 4 else 0}L AS a", f"b & {LOW if k == 2 else -1}L AS b")
            counts = stored(shorter.groupBy("l", "a", "b").agg(F.count("*").alias("n")), "n-grams")
            written.append(counts)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l, k, a, b = (batch.column(i).to_numpy() for i in range(4))
            h = np.zeros(len(l), np.uint64)
            chars = [a >> BITS, a & LOW, b >> BITS, b & LOW]
            for kind in np.unique(k).tolist():
                at = k == kind
                h[at] = _key(l.view(np.uint64)[at], kind, [c[at] for c in chars[ORDER - kind :]] if 0 < kind <= ORDER else [])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *batch.columns[4:]], names=["h", *VALUES])

    summed = rows.groupBy("l", "k", "a", "b").agg(*(F.sum(c).alias(c) for c in VALUES))
    entries = stored(summed.mapInArrow(keyed, "h bigint, " + ", ".join(f"{c} bigint" for c in VALUES)), "n-gram-rows")
    for x in written:
        discard(x)
    write_table(entries, folder, entries.count())
    discard(entries)
    return folder


class Scorer:
    """Scores texts by a model's table; results of 2 ** RESULTS_BITS n-grams are held."""

    def __init__(self, rows: Table):
        self.rows = rows
        self.keys = np.zeros(1 << RESULTS_BITS, np.uint64)
        self.results = np.zeros(1 << RESULTS_BITS, np.float32)
        self.discounts: dict[int, list[np.ndarray]] = {}

    def _discounts(self, language: np.ndarray) -> list[np.ndarray]:
        of = int(language[0])
        if of not in self.discounts:
            if len(self.discounts) > 1000:
                self.discounts.clear()
            found = []
            for k in range(1, ORDER + 1):
                n = self.rows.find(_key(language, 10 + k, []))[:4, 0].astype(np.float64)
                y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
                found.append(np.array([0.0] + [min(max(j - (j + 1) * y * (n[j] / n[j - 1] if n[j - 1] else 0.5), 0.1), j - 0.1) for j in (1, 2, 3)]))
            self.discounts[of] = found
        return self.discounts[of]

    def probabilities(self, language: np.ndarray, chars: list[np.ndarray]) -> np.ndarray:
        """Of the last of four characters after the others; a language's unseen characters count as one."""
        below: np.ndarray | float = 1.0 / (1.0 + float(self.rows.find(_key(language, 0, []))[2:, 0].sum()))
        for k, d in enumerate(self._discounts(language), 1):
            c = self.rows.find(_key(language, k, chars[ORDER - k :]))[0].astype(np.float64)
            t, *n = self.rows.find(np.broadcast_to(_key(language, k - 1, chars[ORDER - k : -1]), c.shape))[1:].astype(np.float64)
            some = np.maximum(t, 1)
            p = (c - d[np.minimum(c, 3).astype(np.int64)]) / some + (d[1] * n[0] + d[2] * n[1] + d[3] * n[2]) / some * below
            below = np.where(t > 0, p, below)
        return below

    def log_probabilities(self, lang: str | None, points: np.ndarray) -> np.ndarray:
        """Of each code point from the fourth on."""
        language = np.array([seed(lang)], np.uint64)
        n = len(points) - len(PAD)
        chars = [points[k : k + n] for k in range(ORDER)]
        h = np.full(n, language[0])
        for c, f in zip(chars, _FACTORS):
            h += c * f
        at = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - RESULTS_BITS)).astype(np.int64)
        out = self.results[at]
        miss = np.flatnonzero(self.keys[at] != h)
        if len(miss):
            new, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            found = np.log(np.maximum(self.probabilities(language, [c[miss[first]] for c in chars]), 1e-12)).astype(np.float32)
            out[miss] = found[inverse]
            self.keys[at[miss[first]]], self.results[at[miss[first]]] = new, found
        return out

    def surprises(self, names: list[str | None], texts: list[str | None], counts_as_word: np.ndarray) -> tuple[list[float | None], list[int]]:
        """Per text the log perplexity of a word character (what other characters cost is shared among them) and the number of word characters."""
        x: list[float | None] = [None] * len(texts)
        n = [0] * len(texts)
        groups: dict[str | None, list[int]] = {}
        for i, (name, t) in enumerate(zip(names, texts)):
            if t:
                groups.setdefault(name, []).append(i)
        for name, rows in groups.items():
            for part, points, at, real in slices([texts[i] for i in rows]):
                log_p = np.zeros(len(points))
                log_p[len(PAD) :] = self.log_probabilities(name, points)
                words = np.maximum(np.add.reduceat((counts_as_word[points] & real).astype(np.int64), at), 1)
                total = np.add.reduceat(np.where(real, log_p, 0.0), at)
                for i, m, s in zip(rows[part], words.tolist(), (-total / words).tolist()):
                    x[i], n[i] = s, m
        return x, n


_SCORERS: dict[str, Scorer] = {}
KEEPERS.append(_SCORERS)


def scorer(folder: str) -> Scorer:
    """The worker's scorer of a folder."""
    if folder not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[folder] = Scorer(table(folder))
    return _SCORERS[folder]

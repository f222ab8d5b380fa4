"""Quality rules: counts of words, symbols and repeats, and a perplexity band per language.

The rules' language model is that of ngrams, over unfolded characters. Bands lie around
each language's median log perplexity, their width from its spread over all distinct texts.

The model of this module is for telling languages alone (see language): a modified
Kneser-Ney model of order four over a folded alphabet of 32 character classes, at most
32 ** 4 n-grams a language. It is stored as arrays sorted by the n-grams' hashes, in one
file per language in the shared folder; a worker reads the files of the languages it meets.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import discard, hold, joined_by_hot_key, run_dir, stored
from .lookup import write_table
from .ngrams import SLICE, parts_of, scorer
from .token_store import _put

A, ORDER = 32, 4
SIZE = A**ORDER
#: Fixed values of the rules: characters that count as symbols, the fewest words, the window's words, the largest share of repeated words in percent.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: The least spreads of a language, so that near copies or few texts don't make a band of no width: of a long text's log perplexity, and of its deviation times the root of its length.
MIN_SPREAD, MIN_ROOT_SPREAD = 0.025, 1.0
_OTHER, _UPPER, _DIGIT, _MARK, _SYMBOL = 31, 27, 28, 29, 30
_MARKS = ".,;:!?'\"()-–—…¿¡«»’“”"


def _classes() -> np.ndarray:
    out = np.full(1 << 16, _OTHER, np.int32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            out[i] = 0
        elif "a" <= c <= "z":
            out[i] = 1 + i - ord("a")
        elif c.isupper():
            out[i] = _UPPER
        elif c.isnumeric():
            out[i] = _DIGIT
        elif c in _MARKS:
            out[i] = _MARK
        elif not c.isalnum():
            out[i] = _SYMBOL
    return out


_CLASS: np.ndarray | None = None


def grams(text: str) -> np.ndarray:
    """The packed n-gram that ends at each character; white space stands before the first."""
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.zeros(len(points) + ORDER - 1, np.int32)
    c[ORDER - 1 :] = _CLASS[np.minimum(points, 0xFFFF)]
    out = c[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        out += c[ORDER - 1 - k : len(c) - k] << 5 * k
    return out


# ---- the model -----------------------------------------------------------------------


def _hash(order: int, keys: np.ndarray) -> np.ndarray:
    """A one-to-one mix of order and packed n-gram: distinct n-grams never meet."""
    x = (keys.astype(np.uint32) | np.uint32(order << 5 * ORDER)) * np.uint32(0x9E3779B1)
    return x ^ x >> np.uint32(16)


def kneser_ney(counts: np.ndarray) -> dict[str, np.ndarray]:
    """From dense counts of the highest order: hashes (sorted), log p of each seen n-gram and its back-off as a context."""
    tables = [counts.reshape((A,) * ORDER).astype(np.float64)]
    while tables[-1].ndim > 1:
        tables.append((tables[-1] > 0).sum(axis=0).astype(np.float64))
    below = np.full(A, 1.0 / A)
    probabilities, backoffs = {}, {}
    for table in reversed(tables):
        n = [float((table == k).sum()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
        d = [min(max(k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 0.5), 0.0), k - 0.1) for k in (1, 2, 3)]
        cut = np.select([table == 0, table == 1, table == 2], [0.0, d[0], d[1]], d[2])
        total = table.sum(axis=-1, keepdims=True)
        some = np.maximum(total, 1)
        gamma = np.where(total > 0, cut.sum(axis=-1, keepdims=True) / some, 1.0)
        p = (table - cut) / some + gamma * below
        probabilities[table.ndim], backoffs[table.ndim] = p, gamma[..., 0]
        below = np.broadcast_to(p, (A,) * (table.ndim + 1)) if table.ndim < ORDER else p
    hashes, log_p, log_backoff = [], [], []
    for table in tables:
        order = table.ndim
        as_context = backoffs[order + 1].ravel() if order < ORDER else None
        seen = np.flatnonzero((table.ravel() > 0) | (as_context < 1) if as_context is not None else table.ravel() > 0)
        hashes.append(_hash(order, seen))
        log_p.append(np.log(probabilities[order].ravel()[seen]))
        log_backoff.append(np.log(np.maximum(as_context[seen], 1e-12)) if as_context is not None else np.zeros(len(seen)))
    h = np.concatenate(hashes)
    by = np.argsort(h)
    empty = np.log(np.maximum(backoffs[1], 1e-12)) - np.log(A)
    return {"hash": h[by], "log_p": np.concatenate(log_p)[by].astype(np.float32), "log_backoff": np.concatenate(log_backoff)[by].astype(np.float32), "unknown": np.array([empty], np.float32)}


def packed(model: dict[str, np.ndarray]) -> bytes:
    return np.array([len(model["hash"])], "<u4").tobytes() + b"".join(model[k].tobytes() for k in ("unknown", "hash", "log_p", "log_backoff"))


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return {"unknown": np.frombuffer(data, "<f4", 1, 4), "hash": np.frombuffer(data, "<u4", n, 8), "log_p": np.frombuffer(data, "<f4", n, 8 + 4 * n), "log_backoff": np.frombuffer(data, "<f4", n, 8 + 8 * n)}


def log_probabilities(model: dict[str, np.ndarray]) -> np.ndarray:
    """log p of every packed n-gram of the highest order, by look-ups in the sorted arrays, backing off where one isn't there."""

    def find(order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _hash(order, keys)
        at = np.minimum(np.searchsorted(model["hash"], h), len(model["hash"]) - 1)
        return at, model["hash"][at] == h

    out = np.full(A, model["unknown"][0], np.float32)
    for order in range(1, ORDER + 1):
        keys = np.arange(A**order)
        at, there = find(order, keys)
        back = np.tile(out, A) if order > 1 else out
        if order > 1:
            # the context is all but the last class; the shorter n-gram all but the first
            context_at, known = find(order - 1, np.arange(A ** (order - 1)))
            back = back + np.repeat(np.where(known, model["log_backoff"][context_at], 0.0), A)
        out = np.where(there, model["log_p"][at], back).astype(np.float32)
    return out


def _name(lang: str | None) -> str:
    return hashlib.md5((lang or "").encode()).hexdigest()


def _same(text: str, lang: str) -> Column:
    """The hash by which rows are copies of one text of a language."""
    return F.xxhash64(F.coalesce(F.col(lang).cast("string"), F.lit("")), F.col(text))


def copies(df: DataFrame, text: str = "text", lang: str = "lang") -> str:
    """A table (see lookup) of how many rows have each text of a language that more than one has; returns the folder."""
    folder = run_dir(df.sparkSession, "copies")
    many = stored(df.where(F.col(text) != "").select(_same(text, lang).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "copy-counts")
    write_table(many, folder, many.count())
    discard(many)
    return folder


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> str:
    """Count the n-grams of every text by language and write a model per language; returns the folder.

    Null and empty texts count nothing; a null language is a language of its own.
    """
    folder = run_dir(df.sparkSession, "perplexity")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, n in held.items():
                at = np.flatnonzero(n)
                for k in range(0, len(at), 100_000):
                    part = at[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part, pa.int32()), pa.array(n[part], pa.int64())], names=["l", "g", "n"])
            held.clear()

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    g = grams(t)
                    into = held.setdefault(name, np.zeros(SIZE, np.int64))
                    if len(g) > SIZE // 8:
                        into += np.bincount(g, minlength=SIZE)
                    else:
                        np.add.at(into, g, 1)
                if len(held) > 12:
                    yield from flush()
        yield from flush()

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(SIZE, np.int64)
        counts[frame["g"]] = frame["n"]
        name = frame["l"].iloc[0]
        _put(f"{folder}/{name}.model", packed(kneser_ney(counts)))
        return pd.DataFrame({"l": [name], "n": [len(frame)]})

    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    parts = df.select(F.md5(F.coalesce(F.col(lang).cast("string"), F.lit(""))).alias("l"), F.col(text).alias("t")).mapInArrow(count, "l string, g int, n bigint")
    counts = parts.groupBy("l", "g").agg(F.sum("n").alias("n"))
    counts.groupBy("l").applyInPandas(build, "l string, n bigint").write.parquet(f"{folder}/languages")
    return folder


class Models:
    """The models of a folder, the last max_models used."""

    def __init__(self, folder: str, max_models: int = 24):
        self.fs, self.at = pyarrow.fs.FileSystem.from_uri(folder)
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()
        self.max_models = max_models

    def get(self, name: str) -> np.ndarray:
        if name not in self.held:
            if len(self.held) >= self.max_models:
                self.held.popitem(last=False)
            with self.fs.open_input_file(f"{self.at}/{name}.model") as f:
                self.held[name] = log_probabilities(unpacked(f.read()))
        self.held.move_to_end(name)
        return self.held[name]


_MODELS: dict[str, Models] = {}


def _models(folder: str) -> Models:
    hold("language", _MODELS.clear)
    if folder not in _MODELS:
        _MODELS.clear()
        _MODELS[folder] = Models(folder)
    return _MODELS[folder]


def _word_characters() -> np.ndarray:
    """By code point, whether it counts as part of a word."""
    global _WORD
    if _WORD is None:
        c = _classes()
        _WORD = np.ones(0x110000, bool)
        _WORD[: len(c)] = (c > 0) & (c < _MARK) | (c == _OTHER)
    return _WORD


_WORD: np.ndarray | None = None


# ---- the rules -----------------------------------------------------------------------


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key = w[:n]
    for k in range(1, window):
        if int(key.max()) >= 2**62 // len(ids):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + w[k : k + n]
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    twice = np.zeros(n, bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; all 0 without one."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at blank, tab, line feed, vertical tab, form feed, carriage return
    blanks = len(text) - len(text.translate(_DROP_BLANKS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


_DROP_BLANKS = dict.fromkeys(map(ord, " \t\n\v\f\r"))


# ---- the operator --------------------------------------------------------------------


def bands(df: DataFrame, folder: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per language: middle, the median log perplexity of its distinct texts, and two spreads.

    spread is the scaled median deviation from the middle; root_spread that of the
    deviation times the root of the length, as short texts scatter more. Both have a
    least value. Copies of a text count once, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(at, n) for batch in batches for at, n in parts_of(batch.column(1), SLICE)):
            names = batch.column(0).to_pylist()
            x, n = scorer(folder).surprises(names, batch.column(1).to_pylist(), _word_characters())
            yield pa.RecordBatch.from_arrays([pa.array([_name(name) for name in names], pa.string()), batch.column(2), pa.array(x, pa.float64()), pa.array(n, pa.int64())], names=["l", "h", "x", "n"])

    scored = df.select(F.col(lang).cast("string"), F.col(text), _same(text, lang)).mapInArrow(run, "l string, h bigint, x double, n bigint").where("x is not null")
    seen = stored(scored.groupBy("l", "h").agg(F.min("x").alias("x"), F.min("n").alias("n")).drop("h"), "surprise")
    accuracy = 10_000
    middle = seen.groupBy("l").agg(F.percentile_approx("x", 0.5, accuracy).alias("middle"))
    middle = middle.join(seen.groupBy("l").agg(F.count("*").alias("texts")), "l")
    off = joined_by_hot_key(seen, middle, "l", "texts").select("l", F.abs(F.col("x") - F.col("middle")).alias("d"), F.sqrt("n").alias("r"))
    spread = off.groupBy("l").agg(
        F.greatest(F.percentile_approx("d", 0.5, accuracy) * 1.4826, F.lit(MIN_SPREAD)).alias("spread"),
        F.greatest(F.percentile_approx(F.col("d") * F.col("r"), 0.5, accuracy) * 1.4826, F.lit(MIN_ROOT_SPREAD)).alias("root_spread"),
    )
    out = stored(middle.drop("texts").join(spread, "l"), "bands")
    discard(seen)
    return out


def assess(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", lower: float = 3.5, upper: float = 5.0) -> DataFrame:
    """df's columns and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), perplexity (double).

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT
    percent of them in repeated windows. kept: not so, and the text's log perplexity lies
    at most lower spreads below and upper spreads above its language's middle. Columns of
    these names are replaced. A null text has no words and fails; a null language
    counts as a language; repeated rows count each time and stay. One text at a
    time is held, whole.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"]
    df = df.drop(*(c for c in made if c not in (key, text, lang)))
    folder = ngrams.fit(df, text, lang, _same(text, lang), copies(df, text, lang))
    limits = bands(df, folder, text, lang)
    at, at_lang = df.columns.index(text), df.columns.index(lang)
    own = ["__l", "__x", "__n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(start, n) for batch in batches for start, n in parts_of(batch.column(at), SLICE)):
            texts = batch.column(at).to_pylist()
            names = [None if n is None else str(n) for n in batch.column(at_lang).to_pylist()]
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            x, n = scorer(folder).surprises(names, texts, _word_characters())
            more = [*(pa.array(c, pa.int64()) for c in counts.T), pa.array([_name(name) for name in names], pa.string()), pa.array(x, pa.float64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *made[:5], *own])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields]
    scored = df.mapInArrow(run, ", ".join([*fields, *(f"{c} bigint" for c in made[:5]), "__l string, __x double, __n bigint"]))
    limits = limits.select(F.col("l").alias("__l"), F.col("middle").alias("__m"), F.col("spread").alias("__s"), F.col("root_spread").alias("__r"))
    off = F.col("__x") - F.col("__m")
    wide = F.sqrt(F.col("__s") * F.col("__s") + F.col("__r") * F.col("__r") / F.greatest(F.col("__n"), F.lit(1))) + F.lit(1e-9)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return (
        scored.join(limits, "__l", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.coalesce((off >= -lower * wide) & (off <= upper * wide), F.lit(True)))
        .withColumn("perplexity", F.exp("__x"))
        .drop(*own, "__m", "__s", "__r")
    )

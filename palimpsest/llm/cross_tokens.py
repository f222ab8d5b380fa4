"""Alignment of two tokenizers: where their tokens end together, and how often which pairs of tokens do.

Both tokenizers begin a token at a blank that follows a character other than white
space, so texts are cut there, and each distinct chunk is aligned once per worker. Chunks
that are new are aligned together: NumPy sums their tokens' lengths to ends, intersects the two
sides' ends to the common cuts, looks up each token's group among these, and expands the
tokens of a cut to links by repetition.

A block of documents is stored with its documents' chunks, the chunks' links, and a count per
pair of ids. The counts are summed over the corpus in two stages, first by pair and
salt, then by pair. A block asks for its own pairs' totals, each of them once, so that no
pair, however common, brings more than one row per block to that join. Blocks then sum
what their documents' links tell.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, chunked, discard, hold, small_batches, stored

#: Bytes of text in a block, if more than one document; salts of the first stage; chunks that go to a library at once.
BLOCK_BYTES, SALTS, GROUP = 8 << 20, 16, 10_000
BLANK = "▁"


# ---- alignment of token ends ---------------------------------------------------------


def expand(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs with equal labels; both sides' labels ascend."""
    cells = int(max(left.max(initial=-1), right.max(initial=-1))) + 1
    many = np.bincount(right, minlength=cells)
    times = many[left]
    first = np.cumsum(many) - many
    total = int(times.sum())
    within = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(np.arange(len(left)), times), np.repeat(first[left], times) + within


class Alignment:
    """Of two token sequences over the same bytes, given the tokens' lengths.

    cuts: the offsets at which tokens of both sides end; group_a, group_b: each token's
    group between cuts; left, right: the linked tokens' places, and at: the group in which a link lies.
    Linked are the tokens that end together, or with whole_groups all tokens of a group.
    """

    def __init__(self, lengths_a: np.ndarray, lengths_b: np.ndarray, whole_groups: bool = False):
        ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
        # ends ascend, and repeat only where a token is empty
        self.cuts = np.intersect1d(ends_a, ends_b, assume_unique=bool((lengths_a > 0).all() and (lengths_b > 0).all()))
        self.group_a, self.group_b = (np.searchsorted(self.cuts, e, side="left") for e in (ends_a, ends_b))
        some_a, some_b = np.arange(len(ends_a)), np.arange(len(ends_b))
        if not whole_groups:
            some_a, some_b = (some[e == np.append(self.cuts, -1)[g]] for some, e, g in ((some_a, ends_a, self.group_a), (some_b, ends_b, self.group_b)))
        x, y = expand(self.group_a[some_a], self.group_b[some_b])
        self.left, self.right = some_a[x], some_b[y]
        self.at = self.group_a[self.left]


# ---- chunks --------------------------------------------------------------------------


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies show a byte as a printable character: visible Latin-1 as itself, others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {chr(b if b in visible else next(hidden)): b for b in range(256)}


class _Grown:
    """A flat array that grows."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class Aligner:
    """Aligns texts by two tokenizers; keeps what became of chunks in flat arrays, max_chunks at most between blocks."""

    def __init__(self, definition: str, model: bytes, whole_groups: bool = False, max_chunks: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte = _bytes_of_characters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte.get(c, 0) for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(BLANK in name.lstrip(BLANK) for name in names):
            raise ValueError("a piece reaches over a blank")
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # an id's digits with what may follow them: a further token of its side, the other side, the next group
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        self.digits = [b"%d%c" % (i, c) for c in b",|;" for i in range(self.ids)]
        self.digit_sizes = np.array([len(d) for d in self.digits], np.int64)
        self.whole_groups, self.max_chunks = whole_groups, max_chunks
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # a chunk without the blank that it starts with
        #: per chunk: tokens of A (-1 where bytes differ), of B, groups, links; where its spelling and its links begin
        self.numbers, self.spelled_at, self.pairs_at = (_Grown(np.int32), _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)), _Grown(np.int64), _Grown(np.int64)
        self.spelled, self.spelled_sizes, self.pairs = _Grown(np.uint8), _Grown(np.int32), _Grown(np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Chunks that aren't known. Where the next one's blank follows a character other than white space, they are encoded joined; the others by themselves."""
        plain = [c for c in chunks if c and not c[-1].isspace() and BLANK not in c]
        rest = [c for c in chunks if not c or c[-1].isspace() or BLANK in c]
        for k in range(0, len(plain), GROUP):
            some = plain[k : k + GROUP]
            text = " ".join(some)
            data = (" " + text).encode()
            a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)
            b = np.array(self.b.encode(text, num_threads=1), np.int64)  # this library puts the blank in front
            if self._bytes(a, b) == (data, data):
                sizes = np.fromiter(map(len, some), np.int64, len(some)) if text.isascii() else np.array([len(c.encode()) for c in some], np.int64)
                self._add(some, np.cumsum(sizes + 1), np.ones(len(some), bool), a, b)
            else:
                rest += some
        for k in range(0, len(rest), GROUP):
            self._learn_apart(rest[k : k + GROUP])

    def _bytes(self, a: Sequence[int], b: Sequence[int]) -> tuple[bytes, bytes]:
        return b"".join(map(self.bytes_a.__getitem__, a)), b"".join(map(self.bytes_b.__getitem__, b))

    def _learn_apart(self, chunks: list[str]) -> None:
        data = [b" " + c.encode() for c in chunks]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        # the blank comes in front of something only; alone it is one piece
        ids_b = [b if c else [self.b.piece_to_id(BLANK)] for c, b in zip(chunks, self.b.encode(chunks, num_threads=1))]
        same = [self._bytes(a, b) == (d, d) for a, b, d in zip(ids_a, ids_b, data)]
        real = [i for i, s in enumerate(same) if s]
        flat = (np.array([x for i in real for x in ids[i]], np.int64) for ids in (ids_a, ids_b))
        self._add(chunks, np.cumsum([len(data[i]) for i in real]), np.array(same, bool), *flat)

    def _add(self, chunks: list[str], ends: np.ndarray, same: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Chunks, of which those that are the same have these ends and tokens."""
        found = Alignment(self.lengths_a[a], self.lengths_b[b], self.whole_groups)
        # a chunk's end is a cut, so groups and links lie within chunks
        groups = np.searchsorted(found.cuts, ends, side="left") + 1
        links = np.searchsorted(found.at, groups, side="left")
        of_group = [np.bincount(g, minlength=len(found.cuts)) for g in (found.group_a, found.group_b)]
        numbers = [np.diff(np.concatenate([[0], np.cumsum(n)])[groups], prepend=0) for n in of_group] + [np.diff(groups, prepend=0), np.diff(links, prepend=0)]
        spelled, sizes = self._spelled(a, b, found)
        spelled_ends = np.concatenate([[0], np.cumsum(sizes)])[groups]

        def spread(values: np.ndarray, otherwise: int = 0) -> np.ndarray:
            out = np.full(len(chunks), otherwise, np.int64)
            out[same] = values
            return out

        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        for held, values, otherwise in zip(self.numbers, numbers, (-1, 0, 0, 0)):
            held.add(spread(values, otherwise))
        own_links, own_bytes = spread(numbers[3]), spread(np.diff(spelled_ends, prepend=0))
        self.spelled_at.add(self.spelled.n + np.cumsum(own_bytes) - own_bytes)
        self.pairs_at.add(self.pairs.n + np.cumsum(own_links) - own_links)
        self.spelled_sizes.add(own_bytes)
        self.spelled.add(np.frombuffer(spelled, np.uint8))
        self.pairs.add(a[found.left] << 32 | b[found.right])

    def _spelled(self, a: np.ndarray, b: np.ndarray, found: Alignment) -> tuple[bytes, np.ndarray]:
        """All groups as a1,a2|b1,b2; and each one's length."""
        group = np.concatenate([found.group_a, found.group_b])
        order = np.argsort(group * 2 + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (found.group_a, found.group_b)]
        coded = np.concatenate([a + np.where(last[0], self.ids, 0), b + np.where(last[1], 2 * self.ids, 0)])[order]
        sizes = np.bincount(group[order], weights=self.digit_sizes[coded], minlength=len(found.cuts)).astype(np.int64)
        return b"".join(map(self.digits.__getitem__, coded.tolist())), sizes

    def digest(self, chunks: np.ndarray) -> str:
        """SHA-256 of a text's groups; empty without any."""
        if not len(chunks):
            return ""
        out = hashlib.sha256()
        for k in range(0, len(chunks), GROUP):
            some = chunks[k : k + GROUP]
            begin = self.spelled_at.held[some]
            sizes = self.spelled_sizes.held[some]
            at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            # what parts groups follows each of them, but for a text's last
            out.update(self.spelled.held[at][: len(at) - (k + GROUP >= len(chunks))])
        return out.hexdigest()

    def chunks(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's chunks; a text without any has none."""
        parts = []
        for t in texts:
            cut, regular = chunked(t) if t else ([], True)
            if not regular:
                cut = [c[1:] for c in chunked(" " + t)[0]]
            parts.append(cut)
        self.learn(list({c for cut in parts for c in cut if c not in self.known}))
        return [np.fromiter(map(self.known.__getitem__, cut), np.int32, len(cut)) for cut in parts]


@lru_cache(maxsize=1)
def _aligner(definition: str, model: bytes, whole_groups: bool) -> Aligner:
    return Aligner(definition, model, whole_groups)


def aligner(definition: str, model: bytes, whole_groups: bool) -> Aligner:
    """The worker's aligner."""
    hold("aligner", _aligner.cache_clear)
    return _aligner(definition, model, whole_groups)


# ---- blocks --------------------------------------------------------------------------

_BLOCK = "block bigint, ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, shas array<string>, starts binary, chunks binary, link_starts binary, links binary, pairs array<bigint>, counts array<bigint>"


def _block(number: int, ids: list, chunks: list[np.ndarray], known: Aligner, schema: pa.Schema) -> pa.RecordBatch:
    """A block's one row: its documents, their chunks as places among the block's, these chunks' links as places among the block's pairs, and each pair's count."""
    flat = np.concatenate(chunks) if chunks else np.zeros(0, np.int32)
    sizes = np.array([len(c) for c in chunks], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # a text with a chunk whose bytes differ has no tokens, and so no chunks
    bad = _summed(known.numbers[0].held[flat] < 0, starts) > 0
    if bad.any():
        flat, sizes = flat[~np.repeat(bad, sizes)], np.where(bad, 0, sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])
    sums = [_summed(n.held[flat], starts).tolist() for n in known.numbers]
    shas = [known.digest(flat[lo:hi]) for lo, hi in zip(starts.tolist(), starts[1:].tolist())]
    used = np.flatnonzero(np.bincount(flat, minlength=len(known.known)))
    place = np.zeros(len(known.known), np.int32)
    place[used] = np.arange(len(used))
    own = place[flat]
    times = np.bincount(own, minlength=len(used)).astype(np.int64)
    n_links = known.numbers[3].held[used].astype(np.int64)
    at = np.repeat(known.pairs_at.held[used] - (np.cumsum(n_links) - n_links), n_links) + np.arange(int(n_links.sum()))
    pairs, links = np.unique(known.pairs.held[at], return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, links, np.repeat(times, n_links))
    link_starts = np.concatenate([[0], np.cumsum(n_links)])
    packed = [x.astype("<u4").tobytes() for x in (starts, own, link_starts, links)]
    row = [number, ids, *sums, shas, *packed, pairs, counts]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums between starts."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[starts])


def blocks(df: DataFrame, definition: str, model: bytes, key: str, text: str, whole_groups: bool) -> DataFrame:
    """Rows of _BLOCK: documents in blocks of bounded bytes, a longer text alone."""
    small_batches(df.sparkSession)
    told = df.sparkSession.sparkContext.broadcast((definition, model))
    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(*told.value, whole_groups)
        schema = None
        first = TaskContext.get().partitionId() << 32
        ids, chunks, held, n = [], [], 0, 0

        for batch in batches:
            schema = schema or pa.schema([pa.field(x, t) for x, t in _arrow_types(batch.schema.field(0).type)])
            at = 0
            for texts in byte_slices(batch.column(1)):
                if held and held + texts.nbytes > BLOCK_BYTES:
                    yield _block(first + n, ids, chunks, known, schema)
                    ids, chunks, held, n = [], [], 0, n + 1
                    if len(known.known) > known.max_chunks:
                        known.forget()
                chunks += known.chunks([t or "" for t in texts.to_pylist()])
                ids += batch.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                held += texts.nbytes
        if ids:
            yield _block(first + n, ids, chunks, known, schema)
            if len(known.known) > known.max_chunks:
                known.forget()

    return rows.mapInArrow(run, _BLOCK.format(kind=kind))


def _arrow_types(key: pa.DataType) -> list[tuple[str, pa.DataType]]:
    longs = pa.list_(pa.int64())
    out = [("block", pa.int64()), ("ids", pa.list_(key)), *((c, longs) for c in ("n_a", "n_b", "n_groups", "n_links")), ("shas", pa.list_(pa.string()))]
    return [*out, *((c, pa.binary()) for c in ("starts", "chunks", "link_starts", "links")), ("pairs", longs), ("counts", longs)]


def pair_counts(held: DataFrame) -> DataFrame:
    """pair, a, b, n (long), best: all linked id pairs of the blocks, how many links hold each, and whether no pair with this b has more."""
    rows = held.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    salted = rows.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    totals = salted.groupBy("pair").agg(F.sum("n").alias("n"))
    totals = totals.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "n")
    totals = stored(totals, "pair-counts")
    # a row for each id of b's vocabulary at most
    most = totals.groupBy("b").agg(F.max("n").alias("most"))
    return totals.join(F.broadcast(most), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(df: DataFrame, definition: str, model: bytes, key: str = "doc_id", text: str = "text", whole_groups: bool = False) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    definition is a byte-level tokenizer of the tokenizers library (A), which encodes a
    blank and the text; model a sentencepiece model (B), which adds the blank itself. Special
    tokens' strings within texts are plain text. A text that is null or empty, or whose
    joined tokens of either side aren't the blank and the text, has no tokens: zeros,
    and an empty groups_sha256. Otherwise that is the hexadecimal SHA-256 of its groups, a1,a2|b1;a3|b2,b3.

    A link is a token of A and one of B whose bytes end together, or with whole_groups any two
    in a group. A pair's count is that of its links in the whole table; n_best
    counts a row's links whose count is the highest of their B id, ties included, count_sum sums
    the counts of a row's links. Keys may be null or repeat; repeated rows count as often as they
    occur; other columns play no part whatever their names; an empty table gives no rows. A text is
    aligned whole, whatever its length.
    """
    held = stored(blocks(df, definition, model, key, text, whole_groups), "aligned", group_rows=1)
    totals = stored(pair_counts(held), "pair-totals")
    asked = held.select("block", F.explode("pairs").alias("pair")).join(totals, "pair").select("block", "pair", "n", "best")
    wanted = ["ids", "n_a", "n_b", "n_groups", "n_links", "shas", "starts", "chunks", "link_starts", "links"]

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        hold("aligned", lambda: None)
        cell = lambda name: block.column(name)[0]
        starts, own, link_starts, links = (np.frombuffer(cell(c).as_buffer(), "<u4").astype(np.int64) for c in wanted[6:])
        order = np.argsort(told.column("pair").to_numpy())
        sums = []
        for name in ("best", "n"):
            of_pair = told.column(name).cast(pa.int64()).to_numpy()[order]
            of_chunk = _summed(of_pair[links] if len(links) else links, link_starts)
            sums.append(pa.array(_summed(of_chunk[own], starts)))
        return pa.Table.from_arrays([cell(c).values for c in wanted[:5]] + sums + [cell("shas").values], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = df.schema[key].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    joined = held.select("block", *wanted).groupBy("block").cogroup(asked.withColumnRenamed("block", "of").groupBy("of"))
    return joined.applyInArrow(run, f"id {kind}, {longs}, groups_sha256 string").withColumnRenamed("id", key)


def links(df: DataFrame, definition: str, model: bytes, key: str = "doc_id", text: str = "text", whole_groups: bool = False) -> DataFrame:
    """a, b (ids), n (long), best: the crosswalk between the two vocabularies, a row for each pair that the table's texts link."""
    held = stored(blocks(df, definition, model, key, text, whole_groups), "aligned", group_rows=1)
    out = stored(pair_counts(held), "pair-totals").select("a", "b", "n", "best")
    discard(held)
    return out

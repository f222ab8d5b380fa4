"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds every id's
first chunk; a continuation bitmap says which ids go on; level 1 holds those ids'
second chunk, and so on. A rank directory holds the number of set bits before
every 512th bit, so that the place of an id's next chunk follows from one look-up
and a short count: any id is read without decoding what stands before it.

A file: the magic, then little-endian numbers: n_docs, n_ids, n_levels (u64), per
level its n_codes (u64); then doc ids (i64), a bitmap of those that are null, the
documents' first ids within the file (n_docs + 1 times u64); per level the codes
(u8), the bitmap (bit i of byte i // 8), the directory (u32).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, chunked, hold, run_dir

MAGIC = b"DACIDS01"
RANK_BITS = 512
#: Chunks given to the library at once: a call has a cost of its own, and so does each text.
GROUP = 10_000
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


# ---- the codes --------------------------------------------------------------------


def pack(ids: np.ndarray, doc_ids: list[int | None], first: np.ndarray) -> bytes:
    """A file's bytes for these ids; first[i] is document i's first id, first[-1] the number of ids."""
    levels: list[tuple[bytes, bytes, bytes]] = []
    left = ids.astype(np.uint32)
    counts = []
    while len(left) or not levels:
        more = left > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(_ONES[bitmap], np.arange(0, len(bitmap), RANK_BITS // 8)) if len(bitmap) else np.zeros(0, int)
        directory = np.concatenate([[0], np.cumsum(ones, dtype=np.uint64)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append(((left & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), directory.tobytes()))
        counts.append(len(left))
        left = left[more] >> 8
    head = np.array([len(doc_ids), len(ids), len(levels), *counts], "<u8").tobytes()
    null = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little").tobytes()
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    return b"".join([MAGIC, head, known, null, first.astype("<u8").tobytes(), *(part for level in levels for part in level)])


class Shard:
    """A file's bytes, read by position."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_docs, self.n_ids, n_levels = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        counts = np.frombuffer(data, "<u8", n_levels, 32)
        at = 32 + 8 * n_levels

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known = take("<i8", self.n_docs)
        null = np.unpackbits(take("u1", -(-self.n_docs // 8)), bitorder="little")[: self.n_docs]
        self.doc_ids = [None if gone else int(d) for d, gone in zip(known, null)]
        self.first = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for n in map(int, counts):
            bits = -(-n // 8)
            self.levels.append((take("u1", n), take("u1", bits), take("<u4", -(-bits // (RANK_BITS // 8)))))

    def _rank(self, level: int, i: int) -> int:
        """The set bits before bit i of a level's bitmap."""
        _, bitmap, directory = self.levels[level]
        if not len(directory):
            return 0
        block = min(i // RANK_BITS, len(directory) - 1)
        start, whole = block * (RANK_BITS // 8), i // 8
        n = int(directory[block]) + int(_ONES[bitmap[start:whole]].sum())
        return n + (int(_ONES[bitmap[whole] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def get(self, i: int) -> int:
        """Id i, by one chunk per level."""
        value = 0
        for level, (codes, bitmap, _) in enumerate(self.levels):
            value |= int(codes[i]) << 8 * level
            if not bitmap[i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def get_all(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, as get() finds each."""
        out = np.zeros(len(places), np.uint32)
        on, at = np.arange(len(places)), places.astype(np.int64)
        for level, (codes, bitmap, directory) in enumerate(self.levels):
            out[on] |= codes[at].astype(np.uint32) << 8 * level
            more = (bitmap[at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)
            on, at = on[more], at[more]
            if not len(on):
                break
            # set bits before the place: those before its block, of the block's whole bytes, and of its byte
            width = RANK_BITS // 8
            block = at // RANK_BITS
            bytes_at = block[:, None] * width + np.arange(width)
            ones = np.where(bytes_at < (at // 8)[:, None], _ONES[bitmap[np.minimum(bytes_at, len(bitmap) - 1)]], 0).sum(axis=1, dtype=np.int64)
            at = directory[block].astype(np.int64) + ones + _ONES[bitmap[at // 8] & ((1 << at % 8) - 1).astype(np.uint8)].astype(np.int64)
        return out

    def ids(self, lo: int, hi: int, level: int = 0) -> np.ndarray:
        """Ids lo to hi - 1."""
        codes, bitmap, _ = self.levels[level]
        out = codes[lo:hi].astype(np.uint32)
        if level + 1 < len(self.levels) and hi > lo:
            bits = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            n = int(bits.sum())
            if n:
                start = self._rank(level, lo)
                out[bits] |= self.ids(start, start + n, level + 1) << 8
        return out


class Ranges:
    """A stored file read by byte ranges: an id costs a few bytes of each of its levels, whatever the file's size."""

    def __init__(self, file):
        self.file = file
        if bytes(file.read_at(8, 0)) != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_docs, self.n_ids, n_levels = (int(x) for x in self._take("<u8", 3, 8))
        counts = [int(x) for x in self._take("<u8", n_levels, 32)]
        self.known = 32 + 8 * n_levels
        self.first = self.known + 8 * self.n_docs + -(-self.n_docs // 8)
        at = self.first + 8 * (self.n_docs + 1)
        self.levels = []
        for n in counts:
            bits = -(-n // 8)
            self.levels.append((at, at + n, at + n + bits))
            at += n + bits + 4 * -(-bits // (RANK_BITS // 8))

    def _take(self, kind: str, n: int, at: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)

    def get(self, i: int) -> int:
        """Id i."""
        return int(self.ids(i, i + 1)[0])

    def ids(self, lo: int, hi: int, level: int = 0) -> np.ndarray:
        """Ids lo to hi - 1."""
        codes, bitmap, directory = self.levels[level]
        out = self._take("u1", hi - lo, codes + lo).astype(np.uint32)
        if hi > lo:
            block = lo // RANK_BITS * (RANK_BITS // 8)
            held = self._take("u1", -(-hi // 8) - block, bitmap + block)
            bits = np.unpackbits(held, bitorder="little")
            before, own = bits[: lo - 8 * block], bits[lo - 8 * block : hi - 8 * block].astype(bool)
            n = int(own.sum())
            if n:
                start = int(self._take("<u4", 1, directory + 4 * (lo // RANK_BITS))[0]) + int(before.sum())
                out[own] |= self.ids(start, start + n, level + 1) << 8
        return out

    def document(self, d: int) -> np.ndarray:
        """The ids of the file's document d, with its end id."""
        lo, hi = (int(x) for x in self._take("<u8", 2, self.first + 8 * d))
        return self.ids(lo, hi)


# ---- encoding ----------------------------------------------------------------------


class Encoder:
    """Ids by the tokenizers library; keeps those of chunks seen, max_chunks at most, in flat arrays.

    Added tokens are read wherever a text spells them out, as the library does; one that
    holds a blank would be cut apart, so a tokenizer with such a token is refused.
    """

    def __init__(self, definition: str, max_chunks: int = 690_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        if any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token reaches over a blank")
        # each character of a byte-level token stands for one byte
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.max_chunks = max_chunks
        self._forget()

    def _forget(self) -> None:
        self.after: dict[str, int] = {}  # chunks that follow a blank, without it
        self.first: dict[str, int] = {}  # chunks at a text's start
        self.flat, self.used, self.n = np.zeros(1 << 20, np.uint32), 0, 0
        self.start, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Each chunk after a blank: joined, the library cuts them where they are joined."""
        for k in range(0, len(chunks), GROUP):
            group = [" " + c for c in chunks[k : k + GROUP]]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, np.uint32)
            # ids stand for bytes, and none for bytes of two chunks: a token lies in the chunk in which it ends
            ends = np.cumsum([len(c) if c.isascii() else len(c.encode("utf-8", "surrogatepass")) for c in group])
            places = np.searchsorted(ends, np.cumsum(self.n_bytes[ids]), side="left")
            n = self._add(ids, np.bincount(places, minlength=len(group)))
            self.after.update(zip(chunks[k : k + GROUP], range(n, n + len(group))))

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        n = self.n
        while n + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(sizes)] = sizes
        self.used += len(ids)
        self.n += len(sizes)
        return n

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are cut at every blank, one after the other, and how many each has."""
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        if self.n + len(names) > self.max_chunks:
            self._forget()
        heads = np.zeros(len(codes), bool)
        heads[offsets[:-1]] = True
        used = np.flatnonzero(np.bincount(codes[~heads], minlength=len(names))).tolist()
        asked = [names[c] for c in used]
        self._learn([c for c in asked if c not in self.after])
        where = np.zeros(len(names), np.int64)
        where[used] = list(map(self.after.__getitem__, asked))
        at = where[codes]
        for i, c in zip(offsets[:-1].tolist(), codes[offsets[:-1]].tolist()):
            found = self.first.get(names[c])
            if found is None:
                ids = self._whole(names[c])
                found = self.first[names[c]] = self._add(ids, np.array([len(ids)]))
            at[i] = found
        size = self.size[at]
        ends = np.cumsum(size)
        take = np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]))
        return self.flat[take], np.add.reduceat(size, offsets[:-1])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after the other, and how many each has."""
        uncut = pc.match_substring_regex(texts, _UNCUT).to_numpy(zero_copy_only=False)
        if len(texts) and not uncut.any():
            return self._regular(texts)
        pieces: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        regular = np.flatnonzero(~uncut)
        if len(regular):
            ids, n = self._regular(texts.take(pa.array(regular)))
            for i, part in zip(regular.tolist(), np.split(ids, np.cumsum(n)[:-1])):
                pieces[i] = part
        for i in np.flatnonzero(uncut).tolist():
            text = texts[i].as_py()
            chunks, by_blank = chunked(text)
            pieces[i] = np.concatenate([np.zeros(0, np.uint32), *map(self._whole, [text] if by_blank else chunks)])
        return np.concatenate([np.zeros(0, np.uint32), *pieces]), np.array([len(p) for p in pieces], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


#: Texts that aren't cut at every blank: empty ones, and those with a blank at an end or after white space (fixed values: Unicode's white space with the separators 1C to 1F).
_UNCUT = r"^$|^ | $|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


def encoder(definition: str) -> Encoder:
    """The worker's encoder."""
    hold("token store", _encoder.cache_clear)
    return _encoder(definition)


# ---- writing and reading -----------------------------------------------------------


def _put(path: str, data: bytes) -> None:
    """Written under a name of its own and then moved, over what an earlier attempt of the task may have left."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(data)
    try:
        fs.move(part, at)
    except OSError:  # not every store moves over a file
        if fs.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
            raise
        fs.delete_file(at)
        fs.move(part, at)


def write(df: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = 1 << 22) -> DataFrame:
    """Encode every text, append end_id, and write the ids in ascending key order to files in folder.

    Null keys come first; rows of one key follow by their texts' hash and text; a
    null text counts as empty and has the end id alone. A file takes slices of
    whole documents until it has shard_ids ids. Other columns play no part. Returns the manifest, read back: part, seq,
    n_docs, n_ids and start, the number of ids in all files before.
    """
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(definition.value)
        keys: list[int | None] = []
        pieces: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq, keys, pieces, sizes
            first = np.cumsum(np.concatenate([[0], *sizes]))
            _put(f"{folder}/ids/{part:06d}-{seq:06d}.dac", pack(np.concatenate(pieces), keys, first))
            out = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(keys), "n_ids": held}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            held, seq, keys, pieces, sizes = 0, seq + 1, [], [], []
            return out

        for batch in batches:
            done = 0
            for texts in byte_slices(batch.column(1), min(4 << 20, 4 * shard_ids)):
                ids, n = enc.encode_all(texts)
                ends = np.cumsum(n)
                keys += batch.column(0).slice(done, len(texts)).to_pylist()
                pieces.append(np.insert(ids, ends, end_id))
                sizes.append(n + 1)
                held += len(pieces[-1])
                done += len(texts)
                if held >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{at}/ids", recursive=True)
    ordered.mapInArrow(run, "part int, seq int, n_docs bigint, n_ids bigint").write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a store in order, with start; its rows number the files (one for millions of ids), not the documents."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema("part int, seq int, n_docs bigint, n_ids bigint").parquet(f"{folder}/manifest")
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start (ids before it in the store), n_tokens (with the end id), ids_crc32, first_id.

    first_id, the document's first id (its end id where it is empty), is read by its place alone.
    """
    files = spark.read.format("binaryFile").load(f"{folder}/ids/*.dac").select(
        F.regexp_extract("path", r"(\d+)-\d+\.dac$", 1).cast("int").alias("part"),
        F.regexp_extract("path", r"-(\d+)\.dac$", 1).cast("int").alias("seq"),
        "content",
    )
    rows = files.join(manifest(spark, folder).select("part", "seq", "start"), ["part", "seq"]).select("start", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start, content in zip(frame["start"], frame["content"]):
                shard = Shard(bytes(content))
                first = shard.first
                ids = shard.ids(0, shard.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pd.DataFrame({key: pd.array(shard.doc_ids, "Int64"), "start": start + first[:-1], "n_tokens": np.diff(first), "ids_crc32": np.array(crc, np.int64), "first_id": shard.get_all(first[:-1]).astype(np.int64)})

    return rows.mapInPandas(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint, first_id bigint")


def read_places(wanted: DataFrame, folder: str) -> DataFrame:
    """wanted: part, seq, place (a file and an id's place in it). Returns these and id, read by byte ranges; null where there is no such place.

    Rows of one file may be dealt to any tasks: none reads more than it asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        name, ranges = None, None
        for batch in batches:
            found: list[int | None] = []
            for part, seq, place in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, seq) != name:
                    path = f"{at}/ids/{part or 0:06d}-{seq or 0:06d}.dac"
                    there = part is not None and seq is not None and fs.get_file_info(path).type == pyarrow.fs.FileType.File
                    name, ranges = (part, seq), Ranges(fs.open_input_file(path)) if there else None
                found.append(ranges.get(place) if ranges and place is not None and 0 <= place < ranges.n_ids else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["part", "seq", "place", "id"])

    return wanted.select(F.col("part").cast("int"), F.col("seq").cast("int"), F.col("place").cast("long")).mapInArrow(run, "part int, seq int, place bigint, id bigint")


def store_and_read(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Write df's ids to a new folder under the shared folder and read them back; an empty df gives no rows."""
    spark = df.sparkSession
    folder = run_dir(spark, "token-store")
    write(df, tokenizer, folder, key, text, **how)
    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    if not fs.get_file_info(pyarrow.fs.FileSelector(f"{at}/ids")):
        return spark.createDataFrame([], f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint, first_id bigint")
    return read(spark, folder, key)

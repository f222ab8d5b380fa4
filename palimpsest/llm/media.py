"""Media columns: AVI files of motion JPEG, their frames, shots and timed clips.

A file's RIFF chunks are parsed and its frames found by the index; frames are decoded
on their own; a shot ends where the difference of two frames' histograms rises above
what the shot's own differences let expect.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import small_batches

FRAMES_PER_SECOND = 25
BINS = 16
#: A cut: the difference exceeds the mean by so many deviations, and this share of the samples.
DEVIATIONS, FLOOR = 3.0, 0.15
BATCH_BYTES = 1 << 20


# ---- RIFF ------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FRAMES_PER_SECOND) -> bytes:
    """One video stream of JPEG frames with an index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        pad = len(f) % 2
        parts += [b"00dc", len(f).to_bytes(4, "little"), f, b"\0" * pad]
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + pad
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """A file's video frames, by its index or else in file order, and frames per second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FRAMES_PER_SECOND), (0, 0), b""

    def walk(at: int, end: int) -> None:
        nonlocal fps, movi, index
        while at + 8 <= end:
            name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST" and data[body : body + 4] == b"movi":
                movi = (body, min(body + n, end))
            elif name == b"LIST":
                walk(body + 4, min(body + n, end))
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                fps = rate / scale if scale and rate else fps
            elif name == b"idx1":
                index = data[body : body + n]
            at = body + n + n % 2

    walk(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))
    frames = []
    if index:
        entries = np.frombuffer(index, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]), len(index) // 16)
        video = entries[[x[2:4] in (b"dc", b"db") for x in entries["name"].tolist()]]
        # offsets count from the list's name, or in some files from the file's start
        start = movi[0] if not len(video) or data[movi[0] + int(video["at"][0]) :][:4] == video["name"][0] else 0
        frames = [data[start + a + 8 : start + a + 8 + n] for a, n in zip(video["at"].tolist(), video["n"].tolist())]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            n = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + n])
            at += 8 + n + n % 2
    return [f for f in frames if f], fps


# ---- shots -----------------------------------------------------------------------


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """Frames' histograms, each of sum 1: the shots as first frame and end.

    Within a shot, the mean and deviation of its differences so far set the threshold for the next; a shot's first
    difference is held against twice the median of all, if there are more than two.
    """
    if not len(histograms):
        return []
    change = (np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2).tolist()
    cuts, n, total, squares = [0], 0, 0.0, 0.0
    prior = 2 * sorted(change)[len(change) // 2] if len(change) > 2 else 0.0
    for i, d in enumerate(change, 1):
        mean = total / n if n else prior
        deviation = max(squares / n - mean * mean, 0.0) ** 0.5 if n else 0.0
        if d > FLOOR and d > mean + DEVIATIONS * deviation:
            cuts.append(i)
            n, total, squares = 0, 0.0, 0.0
        else:
            n, total, squares = n + 1, total + d, squares + d * d
    return list(zip(cuts, [*cuts[1:], len(histograms)]))


def clips(planes: list[np.ndarray], fps: float) -> list[tuple[int, int, int, int, float]]:
    """Per shot: first frame, end, start and end in milliseconds, mean level; planes: the frames' first components."""
    if not planes:
        return []
    sizes = np.array([p.size for p in planes])
    frame = np.repeat(np.arange(len(planes)), sizes)
    levels = np.concatenate([p.ravel() for p in planes])
    counts = np.bincount(frame * BINS + levels // (256 // BINS), minlength=len(planes) * BINS).reshape(-1, BINS)
    sums = np.bincount(frame, levels, minlength=len(planes))
    return [(a, b, round(a * 1000 / fps), round(b * 1000 / fps), round(float(sums[a:b].sum() / sizes[a:b].sum()), 2)) for a, b in shots(counts / sizes[:, None])]


# ---- texts as media --------------------------------------------------------------


def payload(text: str | None) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (64 - len(data) % 64 if len(data) % 64 or not data else 0)


def store_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload as an AVI file: a sample is a flat block, a row has 64 of them, a frame eight rows, the last one perhaps fewer."""
    rows_of, frames_of = [], []
    for p in payloads:
        whole, rest = divmod(len(p) // 64, jpeg.ROWS)
        rows_of += [jpeg.ROWS] * whole + [rest] * (rest > 0)
        frames_of.append(whole + (rest > 0))
    frames = iter(jpeg.encode_flat(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, jpeg.COLUMNS), rows_of))
    return [write_avi([next(frames) for _ in range(n)], jpeg.COLUMNS * 8, jpeg.ROWS * 8) for n in frames_of]


def _batches(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of about most bytes each."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _emit(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def texts_to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, payload_bytes (long) and media, the text as an AVI file. A null text is empty; its payload is 64 zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for part in _batches([len(t) for t in texts.fill_null("").to_pylist()]):
                own = texts[part].to_pylist()
                payloads = [payload(t) for t in own]
                n = [len((t or "").encode("utf-8", "surrogatepass")) for t in own]
                yield pa.RecordBatch.from_arrays([keys[part], pa.array(n, pa.int64()), pa.array(map(len, payloads), pa.int64()), pa.array(store_payloads(payloads), pa.binary())], names=[key, "n_bytes", "payload_bytes", "media"])

    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, media binary")


def decode_samples(files: list[bytes], scale: int = 8) -> list[tuple[list[np.ndarray], float]]:
    """Per file: its frames' first components, at one sample per block if scale is 8, and frames per second."""
    parsed = [read_avi(f) for f in files]
    planes = iter(jpeg.decode([f for frames, _ in parsed for f in frames], scale=scale))
    return [([next(planes)[0] for _ in frames], fps) for frames, fps in parsed]


def clip_rows(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Timed clips of a column of AVI files: key, clip, first_frame, end_frame, start_ms, end_ms (int), level (double).

    A null file or one without frames has no clips; a file that isn't AVI of baseline JPEG is an error.
    """
    names = [key, "clip", "first_frame", "end_frame", "start_ms", "end_ms", "level"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.float64()]
            keys, files = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            some = [(k, f) for k, f in zip(keys, files) if f]
            for part in _batches([len(f) for _, f in some]):
                rows = [(k, i, *c) for (k, _), (planes, fps) in zip(some[part], decode_samples([f for _, f in some[part]], 1)) for i, c in enumerate(clips(planes, fps))]
                yield _emit(names, kinds, rows)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} int" for n in names[1:6]) + ", level double")


def digests(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of texts_to_media, read back from media: payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, the clips as start-end:level."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            keys, n_bytes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            files = batch.column(2)
            for part in _batches([len(f) for f in files.to_pylist()]):
                own = files[part].to_pylist()
                rows = []
                for k, n, f, (planes, fps) in zip(keys[part], n_bytes[part], own, decode_samples(own)):
                    data = b"".join(p.tobytes() for p in planes)
                    feature = ";".join(f"{a}-{b}:{level:.2f}" for _, _, a, b, level in clips(planes, fps))
                    rows.append((k, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature))
                yield _emit(names, kinds, rows)

    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")

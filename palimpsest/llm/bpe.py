"""Byte-level BPE encoding and decoding by a sentencepiece model that is written straight from the vocabulary.

No tokenizer is trained: the rank file's byte strings become pieces, each byte
shown as one printable character, scored by their negative rank, so that the
library's best-score-first merges are the lowest-rank-first merges of byte-level
BPE. Normalisation is the identity. Pre-tokens are encoded one by one; decoding
maps piece ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, hold, small_batches


def byte_characters() -> str:
    """256 printable characters, one for each byte: visible Latin-1 characters stand for themselves, others follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))


_CHARACTERS = byte_characters()
_SHOW = {b: c for b, c in enumerate(_CHARACTERS)}
_BYTE = {c: b for b, c in enumerate(_CHARACTERS)}


def shown(data: bytes) -> str:
    return data.decode("latin-1").translate(_SHOW)


def read_ranks(data: bytes) -> list[bytes]:
    """The byte strings of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model in which token i is piece i; the unknown piece comes last.

    Fields of the public protocol: model 1 pieces (1 piece, 2 score, 3 type), 2
    trainer (3 model type, 35 byte fallback, 40 to 43 special ids), 3 normaliser (1
    name, 3 dummy prefix, 4 extra blanks, 5 escaped blanks).
    """
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _bytes(1, _bytes(1, shown(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1))
    out += _bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    off = (1 << 64) - 1
    trainer = _number(3, 2) + _number(35, 0) + _number(40, len(tokens)) + b"".join(_number(k, off) for k in (41, 42, 43))
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _bytes(2, trainer) + _bytes(3, normaliser))


#: Chunks that a worker keeps: of texts in many languages most of the work is in those met anew. Beside other stages, in the pipeline, fewer.
SPELLED_CHUNKS, CHUNKS = 600_000, 250_000


class Codec:
    """Encodes and decodes with one model; keeps what became of chunks, max_chunks at most: their ids, or if spelled, these as decimal digits and the bytes they decode to."""

    def __init__(self, model: bytes, pattern: str, spelled: bool = False, max_chunks: int = CHUNKS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.pieces = [bytes(map(_BYTE.__getitem__, self.sp.id_to_piece(i))) for i in range(self.sp.get_piece_size() - 1)]
        self.spelled, self.max_chunks = spelled, max_chunks
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.raw: dict[str, int] = {}
        self.after_blank: dict[str, int] = {}
        self.held: list = []

    def _learn(self, into: dict[str, int], chunks: list[str], before: str) -> None:
        """Chunks not seen yet, by one call of the library for all their new pre-tokens."""
        split = {c: self.find(before + c) for c in chunks}
        new = list({w for ws in split.values() for w in ws if w not in self.words})
        for w, ids in zip(new, self.sp.encode([shown(w.encode("utf-8")) for w in new], num_threads=1)):
            self.words[w] = ids
        words = self.words
        for c, ws in split.items():
            ids = words[ws[0]] if len(ws) == 1 else [i for w in ws for i in words[w]]
            into[c] = len(self.held)
            self.held.append((" ".join(map(str, ids)).encode(), self.decode(ids)) if self.spelled else ids)

    def _chunks(self, text: str) -> list[int]:
        """The numbers of a text's chunks, each of which has ids."""
        if not text:
            return []
        if len(self.words) + len(self.held) > self.max_chunks:
            self._forget()
        chunks, regular = chunked(text)
        if not regular:
            if new := [c for c in set(chunks) if c not in self.raw]:
                self._learn(self.raw, new, "")
            return list(map(self.raw.__getitem__, chunks))
        first, rest = chunks[0], chunks[1:]
        if first not in self.raw:
            self._learn(self.raw, [first], "")
        if new := [c for c in set(rest) if c not in self.after_blank]:
            self._learn(self.after_blank, new, " ")
        return [self.raw[first], *map(self.after_blank.__getitem__, rest)]

    def encode(self, text: str) -> list[int]:
        """A text's ids, of a codec that isn't spelled."""
        at = self._chunks(text)
        return list(chain.from_iterable(map(self.held.__getitem__, at)))

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """Of a spelled codec, the ids as decimal digits between single blanks, and the bytes that they decode to: a chunk's ids decode by themselves."""
        at = self._chunks(text)
        digits, decoded = zip(*map(self.held.__getitem__, at)) if at else ((), ())
        return b" ".join(digits), b"".join(decoded)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=1)
def _codec(model: bytes, pattern: str, spelled: bool) -> Codec:
    return Codec(model, pattern, spelled, SPELLED_CHUNKS if spelled else CHUNKS)


def codec(model: bytes, pattern: str, spelled: bool = False) -> Codec:
    """The worker's codec."""
    hold("bpe", _codec.cache_clear)
    return _codec(model, pattern, spelled)


def _model(df: DataFrame, vocabulary: str):
    """The model as a broadcast; its size is that of the vocabulary, whatever the input's."""
    small_batches(df.sparkSession)
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(f.read())))


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column ids, the token ids of text; a column of that name is replaced.

    A null text counts as empty; an empty text has no ids; other columns, rows and
    repeated rows stay as they are. A text of any length is encoded whole.
    """
    model = _model(df, vocabulary)
    kept = df.drop(ids)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value, pattern)
        for batch in batches:
            lists = [c.encode(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, ids])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, `{ids}` array<int>")


def round_trip(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (decimal ids joined by one blank), decoded_sha256 (bytes decoded from the ids).

    Null and empty texts have no tokens and the digests of nothing; a null key
    stays null; repeated rows give repeated results. Works batch by batch.
    """
    model = _model(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value, pattern, spelled=True)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for t in batch.column(1).to_pylist():
                ids, decoded = c.round_trip(t or "")
                counts.append(ids.count(b" ") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

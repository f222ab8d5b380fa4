import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from palimpsest.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b \n c\n\n  d", "\n x\t y   z", "don't we'll  'S", "12 345 ½ x²", "naïve ÀÉ 漢字かな 🎉👍🏽", "<|endoftext|> x", "a\x1c b", "a" * 5000, "ab " * 3000 + " ", "  q　 r", "x" + " " * 4000 + "y"]


def test_same_ids_as_byte_level_bpe_and_round_trip():
    enc, c = reference(), bpe.Codec(bpe.sentencepiece_model(bpe.read_ranks(open(PATH, "rb").read())), P.PATTERN, max_chunks=500)
    told = bpe.Codec(bpe.sentencepiece_model(bpe.read_ranks(open(PATH, "rb").read())), P.PATTERN, spelled=True, max_chunks=500)
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("ab é\n\t '.1漢s") for _ in range(rnd.randrange(60))) for _ in range(2000)]
    for t in texts:
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t), repr(t)
        assert c.decode(ids) == t.encode()
        assert told.round_trip(t) == (" ".join(map(str, ids)).encode(), t.encode())


def test_operator_handles_null_empty_repeated_and_extra_columns(spark):
    rows = [(i, t, "extra", i) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (1, "a", "x", 1), (1, "a", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids int")
    got = bpe.round_trip(df, PATH, P.PATTERN).collect()
    enc = reference()
    want = sorted(
        (d, len(e := enc.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) if d is not None else (-1, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
        for d, t, _, _ in rows
    )
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    out = bpe.encode_texts(df, PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids"]
    assert all(r.ids == enc.encode_ordinary(r.text or "") for r in out.collect())
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_the_querys_codec_keeps_chunks_beyond_250_000():
    """Most of the work is in chunks that are met anew, so what a worker can hold isn't thrown away."""
    c = bpe.codec(bpe.sentencepiece_model(bpe.read_ranks(open(PATH, "rb").read())), P.PATTERN, spelled=True)
    for lo, hi in ((0, 150_000), (150_000, 300_000), (0, 3)):
        c.round_trip(" ".join(map(str, range(lo, hi))))
    assert len(c.held) >= 300_000

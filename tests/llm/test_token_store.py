import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
from tokenizers import Tokenizer

from palimpsest.llm import token_store as ts
from tests.llm.test_bpe import TEXTS

PATH = P.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_codes_are_directly_addressable():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = rnd.choice(np.array([0, 1, 255, 256, 300, 65535, 65536, 50256, 2**24, 2**32 - 1], np.uint32), n)
        shard = ts.Shard(ts.pack(ids, [None, 4], np.array([0, n // 2, n])))
        assert shard.doc_ids == [None, 4] and list(shard.first) == [0, n // 2, n]
        assert [shard.get(i) for i in range(n)] == ids.tolist()
        for _ in range(30):
            lo, hi = sorted(rnd.integers(0, n + 1, 2))
            assert np.array_equal(shard.ids(lo, hi), ids[lo:hi])
        places = rnd.integers(0, n, 200) if n else np.zeros(0, np.int64)
        assert np.array_equal(shard.get_all(places), ids[places])
        ranges = ts.Ranges(pa.BufferReader(ts.pack(ids, [None, 4], np.array([0, n // 2, n]))))
        assert [ranges.get(i) for i in places] == ids[places].tolist()
        assert np.array_equal(ranges.document(0), ids[: n // 2]) and np.array_equal(ranges.document(1), ids[n // 2 :])


def test_encoder_equals_the_library():
    t, e = library(), ts.Encoder(open(PATH, encoding="utf-8").read(), max_chunks=300)
    rnd = random.Random(2)
    texts = TEXTS + ["a <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", " <|endoftext|>  <|endoftext|> c"] + ["".join(rnd.choice("ab é\n\t '.1漢s🎉") for _ in range(rnd.randrange(80))) for _ in range(1500)] + [" ".join(rnd.choice(["don't", "É1", "x.\ny", "漢字", "🎉🎉", "é"]) + str(rnd.randrange(50)) for _ in range(40)) for _ in range(200)]
    for x in texts:
        assert e.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    ids, n = e.encode_all(pa.array(texts))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    long = " ".join(rnd.choice(["word", "É1", "x.\ny", "漢字"]) + str(rnd.randrange(500)) for _ in range(400_000))
    assert e.encode(long).tolist() == t.encode(long, add_special_tokens=False).ids


def test_store(spark):
    rows = [(i * 7 % 19, t, 1, "c") for i, t in enumerate(TEXTS)] + [(None, None, 1, "c"), (None, "x y", 2, "d"), (3, "same", 1, "c"), (3, "same", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int, k string").repartition(3)
    got = [tuple(r) for r in ts.store_and_read(df, PATH, shard_ids=60).collect()]
    t = library()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == [0, *np.cumsum([r[2] for r in by_start])[:-1]]
    assert [r[0] for r in by_start] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    want = sorted((-1 if d is None else d, len(i := t.encode(x or "", add_special_tokens=False).ids + [0]), zlib.crc32(np.array(i, "<u4").tobytes())) for d, x, *_ in rows)
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got) == want
    firsts = {(-1 if d is None else d, (t.encode(x or "", add_special_tokens=False).ids + [0])[0]) for d, x, *_ in rows}
    assert {(-1 if r[0] is None else r[0], r[4]) for r in got} == firsts
    assert ts.store_and_read(df.limit(0), PATH).count() == 0


def test_ids_by_their_places(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words {i} x{i * 977} <|endoftext|>") for i in range(300)], "doc_id bigint, text string").repartition(5)
    folder = f"file://{tmp_path}/store"
    files = ts.write(df, PATH, folder, shard_ids=500).collect()
    assert len(files) > 3 and [f.start for f in files] == [0, *np.cumsum([f.n_ids for f in files])[:-1]]
    t = library()
    stream = [i for d in range(300) for i in [*t.encode(f"some words {d} x{d * 977} <|endoftext|>", add_special_tokens=False).ids, 0]]
    wanted = [(f.part, f.seq, p) for f in files for p in range(0, f.n_ids, 7)] + [(files[0].part, files[0].seq, 10**9), (999, 0, 0), (None, 0, 0)]
    got = {(r.part, r.seq, r.place): r.id for r in ts.read_places(spark.createDataFrame(wanted, "part int, seq int, place bigint").repartition(3), folder).collect()}
    for f in files:
        assert all(got[f.part, f.seq, p] == stream[f.start + p] for p in range(0, f.n_ids, 7))
    assert got[files[0].part, files[0].seq, 10**9] is None and got[999, 0, 0] is None and got[None, 0, 0] is None


def test_a_file_written_twice_stays(tmp_path):
    path = f"file://{tmp_path}/a"
    for data in (b"one", b"two"):
        ts._put(path, data)
    assert (tmp_path / "a").read_bytes() == b"two" and len(list(tmp_path.iterdir())) == 1


def test_chunks_seen_are_kept_beyond_600_000():
    """Most of the work is in chunks that are met anew, so what a worker can hold isn't thrown away."""
    enc = ts.Encoder(open(PATH, encoding="utf-8").read())
    for lo, hi in ((0, 320_000), (320_000, 640_000), (0, 3)):
        enc.encode(" ".join(map(str, range(lo, hi))))
    assert enc.n >= 640_000

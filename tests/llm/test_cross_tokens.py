import hashlib
import random
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from palimpsest.llm.cross_tokens import Alignment, align, expand, links
from palimpsest.llm.queries import QUERIES


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def by_hand(rows, files, whole_groups=False):
    """Rows and pair counts by the untouched libraries, whole texts, plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_str(files[0])
    first.encode_special_tokens = True
    shown = {c: b for b, c in zip(range(256), _shown())}
    second = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    told, counts = [], Counter()
    for d, text in rows:
        data = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        xs = [bytes(shown[c] for c in first.id_to_token(i)) for i in a]
        ys = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(xs) != data or b"".join(ys) != data:
            told.append((d, None))
            continue
        ea, eb = np.cumsum([len(x) for x in xs]).tolist(), np.cumsum([len(y) for y in ys]).tolist()
        cuts, lo, groups, linked = sorted({*ea} & {*eb}), 0, [], []
        for c in cuts:
            ga, gb = a[bisect_right(ea, lo) : bisect_right(ea, c)], b[bisect_right(eb, lo) : bisect_right(eb, c)]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            linked += [(x, y) for x in ga for y in gb] if whole_groups else [(ga[-1], gb[-1])]
            lo = c
        counts.update(linked)
        told.append((d, (len(a), len(b), len(cuts), linked, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = Counter((d, 0, 0, 0, 0, 0, 0, "") if v is None else (d, *v[:3], len(v[3]), sum(counts[p] == most[p[1]] for p in v[3]), sum(counts[p] for p in v[3]), v[4]) for d, v in told)
    return out, counts, most


def _shown():
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_equals_the_libraries_on_whole_texts(spark, files):
    rnd = random.Random(6)
    pieces = ["the", "Th", " ", "  ", "\n", "\t", "é", "漢字", "ﬁ", "­", "\x00", "\x1c", "<s>", "<|endoftext|>", "<0x41>", "don't", "12", "!!", "　", "\xa0", "🙂", "unbelievably", "▁"]
    rows = [(i, "".join(rnd.choice(pieces[: 22 + (i % 10 == 0)]) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 40)))) for i in range(150)]
    rows += [(500, ""), (501, None), (502, " "), (503, "a▁b"), (504, "▁"), (None, "twice the same"), (None, "twice the same"), (505, "word " * 60_000), (506, "x" * 100_000)]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id bigint, text string, block string, n_a int").repartition(4)
    for whole in (False, True):
        want, counts, most = by_hand(rows, files, whole)
        assert Counter(tuple(r[c] for c in COLUMNS) for r in align(df, *files, whole_groups=whole).collect()) == want
        got = {(r.a, r.b): (r.n, r.best) for r in links(df, *files, whole_groups=whole).collect()}
        assert got == {p: (n, n == most[p[1]]) for p, n in counts.items()}
    assert align(df.where("false"), *files).count() == 0


def test_links_of_tokens_that_are_empty_or_share_a_group():
    x, y = expand(np.array([0, 0, 1, 3]), np.array([0, 1, 1, 2]))
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (1, 0), (2, 1), (2, 2)]
    rnd = random.Random(7)
    for _ in range(200):
        total = rnd.randrange(1, 12)
        sides = []
        for _ in "ab":
            ends = sorted({*(rnd.randrange(1, total + 1) for _ in range(5)), total})
            sides.append(np.diff([0, *ends]))
        found = Alignment(*sides)
        ends = [np.cumsum(s).tolist() for s in sides]
        assert set(zip(found.left.tolist(), found.right.tolist())) == {(i, j) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1]) if e == f}


def test_blocks_of_any_size_agree(spark, files, monkeypatch):
    import palimpsest.llm.cross_tokens as module

    rows = [(i, f"some words {i} and words again " * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    want = sorted(align(df, *files).collect())
    monkeypatch.setattr(module, "BLOCK_BYTES", 100)
    assert sorted(align(df, *files).collect()) == want


def test_the_query_covers_the_table(spark, files):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_cross_tokens"](spark, sf).collect()) == by_hand(rows, files)[0]


def test_blocks_are_written_and_read_one_by_one(spark, files, monkeypatch):
    """However many blocks a task has, one of them is buffered."""
    import pyarrow.parquet as pq

    from palimpsest.llm import cross_tokens as module

    kept = []
    own = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name, **more: kept.append((name, own(df, name, **more))) or kept[-1][1])
    monkeypatch.setattr(module, "BLOCK_BYTES", 100)
    df = spark.createDataFrame([(i, f"some words of text {i} " * 5) for i in range(20)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert align(df, *files).count() == 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    told = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in dict(kept)["aligned"].inputFiles()]
    assert sum(m.num_rows for m in told) > 10
    assert all(m.row_group(i).num_rows == 1 for m in told for i in range(m.num_row_groups))

import hashlib
import math

import numpy as np
import pytest

from palimpsest.llm.queries import QUERIES
from palimpsest.llm.vector_codes import BLOCK, compress, with_label_errors


def by_hand(vectors, parts=4, entries=256, rounds=4):
    """Codes, errors and entries of rows that are in order; plain loops over integers."""
    whole = [[math.floor(1024 * x) for x in v] for v in vectors]
    size = len(whole[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for v in whole] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def nearest(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in cut[p]:
                members.setdefault(nearest(v, books[p])[1], []).append(v)
            for i, vs in members.items():
                books[p][i] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(whole))]
    return ["".join(f"{i:02x}" for _, i in f) for f in found], [sum(d for d, _ in f) for f in found], books


def digest(books):
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_equals_plain_loops(spark):
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(size=(300, 8)).astype(np.float32)
    vectors[100:150] = vectors[3]  # repeated vectors tie
    rows = [(i, v.tolist(), None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors)]
    odd = [(1000, None, 1), (1001, [float("nan")] * 8, 1), (1002, [float("inf")] + [0.0] * 7, None), (1003, [None] + [0.0] * 7, 2), (1004, [1.0, 2.0], 2)]
    df = spark.createDataFrame([(*r, "c") for r in rows + odd], "vec_id bigint, embedding array<float>, label int, code string").repartition(5)
    for entries in (256, 16):
        out, books = compress(df, entries=entries)
        codes, errors, plain = by_hand(vectors.tolist(), entries=entries)
        told = {r.vec_id: r for r in with_label_errors(out).collect()}
        assert set(told) == {*range(300), 1004}  # another dimension stays without a code
        assert told[1004].code is None and told[1004].error is None
        assert [told[i].code for i in range(300)] == codes
        assert [told[i].error for i in range(300)] == errors
        assert books.sha256() == digest(plain)
        sums = {}
        for (_, _, label), e in zip(rows, errors):
            sums[label] = sums.get(label, 0) + e
        assert all(told[i].label_error == sums[label] for i, _, label in rows)
        back = {r.vec_id: r.vector for r in books.decode(out).collect()}
        assert back[1004] is None
        assert back[9] == [x / 1024 for p in range(4) for x in plain[p][int(codes[9][2 * p : 2 * p + 2], 16)]]


def test_small_and_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>, label string"
    out, books = compress(spark.createDataFrame([], schema))
    assert out.count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    rows = [(None, [1.0, 2.0, 3.0, 4.0], None), (3, [0.0] * 4, "x"), (3, [-1.0] * 4, "x"), (3, [-1.0] * 4, None)]
    out, books = compress(spark.createDataFrame(rows, schema), rounds=0)
    # entries: both rows of -1, that of 0, that without a key; the first of equal entries is taken
    assert sorted((r.vec_id or 0, r.code, r.error) for r in out.collect()) == [(0, "03030303", 0), (3, "00000000", 0), (3, "00000000", 0), (3, "02020202", 0)]
    with pytest.raises(Exception, match="64 bits"):
        compress(spark.createDataFrame([(1, [1e9] * 4, "x")], schema))


def test_blocks_and_tree_don_t_change_the_result(spark):
    rnd = np.random.default_rng(2)
    vectors = np.round(rnd.normal(size=(BLOCK + 100, 4)), 1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    results = []
    for parts in (1, 70):
        out, books = compress(df.repartition(parts), entries=8)
        results.append((books.sha256(), sorted((r.vec_id, r.code, r.error) for r in out.collect())))
    assert results[0] == results[1]


def test_the_query_covers_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    codes, errors, books = by_hand([r.embedding for r in rows])
    got = {r.vec_id: r for r in QUERIES["op12_vector_codes"](spark, sf).collect()}
    assert [(got[r.vec_id].code, got[r.vec_id].error) for r in rows] == list(zip(codes, errors))
    assert {r.codebooks_sha256 for r in got.values()} == {digest(books)}

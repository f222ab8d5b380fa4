import random

import numpy as np
import pytest

from palimpsest.operators import bytecode, paged

TABLE = {0: ("nop", ""), 1: ("push1", "u8"), 2: ("push2", "u16"), 3: ("push4", "u32"), 4: ("jump", "rel16"), 5: ("enter", "enter"), 6: ("leave", "leave"), 7: ("switch", "switch"), 8: ("call", "u24"), 9: ("native", "native")}


def program(rnd, n):
    out = bytearray()
    while len(out) < n:
        op = rnd.randrange(10)
        kind = TABLE[op][1]
        if kind == "enter":
            k = rnd.randrange(60)
            body = bytes([1, 2, 0, k]) + rnd.randbytes(k)
        elif kind == "switch":
            k = rnd.randrange(40)
            body = bytes([k]) + rnd.randbytes(6 * k)
        else:
            body = rnd.randbytes(bytecode.SIZES[kind])
        out += bytes([op]) + body
    return bytes(out)


def test_pages_tell_what_linear_decoding_tells(spark):
    rnd = random.Random(23)
    rows = [("a", "x", program(rnd, 30_000)), ("b", "x", program(rnd, 500)), ("c", "y", b""), ("d", "y", program(rnd, 9000))]
    df = spark.createDataFrame(rows, "script string, version string, code binary")
    want = sorted(tuple(r) for r in bytecode.instructions(df, TABLE).collect())
    for page in (64, 4096, 1 << 16):
        assert sorted(tuple(r) for r in paged.instructions(df, TABLE, page).collect()) == want


def test_leaps_equal_steps():
    rnd = random.Random(24)
    code = np.frombuffer(rnd.randbytes(5000), np.uint8) % 14
    ahead, n = paged.next_offsets(code, TABLE, 3000), 3000
    got = paged.leaps(code, TABLE, n)
    for p in range(n):
        at = p
        while 0 <= at < n:
            at = ahead[at]
        assert got[p] == at


def test_broken_programs_are_errors(spark):
    for code, why in ((b"\x00\xff\x00", "no instruction"), (b"\x00\x03\x01", "cut off")):
        with pytest.raises(Exception, match=why):
            paged.instructions(spark.createDataFrame([("a", "x", code)], "script string, version string, code binary"), TABLE, 64).collect()


def test_programs_are_decoded_in_sql(spark):
    paged.register(spark, TABLE)
    spark.createDataFrame([("a", b"\x01\x07\x00\x02\x01\x01")], "script string, code binary").createOrReplaceTempView("programs_in_sql")
    got = spark.sql("SELECT script, d.offset, d.mnemonic, d.value FROM programs_in_sql, LATERAL decode_program(code) d WHERE d.kind <> '' ORDER BY d.offset").collect()
    assert [tuple(r) for r in got] == [("a", 0, "push1", 7), ("a", 3, "push2", 257)]


def test_pages_of_one_program_are_dealt_over_tasks(spark, monkeypatch):
    """Small pages are few bytes, but each is work."""
    seen, staged = [], paged.staged
    monkeypatch.setattr(paged, "staged", lambda df: seen.append(staged(df)) or seen[-1])
    code = program(random.Random(29), 140_000)
    df = spark.createDataFrame([("a", "x", code)], "script string, version string, code binary")
    assert paged.instructions(df, TABLE, 64).count() == bytecode.instructions(df, TABLE).count()
    (pages,) = [x for x in seen if "bytes" in x.columns]
    assert sum(n > 0 for n in pages.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= 4

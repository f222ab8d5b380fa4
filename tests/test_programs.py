import json
import struct

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import binary
from palimpsest.operators import assembly, bytecode
from palimpsest.plans.resolving import TABLE
from palimpsest.sources import dumps, patches


def test_symbolic_programs():
    text = """
    main: ENTER 2, 5, "name"  ; a comment; with "marks
    PUSH_U32 0x10
    SWITCH 5:end, 0xFFFFFFFF:xend
    xend: JUMP xend
    NATIVE 8, 300
    end: LEAVE 2, 1
    FIELD -3
    PUSH_U8 #FF
    JUMP main
    """
    code = assembly.assemble_text(text, TABLE)
    rows = bytecode.disassemble(code, TABLE)
    assert [r[2] for r in rows] == ["ENTER", "PUSH_U32", "SWITCH", "JUMP", "NATIVE", "LEAVE", "FIELD", "PUSH_U8", "JUMP"]
    at = {r[2]: r[0] for r in rows}
    assert rows[3][5] == rows[3][0] and rows[-1][5] == 0
    assert bytecode.switch_cases(rows[2][4], rows[2][0]) == [(5, at["LEAVE"]), (0xFFFFFFFF, rows[3][0])]
    for bad in ("a: NOP\na: NOP", "JUMP nowhere", "PUSH_U8 256", "PUSH_U8", "PUSH_U8 1, 2", "WHAT 1", "PUSH_U8 x1", "LEAVE 1"):
        with pytest.raises(ValueError):
            assembly.assemble_text(bad, TABLE)
    assert assembly.assemble_text("", TABLE) == b"" and assembly.tokenize(" ; nothing") == (None, None, [])


def test_listings_of_odd_operands(spark):
    # names that can't be quoted, jumps into an instruction, an empty switch
    code = bytes([6, 1, 2, 0, 3]) + b'a"b' + bytes([0x0C, 0, 5, 0xFE, 0xFF, 6, 0, 0, 0, 2]) + b"ok" + bytes([0x0C, 1, 1, 0, 0, 0, 0, 0, 9])
    p = spark.createDataFrame([("x", "old", bytearray(code))], "script string, version string, code binary")
    lines = [r.text for r in assembly.listing(bytecode.instructions(p, TABLE)).orderBy("seq").collect()]
    assert assembly.assemble_text("\n".join(lines), TABLE) == code
    assert lines[-1].startswith("L") and lines[-1].endswith("NOP") and '"ok"' in "".join(lines)


def test_positions_and_floats(spark):
    data = bytes.fromhex("0A 0B 0C 0A FF 0C 0A")
    d = spark.createDataFrame([(bytearray(data),)], "b binary")
    r = d.select(binary.positions("b", "0A ? 0C").alias("p"), binary.positions("b", "77").alias("n"), binary.count_bytes("b", "0A ? 0C").alias("c")).first()
    assert r.p == [0, 3] and r.n == [] and r.c == 2
    values = [0.0, -0.0, 1.0, -2.5, 3.4e38, 1e-45, 1e-40, float("inf"), float("-inf"), 0.1]
    bits = [struct.unpack("<I", struct.pack("<f", v))[0] for v in values]
    got = [x.f for x in spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "i int, b bigint").select("i", binary.float_of_bits("b").alias("f")).orderBy("i").collect()]
    assert got == [struct.unpack("<f", struct.pack("<f", v))[0] for v in values]
    assert spark.range(1).select(binary.float_of_bits(F.lit(0x7FC00000)).alias("f")).first().f != 0.0


@pytest.mark.parametrize("head", [b"", struct.pack("<I", 0x37435352) + bytes(12)])
def test_dumps_of_the_long_layout(head):
    code = bytes([9]) * (dumps.PAGE + 77)
    shift = len(head)
    body = bytearray(0x80)
    put = lambda at, v, n=4: body.__setitem__(slice(at, at + n), v.to_bytes(n, "little"))
    table, natives, name = 0x80, 0x90, 0xA0
    pages = [0xB0, 0xB0 + dumps.PAGE]
    put(0x10, table | 0x50000000)  # only 24 bits of a pointer count
    put(0x1C, len(code)), put(0x2C, 2), put(0x40, natives | 0x50000000), put(0x60, name)
    body += b"".join(struct.pack("<II", p | 0x50000000, 7) for p in pages) + struct.pack("<qq", 5, -6) + b"script_x\0".ljust(16, b"\0") + code
    assert dumps.parse(head + bytes(body)) == ("script_x", code, [5, -6])
    with pytest.raises(ValueError):
        dumps.parse(head + bytes(body[:-1]))
    with pytest.raises(ValueError):
        dumps.parse(b"xy")


def test_patch_sets(spark, tmp_path):
    rows = [
        {"patch_name": "a", "script_name": "s", "pattern": "0A ? 0C", "offset": 1, "bytes_to_patch": "2D 01 02", "category": "inject", "values": [{"id": 1, "pattern": "FF", "offset": 0, "bytes_to_read": 4}]},
        {"patch_name": "b", "script_name": "s", "pattern": "0A", "bytes_to_patch": "2D {x}", "category": "inject"},
        {"patch_name": "c", "script_name": "none", "pattern": "0A", "bytes_to_patch": "00", "dev": True},
        {"patch_name": "d", "script_name": "", "pattern": "0A"},
    ]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    p = patches.read_patches(spark, f"{tmp_path}/p.json")
    assert [r.i for r in p.orderBy("patch").select(patches.injected("inject", "2d").alias("i")).collect()] == [True, False, False, False]
    code = {"old": bytes.fromhex("0A 0B 0C FF"), "new": bytes.fromhex("0A 0B 0C")}
    programs = spark.createDataFrame([("s", v, bytearray(c)) for v, c in code.items()], "script string, version string, code binary")
    got = {r.patch: r for r in patches.patch_health(p, programs).collect()}
    assert got[0].status == "BROKEN" and got[0].values[0].status == "BROKEN" and (got[0].n_old, got[0].n_new) == (1, 1)
    assert got[1].status == "OK" and got[2].status == "NOT_IN_OLD" and 3 not in got
    done = patches.repaired(p, spark.createDataFrame([(0, bytearray(b"\x01\xff"))], "patch int, code binary"))
    patches.write_patches(done, f"{tmp_path}/out")
    again = json.loads(spark.read.text(f"{tmp_path}/out").first().value)
    assert again[0]["bytes_to_patch"] == "01 FF" and again[0]["values"] == rows[0]["values"] and [x["patch_name"] for x in again] == list("abcd")


def test_calls_into_a_span_move_with_it(spark):
    code = bytes([4, 0x10, 0, 0, 4, 0x40, 0, 0])
    rows = bytecode.instructions(spark.createDataFrame([("x", "old", bytearray(code))], "script string, version string, code binary"), TABLE)
    none = spark.createDataFrame([], "script string, index int, hash bigint")
    calls = spark.createDataFrame([], "script string, old_address int, new_address int, tier string")
    spans = spark.createDataFrame([("x", 0x10, 0x100, 8)], "script string, old_base int, new_base int, length int")
    audit = bytecode.remap_audit(rows, none, none, calls, spans)
    assert {(r.old, r.new, r.confidence) for r in audit.collect()} == {(0x10, 0x100, "internal"), (0x40, None, "review")}
    assert bytes(bytecode.assemble(bytecode.remapped(rows, audit)).first().code) == bytes([4, 0, 1, 0, 4, 0x40, 0, 0])

"""Program dumps: a header of pointers, code in pages, and a table of 64-bit hashes.

All numbers are little-endian. Layouts say where a header's fields stand: LONG is that of the
dumps in use, SHORT a layout of our own. The page table holds an offset per 16 KiB page of
code; the name ends in a zero byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = 1 << 14
HEADER = "<4s5I"


@dataclass(frozen=True)
class Layout:
    """Offsets of a header's fields, bytes of a page table's entry, the bits of a pointer that count, and by magic number how far all is shifted."""

    pages: int
    code_length: int
    n_natives: int
    natives: int
    name: int
    entry: int
    mask: int
    shifts: dict[int, int]


# The fields' offsets, the magic numbers and the length of the header before them in LONG's format.
LONG = Layout(pages=0x10, code_length=0x1C, n_natives=0x2C, natives=0x40, name=0x60, entry=8, mask=0xFFFFFF, shifts={0x37435352: 0x10, 0x38435352: 0x10})
SHORT = Layout(pages=16, code_length=4, n_natives=8, natives=20, name=12, entry=4, mask=0xFFFFFFFF, shifts={})


def parse(data: bytes, layout: Layout | None = None) -> tuple[str, bytes, list[int]]:
    """name, code and hashes (as signed bit patterns); without a layout, SHORT if the magic is its own, else LONG."""
    layout = layout or (SHORT if data[:4] == b"PDMP" else LONG)
    u32 = lambda at: struct.unpack_from("<I", data, at)[0]
    try:
        shift = layout.shifts.get(u32(0), 0)
        pointer = lambda at: (u32(at) & layout.mask) + shift
        n_code, n_natives = u32(shift + layout.code_length), u32(shift + layout.n_natives)
        table, natives, name = (pointer(shift + x) for x in (layout.pages, layout.natives, layout.name))
        pages = [pointer(table + i * layout.entry) for i in range(-(-n_code // PAGE))]
        hashes = list(struct.unpack_from(f"<{n_natives}q", data, natives))
    except struct.error:
        raise ValueError("not a program dump") from None
    code = b"".join(data[p : p + min(PAGE, n_code - i * PAGE)] for i, p in enumerate(pages))
    if len(code) != n_code:
        raise ValueError("a page is cut off")
    end = data.find(b"\0", name)
    return data[name : end if end >= 0 else len(data)].decode("latin-1"), code, hashes


def build(name: str, code: bytes, natives: list[int]) -> bytes:
    """The dump that parse() reads."""
    size = struct.calcsize(HEADER)
    pages = [code[i : i + PAGE] for i in range(0, len(code), PAGE)]
    named = name.encode() + b"\0"
    pages_at = size + len(named)
    natives_at = pages_at + 4 * len(pages)
    first = natives_at + 8 * len(natives)
    offsets = [first + i * PAGE for i in range(len(pages))]
    return struct.pack(HEADER, b"PDMP", len(code), len(natives), size, pages_at, natives_at) + named + struct.pack(f"<{len(pages)}I", *offsets) + struct.pack(f"<{len(natives)}q", *natives) + b"".join(pages)


def read_dumps(spark: SparkSession, path: str, version: str) -> DataFrame:
    """script, version, code and natives (an array by index) of dump files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([parse(bytes(c)) for c in frame["content"]], columns=["script", "code", "natives"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "script string, code binary, natives array<bigint>").withColumn("version", F.lit(version))


def native_table(dumps: DataFrame) -> DataFrame:
    """script, version, index, hash."""
    return dumps.select("script", "version", F.posexplode("natives").alias("index", "hash"))


def hash_names(spark: SparkSession, path: str) -> DataFrame:
    """hash and name of a JSON dictionary of namespaces, each of hexadecimal hashes to entries with a name; others are skipped."""
    from ..functions.binary import integer

    kind = "map<string,map<string,struct<name:string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))
    rows = whole.select(F.explode("d").alias("space", "names")).select(F.explode("names").alias("h", "entry"))
    digits = F.regexp_extract("h", r"^0[xX]([0-9A-Fa-f]{1,16})$", 1)
    return rows.where(digits != "").select(integer(F.unhex(F.lpad(digits, 16, "0")), 1, 8, big=True).alias("hash"), F.col("entry.name").alias("name")).distinct()

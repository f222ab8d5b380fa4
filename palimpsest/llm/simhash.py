"""Near duplicates by SimHash: documents whose 64-bit fingerprints differ in few bits.

Candidates are pruned by chains of segments on a ring. A fingerprint is cut into
m = 2 * bits + 1 segments. If two fingerprints differ in at most bits places, there is a
segment from which, going round the ring, the differences of the first j segments sum to
at most j * bits / m, for every j: otherwise, from each start some run would exceed its
share, and such runs, one after the other round the ring, would exceed the whole.

The first two segments of such a chain are equal, so each distinct fingerprint is entered
m times, under each segment with the next one; the budgets of the longer chains
and the full difference are conditions of that join. Where more than `hot` fingerprints
share two segments, the chain is followed further before anything meets: up to
where its budget is one, the places in which one side may differ are written out, and the
join asks for all those segments to be equal.

Equal fingerprints are one class; what meets are classes, whose components are then
told to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, hold, joined_by_hot_key, stored
from .components import components

WIDTH = 64
SEED = 42
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


# ---- fingerprints ------------------------------------------------------------------


def fingerprint(words: list[bytes], size: int) -> int:
    """The fingerprint of a sequence of lower-cased words: a bit is set if more than half of the shingles' hashes have it."""
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    n = max(1, len(words) - size + 1)
    ends = (starts + lengths)[min(size, len(words)) - 1 :]
    votes = np.zeros(WIDTH, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, AT_ONCE):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[k : k + AT_ONCE].tolist(), ends[k : k + AT_ONCE].tolist())]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Per row: id (the key) and fp (long, the fingerprint's 64 bits).

    A-Z are lower-cased, ASCII white space parts words, shingles of so many words count as
    often as they occur; a shorter text is one shingle; null texts and texts without
    words have the fingerprint 0. A text of any length is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", lambda: None)
        for batch in batches:
            out = []
            for part in byte_slices(batch.column(1)):
                lowered = pc.ascii_lower(pc.fill_null(part, "")).cast(pa.large_binary())
                out += [fingerprint(t.split(), words) for t in lowered.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["id", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"id {kind}, fp bigint")


# ---- chains of segments ------------------------------------------------------------


class Ring:
    """The segments of a fingerprint and the budgets of chains of them; masks are signed 64-bit numbers."""

    def __init__(self, bits: int):
        if not 0 <= bits <= 10:
            raise ValueError("bits must be from 0 to 10")
        self.bits, self.m = bits, 2 * bits + 1
        cuts = [WIDTH * i // self.m for i in range(self.m + 1)]
        segment = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
        #: chains[i][j]: what the first j + 1 segments from segment i on cover
        self.chains = [[sum(segment[(i + k) % self.m] for k in range(j + 1)) for j in range(self.m)] for i in range(self.m)]
        budget = [(j + 1) * bits // self.m for j in range(self.m)]
        #: of chains with one budget, the longest says all
        self.longest = {b: j for j, b in enumerate(budget)}

    def masks(self, budget: int) -> list[int]:
        return [_signed(chain[self.longest[budget]]) for chain in self.chains]

    def flips(self) -> list[list[int]]:
        """Per start, what may be changed within a chain of budget one: nothing, or a place after its equal part."""
        out = []
        for chain in self.chains:
            free = chain[self.longest[1]] & ~chain[self.longest[0]]
            out.append([0, *(_signed(1 << b) for b in range(WIDTH) if free >> b & 1)])
        return out


def _signed(x: int) -> int:
    return x - (1 << WIDTH) if x >> (WIDTH - 1) else x


def _at(values: list[int], i: str = "i") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col(i) + 1)


def _differ(a: str = "a.fp", b: str = "b.fp", mask: Column | None = None) -> Column:
    x = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(x if mask is None else x.bitwiseAND(mask))


def near_fingerprints(classes: DataFrame, bits: int = 2, hot: int = 2000) -> DataFrame:
    """a < b (long): all pairs of classes' fingerprints fp, distinct ones, that differ in 1 to so many bits; a pair may come more than once.

    hot: from how many fingerprints on that share a chain's equal part the chain is followed further first.
    """
    ring = Ring(bits)
    if bits == 0:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    entries = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(ring.m - 1))).alias("i"))
    entries = entries.select("i", "fp", F.col("fp").bitwiseAND(_at(ring.masks(0))).alias("part"))
    crowded = entries.groupBy("i", "part").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("i", "part")
    crowded = stored(crowded, "crowded")

    within = F.col("a.fp") < F.col("b.fp")
    for budget in range(1, bits):
        within = within & (_differ(mask=_at(ring.masks(budget), "a.i")) <= budget)
    within = within & (_differ() <= bits)

    few = entries.join(crowded, ["i", "part"], "left_anti")
    sparse = few.alias("a").join(few.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.part") == F.col("b.part")) & within)

    many = entries.join(crowded, ["i", "part"], "left_semi").select("i", "fp", F.col("fp").bitwiseAND(_at(ring.masks(1))).alias("part"))
    flips = F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in ring.flips())), F.col("i") + 1)
    tried = many.select("i", "fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("part")))).alias("part"))
    dense = tried.alias("a").join(many.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.part") == F.col("b.part")) & within)
    return sparse.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).unionByName(dense.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))


# ---- documents ---------------------------------------------------------------------


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2, hot: int = 2000) -> DataFrame:
    """Per document: key, fingerprint (16 lowercase hex digits), component_id (the least key of the documents linked to it, directly or not), n_links (long, the other fingerprints within so many bits of its own).

    Two documents link if their fingerprints differ in at most that many bits. Null and
    empty texts have fingerprint zero and are linked like any other. Rows with null keys take
    part; if a component has none but these, its id is null. Repeated rows stay, other
    columns play no part, whatever their names, and an empty table gives no rows.
    """
    docs = stored(fingerprints(df, key, text, words), "fingerprints")
    classes = stored(docs.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    links = stored(near_fingerprints(classes, bits, hot).distinct(), "near")
    roots = components(links)
    degrees = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    inside = classes.join(roots.withColumnsRenamed({"node": "fp"}), "fp").select("fp", "root", "id")
    grouped = inside.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    least = joined_by_hot_key(inside.select("fp", "root"), grouped, "root", "size").select("fp", "least")
    # a class that is linked has its component's least id, null as that may be; one that isn't, its own
    told = classes.join(least.withColumn("linked", F.lit(True)), "fp", "left").join(degrees, "fp", "left")
    told = told.select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies")
    told = stored(told, "told")
    for x in (classes, links, roots):
        discard(x)
    out = joined_by_hot_key(docs, told, "fp", "copies")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")

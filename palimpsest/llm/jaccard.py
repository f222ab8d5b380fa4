"""Near duplicates: documents whose sets of word n-grams reach a Jaccard similarity.

Documents with equal sets are one class; what follows deals with classes. Two
similar sets share a token within their prefixes under every global order of the
tokens, so a pair is a candidate only if it does so under each of three.

The first order puts a fixed share of the hash space first (its tokens are all that a class
sends out), within it rare tokens before common ones by their own counts over all
classes, and what is left by hash. Classes whose prefixes hold only tokens that no
other class has drop out at once. The other two orders are seeded hashes. The
first order's prefix tokens are joined; sizes and the parity of the tokens' bits, which bounds the
sets' difference from below, are conditions of that join. Pairs then meet the
other orders' prefixes and a parity as wide as their sets ask for, and only what is left
is verified, set against set.

Only components are asked for, so pairs within one component needn't be looked
at: in a few rounds each token's classes are tried against one of them, and only
then are all pairs of different components compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, hold, joined_by_hot_key, stored
from .components import components

#: Of the hash space, the share in percent, beyond the prefix's own, whose tokens come first.
SPARE_PERCENT = 10
#: 64-bit words of the parity that goes with every prefix token; bits of a class's own parity for each of its tokens.
PARITY_WORDS, PARITY_SHARE = 8, 0.5
STAR_ROUNDS = 2
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def token_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct word n-grams as sorted 64-bit hashes; A-Z are lower-cased, ASCII white space parts words."""
    hold("sets", lambda: None)
    for part in byte_slices(texts):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part, "")))
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.large_binary()).to_pylist()
        hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in names], np.uint64)
        real = np.array([bool(w) for w in names], bool)  # white space at an end leaves an empty word
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        there = real[codes] if len(names) else np.zeros(0, bool)
        at = np.concatenate([[0], np.cumsum(there)])[offsets]
        h = hashes[codes[there]] if len(names) else np.zeros(0, np.uint64)
        grams = _hashed(h, words)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            n = hi - lo
            s = np.sort(grams[lo : hi - words + 1] if n >= words else _hashed(h[lo:hi], n) if n else h[:0])
            fresh = s[1:] != s[:-1]
            yield s if fresh.all() else s[np.concatenate([[True], fresh])]


def _hashed(h: np.ndarray, words: int) -> np.ndarray:
    """Of each sequence of so many words."""
    n = max(0, len(h) - words + 1)
    out = np.full(n, words, np.uint64)
    for i in range(words):
        out = (out ^ h[i : i + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    return out


def prefix_length(n: int, percent: int) -> int:
    """At least one of a set's first so many tokens, under any global order, is among those of each similar set."""
    return n - -(-percent * n // 100) + 1 if n else 0


def ordered_prefix(tokens: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The places, as 32-bit numbers in order, of the first tokens under a seeded order."""
    x = (tokens ^ np.uint64(0x5851F42D4C957F2D * (order + 1) & 0xFFFFFFFFFFFFFFFF)) * _MIX[order]
    x = (x ^ x >> np.uint64(32)) * _MIX[0]
    p = prefix_length(len(tokens), percent)
    return np.sort(np.partition(x, p - 1)[:p] >> np.uint64(32)).astype("<u4") if p else np.zeros(0, "<u4")


def parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """For each bit, whether an odd number of tokens fall on it: two sets' bits differ in at most as many places as the sets do."""
    place = ((tokens * _MIX[1]) >> np.uint64(32)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def parity_bits(n: int) -> int:
    return max(PARITY_WORDS * 64, 1 << int(n * PARITY_SHARE).bit_length())


def _class(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else 0


def _described(df: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Per document: its key, th (its text's hash), n, class k (0 where the set is empty), sent (the tokens that come first), spare (how many beyond the prefix's length) and parity words."""
    share = np.uint64((100 - percent + SPARE_PERCENT) * (1 << 64) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k, sent, spare, bits = [], [], [], [], []
            for s in token_sets(batch.column(2), words):
                p = prefix_length(len(s), percent)
                m = max(p, int(np.searchsorted(s, share)))
                n.append(len(s))
                k.append(_class(s))
                sent.append(s[:m].view(np.int64))
                spare.append(m - p)
                bits.append(parity(s, PARITY_WORDS * 64).view("<i8"))
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n, k, spare)), pa.array(sent, pa.list_(pa.int64()))]
            columns += [pa.array([b[i] for b in bits], pa.int64()) for i in range(PARITY_WORDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "n", "k", "spare", "sent", *(f"w{i}" for i in range(PARITY_WORDS))])

    kind = df.schema[key].dataType.simpleString()
    parts = ", ".join(f"w{i} bigint" for i in range(PARITY_WORDS))
    return df.select(F.col(key), F.xxhash64(F.col(text)), F.col(text)).mapInArrow(run, f"id {kind}, th bigint, n bigint, k bigint, spare bigint, sent array<bigint>, {parts}")


def _places(classes: DataFrame) -> DataFrame:
    """k and token: the tokens of each class's prefix that another class has sent too.

    Tokens that no other class has sent stand first in the order, so only their number matters.
    """
    rows = classes.select("k", "spare", F.explode("sent").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    common = rows.join(counts, "token").groupBy("k", "spare").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    # of all that was sent, the last in order are the spare ones
    first = F.slice("common", F.lit(1), F.greatest(F.size("common") - F.col("spare").cast("int"), F.lit(0)))
    return common.select("k", F.explode(F.transform(first, lambda c: c["token"])).alias("token"))


class _Wanted:
    """A bitmap of hashes, broadcast: lets through every hash of a table and few others. It widens with the table, up to 16 MB; what passes beyond is only more to move."""

    def __init__(self, hashes: DataFrame, column: str):
        self.bits = min(27, max(16, hashes.count().bit_length() + 5))
        slot = F.shiftrightunsigned(F.col(column), 64 - self.bits)
        pieces = hashes.groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()
        # piece 0 holds the number 0 alone, the others 32,768 numbers each
        self.table = np.zeros(((1 << self.bits - 15) + 1) << 12, np.uint8)
        for piece, bits in zip(pieces.column(0).to_pylist(), pieces.column(1).to_pylist()):
            self.table[piece << 12 : piece + 1 << 12] = np.frombuffer(bits, np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        # a number's piece and its place within: those of bitmap_bucket_number and bitmap_bit_position
        piece = np.where(slot > 0, 1 + (slot - 1) // 32768, 0)
        place = np.where(slot > 0, (slot - 1) % 32768, 0)
        return (self.table[piece * 4096 + place // 8] >> (place % 8).astype(np.uint8) & 1).astype(bool)


def _sets(df: DataFrame, text: str, words: int, percent: int, hashes: DataFrame) -> DataFrame:
    """For the classes of texts with these hashes th: k, s (the set), w (its parity), p1 and p2 (the other orders' prefixes)."""
    wanted = df.sparkSession.sparkContext.broadcast(_Wanted(hashes, "th"))
    made = ("s", "w", "p1", "p2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = set()
        for batch in batches:
            some = np.flatnonzero(wanted.value.passes(batch.column(0).to_numpy(zero_copy_only=False)))
            rows = []
            for s in token_sets(batch.column(1).take(pa.array(some)), words):
                own = _class(s)
                if len(s) and own not in told:
                    told.add(own)
                    rows.append((own, s.tobytes(), parity(s, parity_bits(len(s))).tobytes(), *(ordered_prefix(s, order, percent).tobytes() for order in (1, 2))))
                if len(rows) >= 500:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["k", *made])

    found = df.select(F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("t")).mapInArrow(run, "k bigint, " + ", ".join(f"{c} binary" for c in made))
    return found.groupBy("k").agg(*(F.first(c).alias(c) for c in made))


def _may_match(a: str, b: str, percent: int) -> Column:
    """Sizes and parity words of the rows named a and b allow the similarity."""
    c = lambda side, name: F.col(f"{side}.{name}")
    differ = sum((F.bit_count(c(a, f"w{i}").bitwiseXOR(c(b, f"w{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
    sizes = (c(a, "n") * percent <= c(b, "n") * 100) & (c(b, "n") * percent <= c(a, "n") * 100)
    return sizes & (differ * (100 + percent) <= (c(a, "n") + c(b, "n")) * (100 - percent))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values of the shorter of two sorted arrays the other has."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _differ(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two parities differ; the wider one is folded to the other's bits."""
    if len(a) < len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(folded ^ b).sum())


def _kept(pairs: DataFrame, columns: list[str], test) -> DataFrame:
    """The pairs a, b whose columns, a's and then b's as bytes, pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(i) for i in range(2, len(columns) + 2)]
            keep = pa.array([test(*(memoryview(v[i].as_buffer()) for v in values)) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", *columns).mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs a, b that share prefix tokens under the other orders too, and of these those that reach the similarity."""
    narrow, wide = ["w", "p1", "p2"], ["s"]

    def both(of: DataFrame, columns: list[str]) -> DataFrame:
        named = lambda x: sets.select(F.col("k").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
        return of.join(named("b"), "b").join(named("a"), "a")

    def may(aw, a1, a2, bw, b1, b2) -> bool:
        if not all(_shared(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in ((a1, b1), (a2, b2))):
            return False
        # p is the prefix's length, n - ceil(percent * n / 100) + 1, and so n at most 100 * p / (100 - percent)
        most = 100 * (len(a1) // 4 + len(b1) // 4) // (100 - percent) if percent < 100 else 1 << 62
        return _differ(np.frombuffer(aw, np.uint8), np.frombuffer(bw, np.uint8)) * (100 + percent) <= most * (100 - percent)

    def reach(a, b) -> bool:
        s, t = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
        shared = _shared(s, t)
        return 100 * shared >= percent * (len(s) + len(t) - shared)

    some = _kept(both(pairs, narrow), [f"{x}_{c}" for x in "ab" for c in narrow], may)
    return _kept(both(some, wide), [f"{x}_{c}" for x in "ab" for c in wide], reach)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles (long), component_id (the least key of the documents linked to it, directly or not).

    A set holds the distinct sequences of that many words (A-Z lower-cased, cut at
    ASCII white space); a shorter text is one sequence; without words it is empty and linked
    with nothing: its component is its own key. Two documents link if 100 times their
    sets' intersection is at least percent times their union. Null texts are empty.
    Rows with null keys take part; if a component has none but these, its id is null.
    Repeated rows stay, other columns play no part, and an empty table gives no rows.
    Sets are compared by 64-bit hashes of their tokens, classes by one of their sets.
    """
    bits = [f"w{i}" for i in range(PARITY_WORDS)]
    shingled = stored(_described(df, key, text, words, percent), "shingled")
    own = ("n", "spare", *bits, "sent")
    classes = stored(shingled.where("n > 0").groupBy("k").agg(*(F.first(c).alias(c) for c in own), F.min("th").alias("th"), F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    docs = stored(shingled.select("id", "n", "k"), "documents")
    discard(shingled)
    common = stored(_places(classes), "prefixes")
    split = common.groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("token")
    places = stored(common.join(split, "token", "left_semi").join(classes.select("k", "n", *bits), "k"), "places")
    discard(common)
    heads = stored(classes.select("k", "th", "id", "copies"), "heads")
    discard(classes)
    sets = stored(_sets(df, text, words, percent, places.select("k").distinct().join(heads, "k").select("th")), "sets")

    spark = df.sparkSession
    links = spark.createDataFrame([], "a bigint, b bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    for r in range(STAR_ROUNDS + 1):
        named = places.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("c", F.coalesce("root", "k")).drop("root")
        split = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
        named = stored(named.join(split, "token", "left_semi"), "named")
        if named.isEmpty():
            discard(named)
            break
        if r < STAR_ROUNDS:
            one = F.min_by(F.struct("k", "n", "c", *bits), F.struct(F.xxhash64("k", "token", F.lit(r)), "k"))
            centre = named.groupBy("token").agg(one.alias("o")).select("token", "o.*")
        else:
            centre = named
        differ = (F.col("a.token") == F.col("b.token")) & (F.col("a.c") != F.col("b.c"))
        if r == STAR_ROUNDS:
            differ = differ & (F.col("a.k") < F.col("b.k"))
        near = named.alias("a").join(centre.alias("b"), differ & _may_match("a", "b", percent))
        pairs = stored(near.select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b")).distinct(), "pairs")
        last, links = links, stored(links.unionByName(_verified(pairs, sets, percent)), "links")
        for x in (last, pairs, named):
            discard(x)
        last, roots = roots, components(links)
        discard(last)
    for x in (places, sets, links):
        discard(x)
    # a class's least key, and from these a component's, which goes back to the classes and then to the documents
    inside = heads.join(roots.withColumnRenamed("node", "k"), "k")
    least = stored(inside.groupBy("root").agg(F.min("id").alias("least")).join(inside.select("root", "k", "copies"), "root").select("k", "least", "copies"), "least")
    linked = joined_by_hot_key(docs.where("n > 0"), heads.select("k", "id", "copies").join(least.select("k", "least"), "k", "left").select("k", F.coalesce("least", "id").alias("component_id"), "copies"), "k", "copies")
    alone = docs.where("n = 0").withColumn("component_id", F.col("id"))
    return linked.select("id", "n", "component_id").unionByName(alone.select("id", "n", "component_id")).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")

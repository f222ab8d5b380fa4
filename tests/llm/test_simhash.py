import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from palimpsest.llm.queries import QUERIES
from palimpsest.llm.simhash import Ring, fingerprints, near_duplicates, near_fingerprints


def by_hand(text, size):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits):
    """Per place the least place reachable."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components_equal_plain_loops(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)] + ["É", "é", "ABC", "漢字", "x\x1cy", "x\xa0y"]
    rows = []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 30, 400]))]
        for _ in range(rnd.choice([1, 2, 6])):
            w = list(base)
            if rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows), rnd.choice([" ", "\n", "\t "]).join(w)))
    long = " ".join(rnd.choice(vocabulary) for _ in range(150_000))
    rows += [(1000, ""), (1001, None), (1002, " \n"), (None, rows[0][1]), (None, "all alone here"), (5, rows[5][1]), (5, rows[5][1]), (1003, long), (1004, long + " w1")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id bigint, text string, fp int, component_id string").repartition(3)
    prints = [by_hand(t, 3) for _, t in rows]
    root = groups(prints, 2)
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    want = Counter((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, root))
    out = near_duplicates(df)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()) == want
    assert near_duplicates(df.where("false")).count() == 0


def test_chains_lose_no_pair_and_crowded_parts_are_followed_further(spark):
    rnd = random.Random(4)
    prints = set()
    for _ in range(6):  # clouds around common centres, so that many share the same segments
        centre = rnd.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rnd.randrange(5)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    prints |= {rnd.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    for bits in (1, 2, 3, 5):
        want = {frozenset((p, q)) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= bits}
        for hot in (0, 7, 2000):
            got = near_fingerprints(df, bits, hot).collect()
            assert {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in got} == want


def test_crowded_parts_meet_in_few_places(spark):
    """A part shared by 5,000 fingerprints makes candidates by equal longer chains, not all pairs."""
    rnd = random.Random(5)
    low = list({rnd.getrandbits(38) for _ in range(5000)})
    df = spark.createDataFrame([(x,) for x in low], "fp bigint")
    ring = Ring(2)
    chain = max(ring.masks(1), key=lambda m: (m & (1 << 38) - 1).bit_count())
    flips = [f for f in ring.flips()[ring.masks(1).index(chain)]]
    places = Counter(x & chain for x in low)
    met = sum(places[(x & chain) ^ f] for x in low for f in flips)
    assert met < 20 * len(low)
    want = 0
    known = set(low)
    for x in low:
        want += sum((x ^ 1 << a) in known for a in range(38)) + sum((x ^ 1 << a ^ 1 << b) in known for a in range(38) for b in range(a))
    assert near_fingerprints(df, 2, 100).distinct().count() == want // 2


def test_the_query_reads_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_simhash"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [by_hand(r.text, 3) for r in rows]
    ids = [r.doc_id for r in rows]
    assert {d: (got[d].fingerprint, got[d].component_id) for d in ids} == {d: (f"{p:016x}", ids[r]) for d, p, r in zip(ids, prints, groups(prints, 2))}
    assert fingerprints(docs.select("doc_id", F.col("text"))).count() == len(ids)

import random
import re
from collections import defaultdict

from palimpsest.llm.components import components
from palimpsest.llm.jaccard import near_duplicates


def by_hand(rows, words, percent):
    sets, n = {}, {}
    for i, (_, text) in enumerate(rows):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x20\x09-\x0d]+", text or "")]
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for t in s:
            index[t].append(i)
    pairs = {(a, b) for v in index.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def test_same_components_as_all_pairs(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([2, 5, 40, 120]))]
        for _ in range(rnd.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((i, " ".join(w)))
            i += 1
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for _ in range(40):
        rows.append((i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(50))) + "\n" + passage))
        i += 1
    rows += [(i, "One Two É"), (i + 1, "one two É"), (i + 2, "one two é"), (i + 3, ""), (i + 4, None), (i + 5, " "), (None, "One Two É"), (None, "alone here now"), (i + 6, rows[0][1]), (i + 6, rows[0][1])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, 7, "c") for d, t in rows], "doc_id bigint, text string, n int, k string").repartition(3)
    for words, percent in ((3, 90), (5, 80)):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(df, words=words, percent=percent).collect())
        want = by_hand(rows, words, percent)
        # documents without words stand alone under their own id
        assert [g for g in got if g[1]] == [w for w in want if w[1]]
        assert all(d == c for d, n, c in got if not n)
        assert len(got) == len(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 999), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1000] == got[999] == 999


def test_hot_groups_and_very_long_texts(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(vocabulary) for _ in range(80)]
    rows = [(i, " ".join(base)) for i in range(4000)] + [(i, None if i % 2 else " \n") for i in range(4000, 8000)]
    # a hub: near copies that link with the copies, and a chain that hangs on by one of them
    chain = list(base)
    for i in range(300):
        w = list(base)
        w[rnd.randrange(80)] = f"new{i}"
        rows.append((8000 + i, " ".join(w)))
    for i in range(12):
        chain[i * 6] = f"step{i}"
        rows.append((9000 + i, " ".join(chain)))
    long = [rnd.choice(vocabulary) for _ in range(300_000)]
    rows += [(9100, " ".join(long)), (9101, " ".join([*long[:150_000], "other", *long[150_000:]])), (9102, " ".join(long[:200_000])), (9103, "x" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, words=3, percent=90).collect()}
    assert len(got) == len(rows)
    assert all(got[i][1] == 0 for i in range(4000)) and all(got[i] == (0, i) for i in range(4000, 8000))
    for d, n, c in by_hand([r for r in rows if r[0] >= 8000 or r[0] == 0], 3, 90):
        assert got[int(d)] == (n, int(c)), d
    assert got[9101][1] == 9100 and got[9102][1] == 9102 and got[9103] == (1, 9103)


def test_components_of_a_hub(spark):
    links = [(5, i) for i in range(100, 5100)] + [(i, i + 10_000) for i in range(100, 1100)] + [(2, 5), (70_000, 80_000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert len(got) == 6004 and all(c == (2 if n < 70_000 else 70_000) for n, c in got.items())

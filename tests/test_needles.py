import random

from palimpsest.operators.needles import counted, occurrences


def by_hand(rows, needles):
    out = []
    for k, t in rows:
        data = (t or "").encode()
        for n in {n for n in needles if n}:
            b, at = n.encode(), -1
            while (at := data.find(b, at + 1)) >= 0:
                out.append((k, n, at))
    return sorted(out, key=repr)


def test_every_occurrence_overlaps_too(spark):
    rnd = random.Random(16)
    word = lambda n: "".join(rnd.choice("ab é漢") for _ in range(n))
    needles = ["aa", "a", "aba", "", None, "a", "https://one.example", "https://two.example", "漢", "zzz", *(word(rnd.randrange(1, 25)) for _ in range(200))]
    rows = [(i, "".join(rnd.choice(needles) or "" for _ in range(rnd.randrange(12)))) for i in range(80)] + [(100, None), (101, ""), (None, "aaaa"), (102, "https://one.exampl"), (102, "xx https://two.example")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(3)
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    found = occurrences(df, "k", "text", asked)
    assert sorted(((r.k, r.needle, r["at"]) for r in found.collect()), key=repr) == by_hand(rows, needles)
    assert {(r.n, r["first"]) for r in counted(found, "k").where("k IS NULL AND needle = 'aa'").collect()} == {(3, 0)}
    assert occurrences(df, "k", "text", asked.where("false")).count() == occurrences(df.where("false"), "k", "text", asked).count() == 0


def test_a_hundred_thousand_needles(spark):
    rnd = random.Random(17)
    needles = [f"prefix/{i:06d}/{rnd.getrandbits(32):08x}" for i in range(100_000)]
    rows = [(i, " ".join(rnd.sample(needles, 5)) + f" prefix/{i:06d}/nothing") for i in range(300)]
    df, asked = spark.createDataFrame(rows, "k int, text string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    got = sorted((r.k, r.needle, r["at"]) for r in occurrences(df, "k", "text", asked).collect())
    assert got == sorted((k, n, t.index(n)) for k, t in rows for n in t.split() if not n.endswith("nothing"))

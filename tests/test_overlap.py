import random
from collections import Counter

from pyspark.sql import functions as F

from palimpsest.operators import context, unnamed


def by_hand(old, new, near):
    """The greatest overlap of each old row, over all pairs."""
    freq = Counter((g, t) for g, _, ts in new for t in ts)
    out = {}
    for g, i, a in old:
        best = []
        for h, j, b in new:
            if g == h and a.keys() & b.keys():
                score = sum(min(a[t], b[t]) / freq[g, t] for t in a.keys() & b.keys()) + (0.001 / (1 + abs(i - j)) if near else 0)
                best.append((-round(score, 6), j))
        if best:
            s, j = min(best)
            out[g, i] = (j, -s)
    return out


def frame(spark, rows, key):
    return spark.createDataFrame([(g, i, t, n) for g, i, ts in rows for t, n in ts.items()], f"g string, {key} long, token string, n long")


def test_the_best_overlap_is_that_of_all_pairs(spark):
    rnd = random.Random(15)
    for skew in (1, 3):
        words = [f"t{int(rnd.random() ** skew * 60)}" for _ in range(400)]
        side = lambda n: [(rnd.choice("gh"), i, Counter(rnd.choice(words) for _ in range(rnd.randrange(1, 8)))) for i in range(n)]  # noqa: E731, B023
        old, new = side(60), side(60)
        for near in (False, True):
            for first in (2, 16):
                got = context.best_overlap(frame(spark, old, "o"), frame(spark, new, "w"), ["g"], "o", "w", near, first=first).collect()
                want = by_hand(old, new, near)
                assert {(r.g, r.o): r.w for r in got} == {k: j for k, (j, _) in want.items()}
                assert all(abs(r.score - want[r.g, r.o][1]) < 2e-6 for r in got)


def test_a_token_that_all_rows_hold_makes_no_pairs(spark, monkeypatch):
    rows = [("g", i, Counter({"all": 3, f"own{i}": 1, f"few{i // 4}": 1})) for i in range(1000)]
    made = []
    plain = context.staged
    monkeypatch.setattr(context, "staged", lambda df: made.append((set(df.columns), plain(df))) or made[-1][1])
    got = context.best_overlap(frame(spark, rows, "o"), frame(spark, rows, "w"), ["g"], "o", "w")
    assert got.where("o <> w").count() == 0 and got.count() == 1000
    assert sum(df.count() for c, df in made if "part" in c) < 10 * 1000


LINES = [
    ("old", "iLocal_5.f_10 = 94;"), ("old", "if (iLocal_5.f_12 != 94) {"), ("old", "switch (iLocal_5.f_40) {"), ("old", 'AREA::CALL(iLocal_5.f_44, "some");'), ("old", "iLocal_5.f_300 = 7;"), ("old", "iLocal_5.f_10 = 1;"), ("old", "iLocal_6.f_10 = 2;"), ("old", "iLocal_6.f_20 = 3;"),
    ("new", "iLocal_8.f_13 = 94;"), ("new", "if (iLocal_8.f_15 != 94) {"), ("new", "switch (iLocal_8.f_43) {"), ("new", 'AREA::CALL(iLocal_8.f_47, "some");'), ("new", "iLocal_8.f_9000 = 7;"), ("new", "iLocal_8.f_13 = 1;"), ("new", "iLocal_9.f_14 = 2;"), ("new", "iLocal_9.f_24 = 3;"),
]


def test_fields_find_their_container(spark):
    lines = spark.createDataFrame([(v, "f", i, x) for i, (v, x) in enumerate(LINES)], "version string, file string, line_no long, line string")
    containers = spark.createDataFrame([("f", 6, 9, 0), ("f", 5, 8, 1)], "file string, container long, new_container long, ord int")
    entries = spark.createDataFrame([(f"F{n}", "f", n) for n in (10, 20, 41, 300, 11, 400)], "name string, file string, value long")
    got = {r["name"]: (r.container, r.new_value, r.method) for r in unnamed.resolve_struct_fields(entries, lines, containers).collect()}
    # twice in 5, once in 6; in 6 alone; nowhere, but between fields of 5; marked but not aligned; between fields of both; beyond all
    assert got == {"F10": (5, 13, "agreed"), "F20": (6, 24, "agreed"), "F41": (5, 44, "step"), "F300": (5, 9000, "context"), "F11": (6, 15, "step"), "F400": (None, None, None)}


def test_switches_over_fields_and_calls(spark):
    rows = [("old", 1, "switch (iLocal_5.f_2) {"), ("old", 2, 'say("alpha");'), ("old", 10, "switch (func(iLocal_7)) {"), ("old", 11, 'say("beta");'), ("new", 1, "switch (iLocal_9) {"), ("new", 2, 'say("alpha");'), ("new", 10, "switch (func(iLocal_3, iLocal_12)) {"), ("new", 11, 'say("beta");')]
    lines = spark.createDataFrame([(v, "f", i * 10, x) for v, i, x in rows], "version string, file string, line_no long, line string")
    entries = spark.createDataFrame([("A", 5), ("B", 7)], "name string, value long")
    got = {r["name"]: r.new_value for r in unnamed.by_switch(entries, lines, unnamed.anchor_lines(lines)).collect()}
    assert got == {"A": 9, "B": 12}


def test_merged_confidence_is_at_most_one_and_reasons_keep_their_order(spark):
    rows = [("k", "v", 0.99, r, 0, i) for i, r in enumerate(["z", "a", "z", "m"])]
    df = spark.createDataFrame(rows, "name string, value string, confidence double, reason string, source_rank int, place int")
    (r,) = context.merge_candidates(df, "name", "value").collect()
    assert (r.confidence, r.reason, r.mentions) == (1.0, "z; a; m", 4)
    assert context.merge_candidates(df.where(F.col("reason") == "m"), "name", "value").first().confidence == 0.99


def test_pairs_that_nothing_rare_decides_are_not_written(spark, monkeypatch):
    """Rows of frequent tokens meet in blocks, whose copies are the same as one block."""
    rnd = random.Random(16)
    side = lambda n: [(rnd.choice("gh"), i, Counter(rnd.choice(range(30)) for _ in range(6))) for i in range(n)]
    rows = [(g, i, Counter({f"t{t}": n for t, n in c.items()})) for g, i, c in side(300)]
    written = []
    for name in ("staged", "stored"):
        monkeypatch.setattr(context, name, lambda df, plain=getattr(context, name): written.append(plain(df)) or written[-1])
    got = context.best_overlap(frame(spark, rows, "o"), frame(spark, rows[:200], "w"), ["g"], "o", "w").collect()
    assert {(r.g, r.o): r.w for r in got} == {k: j for k, (j, _) in by_hand(rows, rows[:200], False).items()}
    assert sum(df.count() for df in written) < 3000
    for block in (40, 400):
        again = context.best_overlap(frame(spark, rows, "o"), frame(spark, rows[:200], "w"), ["g"], "o", "w", block=block).collect()
        assert sorted(again) == sorted(got)


def test_lines_are_read_once_for_all_strategies_that_find_nothing(spark):
    """A line is not parsed anew for each strategy and side; what they tell stays."""
    rows = [(v, "f", 100 * i + j, line) for v, s in (("old", 0), ("new", 1000)) for i in range(40) for j, line in enumerate((f'say("tag{i}");', "", f"x = iLocal_{i + s};") if i % 2 else (f'if (iLocal_{i + s}) say("tag{i}");',))]
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    kinds = "version string, file string, line_no long, line string"
    lines = spark.createDataFrame(rows, kinds).mapInPandas(counted, kinds)
    told = unnamed.resolve_variables(spark.createDataFrame([(f"V_{i}", i) for i in range(41)], "name string, value long"), lines).collect()
    want = {f"V_{i}": (i + 1000, "window" if i % 2 else "same_line") for i in range(40)} | {"V_40": (None, None)}
    assert {r.name: (r.new_value, r.method) for r in told} == want and read.value <= 8 * len(rows)

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from palimpsest.operators import fuzzy
from palimpsest.operators.similarity import similar_pairs

VALUE = re.compile(r"\b(?:Root|[a-z]?Local)_[0-9]+(?:\[[^\]]*\]|\.f_[0-9]+)*")
ANCHORS = [r"\bRoot_[0-9]+(?:\.f_[0-9]+)+", r"\b[a-z]?Local_[0-9]+", r"\b[A-Z_]{4,}::[A-Z_]+\b", r'"[^"]{2,32}"']
RANKS = ["exact path still present", "same path shape in same file", "context match in same file", "exact local token still present", "same local shape in same file"]


def prefixes(v):
    parts = re.findall(r"^\w+|\[[^\]]*\]|\.f_[0-9]+", v)
    return ["".join(parts[: i + 1]) for i in range(len(parts))]


def shape(v):
    return re.sub(r"\[[^\]/]+\]", "[]", re.sub(r"\[[^\]/]*(/[^\]]*)\]", r"[\1]", v))


def signature(v):
    return re.sub(r"\.f\b", ".f", re.sub(r"\[[^\]]+\]", "[idx]", re.sub(r"_[0-9]+", "", v)))


def normal(line, value):
    return re.sub(r"\s+", " ", re.sub(r"(func_|Root_|Local_|\.f_|Var)[0-9]+", r"\1N", line.replace(value, "__TARGET__"))).strip()


def ratio(a, b):
    return round(SequenceMatcher(None, a, b).ratio(), 6)


def canonical(v):
    letters = iter("ijklmn")
    return re.sub(r"\[[A-Za-z_]\w*\s*(/\*[0-9]+\*/)?\]", lambda m: f"[{next(letters)}{' ' + m[1] if m[1] else ''}]", v)


def root(v):
    return int(re.search(r"_([0-9]+)", v)[1])


def by_hand(entries, old, new, semantic, preferred):
    """old, new: file to lines; semantic: (version, file, line_no) to path; preferred: name to files. One entry after the other, in plain loops."""
    old, new = ({f: [VALUE.sub(lambda m: canonical(m[0]), line) for line in ls] for f, ls in c.items()} for c in (old, new))
    entries = [(n, canonical(v)) for n, v in entries]
    kind = lambda v: "local" if re.match(r"[a-z]?Local_", v) else "global"
    tokens = lambda lines: list(dict.fromkeys(t for p in ANCHORS for t in re.findall(p, "\n".join(lines))))
    around = lambda lines, i, r: lines[max(0, i - r) : i + r + 1]
    out = []
    for name, value in entries:
        matches = [(f, i) for f in sorted(old) for i, line in enumerate(old[f]) if any(value in prefixes(m) for m in VALUE.findall(line))]
        with_path = [m for m in matches if semantic.get(("old", m[0], m[1] + 1))]
        if with_path:
            matches = with_path
        elif len(matches) > 12:
            seen, ranked = set(), []
            for f, i in matches:
                form = (f, normal(old[f][i], value))
                if f in new and form not in seen:
                    seen.add(form)
                    ranked.append((len([t for t in tokens(around(old[f], i, 6)) if t != value]), f, -i))
            matches = [(f, -i) for _, f, i in sorted(ranked, reverse=True)[:12]] if ranked else matches[:12]
        found = []
        for rank, (f, i) in enumerate(matches):
            path = semantic.get(("old", f, i + 1))
            for target in list(dict.fromkeys(x for x in [f, *preferred.get(name, [])] if x in new)):
                lines = new[target]
                told = [(VALUE.findall(line)[-1], 1.0, f"semantic path match: {'/'.join(path)}", target, k + 1) for k, line in enumerate(lines) if semantic.get(("new", target, k + 1)) == path and VALUE.findall(line)] if path else []
                shapes = []
                for k, line in enumerate(lines):
                    hit = next((p for m in VALUE.findall(line) for p in prefixes(m) if shape(p) == shape(value)), None)
                    if hit:
                        local, same = kind(value) == "local", hit == value
                        shapes.append((hit, (0.88 if same else 0.76) if local else (0.97 if same else 0.8), RANKS[(3 if same else 4) if local else (0 if same else 1)], target, k + 1))
                if told:
                    found += [(*c, rank) for c in told] + [(*c, rank) for c in shapes if c[0] == value]
                    break
                found += [(*c, rank) for c in shapes]
                mine = old[f][i]
                anchors = [t for t in tokens(around(old[f], i, 6)) if t != value]
                assigns = lambda line: "=" in line and "==" not in line
                for k, line in enumerate(lines):
                    if assigns(mine) and not assigns(line) or mine.strip().startswith("return ") and not line.strip().startswith("return "):
                        continue
                    hits = len(set(anchors) & set(tokens(around(lines, k, 6))))
                    if anchors and not hits:
                        continue
                    for v in dict.fromkeys(m for m in VALUE.findall(line) if kind(m) == kind(value)):
                        if not re.search(r"\[|\.f_", value) and re.search(r"\[|\.f_", v):
                            continue
                        equal = signature(v) == signature(value)
                        own = ratio(normal(mine, value), normal(line, v))
                        if own < 0.58 and not equal:
                            continue
                        window = lambda r: ratio("\n".join(normal(x, value) for x in around(old[f], i, r)), "\n".join(normal(x, v) for x in around(lines, k, r)))  # noqa: E731, B023
                        far = abs(root(value) - root(v))
                        near = 0.18 if far == 0 else 0.16 if far <= 5000 else 0.1 if far <= 50000 else 0.05 if far <= 250000 else 0.0
                        bonus = (0.08 if equal else 0.0) + (0.04 if v.count(".f_") == value.count(".f_") else 0.0) + 0.12 * (hits / max(1, len(anchors))) + near
                        score = min(bonus + 0.25 * own + 0.45 * window(2) + 0.2 * window(6), 0.99)
                        if round(score, 6) >= 0.72:
                            found.append((v, round(score, 6), RANKS[2], target, k + 1, rank))
        merged = []
        for v in dict.fromkeys(c[0] for c in found):
            own = [c for c in found if c[0] == v]
            best = max(own, key=lambda c: c[1])
            reason = "; ".join(dict.fromkeys(c[2] for c in own))
            trust = 0 if reason.startswith("semantic") else RANKS.index(reason) + 1 if reason in RANKS else 6
            merged.append((trust, min(c[5] for c in own), -round(min(best[1] + 0.02 * min(len(own) - 1, 3), 1.0), 6), abs(root(v) - root(value)), v, reason, len(own), best[3], best[4]))
        out += [(name, value, v, -c, reason, s, m, f, n, k + 1) for k, (_, s, c, _, v, reason, m, f, n) in enumerate(sorted(merged))]
    return out


def corpora():
    rnd = random.Random(12)
    old, new, semantic = {}, {}, {}
    for f in range(8):
        a = []
        for i in range(30):
            v = rnd.choice([f"Root_{rnd.choice([100, 120, 9000])}.f_{rnd.randrange(3)}", f"Root_{100 + f}", f"Root_7{f}[i /*9*/].f_{rnd.randrange(2)}", f"Root_55[j].f_{f}.f_2", f"iLocal_{rnd.randrange(4)}"])
            a.append(rnd.choice([f"  {v} = {i % 4};", f"return {v};", f"if ({v} == 3) {{", f'call("key_{rnd.randrange(3)}", {v});', f"AREA::SET_{'ABCD'[i % 4]}({v}, iVar{i});", f"    func_{i}();", "}"]))
        b = [re.sub(r"Root_([0-9]+)", lambda m: f"Root_{int(m[1]) + (40 if f % 2 else 0)}", line) for line in a]
        for _ in range(12):
            k = rnd.randrange(len(b))
            b[k] = rnd.choice([b[k] + " // x", "", b[k].replace("[i", "[k"), b[k].replace("[j]", "[3]").replace("[i ", "[2 "), b[k].replace(".f_1", ".f_2")])
        old[f"file{f}"] = a
        if f != 7:
            new[f"file{f}"] = b
        for i in range(0, 30, 7):
            semantic[("old", f"file{f}", i + 1)] = ("top", f"p{i % 3}")
            if f != 7:
                semantic[("new", f"file{f}", i + 2)] = ("top", f"p{i % 3}")
    values = sorted({p for a in old.values() for line in a for m in VALUE.findall(line) for p in prefixes(m)})
    entries = [(f"KEY_{i}", v) for i, v in enumerate(values)]
    preferred = {f"KEY_{i}": [f"file{(i + 1) % 8}", f"file{i % 8}"] for i in range(0, len(values), 3)}
    return entries, old, new, semantic, preferred


def run(spark, entries, old, new, semantic, preferred):
    lines = spark.createDataFrame([(v, f, i + 1, line) for v, c in (("old", old), ("new", new)) for f, ls in c.items() for i, line in enumerate(ls)], "version string, file string, line_no long, line string")
    paths = spark.createDataFrame([(*k, list(p)) for k, p in semantic.items()], "version string, file string, line_no long, path array<string>")
    pref = spark.createDataFrame([(n, f, i) for n, fs in preferred.items() for i, f in enumerate(fs)], "name string, file string, ord int")
    return fuzzy.resolve(spark.createDataFrame(entries, "name string, value string"), lines, paths, pref)


def test_equals_one_entry_after_the_other(spark):
    """Paths, shapes and contexts, preferred files, pruned matches, all bounds: the same candidates in the same order."""
    given = corpora()
    columns = ["name", "old_value", "new_value", "confidence", "reason", "source_rank", "mentions", "file", "line_no", "rank"]
    got = sorted(tuple(r[c] for c in columns) for r in run(spark, *given).collect())
    want = sorted(by_hand(*given))
    assert [(*g[:3], *g[4:]) for g in got] == [(*w[:3], *w[4:]) for w in want]
    assert all(abs(g[3] - w[3]) < 3e-6 for g, w in zip(got, want))  # sums of rounded numbers
    reasons = {r[4] for r in want}
    assert all(any(x in r for r in reasons) for x in (*RANKS[:3], "semantic", ";"))
    assert any(r[3] == 1.0 and not r[4].startswith("semantic") for r in want)  # the cap decides


def test_contexts_are_made_of_asked_files_alone(spark, monkeypatch):
    """A match that its path settles asks for no context; one without a path asks for that of its own file and kind."""
    seen = []
    told = fuzzy.context_scores
    monkeypatch.setattr(fuzzy, "context_scores", lambda old, new, *rest: seen.append((old.count(), new.count())) or told(old, new, *rest))
    text = {f"f{i}": [f"a(Root_{i}.f_1);", f"b(Root_{i}.f_2);", f"c(iLocal_{i});"] for i in range(6)}
    semantic = {(v, "f0", 1): ("top",) for v in ("old", "new")}
    given = [("A", "Root_0.f_1")], text, text, semantic, {}
    assert [(r.new_value, r.reason) for r in run(spark, *given).collect()] == [("Root_0.f_1", "semantic path match: top; exact path still present")]
    given = [("A", "Root_0.f_1"), ("B", "Root_3.f_2")], text, text, semantic, {}
    assert {(r["name"], r.new_value) for r in run(spark, *given).collect()} >= {("A", "Root_0.f_1"), ("B", "Root_3.f_2")}
    assert seen == [(0, 0), (1, 2)]


def test_what_may_be_written_without_review(spark):
    rows = [("Root_5", "Root_9", "context match in same file", 0.996), ("Root_5", "Root_9", "context match in same file", 0.99), ("Root_5", "Root_9000", "context match in same file", 0.999), ("Root_5.f_1", "Root_6.f_1", "context match in same file", 0.999), ("Root_5.f_1", "Root_5.f_1", "exact path still present", 0.9), ("a", "b", "semantic path match: x", 0.1), ("a", "b", "verified special", 0.99), ("a", "b", "verified special", 0.98)]
    df = spark.createDataFrame(rows, "a string, b string, reason string, confidence double")
    told = df.select(fuzzy.safe(F.col("a"), F.col("b"), F.col("reason"), F.col("confidence"), [("verified special", 0.99)])).collect()
    assert [r[0] for r in told] == [True, False, False, False, True, True, True, False]


def test_similar_pairs_are_all_pairs_that_reach_the_similarity(spark):
    rnd = random.Random(13)
    texts = lambda n: ["".join(rnd.choice("abcdeeeé  漢") for _ in range(rnd.randrange(0, 12))) for _ in range(n)]
    a = [(rnd.choice("xy"), i, t) for i, t in enumerate(texts(60))] + [("x", 100, None), ("x", 101, "abcde"), ("x", 102, "abcde")]
    b = [(rnd.choice("xy"), i, t) for i, t in enumerate(texts(60))] + [("x", 100, None), ("x", 101, "abcdf")]
    schema = "g string, id int, text string"
    for least in (0.58, 0.8, 1.0):
        got = {(r.g, r.a_id, r.b_id): r.similarity for r in similar_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["g"], least).collect()}
        assert got == {(g, i, j): ratio(s, t) for g, i, s in a for h, j, t in b if g == h and s and t and ratio(s, t) >= least}


def test_few_pairs_are_matched(spark, monkeypatch):
    """Lines of a thousand names: lengths and rare characters leave few pairs of a million."""
    from palimpsest.operators import similarity

    rnd = random.Random(14)
    rows = [("g", i, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(5, 40)))) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id int, text string")
    asked = []
    monkeypatch.setattr(similarity, "verified", lambda pairs, least: asked.append(pairs.count()) or pairs.withColumn("similarity", F.lit(1.0)))
    similar_pairs(df, df, ["g"], 0.9).count()
    assert asked[0] < 0.1 * 400 * 400


def test_the_query_equals_plain_loops(spark):
    from palimpsest.plans import deciding

    entries, lines, semantic, preferred = deciding.corpus(spark, "/root/testdata/sf0.001")
    sides = {"old": {}, "new": {}}
    for r in lines.orderBy("line_no").collect():
        sides[r.version].setdefault(r.file, []).append(r.line)
    pref = {}
    for r in preferred.collect():
        pref.setdefault(r["name"], []).append(r.file)
    want = sorted(by_hand([tuple(r) for r in entries.collect()], sides["old"], sides["new"], {(r.version, r.file, r.line_no): tuple(r.path) for r in semantic.collect()}, pref))
    columns = ["name", "old_value", "new_value", "confidence", "reason", "source_rank", "mentions", "file", "line_no", "rank"]
    got = sorted(tuple(r[c] for c in columns) for r in deciding.fuzzy_resolve(spark, "/root/testdata/sf0.001").collect())
    assert [(*g[:3], *g[4:]) for g in got] == [(*w[:3], *w[4:]) for w in want] and len(got) > 50
    assert all(abs(g[3] - w[3]) < 3e-6 for g, w in zip(got, want))

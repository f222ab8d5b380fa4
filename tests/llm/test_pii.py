import hashlib
import random
import re
from collections import Counter, defaultdict

from palimpsest.llm.pii import find_personal_data
from palimpsest.llm.queries import op9_personal_data

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": "[0-9]([\x20-]?[0-9])+",
    "phone": "\\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        s = 0
        for i, d in enumerate(reversed(digits)):
            n = int(d) * (1 + i % 2)
            s += n - 9 if n > 9 else n
        return 12 <= len(digits) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_hand(text):
    found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(FORMS.items()) for m in re.finditer(p, text or "") if passes(k, m[0]))
    return [sum(f[3] == k for f in found) for k in FORMS], ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


def check(rows, got):
    for r in got:
        counts, spans = by_hand(rows[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, (rows[r.doc_id][:200], r)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), (rows[r.doc_id][:200], spans, r.spans)
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_base_entities(spark):
    rnd = random.Random(8)
    texts = ["", None, "a@b.c_d@e.f", "x@y..z q@w.e.", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (017) 555-7713.", "++1 2345678901", "é🎉 a@b.co 漢 1.2.3.4", "1" * 30_000, "a" * 30_000 + "@", "1." * 9000, "+1" + " " * 9000 + "2", "a@b" + ".c" * 5000]
    texts += ["".join(rnd.choice(["1", "22", "+", "4111111111111111", ".", "-", " ", "(", "a", "@", "é", "b.c", "255", "\n", "\x01"]) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    rows = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows.items()] + [(0, "", "x"), (0, "", "x")], "doc_id bigint, text string, spans string")
    got = find_personal_data(df).collect()
    assert len(got) == len(rows) + 2
    check(rows, got)
    assert find_personal_data(df.limit(0)).count() == 0
    assert [r.spans for r in find_personal_data(spark.createDataFrame([(None, "a@b.c")], "doc_id bigint, text string")).collect()] == ["email:0:5"]


def normal(word):
    if re.search("[0-9@]", word):
        return ""
    return (re.sub(r"^[^\w\s=]+|[^\w\s=]+$", "", word) or word).lower()


def bootstrapped(rows, min_confidence=0.8, min_seeds=5, damping=0.9):
    """The spans of kind id by document, by plain loops."""
    instances, words = [], Counter()
    for i, text in rows.items():
        tokens = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text or "")]
        words.update(filter(None, (normal(t[2]) for t in tokens)))
        base = [(int(a), int(b), list(FORMS).index(k)) for k, a, b in (x.split(":") for x in by_hand(text)[1].split(",") if x)]
        at = {n: t for n, t in enumerate(tokens) if re.search("[0-9@]", t[2])}
        around = lambda n: (normal(tokens[n][2]) if 0 <= n < len(tokens) else "")
        for a, b, kind in base:
            held = [n for n, t in at.items() if t[0] < b and a < t[1]]
            instances.append((i, a, b, text[a:b], kind, around(held[0] - 1), around(held[-1] + 1)))
        for n, (a, b, value) in at.items():
            if not any(x < b and a < y for x, y, _ in base):
                instances.append((i, a, b, value, None, around(n - 1), around(n + 1)))
    edges, beside = defaultdict(set), Counter()
    score = {}
    for _, _, _, value, kind, left, right in instances:
        for pattern in (("left", left), ("right", right)):
            if pattern[1]:
                edges[pattern].add(value)
                beside[pattern] += 1
                if kind is not None:
                    score[value] = (min(kind, score.get(value, (9,))[0]), 1.0)
    while True:
        trusted = {}
        for pattern, values in edges.items():
            held = [score[v] for v in values if v in score]
            by = [(sum(s for k, s in held if k == kind), -kind, sum(k == kind for k, _ in held)) for kind in {k for k, _ in held}]
            if by:
                total, kind, seeds = max(by)
                c = total / (len(held) + max(words[pattern[1]] - beside[pattern], 0))
                if seeds >= min_seeds and c >= min_confidence:
                    trusted[pattern] = (c, kind)
        fresh = {}
        for pattern, best in trusted.items():
            for v in edges[pattern] - set(score):
                fresh[v] = max(best, fresh.get(v, (0, 0)))
        if not fresh:
            break
        score |= {v: (-kind, c * damping) for v, (c, kind) in fresh.items()}
    return {(i, a, b) for i, a, b, _, kind, left, right in instances if kind is None and (("left", left) in trusted or ("right", right) in trusted)}


def test_patterns_discover_unseen_identifiers(spark):
    rnd = random.Random(4)
    rows = dict(enumerate([f"call me. contact: +49 30 {1000000 + i} now" for i in range(6)] + [f"server address 10.0.{i}.7 up" for i in range(12)]))
    # the first are found by words before and after seeds, the chains only by what has been found before
    extra = ["server address 10.0.300.7 up", "other words 10.0.300.9 words", "version 2.0 and 3.0", "contact: ext-551 soon", "the contacts are here", None, "", "x" * 50_000 + " 1" * 3000]
    extra += [f"ticket ext-{i} closed" for i in range(8)] + [f"contact: ext-{i} soon" for i in range(8)] + ["ticket zz9 open", "ticket zz9 open"]
    rows |= dict(enumerate(extra, 100))
    for i in range(200, 700):
        rows[i] = " ".join(rnd.choice(["mail", "to", "id=", "=", "ref", "is", "Or,", "a@b.c", f"u{rnd.randrange(40)}@x{rnd.randrange(4)}.de", f"10.1.{rnd.randrange(60)}.{rnd.randrange(300)}", f"k{rnd.randrange(50)}", f"+49 30 {rnd.randrange(90000, 99999)}"]) for _ in range(rnd.randrange(1, 12)))
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(5)
    for how in ({}, {"min_confidence": 0.3, "min_seeds": 3}, {"min_confidence": 0.05, "min_seeds": 1}):
        got = find_personal_data(df, **how).collect()
        found = {(r.doc_id, *map(int, x.split(":")[1:])) for r in got for x in r.spans.split(",") if x.startswith("id:")}
        assert found == bootstrapped(rows, **how)
        assert all(r.n_id == r.spans.count("id:") and r.n_found == len([x for x in r.spans.split(",") if x]) for r in got)
        if not how:
            assert {(100, 15, 25), (103, 9, 16), (124, 7, 10)} <= found and not any(d in (101, 102) for d, *_ in found)


def test_query_on_documents(spark, sf):
    import duckdb

    rows = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    got = op9_personal_data(spark, "/root/testdata/sf0.01").collect()
    check(rows, got)
    assert len(got) == len(rows)

import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

from palimpsest.llm import quality as q
from palimpsest.llm.queries import op5_quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_counts():
    rnd = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e f", "x y z\x85q\x1ck   é漢🎉"] + [" ".join(rnd.choice(["a", "b", "c", "d|", "é é", "\n", "a\n"]) for _ in range(rnd.randrange(90))) for _ in range(400)]
    texts += [" ".join(str(rnd.randrange(9000)) for _ in range(3000)) + " p q r s t u p q r s t u"]
    for t in texts[:-1]:
        assert q.base_counts(t) == by_hand(t), repr(t)
    n = q.base_counts(texts[-1])
    assert n[0] == 3012 and n[4] >= 12


def test_model_is_a_distribution_and_backs_off():
    rnd = np.random.default_rng(1)
    counts = np.zeros(q.SIZE, np.int64)
    np.add.at(counts, q.grams("the cat sat on the mat. " * 20 + "".join(map(chr, rnd.integers(97, 123, 400)))), 1)
    m = q.unpacked(q.packed(q.kneser_ney(counts)))
    assert (np.diff(m["hash"].astype(np.int64)) > 0).all()
    p = np.exp(q.log_probabilities(m).reshape(-1, q.A).astype(np.float64))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    assert p.min() > 0


def test_operator_separates_labelled_documents_and_takes_odd_rows(spark, sf):
    import duckdb

    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = {r.doc_id: r for r in op5_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    good = [rows[d].kept for d, v in labels.items() if v == 1 and not rows[d].base_failed]
    bad = [rows[d].kept for d, v in labels.items() if v == 0 and not rows[d].base_failed]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35
    texts = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    for d, t in list(texts.items())[::23]:
        r = rows[d]
        want = by_hand(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    odd = spark.createDataFrame([(1, None, None, 5), (None, "", "en", 5), (2, "a b c d e f g h i j k l", None, 5), (2, "a b c d e f g h i j k l", None, 5)], "doc_id bigint, text string, lang string, n_words int")
    got = q.assess(odd).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in got) == [(0, True, False), (0, True, False), (12, False, True), (12, False, True)]
    assert q.assess(odd.limit(0)).count() == 0


def test_copies_of_one_text_do_not_narrow_a_language(spark):
    import duckdb

    rows = duckdb.sql("select d.doc_id, d.text, d.lang from '/root/testdata/sf0.01/documents.parquet' d join '/root/testdata/sf0.01/labels.parquet' l using (doc_id) where l.quality = 1 and d.lang = 'de' order by doc_id limit 120").fetchall()
    copies = [(10_000_000 + i, rows[0][1], "de") for i in range(3 * len(rows))]
    kept = {r.doc_id: r.kept for r in q.assess(spark.createDataFrame(rows + copies, "doc_id bigint, text string, lang string")).where("not base_failed").collect()}
    own = [kept[d] for d, *_ in rows[1:] if d in kept]
    assert np.mean(own) > 0.9 and kept[10_000_000]


def test_shuffled_texts_of_any_script_are_rejected_and_tables_grow(spark):
    from palimpsest.llm import ngrams
    from palimpsest.llm.lookup import Table

    rnd = random.Random(3)
    syllables = [c + v for c in "бвгдклмнпрст" for v in "аеиоу"]
    words = ["".join(rnd.choices(syllables, k=rnd.randrange(1, 5))) for _ in range(300)]
    clean = [" ".join(rnd.choices(words, k=200)) for _ in range(150)]
    bad = ["".join(rnd.sample(t, len(t))) for t in clean[:10]]
    rows = [(i, t, "ru") for i, t in enumerate(clean + bad)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r.doc_id: r.kept for r in q.assess(df).where("not base_failed").collect()}
    assert np.mean([kept[i] for i in range(150)]) > 0.95
    assert not any(kept.get(150 + i, False) for i in range(10))
    n = []
    for part in (df.limit(20), df):
        t = Table(ngrams.fit(part, "text", "lang", q._same("text", "lang"), q.copies(part)))
        n.append(sum(len(t._part(p)[0]) for p in range(1 << t.bits)))
        points = np.frombuffer((ngrams.PAD + clean[0][:40]).encode("utf-32-le"), "<u4")
        seen = sorted({ord(c) for r in part.collect() for c in r.text})
        every = np.array([*seen, 0x1F600], np.uint32)
        s = ngrams.Scorer(t)
        for i in range(0, 40, 7):
            p = s.probabilities(np.array([ngrams.seed("ru")], np.uint64), [*(np.full(len(every), c) for c in points[i : i + 3]), every])
            assert abs(p.sum() - 1) < 1e-4 and p.min() > 0, (i, p.sum(), p.min())
    assert n[1] > n[0]


def plain_model(texts):
    """log p of a character after three others: modified Kneser-Ney over distinct texts, in plain dictionaries."""
    counts = {}
    counts[4] = Counter(p[i : i + 4] for t in set(texts) for p in ["\n\n\n" + t] for i in range(len(p) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d, after = {}, [defaultdict(list) for _ in range(5)]
    for k in range(1, 5):
        n = [sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
        d[k] = [0.0] + [min(max(j - (j + 1) * y * (n[j] / n[j - 1] if n[j - 1] else 0.5), 0.1), j - 0.1) for j in (1, 2, 3)]
        for g, c in counts[k].items():
            after[k][g[:-1]].append(c)

    def p(g):
        below = 1 / (1 + len(counts[1]))
        for k in range(1, 5):
            own = g[4 - k :]
            held = after[k].get(own[:-1])
            if held:
                c = counts[k].get(own, 0)
                below = (c - d[k][min(c, 3)]) / sum(held) + sum(d[k][min(x, 3)] for x in held) / sum(held) * below
        return below

    return p


def test_perplexity_and_verdicts_equal_a_plain_model(spark):
    rnd = random.Random(12)
    vocabulary = {"en": "the river house water old runs near bridge town light".split(), "ru": "река дом вода старый мост город свет течёт рядом и".split(), None: "𝔞𝔟 𝔠𝔡 漢字 かな".split()}
    rows = []
    for i in range(150):
        lang = rnd.choice(list(vocabulary))
        w = [rnd.choice(vocabulary[lang]) + str(rnd.randrange(30)) * (rnd.random() < 0.2) for _ in range(rnd.randrange(8, 60))]
        if i % 15 == 0:
            w = ["".join(rnd.sample("".join(w), 6)) for _ in w]
        rows.append((i, " ".join(w), lang))
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(90)] + [(300, "", "en"), (301, None, "en"), (302, " ".join(rnd.choice(vocabulary["en"]) for _ in range(60_000)), "en")]
    got = {r.doc_id: r for r in q.assess(spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(5)).collect()}
    assert len(got) == len(rows)
    word = q._word_characters()
    median = lambda v: sorted(v)[-(-len(v) // 2) - 1]
    rejected = 0
    for lang in vocabulary:
        texts = sorted({t for _, t, name in rows if t and name == lang})
        p = plain_model(texts)
        n = {t: max(1, sum(bool(word[ord(c)]) for c in t)) for t in texts}
        cost = lru_cache(None)(lambda g: -math.log(p(g)))
        x = {t: sum(cost(("\n\n\n" + t)[i : i + 4]) for i in range(len(t))) / n[t] for t in texts}
        middle = median(x.values())
        spread = max(1.4826 * median([abs(v - middle) for v in x.values()]), 0.025)
        root = max(1.4826 * median([abs(v - middle) * n[t] ** 0.5 for t, v in x.items()]), 1.0)
        for d, t, name in rows:
            if t and name == lang:
                wide = math.sqrt(spread**2 + root**2 / n[t])
                off = (x[t] - middle) / wide
                assert math.isclose(math.log(got[d].perplexity), x[t], rel_tol=1e-4, abs_tol=1e-4)
                if abs(off + 3.5) > 0.01 and abs(off - 5) > 0.01:
                    assert got[d].kept == (not got[d].base_failed and -3.5 <= off <= 5)
                    rejected += not got[d].kept and not got[d].base_failed
    assert rejected > 2 and not got[300].kept and not got[301].kept and got[302].n_words == 60_000

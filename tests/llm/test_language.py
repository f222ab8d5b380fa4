import math
import random
import time
from collections import defaultdict

from palimpsest.llm import language
from palimpsest.llm.common import joined_by_hot_key
from palimpsest.llm.language import declared, identify, visible_text
from palimpsest.llm.queries import op10_language_id

SF = "/root/testdata/sf0.01"


def test_pages_get_their_language(spark):
    rows = op10_language_id(spark, SF).collect()
    truth = {r.page_id: r.url.split("/")[3] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(truth)
    assert sum(r.lang == truth[r.page_id] for r in rows) / len(rows) > 0.98
    # held out: the text alone, without what the pages declare
    assert sum(r.text_lang == truth[r.page_id] for r in rows) / len(rows) > 0.9
    assert all(0 < r.probability <= 1.0000001 for r in rows)


def test_parts():
    page = '<html lang="de-AT"><script>let x = "</p> the";</script><!-- en --><style>p{}</style><p title="x">Grüße &amp; mehr</p>'
    assert visible_text(page) == "Grüße & mehr" and declared(page) == "de"
    assert declared('<meta http-equiv="content-language" content="fr">') == "fr" and declared("") == ""


def test_long_and_broken_pages():
    start = time.time()
    assert visible_text("<!-- " * 200_000) == "<!-- " * 199_999 + "<!--"
    assert visible_text("<script>a" * 100_000 + "</script>b") == "b"
    assert len(visible_text("<" * 300_000)) == 300_000 and visible_text("<style>x <b>y</b>") == "x y"
    assert declared("<html " * 100_000 + "<meta " * 100_000) == ""
    assert visible_text("word " * 500_000) == ("word " * 500_000).strip()
    assert time.time() - start < 20


def fused(rows, k, text_chars=60):
    """The best language and its probability by page, by plain loops over what each page shows."""
    best = {i: r.likely.index(max(r.likely)) if r.n else None for i, r in rows.items()}
    total = [sum(b == j for b in best.values()) for j in range(k)]
    top = [(c + 1) / (sum(total) + k) for c in total]
    tally = {by: defaultdict(lambda: [0] * k) for by in ("host", "domain", "declared", "suffix")}
    for i, r in rows.items():
        for by, held in tally.items():
            if best[i] is not None:
                held[getattr(r, by)][best[i]] += 1
    out = {}
    for i, r in rows.items():
        others = lambda by: [c - (best[i] == j) for j, c in enumerate(tally[by][getattr(r, by)])]
        prior = top
        for by, weight in (("domain", 20.0), ("host", 5.0)):
            own = others(by)
            prior = [(c + p * weight) / (sum(own) + weight) for c, p in zip(own, prior)]
        score = [x * min(r.n, text_chars) + math.log(p) for x, p in zip(r.likely, prior)]
        for by in ("declared", "suffix"):
            if by == "suffix" or r.declared:
                score = [s + math.log((c + 1) / (n + k)) for s, c, n in zip(score, others(by), total)]
        out[i] = (score.index(max(score)), 1 / sum(math.exp(s - max(score)) for s in score))
    return out


def test_fusion_equals_a_plain_version(spark):
    rnd = random.Random(6)
    words = {"en": "the cat and dog went to house by river".split(), "de": "der hund und die katze gehen zu dem haus".split(), "pt-BR": "o gato não está na casa das mães então".split()}
    sentence = lambda name, n: " ".join(rnd.choice(words[name]) for _ in range(n))
    labelled = spark.createDataFrame([(sentence(x, 60), x if i else x.upper()) for x in words for i in range(6)] + [("zz", None), ("zz", " "), (None, "en")], "text string, lang string")
    pages = []
    for i in range(300):
        name = rnd.choice(list(words))
        told = rnd.choice(["", f'<html lang="{rnd.choice(list(words))}">'])
        host = "big.site.org" if i % 3 == 0 else f"h{rnd.randrange(9)}.d{rnd.randrange(4)}.{rnd.choice(['de', 'com', 'br'])}"
        pages.append((i, f"http://{host}/", told + "<p>" + sentence(name, rnd.choice([0, 1, 2, 30])) + "</p>"))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)
    texts = labelled.select(language.language_of(labelled["lang"]).alias("l"), labelled["text"].alias("t")).where("l IS NOT NULL")
    names = language._languages(texts.select("l"))
    assert names == ["de", "en", "pt"]
    rows = {r.id: r for r in language._described(df, language.fit(texts, "t", "l"), names, "page_id", "url", "html").collect()}
    want = fused(rows, 3)
    got = {r.page_id: r for r in identify(df, labelled).collect()}
    assert len(got) == 300 and "pt" in {r.lang for r in got.values()}
    for i, (best, probability) in want.items():
        assert got[i].lang == names[best] and math.isclose(got[i].probability, probability, rel_tol=1e-6)


def test_evidence_fills_in_and_odd_rows(spark):
    docs = [(i, "the cat and the dog went to the house by the river " * 3, "en") for i in range(5)] + [(9, "der hund und die katze gehen zu dem haus an dem fluss " * 3, "de"), (10, None, "de"), (11, "x", None)]
    labelled = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    pages = [(i, "http://a.site.de/x", '<html lang="de"><p>die katze und der hund an dem fluss, das haus</p>', "k") for i in range(20)]
    pages += [(i, "http://b.other.com/x", "<p>the dog and the cat by the river, the house</p>", "k") for i in range(20, 40)]
    pages += [(100, "http://a.site.de/y", "", "k"), (101, None, None, "k"), (None, "http://b.other.com", "<p></p>", "k"), (102, "http://b.other.com/z", "<p>the river</p>", "k"), (102, "http://b.other.com/z", "<p>the river</p>", "k")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, lang string")
    got = {}
    for r in identify(df, labelled).collect():
        got.setdefault(r.page_id, []).append(r)
    assert all(got[i][0].lang == "de" for i in range(20)) and all(got[i][0].lang == "en" for i in range(20, 40))
    assert got[100][0].lang == "de" and got[None][0].lang == "en" and got[101][0].lang in ("de", "en") and len(got[102]) == 2
    assert identify(df.limit(0), labelled).count() == 0
    assert {r.lang for r in identify(df, labelled.limit(0)).collect()} == {None}


def test_join_by_hot_key_equals_a_left_join(spark):
    left = spark.createDataFrame([(i, "a" if i % 3 else str(i), i) for i in range(3000)] + [(1, None, 2)], "x int, k string, v int")
    right = left.where("k is not null").groupBy("k").count().selectExpr("k", "count as w", "count * 2 as y")
    got = joined_by_hot_key(left, right, "k", "w", share=10)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", "left").select(got.columns).collect()))

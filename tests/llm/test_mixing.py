import itertools

from pyspark.sql import functions as F

from palimpsest.llm.mixing import budgets, mix


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, tokens bigint")


def test_shortage_goes_to_siblings_before_ancestors(spark):
    df = leaves(spark, [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000), ("b", "en", "s5", 0)])
    got = {r.source: r.budget for r in budgets(df, {}, F.lit(400), 1).collect()}
    # a and b have 200 each; s1's shortage of 40 goes to s2, its sibling, not to de or b
    assert got == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}
    got = {r.source: r.budget for r in budgets(leaves(spark, [("a", "en", "s1", 10), ("a", "en", "s2", 10), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)]), {"domain": {"a": 3}}, F.lit(400), 2).collect()}
    # all of a's English is exhausted: what is left goes to its German, none to b
    assert got == {"s1": 20, "s2": 20, "s3": 260, "s4": 100}


def test_prefixes_epochs_and_odd_rows(spark):
    rows = [(i, "a", "en", "s", i % 5) for i in range(50)] + [(None, None, None, None, 7), (100, "a", "en", "s", None), (7, "a", "en", "s", 2), (7, "a", "en", "s", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, n_tokens bigint")
    for total, epochs in ((60, 1), (150, 3), (10_000, 2)):
        out = mix(df, {"domain": {"a": 9}}, F.lit(total), epochs, seed=3).collect()
        by = {}
        for r in out:
            by[r.domain] = by.get(r.domain, 0) + r["take"]
        cap = {"a": 104 * epochs, "": 7 * epochs}
        assert all(by[k] <= cap[k] for k in by) and sum(by.values()) in (min(total, 111 * epochs), min(total, 111 * epochs) - 1)
        for _, drawn in itertools.groupby(sorted(out, key=lambda r: r.epoch), key=lambda r: r.epoch):
            assert sum(r["take"] < r.n_tokens for r in drawn) <= 2
    assert mix(df.limit(0), {}, F.lit(5), 1, seed=3).count() == 0

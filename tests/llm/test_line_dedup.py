from palimpsest.llm.line_dedup import without_boilerplate

SCHEMA = "doc_id bigint, text string, source string, n_removed int, k string"


def test_first_occurrence_stays_and_odd_rows(spark):
    rows = [(i, f"own {i}\nshared\n\nshared", f"s{i % 4}", 9, "x") for i in range(8)]
    rows += [(20, None, "s0", 9, "x"), (None, "shared\nnull id", None, 9, "x"), (21, "", "s1", 9, "x"), (22, "two\n" + "long " * 50_000, "s1", 9, "x"), (23, "two", "s2", 9, "x"), (24, "same\nshared", "s2", 9, "x"), (24, "same\nshared", "s2", 9, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in without_boilerplate(df, min_sites=3).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[None][0].text == "shared\nnull id" and got[None][0].n_removed == 0  # null keys come first
    assert got[0][0].text == "own 0\n" and (got[0][0].n_lines, got[0][0].n_removed) == (3, 2)
    assert got[20][0].text is None and (got[20][0].n_lines, got[20][0].n_removed) == (0, 0)
    assert got[21][0].text == "" and got[21][0].n_lines == 0
    assert got[23][0].text == "two" and got[22][0].n_removed == 0
    assert [r.text for r in got[24]] == ["same", "same"] and got[24][0].k == "x"
    assert without_boilerplate(df.limit(0), 3).count() == 0


def test_near_threshold_counts_are_exact(spark):
    rows = [(1000 * n + i, f"line {n}", f"site{i}", 0, "") for n in (199, 200, 201) for i in range(n)]
    out = without_boilerplate(spark.createDataFrame(rows, SCHEMA), min_sites=200)
    removed = {r["n"]: r["c"] for r in out.selectExpr("doc_id div 1000 as n", "n_removed").groupBy("n").agg({"n_removed": "sum"}).toDF("n", "c").collect()}
    # documents 200000 to 201000 + 200 mix two lines' ids: count by line instead
    assert sum(removed.values()) == 199 + 200

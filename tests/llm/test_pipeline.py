import re
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_bpe import reference
from tests.llm.test_jaccard import by_hand as components_by_hand
from tests.llm.test_quality import by_hand as counts_by_hand

SF = "/root/testdata/sf0.01"


def lines_by_hand(rows):
    """Texts without lines on eight sources or more, first occurrences kept."""
    sites, first = defaultdict(set), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        for i, line in enumerate(r.text.split("\n")):
            if line.strip(" "):
                sites[line].add(r.source)
                first.setdefault(line, (r.doc_id, i))
    keep = lambda d, i, x: not x.strip(" ") or len(sites[x]) < 8 or first[x] == (d, i)
    return {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if keep(r.doc_id, i, x)) for r in rows}


def test_each_stage_against_a_plain_version_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, enc = docs.columns, reference()
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert after and set(after) <= set(before)
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "quality":
            for d in before:
                n, *_, repeated = counts_by_hand(before[d].text)
                assert d not in after if n < 10 or 100 * repeated > 20 * n else True
            assert len(after) > 0.6 * len(before)
        elif name == "line_dedup":
            assert {d: r.text for d, r in after.items()} == lines_by_hand(list(before.values()))
        elif name == "jaccard_join":
            groups = components_by_hand([(d, r.text) for d, r in before.items()], 5, 80)
            assert {str(d) for d in after} == {d for d, n, c in groups if d == c or n == 0}
        elif name == "mixing":
            tokens = lambda rows: sum(len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in rows.values())
            assert 0.88 < tokens(after) / tokens(before) < 0.97
        else:
            assert all(r.ids == enc.encode_ordinary(before[d].text) and r.n_tokens == len(r.ids) for d, r in after.items())


def test_stages_on_odd_rows(spark, tmp_path):
    prose = "the river runs by the old house and nobody in town knows where the water ends or how it came there"
    rows = [(i, f"{prose} number {i} {'abc'[i % 3]} said one more thing on day {i * 7}\nshared line of all sources", "en", f"src{i % 11}", 7, f"k{i}", True, 0.5) for i in range(60)]
    rows += [(3, rows[3][1], "en", "src3", 7, "again", False, None), (3, rows[3][1], "en", "src3", 7, "again", False, None), (None, rows[5][1], None, None, None, None, None, None)]
    rows += [(100, None, None, None, None, "null", None, 1.0), (101, "", "en", "src1", 0, "empty", None, 1.0), (102, " \n ", None, "src2", 3, "blank", None, 1.0), (103, "Wort " * 30_000, "de", None, 5, "long", None, 1.0)]
    rows += [(104 + i, " ".join(f"w{(i * 31 + j * j) % 997}" for j in range(40_000)), "fr", "src4", 5, "very long", True, 2.0) for i in range(2)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, kept boolean, perplexity double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, table, str(tmp_path)).collect()
        empty = stage(spark, table.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name != "byte_bpe":
            assert empty.columns == table.columns
    given = {(r.n_lines, r.kept, r.perplexity) for r in table.collect()}
    for name in ("quality", "line_dedup", "jaccard_join", "mixing"):
        assert {(r.n_lines, r.kept, r.perplexity) for r in out[name]} <= given  # columns of these names stay as they were
    assert {r.doc_id for r in out["quality"]} >= set(range(60)) - {100, 101, 102} and len([r for r in out["quality"] if r.doc_id == 3]) == 3
    assert len(out["line_dedup"]) == len(rows) and sum("shared line" in (r.text or "") for r in out["line_dedup"]) < 6
    stay = [r.doc_id for r in out["jaccard_join"]]
    assert stay.count(3) <= 1 and None not in stay and {100, 101, 102, 103} <= set(stay)
    assert sorted(d for d in stay if d < 60) == sorted(int(c) for d, n, c in components_by_hand([(r[0], r[1]) for r in rows[:60]], 5, 80) if str(d) == c)
    assert {100, 101, 102}.isdisjoint(r.doc_id for r in out["mixing"])
    assert len(out["byte_bpe"]) == len(rows) and all((r.n_tokens == 0) == (r.doc_id in (100, 101)) for r in out["byte_bpe"])


def test_rows_keep_their_names_however_files_are_cut(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(6).write.option("parquet.block.size", 64 << 10).parquet(f"{tmp_path}/in")
    read = lambda: {r["__row"]: r.doc_id for r in corpus_pipeline._numbered(spark.read.parquet(f"{tmp_path}/in")).collect()}
    names, size = read(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        assert read() == names and len(names) == 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    made = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id bigint, _metadata string")
    assert corpus_pipeline._numbered(made).select("__row").distinct().count() == 3


def test_run_gives_the_stages_rows(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

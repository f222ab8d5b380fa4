import random
import re

from pyspark.sql import functions as F

from palimpsest.sources import trigrams

PATTERNS = ["abc", "ab.cd", "(abc|bcd)a", "a(bc)+d", "(ab|cd)(da|bc)ab", "a[bc]dab", "^abca", "dcb$", "(?i)ABC", "ab?cda", "(abc)?d", "x{2}abc", "abc|", "a(?:bcd|dc)bd", r"\bcab", "(abc)d"]


def test_alternatives_never_dismiss_a_match():
    rnd = random.Random(21)
    for _ in range(20_000):
        line = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(12)))
        for p in PATTERNS:
            if re.search(p, line):
                held = {line[i : i + 3] for i in range(len(line) - 2)}
                assert any(c <= held for c in trigrams.alternatives(p)), (p, line)
    assert trigrams.alternatives("abcd", literal=True) == [frozenset({"abc", "bcd"})]
    assert trigrams.alternatives("(abc|bcd)a") and frozenset() not in trigrams.alternatives("(abc|bcd)a")
    assert trigrams.alternatives("(?i)ABC") == trigrams.alternatives("abc|") == [frozenset()]


def test_search_reads_few_files_and_finds_all(spark, tmp_path):
    rnd = random.Random(22)
    lines = [("v", f"f{i}", j, "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(15)))) for i in range(200) for j in range(3)] + [("w", "f0", 0, "abcabcabc"), ("w", "f1", 0, "")]
    df = spark.createDataFrame(lines, "version string, file string, line_no int, line string")
    path = f"file://{tmp_path}/index"
    trigrams.build(df, path)
    named = {p: (p, False) for p in PATTERNS} | {"lit": ("ab.c", True), "two": ("cd", True), "long": ("abcabcabc", True)}
    got = {tuple(r) for r in trigrams.search(df, path, named).select("name", "version", "file", "line_no").collect()}
    test = {n: (lambda x, p=p: p in x) if literal else (lambda x, p=p: re.search(p, x)) for n, (p, literal) in named.items()}
    assert got == {(n, v, f, i) for n, t in test.items() for v, f, i, x in lines if t(x)}
    seen = {r["name"]: r.n for r in trigrams.files(spark, path, named, df).groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert seen["long"] < 10 and seen["abc"] < 60 and seen["two"] == 202
    assert "trigram" in str(trigrams.files(spark, path, {"a": ("abc", True)}, df)._jdf.queryExecution().executedPlan()).split("PushedFilters")[1][:200]


def test_a_file_tells_a_trigram_once_before_anything_is_shuffled(monkeypatch):
    import pyarrow as pa

    rows = [("v", f, line) for f in ("a", "b", "a", None, None) for line in ("", "abcd", "xy", None, "é漢😀", "abcd" * 3, "y" * 9)]
    want = {(v, f, trigrams.code(line[i : i + 3])) for v, f, line in rows for i in range(len(line or "") - 2)}
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=["version", "file", "line"])
    for characters, most in ((1 << 20, 8 * 7), (10, 100)):
        monkeypatch.setattr(trigrams, "CHARACTERS", characters)
        got = [tuple(r.values()) for b in trigrams._of_files(batch) for r in b.to_pylist()]
        assert set(got) == want and len(got) <= most

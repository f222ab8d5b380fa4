from pyspark.sql import functions as F

from palimpsest.functions import binary, text
from palimpsest.operators import bytecode, paths, resolve
from palimpsest.plans.resolving import TABLE
from palimpsest.sources import corpus, dumps, entries, sinks, versions


def test_entries_are_rewritten_in_place(spark, tmp_path):
    text = '# head\nKEY_A = "1"  # note "x"\n\n  KEY_B="two"\nplain\nKEY_A = "3"'
    (tmp_path / "a.ini").write_text(text)
    lines = entries.read_entries(spark, f"{tmp_path}/a.ini")
    assert {(r.name, r.value) for r in lines.where("name is not null").collect()} == {("KEY_A", "1"), ("KEY_B", "two"), ("KEY_A", "3")}
    done = spark.createDataFrame([("KEY_A", "9"), ("KEY_C", "0")], "name string, applied string")
    out = sinks.rewritten(lines, done)
    sinks.write_text(out, f"{tmp_path}/out")
    got = spark.read.text(f"{tmp_path}/out/file=a.ini", wholetext=True).first().value
    assert got.rstrip("\n") == text.replace('"1"', '"9"').replace('"3"', '"9"')


def test_corpus_scan_keep_list_and_index(spark, tmp_path):
    for v, n in (("old", 1), ("new", 2)):
        (tmp_path / v).mkdir()
        (tmp_path / v / "a.c").write_bytes(b"Root_5.f_%d = 1;\r\nx\x0by\n" % n)
        (tmp_path / v / "b.c").write_bytes(b"Other_7 = 2;\n\xff")
    lines = corpus.corpus(spark, {v: f"{tmp_path}/{v}" for v in ("old", "new")})
    assert lines.where("version = 'old' and file = 'a.c'").count() == 4
    assert {r.file_ord for r in corpus.kept(lines, ["z.c", "b.c"]).collect()} == {1}
    index = corpus.mentions(lines, "[A-Z][a-z]+_[0-9]+")
    assert {r.file for r in corpus.mentioning(lines, index, F.col("token") == "Root_5").collect()} == {"a.c"}
    assert {r.file for r in corpus.mentioning(lines, index, F.col("token") == "None_1").collect()} == {"a.c", "b.c"}
    once = corpus.cached(index, f"{tmp_path}/cache", F.col("file"), lines)
    assert once.count() == index.count() == corpus.cached(index.limit(0), f"{tmp_path}/cache", F.col("file"), lines).count()


def test_policies_names_and_crosswalks(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"tiers": [{"name": "big", "globs": ["*_Main.c"], "least": {"n": 5}}, {"name": "any", "globs": ["*.c"], "least": {}}]}')
    df = spark.createDataFrame([("A_main.c", 9), ("A_main.c", 2), ("x.h", 9)], "name string, n int")
    got = [r.tier for r in resolve.route(df, entries.tier_rules(spark, f"{tmp_path}/p.json"), "dropped", "tier").collect()]
    assert got == ["big", "any", "dropped"]
    lines = spark.createDataFrame([("0x10:7",), ("5=6",), ("a,b",), ("none",), ("1,2=3",)], "line string")
    assert {(r.source, r.target) for r in entries.crosswalk(lines, "line").collect()} == {(16, 7), (5, 6)}
    names = spark.createDataFrame([("A # x",), ("#",), ("A",), ("B",)], "line string")
    assert {r.name for r in entries.name_list(names, "line").collect()} == {"A", "B"}
    ranked = spark.createDataFrame([("b", "any", 2), ("a", "big", 1), ("c", "dropped", 3)], "name string, tier string, rank int")
    sinks.write_keep_list(ranked, f"{tmp_path}/keep")
    assert [r.value for r in spark.read.text(f"{tmp_path}/keep").collect()] == ["a", "b"]
    sinks.write_report(ranked, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 3
    assert sinks.verified(ranked, "name", "name").count() == 3


def test_versions(spark, tmp_path):
    for n in ("b2", "b10", "b9_1", ".git", "b9_2"):
        (tmp_path / n).mkdir()
    found = versions.list_versions(spark, f"file://{tmp_path}")
    assert found == ["b2", "b9_1", "b9_2", "b10"]
    assert versions.resolve(found, None) == "b10" and versions.resolve(found, "b9") == "b9_2" and versions.resolve(found, "x") is None
    assert versions.previous(found, "b10") == "b9_2" and versions.previous(found, "b2") is None


def test_dumps_and_programs(spark, tmp_path):
    code = bytes.fromhex("0602030000 01ff 03080102 0201020304 05feff 09 070201".replace(" ", "")) * 900
    natives = [7, -1, 1 << 62]
    (tmp_path / "x.dump").write_bytes(dumps.build("x", code, natives))
    d = dumps.read_dumps(spark, f"{tmp_path}/x.dump", "old")
    r = d.first()
    assert bytes(r.code) == code and r.natives == natives and r.script == "x"
    rows = bytecode.instructions(d, TABLE)
    assert bytes(bytecode.assemble(rows).first().code) == code
    assert bytecode.functions(rows).count() == 900
    assert {(x["index"], x["hash"]) for x in dumps.native_table(d).collect()} == set(enumerate(natives))
    assert bytecode.switch_cases(bytes([1]) + bytes.fromhex("050000000300"), 10) == [(5, 21)]
    (tmp_path / "n.json").write_text('{"A": {"0x10": {"name": "N"}, "zz": {"name": "M"}}}')
    assert [(x["hash"], x["name"]) for x in dumps.hash_names(spark, f"{tmp_path}/n.json").collect()] == [(16, "N")]


def test_paths_and_bytes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(paths.canonical(lit("Root_1.f_2[iVar3 /*5*/][7][x][a + 1]"))) == "Root_1.f_2[i /*5*/][7][j][a + 1]"
    assert one(paths.canonical(lit("R" + "[x]" * 11))) == "R" + "".join(f"[{c}]" for c in "ijklmnopqii")
    assert one(paths.variants(lit("Root_1[i /*5*/].f_2[j /*3*/]"))) == ["Root_1[i /*5*/].f_2[j /*3*/]", "Root_1[i /*5*/].f_2", "Root_1.f_2"]
    assert one(paths.variants(lit("Root_1[3].f_2[j]"))) == ["Root_1[3].f_2"] and one(paths.variants(lit("Root_1[j]"))) == ["Root_1[j]", "Root_1"]
    assert one(paths.loose(lit("Root_1.f_2[3 /*10*/].f_1"))) == one(paths.loose(lit("Root_1.f_33"))) == ["Root_1", "+33"]
    assert one(paths.loose(lit("Root_1.f_2[i /*4*/][2][j].f_1[k /*6*/]"))) == ["Root_1", "+2", "*4", "+3", "*6", "+0"]
    assert [one(paths.loose(lit(x))) for x in ("x?", "Root_1.60", "Root_1[a + 1]", "")] == [None] * 4
    assert one(paths.offset_notation(lit("Root_1[2 /*4*/][0 /*3*/][5][i]"))) == "Root_1.f_8[5]" and one(paths.offset_notation(lit("x[2 /*4*/]"))) == "x[2 /*4*/]"
    assert one(paths.in_notation_of(lit("Root_9.f_7[j /*27*/].f_2[k /*3*/]"), lit("Root_1.f_9.f_2"))) == "Root_9.f_7.f_2"
    assert one(paths.in_notation_of(lit("Root_9.f_7[j /*27*/].f_2[1 /*3*/]"), lit("Root_1.f_9[i /*2*/]"))) == "Root_9.f_7[j /*27*/].f_2[1 /*3*/]"
    assert one(text.stripped_reference(lit("&(*(x))"))) == "x" and one(text.stripped_reference(lit("**a"))) == "*a"
    assert paths.split_arguments_one("a,") == ["a"] and paths.split_arguments_one("a, ") == ["a", ""] and paths.split_arguments_one("f(a], b") == ["f(a], b"]
    assert paths.split_arguments_one('a, f(b, "c,)"), d[1, 2]') == ["a", 'f(b, "c,)")', "d[1, 2]"] and paths.split_arguments_one("") == []
    d = spark.createDataFrame([(bytes.fromhex("0102030405"),)], "b binary")
    r = d.select(binary.integer("b", 2, 2).alias("u"), binary.with_integer("b", 2, 2, F.lit(0xABCD)).alias("w"), binary.hex_text("b").alias("h"), binary.count_bytes("b", "02 ? 04").alias("c"), binary.float_of_bits(F.lit(0x3F800000)).alias("f"), paths.next_field(F.lit("R_1.f_9[i /*3*/]"), 2, 8).alias("n")).first()
    assert (r.u, bytes(r.w), r.h, r.c, r.f, r.n) == (0x0302, bytes.fromhex("01CDAB0405"), "01 02 03 04 05", 1, 1.0, "R_1.f_11[i /*8*/]")

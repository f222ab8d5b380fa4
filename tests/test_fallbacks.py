import glob
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import fallbacks, resolve
from palimpsest.sources import corpus, sinks


def test_helper_keys(spark):
    text = {
        "a": ['func_12("one", Root_5.f_3[iVar0 /*9*/].f_1[iVar2], 4);', 'set_label(&lbl, "tw");', 'add_label(&lbl, "o");', "func_12(&lbl, *Root_5.f_4[i /*9*/]);", 'func_13("three", Root_5.f_1);', "func_12(none, Root_5.f_2);", 'func_13("four", 7);'],
        "b": ['func_13("three", Root_5.f_2);', 'func_1("one", Root_5.f_3[iVar7 /*9*/].f_1[i]);'],
        "c": ['func_13("five", Root_5.f_9);'],
    }
    lines = spark.createDataFrame([(f, i, x) for f, ls in text.items() for i, x in enumerate(ls)], "file string, line_no long, line string")
    got = {r.key: r.value for r in fallbacks.helper_keys(lines, ["file"], spark.createDataFrame([("a",), ("b",)], "file string")).collect()}
    assert got == {"one": "Root_5.f_3[i /*9*/].f_1", "two": "Root_5.f_4[i /*9*/]"}
    assert "five" in {r.key for r in fallbacks.helper_keys(lines, ["file"]).collect()}


def test_the_order_of_fallbacks_and_their_guards(spark):
    rows = [
        ("s_full", "Root_1.f_5[i /*4*/].f_2"),  # a family that structure tells whole
        ("x_full", "Root_1.f_5[i /*4*/].f_2"),  # another one: no array steps, so its helper key tells
        ("x_scalar", "Root_1.f_7"), ("x_moved", "Root_1.f_8"),  # structure leads to another base, the helper is next
        ("x_spelt", "Root_1.f_9[i /*3*/]"),  # the helper tells the same in another spelling: loose tells that it stays
        ("x_fuzzy", "Root_2.f_1"), ("x_none", "Root_2.f_2"), ("x_far", "Root_2.f_3"),
    ]
    entries = spark.createDataFrame(rows, "name string, value string")

    def structural(left, scalar_only):
        told = {"s_full": "Root_1.f_6[i /*5*/].f_2", "x_full": "Root_1.f_66[i /*5*/].f_2", "x_scalar": "Root_1.f_17", "x_moved": "Root_9.f_8"}
        table = spark.createDataFrame([(n, v, "p") for n, v in told.items() if not scalar_only or "[" not in v], "name string, new_value string, phase string")
        return table.join(left.select("name"), "name", "left_semi")

    told = lambda d: lambda left: spark.createDataFrame([(n, v, 0.9) for n, v in d.items()], "name string, new_value string, confidence double").join(left.select("name"), "name", "left_semi")
    helper = told({"x_full": "Root_1.f_67[i /*5*/].f_2", "x_moved": "Root_1.f_18", "x_spelt": "Root_1.f_9[k /*3*/]", "s_full": "Root_1.f_1"})
    backward = spark.createDataFrame([("Root_1.f_9[i /*3*/]", "p.q"), ("Root_2.f_3", "p.r")], "value string, path string")
    forward = spark.createDataFrame([("p.q", "Root_1.f_9[j /*3*/]"), ("p.r", "Root_7.f_3")], "path string, new_value string")
    out = fallbacks.resolve_fallbacks(entries, structural, helper, (backward, forward), told({"x_fuzzy": "Root_2.f_11", "x_far": "Root_8.f_1"}), ["s_"])
    got = {r["name"]: (r.new_value, r.status) for r in out.collect()}
    assert got == {
        "s_full": ("Root_1.f_6[i /*5*/].f_2", "migrated_structural"), "x_full": ("Root_1.f_67[i /*5*/].f_2", "migrated_helper"), "x_scalar": ("Root_1.f_17", "migrated_structural"),
        "x_moved": ("Root_1.f_18", "migrated_helper"), "x_spelt": ("Root_1.f_9[i /*3*/]", "unchanged"), "x_fuzzy": ("Root_2.f_11", "migrated_fallback"), "x_none": (None, "unresolved"), "x_far": (None, "unresolved"),
    }


def test_helper_by_key_and_by_old_value(spark):
    keys = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    entries = spark.createDataFrame([("one", "Root_1.f_1"), ("other", "Root_1.f_2"), ("none", "Root_1.f_3")], "name string, value string")
    got = fallbacks.by_helper(entries, keys({"one": "Root_1.f_9", "two": "Root_1.f_2"}), keys({"one": "Root_1.f_11", "two": "Root_1.f_12"}), F.col("name"))
    assert {r["name"]: r.new_value for r in got.collect()} == {"one": "Root_1.f_11", "other": "Root_1.f_12"}


def test_families_are_repaired_in_root_number_and_next(spark):
    one = lambda root, stride, leaf: f"Root_1.f_{root}[i /*{stride}*/]{leaf}"
    rows = [
        ("act_a", "act_", one(100, 7, ".f_2"), one(150, 9, ".f_3")), ("act_b", "act_", one(100, 7, ".f_6"), one(150, 9, ".f_9.f_1")), ("act_c", "act_", one(100, 7, ""), one(150, 9, "")),
        ("act_loc", "act_", one(100, 7, ".f_4"), one(900, 3, ".f_4")), ("act_top", "act_", one(100, 7, ".f_20.f_5"), one(900, 4, ".f_1")), ("act_low", "act_", one(100, 7, ".f_1"), one(901, 5, ".f_1")),
        ("act_own", "act_", one(500, 7, ".f_4"), one(910, 6, ".f_4")),  # another old root: no outlier
        ("act_number", "act_", "Root_1.f_99", "Root_1.f_899"), ("act_x_number", "act_", "Root_1.f_98", "Root_1.f_300"), ("act_NEXT", None, "7", "7"),
        ("few_a", "few_", one(1, 2, ""), one(3, 2, "")), ("few_b", "few_", one(1, 2, ""), one(4, 2, "")), ("few_number", "few_", "Root_1.f_1", "Root_1.f_999"), ("act_untold", "act_", one(100, 7, ".f_4"), None),
    ]
    got = {r["name"]: (r.fixed_value, r.repair) for r in resolve.repair_families(spark.createDataFrame(rows, "name string, family string, value string, new_value string")).collect()}
    fixed = {"act_loc": (one(150, 9, ".f_5"), "root"), "act_top": (one(150, 9, ".f_23.f_5"), "root"), "act_low": (one(150, 9, ".f_2"), "root"), "act_number": ("Root_1.f_149", "number"), "act_NEXT": ("9", "next")}
    assert got == {r[0]: fixed.get(r[0], (r[3], None)) for r in rows}


def test_conservative_paths_change_their_strides_alone(spark):
    from palimpsest.operators import structure

    array = "base string, root bigint, stride bigint, stride2 bigint, child bigint"
    old = [("Root_1", 5, 10, None, c) for c in (1, 2, 3)] + [("Root_1", 60, 20, None, c) for c in (7, 8)]
    new = [("Root_1", 5, 11, None, c) for c in (1, 2, 3)] + [("Root_1", 90, 20, None, c) for c in (7, 8)]
    none = spark.createDataFrame([], "base string, root bigint, sub bigint, stride bigint, leaf bigint")
    scalars = spark.createDataFrame([], "base string, field bigint")
    values = spark.createDataFrame([("stride", "Root_1.f_5[i /*10*/].f_2"), ("root", "Root_1.f_60[i /*20*/].f_7")], "name string, value string")
    run = lambda **how: {r["name"]: r.new_value for r in structure.resolve_paths(values, (spark.createDataFrame(old, array), spark.createDataFrame(new, array)), (none, none), (scalars, scalars), **how).collect()}
    assert run() == {"stride": "Root_1.f_5[i /*11*/].f_2", "root": "Root_1.f_90[i /*20*/].f_7"}
    assert run(conservative=True) == {"stride": "Root_1.f_5[i /*11*/].f_2", "root": None}
    assert run(scalar_only=True) == {"stride": None, "root": None}


def test_gates_publish_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, i if i % 4 else None, i % 3) for i in range(20)], "k int, v int, w int")
    path = f"file://{tmp_path}/out"
    gate = lambda **x: sinks.Gate(F.lit(True), F.col("v").isNotNull(), F.col("v").isNotNull(), F.col("w") > 0, **x)
    measured = sinks.publish(df, path, gate(least_coverage=0.75, least_agreement=0.6, most_unresolved=5))
    assert (measured["rows"], measured["resolved"], measured["coverage"], measured["compared"]) == (20, 15, 0.75, 15)
    for limits, why in (({"least_coverage": 0.8}, "coverage"), ({"least_agreement": 0.99}, "agreement"), ({"most_unresolved": 4}, "unresolved")):
        with pytest.raises(sinks.NotPublished, match=why):
            sinks.publish(df.where("k <> 13"), path, gate(**limits))
    assert spark.read.parquet(path).count() == 20 and os.listdir(tmp_path) == ["out"]


def test_only_changed_files_are_derived_again(spark, tmp_path):
    files = {f"f{i}": [f"line {i} {j}" for j in range(3)] for i in range(12)}
    frame = lambda: spark.createDataFrame([("v", f, j, x) for f, ls in files.items() for j, x in enumerate(ls)], "version string, file string, line_no long, line string").repartition(3)
    derived = []

    def derive(lines):
        derived.append(sorted(r.file for r in lines.select("file").distinct().collect()))
        return lines.where("line NOT LIKE '%drop%'").groupBy("version", "file").agg(F.max("line").alias("top"), F.count("*").alias("n"))

    root = f"file://{tmp_path}/cache"
    run = lambda: {r.file: (r.top, r.n) for r in corpus.refreshed(frame(), root, derive).collect()}
    want = lambda: {f: (max(ls), len(ls)) for f, ls in files.items()}
    assert run() == want()
    stamps = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/cache/rows/*/*/*.parquet")}
    first = stamps()
    files["f3"] = files["f3"] + ["more 3"]
    del files["f5"]
    files["new"] = ["a"]
    assert run() == want()
    second = stamps()
    assert {p.split("file=")[1].split("/")[0] for p in second.keys() ^ first.keys()} == {"f3", "new"}
    files["f4"] = ["drop this"]  # a file that no longer gives any row
    assert run() == {f: v for f, v in want().items() if f != "f4"}
    assert run() == {f: v for f, v in want().items() if f != "f4"}
    files["f5"] = ["line 5 0"]  # back in another state
    assert run()["f5"] == ("line 5 0", 1)
    assert derived == [sorted(f"f{i}" for i in range(12)), ["f3", "new"], ["f4"], [], ["f5"]]

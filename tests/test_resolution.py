from palimpsest.operators import extract, structure

OLD = """root = make_dict(0, "a");
set_label(&lbl, "pre");
add_label(&lbl, "_x");
inner = make_dict(root, &lbl);
put_int(inner, "k", Root_5.f_1);
put_int(inner, "lit", 7);
push_int(inner, Root_5.f_2);
set_label(&lbl, "z");
put_int(root, &lbl, Root_5.f_3);
put_int(other, "bare", Root_5.f_4);
loop = make_dict(loop, "l");
put_int(loop, "c", Root_5.f_9);"""


def lines(spark, versions):
    return spark.createDataFrame([(v, "f.c", i, x) for v, t in versions.items() for i, x in enumerate(t.split("\n"))], "version string, file string, line_no int, line string")


def test_extraction_and_two_hop(spark):
    from palimpsest.operators.keyed import two_hop

    new = OLD.replace("f_1)", "f_11)").replace('put_int(other, "bare", Root_5.f_4);', "")
    found = extract.mappings(lines(spark, {"old": OLD, "new": new}))
    got = {(r.path, r.value, r.dynamic) for r in found.where("version = 'old'").collect()}
    assert got == {("a.pre_x.k", "Root_5.f_1", True), ("a.pre_x", "Root_5.f_2", True), ("a.z", "Root_5.f_3", True), ("bare", "Root_5.f_4", False), ("l.c", "Root_5.f_9", False)}
    _, backward = extract.forward_and_backward(found.where("version = 'old'"), ["file", "line_no"])
    forward, _ = extract.forward_and_backward(found.where("version = 'new'"), ["file", "line_no"])
    entries = spark.createDataFrame([("A", "Root_5.f_1"), ("B", "Root_5.f_3"), ("C", "Root_5.f_4"), ("D", "Root_9")], "name string, value string")
    done = {r["name"]: (r.status, r.new_value) for r in two_hop(entries, backward, forward).collect()}
    assert done == {"A": ("migrated", "Root_5.f_11"), "B": ("unchanged", "Root_5.f_3"), "C": ("path_removed_in_new", None), "D": ("not_found_in_old", None)}
    # old and new alike: all unchanged
    same, _ = extract.forward_and_backward(found.where("version = 'old'"), ["file", "line_no"])
    assert {r.status for r in two_hop(entries.where("name <> 'D'"), backward, same).collect()} == {"unchanged"}


def test_wrappers(spark):
    text = "void save(int d, char* k, int v)\n{\n    put_int(d, k, v);\n}\nint other(int a)\n    put_int(a, b, a);"
    got = [tuple(r) for r in extract.wrapper_roles(lines(spark, {"x": text}), ["version", "file"]).collect()]
    assert got == [("x", "f.c", "save", 0, 1, 2)]


def test_roots_match_in_four_phases(spark):
    kind = "base string, root bigint, stride bigint, children array<bigint>"
    old = [("g", 1, 10, [1, 2]), ("g", 2, 10, [1, 2]), ("g", 3, 20, [1, 2, 3, 4, 5]), ("g", 4, 30, [900]), ("g", 5, 40, [10, 30, 55, 90, 140])]
    new = [("g", 11, 10, [1, 2]), ("g", 12, 11, [1, 2]), ("g", 13, 21, [1, 2, 3, 4, 6]), ("g", 4, 31, [990]), ("g", 15, 41, [13, 33, 58, 93, 143])]
    o, n = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    got = {r.root: (r.new_root, r.phase) for r in structure.match_roots(o, n).collect()}
    assert got == {1: (11, "signature"), 2: (12, "signature"), 3: (13, "similar"), 4: (4, "same"), 5: (15, "delta")}
    entries = spark.createDataFrame([("A", "g", 5, 40, 55), ("B", "g", 4, 30, 900), ("C", "g", 99, 1, 1)], "name string, base string, root bigint, stride bigint, leaf bigint")
    done = {r["name"]: (r.new_root, r.new_stride, r.new_leaf) for r in structure.resolve_arrays(entries, o, n).collect()}
    assert done == {"A": (15, 41, 58), "B": (4, 31, 900), "C": (None, 1, None)}


def test_profiles_and_strides(spark):
    rows = spark.createDataFrame([("g", 1, 5, 2), ("g", 1, 5, 1), ("g", 1, 7, 2), ("g", 2, None, 9)], "base string, root bigint, stride bigint, child bigint")
    assert {(r.root, r.stride, tuple(r.children)) for r in structure.profiles(rows).collect()} == {(1, 5, (1, 2)), (2, None, (9,))}
    pairs = spark.createDataFrame([([163, 4141], [165, 4201]), ([163], [165]), ([163], [166]), ([1, 2], [3])], "old array<bigint>, new array<bigint>")
    entries = spark.createDataFrame([("A_NEXT", 163), ("A_OTHER", 163), ("B_size", 4141), ("C_SETTINGS", 5)], "name string, value bigint")
    got = {r["name"]: r.new_value for r in structure.propagate_strides(pairs, entries).collect()}
    assert got == {"A_NEXT": 165, "A_OTHER": 163, "B_size": 4201, "C_SETTINGS": 5}


def test_variables_by_each_strategy(spark):
    from palimpsest.operators import unnamed

    old = """int iLocal_50 = 0;
float fLocal_51;

# note
struct<7> Local_52;
void main()
{
    Local_60 = { 1, 2, 3, 4, 5, 6 };
    if (iLocal_61) PED::WALK("tag_one");
    switch (iLocal_62)
    {
        case 1: say("alpha_body"); break;
        case 2: say("beta_body"); break;
    }
%s
    say("far_anchor");
    x = iLocal_63;
}""" % "\n"
    new = old
    for a, b in ((50, 70), (51, 71), (52, 72), (60, 85), (61, 81), (62, 82), (63, 99)):
        new = new.replace(f"Local_{a}", f"Local_{b}")
    text = lines(spark, {"old": old, "new": new})
    entries = spark.createDataFrame([(f"V{v}", v) for v in (51, 60, 61, 62, 63, 77)], "name string, value bigint")
    got = {r["name"]: (r.new_value, r.method) for r in unnamed.resolve_variables(entries, text).collect()}
    assert got == {"V51": (71, "declaration"), "V60": (85, "initializer"), "V61": (81, "same_line"), "V62": (82, "switch"), "V63": (99, "window"), "V77": (None, None)}


def test_assembly():
    import pytest

    from palimpsest.operators import assembly
    from palimpsest.plans.resolving import TABLE

    code = assembly.assemble_text("start: PUSH_U8 0x10 ; first\n JUMP end\n PUSH_U32 7\nend: NOP", TABLE)
    assert code == bytes.fromhex("0110" "050500" "0207000000" "09")
    assert assembly.tokenize(" L1: CALL 5, 6 ; x") == ("L1", "CALL", ["5", "6"])
    with pytest.raises(ValueError):
        assembly.assemble_text("PUSH_U8 256", TABLE)
    with pytest.raises(ValueError):
        assembly.assemble_text("WHAT 1", TABLE)


def test_parent_paths_of_deep_chains_are_whole(spark):
    from palimpsest.operators.joins import parent_paths

    chain = spark.createDataFrame([(i, i - 1, f"k{i}") for i in range(36)] + [(100, 101, "a"), (101, 100, "b")], "id int, up int, label string").coalesce(1)
    got = {r.id: (r.path, r.depth) for r in parent_paths(chain, "id", "up", "label").collect()}
    assert got[35] == (".".join(f"k{i}" for i in range(36)), 36) and got[0] == ("k0", 1) and got[100] == ("b.a", 2)


def test_only_headers_and_bodies_are_scanned_for_forwarding_functions(spark, monkeypatch):
    """Calls, most of a file's lines, don't tell which function a line lies in."""
    text = ["void save(char* k, int n, int v, int d)", "    put_int(d, k, v);", "void other(int v, int d)", '    put_int(d, "x", v);', "void main()"] + [f'save("k{i}", 5, Root_{i}, d);' for i in range(60)]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no long, line string")
    scanned, real = [], extract.sequence.last_before
    monkeypatch.setattr(extract.sequence, "last_before", lambda df, *a, **k: scanned.append(df.count()) or real(df, *a, **k))
    (row,) = extract.wrapper_roles(lines, ["file"]).collect()
    assert (row.function, row.container_at, row.key_at, row.value_at) == ("save", 3, 0, 2) and scanned[0] <= 5

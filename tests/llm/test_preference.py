from palimpsest.llm.preference import conversation_arrays, format_pairs, neighbour_pairs


def test_prefix_masks_and_odd_rows(spark):
    turns = "array<struct<role string, text string>>"
    rows = [
        (1, [("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")], 3),
        (2, [("user", "hi")], [("user", "hi"), ("assistant", "<|end|>")], 3),
        (3, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")], 3),
        (4, None, [("assistant", "é🎉")], 3),
        (5, [("user", "x")], [("user", "y")], 3),
    ]
    got = {r.id: r for r in format_pairs(spark.createDataFrame(rows, f"id int, chosen {turns}, rejected {turns}, prompt int")).collect()}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].n_common == 1
    assert got[1].chosen == "<|assistant|>\nyes<|end|>\n" and got[1].chosen_mask == "14:25"
    assert got[1].chosen[14:25] == "yes<|end|>\n" and got[1].rejected_mask == "14:24"
    assert got[2].chosen == "" and got[2].chosen_mask == "" and got[2].rejected == "<|assistant|>\n< |end|><|end|>\n"
    assert got[3].n_common == 2 and got[3].chosen == got[3].rejected == ""
    assert got[4].prompt == "" and got[4].rejected_mask == "14:24"
    assert got[5].n_common == 0 and got[5].chosen_mask == ""


def test_pairs_from_conversations(spark):
    rows = [(2, 1, "assistant", "A", "x"), (2, 0, "user", "q", "x"), (3, 0, "user", None, "x"), (3, 1, "assistant", "B", "x"), (3, 2, "user", "end", "x"), (4, 0, None, "only", "x"), (None, 0, "user", "lost", "x"), (2, 1, "assistant", "A", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r.conv_id: r for r in format_pairs(neighbour_pairs(conversation_arrays(df))).collect()}
    assert set(got) == {2, 3, 4}
    assert got[3].n_common == 1 and got[3].rejected == "<|assistant|>\nA<|end|>\n<|user|>\nend<|end|>\n"
    assert got[2].n_common == 2 and got[2].rejected == "<|assistant|>\nB<|end|>\n"
    assert got[4].n_common == 1 and got[4].prompt == "<|unknown|>\nonly<|end|>\n"
    assert format_pairs(neighbour_pairs(conversation_arrays(df.limit(0)))).count() == 0

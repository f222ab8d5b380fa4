"""Preference formatting: a pair of conversations becomes one prompt and two masked completions.

The prompt is the longest prefix of turns that both conversations share, rendered
once. What follows in each is its completion; its mask lists the character spans to
train on, those of the assistant's words with their closing marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversation_arrays(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id and turns, an array of (turn, role, text) in order.

    A null role is called unknown, a null text is empty; null turns come first,
    turns of one number by role and text; repeated rows repeat. Rows without a conversation
    belong to none and are left out.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.where(F.col(conversation).isNotNull()).groupBy(conversation).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def _safe(text: Column) -> Column:
    """text in which nothing looks like a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(t["role"]), F.lit(CLOSE))


def _body(t: Column) -> Column:
    return F.concat(_safe(t["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """start:end of each trained span of the rendered turns, in characters, comma-joined."""
    lengths = F.transform(turns, lambda t: F.struct((t["role"] == TRAINED).alias("own"), F.length(_head(t)).alias("head"), F.length(_body(t)).alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["head"]
        span = F.concat_ws(":", begin.cast("string"), (begin + x["body"]).cast("string"))
        return F.struct((begin + x["body"]).alias("at"), F.when(x["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(lengths, start, step, lambda acc: F.array_join(acc["spans"], ","))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many first turns have the same role and text."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other == 0, F.size(same)).otherwise(first_other - 1).cast("int")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs: two arrays of turns (with role and text). Both are replaced by their completions' text; adds prompt, n_common, chosen_mask, rejected_mask.

    Where one conversation is a prefix of the other, its completion is empty; a null
    array counts as one without turns; other columns stay, those named like new ones are replaced.
    """
    none = lambda c: F.coalesce(F.col(c), F.array().cast(pairs.schema[c].dataType))
    a, b = none(chosen), none(rejected)
    rest = lambda x: F.slice(x, F.col("n_common") + 1, F.size(x))
    return (
        pairs.withColumn("n_common", common_turns(a, b))
        .withColumns({"prompt": render(F.slice(a, F.lit(1), F.col("n_common"))), "chosen_mask": mask(rest(a)), "rejected_mask": mask(rest(b)), chosen: render(rest(a)), rejected: render(rest(b))})
    )


def neighbour_pairs(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Preference pairs out of single conversations (rows of conversation_arrays): id, chosen, rejected.

    chosen is the conversation itself; rejected has, for the text of its last
    assistant turn, that of its neighbour's (the ids 2k and 2k + 1 are neighbours), or
    none if there is no such text.
    """
    rows = conversations.withColumn("__last", F.try_element_at(F.filter("turns", lambda t: t["role"] == TRAINED), F.lit(-1)))
    other = rows.select(F.col(conversation).bitwiseXOR(F.lit(1)).alias("__id"), F.col("__last")["text"].alias("__text"))
    joined = rows.join(other, F.col(conversation) == F.col("__id"), "left")
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), F.lit(TRAINED))
    swapped = F.transform("turns", lambda t, i: F.when(F.col("__last").isNotNull() & (i == at), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.coalesce(F.col("__text"), F.lit("")).alias("text"))).otherwise(t))
    return joined.select(conversation, F.col("turns").alias("chosen"), swapped.alias("rejected"))

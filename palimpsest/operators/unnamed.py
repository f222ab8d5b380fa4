"""Unnamed variables: finding a variable's number in the new version by what stands around it.

Lines come as version ('old' or 'new'), file, line_no, line; a variable is the number
that a pattern captures. Each strategy returns name, new_value and confidence, so they
run as a cascade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchors
from .resolve import cascade
from .staged import staged, stored

VARIABLE = r"\b[a-z]*Local_([0-9]+)\b"
MOST = 25
SWITCH_LINES = 40
WINDOW_LINES = 15


def occurrences(lines: DataFrame, pattern: str = VARIABLE) -> DataFrame:
    """version, file, line_no, var: each variable once a line."""
    return lines.select("version", "file", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)))).alias("v")).select("version", "file", "line_no", F.col("v").cast("long").alias("var"))


def anchor_lines(lines: DataFrame, most: int = MOST) -> DataFrame:
    """version, file, line_no, anchor, freq: anchors on at most so many lines of their file."""
    a = lines.select("version", "file", "line_no", F.explode(anchors("line")).alias("anchor"))
    freq = a.groupBy("version", "file", "anchor").agg(F.count("*").alias("freq")).where(F.col("freq") <= most)
    return a.join(freq, ["version", "file", "anchor"])


def within(a: DataFrame, b: DataFrame, by: list[str], a_at: str, b_at: str, back: int, ahead: int) -> DataFrame:
    """a and b joined on by where b_at lies from a_at - back to a_at + ahead; through buckets of the window's width."""
    width = F.lit(back + ahead + 1)
    left = a.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((F.col(a_at) - back) / width), F.floor((F.col(a_at) + ahead) / width)))))
    right = b.withColumn("__b", F.floor(F.col(b_at) / width))
    return left.join(right, [*by, "__b"]).where((F.col(b_at) >= F.col(a_at) - back) & (F.col(b_at) <= F.col(a_at) + ahead)).drop("__b")


def _told(df: DataFrame, confidence: float) -> DataFrame:
    return df.select("name", F.col("new_var").alias("new_value"), F.lit(confidence).alias("confidence"))


def _none(entries: DataFrame) -> DataFrame:
    """What a strategy tells that finds nothing to go by; entries aren't moved for it."""
    return entries.where(F.lit(False)).select("name", F.lit(None).cast("long").alias("new_value"), F.lit(None).cast("double").alias("confidence"))


def by_vote(entries: DataFrame, occ: DataFrame, anch: DataFrame, window: int, confidence: float) -> DataFrame:
    """Anchors near the old variable vote for the variable nearest to them in the new file; rare and near ones weigh most."""
    old_occ = occ.where("version = 'old'").select("file", F.col("line_no").alias("ol"), F.col("var").alias("value"))
    old_anch = anch.where("version = 'old'").select("file", "anchor", F.col("line_no").alias("al"), F.col("freq").alias("fo"))
    new_anch = anch.where("version = 'new'").select("file", "anchor", F.col("line_no").alias("nl"), F.col("freq").alias("fn"))
    new_occ = occ.where("version = 'new'").select("file", F.col("line_no").alias("vl"), F.col("var").alias("new_var"))
    # what is nearest to a new anchor is the same for all old variables, so it is told before these come
    found = within(new_anch, new_occ, ["file"], "nl", "vl", window, window).withColumn("d2", F.abs(F.col("vl") - F.col("nl")))
    nearest = found.groupBy("file", "anchor", "nl", "fn").agg(F.min(F.struct("d2", "vl", "new_var")).alias("b")).select("file", "anchor", "fn", "b.new_var", "b.d2")
    near = within(entries.select("name", "value").join(old_occ, "value"), old_anch, ["file"], "ol", "al", window, window)
    met = near.select("name", "file", "anchor", "fo", F.abs(F.col("al") - F.col("ol")).alias("d1")).join(nearest, ["file", "anchor"])
    weight = 1.0 / (F.col("fo") * F.col("fn") * (1 + F.col("d1"))) / (1 + F.col("d2"))
    score = met.groupBy("name", "new_var").agg(F.round(F.sum(weight), 9).alias("s"))
    return _told(score.groupBy("name").agg(F.min_by("new_var", F.struct((-F.col("s")).alias("s"), F.col("new_var").alias("v"))).alias("new_var")), confidence)


def by_initializer(entries: DataFrame, lines: DataFrame, confidence: float = 0.99, pattern: str = VARIABLE) -> DataFrame:
    """A struct initialiser of at least six parts, the same and unique on both sides."""
    whole = r"^\s*(?:struct<[0-9]+>\s+)?[a-z]*Local_([0-9]+)\s*=\s*\{(.*)\}"
    rows = lines.where(F.col("line").rlike(whole)).select("version", "file", F.regexp_extract("line", whole, 1).cast("long").alias("var"), F.regexp_extract("line", whole, 2).alias("body"))
    rows = rows.where(F.size(F.split("body", ",")) > 5)
    once = lambda v, c: rows.where(F.col("version") == v).groupBy("file", "body").agg(F.min("var").alias(c), F.max("var").alias("o")).where(F.col(c) == F.col("o")).drop("o")
    both = once("old", "value").join(once("new", "new_var"), ["file", "body"]).groupBy("value").agg(F.min("new_var").alias("new_var"), F.max("new_var").alias("o")).where("new_var = o")
    both = staged(both)
    return _none(entries) if both.isEmpty() else _told(entries.join(both, "value"), confidence)


def by_switch(entries: DataFrame, lines: DataFrame, anch: DataFrame, confidence: float = 0.9) -> DataFrame:
    """A switch over the variable, or over a field or call of it, whose body shares most rare anchors; the least of several.

    An old switch is one of each variable in its parentheses, a new one of the last.
    """
    over = r"switch \(([^)]*)"
    inside = F.regexp_extract_all(F.regexp_extract("line", over, 1), F.lit(VARIABLE), F.lit(1))
    found = lines.where(F.col("line").rlike(over)).select("version", "file", F.col("line_no").alias("at"), inside.alias("vars")).where(F.size("vars") > 0)
    found = staged(found)
    if found.isEmpty():
        return _none(entries)
    heads = found.select("version", "file", "at", F.explode(F.when(F.col("version") == "old", F.array_distinct("vars")).otherwise(F.array(F.element_at("vars", -1)))).alias("v")).withColumn("var", F.col("v").cast("long")).drop("v")
    body = within(heads, anch.select("version", "file", F.col("line_no").alias("al"), "anchor", "freq"), ["version", "file"], "at", "al", 0, SWITCH_LINES).where("al > at")
    marks = body.groupBy("version", "file", "var", "anchor").agg(F.min("freq").alias("freq"))
    old = marks.where("version = 'old'").select("file", "anchor", F.col("var").alias("value"), "freq")
    new = marks.where("version = 'new'").select("file", "anchor", F.col("var").alias("new_var"))
    score = entries.select("name", "value").join(old, "value").join(new, ["file", "anchor"]).groupBy("name", "new_var").agg(F.round(F.sum(1.0 / F.col("freq")), 9).alias("s"))
    return _told(score.groupBy("name").agg(F.min_by("new_var", F.struct((-F.col("s")).alias("s"), F.col("new_var").alias("v"))).alias("new_var")), confidence)


def by_declaration(entries: DataFrame, lines: DataFrame, confidence: float = 0.8) -> DataFrame:
    """The declaration at the same place from the end of the block of declarations, blanks and comments before the entry function."""
    declared = r"^\s*(?:\w+(?:<[0-9]+>)?\s+)?[a-z]*Local_([0-9]+)\b[^(]*;\s*$"
    entry = lines.where(F.col("line").rlike(r"^void main\(|^void __EntryFunction__\(")).groupBy("version", "file").agg(F.min("line_no").alias("entry"))
    entry = staged(entry)
    if entry.isEmpty():
        return _none(entries)
    head = lines.join(entry, ["version", "file"]).where("line_no < entry")
    other = ~F.col("line").rlike(declared) & ~F.col("line").rlike(r"^\s*(#.*|//.*)?$")
    w = Window.partitionBy("version", "file").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    block = head.withColumn("broken", F.sum(other.cast("int")).over(w)).where("broken = 0").where(F.col("line").rlike(declared))
    placed = block.select("version", "file", F.regexp_extract("line", declared, 1).cast("long").alias("var"), F.row_number().over(Window.partitionBy("version", "file").orderBy(F.desc("line_no"))).alias("place"))
    old, new = (placed.where(F.col("version") == v).select("file", "place", F.col("var").alias(c)) for v, c in (("old", "value"), ("new", "new_var")))
    return _told(entries.join(old.join(new, ["file", "place"]).groupBy("value").agg(F.min("new_var").alias("new_var")), "value"), confidence)


def resolve_variables(entries: DataFrame, lines: DataFrame, pattern: str = VARIABLE) -> DataFrame:
    """entries: name, value (a variable's number). The cascade of the five strategies; see resolve.cascade for what it returns."""
    # both are read by most strategies
    occ, anch = stored(occurrences(lines, pattern)), stored(anchor_lines(lines))
    return cascade(
        entries,
        [
            ("initializer", lambda e: by_initializer(e, lines)),
            ("same_line", lambda e: by_vote(e, occ, anch, 0, 0.95)),
            ("switch", lambda e: by_switch(e, lines, anch)),
            ("declaration", lambda e: by_declaration(e, lines)),
            ("window", lambda e: by_vote(e, occ, anch, WINDOW_LINES, 0.6)),
        ],
    )


#: A field of a variable, and what it is compared with or set to.
_ACCESS = r"\b[a-z]*Local_([0-9]+)\.f_([0-9]+)\b(?:\s*(==|!=|<=|>=|=|<|>)\s*(-?[0-9]+))?"


def field_accesses(lines: DataFrame) -> DataFrame:
    """version, file, container, field, tokens: each field of a variable where it stands, with what marks the place: the number it meets, a switch before it, the line's calls and strings."""
    part = lambda i: F.regexp_extract_all("line", F.lit(_ACCESS), F.lit(i))
    found = lines.where(F.col("line").rlike(_ACCESS)).select("version", "file", "line", F.split("line", _ACCESS, -1).alias("pieces"), F.posexplode(F.arrays_zip(part(1).alias("c"), part(2).alias("f"), part(3).alias("op"), part(4).alias("n"))).alias("i", "z"))
    before = F.array_join(F.slice("pieces", F.lit(1), F.col("i") + 1), "")
    calls = F.transform(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]+::[A-Za-z_]+)"), F.lit(1)), lambda x: F.concat(F.lit("nat:"), x))
    texts = F.transform(F.regexp_extract_all("line", F.lit(r'"([^"]{3,})"'), F.lit(1)), lambda x: F.concat(F.lit("str:"), x))
    own = F.filter(F.array(F.when(F.col("z.n") != "", F.concat(F.lit("op"), "z.op", "z.n")), F.when(F.contains(before, F.lit("switch (")), "#switch")), lambda x: x.isNotNull())
    return found.select("version", "file", F.col("z.c").cast("long").alias("container"), F.col("z.f").cast("long").alias("field"), F.concat(own, calls, texts).alias("tokens"))


def field_signatures(accesses: DataFrame) -> DataFrame:
    """version, file, container, field, token, n: how often each token marks a field."""
    return accesses.select("version", "file", "container", "field", F.explode("tokens").alias("token")).groupBy("version", "file", "container", "field", "token").agg(F.count("*").alias("n"))


def resolve_struct_fields(entries: DataFrame, lines: DataFrame, containers: DataFrame, reach: int = 2000) -> DataFrame:
    """entries (name, file, value: a field's number) with container (the old variable), new_value and method; null where nothing tells.

    containers: file, container, new_container, ord: variables that are told already. A field's container is found among them: that
    with most direct accesses to the field, in the order of ord where equal, and the next one if it tells nothing: by alignment of
    all fields and by what marks the accesses where both agree, else by alignment, else by the marks, else by the step of the next aligned field below.
    Without any direct access, by the first container's step that tells one. Steps end at the highest aligned field.
    """
    from . import align
    from .context import best_overlap
    from .staged import staged
    from .structure import aligned_fields

    acc = staged(field_accesses(lines))
    pairs = staged(containers.select("file", "container", "new_container", "ord", F.concat_ws("|", "file", "container", "new_container").alias("base")))
    old = acc.where("version = 'old'").join(pairs, ["file", "container"])
    new = acc.where("version = 'new'").join(pairs.drop("container"), (acc["file"] == pairs["file"]) & (acc["container"] == F.col("new_container")))
    direct = old.groupBy("base", "field").agg(F.count("*").alias("uses"))
    moved = staged(aligned_fields(old.select("base", "field"), new.select("base", "field"), 64, reach))

    asked = entries.join(pairs, "file").join(direct.withColumnRenamed("field", "value"), ["base", "value"], "left")
    marks = staged(field_signatures(acc))
    wanted = asked.where("uses > 0").select("base", F.col("value").alias("o")).distinct()
    old_marks = marks.where("version = 'old'").join(pairs, ["file", "container"]).select("base", F.col("field").alias("o"), "token", "n").join(wanted, ["base", "o"], "left_semi")
    into = pairs.select("file", F.col("new_container").alias("container"), "base")
    new_marks = marks.where("version = 'new'").join(into, ["file", "container"]).select("base", F.col("field").alias("w"), "token", "n")
    met = best_overlap(old_marks, new_marks, ["base"], "o", "w", near=True).select("base", F.col("o").alias("value"), F.col("w").alias("__context"))
    steps = align.as_of(asked.select("base", F.col("value").alias("field")).distinct(), moved.withColumn("shift", F.col("new_field") - F.col("field")), ["base"], "field", "shift")
    stepped = steps.where("as_of IS NOT NULL").select("base", F.col("field").alias("value"), (F.col("field") + F.col("as_of")).alias("__step"))

    j = asked.join(moved.select("base", F.col("field").alias("value"), F.col("new_field").alias("__aligned")), ["base", "value"], "left").join(met, ["base", "value"], "left").join(stepped, ["base", "value"], "left")
    used = F.col("uses") > 0
    method = F.when(used & (F.col("__aligned") == F.col("__context")), "agreed").when(used & F.col("__aligned").isNotNull(), "aligned").when(used & F.col("__context").isNotNull(), "context").when(F.col("__step").isNotNull(), "step")
    told = j.withColumn("method", method).withColumn("new_value", F.when(F.col("method") == "step", F.col("__step")).when(F.col("method").isNotNull(), F.coalesce("__aligned", "__context")))
    order = F.struct(F.coalesce(-F.col("uses"), F.lit(0)).alias("u"), "ord", "container")
    best = told.groupBy("name").agg(F.min_by(F.struct("container", "new_value", "method"), F.when(F.col("new_value").isNotNull(), order)).alias("b"))
    return entries.join(best, "name", "left").select(*entries.columns, "b.container", "b.new_value", "b.method")


def resolve_fields(entries: DataFrame, aligned: DataFrame, contextual: DataFrame, stepped: DataFrame) -> DataFrame:
    """entries: name, value. By alignment and context where both agree, else alignment, else context, else the step function; each: value, new_value."""
    j = entries
    for df, c in ((aligned, "__a"), (contextual, "__c"), (stepped, "__s")):
        j = j.join(df.select("value", F.col("new_value").alias(c)), "value", "left")
    method = F.when(F.col("__a") == F.col("__c"), "agreed").when(F.col("__a").isNotNull(), "aligned").when(F.col("__c").isNotNull(), "context").when(F.col("__s").isNotNull(), "step")
    return j.withColumns({"method": method, "new_value": F.coalesce("__a", "__c", "__s")}).drop("__a", "__c", "__s")


def resolve_local_fields(entries: DataFrame, variables: DataFrame, fields: DataFrame, pattern: str = r"^([A-Za-z]*Local_)([0-9]+)\.f_([0-9]+)(.*)$") -> DataFrame:
    """entries (name, value) of a variable and a field of it: new_value and confidence, the lesser of both; only where both are told.

    variables: value, new_value and confidence by a variable's number; fields: variable, value, new_value and confidence.
    """
    part = lambda i: F.regexp_extract("value", pattern, i)
    e = entries.where(F.col("value").rlike(pattern)).select("name", "value", part(1).alias("__stem"), part(2).cast("long").alias("__var"), part(3).cast("long").alias("__field"), part(4).alias("__rest"))
    v = variables.select(F.col("value").alias("__var"), F.col("new_value").alias("__v"), F.col("confidence").alias("__cv"))
    f = fields.select(F.col("variable").alias("__var"), F.col("value").alias("__field"), F.col("new_value").alias("__f"), F.col("confidence").alias("__cf"))
    j = e.join(v, "__var").join(f, ["__var", "__field"]).where("__v IS NOT NULL AND __f IS NOT NULL")
    made = F.concat("__stem", F.col("__v").cast("string"), F.lit(".f_"), F.col("__f").cast("string"), "__rest")
    return j.select("name", "value", made.alias("new_value"), F.least("__cv", "__cf").cast("double").alias("confidence"))

"""Semantic extraction: mappings from key paths to addresses out of lines of serialising code.

The grammar is a set of regular expressions with named parts (see Grammar), so any
corpus in which containers are created under keys and values set in them can be read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence
from .staged import staged


@dataclass(frozen=True)
class Grammar:
    """Patterns of a line; groups are numbered as told."""

    create: str = r'^\s*(\w+) = make_(?:dict|list)\((\w+), (&?\w+|"[^"]*")\);'  # container, parent, key
    put: str = r'^\s*put_(\w+)\((\w+), (&?\w+|"[^"]*"), (.+)\);'  # type, container, key, value
    append: str = r"^\s*push_(\w+)\((\w+), (.+)\);"  # type, container, value
    load: str = r'^\s*copy\(&\((.+)\), get_(\w+)\((\w+), (&?\w+|"[^"]*")\)\);'  # value, type, container, key
    call: str = r"^\s*(\w+)\((.*)\);\s*$"  # function, arguments
    header: str = r"^\w+ (\w+)\((.*)\)\s*$"  # function, parameters
    forward: str = r"^\s*put_\w+\((\w+), (\w+), (\w+)\);"  # container, key, value
    build: str = r"^\s*set_label\(&?(\w+), (\w+)\);"  # label, text
    assign: str = r'^\s*set_label\(&(\w+), "([^"]*)"\);'  # label, text
    extend: str = r'^\s*add_label\(&(\w+), "([^"]*)"\);'  # label, text
    address: str = r"^[A-Za-z]+_[0-9]+"


def _part(line: Column, pattern: str, i: int) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, i))


def labels(lines: DataFrame, g: Grammar, by: list[str]) -> DataFrame:
    """by, line_no, label, text: what a label holds from a line on: an assignment starts it, extensions add to it.

    A call of a function that only assigns a label it is given assigns it too.
    """
    line = F.col("line")
    own = lines.select(*by, "line_no", F.coalesce(_part(line, g.assign, 1), _part(line, g.extend, 1)).alias("label"), line.rlike(g.assign).alias("reset"), F.coalesce(_part(line, g.assign, 2), _part(line, g.extend, 2)).alias("piece"))
    built = called(lines, g, by, g.build, ["label", "piece"])
    built = built.select(*by, "line_no", F.regexp_extract("label", r"^&(\w+)$", 1).alias("label"), F.lit(True).alias("reset"), F.regexp_extract("piece", r'^"([^"]*)"$', 1).alias("piece")).where("label <> '' AND piece <> ''")
    changes = staged(own.where("label is not null").unionByName(built))
    return sequence.running_label(changes, [*by, "label"], [F.col("line_no")], F.col("reset"), F.col("piece"), "", "text").select(*by, "line_no", "label", "text")


def forwarding(lines: DataFrame, by: list[str], header: str, body: str, names: list[str]) -> DataFrame:
    """Functions that hand their parameters to what body matches: by, function and, per name, the place (from 0) of the parameter in body's group; null where it is none.

    A function's lines go from its header to the next; its first match whose last two groups are both parameters counts.
    """
    from .keyed import first_wins

    line = F.col("line")
    head = F.when(line.rlike(header), F.struct(F.regexp_extract(line, header, 1).alias("f"), F.split(F.regexp_extract(line, header, 2), r",\s*").alias("args")))
    # no other line tells which function a match lies in
    own = sequence.last_before(lines.where(line.rlike(header) | line.rlike(body)), by, [F.col("line_no")], head, "own")
    held = own.where(line.rlike(body) & F.col("own").isNotNull()).select(*by, "line_no", F.col("own.f").alias("function"), F.transform(F.col("own.args"), lambda a: F.regexp_extract(a, r"(\w+)$", 1)).alias("args"), *(F.regexp_extract(line, body, i).alias(f"p{i}") for i in range(1, len(names) + 1)))
    places = held.withColumns({f"{n}_at": F.nullif(F.array_position("args", F.col(f"p{i}")), F.lit(0)) - 1 for i, n in enumerate(names, 1)})
    some = places.where(F.col(f"{names[-1]}_at").isNotNull() & F.col(f"{names[-2]}_at").isNotNull())
    return first_wins(some.select(*by, "function", "line_no", *(f"{n}_at" for n in names)), [*by, "function"], [F.col("line_no")]).drop("line_no")


def called(lines: DataFrame, g: Grammar, by: list[str], body: str, names: list[str]) -> DataFrame:
    """by, line_no and, per name, the argument that a call of a forwarding function of the file gives."""
    from .joins import call_arguments
    from .paths import split_arguments

    line = F.col("line")
    roles = forwarding(lines, by, g.header, body, names).withColumn("__f", F.concat_ws("\x00", *by, "function")).select("__f", *(F.col(f"{n}_at").cast("int").alias(n) for n in names))
    calls = lines.where(line.rlike(g.call)).select(*by, "line_no", F.concat_ws("\x00", *by, F.regexp_extract(line, g.call, 1)).alias("__f"), F.regexp_extract(line, g.call, 2).alias("text"))
    # only calls of these functions are cut into arguments
    some = calls.join(roles.select("__f"), "__f", "left_semi").withColumn("__args", split_arguments("text")).drop("text")
    return call_arguments(some, roles, "__f", "__args", names).select(*by, "line_no", *names)


def _keyed(rows: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """rows with a raw key to key and dynamic: a quoted key is itself, &label the label's text at that line."""
    literal = rows.withColumn("literal", F.regexp_extract("raw", r'^"([^"]*)"$', 1)).withColumn("label", F.regexp_extract("raw", r"^&(\w+)$", 1))
    both = literal.withColumn("text", F.lit(None).cast("string")).withColumn("is", F.lit(1)).unionByName(held.withColumn("is", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by, "label").orderBy("line_no", "is").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("held", F.last(F.when(F.col("is") == 0, F.col("text")), ignorenulls=True).over(w)).where(F.col("is") == 1)
    dynamic = F.col("label") != ""
    return seen.withColumns({"key": F.when(dynamic, F.col("held")).otherwise(F.nullif("literal", F.lit(""))), "dynamic": dynamic}).drop("literal", "label", "text", "is", "held", "raw")


def containers(lines: DataFrame, g: Grammar, by: list[str], held: DataFrame | None = None) -> DataFrame:
    """by, line_no, container, parent, key, dynamic; the first creation of a container in its file counts. held: the labels, if they are known."""
    from .keyed import first_wins

    line = F.col("line")
    made = lines.select(*by, "line_no", _part(line, g.create, 1).alias("container"), _part(line, g.create, 2).alias("parent"), _part(line, g.create, 3).alias("raw")).where("container is not null")
    return first_wins(_keyed(made, labels(lines, g, by) if held is None else held, by), [*by, "container"], [F.col("line_no")])


def container_paths(found: DataFrame, by: list[str]) -> DataFrame:
    """by, container, path, dynamic: keys from the outermost container down; a cycle's walk ends."""
    from .joins import parent_paths

    name = lambda c: F.concat_ws("\x00", *by, c)
    nodes = found.select(name("container").alias("id"), name("parent").alias("up"), "key")
    paths = parent_paths(nodes.where("key is not null"), "id", "up", "key", ".")
    return found.withColumn("id", name("container")).join(paths, "id", "left").select(*by, "container", "path", "dynamic")


def mappings(lines: DataFrame, g: Grammar | None = None, by: tuple[str, ...] = ("version", "file")) -> DataFrame:
    """lines: by, line_no, line. Returns by, line_no, key, path, value, type, dynamic of values set under keys or appended to containers.

    Values are set, loaded back, or handed to a function of the file that sets them. A value that isn't an address is left out; a key without a known container is a path of its own.
    """
    g, by = g or Grammar(), list(by)
    line = F.col("line")
    # lines that none of the patterns reads go, and what is left is written once for all that follows
    told = "|".join(f"(?:{p})" for p in (g.create, g.put, g.append, g.load, g.call, g.header, g.forward, g.build, g.assign, g.extend))
    lines = staged(lines.select(*by, "line_no", "line").where(line.rlike(told)))
    held = staged(labels(lines, g, by))
    paths = container_paths(containers(lines, g, by, held), by).select(*by, "container", F.col("path").alias("parent"), F.col("dynamic").alias("outer"))
    put = lines.select(*by, "line_no", _part(line, g.put, 1).alias("type"), _part(line, g.put, 2).alias("container"), _part(line, g.put, 3).alias("raw"), _part(line, g.put, 4).alias("value")).where("type is not null")
    loaded = lines.select(*by, "line_no", _part(line, g.load, 2).alias("type"), _part(line, g.load, 3).alias("container"), _part(line, g.load, 4).alias("raw"), _part(line, g.load, 1).alias("value")).where("type is not null")
    forwarded = called(lines, g, by, g.forward, ["container", "raw", "value"]).select(*by, "line_no", F.lit("call").alias("type"), "container", "raw", "value")
    put = _keyed(put.unionByName(loaded).unionByName(forwarded), held, by).join(paths, [*by, "container"], "left").withColumn("path", F.when(F.col("parent").isNull(), F.col("key")).otherwise(F.concat_ws(".", "parent", "key")))
    pushed = lines.select(*by, "line_no", _part(line, g.append, 1).alias("type"), _part(line, g.append, 2).alias("container"), _part(line, g.append, 3).alias("value")).where("type is not null")
    pushed = pushed.join(paths, [*by, "container"]).select(*by, "line_no", "type", "value", F.regexp_extract("parent", r"([^.]*)$", 1).alias("key"), F.col("parent").alias("path"), F.col("outer").alias("dynamic"))
    out = put.select(*by, "line_no", "type", "value", "key", "path", (F.col("dynamic") | F.coalesce("outer", F.lit(False))).alias("dynamic")).unionByName(pushed)
    return out.where(F.col("value").rlike(g.address) & F.col("path").isNotNull()).select(*by, "line_no", "key", "path", "value", "type", "dynamic")


def forward_and_backward(found: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """From one version's mappings: path and new_value, the first in order; and value and path, all, but bare paths only where no dotted one is."""
    from .keyed import first_wins, specific_over_generic

    forward = first_wins(found.select("path", F.col("value").alias("new_value"), *order), ["path"], [F.col(c) for c in order]).select("path", "new_value")
    return forward, specific_over_generic(found.select("value", "path").distinct(), ["value"], F.contains("path", F.lit(".")))


def with_variants(backward: DataFrame) -> DataFrame:
    """backward (value, path) with the other ways in which values are written (see paths.variants); a way that a value has itself is that value's alone."""
    from .paths import canonical, variants_of_whole, without_iteration

    # step by step, as each form is read several times by the next
    known = staged(backward.select(canonical("value").alias("value"), "path"))
    whole = known.select(without_iteration("value").alias("value"), "path")
    told = whole.select(F.posexplode(variants_of_whole("value")).alias("__at", "value"), "path")
    own = known.select("value").distinct().withColumn("__own", F.lit(True))
    return told.join(own, "value", "left").where((F.col("__at") == 0) | F.col("__own").isNull()).select("value", "path").distinct()


def loose_resolve(entries: DataFrame, backward: DataFrame, forward: DataFrame) -> DataFrame:
    """entries (name, value) told by their loose identity: name and new_value, in the entry's notation.

    All paths of old values of the same identity are followed; they must lead to one new value.
    """
    from .paths import canonical, in_notation_of, loose, offset_notation

    known = backward.select(loose(canonical("value")).alias("__k"), "path").where("__k IS NOT NULL").distinct()
    asked = entries.select("name", "value", loose(canonical("value")).alias("__k")).where("__k IS NOT NULL")
    told = asked.join(known, "__k").join(forward.select("path", "new_value"), "path")
    shown = offset_notation(in_notation_of(canonical("new_value"), canonical("value")))
    one = told.withColumn("__n", shown).groupBy("name").agg(F.count_distinct("__n").alias("n"), F.min("__n").alias("new_value"))
    return one.where("n = 1").select("name", "new_value")


def wrapper_roles(lines: DataFrame, by: list[str], header: str = Grammar.header, put: str = Grammar.forward) -> DataFrame:
    """Functions that forward their parameters to a put: by, function, container_at, key_at, value_at; see forwarding."""
    return forwarding(lines, by, header, put, ["container", "key", "value"])

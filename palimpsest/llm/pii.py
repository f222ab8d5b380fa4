"""Personal data: base patterns, then contextual extraction bootstrapped from them.

Base entities are found by four patterns and are the seeds. The word before an entity and
the word after it are lexical patterns. Patterns and instances score each other by grouped
sums: a pattern's confidence in a kind is the sum of its instances' scores for that kind over the number
of its instances of any kind and of the places where an ordinary word stands instead; unknown
instances count neither way. Unknown instances of confident patterns become
instances of that kind with a damped score, and may lift further patterns, until no new one
is found. What confident patterns mark and the base patterns miss is reported as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in a form that neither backtracks nor recurses on long runs. A match of the
#: first two can start only where a run of its first class does, or where the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an at sign, the unit that induced patterns extract; all others are ordinary words.
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
INDUCED = "id"
#: What must stand in a text for a pattern to match at all.
_NEEDLE = {"email": "@", "phone": "+"}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

DAMPING = 0.9
MIN_CONFIDENCE, MIN_SEEDS = 0.8, 5


def _normal(word: Column) -> Column:
    """Lower-cased and without punctuation around it; a word of punctuation alone stays; one with a digit or an at sign is none."""
    bare = F.regexp_replace(word, r"^\p{P}++|\p{P}++$", "")
    return F.when(F.contains(word, F.lit("@")) | word.rlike("[0-9]"), F.lit("")).otherwise(F.lower(F.when(bare == "", word).otherwise(bare)))


def spans_of(text: Column, pattern: str, around: bool = False) -> Column:
    """The matches in order: start, end (code points, end exclusive), value, and if around, left and right, the words before and after.

    The pieces between the matches and the matches themselves tile the text, so
    their lengths give the places.
    """
    fields = ["left", "right"] if around else []
    kind = "array<struct<" + ",".join(["start:int", "end:int", "value:string", *(f"{c}:string" for c in fields)]) + ">>"

    def gap(g: Column) -> Column:
        words = (F.regexp_extract(g, r"(?<!\S)(\S++)\s*+$", 1).alias("left"), F.regexp_extract(g, r"^\s*+(\S++)", 1).alias("right"))
        return F.struct(F.length(g).alias("n"), *words) if around else F.struct(F.length(g).alias("n"))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), gap)
    n = F.size(values)
    pairs = F.zip_with(values, F.slice(gaps, F.lit(1), n), lambda v, g: F.struct(v.alias("v"), g.alias("before")))
    if around:
        pairs = F.zip_with(pairs, F.slice(gaps, F.lit(2), n), lambda x, g: F.struct(x["v"].alias("v"), x["before"].alias("before"), g.alias("after")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]["n"]
        end = start + F.length(x["v"])
        words = (_normal(x["before"]["left"]).alias("left"), _normal(x["after"]["right"]).alias("right")) if around else ()
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), *words)).alias("out"))

    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
    return F.when(n > 0, folded).otherwise(F.array().cast(kind))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def _entities(text: Column, rank: int, kind: str) -> Column:
    found = F.filter(spans_of(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    kept = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))
    needle = _NEEDLE.get(kind)
    return F.when(F.contains(text, F.lit(needle)), kept).otherwise(F.slice(kept, 1, 0)) if needle else kept


def base_entities(text: Column) -> Column:
    """All valid base matches as (start, rank of the kind, end, value), in order."""
    return F.array_sort(F.concat(*(_entities(text, rank, kind) for rank, kind in enumerate(KINDS))))


def _described(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: row (a number of its own), the key, base entities, and instances: these and mentions without any (start, end, value, kind, left, right)."""
    one = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    one = one.withColumn("base", base_entities(F.col("t"))).withColumn("mentions", spans_of(F.col("t"), MENTION, around=True)).drop("t")

    def instance(start: Column, end: Column, value: Column, kind: Column, left: Column, right: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"), kind.cast("int").alias("kind"), left.alias("left"), right.alias("right"))

    def seed(b: Column) -> Column:
        held = F.filter("mentions", lambda m: (m["start"] < b["end"]) & (b["start"] < m["end"]))
        return instance(b["start"], b["end"], b["value"], b["rank"], F.get(held, F.lit(0))["left"], F.get(held, F.size(held) - 1)["right"])

    alone = F.filter("mentions", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    unknown = F.transform(alone, lambda m: instance(m["start"], m["end"], m["value"], F.lit(None), m["left"], m["right"]))
    return one.select("row", "id", "base", F.concat(F.transform("base", seed), unknown).alias("instances"))


def _contexts(instances: DataFrame) -> DataFrame:
    """A row per instance and pattern: side (the word before or after) and word."""
    both = F.expr("inline(array(struct('left' AS side, left AS word), struct('right' AS side, right AS word)))")
    return instances.select("row", "start", "end", "value", "kind", both).where("word <> ''")


def ordinary_words(df: DataFrame, text: str = "text") -> DataFrame:
    """word and n: how often each word without a digit or an at sign stands in the texts, as patterns name it."""
    words = df.select(F.explode(F.split(F.col(text), r"\s+")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return words.select(_normal(F.col("raw")).alias("word"), "n").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def confident_patterns(contexts: DataFrame, words: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """contexts: side, word, value, kind (null: unknown), a row per occurrence; words: see ordinary_words. Returns side, word, kind and confidence of the patterns to trust.

    A value that is an entity anywhere is one everywhere, of the least kind. A pattern
    needs min_seeds distinct values of a kind; its places without an instance are those of its word less those
    beside an instance. Of kinds equally good the least counts.
    """
    edges = contexts.groupBy("side", "word", "value").agg(F.min("kind").alias("kind"), F.count("*").alias("n"))
    known = edges.groupBy("value").agg(F.min("kind").alias("kind")).where("kind IS NOT NULL")
    beside = edges.groupBy("side", "word").agg(F.sum("n").alias("beside"))
    elsewhere = stored(beside.join(words, "word", "left").select("side", "word", F.greatest(F.coalesce("n", F.lit(0)) - F.col("beside"), F.lit(0)).alias("elsewhere")), "pattern-places")
    edges = stored(edges.select("side", "word", "value"), "pattern-edges")
    scored = stored(known.withColumn("score", F.lit(1.0)), "instances")
    while True:
        held = edges.join(scored, "value").groupBy("side", "word", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("seeds"))
        best = held.groupBy("side", "word").agg(F.sum("seeds").alias("all"), F.max_by(F.struct("score", "seeds", "kind"), F.struct("score", -F.col("kind"))).alias("b"))
        confidence = F.col("b.score") / (F.col("all") + F.col("elsewhere"))
        judged = best.where(F.col("b.seeds") >= min_seeds).join(elsewhere, ["side", "word"]).select("side", "word", F.col("b.kind").alias("kind"), confidence.alias("confidence"))
        trusted = stored(judged.where(F.col("confidence") >= min_confidence), "patterns")
        marked = edges.join(trusted, ["side", "word"]).groupBy("value").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", -F.col("kind"))).alias("b"))
        fresh = marked.join(scored, "value", "left_anti").select("value", F.col("b.kind").alias("kind"), (F.col("b.confidence") * DAMPING).alias("score"))
        fresh = stored(fresh, "instances")
        if fresh.isEmpty():
            for x in (fresh, scored, edges, elsewhere):
                discard(x)
            return trusted
        last, scored = scored, stored(scored.unionByName(fresh), "instances")
        for x in (last, fresh, trusted):
            discard(x)


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone (long), base_sha256, spans, n_id and n_found (long).

    spans lists kind:start:end by start, then kind, comma-joined; base_sha256 is the
    digest of that list of base entities alone. What patterns find besides, of kind id (n_id), never
    replaces or overlaps base ones; n_found counts all. A null text is empty; a null
    key stays; repeated rows count once as instances and each get their spans; other columns
    play no part. how: see confident_patterns.
    """
    rows = stored(_described(df, key, text), "personal-data")
    contexts = stored(_contexts(rows.select("row", F.explode("instances").alias("m")).select("row", "m.*")), "contexts")
    trusted = confident_patterns(contexts, ordinary_words(df, text), **how)
    unknown = contexts.where("kind IS NULL").select("row", "start", "end", "side", "word")
    found = unknown.join(trusted.select("side", "word"), ["side", "word"]).groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end")).alias("more"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end")))
    names = F.array(*map(F.lit, (*KINDS, INDUCED)))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    more = F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int>>"))

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda b: b["rank"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return rows.join(found, "row", "left").select(
        F.col("id").alias(key), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.array_sort(F.concat(base, more))).alias("spans"),
        F.size(more).cast("long").alias("n_id"), (F.size("base") + F.size(more)).cast("long").alias("n_found"),
    )

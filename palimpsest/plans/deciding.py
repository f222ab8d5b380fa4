"""Queries in which several ways are tried and their bounds decide: similarity, fuzzy resolution, fallbacks, family repair, gates and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fallbacks, fuzzy, needles, resolve, similarity, structure
from ..operators.scan import running
from ..operators.staged import staged
from .registry import query, table
from .resolving import CASCADE, cascaded

#: Ratcliff-Obershelp in SQL: of pairs p (a, b), the longest common block, the first of several in a, then in b; then what lies before and after it.
RATIO = """eq AS (SELECT a, b, i, j FROM (SELECT a, b, unnest(range(1, len(a) + 1)) AS i FROM p) q, range(1, 200) r(j) WHERE j <= len(b) AND a[i] = b[j]),
  runs AS (SELECT a, b, i, j, count(*) OVER (PARTITION BY a, b, i - j, g ORDER BY i DESC) AS run FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS g FROM eq)),
  seg(a, b, alo, ahi, blo, bhi, k) AS (SELECT a, b, 1::BIGINT, len(a) + 1, 1::BIGINT, len(b) + 1, 0::BIGINT FROM p UNION ALL
    SELECT a, b, CASE x WHEN 0 THEN alo ELSE i + k END, CASE x WHEN 0 THEN i ELSE ahi END, CASE x WHEN 0 THEN blo ELSE j + k END, CASE x WHEN 0 THEN j ELSE bhi END, CASE x WHEN 0 THEN k ELSE 0 END
    FROM (SELECT s.a, s.b, alo, ahi, blo, bhi, i, j, least(run, ahi - i, bhi - j) AS k, row_number() OVER (PARTITION BY s.a, s.b, alo, ahi, blo, bhi ORDER BY least(run, ahi - i, bhi - j) DESC, i, j) AS o
      FROM seg s JOIN runs r ON r.a = s.a AND r.b = s.b AND i >= alo AND i < ahi AND j >= blo AND j < bhi), (VALUES (0), (1)) v(x) WHERE o = 1),
  ratio AS (SELECT a, b, round(2.0 * sum(k) / (len(a) + len(b)), 6)::DOUBLE AS similarity FROM seg GROUP BY a, b)"""


@query("similar_names", f"""WITH RECURSIVE t AS (SELECT DISTINCT p_brand, p_type, p_name AS name, p_size <= 25 AS old FROM part), m AS (SELECT a.p_brand, a.p_type, a.name AS a, b.name AS b FROM t a JOIN t b USING (p_brand, p_type) WHERE a.old AND NOT b.old),
  p AS (SELECT DISTINCT a, b FROM m), {RATIO} SELECT p_brand, p_type, m.a AS a_id, m.b AS b_id, similarity FROM m JOIN ratio r ON r.a = m.a AND r.b = m.b WHERE similarity >= 0.58""")
def similar_names(spark, sf):
    t = table(spark, sf, "part").select("p_brand", "p_type", F.col("p_name").alias("id"), F.col("p_name").alias("text"), (F.col("p_size") <= 25).alias("old")).distinct()
    return similarity.similar_pairs(t.where("old"), t.where("NOT old"), ["p_brand", "p_type"], 0.58)


def corpus(spark, sf):
    """entries, lines, semantic paths and preferred files, made of customers: twenty to a file, two lines each, of which the new ones have moved."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.substring("c_mktsegment", 1, 4).alias("seg"), "c_nationkey")
    k = F.col("k")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    file = text("file", F.floor(k / 20))

    def side(version, shift):
        a = text("Root_", k % 7 + 100 + shift, ".f_", F.col("c_nationkey") % 4)
        b = F.when(k % 3 == 0, text("Root_", k % 5 + 300, "[", F.lit("i" if version == "old" else "k"), " /*9*/].f_", k % 2)).otherwise(text("iLocal_", k % 9 + shift))
        first = F.when(k % 4 == 0, text("  ", a, " = ", k % 10, ";")).when(k % 4 == 1, text("return ", a, ";")).otherwise(text("AREA::SET_", F.upper("seg"), "(", a, ");"))
        second = F.when(k % 6 == 0, text('call("', "seg", '", ', b, ");")).otherwise(text("if (", b, " == ", k % 3, ") {"))
        rows = c.select(file.alias("file"), k, F.posexplode(F.array(first, second)).alias("i", "line"))
        return rows.select(F.lit(version).alias("version"), "file", ((k % 20) * 2 + F.col("i") + 1).cast("long").alias("line_no"), "line")

    lines = side("old", 0).unionByName(side("new", 3))
    found = staged(fuzzy.mentions(side("old", 0), fuzzy.Notation()).select("value").distinct())
    entries = found.select(F.concat(F.lit("K_"), "value").alias("name"), "value")
    path = F.array(F.lit("top"), text("p", F.col("line_no") % 3))
    semantic = lines.where(F.col("line_no") % 13 == 0).select("version", "file", (F.col("line_no") + F.when(F.col("version") == "new", 1).otherwise(0)).alias("line_no"), path.alias("path"))
    preferred = entries.where("value LIKE '%Local%'").select("name", F.lit("file1").alias("file"), F.lit(0).alias("ord"))
    return entries, lines, semantic, preferred


@query("fuzzy_resolve")
def fuzzy_resolve(spark, sf):
    """Held against plain loops over entries in the tests: SQL would have to compare all windows of lines."""
    return fuzzy.resolve(*corpus(spark, sf))


@query("needle_scan", """WITH n AS (SELECT DISTINCT s AS needle FROM (SELECT unnest(string_split(text, '. ')) AS s FROM benchmark) WHERE s <> '') SELECT doc_id, needle, strlen(left(text, strpos(text, needle) - 1))::BIGINT AS "first" FROM documents, n WHERE contains(text, needle)""")
def needle_scan(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.explode(F.split("text", r"\. ", -1)).alias("needle"))
    return needles.counted(needles.occurrences(table(spark, sf, "documents"), "doc_id", "text", asked), "doc_id").drop("n")


@query("family_repair_whole", """WITH l AS (SELECT 'f' || l_suppkey || '_' AS family, 'f' || l_suppkey || '_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS name, 100 + l_linenumber % 3 AS r, 5 + l_suppkey % 3 AS s, l_partkey % 50 AS leaf, l_quantity::BIGINT % 7 = 0 AS off, l_linenumber AS ln FROM lineitem),
  a AS (SELECT *, CASE WHEN off THEN 900 + ln ELSE r + 40 END AS nr, CASE WHEN off THEN 3 ELSE s + 1 END AS ns, CASE WHEN off THEN leaf WHEN leaf >= 20 THEN leaf + 2 ELSE leaf + 1 END AS nl FROM l),
  g AS (SELECT family FROM a GROUP BY 1 HAVING count(*) >= 3),
  o AS (SELECT family, r AS mo FROM (SELECT family, r, row_number() OVER (PARTITION BY family ORDER BY n DESC, r::VARCHAR) AS k FROM (SELECT family, r, count(*) AS n FROM a GROUP BY family, r)) WHERE k = 1),
  w AS (SELECT family, nr AS mn FROM (SELECT family, nr, row_number() OVER (PARTITION BY family ORDER BY n DESC, nr::VARCHAR) AS k FROM (SELECT family, nr, count(*) AS n FROM a GROUP BY family, nr)) WHERE k = 1),
  t AS (SELECT family, ns AS ms FROM (SELECT family, ns, row_number() OVER (PARTITION BY family ORDER BY n DESC, ns::VARCHAR) AS k FROM (SELECT family, ns, count(*) AS n FROM a GROUP BY family, ns)) WHERE k = 1),
  f AS (SELECT a.*, mo, mn, ms FROM a JOIN g USING (family) JOIN o USING (family) JOIN w USING (family) JOIN t USING (family)),
  p AS (SELECT family, leaf AS at_, max(nl - leaf) AS shift FROM f WHERE r = mo AND nr = mn GROUP BY ALL), z AS (SELECT family, arg_min(shift, at_) AS first_shift FROM p GROUP BY 1),
  x AS (SELECT f.name, f.leaf + coalesce(p.shift, z.first_shift, 0) AS fl, mn, ms FROM (SELECT * FROM f WHERE r = mo AND nr <> mn) f ASOF LEFT JOIN p ON p.family = f.family AND p.at_ <= f.leaf LEFT JOIN z ON z.family = f.family)
  SELECT a.name, CASE WHEN x.name IS NOT NULL THEN 'Root_1.f_' || mn || '[i /*' || ms || '*/].f_' || fl ELSE 'Root_1.f_' || nr || '[i /*' || ns || '*/].f_' || nl END AS fixed_value, CASE WHEN x.name IS NOT NULL THEN 'root' END AS repair FROM a LEFT JOIN x USING (name)""")
def family_repair_whole(spark, sf):
    """A family for each supplier; every seventh quantity's line is an outlier."""
    supp, ln, leaf, off = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey") % 50, F.col("l_quantity").cast("long") % 7 == 0
    made = lambda r, s, x: F.concat(F.lit("Root_1.f_"), r, F.lit("[i /*"), s, F.lit("*/].f_"), x)
    family = F.concat(F.lit("f"), supp, F.lit("_"))
    old = made(100 + ln % 3, 5 + supp % 3, leaf)
    new = F.when(off, made(900 + ln, F.lit(3), leaf)).otherwise(made(140 + ln % 3, 6 + supp % 3, F.when(leaf >= 20, leaf + 2).otherwise(leaf + 1)))
    r = table(spark, sf, "lineitem").select(F.concat(family, "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey").alias("name"), family.alias("family"), old.alias("value"), new.alias("new_value"))
    return resolve.repair_families(r).select("name", "fixed_value", "repair")


@query("fallback_resolve", """WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS kind FROM part),
  t AS (SELECT k, kind, CASE WHEN kind = 0 THEN 'Root_1.f_' || 3 * k + 7 WHEN kind = 1 AND k % 10 <> 1 THEN 'Root_2.f_' || k + 1 || '[i /*4*/].f_1' WHEN kind = 2 THEN 'Root_3.f_' || k + CASE WHEN k % 2 = 0 THEN 0 ELSE 4 END WHEN kind = 3 THEN 'Root_4.f_' || k + 2 END AS new_value FROM p)
  SELECT 'K_' || k AS name, new_value, CASE WHEN new_value IS NULL THEN 'unresolved' WHEN kind = 0 THEN 'migrated_structural' WHEN kind = 1 THEN 'migrated_helper' WHEN kind = 2 AND k % 2 = 0 THEN 'unchanged' WHEN kind = 2 THEN 'migrated_loose' ELSE 'migrated_fallback' END AS status,
    CASE WHEN new_value IS NOT NULL THEN CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 ELSE 0.99 END END::DOUBLE AS confidence FROM t""")
def fallback_resolve(spark, sf):
    """By remainder: a scalar that moves with its run, a helper's key (every other one leads to another base), a semantic path of loose identity, a line of its own file, nothing."""
    k, p = F.col("k"), table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    kind = lambda n: p.where(k % 5 == n)
    value = F.when(k % 5 == 0, text("Root_1.f_", 3 * k)).when(k % 5 == 1, text("Root_2.f_", k, "[i /*4*/].f_1")).when(k % 5 == 2, text("Root_3.f_", k)).when(k % 5 == 3, text("Root_4.f_", k)).otherwise(text("Root_5.f_", k))
    entries = p.select(text("K_", k).alias("name"), value.alias("value"))
    fields = kind(0).select(F.lit("Root_1").alias("base"), (3 * k).alias("field"))
    array = spark.createDataFrame([], "base string, root bigint, stride bigint, stride2 bigint, child bigint")
    sub = spark.createDataFrame([], "base string, root bigint, sub bigint, stride bigint, leaf bigint")

    def structural(left, scalar_only):
        return structure.resolve_paths(left, (array, array), (sub, sub), (fields, fields.withColumn("field", F.col("field") + 7)), scalar_only=scalar_only).select("name", "new_value", "phase")

    keys = kind(1).select(text("K_", k).alias("key"), F.when(k % 10 == 1, F.lit("Root_9.f_1[i /*4*/].f_1")).otherwise(text("Root_2.f_", k + 1, "[i /*4*/].f_1")).alias("value"))
    none = spark.createDataFrame([], "key string, value string")
    backward = kind(2).select(text("Root_3.f_", k).alias("value"), text("p.", k).alias("path"))
    forward = kind(2).select(text("p.", k).alias("path"), text("Root_3.f_", k + F.when(k % 2 == 0, 0).otherwise(4)).alias("new_value"))
    side = lambda version, shift: kind(3).select(F.lit(version).alias("version"), text("f", k).alias("file"), F.lit(1).cast("long").alias("line_no"), text('call("tag', k, '", Root_4.f_', k + shift, ");").alias("line"))
    lines = side("old", 0).unionByName(side("new", 2))
    context = lambda left: fuzzy.resolve(left.select("name", "value"), lines).where("rank = 1").select("name", "new_value", "confidence")
    helper = lambda left: fallbacks.by_helper(left, none, keys, F.col("name"))
    return fallbacks.resolve_fallbacks(entries, structural, helper, (backward, forward), context, ["S_"]).select("name", "new_value", "status", "confidence")


@query("gated_publication", CASCADE + " SELECT count(*)::BIGINT AS rows, count(*) FILTER (new_value IS NOT NULL)::BIGINT AS resolved, count(*) FILTER (new_value IS NULL)::BIGINT AS unresolved, count(*) FILTER (new_value = value)::BIGINT AS agree FROM s")
def gated_publication(spark, sf):
    """The measures that come with writing the cascade's rows; the rows that were published are counted again."""
    from ..operators.staged import folder
    from ..sources.sinks import Gate, publish

    told = F.col("new_value").isNotNull()
    path = folder(spark, "published")
    m = publish(cascaded(spark, sf), path, Gate(F.lit(True), told, told, F.col("new_value") == F.col("value"), least_coverage=0.01))
    again = spark.read.parquet(path).agg(F.count("*").alias("rows"))
    return again.select("rows", *(F.lit(m[c]).cast("long").alias(c) for c in ("resolved", "unresolved", "agree")))


@query("cached_by_file", "SELECT source AS file, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS size, max(md5(text)) AS top FROM documents WHERE text IS NOT NULL GROUP BY source")
def cached_by_file(spark, sf):
    """A cache over another state of the documents, in which those in English are upper-cased and some sources have another name, brought up to date."""
    from ..operators.staged import folder
    from ..sources.corpus import refreshed

    d = table(spark, sf, "documents").where("text IS NOT NULL")
    lines = d.select(F.lit("v").alias("version"), F.col("source").alias("file"), F.col("doc_id").alias("line_no"), F.col("text").alias("line"))
    before = d.select(F.lit("v").alias("version"), F.when(F.col("source") == "src3", "gone").otherwise(F.col("source")).alias("file"), F.col("doc_id").alias("line_no"), F.when((F.col("lang") == "en") & (F.col("source") < "src2"), F.upper("text")).otherwise(F.col("text")).alias("line"))
    derive = lambda x: x.groupBy("version", "file").agg(F.count("*").alias("n"), F.sum(F.length("line").cast("long")).alias("size"), F.max(F.md5("line")).alias("top"))
    root = folder(spark, "cached")
    refreshed(before, root, derive)
    return refreshed(lines, root, derive).select("file", "n", "size", "top")


@query("whole_table_scan", """SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER w::BIGINT AS total, last_value(CASE WHEN l_returnflag = 'A' THEN l_suppkey END IGNORE NULLS) OVER w AS last_a, lag(l_partkey, 2) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS two_before,
  first_value(CASE WHEN l_returnflag = 'N' THEN l_orderkey END IGNORE NULLS) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_n FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace("OVER w::BIGINT", "OVER w"))
def whole_table_scan(spark, sf):
    """One group of all rows, in ranges of some thousand."""
    li = table(spark, sf, "lineitem").select(F.lit("all").alias("g"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    flag = F.col("l_returnflag")
    out = running(li, ["g"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], sums={"total": F.col("l_linenumber")}, lasts={"last_a": F.when(flag == "A", F.col("l_suppkey"))}, nexts={"next_n": F.when(flag == "N", F.col("l_orderkey"))}, shifts={"two_before": (F.col("l_partkey"), 2)}, most=20_000)
    return out.select("l_orderkey", "l_linenumber", "total", "last_a", "two_before", "next_n")


#: Named patterns, expressions or literals, of an indexed search.
PATTERNS = {"license": ("License", True), "address": (r"[a-z]+@[a-z]+\.(com|org)", False), "either": (r"(Copyright|MIT) [A-Za-z]+", False), "short": ("##", True)}


@query("indexed_search", "WITH l AS (SELECT doc_id, x.i::INT AS line_no, x.line AS line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'i': i - 1})) AS x FROM documents)) " + " UNION ALL ".join(f"SELECT '{n}' AS name, doc_id, line_no FROM l WHERE " + (f"contains(line, '{p}')" if literal else f"regexp_matches(line, '{p}')") for n, (p, literal) in PATTERNS.items()))
def indexed_search(spark, sf):
    """Each document is a file; only those whose trigrams allow a match are read."""
    from ..operators.staged import folder
    from ..sources import trigrams

    d = table(spark, sf, "documents").select(F.lit("v").alias("version"), F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    path = folder(spark, "trigrams")
    trigrams.build(d, path)
    return trigrams.search(d, path, PATTERNS).select("name", F.col("file").alias("doc_id"), "line_no")


@query("paged_decode", "WITH s AS (SELECT s_nationkey::VARCHAR AS script, s_suppkey % 3 AS params, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier) SELECT script, (7 * i)::INT AS seq, params::BIGINT AS value FROM s")
def paged_decode(spark, sf):
    """Where functions begin, in programs that are cut into pages of 64 bytes."""
    from ..operators import paged
    from .resolving import TABLE, programs

    return paged.instructions(programs(spark, sf, "old"), TABLE, 64).where("kind = 'enter'").select("script", "seq", "value")

"""Queries of joins, context matching, the cascade and programs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import bytecode, candidates, context, evidence, joins, keyed, metrics, paths, resolve, routing
from .keyed import NEW, OLD, SPLIT, events
from .registry import query, table


@query("interval_containment", f"""WITH i AS (SELECT user_id, event_id AS lo, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 3 AS hi, value FROM events WHERE event_type = 'signup')
  SELECT e.user_id, e.event_id, i.lo AS section FROM events e LEFT JOIN i ON i.user_id = e.user_id AND e.event_id >= i.lo AND e.event_id < i.hi WHERE e.event_type = 'click'""")
def interval_containment(spark, sf):
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    i = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("lo"), (F.lead("event_id").over(w) - 3).alias("hi"), F.col("event_id").alias("section"))
    return joins.containing(e.where("event_type = 'click'").select("user_id", "event_id"), i, ["user_id"], "event_id", "lo", "hi", ["section"])


TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 3 END AS up, 'n' || (p_partkey % 10)::VARCHAR AS label FROM part"


@query("recursive_parent_path", f"""WITH RECURSIVE t AS ({TREE}), w(id, up, path, depth) AS (SELECT id, up, label, 1 FROM t UNION ALL SELECT w.id, t.up, t.label || '.' || w.path, w.depth + 1 FROM w JOIN t ON t.id = w.up)
  SELECT id, arg_max(path, depth) AS path, max(depth)::INT AS depth FROM w GROUP BY id""")
def recursive_parent_path(spark, sf):
    k = F.col("p_partkey")
    tree = table(spark, sf, "part").select(k.alias("id"), F.when(k > 0, F.floor(k / 3)).alias("up"), F.concat(F.lit("n"), (k % 10).cast("string")).alias("label"))
    return joins.parent_paths(tree, "id", "up", "label")


@query("positional_zip", """WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'A') AS x, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'N') AS y FROM lineitem GROUP BY 1)
  SELECT l_orderkey, (i - 1)::INT AS place, x[i] AS a_value, y[i] AS b_value FROM a, range(1, 9) t(i) WHERE len(x) = len(y) AND i <= len(x)""")
def positional_zip(spark, sf):
    pick = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == f, F.struct("l_linenumber", "l_partkey")))), lambda s: s["l_partkey"])
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(pick("A").alias("x"), pick("N").alias("y"))
    return joins.zipped(a, ["l_orderkey"], "x", "y")


@query("callsite_definition_join", """WITH c AS (SELECT o_orderkey, 'func_' || (o_custkey % 40)::VARCHAR AS f, [o_orderpriority, o_orderstatus, o_custkey::VARCHAR] AS args FROM orders), r AS (SELECT 'func_' || p_partkey::VARCHAR AS f, p_size % 4 AS key_at, p_size % 3 AS value_at FROM part)
  SELECT o_orderkey, f, args[key_at + 1] AS key_at, args[value_at + 1] AS value_at FROM c JOIN r USING (f)""")
def callsite_definition_join(spark, sf):
    calls = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("func_"), (F.col("o_custkey") % 40).cast("string")).alias("f"), F.array("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")).alias("args"))
    roles = table(spark, sf, "part").select(F.concat(F.lit("func_"), F.col("p_partkey").cast("string")).alias("f"), (F.col("p_size") % 4).alias("key_at"), (F.col("p_size") % 3).alias("value_at"))
    return joins.call_arguments(calls, roles, "f", "args", ["key_at", "value_at"]).drop("args")


@query("override_dimension", "SELECT c_custkey, CASE WHEN c_nationkey IN (1, 5, 9) THEN 'verified_' || c_nationkey::VARCHAR ELSE c_mktsegment END AS segment, c_nationkey IN (1, 5, 9) AS overridden FROM customer")
def override_dimension(spark, sf):
    fixed = spark.createDataFrame([(n, f"verified_{n}") for n in (1, 5, 9)], "c_nationkey int, segment string")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    return evidence.overridden(c, "c_nationkey", fixed, "segment").select("c_custkey", "segment", "overridden")


@query("crosswalk_default", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 100 ELSE n_nationkey END AS mapped FROM nation")
def crosswalk_default(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey")
    return joins.with_default(n, n.where("n_nationkey % 2 = 0").withColumn("to", F.col("n_nationkey") + 100), "n_nationkey", "to", "mapped")


@query("inverse_lookup", "SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def inverse_lookup(spark, sf):
    return keyed.last_wins(table(spark, sf, "part"), ["p_name"], "p_partkey", [F.col("p_partkey")])


@query("identity_fallback", "SELECT DISTINCT a.l_suppkey AS key, b.l_suppkey IS NOT NULL AS same FROM (SELECT * FROM lineitem WHERE l_returnflag = 'A') a LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity = 50) b USING (l_suppkey)")
def identity_fallback(spark, sf):
    li = table(spark, sf, "lineitem")
    used = li.where("l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity = 50").select("l_suppkey").distinct().withColumn("same", F.lit(True))
    return li.where("l_returnflag = 'A'").select("l_suppkey").distinct().join(used, "l_suppkey", "left").select(F.col("l_suppkey").alias("key"), F.coalesce("same", F.lit(False)).alias("same"))


WORDS = "SELECT DISTINCT {k} AS k, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM {t}"


@query("anchor_vote", f"""WITH a AS (SELECT k AS item_id, token FROM ({WORDS.format(k='item_id', t='benchmark')})), b AS (SELECT k AS doc_id, token FROM ({WORDS.format(k='doc_id', t='documents')})),
  fa AS (SELECT token, count(*) AS fa FROM a GROUP BY 1 HAVING count(*) <= 25), fb AS (SELECT token, count(*) AS fb FROM b GROUP BY 1 HAVING count(*) <= 25),
  s AS (SELECT item_id, doc_id, count(*)::BIGINT AS shared, round(sum(1.0::DOUBLE / (fa * fb)), 6) AS score FROM a JOIN fa USING (token) JOIN b USING (token) JOIN fb USING (token) GROUP BY ALL)
  SELECT item_id, doc_id, shared, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r = 1""")
def anchor_vote(spark, sf):
    side = lambda t, k: context.tokens_of(table(spark, sf, t), k, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return context.anchor_vote(side("benchmark", "item_id"), side("documents", "doc_id"), "item_id", "doc_id")


@query("switch_overlap_best", """WITH t AS (SELECT conv_id % 5 AS g, conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS token FROM conversations) GROUP BY ALL), o AS (SELECT * FROM t WHERE conv_id % 2 = 0), n AS (SELECT * FROM t WHERE conv_id % 2 = 1),
  f AS (SELECT g, token, count(*) AS f FROM n GROUP BY ALL), s AS (SELECT g, o.conv_id AS old_id, n.conv_id AS new_id, round(sum(least(o.n, n.n) / f), 6) AS score FROM o JOIN n USING (g, token) JOIN f USING (g, token) GROUP BY ALL)
  SELECT g, old_id, new_id, score FROM (SELECT *, row_number() OVER (PARTITION BY g, old_id ORDER BY score DESC, new_id) AS r FROM s) WHERE r = 1""")
def switch_overlap_best(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("token"))
    t = c.groupBy((F.col("conv_id") % 5).alias("g"), "conv_id", "token").agg(F.count("*").alias("n"))
    half = lambda r, k: t.where(F.col("conv_id") % 2 == r).withColumnRenamed("conv_id", k)
    return context.best_overlap(half(0, "old_id"), half(1, "new_id"), ["g"], "old_id", "new_id")


@query("literal_body_match", """WITH k AS (SELECT md5(text) AS body, length(text)::BIGINT AS n, doc_id FROM documents), a AS (SELECT body, n, min(doc_id) AS old_id FROM k WHERE doc_id % 2 = 0 GROUP BY ALL HAVING count(*) = 1), b AS (SELECT body, n, min(doc_id) AS new_id FROM k WHERE doc_id % 2 = 1 GROUP BY ALL HAVING count(*) = 1) SELECT n, old_id, new_id FROM a JOIN b USING (body, n)""")
def literal_body_match(spark, sf):
    k = table(spark, sf, "documents").select(F.md5("text").alias("body"), F.length("text").cast("long").alias("n"), "doc_id")
    half = lambda r, c: k.where(F.col("doc_id") % 2 == r).withColumnRenamed("doc_id", c)
    return keyed.unique_both_ways(half(0, "old_id"), half(1, "new_id"), ["body", "n"]).drop("body")


@query("fuzzy_context_score")
def fuzzy_context_score(spark, sf):
    """Benchmark items' lines and the like lines of the document that each is nearest to; similar_names holds the similarity against SQL."""
    from ..operators.similarity import similar_pairs

    near = anchor_vote(spark, sf).select("item_id", "doc_id")
    lines = lambda t, k: near.join(table(spark, sf, t).select(k, "text"), k).select("item_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("id", "text"))
    scored = similar_pairs(lines("benchmark", "item_id"), lines("documents", "doc_id"), ["item_id", "doc_id"], candidates.LEAST_LINE)
    best = scored.groupBy("item_id", "doc_id").agg(F.max("similarity").alias("line"))
    found = best.select(F.col("item_id").alias("name"), F.col("doc_id").cast("string").alias("value"), F.col("line").alias("confidence"), F.lit("context match").alias("reason"), F.lit(1).alias("source_rank"), F.lit(0).alias("place"))
    return context.merge_candidates(found, "name", "value")


@query("index_variants", """WITH v AS (SELECT l_orderkey, l_linenumber, 'Root_' || l_suppkey || '.f_' || l_linenumber AS a, ' /*' || (l_partkey % 97) || '*/]' AS s, l_partkey % 4 AS k FROM lineitem),
  c AS (SELECT *, CASE k WHEN 0 THEN a || '[i' || s || '.f_2[j]' WHEN 1 THEN a || '[i' || s || '.f_2[j' || s WHEN 2 THEN a || '[7]' ELSE a || '[a + 1][i]' END AS canonical,
    CASE k WHEN 0 THEN [a || '[i' || s || '.f_2', a || '.f_2'] WHEN 1 THEN [a || '[i' || s || '.f_2[j' || s, a || '[i' || s || '.f_2', a || '.f_2'] WHEN 2 THEN [a || '[7]'] ELSE [a || '[a + 1]'] END AS variants FROM v)
  SELECT l_orderkey, l_linenumber, canonical, (i - 1)::INT AS place, variants[i] AS variant FROM (SELECT *, unnest(range(1, len(variants) + 1)) AS i FROM c)""")
def index_variants(spark, sf):
    root, stride, k = F.concat(F.lit("Root_"), F.col("l_suppkey"), F.lit(".f_"), F.col("l_linenumber")), F.concat(F.lit("/*"), F.col("l_partkey") % 97, F.lit("*/")), F.col("l_partkey") % 4
    value = F.when(k == 0, F.concat(root, F.lit("[ iVar0  "), stride, F.lit("].f_2[iVar1]"))).when(k == 1, F.concat(root, F.lit("[iVar0 "), stride, F.lit("].f_2[x "), stride, F.lit(" ]"))).when(k == 2, F.concat(root, F.lit("[7]"))).otherwise(F.concat(root, F.lit("[a + 1][n]")))
    c = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", paths.canonical(value).alias("canonical"))
    return c.select("l_orderkey", "l_linenumber", "canonical", F.posexplode(paths.variants("canonical")).alias("place", "variant"))


@query("notation_align", """WITH v AS (SELECT p_partkey, 'Root_' || p_partkey AS r, p_size AS n, p_partkey % 3 AS k FROM part)
  SELECT p_partkey, r || '.f_3[j /*9*/]' || CASE WHEN k = 0 THEN '' ELSE '.f_' || k * n END || '.f_1' AS offsets, r || ' +3 *9 +' || (k * n + 1) AS loose,
    r || '.f_3' || CASE WHEN k = 1 THEN '[j /*9*/]' ELSE '' END || '[' || k || ' /*' || n || '*/].f_1' AS aligned, 'y' || p_partkey AS unread, NULL::VARCHAR AS unread_loose FROM v""")
def notation_align(spark, sf):
    k = F.col("p_partkey") % 3
    value = F.concat(F.lit("Root_"), F.col("p_partkey"), F.lit(".f_3[j /*9*/]["), k, F.lit(" /*"), F.col("p_size"), F.lit("*/].f_1[i]"))
    like = F.when(k == 1, F.lit("Root_1.f_2[i /*4*/].f_3")).otherwise(F.lit("Root_1.f_2.f_3.f_9"))
    p = table(spark, sf, "part").select("p_partkey", value.alias("value"), like.alias("like"), F.concat(F.lit("y"), F.col("p_partkey")).alias("other"))
    return p.select("p_partkey", paths.offset_notation("value").alias("offsets"), F.array_join(paths.loose("value"), " ").alias("loose"), paths.in_notation_of("value", "like").alias("aligned"), paths.offset_notation("other").alias("unread"), F.array_join(paths.loose("other"), " ").alias("unread_loose"))


@query("args_split", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['f(a, b)', '"x, \\" y"', 'g[' || event_id || ', 2]', event_type] WHEN 1 THEN [event_type, 'h(a], b), c' || event_id] ELSE [event_type || '[(1, 2), ' || event_id || ']', ''] END AS args FROM events""")
def args_split(spark, sf):
    n, kind = F.col("event_id"), F.col("event_type")
    call = F.when(n % 3 == 0, F.concat(F.lit('f(a, b) , "x, \\" y",g['), n, F.lit(", 2], "), kind))
    call = call.when(n % 3 == 1, F.concat(kind, F.lit(", h(a], b), c"), n)).otherwise(F.concat(kind, F.lit("[(1, 2), "), n, F.lit("], ")))
    return table(spark, sf, "events").select("event_id", paths.split_arguments(call).alias("args"))


@query("stripped_reference", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'x.f_' || event_id WHEN 2 THEN '(y)' WHEN 3 THEN 'a' || event_id ELSE 'b' END AS bare FROM events""")
def stripped_reference(spark, sf):
    n, kind = F.col("event_id"), F.col("event_type")
    forms = F.when(n % 5 == 0, F.concat(F.lit(" &"), kind)).when(n % 5 == 1, F.concat(F.lit("&(*(x.f_"), n, F.lit(")) "))).when(n % 5 == 2, F.lit("((y))")).when(n % 5 == 3, F.concat(F.lit("*( a"), n, F.lit(" )"))).otherwise(F.lit("b"))
    return table(spark, sf, "events").select("event_id", text.stripped_reference(forms).alias("bare"))


@query("stride_only_change", """WITH v AS (SELECT l_orderkey, l_linenumber, 'Root_1.f_' || l_linenumber::VARCHAR || '[i /*' || (l_partkey % 5)::VARCHAR || '*/].f_2' AS a, 'Root_1.f_' || (l_linenumber + l_suppkey % 2)::VARCHAR || '[i /*' || (l_partkey % 3)::VARCHAR || '*/].f_2' AS b FROM lineitem)
  SELECT l_orderkey, l_linenumber, regexp_replace(a, '\\s*/\\*\\s*[0-9]+\\s*\\*/', '', 'g') = regexp_replace(b, '\\s*/\\*\\s*[0-9]+\\s*\\*/', '', 'g') AS stride_only FROM v""".replace("\\\\", "\\"))
def stride_only_change(spark, sf):
    make = lambda field, stride: F.concat(F.lit("Root_1.f_"), field.cast("string"), F.lit("[i /*"), stride.cast("string"), F.lit("*/].f_2"))
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (paths.without_strides(make(n, p % 5)) == paths.without_strides(make(n + F.col("l_suppkey") % 2, p % 3))).alias("stride_only"))


@query("weighted_role_score", """WITH w(event_type, weight) AS (VALUES ('purchase', 5.0::DOUBLE), ('click', 1.0::DOUBLE), ('error', -0.5::DOUBLE)), s AS (SELECT user_id, round(sum(weight * n), 6) AS score, count(*)::BIGINT AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) JOIN w USING (event_type) GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3)
  SELECT user_id % 10 AS g, arg_max(user_id, {'s': score, 'u': -user_id}) AS user_id, max(score) AS score FROM s GROUP BY 1""")
def weighted_role_score(spark, sf):
    w = spark.createDataFrame([("purchase", 5.0), ("click", 1.0), ("error", -0.5)], "event_type string, weight double")
    s = evidence.weighted_score(table(spark, sf, "events"), ["user_id"], "event_type", w, (2, 3))
    return keyed.first_wins(s.withColumn("g", F.col("user_id") % 10), ["g"], [-F.col("score"), F.col("user_id")]).select("g", "user_id", "score")


@query("state_statistics", """WITH a AS (SELECT user_id, event_type AS state FROM events WHERE event_id % 3 > 0 UNION ALL SELECT user_id + 1, 'set_' || event_type FROM events WHERE event_id % 3 = 0)
  SELECT user_id, count(DISTINCT state)::BIGINT AS states, max(state) AS top, string_agg(DISTINCT state, ',' ORDER BY state) AS names FROM a GROUP BY user_id""")
def state_statistics(spark, sf):
    e = table(spark, sf, "events")
    calls = e.where("event_id % 3 = 0").select(F.concat(F.lit("f"), F.col("user_id")).alias("function"), F.concat(F.lit("set_"), "event_type").alias("state"))
    setters = e.select(F.concat(F.lit("f"), F.col("user_id")).alias("function"), (F.col("user_id") + 1).alias("user_id")).distinct()
    return evidence.state_statistics(e.where("event_id % 3 > 0").withColumnRenamed("event_type", "state"), "user_id", "state", setters, calls)


@query("cooccurrence_counts", "WITH l AS (SELECT source, x.line AS line, x.i AS i FROM (SELECT source, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'i': i - 1})) AS x FROM documents)) SELECT source, count(*) FILTER (contains(line, 'License') AND contains(line, 'the'))::BIGINT AS both_, count(*) FILTER (contains(line, '@'))::BIGINT AS at_sign FROM l WHERE i BETWEEN 1 AND 20 GROUP BY source")
def cooccurrence_counts(spark, sf):
    """Of all texts, the lines after the first and up to the twentieth."""
    lines = table(spark, sf, "documents").select("source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return evidence.cooccurrences(lines, ["source"], "line", {"both_": ["License", "the"], "at_sign": ["@"]}, "i", 1, 20)


@query("role_root", """WITH a AS (SELECT l_suppkey % 20 AS file, l_partkey % 50 AS root, l_linenumber AS field FROM lineitem WHERE l_linenumber <> 3), w(field, weight) AS (VALUES (1, 4.0::DOUBLE), (2, 1.5::DOUBLE), (5, 0.5::DOUBLE)),
  s AS (SELECT file, root, root * 7 % 40 + 800 AS size, round(sum(weight), 6) AS score, count(DISTINCT field) AS fields FROM a JOIN w USING (field) WHERE root * 7 % 40 + 800 BETWEEN 805 AND 830 GROUP BY ALL)
  SELECT file, root AS value, score, fields::BIGINT AS fields, round(least(0.92 + score * 0.00005 + fields * 0.001, 0.999), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, fields DESC, size DESC, root) AS r FROM s) WHERE r = 1""")
def role_root(spark, sf):
    from ..operators import roles

    a = table(spark, sf, "lineitem").where("l_linenumber <> 3").select((F.col("l_suppkey") % 20).alias("file"), (F.col("l_partkey") % 50).alias("root"), F.col("l_linenumber").alias("field"))
    sizes = a.select("file", "root", (F.col("root") * 7 % 40 + 800).alias("size")).distinct()
    w = spark.createDataFrame([(1, 4.0), (2, 1.5), (5, 0.5)], "field int, weight double")
    return roles.root_role(a, sizes, w, (805, 830), per_score=0.00005, per_field=0.001)


@query("role_argument", """WITH c AS (SELECT p_partkey AS k, p_size % 8 AS n, p_partkey % 4 AS rule FROM part)
  SELECT k AS file, CASE rule WHEN 0 THEN CASE WHEN n >= 5 THEN 'a' || k END WHEN 1 THEN CASE WHEN n >= 4 THEN 'b' || k END WHEN 2 THEN 'c' || k ELSE 'z' || k END AS value FROM c""")
def role_argument(spark, sf):
    """Calls of the form u, worker, some p, u, u, other, u."""
    from ..operators import roles

    k, n = F.col("p_partkey"), F.col("p_size") % 8
    one = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(name), k).alias("root"))
    run = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("p").alias("kind"), F.concat(F.lit("p"), i).alias("root")))
    args = F.concat(F.array(one("u", "z"), one("o", "worker")), F.when(n > 0, run).otherwise(F.slice(run, 1, 0)), F.array(one("u", "a"), one("u", "b"), one("o", "x"), one("u", "c")))
    rule = F.when(k % 4 == 0, "after_run").when(k % 4 == 1, "second_after_run").when(k % 4 == 2, "last").otherwise("previous")
    calls = table(spark, sf, "part").select(k.alias("file"), args.alias("args"), F.concat(F.lit("worker"), k).alias("worker"), rule.alias("rule"), F.when(k % 4 == 0, 5).otherwise(4).alias("least"))
    return roles.argument_role(calls, F.col("worker"), F.col("rule"), F.col("least")).select("file", "value")


@query("role_state", """WITH s AS (SELECT o_custkey % 30 AS file, o_custkey % 7 AS variable, o_orderkey % 40 AS state FROM orders), t AS (SELECT file, variable, count(DISTINCT state) AS states, max(state) AS top FROM s GROUP BY ALL HAVING count(DISTINCT state) >= 8),
  w AS (SELECT file, variable, count(*) % 9 AS cases, count(*) AS uses FROM s GROUP BY ALL), r AS (SELECT file, variable, round(states * 5.0 + cases * 1.5 + least(uses, 25) * 0.15 + top * 0.01 + CASE WHEN (file + variable) % 5 = 0 THEN 250.0 ELSE 0 END, 6)::DOUBLE AS score FROM w JOIN t USING (file, variable))
  SELECT file, arg_max(variable, {'s': score, 'v': variable}) AS value, max(score) AS score FROM r GROUP BY file""")
def role_state(spark, sf):
    from ..operators import roles

    s = table(spark, sf, "orders").select((F.col("o_custkey") % 30).alias("file"), (F.col("o_custkey") % 7).alias("variable"), (F.col("o_orderkey") % 40).alias("state"))
    switches = s.groupBy("file", "variable").agg((F.count("*") % 9).alias("cases"), F.count("*").alias("uses")).withColumn("function", F.col("file") + F.col("variable"))
    return roles.state_role(switches, s, switches.where("function % 5 = 0"))


@query("role_gate", """WITH b AS (SELECT user_id % 25 AS file, user_id AS block, 'v' || user_id % 3 AS v, count(*) FILTER (event_type = 'click') > 0 AS c, count(*) FILTER (event_type = 'purchase') > 0 AS s, count(*) FILTER (event_type = 'error') > 0 AS r, count(*) FILTER (event_type = 'signup') > 0 AS n FROM events GROUP BY user_id),
  h AS (SELECT file, v, count(*) AS blocks FROM b WHERE c AND s AND r AND n GROUP BY ALL) SELECT file, v AS value, blocks::BIGINT AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY blocks DESC, v) AS i FROM h) WHERE i = 1""")
def role_gate(spark, sf):
    from ..operators import roles

    t, v = F.col("event_type"), F.concat(F.lit("v"), F.col("user_id") % 3)
    line = F.when(t == "click", F.concat(F.lit("  if ("), v, F.lit(" == 1)"))).when(t == "purchase", F.concat(v, F.lit(" = 1;"))).when(t == "error", F.concat(F.lit("  "), v, F.lit(" = 0;"))).when(t == "signup", F.lit("copy(pre, worker);")).otherwise("other();")
    lines = table(spark, sf, "events").select((F.col("user_id") % 25).alias("file"), F.col("user_id").alias("block"), v.alias("variable"), line.alias("line"))
    return roles.gate_role(lines, "variable", "line", ["pre", "worker"])


@query("containers_by_access", "WITH c AS (SELECT user_id % 20 AS g, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT g, event_type, n::BIGINT AS n, row_number() OVER (PARTITION BY g ORDER BY n DESC, f, event_type)::INT AS rank FROM c")
def containers_by_access(spark, sf):
    return evidence.by_access(table(spark, sf, "events").withColumn("g", F.col("user_id") % 20), ["g"], "event_type", "event_id")


@query("routed_resolve", """WITH e AS (SELECT p_partkey, 'KEY_' || replace(p_brand, '#', '_') || '_' || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'Root_' || p_partkey || '.f_' || p_size WHEN 1 THEN 'iVar' || p_size WHEN 2 THEN 'f_' || p_size ELSE p_size::VARCHAR END AS value FROM part)
  SELECT name, value, CASE WHEN p_partkey % 50 = 0 THEN 'anchor' WHEN starts_with(name, 'KEY_Brand_11') THEN 'skip' ELSE CASE p_partkey % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'local' WHEN 2 THEN 'field' ELSE 'static' END END AS route,
    CASE WHEN p_partkey % 50 = 0 THEN 'told' WHEN starts_with(name, 'KEY_Brand_11') OR p_partkey % 4 = 3 THEN value WHEN p_partkey % 4 = 0 AND p_partkey % 3 > 0 THEN value || '.f_1' WHEN p_partkey % 4 = 1 THEN value END AS new_value,
    CASE WHEN p_partkey % 50 = 0 OR starts_with(name, 'KEY_Brand_11') OR p_partkey % 4 = 3 THEN 1.0 WHEN p_partkey % 4 = 0 AND p_partkey % 3 > 0 THEN 0.9 WHEN p_partkey % 4 = 1 THEN 0.7 END::DOUBLE AS confidence,
    CASE WHEN p_partkey % 50 = 0 THEN 'anchored' WHEN starts_with(name, 'KEY_Brand_11') THEN 'skipped' WHEN p_partkey % 4 = 3 THEN 'static' WHEN p_partkey % 4 = 0 AND p_partkey % 3 > 0 THEN 'migrated' WHEN p_partkey % 4 = 1 THEN 'unchanged' ELSE 'unresolved' END AS status FROM e""")
def routed_resolve(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    value = F.when(k % 4 == 0, F.concat(F.lit("Root_"), k, F.lit(".f_"), size)).when(k % 4 == 1, F.concat(F.lit("iVar"), size)).when(k % 4 == 2, F.concat(F.lit("f_"), size)).otherwise(size.cast("string"))
    e = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("KEY_"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_"), k).alias("name"), value.alias("value"))
    told = lambda df, v, c: df.select("name", v.alias("new_value"), F.lit(c).alias("confidence"))
    resolvers = {"global": told(e.where(k % 3 > 0), F.concat("value", F.lit(".f_1")), 0.9), "local": told(e, F.col("value"), 0.7)}
    return routing.routed(e.select("name", "value"), told(e.where(k % 50 == 0), F.lit("told"), 1.0), ["KEY_Brand_11"], paths.shapes("Root"), resolvers)


@query("candidate_files", """WITH m AS (SELECT doc_id AS name, lang AS kind, source AS file FROM documents WHERE doc_id % 5 = 0), f AS (SELECT DISTINCT source AS file FROM documents WHERE doc_id % 7 = 1), p(kind, file) AS (VALUES ('en', 'src1'), ('en', 'src2'), ('de', 'src3'), ('fr', 'none'))
  SELECT name, file, min(source_rank)::INT AS source_rank FROM (SELECT name, p.file, 0 AS source_rank FROM m JOIN p USING (kind) UNION ALL SELECT name, file, 1 FROM m) WHERE file IN (FROM f) GROUP BY ALL""")
def candidate_files(spark, sf):
    d = table(spark, sf, "documents")
    p = spark.createDataFrame([("en", "src1"), ("en", "src2"), ("de", "src3"), ("fr", "none")], "kind string, file string")
    matches = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("name"), F.col("lang").alias("kind"), F.col("source").alias("file"))
    return candidates.candidate_files(matches, d.where("doc_id % 7 = 1").select(F.col("source").alias("file")), p)


@query("semantic_path_join", r"""WITH s AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS file, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS own, list_transform(own, lambda x: regexp_replace(x, '[0-9]+', '#', 'g')) AS path FROM pages), n AS (SELECT file, path, min(page_id) AS new_value, count(DISTINCT page_id)::BIGINT AS n FROM s WHERE page_id % 2 = 1 AND len(path) > 0 GROUP BY ALL)
  SELECT s.page_id AS name, n.new_value, n.n FROM s JOIN n ON n.file = s.file AND n.path = s.path WHERE s.page_id % 2 = 0""")
def semantic_path_join(spark, sf):
    s = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("file"), F.transform(text.segments("url"), lambda x: F.regexp_replace(x, "[0-9]+", "#")).alias("path"))
    old, new = s.where("page_id % 2 = 0").withColumnRenamed("page_id", "name"), s.where("page_id % 2 = 1").withColumnRenamed("page_id", "value")
    return candidates.by_path(old, new)


@query("context_candidates", """WITH e AS (SELECT c_custkey AS k, c_nationkey::VARCHAR AS file, c_custkey % 9 = 0 AS deep FROM customer WHERE c_custkey % 3 > 0)
  SELECT 'KEY_' || k AS name, 'Root_' || (k + 5) || CASE WHEN deep THEN '.f_2' ELSE '.f_1' END AS value, 0.99::DOUBLE AS confidence, k::BIGINT AS line_no FROM e""")
def context_candidates(spark, sf):
    c = table(spark, sf, "customer")
    k, deep = F.col("c_custkey"), F.col("c_custkey") % 9 == 0
    own = F.concat(F.lit("set "), "c_name", F.lit(" to VALUE"))

    def side(df, shift):
        value = F.concat(F.lit("Root_"), k + shift, F.when(deep, ".f_2").otherwise(".f_1"))
        near, wide = F.concat(F.lit("before\n"), own, F.lit("\nafter")), F.concat(F.lit("far\nbefore\n"), own, F.lit("\nafter\nfar"))
        return df.select(F.col("c_nationkey").cast("string").alias("file"), F.lit("global").alias("kind"), value.alias("value"), own.alias("line"), near.alias("near"), wide.alias("wide"), F.lit(False).alias("assigns"), F.lit(False).alias("returns"), F.lit(False).alias("bare"), k.cast("long").alias("line_no"), "c_name")

    old = side(c.where("c_custkey % 3 > 0"), 0)
    old = old.select(F.concat(F.lit("KEY_"), F.col("line_no")).alias("name"), *(x for x in old.columns if x not in ("line_no", "c_name")), F.array("c_name").alias("anchors"))
    new = side(c, 5)
    new = new.select(*(x for x in new.columns if x != "c_name"), F.array("c_name", F.lit("far")).alias("tokens"))
    root = lambda v: F.regexp_extract(F.col(v), r"_([0-9]+)", 1).cast("long")
    return candidates.by_context(old, new, lambda v: F.regexp_replace(v, "[0-9]+", "N"), root("a_value") - root("b_value"), [(10, 0.18), (100, 0.16)])


@query("candidate_order", """WITH c AS (SELECT l_orderkey % 200 AS name, l_suppkey AS value, CASE l_linenumber % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'shape' ELSE 'other' END AS reason, l_linenumber % 2 AS source_rank, l_discount AS confidence, abs(l_suppkey - l_partkey) AS d, l_orderkey, l_linenumber, l_partkey FROM lineitem)
  SELECT name, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE reason WHEN 'path' THEN 1 WHEN 'shape' THEN 2 ELSE 3 END, source_rank, confidence DESC, d, value, l_orderkey, l_linenumber, l_partkey)::INT AS rank FROM c)""")
def candidate_order(spark, sf):
    li = table(spark, sf, "lineitem")
    reason = F.when(F.col("l_linenumber") % 3 == 0, "path").when(F.col("l_linenumber") % 3 == 1, "shape").otherwise("other")
    c = li.select((F.col("l_orderkey") % 200).alias("name"), F.col("l_suppkey").alias("value"), reason.alias("reason"), (F.col("l_linenumber") % 2).alias("source_rank"), F.col("l_discount").alias("confidence"), F.abs(F.col("l_suppkey") - F.col("l_partkey")).alias("d"), "l_orderkey", "l_linenumber", "l_partkey")
    return candidates.ranked(c, "name", ["path", "shape"], F.col("d"), ["l_orderkey", "l_linenumber", "l_partkey"]).select("name", "l_orderkey", "l_linenumber", "rank")


@query("multiset_sum", f"SELECT event_type, sum(n)::BIGINT AS n FROM (SELECT event_type, count(*) AS n FROM {OLD} GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM {NEW} GROUP BY 1) GROUP BY event_type")
def multiset_sum(spark, sf):
    side = lambda s: metrics.status_counts(events(spark, sf, s), "event_type")
    return side("old").unionByName(side("new")).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("union_max", f"SELECT user_id, max(n)::BIGINT AS n FROM (SELECT user_id, count(*) AS n FROM {OLD} GROUP BY 1 UNION ALL SELECT user_id, count(*) FROM {NEW} GROUP BY 1) GROUP BY user_id")
def union_max(spark, sf):
    side = lambda s: metrics.status_counts(events(spark, sf, s), "user_id")
    return side("old").unionByName(side("new")).groupBy("user_id").agg(F.max("n").alias("n"))


@query("ordered_source_union", "SELECT src_ord, row_ord, length(text)::BIGINT AS n FROM (SELECT 1 AS src_ord, doc_id AS row_ord, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark UNION ALL SELECT 3, conv_id * 100 + turn, text FROM conversations)")
def ordered_source_union(spark, sf):
    part = lambda i, t, k: table(spark, sf, t).select(F.lit(i).alias("src_ord"), k.alias("row_ord"), F.length("text").cast("long").alias("n"))
    return part(1, "documents", F.col("doc_id")).unionByName(part(2, "benchmark", F.col("item_id"))).unionByName(part(3, "conversations", F.col("conv_id") * 100 + F.col("turn")))


@query("preferred_source_join", """WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), p(lang, source, ord) AS (VALUES ('en', 'src9', 1), ('en', 'src7', 0), ('de', 'src4', 0))
  SELECT lang, source, n::BIGINT AS n, row_number() OVER (PARTITION BY lang ORDER BY ord NULLS LAST, n DESC, source)::INT AS rank FROM s LEFT JOIN p USING (lang, source) QUALIFY rank <= 3""")
def preferred_source_join(spark, sf):
    s = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    p = spark.createDataFrame([("en", "src9", 1), ("en", "src7", 0), ("de", "src4", 0)], "lang string, source string, ord int")
    return evidence.preferred(s, "lang", "source", "n", p, 3)


@query("fingerprint_tiers", f"""WITH o AS (SELECT user_id, string_agg(event_type, ',' ORDER BY m) AS p FROM (SELECT user_id, event_type, min(event_id) AS m FROM {OLD} GROUP BY ALL) GROUP BY 1), n AS (SELECT user_id, string_agg(event_type, ',' ORDER BY m) AS p FROM (SELECT user_id, event_type, min(event_id) AS m FROM {NEW} GROUP BY ALL) GROUP BY 1),
  a AS (SELECT p, min(user_id) AS old_id FROM o GROUP BY 1 HAVING count(*) = 1), b AS (SELECT p, min(user_id) AS new_id FROM n GROUP BY 1 HAVING count(*) = 1) SELECT p, old_id, new_id FROM a JOIN b USING (p)""")
def fingerprint_tiers(spark, sf):
    def side(s, name):
        e = events(spark, sf, s).groupBy("user_id", "event_type").agg(F.min("event_id").alias("m"))
        seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "event_type"))), lambda x: x["event_type"]), ",")
        return e.groupBy("user_id").agg(seq.alias("p")).withColumnRenamed("user_id", name)

    return keyed.unique_both_ways(side("old", "old_id"), side("new", "new_id"), ["p"])


#: Every entry's old value, and per resolver the value it tells.
CASCADE = f"""WITH e AS (SELECT user_id, event_type, user_id::VARCHAR || ':' || event_type AS name, arg_min(round(value)::BIGINT, event_id) AS value FROM {OLD} GROUP BY ALL),
  u AS (SELECT user_id, event_type, min(round(value)::BIGINT) AS v FROM {NEW} GROUP BY ALL HAVING count(DISTINCT round(value)::BIGINT) = 1),
  f AS (SELECT event_type, user_id, arg_min(round(value)::BIGINT, event_id) AS v FROM {NEW} GROUP BY ALL),
  m AS (SELECT event_type, v FROM (SELECT event_type, round(value)::BIGINT AS v, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, round(value)::BIGINT) AS r FROM {NEW} GROUP BY event_type, round(value)::BIGINT) WHERE r = 1),
  c AS (SELECT e.name, e.value, e.event_type, CASE WHEN u.v IS NOT NULL AND abs(u.v - e.value) <= 200 THEN 'unique' WHEN f.v IS NOT NULL AND abs(f.v - e.value) <= 200 THEN 'first' WHEN m.v IS NOT NULL AND abs(m.v - e.value) <= 200 THEN 'consensus' END AS method, u.v AS uv, f.v AS fv, m.v AS mv
    FROM e LEFT JOIN u ON u.user_id = e.user_id AND u.event_type = e.event_type LEFT JOIN f ON f.user_id = e.user_id AND f.event_type = e.event_type LEFT JOIN m ON m.event_type = e.event_type),
  d AS (SELECT *, CASE method WHEN 'unique' THEN uv WHEN 'first' THEN fv WHEN 'consensus' THEN mv END AS new_value, CASE method WHEN 'unique' THEN 1.0 WHEN 'first' THEN 0.9 WHEN 'consensus' THEN 0.5 END::DOUBLE AS confidence FROM c),
  s AS (SELECT *, CASE WHEN new_value IS NULL THEN 'unresolved' WHEN new_value = value THEN 'unchanged' ELSE 'migrated_' || method END AS status FROM d)"""


def cascaded(spark, sf):
    new = events(spark, sf, "new").withColumns({"name": F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")), "v": F.round("value").cast("long")})
    old = events(spark, sf, "old").withColumns({"name": F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")), "v": F.round("value").cast("long")})
    entries = old.groupBy("name", "event_type").agg(F.min_by("v", "event_id").alias("value"))
    told = lambda df, c: df.select("name", F.col("v").alias("new_value"), F.lit(c).alias("confidence"))
    consensus = keyed.votes(new, ["event_type"], "v").select("event_type", "v")
    return resolve.cascade(
        entries,
        [
            ("unique", lambda left: told(keyed.unique_map(new, ["name"], "v"), 1.0)),
            ("first", lambda left: told(keyed.first_wins(new.select("name", "v", "event_id"), ["name"], [F.col("event_id")]), 0.9)),
            ("consensus", lambda left: told(left.join(consensus, "event_type").select("name", "v"), 0.5)),
        ],
        guard=F.abs(F.col("new_value") - F.col("value")) <= 200,
    )


@query("cascade_resolve", CASCADE + " SELECT name, event_type, value, new_value, confidence, method, status FROM s")
def cascade_resolve(spark, sf):
    return cascaded(spark, sf).select("name", "event_type", "value", "new_value", "confidence", "method", "status")


@query("pending_by_family", CASCADE + " SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (status = 'unresolved')::BIGINT AS pending, count(*) FILTER (starts_with(status, 'migrated'))::BIGINT AS migrated FROM s GROUP BY event_type")
def pending_by_family(spark, sf):
    return cascaded(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "unresolved").alias("pending"), F.count_if(F.startswith("status", F.lit("migrated"))).alias("migrated"))


@query("validation_report", CASCADE + " SELECT event_type, count(*)::BIGINT AS eligible, count(*) FILTER (new_value IS NOT NULL)::BIGINT AS resolved, round(count(*) FILTER (new_value IS NOT NULL) / greatest(count(*), 1), 6) AS coverage FROM s GROUP BY event_type")
def validation_report(spark, sf):
    return metrics.coverage(cascaded(spark, sf), F.col("new_value").isNotNull(), F.lit(True), ["event_type"])


@query("apply_policy", CASCADE + " SELECT name, CASE WHEN new_value IS NULL THEN 'unresolved' WHEN new_value = value THEN 'unchanged' WHEN method = 'unique' AND confidence >= 0.95 THEN 'safe_update' ELSE 'review_needed' END AS action, CASE WHEN new_value <> value AND method = 'unique' AND confidence >= 0.95 THEN new_value ELSE value END AS applied FROM s")
def apply_policy(spark, sf):
    return resolve.apply_policy(cascaded(spark, sf), 0.95, F.col("method") == "unique").select("name", "action", "applied")


@query("consensus_outliers", f"""WITH r AS (SELECT user_id, event_type, arg_min(user_id % 3, event_id) AS o FROM {OLD} GROUP BY ALL), n AS (SELECT user_id, event_type, arg_min(round(value)::BIGINT % 4, event_id) AS w FROM {NEW} GROUP BY ALL), j AS (SELECT r.user_id, r.event_type, o, w FROM r LEFT JOIN n USING (user_id, event_type)),
  vo AS (SELECT event_type, o AS mo FROM (SELECT event_type, o, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, o) AS k FROM j WHERE w IS NOT NULL GROUP BY event_type, o) WHERE k = 1), vn AS (SELECT event_type, w AS mw FROM (SELECT event_type, w, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, w) AS k FROM j WHERE w IS NOT NULL GROUP BY event_type, w) WHERE k = 1)
  SELECT user_id, event_type, coalesce(o = mo AND w <> mw, false) AS repaired, CASE WHEN o = mo AND w <> mw THEN mw ELSE w END AS fixed_root FROM j LEFT JOIN vo USING (event_type) LEFT JOIN vn USING (event_type)""")
def consensus_outliers(spark, sf):
    o = events(spark, sf, "old").groupBy("user_id", "event_type").agg(F.min_by(F.col("user_id") % 3, "event_id").alias("o"))
    w = events(spark, sf, "new").groupBy("user_id", "event_type").agg(F.min_by(F.round("value").cast("long") % 4, "event_id").alias("w"))
    return resolve.family_repair(o.join(w, ["user_id", "event_type"], "left"), "event_type", "o", "w").select("user_id", "event_type", "repaired", "fixed_root")


#: A small instruction set for programs made from the tables.
TABLE = {0x01: ("PUSH_U8", "u8"), 0x02: ("PUSH_U32", "u32"), 0x03: ("NATIVE", "native"), 0x04: ("CALL", "u24"), 0x05: ("JUMP", "rel16"), 0x06: ("ENTER", "enter"), 0x07: ("LEAVE", "leave"), 0x08: ("FIELD", "s16"), 0x09: ("NOP", ""), 0x0A: ("ROOT", "u24"), 0x0B: ("ARRAY", "u16"), 0x0C: ("SWITCH", "switch")}


def programs(spark, sf, version):
    """A program per nation's suppliers: a function for each, its natives shifted in the new version."""
    shift = 0 if version == "old" else 5
    k = F.col("s_suppkey")
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    body = F.concat(F.lit("06"), two(k % 3), F.lit("020000"), F.lit("01"), two(k % 200), F.lit("0308"), F.lpad(F.hex(k % 50 + shift), 4, "0"), F.lit("02"), two(k % 256), F.lit("000000"), F.lit("04"), two(k % 250), F.lit("0000"), F.lit("09"), F.lit("07"), two(k % 3), F.lit("01"))
    code = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", body.alias("b")))), lambda x: x["b"]), ""))
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("script")).agg(code.alias("code")).withColumn("version", F.lit(version))


def natives(spark, sf, version):
    shift = 0 if version == "old" else 5
    return table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("script"), F.lit(version).alias("version"), (F.col("s_suppkey") % 50 + shift).alias("index"), (F.col("s_suppkey") % 50 * 1000 + 7).alias("hash")).distinct()


@query("decode_roundtrip", "SELECT s_nationkey::VARCHAR AS script, (7 * count(*))::BIGINT AS n, true AS same FROM supplier GROUP BY 1")
def decode_roundtrip(spark, sf):
    p = programs(spark, sf, "old")
    rows = bytecode.instructions(p, TABLE)
    back = bytecode.assemble(rows).select("script", F.col("code").alias("again"))
    return p.join(back, "script").join(rows.groupBy("script").agg(F.count("*").alias("n")), "script").select("script", "n", (F.col("code") == F.col("again")).alias("same"))


@query("function_table", "SELECT s_nationkey::VARCHAR AS script, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS idx, (s_suppkey % 3)::INT AS params FROM supplier")
def function_table(spark, sf):
    return bytecode.functions(bytecode.instructions(programs(spark, sf, "old"), TABLE)).select("script", "idx", "params")


def versioned(spark, sf, version):
    """A program per nation's customers, by what becomes of each in the new version: number % 12 is 0: other constant; 1: other native and constant; 2: gone; 3: the same body as all of that kind; 5: longer, and other native and constant; others stay."""
    k, new = F.col("c_custkey"), version == "new"
    kind = k % 12
    wide = lambda c, n: F.lpad(F.hex(c), n, "0")
    # a number of its own for each customer, in two natives as one holds two bytes; and constants of 31 bits, so that no size of the table makes two bodies alike
    native = F.when(kind == 3, 1).when(kind.isin(1, 5) & F.lit(new), k * 2 + 2).otherwise(k * 2 + 3)
    called = F.concat(*(F.concat(F.lit("0308"), wide(x, 4)) for x in (native % 32768, F.shiftright(native, 15) % 65536)))
    constant = F.when(kind == 3, 9).otherwise(k % 2**31 + F.when(kind.isin(0, 1, 5) & F.lit(new), 2**31).otherwise(0))
    # a u32 is written lowest byte first
    low_first = F.concat(*(wide(F.shiftright(constant, 8 * i) % 256, 2) for i in range(4)))
    filler = F.when((kind == 5) & F.lit(new), F.repeat(F.lit("09"), 40)).otherwise("")
    body = F.concat(F.lit("06"), wide(kind % 3, 2), F.lit("020000"), called, F.lit("02"), low_first, filler, F.lit("07"), wide(kind % 3, 2), F.lit("01"))
    rows = table(spark, sf, "customer").where((kind != 2) | F.lit(not new))
    code = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", body.alias("b")))), lambda x: x["b"]), ""))
    return rows.groupBy(F.col("c_nationkey").cast("string").alias("script")).agg(code.alias("code")).withColumn("version", F.lit(version))


@query("address_map", """WITH o AS (SELECT c_nationkey::VARCHAR AS script, c_custkey AS k, c_custkey % 12 AS kind, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS old_idx FROM customer),
  n AS (SELECT script, k, (row_number() OVER (PARTITION BY script ORDER BY k) - 1)::INT AS new_idx FROM o WHERE kind <> 2), alone AS (SELECT script FROM o WHERE kind = 3 GROUP BY script HAVING count(*) = 1),
  m AS (SELECT o.script, old_idx, new_idx, CASE WHEN kind = 0 THEN 'loose' ELSE 'strict' END AS tier FROM o JOIN n ON n.script = o.script AND n.k = o.k WHERE kind NOT IN (1, 3, 5) OR (kind = 3 AND o.script IN (FROM alone))),
  g AS (SELECT *, lead(old_idx) OVER (PARTITION BY script ORDER BY old_idx) - old_idx AS a, lead(new_idx) OVER (PARTITION BY script ORDER BY old_idx) - new_idx AS b FROM m),
  p AS (SELECT script, (old_idx + i)::INT AS old_idx, (new_idx + i)::INT AS new_idx FROM (SELECT *, unnest(range(1, a)) AS i FROM g WHERE a = b AND a > 1))
  SELECT * FROM m UNION ALL SELECT p.script, p.old_idx, p.new_idx, 'positional' FROM p JOIN o USING (script, old_idx) JOIN n ON n.script = p.script AND n.new_idx = p.new_idx JOIN o q ON q.script = n.script AND q.k = n.k WHERE o.kind % 3 = q.kind % 3 AND q.kind <> 5""")
def address_map(spark, sf):
    none = spark.createDataFrame([], "script string, version string, index int, hash bigint")
    side = lambda v: bytecode.fingerprints(bytecode.instructions(versioned(spark, sf, v), TABLE), none).drop("version")
    return bytecode.address_map(side("old"), side("new"))


def payloads(spark, sf, version):
    """A program per nation's suppliers with natives, calls and strides; in the new version natives are 5 further, calls 1000, and the strides of even roots one more."""
    new = version == "new"
    k = F.col("s_suppkey")
    hex2 = lambda c: F.lpad(F.hex(c), 2, "0")
    low = lambda c, n: F.concat(*(hex2(F.shiftright(c, 8 * i) % 256) for i in range(n)))
    stride = k % 5 * 7 + k % 3 + 300 + F.when((k % 2 == 0) & F.lit(new), 1).otherwise(0)
    # calls whose number is divisible by 9 keep their address, natives 7 of 50 their index: nothing tells where these go
    call = k % 250 + F.when((k % 250 % 9 != 0) & F.lit(new), 1000).otherwise(0)
    native = k % 50 + F.when((k % 50 != 7) & F.lit(new), 5).otherwise(0)
    body = F.concat(F.lit("06"), hex2(k % 3), F.lit("020000"), F.lit("0A"), low(k % 10, 3), F.lit("08"), low(k % 15, 2), F.lit("0B"), low(stride, 2), F.lit("0308"), F.lpad(F.hex(native), 4, "0"), F.lit("04"), low(call, 3), F.lit("07"), hex2(k % 3), F.lit("01"))
    code = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", body.alias("b")))), lambda x: x["b"]), ""))
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("script")).agg(code.alias("code")).withColumn("version", F.lit(version))


def audited(spark, sf):
    rows = {v: bytecode.instructions(payloads(spark, sf, v), TABLE) for v in ("old", "new")}
    calls = rows["old"].where("mnemonic = 'CALL' AND value % 9 <> 0").select("script", F.col("value").alias("old_address"), (F.col("value") + 1000).alias("new_address"), F.lit("strict").alias("tier")).distinct()
    names = (["ROOT"], "FIELD", "ARRAY")
    strides = tuple(bytecode.mined_strides(rows[v], *names) for v in ("old", "new"))
    new_natives = natives(spark, sf, "new").where("hash <> 7 * 1000 + 7")
    return rows["old"], bytecode.remap_audit(rows["old"], natives(spark, sf, "old"), new_natives, calls, None, strides, names)


@query("remap_audit", """SELECT s_nationkey::VARCHAR AS script, 'native' AS kind, s_suppkey % 50 AS old, CASE WHEN s_suppkey % 50 <> 7 THEN s_suppkey % 50 + 5 END AS new, CASE WHEN s_suppkey % 50 <> 7 THEN 'exact' ELSE 'review' END AS confidence, count(*)::BIGINT AS n FROM supplier GROUP BY ALL
  UNION ALL SELECT s_nationkey::VARCHAR, 'call', s_suppkey % 250, CASE WHEN s_suppkey % 250 % 9 <> 0 THEN s_suppkey % 250 + 1000 END, CASE WHEN s_suppkey % 250 % 9 <> 0 THEN 'strict' ELSE 'review' END, count(*) FROM supplier GROUP BY ALL
  UNION ALL SELECT s_nationkey::VARCHAR, 'stride', s_suppkey % 5 * 7 + s_suppkey % 3 + 300, s_suppkey % 5 * 7 + s_suppkey % 3 + 301 - s_suppkey % 2, 'exact', count(*) FROM supplier GROUP BY ALL""")
def remap_audit(spark, sf):
    _, audit = audited(spark, sf)
    return audit.groupBy("script", "kind", "old", "new", "confidence").agg(F.count("*").alias("n"))


@query("remap_bytes", "SELECT s_nationkey::VARCHAR AS script, true AS same FROM supplier GROUP BY 1")
def remap_bytes(spark, sf):
    rows, audit = audited(spark, sf)
    back = bytecode.assemble(bytecode.remapped(rows, audit)).select("script", F.col("code").alias("again"))
    return payloads(spark, sf, "new").join(back, "script").select("script", (F.col("code") == F.col("again")).alias("same"))


@query("audit_report", """SELECT s_nationkey::VARCHAR AS script, s_nationkey::VARCHAR || ': ' || 3 * count(*) || ' operands, ' || count(*) FILTER (s_suppkey % 50 = 7) + count(*) FILTER (s_suppkey % 250 % 9 = 0) || ' need review' AS line FROM supplier GROUP BY s_nationkey""")
def audit_report(spark, sf):
    from ..sources.patches import audit_report as report

    return report(audited(spark, sf)[1]).where("place = 1").select("script", "line")


@query("patch_health", """WITH s AS (SELECT s_suppkey AS k, s_nationkey::VARCHAR AS script, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier), t AS (SELECT * FROM s WHERE i = 1),
  h AS (SELECT t.k AS patch, t.script, count(*) FILTER (s.k % 50 = t.k % 50) AS o, count(*) FILTER (s.k % 50 + CASE WHEN s.k % 50 <> 7 THEN 5 ELSE 0 END = t.k % 50) AS n, count(*) FILTER (s.k % 250 = t.k % 250) AS vo, count(*) FILTER (s.k % 250 + CASE WHEN s.k % 250 % 9 <> 0 THEN 1000 ELSE 0 END = t.k % 250) AS vn FROM t JOIN s USING (script) GROUP BY ALL),
  c AS (SELECT *, CASE WHEN o > 1 THEN 'AMBIG_OLD' WHEN n = 1 THEN 'OK' WHEN n = 0 THEN 'BROKEN' ELSE 'AMBIG_NEW' END AS a, CASE WHEN vo > 1 THEN 'AMBIG_OLD' WHEN vn = 1 THEN 'OK' WHEN vn = 0 THEN 'BROKEN' ELSE 'AMBIG_NEW' END AS b FROM h)
  SELECT patch::INT AS patch, script, o::BIGINT AS n_old, n::BIGINT AS n_new, CASE WHEN a = 'OK' AND b <> 'OK' THEN 'BROKEN' ELSE a END AS status, b AS value_status FROM c""")
def patch_health(spark, sf):
    from ..sources.patches import patch_health as health

    first = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k"))
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    native = F.concat(F.lit("03 ? 00 "), two(F.col("k") % 50), F.lit(" 04"))
    call = F.concat(F.lit("04 "), two(F.col("k") % 250), F.lit(" 00 00 07"))
    rows = first.select(F.col("k").cast("int").alias("patch"), F.lit("p").alias("patch_name"), F.col("s_nationkey").cast("string").alias("script_name"), native.alias("pattern"), F.array(F.struct(F.lit(1).alias("id"), call.alias("pattern"))).alias("values"))
    both = payloads(spark, sf, "old").unionByName(payloads(spark, sf, "new"))
    return health(rows, both).select("patch", "script", "n_old", "n_new", "status", F.get("values", F.lit(0))["status"].alias("value_status"))


def switching(spark, sf):
    """A program per nation's suppliers with named functions, jumps, switches, floats and natives."""
    k = F.col("s_suppkey")
    hex2 = lambda c: F.lpad(F.hex(c), 2, "0")
    name = F.concat(F.lit("fn"), k.cast("string"))
    # enter 5+n bytes, u8 2, switch 14, jump 3, nop 1, native 4, nop 1, leave 3: the jump and the cases go to places behind
    body = F.concat(
        F.lit("06"), hex2(k % 3), F.lit("0200"), hex2(F.length(name)), F.hex(name), F.lit("01"), hex2(k % 200),
        F.lit("0C02"), F.lit("05000000"), F.lit("0900"), F.lit("FFFFFFFF"), F.lit("0400"), F.lit("050100"), F.lit("09"), F.lit("0308"), F.lpad(F.hex(k % 50), 4, "0"), F.lit("09"), F.lit("07"), hex2(k % 3), F.lit("01"),
    )
    code = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", body.alias("b")))), lambda x: x["b"]), ""))
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("script")).agg(code.alias("code")).withColumn("version", F.lit("old"))


@query("listing_roundtrip", "SELECT s_nationkey::VARCHAR AS script, true AS same, (2 * count(*))::BIGINT AS labels FROM supplier GROUP BY 1")
def listing_roundtrip(spark, sf):
    from ..operators import assembly

    p = switching(spark, sf)
    texts = assembly.listing(bytecode.instructions(p, TABLE)).groupBy("script", "version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    labels = texts.select("script", F.regexp_count("text", F.lit(r"(?m)^L[0-9]+: ")).cast("long").alias("labels"))
    back = assembly.assembled(texts, TABLE).select("script", F.col("code").alias("again"))
    return p.join(back, "script").join(labels, "script").select("script", (F.col("code") == F.col("again")).alias("same"), "labels")


@query("delta_overlap_match", """WITH o AS (SELECT DISTINCT l_suppkey % 20 AS g, l_suppkey AS k, l_partkey AS c FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT g, k + 1000 AS k, c + 4 AS c FROM o WHERE c % 27 <> 0),
  oz AS (SELECT g, k, count(*) AS z FROM o GROUP BY ALL HAVING count(*) >= 4), nz AS (SELECT g, k, count(*) AS z FROM n GROUP BY ALL HAVING count(*) >= 4),
  h AS (SELECT o.g, o.k, oz.z, n.k AS nk, n.c - o.c AS delta, count(*) AS hits FROM o JOIN oz USING (g, k) JOIN n ON n.g = o.g AND abs(n.c - o.c) <= 12 JOIN nz ON nz.g = n.g AND nz.k = n.k GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY hits DESC, abs(delta), delta, nk) AS r FROM h)
  SELECT g, k, nk AS new_key, delta, hits::BIGINT AS hits, round(hits / z, 6) AS share FROM b WHERE r = 1 AND round(hits / z, 6) >= 0.6""")
def delta_overlap_match(spark, sf):
    from ..operators import structure

    o = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select((F.col("l_suppkey") % 20).alias("g"), F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("c")).distinct()
    n = o.where("c % 27 <> 0").select("g", (F.col("k") + 1000).alias("k"), (F.col("c") + 4).alias("c"))
    sets = lambda df: df.groupBy("g", "k").agg(F.array_sort(F.collect_set("c")).alias("children"))
    return structure.by_delta(sets(o), sets(n), ["g"], "k", "children")


@query("stride_propagation", """WITH p AS (SELECT l_suppkey % 50 AS a, CASE WHEN l_linenumber <= 5 THEN l_suppkey % 50 + 3 ELSE l_linenumber::BIGINT END AS b FROM lineitem), v AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), w AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS t, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM v),
  e AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'X_NEXT_' ELSE 'X_' END || p_partkey::VARCHAR AS name, p_size::BIGINT AS value FROM part)
  SELECT name, value, CASE WHEN contains(name, 'NEXT') AND w.b IS NOT NULL AND w.b <> value THEN w.b ELSE value END AS new_value FROM e LEFT JOIN w ON w.a = e.value AND r = 1 AND n * 100 >= t * 60""")
def stride_propagation(spark, sf):
    from ..operators import structure

    a = F.col("l_suppkey") % 50
    pairs = table(spark, sf, "lineitem").select(F.array(a).alias("old"), F.array(F.when(F.col("l_linenumber") <= 5, a + 3).otherwise(F.col("l_linenumber").cast("long"))).alias("new"))
    entries = table(spark, sf, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "X_NEXT_").otherwise("X_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("long").alias("value"))
    return structure.propagate_strides(pairs, entries).select("name", "value", "new_value")


#: By a part's number: 0 an array with children of its own, 1 one whose children move by 3, 2 a scalar that moves, 3 a scalar that isn't seen in the new version. Roots move by 7, strides by 1.
_PARTS = "(SELECT p_partkey AS k, p_partkey % 4 AS kind, 'Root_' || p_partkey % 5 AS base, p_partkey * 10 AS root, 10 + p_partkey % 9 AS stride FROM part)"


def structured(spark, sf, version):
    new = version == "new"
    k = F.col("p_partkey")
    base, root = F.concat(F.lit("Root_"), k % 5), k * 10 + (7 if new else 0)
    p = table(spark, sf, "part").select(k.alias("k"), (k % 4).alias("kind"), base.alias("base"), root.alias("root"), (10 + k % 9 + (1 if new else 0)).alias("stride"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: 100_000 + F.col("k") * 40 + i * i + (3 if new else 0))
    children = F.when(F.col("kind") == 0, F.array(F.lit(1).cast("long"), F.col("k") + 2)).otherwise(spread)
    arrays = p.where("kind < 2").select("base", "root", "stride", (F.col("stride") + 50).alias("stride2"), F.explode(children).alias("child"))
    subs = p.where("k % 8 = 0").select("base", "root", F.lit(21 if new else 20).cast("long").alias("sub"), F.lit(5 if new else 4).cast("long").alias("stride"), F.explode(F.array("k", F.col("k") + 1)).alias("leaf"))
    scalars = p.where("kind = 2" if new else "kind >= 2").select("base", F.col("root").alias("field"))
    return arrays, subs, scalars, p


@query("structural_resolve", f"""WITH p AS {_PARTS}, e AS (SELECT base, min(root) AS lo, max(root) AS hi FROM p WHERE kind < 2 GROUP BY base),
  v AS (SELECT k, 'K_' || k AS name, CASE kind WHEN 0 THEN base || '.f_' || root || '[i /*' || stride || '*/]' || CASE WHEN k % 8 = 0 THEN '.f_20[j /*4*/].f_9' WHEN k % 3 = 0 THEN '[j /*9*/].f_1' ELSE '.f_1' END WHEN 1 THEN base || '.f_' || root || '[i /*' || stride || '*/].f_' || 100000 + k * 40 + 4 || '.f_2' ELSE base || '.f_' || root END AS value,
    CASE kind WHEN 0 THEN base || '.f_' || root + 7 || '[i /*' || stride + 1 || '*/]' || CASE WHEN k % 8 = 0 THEN '.f_21[j /*5*/].f_9' WHEN k % 3 = 0 THEN '[j /*' || stride + 51 || '*/].f_1' ELSE '.f_1' END WHEN 1 THEN base || '.f_' || root + 7 || '[i /*' || stride + 1 || '*/].f_' || 100000 + k * 40 + 7 || '.f_2'
      WHEN 2 THEN base || '.f_' || root + 7 ELSE CASE WHEN root > e.lo AND root < e.hi THEN base || '.f_' || root + 7 END END AS new_value,
    CASE kind WHEN 0 THEN 'signature' WHEN 1 THEN 'delta' WHEN 2 THEN 'aligned' ELSE CASE WHEN root > e.lo AND root < e.hi THEN 'bracketed' END END AS phase FROM p JOIN e USING (base)) SELECT name, value, new_value, phase FROM v""")
def structural_resolve(spark, sf):
    from ..operators import structure

    old, new = structured(spark, sf, "old"), structured(spark, sf, "new")
    k, root, kind = F.col("k"), F.col("root"), F.col("kind")
    head = F.concat("base", F.lit(".f_"), root)
    step = F.concat(F.lit("[i /*"), "stride", F.lit("*/]"))
    ends = F.when(k % 8 == 0, ".f_20[j /*4*/].f_9").when(k % 3 == 0, "[j /*9*/].f_1").otherwise(".f_1")
    value = F.when(kind == 0, F.concat(head, step, ends)).when(kind == 1, F.concat(head, step, F.lit(".f_"), 100_000 + k * 40 + 4, F.lit(".f_2"))).otherwise(head)
    values = old[3].select(F.concat(F.lit("K_"), k).alias("name"), value.alias("value"))
    return structure.resolve_paths(values, (old[0], new[0]), (old[1], new[1]), (old[2], new[2]), reach=64)


def code_lines(spark, sf):
    """A file per user and version: values of event types set directly, by a function that forwards them, loaded back, or under a built label."""
    made = []
    for v in ("old", "new"):
        e = events(spark, sf, v).select("user_id", "event_id", "event_type", F.concat(F.lit("Root_"), "user_id", F.lit(".f_"), F.length("event_type"), F.get_json_object("props", "$.k").cast("long") % 3, F.lit("[x /*4*/]")).alias("value"))
        k, name, value = F.col("event_id") % 4, F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("value")
        one = F.when(k == 0, F.array(F.concat(F.lit("put_int(d, "), name, F.lit(", "), value, F.lit(");"))))
        one = one.when(k == 1, F.array(F.concat(F.lit("save("), name, F.lit(", 5, "), value, F.lit(", d);"))))
        one = one.when(k == 2, F.array(F.concat(F.lit("copy(&("), value, F.lit("), get_int(d, "), name, F.lit("));"))))
        one = one.otherwise(F.array(F.concat(F.lit("named(&lbl, "), name, F.lit(");")), F.concat(F.lit("put_int(d, &lbl, "), value, F.lit(");"))))
        body = e.select("user_id", (F.col("event_id") * 2 + 10).alias("line_no"), F.posexplode(one).alias("i", "line")).select("user_id", (F.col("line_no") + F.col("i")).alias("line_no"), "line")
        head = F.array(*map(F.lit, ("void save(char* k, int n, int v, int d)", "    put_int(d, k, v);", "void named(int b, char* k)", "    set_label(&b, k);", "void main()")), F.concat(F.lit('d = make_dict(0, "u'), "user_id", F.lit('");')))
        start = e.select("user_id").distinct().select("user_id", F.posexplode(head).alias("line_no", "line"))
        made.append(body.unionByName(start.select("user_id", F.col("line_no").cast("long"), "line")).select(F.lit(v).alias("version"), F.concat(F.lit("f"), "user_id").alias("file"), "line_no", "line"))
    return made[0].unionByName(made[1])


_VALUE = "'Root_' || user_id || '.f_' || length(event_type) || (props->>'k')::BIGINT % 3 || '[i /*4*/]'"


@query("semantic_extract", f"SELECT 'f' || user_id AS file, 'u' || user_id || '.' || event_type AS path, arg_min({_VALUE}, event_id) AS value, count(*)::BIGINT AS n, bool_or(event_id % 4 = 3) AS dynamic FROM {OLD} GROUP BY user_id, event_type")
def semantic_extract(spark, sf):
    from ..operators import extract

    found = extract.mappings(code_lines(spark, sf).where("version = 'old'"))
    return found.groupBy("file", "path").agg(F.min_by(paths.canonical("value"), "line_no").alias("value"), F.count("*").alias("n"), F.bool_or("dynamic").alias("dynamic"))


@query("semantic_resolve", f"""WITH o AS (SELECT user_id, event_type, {_VALUE} AS value, event_id FROM {OLD}), n AS (SELECT user_id, event_type, arg_min({_VALUE}, event_id) AS value FROM {NEW} GROUP BY ALL),
  b AS (SELECT value, list(DISTINCT event_type ORDER BY event_type) AS types, any_value(user_id) AS user_id FROM o GROUP BY value), e AS (SELECT value, user_id, types[1] AS event_type FROM b WHERE len(types) = 1)
  SELECT replace(e.value, '[i /*4*/]', CASE WHEN user_id % 2 = 0 THEN '' ELSE '[i /*4*/]' END) AS name, CASE WHEN n.value IS NULL THEN 'path_removed_in_new' WHEN n.value = e.value THEN 'unchanged' ELSE 'migrated' END AS status, replace(n.value, '[i /*4*/]', CASE WHEN user_id % 2 = 0 THEN '' ELSE '[i /*4*/]' END) AS new_value FROM e LEFT JOIN n USING (user_id, event_type)
  UNION ALL SELECT 'Root_0.f_0', 'not_found_in_old', NULL""")
def semantic_resolve(spark, sf):
    """Entries are written with or without their index; values come back as each is written."""
    from ..operators import extract
    from ..operators.staged import staged

    found = staged(extract.mappings(code_lines(spark, sf)).withColumn("value", paths.canonical("value")))
    old, new = found.where("version = 'old'"), found.where("version = 'new'")
    _, backward = extract.forward_and_backward(old, ["line_no"])
    forward, _ = extract.forward_and_backward(new, ["line_no"])
    single = old.groupBy("value").agg(F.count_distinct("path").alias("n")).where("n = 1").select("value")
    even = F.regexp_extract("value", "_([0-9]+)", 1).cast("long") % 2 == 0
    entries = single.select(F.when(even, F.regexp_replace("value", r"\[.*$", "")).otherwise(F.col("value")).alias("value"))
    entries = entries.unionByName(spark.createDataFrame([("Root_0.f_0",)], "value string")).withColumn("name", F.col("value"))
    done = keyed.two_hop(entries, extract.with_variants(backward), forward)
    shown = paths.in_notation_of(paths.offset_notation("new_value"), "name")
    # a value that stays is told by its whole form on both sides
    same = F.col("new_value").eqNullSafe(F.col("value")) | (paths.in_notation_of("new_value", "name") == F.col("name"))
    return done.select("name", F.when((F.col("status") == "migrated") & same, "unchanged").otherwise(F.col("status")).alias("status"), shown.alias("new_value"))


@query("loose_resolve", """WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 5 AS kind FROM part)
  SELECT 'K_' || k AS name, 'Root_' || k || '.f_' || n + 9 || CASE WHEN kind = 1 THEN '[i /*4*/]' ELSE '' END || '.f_1' AS new_value FROM p WHERE kind IN (0, 1, 2)""")
def loose_resolve(spark, sf):
    """Old values are told as a number times a stride; entries as the sum, with or without the index; kind 3 has two paths, kind 4 none in new."""
    from ..operators import extract

    k, n, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 5
    text_of = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    p = table(spark, sf, "part")
    old = text_of("Root_", k, "[", n, " /*2*/]", F.when(kind == 1, "[x /*4*/]").otherwise(""), ".f_1")
    backward = p.select(old.alias("value"), text_of("a.", k).alias("path")).unionByName(p.where(kind == 3).select(old.alias("value"), text_of("b.", k).alias("path")))
    new = text_of("Root_", k, ".f_", n + 9, F.when(kind == 1, "[y /*4*/]").otherwise(F.when(kind == 0, "[y]").otherwise("")), ".f_1")
    forward = p.where(kind < 4).select(text_of("a.", k).alias("path"), new.alias("new_value")).unionByName(p.where(kind == 3).select(text_of("b.", k).alias("path"), F.lit("Root_0.f_1").alias("new_value")))
    entries = p.select(text_of("K_", k).alias("name"), text_of("Root_", k, ".f_", n * 2, F.when(kind == 1, "[j /*4*/]").otherwise(""), ".f_1").alias("value"))
    return extract.loose_resolve(entries, backward, forward)


@query("local_field_resolve", """WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part),
  f AS (SELECT k, n, k % 10 <> 0 AS a, k % 4 > 0 AS c, k >= (SELECT min(k) FROM p WHERE k % 7 = 0) AND k <= (SELECT max(k) FROM p WHERE k % 7 = 0) AS s FROM p)
  SELECT 'K_' || k AS name, CASE WHEN a AND c THEN 'agreed' WHEN a THEN 'aligned' WHEN c THEN 'context' WHEN s THEN 'step' END AS method, CASE WHEN (a OR c OR s) AND n % 2 = 0 THEN 'iLocal_' || n + 100 || '.f_' || k + 3 || '.f_1' END AS new_value, CASE WHEN (a OR c OR s) AND n % 2 = 0 THEN 0.8 END::DOUBLE AS confidence FROM f""")
def local_field_resolve(spark, sf):
    """Fields of variables: told by alignment, by their tokens, or between anchors; variables of odd numbers aren't told."""
    from ..operators import align, unnamed

    k, n = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf, "part").select(k.alias("k"), n.alias("n"), F.lit("c").alias("container"))
    a = align.aligned(p.select("container", F.col("k").alias("field")), p.where("k % 10 <> 0").select("container", (F.col("k") + 3).alias("field")), ["container"], "field", 25)
    tokens = lambda shift, name: p.where("k % 4 > 0").select("container", (F.col("k") + shift).alias(name), F.concat(F.lit("tag"), F.col("k")).alias("token"), F.lit(1).alias("n"))
    met = keyed.first_wins(context.multiset_overlap(tokens(0, "o"), tokens(3, "w"), ["container"], "o", "w", near=True), ["o"], [-F.col("score"), F.col("w")])
    steps = align.bracketed(p.select("container", "k"), p.where("k % 7 = 0").select("container", "k", F.lit(3).cast("long").alias("shift")), ["container"], "k", "shift")
    stepped = steps.where("bracketed IS NOT NULL").select(F.col("k").alias("value"), (F.col("k") + F.col("bracketed")).alias("new_value"))
    told = unnamed.resolve_fields(p.select(F.concat(F.lit("K_"), "k").alias("name"), F.col("k").alias("value"), "n"), a.select(F.col("field").alias("value"), F.col("new_key").alias("new_value")), met.select(F.col("o").alias("value"), F.col("w").alias("new_value")), stepped)
    fields = told.select(F.col("n").cast("long").alias("variable"), "value", "new_value", F.lit(0.8).alias("confidence"))
    variables = p.where("n % 2 = 0").select(F.col("n").cast("long").alias("value"), (F.col("n") + 100).alias("new_value"), F.lit(0.95).alias("confidence")).distinct()
    entries = p.select(F.concat(F.lit("K_"), "k").alias("name"), F.concat(F.lit("iLocal_"), "n", F.lit(".f_"), "k", F.lit(".f_1")).alias("value"))
    both = unnamed.resolve_local_fields(entries, variables, fields).select("name", "new_value", "confidence")
    return told.select("name", "method").join(both, "name", "left")


@query("float_bits", "SELECT o_orderkey, (1 + (o_orderkey % 8388608) / 8388608.0::DOUBLE) * power(2.0::DOUBLE, o_custkey % 200 - 100) * (CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END) AS x FROM orders")
def float_bits(spark, sf):
    from ..functions.binary import float_of_bits

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bits = k % 8388608 + F.shiftleft(c % 200 + 27, 23) + F.when(c % 2 == 0, 0).otherwise(F.lit(1 << 31))
    return table(spark, sf, "orders").select("o_orderkey", float_of_bits(bits).alias("x"))


@query("variable_cascade", """WITH o AS (SELECT event_id AS v, event_id % 5 AS kind FROM events)
  SELECT 'V_' || v AS name, v AS value, CASE WHEN kind < 4 THEN v + 20_000_000 END AS new_value, CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN 0.6 END::DOUBLE AS confidence, CASE WHEN kind < 3 THEN 'same_line' WHEN kind = 3 THEN 'window' END AS method, CASE WHEN kind < 3 THEN 'migrated_same_line' WHEN kind = 3 THEN 'migrated_window' ELSE 'unresolved' END AS status FROM o""")
def variable_cascade(spark, sf):
    """A variable per event: beside a tag of its own, some lines below one, or without any."""
    from ..operators import unnamed

    e = table(spark, sf, "events")
    k = F.col("event_id")

    def rows(version, shift):
        name, tag = F.concat(F.lit("iLocal_"), k + shift), F.concat(F.lit('say("tag'), k, F.lit('");'))
        alone, bare = F.concat(F.lit("x = "), name, F.lit(";")), F.concat(F.lit("y = "), name, F.lit(";"))
        one = F.when(k % 5 < 3, F.array(F.concat(F.lit("if ("), name, F.lit(") "), tag))).when(k % 5 == 3, F.array(tag, F.lit(""), F.lit(""), alone)).otherwise(F.array(bare))
        # files are far apart in lines, so that no tag of another event lies near
        lines = e.select(F.concat(F.lit("f"), k % 50).alias("file"), k, F.posexplode(one).alias("i", "line"))
        return lines.select(F.lit(version).alias("version"), "file", (k * 1000 + F.col("i")).alias("line_no"), "line")

    entries = e.select(F.concat(F.lit("V_"), k).alias("name"), k.alias("value"))
    return unnamed.resolve_variables(entries, rows("old", 0).unionByName(rows("new", 20_000_000)))

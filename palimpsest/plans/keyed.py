"""Queries of the keyed operators. Snapshots: events before and from a moment; lineitem by return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed
from .registry import query, table

SPLIT = "2024-01-16"


def events(spark, sf, side):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return e.where(f"ts < timestamp'{SPLIT} 00:00:00'" if side == "old" else f"ts >= timestamp'{SPLIT} 00:00:00'")


OLD, NEW = f"(SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT} 00:00:00')", f"(SELECT * FROM events WHERE ts >= TIMESTAMP '{SPLIT} 00:00:00')"


@query("unique_key_map", """SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL
  GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1""")
def unique_key_map(spark, sf):
    return keyed.unique_map(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("unique_key_resolve", f"""WITH e AS (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k FROM events), o AS (SELECT user_id, event_type, k, min(event_id) AS old_id FROM e WHERE ts < TIMESTAMP '{SPLIT} 00:00:00' GROUP BY ALL HAVING count(DISTINCT event_id) = 1),
  n AS (SELECT user_id, event_type, k, min(event_id) AS new_id FROM e WHERE ts >= TIMESTAMP '{SPLIT} 00:00:00' GROUP BY ALL HAVING count(DISTINCT event_id) = 1)
  SELECT * FROM o JOIN n USING (user_id, event_type, k)""")
def unique_key_resolve(spark, sf):
    key = ["user_id", "event_type", "k"]
    side = lambda s: keyed.unique_map(events(spark, sf, s).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1)).select(*key, F.col("event_id").alias(f"{s}_id")), key, f"{s}_id")
    return side("old").join(side("new"), key)


@query("first_wins_map", """SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def first_wins_map(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return keyed.first_wins(li, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).drop("l_linenumber")


TWO_HOP = f"""WITH e AS (SELECT DISTINCT user_id::VARCHAR || ':' || event_type AS name, round(value * 100)::BIGINT AS value FROM {OLD}),
  b AS (SELECT value, min(path) AS path, max(path) AS other FROM (SELECT round(value * 100)::BIGINT AS value, event_type || '/' || (user_id % 50)::VARCHAR AS path FROM {OLD}) GROUP BY value),
  f AS (SELECT path, new_value FROM (SELECT event_type || '/' || (user_id % 50)::VARCHAR AS path, round(value * 100)::BIGINT AS new_value,
    row_number() OVER (PARTITION BY event_type || '/' || (user_id % 50)::VARCHAR ORDER BY event_id) AS r FROM {NEW}) WHERE r = 1),
  j AS (SELECT e.name, e.value, b.path, f.new_value, CASE WHEN b.path IS NULL THEN 'not_found_in_old' WHEN b.path <> b.other THEN 'ambiguous_path'
    WHEN f.new_value IS NULL THEN 'path_removed_in_new' WHEN f.new_value = e.value THEN 'unchanged' ELSE 'migrated' END AS status
    FROM e LEFT JOIN b USING (value) LEFT JOIN f USING (path))"""


@query("two_hop_resolve_status", TWO_HOP + " SELECT status, count(*)::BIGINT AS n FROM j GROUP BY status")
def two_hop_resolve_status(spark, sf):
    return two_hop(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


def two_hop(spark, sf):
    old, new = events(spark, sf, "old"), events(spark, sf, "new")
    path = F.concat(F.col("event_type"), F.lit("/"), (F.col("user_id") % 50).cast("string"))
    v = F.round(F.col("value") * 100).cast("long")
    entries = old.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("name"), v.alias("value")).distinct()
    forward = keyed.first_wins(new.select(path.alias("path"), v.alias("new_value"), "event_id"), ["path"], [F.col("event_id")]).drop("event_id")
    return keyed.two_hop(entries, old.select(v.alias("value"), path.alias("path")), forward)


@query("two_hop_rows", TWO_HOP + " SELECT name, value, path, CASE WHEN status IN ('unchanged', 'migrated') THEN new_value END AS new_value, status FROM j")
def two_hop_rows(spark, sf):
    return two_hop(spark, sf).select("name", "value", "path", "new_value", "status")


@query("loose_key_agreement", """SELECT lower(regexp_replace(p_type || '|' || p_brand, '[^A-Za-z0-9]+', '', 'g')) AS loose, count(*)::BIGINT AS n,
  count(DISTINCT p_size)::BIGINT AS n_values, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) END AS p_size FROM part GROUP BY 1""")
def loose_key_agreement(spark, sf):
    loose = F.lower(F.regexp_replace(F.concat_ws("|", "p_type", "p_brand"), "[^A-Za-z0-9]+", ""))
    return keyed.agreed(table(spark, sf, "part").select(loose.alias("loose"), "p_size"), ["loose"], "p_size")


@query("specific_over_generic", """WITH p AS (SELECT p_partkey, p_brand AS g, CASE WHEN p_size % 3 = 0 THEN p_brand || '.' || p_type ELSE p_type END AS path FROM part)
  SELECT * FROM (SELECT *, max(contains(path, '.')::INT) OVER (PARTITION BY g) AS has FROM p) WHERE contains(path, '.') OR has = 0""".replace("SELECT * FROM (", "SELECT p_partkey, g, path FROM ("))
def specific_over_generic(spark, sf):
    path = F.when(F.col("p_size") % 3 == 0, F.concat_ws(".", "p_brand", "p_type")).otherwise(F.col("p_type"))
    return keyed.specific_over_generic(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("g"), path.alias("path")), ["g"], F.contains("path", F.lit(".")))


@query("dedup_provenance", """SELECT md5(text) AS text_md5, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*)::BIGINT AS n FROM documents GROUP BY md5(text)""")
def dedup_provenance(spark, sf):
    return keyed.provenance(table(spark, sf, "documents").select(F.md5("text").alias("text_md5"), "source"), ["text_md5"], "source")


VOTES = "SELECT k, v, n, sum(n) OVER (PARTITION BY k) AS total, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS r FROM (SELECT {k} AS k, {v} AS v, count(*) AS n FROM {t} GROUP BY ALL)"


@query("consensus_mode", "SELECT k AS c_nationkey, v AS c_mktsegment, n::BIGINT AS votes, total::BIGINT AS total FROM (" + VOTES.format(k="c_nationkey", v="c_mktsegment", t="customer") + ") WHERE r = 1")
def consensus_mode(spark, sf):
    return keyed.votes(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


@query("supermajority_60", "SELECT k AS o_custkey, CASE WHEN n * 100 >= total * 60 THEN v END AS o_orderpriority, n::BIGINT AS votes, total::BIGINT AS total FROM (" + VOTES.format(k="o_custkey", v="o_orderpriority", t="orders") + ") WHERE r = 1")
def supermajority_60(spark, sf):
    return keyed.supermajority(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("topk_per_group", "SELECT o_custkey, o_orderkey, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 12")
def topk_per_group(spark, sf):
    return keyed.top_k(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 12).drop("o_totalprice")


@query("stable_vs_review", r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[0-9]+', '#', 'g') AS skeleton FROM pages)
  SELECT a.page_id, a.skeleton, CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.page_id % 2 = 1 AND b.skeleton = a.skeleton) THEN 'stable' ELSE 'review' END AS status FROM s a WHERE a.page_id % 2 = 0""")
def stable_vs_review(spark, sf):
    from ..functions.text import skeleton

    s = table(spark, sf, "pages").select("page_id", skeleton("url").alias("skeleton"))
    return keyed.partition_by_presence(s.where("page_id % 2 = 0"), s.where("page_id % 2 = 1"), ["skeleton"], "stable", "review").select("page_id", "skeleton", "status")


@query("snapshot_agreement", f"""WITH o AS (SELECT user_id, event_type, min(event_id) AS i, arg_min(value, event_id) AS v FROM {OLD} GROUP BY ALL), n AS (SELECT user_id, event_type, arg_min(value, event_id) AS v FROM {NEW} GROUP BY ALL)
  SELECT count(*)::BIGINT AS n, count(*) FILTER (o.v > 5 AND n.v > 5)::BIGINT AS both_changed, count(*) FILTER (o.v > 5 AND n.v > 5 AND round(o.v / 10) = round(n.v / 10))::BIGINT AS agree,
  round(count(*) FILTER (o.v > 5 AND n.v > 5 AND round(o.v / 10) = round(n.v / 10)) / greatest(count(*) FILTER (o.v > 5 AND n.v > 5), 1), 6) AS ratio FROM o JOIN n USING (user_id, event_type)""")
def snapshot_agreement(spark, sf):
    return agreement(spark, sf, [])


def agreement(spark, sf, by):
    from ..operators.metrics import agreement_ratios

    side = lambda s: events(spark, sf, s).groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias(s))
    both = side("old").join(side("new"), ["user_id", "event_type"])
    return agreement_ratios(both, by, (F.col("old") > 5) & (F.col("new") > 5), F.round(F.col("old") / 10) == F.round(F.col("new") / 10))


@query("agreement_per_family", f"""WITH o AS (SELECT user_id, event_type, arg_min(value, event_id) AS v FROM {OLD} GROUP BY ALL), n AS (SELECT user_id, event_type, arg_min(value, event_id) AS v FROM {NEW} GROUP BY ALL)
  SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (o.v > 5 AND n.v > 5)::BIGINT AS both_changed, count(*) FILTER (o.v > 5 AND n.v > 5 AND round(o.v / 10) = round(n.v / 10))::BIGINT AS agree,
  round(count(*) FILTER (o.v > 5 AND n.v > 5 AND round(o.v / 10) = round(n.v / 10)) / greatest(count(*) FILTER (o.v > 5 AND n.v > 5), 1), 6) AS ratio FROM o JOIN n USING (user_id, event_type) GROUP BY event_type HAVING count(*) >= 3""")
def agreement_per_family(spark, sf):
    return agreement(spark, sf, ["event_type"]).where("n >= 3")

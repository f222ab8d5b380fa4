"""Queries of the ordered and the aligning operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, sequence
from .keyed import NEW, OLD, SPLIT, events
from .registry import query, table


def numbered(spark, sf, side=None):
    e = events(spark, sf, side) if side else table(spark, sf, "events")
    return e.select("user_id", "event_id", "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("at"))


def N(source="events"):
    return f"(SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS at_ FROM {source})"


@query("islands_gap64", """SELECT o_custkey, island, count(*)::BIGINT AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT *, sum(brk) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS island FROM
  (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 640 THEN 1 ELSE 0 END AS brk FROM orders)) GROUP BY ALL""")
def islands_gap64(spark, sf):
    d = sequence.islands(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 640)
    return d.groupBy("o_custkey", "island").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("lag_pattern_dominant", f"""WITH p AS (SELECT event_type AS t0, lag(event_type, 1) OVER w AS t1, lag(event_type, 2) OVER w AS t2 FROM {N()} WINDOW w AS (PARTITION BY user_id ORDER BY at_)),
  c AS (SELECT t2, t1, t0, count(*) AS n FROM p WHERE t2 IS NOT NULL GROUP BY ALL) SELECT t2, t1, t0, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY t2, t1 ORDER BY n DESC, t0) AS r FROM c) WHERE r = 1""")
def lag_pattern_dominant(spark, sf):
    from ..operators.keyed import votes

    d = sequence.with_previous(numbered(spark, sf), ["user_id"], [F.col("at")], "event_type", 2).where("previous_2 IS NOT NULL")
    v = votes(d.select(F.col("previous_2").alias("t2"), F.col("previous_1").alias("t1"), F.col("event_type").alias("t0")), ["t2", "t1"], "t0")
    return v.select("t2", "t1", "t0", F.col("votes").alias("n"))


@query("enclosing_section", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def enclosing_section(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return sequence.last_before(c, ["conv_id"], [F.col("turn")], F.when(F.col("role") == "user", F.col("turn")), "section").drop("role")


@query("next_section", "SELECT conv_id, turn, first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_user FROM conversations")
def next_section(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return sequence.first_after(c, ["conv_id"], [F.col("turn")], F.when(F.col("role") == "user", F.col("turn")), "next_user").drop("role")


@query("position_from_end", "SELECT a.conv_id, a.turn, b.turn AS other_turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) a JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) b ON b.conv_id = a.conv_id + 1 AND a.r = b.r")
def position_from_end(spark, sf):
    d = sequence.from_end(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], [F.desc("turn")])
    other = d.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turn").alias("other_turn"), "from_end")
    return d.join(other, ["conv_id", "from_end"]).drop("from_end")


@query("context_frame", "SELECT conv_id, turn, string_agg(role, '>' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM conversations".replace("string_agg(role, '>' ORDER BY turn)", "string_agg(role, '>')"))
def context_frame(spark, sf):
    return sequence.frame(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")], "role", 2, 2, ">").drop("role")


@query("label_state_machine", """WITH s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations)
  SELECT conv_id, turn, nullif(string_agg(CASE WHEN role <> 'user' THEN role || turn::VARCHAR END, '.') OVER (PARTITION BY conv_id, seg ORDER BY turn), '') AS label FROM s""")
def label_state_machine(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    piece = F.when(F.col("role") != "user", F.concat("role", F.col("turn").cast("string")))
    return sequence.running_label(c, ["conv_id"], [F.col("turn")], F.col("role") == "user", piece, ".").drop("role")


@query("brace_depth_blocks", r"""WITH t AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<(/?(?:ul|li|div|article|p)\b)', 1), lambda x, i: {'x': x, 'i': i})) AS s FROM pages),
  d AS (SELECT page_id, s.i AS i, s.x AS tag, sum(CASE WHEN s.x[1] = '/' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY s.i) AS after FROM t)
  SELECT page_id, max(after)::BIGINT AS deepest, count(*) FILTER (after = 0)::BIGINT AS closed, count(*)::BIGINT AS tags FROM d GROUP BY page_id""")
def brace_depth_blocks(spark, sf):
    tags = F.posexplode(F.regexp_extract_all("html", F.lit(r"<(/?(?:ul|li|div|article|p)\b)"), F.lit(1))).alias("i", "tag")
    t = table(spark, sf, "pages").select("page_id", tags)
    close = F.startswith("tag", F.lit("/")).cast("int")
    d = sequence.depth_blocks(t, ["page_id"], [F.col("i")], 1 - close, close)
    return d.groupBy("page_id").agg(F.max("depth_after").alias("deepest"), F.count_if(F.col("depth_after") == 0).alias("closed"), F.count("*").alias("tags"))


@query("leading_block", "SELECT conv_id, count(*)::BIGINT AS n FROM (SELECT *, sum((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS broken FROM conversations) WHERE broken = 0 GROUP BY conv_id")
def leading_block(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return sequence.leading_block(c, ["conv_id"], [F.desc("turn")], F.col("role") == "system").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("forward_span", f"""SELECT a.user_id, a.at_ AS at, count(b.at_)::BIGINT AS n, count(*) FILTER (b.event_type = 'purchase')::BIGINT AS purchases FROM {N()} a LEFT JOIN {N()} b ON a.user_id = b.user_id AND b.at_ BETWEEN a.at_ + 1 AND a.at_ + 40 WHERE a.event_type = 'signup' GROUP BY ALL""")
def forward_span(spark, sf):
    w = Window.partitionBy("user_id").orderBy("at").rowsBetween(1, 40)
    d = numbered(spark, sf).withColumns({"n": F.count("*").over(w), "purchases": F.count_if(F.col("event_type") == "purchase").over(w)})
    return d.where("event_type = 'signup'").select("user_id", "at", "n", "purchases")


@query("function_tiles", "SELECT conv_id, turn AS start, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS \"end\" FROM conversations WHERE role = 'user'")
def function_tiles(spark, sf):
    return sequence.tiles(table(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("start")), ["conv_id"], "start")


@query("cumulative_offsets", "SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations")
def cumulative_offsets(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return sequence.cumulative(c, ["conv_id"], [F.col("turn")], "n").drop("n")


@query("run_length_args", f"""WITH r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY at_) AS run, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY at_) AS nxt FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY at_) THEN 0 ELSE 1 END AS brk FROM {N()})),
  g AS (SELECT user_id, run, count(*) AS n, min(event_type) AS event_type, arg_max(coalesce(nxt, ''), at_) AS after FROM r GROUP BY ALL),
  b AS (SELECT user_id, event_type, n, after, count(*) OVER (PARTITION BY user_id) AS runs, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, run) AS i FROM g),
  z AS (SELECT user_id, arg_max(event_type, at_) AS last, arg_max(coalesce(p, ''), at_) AS previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY at_) AS p FROM {N()}) GROUP BY user_id)
  SELECT user_id, event_type, n::BIGINT AS longest, runs::BIGINT AS runs, nullif(after, '') AS after, last, nullif(previous, '') AS previous FROM b JOIN z USING (user_id) WHERE i = 1""")
def run_length_args(spark, sf):
    from ..operators.evidence import longest_run

    return longest_run(numbered(spark, sf), ["user_id"], "at", "event_type", 2)


@query("nearest_within_w", f"""WITH e AS (SELECT * FROM {N()}), j AS (SELECT a.user_id, a.at_, p.event_id, abs(p.at_ - a.at_) AS d, row_number() OVER (PARTITION BY a.user_id, a.at_ ORDER BY abs(p.at_ - a.at_), p.at_) AS r
  FROM e a JOIN e p ON p.user_id = a.user_id AND p.event_type = 'purchase' AND abs(p.at_ - a.at_) <= 15 WHERE a.event_type = 'error')
  SELECT a.user_id, a.at_ AS at, j.event_id AS near_id, j.d AS distance FROM e a LEFT JOIN j ON j.user_id = a.user_id AND j.at_ = a.at_ AND r = 1 WHERE a.event_type = 'error'""")
def nearest_within_w(spark, sf):
    e = numbered(spark, sf)
    targets = e.where("event_type = 'purchase'").withColumnRenamed("event_id", "near_id")
    return align.nearest(e.where("event_type = 'error'").select("user_id", "at"), targets, ["user_id"], "at", 15, "near_id")


@query("signature_ordinal_match", """WITH o AS (SELECT l_orderkey, string_agg(DISTINCT (l_suppkey % 5)::VARCHAR, ',' ORDER BY (l_suppkey % 5)::VARCHAR) AS signature FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
  n AS (SELECT l_orderkey, string_agg(DISTINCT (l_suppkey % 5)::VARCHAR, ',' ORDER BY (l_suppkey % 5)::VARCHAR) AS signature FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
  a AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY l_orderkey)::INT AS ordinal FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY l_orderkey)::INT AS ordinal FROM n)
  SELECT signature, ordinal, a.l_orderkey AS old_key, b.l_orderkey AS new_key FROM a JOIN b USING (signature, ordinal)""")
def signature_ordinal_match(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_suppkey") % 5).cast("string").alias("m"))
    return align.signature_ordinal(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'N'"), "l_orderkey", "m")


@query("jaccard_pairs", """WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), z AS (SELECT l_suppkey, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.l_suppkey AS a_key, b.l_suppkey AS b_key, count(*) AS shared FROM s a JOIN s b USING (l_partkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY ALL)
  SELECT a_key, b_key, shared::BIGINT AS shared, x.n::BIGINT AS a_size, y.n::BIGINT AS b_size, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN z x ON x.l_suppkey = a_key JOIN z y ON y.l_suppkey = b_key WHERE shared / (x.n + y.n - shared) > 0.15""")
def jaccard_pairs(spark, sf):
    s = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    return align.jaccard_pairs(s, s, "l_suppkey", "l_partkey", 0.15, half=True)


SHIFT = """WITH o AS (SELECT DISTINCT l_suppkey AS g, l_orderkey AS o FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT DISTINCT l_suppkey AS g, l_orderkey AS n FROM lineitem WHERE l_returnflag = 'N'),
  h AS (SELECT g, n - o AS shift, count(*) AS hits FROM o JOIN n USING (g) WHERE n >= o AND n < o + 2000 GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY hits DESC, shift) AS r FROM h) WHERE r = 1), c AS (SELECT g, count(*) AS n FROM o GROUP BY g) """


def halves(spark, sf, flag):
    return table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("key"))


@query("dominant_shift", SHIFT + "SELECT g, shift, hits::BIGINT AS hits, c.n::BIGINT AS n FROM b JOIN c USING (g)")
def dominant_shift(spark, sf):
    return align.best_shift(halves(spark, sf, "A"), halves(spark, sf, "N"), ["g"], "key", 2000)


@query("align_runs", """WITH p AS (SELECT DISTINCT event_type AS g, (event_id - event_id % 10) AS k FROM events), q AS (SELECT DISTINCT g, k + 30 AS n FROM p WHERE k % 40 <> 0),
  h AS (SELECT g, n - k AS shift, count(*) AS hits FROM p JOIN q USING (g) WHERE n >= k AND n < k + 100 GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY hits DESC, shift) AS r FROM h) WHERE r = 1), c AS (SELECT g, count(*) AS n FROM p GROUP BY g)
  SELECT p.g, p.k AS key, q.n AS new_key, b.shift FROM p JOIN b USING (g) JOIN c USING (g) JOIN q ON q.g = p.g AND q.n = p.k + b.shift WHERE b.hits >= greatest(1, c.n // 2)""")
def align_runs(spark, sf):
    p = table(spark, sf, "events").select(F.col("event_type").alias("g"), (F.col("event_id") - F.col("event_id") % 10).alias("key")).distinct()
    q = p.where("key % 40 <> 0").withColumn("key", F.col("key") + 30)
    return align.aligned(p, q, ["g"], "key", 100)


ANCHORS = "(SELECT o_custkey, o_orderkey AS k, o_orderkey % 3 AS d FROM orders WHERE o_orderkey % 5 = 0)"


def step_sides(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("k"))
    return o.where("k % 5 <> 0"), o.where("k % 5 = 0").withColumn("d", F.col("k") % 3)


@query("asof_step", f"""WITH a AS {ANCHORS}, t AS (SELECT o_custkey, max(k) AS top FROM a GROUP BY 1) SELECT r.o_custkey, r.o_orderkey AS k, CASE WHEN r.o_orderkey <= t.top THEN a.d END AS as_of
  FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) r ASOF LEFT JOIN a ON a.o_custkey = r.o_custkey AND a.k <= r.o_orderkey LEFT JOIN t ON t.o_custkey = r.o_custkey""")
def asof_step(spark, sf):
    rows, anchors = step_sides(spark, sf)
    return align.as_of(rows, anchors, ["o_custkey"], "k", "d")


@query("bracketed_step", f"""WITH a AS {ANCHORS} SELECT r.o_custkey, r.o_orderkey AS k, CASE WHEN b.d = c.d THEN b.d END AS bracketed FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) r
  ASOF LEFT JOIN a b ON b.o_custkey = r.o_custkey AND b.k <= r.o_orderkey ASOF LEFT JOIN a c ON c.o_custkey = r.o_custkey AND c.k >= r.o_orderkey""")
def bracketed_step(spark, sf):
    rows, anchors = step_sides(spark, sf)
    return align.bracketed(rows, anchors, ["o_custkey"], "k", "d")


@query("greedy_monotone", """WITH RECURSIVE g AS (SELECT l_suppkey, list_sort(coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'A'), [])) AS o, list_sort(coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'N'), [])) AS n FROM lineitem GROUP BY l_suppkey),
  w AS (SELECT l_suppkey, o, n, 1 AS i, 0::BIGINT AS shift, []::VARCHAR[] AS leaves FROM g
    UNION ALL SELECT l_suppkey, o, n, i + 1, coalesce(hit - o[i], shift), CASE WHEN hit IS NULL THEN leaves ELSE list_append(leaves, o[i] || '>' || hit) END FROM (SELECT *, list_min(list_filter(n, lambda x: x >= o[i] + shift AND x <= o[i] + shift + 25)) AS hit FROM w WHERE i <= len(o)))
  SELECT l_suppkey, len(leaves)::INT AS n, array_to_string(leaves, ',') AS leaves FROM w WHERE i = len(o) + 1""")
def greedy_monotone(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = lambda flag: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_partkey"))))
    g = li.groupBy("l_suppkey").agg(keys("A").alias("old"), keys("N").alias("new"))
    return align.greedy_leaves(g, "old", "new").select("l_suppkey", F.size("leaves").alias("n"), F.array_join(F.transform("leaves", lambda x: F.concat_ws(">", x["o"].cast("string"), x["n"].cast("string"))), ",").alias("leaves"))


@query("gap_fill_between_anchors", f"""WITH o AS (SELECT * FROM {N(OLD)}), n AS (SELECT * FROM {N(NEW)}), s AS (SELECT o.user_id, o.at_ AS old_at, n.at_ AS new_at FROM o JOIN n ON n.user_id = o.user_id AND n.at_ = o.at_ WHERE o.at_ % 4 = 1),
  g AS (SELECT *, lead(old_at) OVER w AS no_, lead(new_at) OVER w AS nn FROM s WINDOW w AS (PARTITION BY user_id ORDER BY old_at))
  SELECT o.user_id, o.at_ AS old_at, n.at_ AS new_at, o.event_type FROM g JOIN o ON o.user_id = g.user_id AND o.at_ > g.old_at AND o.at_ < g.no_ JOIN n ON n.user_id = g.user_id AND n.at_ = g.new_at + o.at_ - g.old_at WHERE g.no_ - g.old_at = g.nn - g.new_at AND o.event_type = n.event_type""")
def gap_fill_between_anchors(spark, sf):
    old, new = numbered(spark, sf, "old"), numbered(spark, sf, "new")
    anchors = old.where("at % 4 = 1").select("user_id", F.col("at").alias("old_at")).join(new.select("user_id", F.col("at").alias("old_at"), F.col("at").alias("new_at")), ["user_id", "old_at"])
    return align.gap_fill(old, new, anchors, ["user_id"], "at", "event_type")


@query("greedy_one_to_one", "SELECT s_nationkey::BIGINT AS parent, i AS old, i + 1 AS new, CASE WHEN i % 2 = 0 THEN 0.95 ELSE 0.7 END::DOUBLE AS score FROM (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier)")
def greedy_one_to_one(spark, sf):
    """Even rows like the next best; odd rows like what the row before has taken, and get their second choice."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    r = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("parent"), (F.row_number().over(w) - 1).cast("long").alias("old"))
    even = F.col("old") % 2 == 0
    two = F.array(F.struct(F.col("old").alias("new"), F.when(even, 0.9).otherwise(0.8).alias("score")), F.struct((F.col("old") + 1).alias("new"), F.when(even, 0.95).otherwise(0.7).alias("score")))
    return align.one_to_one(r.select("parent", "old", F.explode(two).alias("c")).select("parent", "old", "c.new", "c.score"), ["parent"], "parent bigint, old bigint, new bigint, score double")

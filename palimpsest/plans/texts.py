"""Queries of scans, predicates and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary, text
from ..operators import evidence, joins, keyed, routing
from .registry import query, table


@query("token_extract_links", r"""SELECT page_id, u.i::INT AS place, u.x AS href FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x, i: {'x': x, 'i': i - 1})) AS u FROM pages)""")
def token_extract_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "href"))


@query("token_measure", r"""SELECT doc_id, len(regexp_extract_all(text, '[a-z]+'))::BIGINT AS words, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers, length(text)::BIGINT AS n, length(text) < 100 AND NOT regexp_matches(text, '[0-9]') AS stub FROM documents""")
def token_measure(spark, sf):
    return evidence.measures(table(spark, sf, "documents"), "doc_id", "text", {"words": "[a-z]+", "numbers": "[0-9]+"}, 100, "[0-9]")


#: Tiers in order: name, globs on the source, least characters.
TIERS = [("long_core", ["src0", "src1*"], 4000), ("core", ["src?"], 500), ("rest", ["*"], 200)]
_TIER_SQL = "CASE WHEN (source = 'src0' OR source LIKE 'src1%') AND n_chars >= 4000 THEN 'long_core' WHEN source LIKE 'src_' AND n_chars >= 500 THEN 'core' WHEN n_chars >= 200 THEN 'rest' ELSE 'dropped' END"


def tiers(spark, sf):
    from ..operators.resolve import route

    match = lambda globs: F.lower("source").rlike("|".join(map(text.glob_to_regex, globs)))
    return route(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), [(n, match(g) & (F.col("n_chars") >= least)) for n, g, least in TIERS], "dropped", "tier")


@query("tier_classify", f"SELECT doc_id, {_TIER_SQL} AS tier FROM documents")
def tier_classify(spark, sf):
    return tiers(spark, sf).select("doc_id", "tier")


@query("tier_manifest", f"SELECT tier, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars < 100)::BIGINT AS stubs FROM (SELECT *, {_TIER_SQL} AS tier FROM documents) GROUP BY tier")
def tier_manifest(spark, sf):
    return tiers(spark, sf).groupBy("tier").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 100).alias("stubs"))


@query("tier_rank", f"SELECT source, doc_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (tier <> 'dropped') DESC, n_chars DESC, doc_id) AS r FROM (SELECT *, {_TIER_SQL} AS tier FROM documents)) WHERE r <= 5")
def tier_rank(spark, sf):
    d = keyed.top_k(tiers(spark, sf), ["source"], [F.desc(F.col("tier") != "dropped"), F.desc("n_chars"), F.asc("doc_id")], 5)
    return d.select("source", "doc_id", "rank")


@query("canonicalize_url", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])utm_[^&]*&?', '\1', 'g'), '[?&]$', '') AS bare, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[0-9]+', '#', 'g') AS skeleton FROM pages""")
def canonicalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.without_tracking("url").alias("bare"), text.skeleton("url").alias("skeleton"))


@query("prefix_closure_presence", r"""WITH s AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM pages),
  c AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM s WHERE page_id % 2 = 1)),
  w AS (SELECT page_id, array_to_string(p[1:i], '/') AS path FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM s WHERE page_id % 2 = 0)) SELECT page_id, path FROM w WHERE path IN (FROM c)""")
def prefix_closure_presence(spark, sf):
    p = table(spark, sf, "pages").withColumn("p", text.segments("url"))
    wanted = p.where("page_id % 2 = 0").select("page_id", F.explode(text.prefixes(F.col("p"), "/")).alias("path"))
    return joins.present_by_prefix(wanted, "path", p.where("page_id % 2 = 1"), F.col("p"), "/").select("page_id", "path")


@query("most_specific_anchor", r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages), a AS (SELECT host AS anchor, count(*) AS n FROM h GROUP BY 1 UNION ALL SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1), count(*) FROM h GROUP BY 1)
  SELECT page_id, anchor FROM (SELECT h.page_id, a.anchor, row_number() OVER (PARTITION BY h.page_id ORDER BY length(a.anchor) DESC) AS r FROM h JOIN a ON (a.anchor = h.host AND a.n >= 3) OR a.anchor = regexp_extract(h.host, '([^.]+\.[^.]+)$', 1)) WHERE r = 1""")
def most_specific_anchor(spark, sf):
    h = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    h = h.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    hosts = h.groupBy("host").agg(F.count("*").alias("n")).where("n >= 3").select(F.col("host").alias("anchor"))
    return evidence.most_specific(h, "page_id", [F.col("host"), F.col("domain")], hosts.unionByName(h.select(F.col("domain").alias("anchor"))))


@query("shared_multi_pattern", "SELECT d.doc_id, w.word FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) d JOIN (VALUES ('the'), ('and'), ('der'), ('que'), ('les'), ('von')) w(word) USING (word)")
def shared_multi_pattern(spark, sf):
    return evidence.present_words(table(spark, sf, "documents"), "doc_id", F.split(F.lower("text"), " "), ["the", "and", "der", "que", "les", "von"])


@query("needle_prefilter", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+=?'))::BIGINT AS tokens FROM documents WHERE contains(text, 'License')")
def needle_prefilter(spark, sf):
    return table(spark, sf, "documents").where(F.contains("text", F.lit("License"))).select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]+=?")).cast("long").alias("tokens"))


@query("kv_lines_parse", "WITH l AS (SELECT user_id, event_id, 'KEY_' || event_type || ' = \"' || regexp_extract(props, '([0-9]+)', 1) || '\"' AS line FROM events) SELECT user_id, regexp_extract(line, '^(\\w+) = \"([^\"]*)\"$', 1) AS name, arg_max(regexp_extract(line, '^(\\w+) = \"([^\"]*)\"$', 2), event_id) AS value FROM l GROUP BY ALL")
def kv_lines_parse(spark, sf):
    from ..sources.entries import parsed_entries

    line = F.concat(F.lit("KEY_"), F.col("event_type"), F.lit(' = "'), F.regexp_extract("props", "([0-9]+)", 1), F.lit('"'))
    parsed = parsed_entries(table(spark, sf, "events").select("user_id", "event_id", line.alias("line")), "line")
    return keyed.last_wins(parsed, ["user_id", "name"], "value", [F.col("event_id")])


@query("nested_json_dictionary", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE props->>'k' IS NOT NULL")
def nested_json_dictionary(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k is not null")


@query("delimited_crosswalk", "SELECT n_nationkey, n_nationkey * 3 AS source, n_nationkey + 7 AS target FROM nation WHERE n_nationkey % 4 <> 3")
def delimited_crosswalk(spark, sf):
    from ..sources.entries import crosswalk

    n = F.col("n_nationkey")
    sep = F.when(n % 4 == 0, ":").when(n % 4 == 1, "=").when(n % 4 == 2, ",").otherwise(" ")
    lines = table(spark, sf, "nation").select("n_nationkey", F.concat((n * 3).cast("string"), sep, (n + 7).cast("string")).alias("line"))
    return crosswalk(lines, "line").select("n_nationkey", F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"))


@query("statement_filters", """WITH l AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'x = ' || o_custkey WHEN 1 THEN '  return ' || o_custkey WHEN 2 THEN ' f(' || o_custkey || '); ' ELSE 'x == ' || o_custkey END AS line FROM orders)
  SELECT o_orderkey, o_orderkey % 4 = 0 AS assigns, o_orderkey % 4 = 1 AS returns, o_orderkey % 4 = 2 AS calls FROM l""")
def statement_filters(spark, sf):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    line = F.when(k == 0, F.concat(F.lit("x = "), c)).when(k == 1, F.concat(F.lit("  return "), c)).when(k == 2, F.concat(F.lit(" f("), c, F.lit("); "))).otherwise(F.concat(F.lit("x == "), c))
    return table(spark, sf, "orders").select("o_orderkey", line.alias("line")).select("o_orderkey", *evidence.statement_kinds(F.col("line")))


@query("gate_blocks", "SELECT conv_id, bool_or(role = 'system') AND bool_or(role = 'user') AND bool_or(role = 'assistant' AND length(text) > 500) AS gated FROM conversations GROUP BY conv_id")
def gate_blocks(spark, sf):
    r = F.col("role")
    return evidence.gated(table(spark, sf, "conversations"), ["conv_id"], [r == "system", r == "user", (r == "assistant") & (F.length("text") > 500)])


@query("kind_by_suffix", """WITH n AS (SELECT p_partkey, 'KEY_' || replace(p_brand, '#', '_') || '_' || p_size || CASE p_size % 3 WHEN 0 THEN '_max_speed' WHEN 1 THEN '_speed' ELSE '' END AS name FROM part)
  SELECT p_partkey, CASE WHEN ends_with(name, '_max_speed') THEN 'limit' WHEN ends_with(name, '_speed') THEN 'motion' END AS kind, starts_with(name, 'KEY_Brand_1') AND NOT starts_with(name, 'KEY_Brand_13') AS allowed, 'KEY_Brand' AS family FROM n""")
def kind_by_suffix(spark, sf):
    k = F.col("p_size") % 3
    name = F.concat(F.lit("KEY_"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_"), F.col("p_size"), F.when(k == 0, "_max_speed").when(k == 1, "_speed").otherwise(""))
    n = table(spark, sf, "part").select("p_partkey", name.alias("name"))
    return n.select("p_partkey", routing.kind_of("name", {"_speed": "motion", "_max_speed": "limit"}).alias("kind"), routing.allowed("name", ["KEY_Brand_1"], ["KEY_Brand_13"]).alias("allowed"), routing.family_of("name").alias("family"))


@query("value_shape_route", """WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Root_' || p_partkey::VARCHAR || '.f_' || p_size::VARCHAR WHEN 1 THEN 'Root_' || p_partkey::VARCHAR WHEN 2 THEN 'iVar' || p_size::VARCHAR WHEN 3 THEN 'f_' || p_size::VARCHAR WHEN 4 THEN p_size::VARCHAR || '.f_1' ELSE p_size::VARCHAR END AS value FROM part)
  SELECT p_partkey, value, CASE WHEN regexp_matches(value, '^Root_[0-9]+$') THEN 'bare_root' WHEN regexp_matches(value, '^Root_[0-9]+[.]') THEN 'global' WHEN regexp_matches(value, '^[a-z]+Var[0-9]+') THEN 'local' WHEN regexp_matches(value, '^f_[0-9]+$') THEN 'field' WHEN regexp_matches(value, '^[0-9]+[.]f_') THEN 'alias' ELSE 'static' END AS route FROM v""")
def value_shape_route(spark, sf):
    from ..operators.paths import shapes, shape_of

    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    v = F.when(k % 6 == 0, F.concat(F.lit("Root_"), k.cast("string"), F.lit(".f_"), size)).when(k % 6 == 1, F.concat(F.lit("Root_"), k.cast("string"))).when(k % 6 == 2, F.concat(F.lit("iVar"), size)).when(k % 6 == 3, F.concat(F.lit("f_"), size)).when(k % 6 == 4, F.concat(size, F.lit(".f_1"))).otherwise(size)
    return shape_of(table(spark, sf, "part").select("p_partkey", v.alias("value")), "value", shapes("Root"), "route")


@query("content_hash", "SELECT doc_id, sha1(concat_ws('|', doc_id::VARCHAR, lang, source, n_chars::VARCHAR)) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", F.col("n_chars").cast("string"))).alias("hash"))


@query("wildcard_scan_health", r"""WITH p AS (SELECT item_id, regexp_split_to_array(text, '\s+') AS w FROM benchmark), d AS (SELECT doc_id % 2 = 0 AS old, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents)),
  j AS (SELECT p.item_id, count(*) FILTER (d.old) AS o, count(*) FILTER (NOT d.old) AS n FROM p JOIN d ON d.w[i] = p.w[1] AND d.w[i + 1] = p.w[2] AND d.w[i + 3] = p.w[4] AND d.w[i + 3:i + len(p.w) - 1] = p.w[4:] WHERE len(p.w) >= 4 GROUP BY 1)
  SELECT p.item_id, coalesce(o, 0)::BIGINT AS n_old, coalesce(n, 0)::BIGINT AS n_new, CASE WHEN len(p.w) < 4 THEN 'TOO_SHORT' WHEN coalesce(o, 0) = 0 THEN 'NOT_IN_OLD' WHEN o > 1 THEN 'AMBIG_OLD' WHEN coalesce(n, 0) = 1 THEN 'OK' WHEN coalesce(n, 0) = 0 THEN 'BROKEN' ELSE 'AMBIG_NEW' END AS status FROM p LEFT JOIN j USING (item_id)""")
def wildcard_scan_health(spark, sf):
    """Whole items as patterns of any length, in which the third word may be any."""
    words = F.split("text", r"\s+", -1)
    p = table(spark, sf, "benchmark").select(F.col("item_id").alias("pattern"), words.alias("words"))
    return binary.long_pattern_health(table(spark, sf, "documents"), "doc_id", "text", p, [True, True, False, True], F.col("doc_id") % 2 == 0).withColumnRenamed("pattern", "item_id")


@query("hex_fields", "SELECT doc_id, length(hex(encode(text)))::BIGINT AS digits, md5(upper(hex(encode(text)))) AS hex_md5 FROM documents")
def hex_fields(spark, sf):
    h = F.hex(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", F.length(h).cast("long").alias("digits"), F.md5(h).alias("hex_md5"))


@query("hex_literal_parse", "SELECT o_orderkey, o_orderkey % 256 AS low FROM orders")
def hex_literal_parse(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.regexp_replace(F.lpad(F.hex("o_orderkey"), 16, "0"), "(..)", "$1 ").alias("h"))
    return d.select("o_orderkey", binary.integer(binary.hex_bytes("h"), 8, 1, big=True).alias("low"))


@query("int_literal_bases", "SELECT o_orderkey, o_orderkey AS a, o_orderkey AS b FROM orders")
def int_literal_bases(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", binary.literal(F.concat(F.lit("0x"), F.hex(k))).alias("a"), binary.literal(k.cast("string")).alias("b"))


@query("rotl64_crosswalk", "SELECT o_orderkey, ((o_orderkey << 7) | (o_orderkey >> 57))::BIGINT AS rotated FROM orders")
def rotl64_crosswalk(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", binary.rotate_left("o_orderkey", 7).alias("rotated"))


@query("integer_views", "SELECT o_orderkey, o_orderkey % 65536 AS u16, CASE WHEN o_orderkey % 65536 >= 32768 THEN o_orderkey % 65536 - 65536 ELSE o_orderkey % 65536 END AS s16, o_orderkey % 16777216 AS u24 FROM orders")
def integer_views(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.reverse(F.hex("o_orderkey")).alias("x"), F.unhex(F.lpad(F.hex("o_orderkey"), 16, "0")).alias("b"))
    return d.select("o_orderkey", binary.integer(F.col("b"), 7, 2, big=True).alias("u16"), binary.signed(binary.integer(F.col("b"), 7, 2, big=True), 16).alias("s16"), binary.integer(F.col("b"), 6, 3, big=True).alias("u24"))


@query("version_sort", "SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT, p_brand)::INT AS place FROM (SELECT DISTINCT p_brand FROM part)")
def version_sort(spark, sf):
    from ..sources.versions import placed

    return placed(table(spark, sf, "part").select("p_brand").distinct(), "p_brand")


@query("previous_version", "WITH b AS (SELECT DISTINCT p_brand, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS v FROM part) SELECT a.p_brand, arg_max(o.p_brand, o.v) AS previous FROM b a LEFT JOIN b o ON o.v < a.v GROUP BY a.p_brand")
def previous_version(spark, sf):
    b = table(spark, sf, "part").select("p_brand", text.natural_key("p_brand").alias("key")).distinct().withColumn("all", F.lit(1))
    from ..operators.sequence import with_previous

    return with_previous(b, ["all"], [F.col("key"), F.col("p_brand")], "p_brand", 1).select("p_brand", F.col("previous_1").alias("previous"))


@query("common_prefix_len", "WITH p AS (SELECT p_brand, p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS o FROM part) SELECT p_partkey, len(list_filter(range(1, length(p_name) + 1), lambda i: i <= length(o) AND substr(p_name, 1, i) = substr(o, 1, i)))::INT AS n FROM p WHERE o IS NOT NULL")
def common_prefix_len(spark, sf):
    from pyspark.sql import Window

    p = table(spark, sf, "part").withColumn("o", F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("o is not null")
    return p.select("p_partkey", text.common_prefix_length("p_name", "o").cast("int").alias("n"))


@query("anchor_tokens", r"""SELECT page_id, array_to_string(list_distinct_ordered, ',') AS anchors FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT page_id, regexp_extract_all(html, '"([^"]{3,})"', 1) AS l FROM pages))""")
def anchor_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(text.anchors("html"), ",").alias("anchors"))


@query("masked_lines", r"""SELECT doc_id, s.i::INT AS line_no, trim(regexp_replace(regexp_replace(regexp_replace(s.x, '"[^"]*"', '"S"', 'g'), '[0-9]+', 'N', 'g'), '[ \t]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'x': x, 'i': i - 1})) AS s FROM documents)""")
def masked_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line", text.masked_line("line"))


@query("normal_lines", "SELECT o_orderkey, 'x = __TARGET__ + Root_N.f_N[iVarN]; // ' || o_orderstatus AS line FROM orders")
def normal_lines(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    value = F.concat(F.lit("Root_"), k, F.lit(".f_9"))
    line = F.concat(F.lit("  x =  "), value, F.lit(" + Root_"), c, F.lit(".f_"), k, F.lit("[iVar"), c, F.lit("];\t// "), "o_orderstatus")
    # a target that is the beginning of a longer number stays within it: targets end at a step here
    return table(spark, sf, "orders").select("o_orderkey", text.normal_line(line, value).alias("line"))


@query("present_or_parent", """WITH v AS (SELECT p_partkey, 'Root_' || p_size || '.f_' || p_partkey % 30 AS up, 'Root_' || p_size || '.f_' || p_partkey % 30 || '[' || p_partkey % 3 || ' /*3*/]' AS value FROM part), s AS (SELECT DISTINCT CASE p_partkey % 2 WHEN 0 THEN up ELSE value END AS v FROM v WHERE p_partkey % 7 = 0)
  SELECT p_partkey, CASE WHEN value IN (FROM s) THEN 'value' ELSE 'parent' END AS found_by FROM v WHERE value IN (FROM s) OR up IN (FROM s)""")
def present_or_parent(spark, sf):
    k = F.col("p_partkey")
    up = F.concat(F.lit("Root_"), "p_size", F.lit(".f_"), k % 30)
    value = F.concat(up, F.lit("["), k % 3, F.lit(" /*3*/]"))
    v = table(spark, sf, "part").select("p_partkey", value.alias("value"))
    seen = table(spark, sf, "part").where(k % 7 == 0).select(F.when(k % 2 == 0, up).otherwise(value).alias("value"))
    return joins.present_or_parent(v, "value", seen, F.regexp_replace("value", r"\[[0-9]+ /\*[0-9]+\*/\]$", "")).select("p_partkey", "found_by")


@query("root_proximity", "SELECT o_orderkey, CASE WHEN d <= 10 THEN 0.18 WHEN d <= 100 THEN 0.16 WHEN d <= 1000 THEN 0.1 WHEN d <= 5000 THEN 0.05 ELSE 0.0 END::DOUBLE AS bonus FROM (SELECT o_orderkey, abs(o_orderkey - o_custkey) AS d FROM orders)")
def root_proximity(spark, sf):
    steps = [(10, 0.18), (100, 0.16), (1000, 0.1), (5000, 0.05)]
    return table(spark, sf, "orders").select("o_orderkey", text.proximity(F.col("o_orderkey"), F.col("o_custkey"), steps).alias("bonus"))


@query("anchored_single_value", r"""WITH m AS (SELECT page_id % 2 AS v, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), u AS (SELECT v, lang, min(title) AS title, count(DISTINCT title) AS n FROM m GROUP BY ALL)
  SELECT a.lang, CASE WHEN a.n = 1 AND b.n = 1 THEN b.title END AS title, a.n::BIGINT AS n_old, b.n::BIGINT AS n_new FROM u a JOIN u b ON a.lang = b.lang AND a.v = 0 AND b.v = 1""")
def anchored_single_value(spark, sf):
    m = table(spark, sf, "pages").select((F.col("page_id") % 2).alias("v"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return evidence.single_in_each(m.where("v = 0"), m.where("v = 1"), "lang", "title")


@query("shape_equi_join", r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[0-9]+', 'N', 'g') AS shape FROM pages)
  SELECT shape, count(*) FILTER (page_id % 2 = 0)::BIGINT AS n_old, count(*) FILTER (page_id % 2 = 1)::BIGINT AS n_new, min(page_id) FILTER (page_id % 2 = 0) AS old_key, min(page_id) FILTER (page_id % 2 = 1) AS new_key FROM s GROUP BY shape HAVING count(*) FILTER (page_id % 2 = 0) > 0 AND count(*) FILTER (page_id % 2 = 1) > 0""")
def shape_equi_join(spark, sf):
    s = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[0-9]+", "N").alias("shape"))
    return evidence.shape_matches(s.where("page_id % 2 = 0"), s.where("page_id % 2 = 1"), "shape", "page_id")


@query("levenshtein_ascii", "WITH p AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT a.p_brand, a.p_name, b.p_name AS other, levenshtein(a.p_name, b.p_name)::INT AS d FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 4")
def levenshtein_ascii(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_name").distinct()
    d = p.join(p.withColumnRenamed("p_name", "other"), "p_brand").where("p_name < other").withColumn("d", F.levenshtein("p_name", "other", 4))
    return d.where("d >= 0")

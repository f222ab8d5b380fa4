"""The queries over these operators and their SQL, as the driver's entry point registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIN_SITES = 8


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import summary, without_boilerplate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return without_boilerplate(docs, MIN_SITES).select(*summary(docs))


OP1_SQL = f"""
WITH docs AS (SELECT doc_id, source, text FROM documents),
lines AS (
  SELECT doc_id, source, s.x AS line, s.i AS "at"
  FROM (SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'x': x, 'i': i}})) AS s FROM docs)
),
marks AS (
  SELECT line, min({{'d': doc_id, 'i': "at"}}) AS keep FROM lines WHERE trim(line) <> ''
  GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES}
),
told AS (
  SELECT l.*, m.line IS NOT NULL AND m.keep <> {{'d': l.doc_id, 'i': l."at"}} AS gone FROM lines l LEFT JOIN marks m ON l.line = m.line
)
SELECT d.doc_id, coalesce(count(*) FILTER (trim(t.line) <> ''), 0)::BIGINT AS n_lines, coalesce(count(*) FILTER (t.gone), 0)::BIGINT AS n_removed,
  md5(coalesce(string_agg(t.line, chr(10) ORDER BY t."at") FILTER (NOT t.gone), '')) AS text_md5
FROM docs d LEFT JOIN told t ON t.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import digests, texts_to_media

    return digests(texts_to_media(table(spark, sf_dir, "documents")))


#: The target mixture of the query; a name that isn't given has weight 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
SEED, MAX_EPOCHS = 17, 2


def with_domain(docs: DataFrame) -> DataFrame:
    """documents with domain, the class of its source's number, and n_tokens, its words."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    return docs.withColumns({"domain": F.concat(F.lit("d"), F.coalesce(number % 4, F.lit(0)).cast("string")), "n_tokens": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = with_domain(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return mix(docs, WEIGHTS, F.col("tokens"), MAX_EPOCHS, SEED).select("doc_id", "domain", "lang", "source", "epoch", "take")


def _deal_sql(name: str, source: str, parent: str, child: str) -> str:
    order = f"PARTITION BY {parent} ORDER BY cap::DOUBLE / weight, {child}"
    return f"""
{name}_a AS (SELECT *, budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
  sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_, row_number() OVER ({order}) AS n FROM ({source})),
{name}_b AS (SELECT *, cap::HUGEINT * weights_ <= left_::HUGEINT * weight AS full_ FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN NOT full_ THEN n END) OVER (PARTITION BY {parent}) AS first_ FROM {name}_b),
{name}_d AS (SELECT *, max(CASE WHEN n = first_ THEN left_ END) OVER (PARTITION BY {parent}) AS l1, max(CASE WHEN n = first_ THEN weights_ END) OVER (PARTITION BY {parent}) AS w1 FROM {name}_c),
{name} AS (SELECT *, CASE WHEN full_ THEN cap::BIGINT ELSE (l1::HUGEINT * weight // w1)::BIGINT END AS share FROM {name}_d)"""


def _weight_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END AS weight"


OP4_SQL = f"""
WITH docs AS (
  SELECT doc_id, 'd' || coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4, 0)::VARCHAR AS domain, lang, source,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {MAX_EPOCHS} * sum(n_tokens)::BIGINT AS cap FROM docs WHERE n_tokens > 0 GROUP BY ALL),
{_deal_sql("one", "SELECT domain, sum(cap)::BIGINT AS cap, " + _weight_sql("domain") + ", 1 AS one, (SELECT sum(tokens)::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain", "one", "domain")},
{_deal_sql("two", "SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, " + _weight_sql("lang").replace("CASE lang", "CASE l.lang") + ", any_value(o.share) AS budget FROM leaves l JOIN one o USING (domain) GROUP BY l.domain, l.lang", "domain", "lang")},
{_deal_sql("three", "SELECT l.domain, l.lang, l.source, l.tokens, l.cap, " + _weight_sql("source") + ", t.share AS budget FROM leaves l JOIN two t USING (domain, lang)", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, share // tokens AS full_, share % tokens AS rest FROM three),
placed AS (
  SELECT d.*, p.full_, p.rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}|' || p.full_::VARCHAR || '|' || doc_id::VARCHAR), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM docs d JOIN plan p USING (domain, lang, source) WHERE n_tokens > 0
),
drawn AS (SELECT *, greatest(0, least(n_tokens, rest - before_))::BIGINT AS part FROM placed),
times AS (SELECT *, full_ + CASE WHEN part > 0 THEN 1 ELSE 0 END AS times FROM drawn)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, CASE WHEN epoch < full_ THEN n_tokens ELSE part END AS take
FROM (SELECT *, unnest(range(times)) AS epoch FROM times)
"""


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"]
    return assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(*columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preference import conversation_arrays, format_pairs, neighbour_pairs

    return format_pairs(neighbour_pairs(conversation_arrays(table(spark, sf_dir, "conversations"))))


OP7_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
last_ AS (SELECT conv_id, max(n) AS n, arg_max(text, n) AS text FROM turns WHERE role = 'assistant' GROUP BY conv_id),
both_ AS (
  SELECT t.conv_id, t.n, t.role, t.text AS c, CASE WHEN t.n = l.n THEN coalesce(o.text, '') ELSE t.text END AS r
  FROM turns t LEFT JOIN last_ l ON l.conv_id = t.conv_id LEFT JOIN last_ o ON o.conv_id = xor(t.conv_id, 1)
),
split_ AS (SELECT *, coalesce(min(CASE WHEN c <> r THEN n END) OVER (PARTITION BY conv_id), 1 + max(n) OVER (PARTITION BY conv_id)) - 1 AS k FROM both_),
heads AS (
  SELECT *, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(c, '<|', '< |') || '<|end|>' || chr(10) AS cb, replace(r, '<|', '< |') || '<|end|>' || chr(10) AS rb FROM split_
),
ends AS (
  SELECT *, sum(length(head) + length(cb)) OVER w AS ce, sum(length(head) + length(rb)) OVER w AS re
  FROM heads WINDOW w AS (PARTITION BY conv_id, n > k ORDER BY n)
)
SELECT conv_id, any_value(k)::INT AS n_common, coalesce(string_agg(head || cb, '' ORDER BY n) FILTER (n <= k), '') AS prompt,
  coalesce(string_agg(head || cb, '' ORDER BY n) FILTER (n > k), '') AS chosen, coalesce(string_agg(head || rb, '' ORDER BY n) FILTER (n > k), '') AS rejected,
  coalesce(string_agg((ce - length(cb))::BIGINT::VARCHAR || ':' || ce::BIGINT::VARCHAR, ',' ORDER BY n) FILTER (n > k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((re - length(rb))::BIGINT::VARCHAR || ':' || re::BIGINT::VARCHAR, ',' ORDER BY n) FILTER (n > k AND role = 'assistant'), '') AS rejected_mask
FROM ends GROUP BY conv_id
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress, with_label_errors

    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .cross_tokens import align

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return align(table(spark, sf_dir, "documents"), a.read(), b.read())


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_store": op2_token_store,
    "op3_media": op3_media,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_preference": op7_preference,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_personal_data": op9_personal_data,
    "op10_language_id": op10_language_id,
    "op11_simhash": op11_simhash,
    "op12_vector_codes": op12_vector_codes,
    "op13_cross_tokens": op13_cross_tokens,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op4_mixing": OP4_SQL,
    "op7_preference": OP7_SQL,
}

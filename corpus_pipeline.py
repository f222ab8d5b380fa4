"""The corpus pipeline: stages over documents, each an operator of palimpsest.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the
columns of documents; the last returns their token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import encode_texts
from palimpsest.llm.common import stored
from palimpsest.llm.jaccard import near_duplicates
from palimpsest.llm.line_dedup import without_boilerplate
from palimpsest.llm.mixing import mix
from palimpsest.llm.quality import assess
from palimpsest.llm.queries import MIN_SITES, SEED, WEIGHTS, with_domain


def _aside(docs: DataFrame, names: set[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step's rows with the columns of docs, of which those of these names are put aside meanwhile."""
    clash = {c: f"__own_{c}" for c in docs.columns if c in names}
    return step(docs.withColumnsRenamed(clash)).select(*(F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with __row, a name of each row's own that stays the same at each reading, however files are cut into tasks: its file and its place there.

    What isn't read from files as it is gets numbers, which are stored before they are read twice.
    """
    try:
        return docs.select("*", F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string")).alias("__row"))
    except AnalysisException:
        return stored(docs.withColumn("__row", F.monotonically_increasing_id().cast("string")), "numbered")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those with null or empty texts among them; repeated rows are judged alike, a null language is a language."""
    return _aside(docs, {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"}, lambda d: assess(d).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go, but for their first occurrence; every document stays, n_chars follows its text.

    A null text stays null, with a null n_chars; a null source is a source; rows with one id and one
    text keep the same lines.
    """
    return _aside(docs, {"n_lines", "n_removed"}, lambda d: without_boilerplate(d, MIN_SITES).withColumn("n_chars", F.length("text").cast("long")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row stays: that of the least id (null after all others), of rows with one id any one.

    Rows without words are linked with nothing, and all stay.
    """
    rows = _numbered(docs)
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("__key"), "text")
    found = near_duplicates(keyed, key="__key", words=5, percent=80)
    stay = found.where("n_shingles = 0 OR __key = component_id").select(F.col("__key.__row").alias("__row"))
    return rows.join(stay, "__row", "left_semi").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens, by target weights; documents drawn stay whole, that in which a budget ends too.

    Each row is drawn or not by itself; rows without tokens are never drawn; null names are a name of their own.
    """
    rows = _numbered(docs)
    counted = with_domain(rows.select("__row", "doc_id", "lang", "source", "text"))
    drawn = mix(counted, WEIGHTS, F.expr("tokens * 9 div 10"), 1, SEED, key="__row", order="doc_id").where("take > 0").select("__row").distinct()
    return rows.join(drawn, "__row", "left_semi").select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids, none for null and empty texts; a row for each row."""
    coded = encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: The stages hold a language model, components and byte-pair encoding, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet: how likely the visible text is under each language's
character model (fitted on labelled documents, see quality.fit), the language that
the markup declares, the address's suffix, and the host's prior. How far declarations
and suffixes can be trusted is counted over all pages against what the texts alone say;
host priors are counted likewise and smoothed, host by domain, domain by all pages, each
page's own count left out.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_by_hot_key, stored
from .quality import _models, _name, fit, grams

#: More languages than there are; labels of more names than this aren't languages.
MAX_LANGUAGES = 1000
#: Weights, in pages, of the level above when a host's or a domain's prior is smoothed.
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
_OPENS = re.compile(r"<!--|<(script|style|noscript|template)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"""<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b|<meta\b[^<>]*?content-language[^<>]*?content\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I)


def visible_text(page: str) -> str:
    """What stands outside tags, comments and hidden elements; what isn't closed hides nothing. Each kind's end is looked for once more only beyond where it was found."""
    closes: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()
    parts, at = [], 0
    while m := _OPENS.search(page, at):
        kind = (m[1] or "--").lower()
        if kind not in closes:
            closes[kind] = re.compile("-->" if kind == "--" else rf"</{kind}\s*>", re.I)
        end = None if kind in unclosed else closes[kind].search(page, m.end())
        if end:
            parts += [page[at : m.start()], " "]
            at = end.end()
        else:
            unclosed.add(kind)
            parts.append(page[at : m.end()])
            at = m.end()
    rest = "".join([*parts, page[at:]])
    last = rest.rfind(">") + 1
    return " ".join(markup.unescape(_TAG.sub(" ", rest[:last]) + rest[last:]).split())


def declared(page: str) -> str:
    m = _DECLARED.search(page)
    return (m[1] or m[2]).lower() if m else ""


def language_of(label: Column) -> Column:
    """A label's language: its first subtag, lower-cased (pt of pt-BR); null where there is none."""
    first = F.lower(F.regexp_extract(label.cast("string"), r"^\s*([^\s_-]+)", 1))
    return F.when(first != "", first)


def _languages(names: DataFrame) -> list[str]:
    """The languages in use; their number doesn't grow with the texts, and more than MAX_LANGUAGES is an error."""
    found = names.where("l IS NOT NULL").distinct().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"labels of more than {MAX_LANGUAGES} languages")
    return sorted(r.l for r in found)


def _described(pages: DataFrame, folder: str, languages: list[str], key: str, url: str, page: str) -> DataFrame:
    """Per page: id, host, domain, suffix, declared, n (characters of text), likely (mean log p of a character per language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(folder)
        for batch in batches:
            told, n, likely = [], [], []
            for p in batch.column(2).to_pylist():
                text = visible_text(p or "")
                told.append(declared(p or ""))
                n.append(len(text))
                if text:
                    g = grams(text)
                    likely.append([float(models.get(_name(name))[g].mean(dtype=np.float64)) for name in languages])
                else:
                    likely.append([0.0] * len(languages))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string()), pa.array(n, pa.int64()), pa.array(likely, pa.list_(pa.float64()))], names=["id", "host", "declared", "n", "likely"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    kind = pages.schema[key].dataType.simpleString()
    seen = pages.select(F.col(key).alias("id"), host.alias("host"), F.col(page).alias("page")).mapInArrow(run, f"id {kind}, host string, declared string, n bigint, likely array<double>")
    return seen.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+|[^.]*)$", 1))


def _counts(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Pages per value of by and language of the text, as an array, and all."""
    each = F.array(*(F.sum(F.when(F.col("best") == i, 1).otherwise(0)).cast("double") for i in range(n)))
    return rows.groupBy(by).agg(each.alias(f"{by}_counts"), F.count("*").alias(f"{by}_pages"))


def _argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def identify(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", text: str = "text", lang: str = "lang", text_chars: int = 60) -> DataFrame:
    """Per page: key, lang, probability, text_lang (by the text alone), declared, host.

    labelled: texts with their languages, by the first subtag of the label; all that have
    one fit the models. text_chars: a longer text counts for as many characters, as
    neighbouring n-grams aren't independent and hosts and declarations would never tell. A page
    without text is judged by the other evidence; one without any gets the most
    common language. Null addresses share one nameless host; repeated pages count each
    time. No labels or no pages: no rows to tell, and lang is null without labels.
    """
    texts = labelled.select(language_of(F.col(lang)).alias("l"), F.col(text).alias("t"))
    languages = _languages(texts.select("l"))
    if not languages:
        none = F.lit(None).cast("string")
        return pages.select(F.col(key), none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    k = len(languages)
    folder = fit(texts.where("l IS NOT NULL"), "t", "l")
    rows = _described(pages, folder, languages, key, url, page)
    rows = stored(rows.withColumn("best", F.when(F.col("n") > 0, _argmax(F.col("likely")))), "page-evidence")
    names = F.array(*map(F.lit, languages))

    # all pages, for what has no text and as the top of the hierarchy
    overall = _counts(rows.withColumn("all", F.lit("")), "all", k).select("all_counts").collect()
    total = list(overall[0][0]) if overall else [0.0] * k
    share = [(c + 1) / (sum(total) + k) for c in total]
    top = F.array(*map(F.lit, share))

    # declarations and suffixes: few names, whatever the pages' number, but their tables join by key all the same
    seen = rows.select("declared", "suffix", "domain", "host", "best")
    for by in ("declared", "suffix", "domain", "host"):
        rows = joined_by_hot_key(rows, stored(_counts(seen, by, k), f"{by}-counts"), by, f"{by}_pages")

    def others(counts: str) -> Column:
        """The counts without the page's own."""
        return F.transform(F.col(counts), lambda c, i: c - F.when(F.col("best") == i, 1.0).otherwise(0.0))

    def smoothed(counts: Column, above: Column, weight: float) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
        return F.zip_with(counts, above, lambda c, p: (c + p * weight) / (n + weight))

    prior = smoothed(others("host_counts"), smoothed(others("domain_counts"), top, DOMAIN_WEIGHT), HOST_WEIGHT)
    weights = F.array(*(F.lit(float(c) + k) for c in total))
    given = lambda counts: F.zip_with(others(counts), weights, lambda c, n: F.log((c + 1) / n))
    evidence = F.transform("likely", lambda x: x * F.least(F.col("n"), F.lit(text_chars)))
    score = F.zip_with(evidence, F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b)
    told = F.when(F.col("declared") == "", F.transform("likely", lambda x: F.lit(0.0))).otherwise(given("declared_counts"))
    score = F.zip_with(score, told, lambda a, b: a + b)
    score = F.zip_with(score, given("suffix_counts"), lambda a, b: a + b)
    out = rows.withColumn("score", score)
    mass = F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.array_max("score")))
    return out.select(
        F.col("id").alias(key), F.get(names, _argmax(F.col("score"))).alias("lang"), (1 / mass).alias("probability"), F.get(names, F.col("best")).alias("text_lang"), "declared", "host"
    )

"""Language identification of web pages by fusing evidence.

For each page the posterior of a language is the product of

* the likelihood of its main text: byte trigrams, hashed, with smoothed counts
  from a bounded sample of labelled documents; neighbouring trigrams depend on
  each other, so a text counts as ``effective`` independent ones at most;
* the likelihood of the language that its markup declares, from counts of
  (declared, text's language) over all pages;
* the likelihood of its address suffix, counted likewise;
* the prior of its host, smoothed towards its domain's, that towards its
  suffix', and that towards the whole corpus'. The page itself is taken out of
  its host's counts before.

All counts are expected counts (sums of the text's posteriors) made by grouped
aggregation over all pages, so a hot host is summed before it is shuffled. Only
tables whose size does not follow the corpus reach the driver: trigram counts
(2**bits times languages). Counts by suffix and declared language are joined, so
each value has its own likelihood, however many there are.

Defined results: a null or empty page, or one without any article text, is
judged by its other evidence; a null url has the empty host; a page without any
evidence gets the corpus' prior; ties go to the language first in the alphabet;
repeated rows give repeated results; very long pages are read whole; without
labelled documents the result has null languages; an empty table gives an empty
table; extra columns are ignored. More than ``most_languages`` labelled languages
are an error, before anything is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_extract import main_text
from .workspace import materialize

BITS = 16
# Both are linear in the page: a tag is taken once, and its white space is read by one way only.
_HTML_TAG = re.compile(r"<!--.*?(?:-->|\Z)|(?P<tag><html\b[^>]*)", re.IGNORECASE | re.DOTALL)
_LANG = re.compile(r"\blang\s*=\s*(?:[\"']\s*)?([A-Za-z]{2,3})", re.IGNORECASE)


def declared_language(page: str | None) -> str:
    """The language of the first html tag that declares one, wherever in the page; '' if none does."""
    for m in _HTML_TAG.finditer(page or ""):
        if m["tag"] and (lang := _LANG.search(m["tag"])):
            return lang[1].lower()
    return ""


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text, in lower case."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    code = raw[:-2] * np.uint32(65536) + raw[1:-1] * np.uint32(256) + raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class TextModel:
    """Languages and the log-likelihood of each trigram bucket in each of them."""

    languages: list[str]
    table: np.ndarray
    effective: int = 150

    def log_likelihood(self, text: str) -> np.ndarray:
        t = trigrams(text)
        if not len(t) or not text.strip():
            return np.zeros(len(self.languages))
        return self.table[t].mean(axis=0) * min(len(t), self.effective)


def train(docs: DataFrame, sample_rows: int = 6000, effective: int = 150, most_languages: int = 200) -> TextModel:
    """Trigram counts by language from about ``sample_rows`` labelled documents (all, if there are fewer)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", "doc_id")
    n = known.select("lang").count()
    scale = 1 << 30
    share = int(min(1.0, sample_rows / max(n, 1)) * scale)
    sample = known.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(scale)) < share).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                own = counts.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                own += np.bincount(trigrams(text), minlength=1 << BITS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "t": at, "n": own[at]})

    languages = sorted(r["lang"] for r in sample.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:  # the table of counts would not be bounded; a larger one can be asked for
        raise ValueError(f"more than most_languages={most_languages} languages")
    counted = sample.mapInPandas(count, "lang string, t long, n long").groupBy("lang", "t").agg(F.sum("n").alias("n"))
    frame = counted.toPandas()
    table = np.zeros((1 << BITS, max(len(languages), 1)))
    for k, lang in enumerate(languages):
        own = frame[frame["lang"] == lang]
        table[own["t"].to_numpy(), k] = own["n"].to_numpy()
    table = np.log((table + 0.5) / (table + 0.5).sum(axis=0))
    return TextModel(languages, table, effective)


def read_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id``, ``url``, ``declared``, ``loglik`` (of the main text, by language), ``text_chars``."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    "url": batch["url"],
                    "declared": [declared_language(h) for h in batch["html"]],
                    "loglik": [known.log_likelihood(t) for t in texts],
                    "text_chars": [len(t) for t in texts],
                }
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInPandas(
        read, f"page_id {kind}, url string, declared string, loglik array<double>, text_chars long"
    )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def _sums(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Expected counts by language: the sum of each entry of ``p``."""
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias("c"))


def identify(pages: DataFrame, model: TextModel, strength: float = 4.0) -> DataFrame:
    """``page_id``, ``host``, ``suffix``, ``declared``, ``text_lang``, ``lang``, ``confidence``.

    ``strength`` is the weight, in pages, of each level's parent.
    """
    langs = model.languages
    n = len(langs)
    if not n:
        return pages.select(
            "page_id", host_of(F.col("url")).alias("host"), suffix_of(host_of(F.col("url"))).alias("suffix"), F.lit(None).cast("string").alias("declared"),
            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"),
        )
    read = read_pages(pages, model).withColumn("host", host_of(F.col("url")))
    read = read.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), _softmax(F.col("loglik")).alias("p"))
    read = materialize(read.drop("url"), "language-pages")
    pages_p = read.select("host", "domain", "suffix", "declared", "p")

    total = np.array(_sums(pages_p.withColumn("all", F.lit(0)), ["all"], n).select("c").first()[0] if not read.isEmpty() else [0.0] * n)
    base = (total + 1.0) / (total.sum() + n)

    def evidence(table: DataFrame, key: str, counts: str, name: str) -> DataFrame:
        """``key`` and ``name``, log P(value | language), for every value; a missing declaration or suffix says nothing."""
        m = table.where(F.col(key) != "").count() + 1
        own = F.array(*[F.log((F.col(counts)[i] + 1.0) / F.lit(float(total[i] + m))) for i in range(n)])
        return table.select(key, F.when(F.col(key) == "", F.array(*[F.lit(0.0)] * n)).otherwise(own).alias(name))

    def smooth(counts: Column, parent: Column) -> Column:
        whole = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.transform(counts, lambda c, i: (F.greatest(c, F.lit(0.0)) + strength * parent[i]) / (F.greatest(whole, F.lit(0.0)) + strength))

    hosts = materialize(_sums(pages_p, ["host", "domain", "suffix"], n), "language-hosts")
    summed = lambda key: hosts.groupBy(key).agg(F.array(*[F.sum(F.col("c")[i]) for i in range(n)]).alias(f"{key}_c"))
    suffixes = materialize(summed("suffix"), "language-suffixes")
    declared = materialize(_sums(pages_p, ["declared"], n), "language-declared")
    prior0 = F.array(*[F.lit(float(x)) for x in base])
    levels = (
        hosts.join(summed("domain"), "domain").join(suffixes, "suffix").join(evidence(suffixes, "suffix", "suffix_c", "_x"), "suffix")
        .select("host", "_x", F.col("c").alias("host_c"), "domain_c", smooth(F.col("suffix_c"), prior0).alias("_s"))
        .select("host", "_x", "host_c", "domain_c", "_s", smooth(F.col("domain_c"), F.col("_s")).alias("_parent"))
        .select("host", "_x", "host_c", F.col("_parent"))
    )
    # A code has three letters at most, so this table is small whatever the corpus.
    joined = read.join(levels, "host").join(F.broadcast(evidence(declared, "declared", "c", "_d")), "declared")
    without = F.zip_with("host_c", "p", lambda c, p: c - p)
    scored = joined.select("*", without.alias("_others"))
    scored = scored.select("*", smooth(F.col("_others"), F.col("_parent")).alias("_prior"))
    scored = scored.select("*", _softmax(F.transform("loglik", lambda x, i: x + F.log(F.col("_prior")[i]) + F.col("_d")[i] + F.col("_x")[i])).alias("_post"))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return scored.select(
        "page_id", "host", "suffix", "declared",
        F.when(F.col("text_chars") > 0, best(F.col("p"))).alias("text_lang"),
        best(F.col("_post")).alias("lang"),
        F.array_max("_post").alias("confidence"),
    )

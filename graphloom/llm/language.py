"""Language identification by Bayesian fusion of text, markup, address and host evidence.

For each page and language the log posterior is the sum of: a tempered n-gram log likelihood of the
visible text; the log likelihood of the language that the markup declares and of the address's
suffix, from soft counts over all pages; and a host prior. The prior is smoothed in a hierarchy: a
host leans on its domain, a domain on the whole corpus, by KAPPA pseudo-pages each, and a page's own
vote is taken out of its host's counts. Votes are whole millionths, so sums do not depend on order.

The text model is fitted on a bounded sample: of every language SAMPLE_ROWS documents, first those of
at most SAMPLE_CHARS characters by a hash of doc_id, then longer ones by their length. All counts
cover all pages.

Defined results: a null or empty html has no text and no declared language, a null or odd url an
empty host; an html of any length is read whole, in one task; repeated rows count and are returned
each; ties go to the first language in order of name; an empty table of pages gives an empty result,
and without any labelled document the language is null; further columns are not returned.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.store import BROADCAST_BYTES, cut, table

#: The bound of the sample that the text model is fitted on: rows of each language, and characters of a row where the language has such rows.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 4000
#: A host with at least one in this many pages is joined by broadcast: there are no more such hosts.
HEAVY = 1000
BUCKETS = 1 << 16
#: The text counts as at most this many independent n-grams.
TEMPER = 60.0
KAPPA = 4.0
VOTES = 1_000_000

_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.I | re.S)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def visible(html: str) -> str:
    return entities.unescape(_HIDDEN.sub(" ", html))


def declared(html: str) -> str:
    """The primary subtag of the markup's language, or an empty string."""
    found = _DECLARED.search(html)
    return found[1].lower() if found else ""


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the texts, letters in lower case, and len + 1 bounds; none lies across two texts."""
    data = [f" {' '.join(t.lower().split())} ".encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    inside = np.ones(len(raw), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    code = raw[at] << 16 | raw[at + 1] << 8 | raw[at + 2]
    return (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64), np.concatenate([[0], np.cumsum(sizes - 2)])


def fit_text(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """Languages in order and (BUCKETS, languages) log likelihoods, centred, with one pseudo-count a bucket and 1000 in all."""
    names = sorted({lang for lang, _ in rows})
    table = np.zeros((BUCKETS, len(names)), np.float32)
    for i, name in enumerate(names):
        code, _ = _grams([text for lang, text in rows if lang == name])
        counts = np.bincount(code, minlength=BUCKETS)
        table[:, i] = np.log((counts + 0.05) / (counts.sum() + 0.05 * BUCKETS))
    return names, table - table.mean(axis=1, keepdims=True) if names else table


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text) of the bounded sample. Ids are picked first, each partition's own first ones before they meet; texts are then read where they lie."""
    fits = docs.where("lang is not null and text is not null")
    slim = fits.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.greatest(F.length("text"), F.lit(SAMPLE_CHARS)).alias("size"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("size", "h", "doc_id", "t"))
    picked = cut(slim.withColumn("nth", first).where(F.col("nth") <= SAMPLE_ROWS).select("lang", "doc_id", "t").distinct()).toDF("_lang", "_doc_id", "_t")
    texts = fits.select("lang", "doc_id", F.xxhash64("text").alias("t"), "text")
    same = [F.col("lang") == F.col("_lang"), F.col("doc_id").eqNullSafe(F.col("_doc_id")), F.col("t") == F.col("_t")]
    found = texts.join(F.broadcast(picked), same, "left_semi")  # SAMPLE_ROWS rows a language
    return found.dropDuplicates(["lang", "doc_id", "t"]).orderBy("lang", "doc_id", "t").select("lang", "text")


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host in lower case without port, its last two labels, its last label; empty where the url has no host."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    labels = F.split(host, r"\.")
    return host, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), F.element_at(labels, -1)


def page_evidence(pages: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, host, domain, suffix, declared, loglik): loglik is tempered, one entry a language."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows at any corpus size
    fields = [pages.schema["page_id"], *(T.StructField(n, T.StringType()) for n in ("host", "domain", "suffix", "declared")), T.StructField("loglik", T.ArrayType(T.DoubleType()))]
    wide = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = [h or "" for h in part.column(4).to_pylist()]
                code, bounds = _grams([visible(h) for h in pages])
                n = np.diff(bounds)
                each = np.concatenate([model[code], np.zeros((1, wide), np.float32)])
                sums = np.add.reduceat(each, bounds[:-1], axis=0, dtype=np.float64)
                scaled = sums / np.maximum(n, 1)[:, None] * np.where(n > 0, np.minimum(n, TEMPER), 0)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pages) + 1) * wide, pa.int32()), pa.array(scaled.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array([declared(h) for h in pages], pa.string()), lists], names=[f.name for f in fields])

    host, domain, suffix = address(F.col("url"))
    return pages.select("page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), "html").mapInArrow(run, T.StructType(fields))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, posterior, text_lang, declared, host) per row of pages."""
    names, model = fit_text([(r["lang"], r["text"]) for r in sample(docs).collect()])  # SAMPLE_ROWS rows a language
    if not names:
        host, _, _ = address(F.col("url"))
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("posterior"), none.alias("text_lang"), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), _DECLARED.pattern.replace("<html", "(?i)<html", 1), 1)).alias("declared"), host.alias("host"))
    k = range(len(names))
    rows = page_evidence(pages, names, model)
    top = F.array_max("loglik")
    odds = [F.exp(F.col("loglik")[i] - top) for i in k]
    rows = cut(rows.select("*", *[F.round(o / reduce(Column.__add__, odds) * VOTES).cast("long").alias(f"v{i}") for i, o in enumerate(odds)]))

    def votes(*keys: str, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(f"v{i}").alias(f"{name}{i}") for i in k])

    total = rows.agg(*[F.coalesce(F.sum(f"v{i}"), F.lit(0)).alias(f"g{i}") for i in k], F.count("*").alias("pages")).first()
    count = [total[f"g{i}"] / VOTES for i in k]
    prior = [(c + 1.0) / (sum(count) + len(names)) for c in count]
    hosts = rows.groupBy("host", "domain").agg(*[F.sum(f"v{i}").alias(f"h{i}") for i in k], F.count("*").alias("pages"))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"h{i}").alias(f"d{i}") for i in k])
    place = cut(hosts.join(domains, "domain").drop("domain"))
    heavy = F.col("pages") * HEAVY >= total["pages"]
    crowded, rest = F.broadcast(place.where(heavy).drop("pages")), place.where(~heavy).drop("pages")
    joined = rows.join(crowded, "host").unionByName(rows.join(crowded.select("host"), "host", "left_anti").join(rest, "host"))
    suffixes = cut(votes("suffix", name="s"))
    suffixes = F.broadcast(suffixes) if suffixes.count() * 8 * (len(names) + 4) <= BROADCAST_BYTES else suffixes
    joined = joined.join(F.broadcast(cut(votes("declared", name="m"))), "declared").join(suffixes, "suffix")  # a declared language has at most three letters
    in_host, in_domain = (reduce(Column.__add__, [F.col(f"{c}{i}") for i in k]) / VOTES for c in "hd")
    own = reduce(Column.__add__, [F.col(f"v{i}") for i in k]) / VOTES
    scores = []
    for i in k:
        by_domain = (F.col(f"d{i}") / VOTES + KAPPA * prior[i]) / (in_domain + KAPPA)
        by_host = ((F.col(f"h{i}") - F.col(f"v{i}")) / VOTES + KAPPA * by_domain) / (in_host - own + KAPPA)
        likely = [F.log((F.col(f"{c}{i}") / VOTES + 1.0) / (count[i] + 50.0)) for c in "ms"]
        scores.append(F.col("loglik")[i] + F.log(by_host) + likely[0] + likely[1])
    fused = joined.select("page_id", "declared", "host", "loglik", F.array(*scores).alias("score"))
    best = F.array_max("score")
    spread = reduce(Column.__add__, [F.exp(F.col("score")[i] - best) for i in k])
    name = F.array(*[F.lit(n) for n in names])
    return fused.select(
        "page_id",
        F.element_at(name, F.array_position("score", best).cast("int")).alias("lang"),
        F.round(1 / spread, 6).alias("posterior"),
        F.element_at(name, F.array_position("loglik", F.array_max("loglik")).cast("int")).alias("text_lang"),
        "declared",
        "host",
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))

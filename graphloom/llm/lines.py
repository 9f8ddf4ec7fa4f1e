"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and go.

Each line hash gathers the sites it stands on in a HyperLogLog sketch; sketches merge by
aggregation, first within partitions. Lines whose estimate lies within four standard errors of the
threshold get an exact distinct count, so the outcome is that of exact counts. All sites of all rows
count. With ``several_texts`` a spread line stands in two different texts at least: a document that
was copied to many sites is then a duplicate, not boilerplate, which is what the pipeline asks for.

Defined results: blank lines stay; a null text has no lines and stays null; a text all of whose
lines go becomes empty; a null site is no site; repeated rows are treated alike; a text of any length
is read whole; an empty table gives an empty result; further columns are kept by
``drop_spread_lines``, whatever their names, as its own columns are removed again by position in a
struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.store import BROADCAST_BYTES, cut, table

MIN_SITES = 10
#: Registers are 2**LG_K; the relative standard error is 1.04 / sqrt(2**LG_K).
LG_K = 10
ERROR = 1.04 / 2 ** (LG_K / 2)


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """128 bits for each line, null for blank ones."""
    return F.transform(text_lines(text), lambda x: F.when(F.trim(x) != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", text: str = "text", several_texts: bool = False) -> DataFrame:
    """(a, b): keys of the lines that stand on at least min_sites sites and, with ``several_texts``, in two texts."""
    rows = docs.where(F.col(text).isNotNull() & F.col(site).isNotNull()).select(F.xxhash64(text).alias("t1"), F.col(site).cast("string").alias("site"), line_keys(F.col(text)).alias("keys"))
    each = cut(rows.select("t1", "site", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k")).select("k.a", "k.b", "t1", "site"))
    sketches = each.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), (F.min("t1") < F.max("t1")).alias("several"))
    seen = cut(sketches.where("several" if several_texts else "true").where(F.col("sites") >= min_sites * (1 - 4 * ERROR)).drop("several"))
    near = seen.where(F.col("sites") <= min_sites * (1 + 4 * ERROR)).select("a", "b")
    # Few lines are near the threshold: sent to every task, they let the distinct rows combine before their shuffle.
    near = F.broadcast(near) if near.count() * 32 <= BROADCAST_BYTES else near
    exact = each.join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return seen.where(F.col("sites") > min_sites * (1 + 4 * ERROR)).select("a", "b").unionAll(exact.select("a", "b"))


def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", text: str = "text", counts: bool = False, several_texts: bool = False) -> DataFrame:
    """docs without the spread lines; with ``counts``, two more columns after docs' own: n_lines and n_removed."""
    gone = cut(spread_lines(docs, min_sites, site, text, several_texts))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    found = packed.where("text is not null").select("t1", "t2", F.posexplode(line_keys(F.col("text"))).alias("at", "k")).select("t1", "t2", "at", "k.a", "k.b")
    keys = F.broadcast(gone) if gone.count() * 32 <= BROADCAST_BYTES else gone
    hits = cut(found.join(keys, ["a", "b"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("at").alias("gone")))
    bytes_ = hits.agg(F.sum(F.size("gone") * 4 + 48)).first()[0] or 0
    joined = packed.join(F.broadcast(hits) if bytes_ <= BROADCAST_BYTES else hits, ["t1", "t2"], "left")
    lines = text_lines(F.col("text"))
    stay = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    out = [(left if c == text else F.col("row")[c]).alias(c) for c in docs.columns]
    if counts:
        out += [F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_spread_lines(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


ORACLE = f"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line, source FROM documents WHERE source IS NOT NULL),
spread AS (SELECT line FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
parts AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM texts),
kept AS (
  SELECT p.text, count(*) AS n_lines, count(s.line) AS n_removed,
         coalesce(string_agg(p.line, chr(10) ORDER BY p.nth) FILTER (WHERE s.line IS NULL), '') AS left_over
  FROM parts p LEFT JOIN spread s ON p.line = s.line GROUP BY p.text)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, md5(k.left_over) AS text_md5
FROM documents d LEFT JOIN kept k ON d.text = k.text
"""

"""Benchmark decontamination as a prefix-filtered set join in DataFrame operations alone.

A benchmark item is cut into windows of ten words; an item of fewer words, but not none, is one
window. Seen as a set of one-word shingles, a window is contained in a stretch of a document only if
all its shingles are, so with shingles ordered by rarity its necessary prefix is its rarest word:
that word's frequency is counted over all documents. Document words are joined to the prefix words,
the position bounds leave starts whose window lies in the text, the length bound is the window's own
length, and the exact words of the stretch are compared.

The index of windows is broadcast only while it is at most BROADCAST_BYTES by its counted words;
beyond that the join is by shuffle, and candidates meet the texts once more.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no
windows; equal item texts all count; an item_id that repeats counts once; repeated rows of documents
give repeated rows, and rows of one doc_id are told apart by their texts; a text of any length is read
whole; without documents there are no rows, and without items no hits; ids keep their type; further
columns are not returned by ``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.store import BROADCAST_BYTES, cut, table

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cases A to Z alone and takes the runs of digits, these letters and non-ASCII characters."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS, -1), "")


def item_windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """(window, items): distinct windows with the ids, as strings, of the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def prefix_index(docs_words: DataFrame, windows: DataFrame, broadcast: bool) -> DataFrame:
    """(token, at, window, items): each window under its rarest word, which stands at place ``at``, from 0, in it."""
    vocabulary = windows.select(F.explode("window").alias("token")).distinct()
    spread = docs_words.select(F.explode("w").alias("token")).join(F.broadcast(vocabulary) if broadcast else vocabulary, "token", "left_semi")
    often = spread.groupBy("token").agg(F.count("*").alias("n"))
    often = F.broadcast(often) if broadcast else often  # no more words than the windows have
    ranked = windows.select("window", "items", F.explode(F.array_distinct("window")).alias("token")).join(often, "token", "left")
    rarest = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"), F.first("items").alias("items"))
    return rarest.select("token", (F.array_position("window", F.col("token")) - 1).cast("int").alias("at"), "window", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs."""
    return text_contamination(docs, benchmark, length).drop("t1", "t2")


def text_contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The columns of ``contamination`` after t1 and t2, the text's hashes."""
    windows = cut(item_windows(benchmark, length))
    size = windows.agg(F.sum(F.aggregate("window", F.lit(64).cast("long"), lambda n, w: n + 24 + F.octet_length(w)) + F.size("items") * 24)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    rows = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), words(F.col("text")).alias("w"))
    index = cut(prefix_index(rows, windows, small))
    found = _by_broadcast(rows, index) if small else _by_shuffle(rows, index)
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
    union = F.aggregate("spans", nothing, lambda acc, x: F.struct((acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["e"]), F.lit(0))).alias("n"), F.greatest(acc["e"], x["e"]).alias("e")))
    out = found.select("t1", "t2", "doc_id", F.col("n_words").cast("long").alias("n_words"), union["n"].cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _by_broadcast(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(t1, t2, doc_id, n_words, spans, items) per row: words meet the index where they are, and a row's hits combine before their shuffle."""
    # An empty word after the last one leads each row, with or without hits, through the one join.
    end = index.sparkSession.range(1).select(F.lit("").alias("token"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"))
    each = rows.select("doc_id", "t1", "t2", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "token"))
    start, n = F.col("pos") - F.col("at"), F.size("window")
    joined = each.withColumn("n_words", F.size("w")).join(F.broadcast(index.unionByName(end)), "token")
    inside = (start >= 0) & (start + n <= F.col("n_words"))
    hits = joined.where(F.col("at").isNull() | inside & (F.slice("w", F.greatest(start, F.lit(0)) + 1, n) == F.col("window")))
    of_row = hits.groupBy("doc_id", "t1", "t2").agg(
        F.count_if(F.col("at").isNull()).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct(start.alias("s"), (start + n).alias("e"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return of_row.select("t1", "t2", "doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def _by_shuffle(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The same for an index of any size: bare words meet the index, and their candidates, by text, meet the rows."""
    start = (F.col("pos") - F.col("at")).alias("s")
    each = rows.select("t1", "t2", F.posexplode("w").alias("pos", "token"))
    may = each.join(index, "token").where("pos >= at").groupBy("t1", "t2").agg(F.collect_set(F.struct(start, "window", "items")).alias("may"))
    joined = rows.join(may, ["t1", "t2"], "left")
    there = F.filter("may", lambda x: F.slice("w", x["s"] + 1, F.size(x["window"])) == x["window"])
    hits = joined.select("t1", "t2", "doc_id", F.size("w").alias("n_words"), F.coalesce(there, F.array()).alias("hits"))
    spans = F.transform("hits", lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.size(x["window"])).alias("e")))
    return hits.select("t1", "t2", "doc_id", "n_words", F.array_sort(F.array_distinct(spans)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """docs, with all their columns, without the rows whose text holds a window; rows of one doc_id go each by its own text."""
    bad = cut(text_contamination(docs, benchmark, length).where("contaminated").select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct())
    bad = F.broadcast(bad) if bad.count() * 32 <= BROADCAST_BYTES else bad
    same = (F.xxhash64(docs["text"]) == bad["_t1"]) & (F.xxhash64(F.lit(1), docs["text"]) == bad["_t2"])
    return docs.join(bad, same, "left_anti")


def op2_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Windows by brute force: every stretch of a document of the length of some window, joined by its words.
ORACLE = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k, least(len(w), 10) AS n
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
hit AS (SELECT p.rid, p.i, p.n, win.item FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM pos) p JOIN win ON p.k = win.k AND p.n = win.n),
covered AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""

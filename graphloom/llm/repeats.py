"""Substring dedup by level-wise doubling of repeated word windows.

A window of ``length`` words counts as repeated if its word sequence also starts in a document with
a smaller doc_id; every word under such a window goes. Windows at every position of a corpus are too
many to shuffle, so the search climbs levels:

* whole rows: rows with the word sequence of a row with a smaller doc_id are copies, and one grouped
  minimum finds them;
* level ``base``: of the base-word windows in each length-word window only the one with the least
  hash, its anchor, is looked at. Equal long windows have the same anchor at the same place, so a long
  window can repeat only if its anchor occurs in two documents;
* levels 2 * base, 4 * base and on, while shorter than length: each long window whose part at the
  last level occurs in two documents is looked at by a part of twice that length around the anchor.
  The climb ends early once no candidate survives;
* level ``length``: neighbouring windows that share an anchor form a stretch. Stretches that a smaller
  document holds go as a whole; of the others each window is compared by itself.

Levels below length only filter, by 64-bit hashes. What goes is decided by SHA-256 (rows) and 128 bits
of BLAKE2b (stretches and windows) of the words' own bytes, joined by single spaces.

Defined results: a null or empty text has no words; a null doc_id keeps all its words and is smaller
than none; repeated rows are treated alike, as rows of the same doc_id are not smaller than one
another; ids keep their type and are compared by its order; a text of any length is read whole, in one
task; an empty table gives an empty result; further columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.hashing import SPACED, Words, column_words, runs_hash
from graphloom.llm.store import BROADCAST_BYTES, cut, forget, table

#: Words of the windows of the first level.
BASE = 25


def climb(length: int, base: int) -> list[int]:
    """The lengths of the levels below ``length``: base and its doubles; length itself if base is no shorter."""
    out = [min(base, length)]
    while 2 * out[-1] < length:
        out.append(2 * out[-1])
    return out


def _least_place(values: np.ndarray, k: int) -> np.ndarray:
    """The place of the first least of the k values from each place on, where there are so many, by doubling."""
    place, have = np.arange(len(values)), 1
    while have < k:
        step = min(have, k - have)
        left, right = place[:-step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        have += step
    return place


class Windows:
    """The windows of length words that lie in a row of a block: their first words, rows and anchors' places."""

    def __init__(self, words: Words, length: int, base: int):
        self.words, self.length = words, length
        self.heads = np.flatnonzero(words.first[1:][words.row] - np.arange(len(words.starts)) >= length)
        self.row = words.row[self.heads]
        short = runs_hash(words.hashes, base)
        self.anchor = _least_place(short, length - base + 1)[self.heads] if len(self.heads) else self.heads

    def part(self, n: int) -> np.ndarray:
        """The hash of each window's part at level n: the n words from its anchor on, or its last n words."""
        if not len(self.heads):
            return np.zeros(0, np.uint64)
        return runs_hash(self.words.hashes, n)[np.minimum(self.anchor, self.heads + self.length - n)]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def _distinct_by_row(row: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((*values[::-1], row))
    row, values = row[order], tuple(v[order] for v in values)
    new = np.ones(len(row), bool)
    if len(row):
        new[1:] = (row[1:] != row[:-1]) | np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    return (row[new], *(v[new] for v in values))


def _among(row: np.ndarray, values: Sequence[np.ndarray], lists: Sequence[pa.Array]) -> np.ndarray:
    """Which rows of values stand in the row's own lists; null lists are empty."""
    sizes = lists[0].value_lengths().fill_null(0).to_numpy()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    listed = [np.asarray(x.flatten()) for x in lists]
    r = np.concatenate([rows, row])
    vs = [np.concatenate([a, v.view(np.int64)]) for a, v in zip(listed, values, strict=True)]
    order = np.lexsort((*vs, r))
    new = np.ones(len(r), bool)
    if len(r):
        new[1:] = (r[order][1:] != r[order][:-1]) | np.logical_or.reduce([v[order][1:] != v[order][:-1] for v in vs])
    group = np.cumsum(new) - 1
    has = np.zeros(int(new.sum()), bool)
    has[group[order < len(rows)]] = True
    out = np.empty(len(r), bool)
    out[order] = has[group]
    return out[len(rows) :]


class Spelt:
    """The words of a block joined by single spaces, and digests of runs of them."""

    def __init__(self, words: Words):
        raw, at = words.raw.tobytes(), words.offsets.tolist()
        self.rows = [b" ".join(raw[a:b].split()) for a, b in zip(at, at[1:], strict=False)]
        self.bytes = b" ".join(r for r in self.rows if r)
        sizes = words.ends - words.starts
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes

    def digests(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the digest of words first to last of each run."""
        data, blake = self.bytes, hashlib.blake2b
        found = b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist(), strict=True)])
        both = np.frombuffer(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _profile(length: int, base: int, level: int):
    """(doc_id, row_hash, text) to the row's word count, digest with its first 16 bytes as numbers, and parts of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, words in column_words(batch.column(2), SPACED):
                windows = Windows(words, length, base)
                of, least = _distinct_by_row(windows.row, windows.part(level))
                whole = [hashlib.sha256(r) for r in Spelt(words).rows]
                key = np.frombuffer(b"".join(w.digest()[:16] for w in whole), np.int64).reshape(-1, 2)
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(words.counts, pa.int64()), pa.array([w.hexdigest() for w in whole]), pa.array(key[:, 0]), pa.array(key[:, 1]), _lists(least.view(np.int64), np.bincount(of, minlength=stop - row))],
                    names=["doc_id", "row_hash", "n_words", "sha", "w1", "w2", "parts"],
                )

    return run


def _longer(length: int, base: int, last: int, level: int):
    """(doc_id, row_hash, text, alive parts of level last) to the distinct parts at ``level`` of the windows that are alive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, words in column_words(batch.column(2), SPACED):
                windows, part = Windows(words, length, base), batch.slice(row, stop - row)
                live = _among(windows.row, [windows.part(last)], [part.column(3)])
                of, longer = _distinct_by_row(windows.row[live], windows.part(level)[live])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(longer.view(np.int64), np.bincount(of, minlength=stop - row))], names=["doc_id", "row_hash", "parts"])

    return run


class Stretches:
    """The runs of neighbouring living windows of one anchor, by their first and last window, and their digests."""

    def __init__(self, words: Words, alive: pa.Array, length: int, base: int, last: int):
        windows = Windows(words, length, base)
        live = _among(windows.row, [windows.part(last)], [alive])
        self.heads, self.row, anchor = windows.heads[live], windows.row[live], windows.anchor[live]
        new = np.ones(len(self.heads), bool)
        if len(new):
            new[1:] = (self.heads[1:] != self.heads[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (self.row[1:] != self.row[:-1])
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.append(self.first, len(self.heads)))
        self.spelt, self.length = Spelt(words), length
        self.rows = self.row[self.first]
        self.digests = self.spelt.digests(self.heads[self.first], self.heads[self.first] + self.n + length - 2)

    def dead(self, part: pa.RecordBatch, at: int) -> np.ndarray:
        """Which windows lie in stretches whose digests the row lists in columns at and at + 1."""
        return np.repeat(_among(self.rows, self.digests, [part.column(at), part.column(at + 1)]), self.n)


def _stretches(length: int, base: int, last: int):
    """(doc_id, row_hash, text, alive) to the row's distinct stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, words in column_words(batch.column(2), SPACED):
                part = batch.slice(row, stop - row)
                found = Stretches(words, part.column(3), length, base, last)
                of, a, b = _distinct_by_row(found.rows, *found.digests)
                sizes = np.bincount(of, minlength=stop - row)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(a, sizes), _lists(b, sizes)], names=["doc_id", "a", "b"])

    return run


def _windows(length: int, base: int, last: int):
    """(doc_id, row_hash, text, alive, dead stretches a, b) to the distinct windows outside of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, words in column_words(batch.column(2), SPACED):
                part = batch.slice(row, stop - row)
                found = Stretches(words, part.column(3), length, base, last)
                rest = ~found.dead(part, 4)
                of, a, b = _distinct_by_row(found.row[rest], *found.spelt.digests(found.heads[rest], found.heads[rest] + length - 1))
                sizes = np.bincount(of, minlength=stop - row)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(a, sizes), _lists(b, sizes)], names=["doc_id", "a", "b"])

    return run


def _strike(length: int, base: int, last: int):
    """(doc_id, row_hash, text, alive, dead stretches, dead windows) to the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, words in column_words(batch.column(2), SPACED):
                part = batch.slice(row, stop - row)
                found = Stretches(words, part.column(3), length, base, last)
                dead = found.dead(part, 4)
                rest = np.flatnonzero(~dead)
                dead[rest] = _among(found.row[rest], found.spelt.digests(found.heads[rest], found.heads[rest] + length - 1), [part.column(6), part.column(7)])
                cover = np.zeros(len(words.starts) + 1, np.int64)
                cover[found.heads[dead]] += 1
                cover[found.heads[dead] + length] -= 1
                stays = np.cumsum(cover[:-1]) == 0
                kept = []
                for i in range(stop - row):
                    a, b = words.first[i], words.first[i + 1]
                    own = found.spelt.rows[i].split(b" ") if b > a else []
                    kept.append(b" ".join([own[k] for k in np.flatnonzero(stays[a:b]).tolist()]))
                left = np.bincount(words.row[stays], minlength=stop - row)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words.counts - left, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "row_hash", "gone", "kept"])

    return run


def shared(each: DataFrame, keys: Sequence[str], later: bool) -> DataFrame:
    """Rows of each (doc_id, keys) whose keys occur under two ids or more; with ``later``, save those of the least id.

    A key of two rows is found by its least and its most id, without a second look at the rows. The
    keys of more rows are joined back, as a broadcast only while they are few.
    """
    counted = cut(each.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most"))
    two = counted.where("n = 2")
    out = two.select(F.col("most").alias("doc_id"), *keys)
    if not later:
        out = out.unionByName(two.select(F.col("least").alias("doc_id"), *keys))
    many = counted.where("n > 2").select(*keys, "least")
    many = F.broadcast(many) if many.count() * 16 * (len(keys) + 1) <= BROADCAST_BYTES else many
    rest = each.join(many, list(keys))
    return out.unionByName((rest.where("doc_id > least") if later else rest).select("doc_id", *keys))


def _by_id(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """rows with found's lists by doc_id; a null id finds nothing."""
    return rows.join(found, "doc_id", how)


def struck_rows(docs: DataFrame, length: int = 50, base: int = BASE) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows, and what stays of the rows that lose words.

    The first frame has (doc_id, row_hash, n_words, sha, copy): sha digests all the words, and copy
    says that the whole row repeats a smaller document. The second has (doc_id, row_hash, gone, kept)
    for the other rows that lose words; rows that are in neither way hit keep every word.
    """
    kind = docs.schema["doc_id"].dataType
    shape = lambda *fields: T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.ArrayType(T.LongType()) if t is list else t) for n, t in fields)])
    long, text = T.LongType(), T.StringType()
    below = climb(length, base)
    base = below[0]
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    profiles = cut(rows.mapInArrow(_profile(length, base, base), shape(("row_hash", long), ("n_words", long), ("sha", text), ("w1", long), ("w2", long), ("parts", list))))
    # A written side lets the planner split the join where many rows are copies of one.
    least = cut(profiles.where(F.col("n_words") >= length).groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    least = F.broadcast(least) if least.count() * 32 <= BROADCAST_BYTES else least
    marked = profiles.join(least, ["w1", "w2"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    level = base
    each = marked.where("not copy and doc_id is not null").select("doc_id", F.explode("parts").alias("part"))
    texts = rows.where("doc_id is not null")
    while True:
        # What is alive or dead hangs on doc_id and words alone, so rows of one doc_id may share their lists.
        found = cut(shared(each, ["part"], later=False).groupBy("doc_id").agg(F.collect_set("part").alias("alive")))
        ids = found.select("doc_id")
        # The ids alone go to every task while they are few; else the join deals out the texts.
        near = texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() * 32 <= BROADCAST_BYTES else texts
        before, texts = texts, cut(_by_id(near.select("doc_id", "row_hash", "text").dropDuplicates(["doc_id", "row_hash"]), found).select("doc_id", "row_hash", "text", "alive"))
        forget(before, found)
        if level == below[-1] or texts.isEmpty():
            break
        longer = below[below.index(level) + 1]
        each = cut(texts.mapInArrow(_longer(length, base, level, longer), shape(("row_hash", long), ("parts", list)))).select("doc_id", F.explode("parts").alias("part")).distinct()
        level = longer
    pairs = lambda df: df.select("doc_id", F.explode(F.arrays_zip("a", "b")).alias("h")).select("doc_id", "h.a", "h.b")
    lists = lambda df, a, b: df.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("x")).select("doc_id", F.col("x.a").alias(a), F.col("x.b").alias(b))
    stretches = cut(texts.mapInArrow(_stretches(length, base, level), shape(("a", list), ("b", list))))
    gone = lists(shared(pairs(stretches), ["a", "b"], later=True), "sa", "sb")
    halved = cut(_by_id(texts, gone, "left").select("doc_id", "row_hash", "text", "alive", "sa", "sb"))
    forget(stretches, texts)
    windows = cut(halved.mapInArrow(_windows(length, base, level), shape(("a", list), ("b", list))))
    gone = lists(shared(pairs(windows), ["a", "b"], later=True), "wa", "wb")
    struck = _by_id(halved, gone, "left").where("sa is not null or wa is not null").select("doc_id", "row_hash", "text", "alive", "sa", "sb", "wa", "wb")
    struck = struck.mapInArrow(_strike(length, base, level), shape(("row_hash", long), ("gone", long), ("kept", text)))
    return marked.select("doc_id", "row_hash", "n_words", "sha", "copy"), struck


def drop_repeats(docs: DataFrame, length: int = 50, base: int = BASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): kept has the words that stay, by single spaces, of rows that lost some, and is null where all stay."""
    profiles, struck = struck_rows(docs, length, base)
    out = profiles.join(struck, ["doc_id", "row_hash"], "left")
    kept = F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept"))
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(kept.isNotNull(), F.sha2(kept.cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        kept.alias("kept"),
    )


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Every window by brute force, compared by its words.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w FROM documents),
win AS MATERIALIZED (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
dead AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS place FROM win JOIN first USING (k) WHERE doc_id > least),
every AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS place FROM d),
kept AS (SELECT e.rid, string_agg(x, ' ' ORDER BY e.place) AS words, count(*) AS n FROM every e ANTI JOIN dead USING (rid, place) GROUP BY e.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

"""Near-duplicate classes by weighted Jaccard over word 5-grams: BagMinHash, banding and exact verification.

Sketch. A text is a multiset of shingles. Each shingle owns Poisson points in the plane of time and
weight; the weight axis is cut into dyadic intervals [0,1), [1,2), [2,4), [4,8) ..., each with a
process of its own rate, of which a text whose count of the shingle reaches into the interval takes
the points under that count. A component's value is the earliest time of the points dealt to it, so
two texts agree in a component with the probability of their weighted Jaccard similarity. Points
come in order of time and stop at the latest value of the text's components, so a long text costs no
more points than a short one.

Classes. Equal texts are one node from the start. Nodes of one band bucket are compared by whole
sketches inside tasks, which emit a spanning forest of the pairs that may be alike, never all of
them; the forests' components hold every pair that can reach the threshold. Within a component the
texts' multisets are compared word by word, and the verified links' components are the classes.
``groups`` says how groups beyond a block of rows are searched.

Defined results: a null or empty text is in a class of its own, though equal empty texts share one;
a text of fewer than five words, but not none, is one shingle; a text of any length is read whole, in
one task; a row without doc_id has no class; the texts of a repeated doc_id go each by their own, and
where two classes have the same least id, both are numbered by it, save in ``keep_one_each``, which
tells them apart; ids keep their type; an empty table gives an empty result; further columns are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.groups import Alike, linked
from graphloom.llm.hashing import SPACED, Words, column_words, mix
from graphloom.llm.store import BROADCAST_BYTES, cut, forget, table
from graphloom.operators.fixpoint import weak_components

SHINGLE = 5
#: 42 bands of 6: a pair at similarity 0.8 shares no bucket with a probability of 3e-6.
BANDS, ROWS = 42, 6
SIZE = BANDS * ROWS
#: Pairs whose sketches agree in less than this share are apart: 6 deviations below 0.8.
MAYBE = 0.65
#: Rows and shingles of a block; at most two blocks meet in one task.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 100_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _step(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLD) & (1 << 64) - 1)


def multisets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of each distinct shingle of each row, by row."""
    grams, heads = words.grams(k)
    row = words.row[heads]
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    if len(row):
        new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    first = np.flatnonzero(new)
    return row[first], grams[first], np.diff(np.append(first, len(row)))


def _uniform(state: np.ndarray) -> np.ndarray:
    return ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketch(row: np.ndarray, item: np.ndarray, count: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """(rows, size) earliest times; a row without items keeps infinities."""
    out = np.full((rows, size), np.inf)
    weight = np.bincount(row, count, rows)
    late = np.full(rows, np.inf)
    late[weight > 0] = (np.log(size) + 8) / weight[weight > 0]
    todo = np.ones(rows, bool)
    while True:
        _points(out, row, item, count, late.copy(), todo, size)
        todo = (weight > 0) & np.isinf(out).any(axis=1)
        if not todo.any():
            return out
        late[todo] *= 4
        out[todo] = np.inf


def _points(out: np.ndarray, row: np.ndarray, item: np.ndarray, count: np.ndarray, late: np.ndarray, todo: np.ndarray, size: int) -> None:
    flat = out.reshape(-1)
    low = 0
    at_level = todo[row]
    row, item, count = row[at_level], item[at_level], count[at_level]
    r_all, seed_all, low_all, wide_all, top_all = [], [], [], [], []
    level = 0
    while len(row):
        wide = 1 if level == 0 else low
        r_all.append(row)
        seed_all.append(mix(item + _step(level + 1)))
        low_all.append(np.full(len(row), low))
        wide_all.append(np.full(len(row), wide))
        top_all.append(count)
        low += wide
        level += 1
        more = count > low
        row, item, count = row[more], item[more], count[more]
    if not r_all:
        return
    r, seed, low_, wide_, top = (np.concatenate(x) for x in (r_all, seed_all, low_all, wide_all, top_all))
    time, turn = np.zeros(len(r)), 0
    while len(r):
        turn += 1
        draw = mix(seed + _step(2 * turn))
        time = time - np.log(_uniform(draw)) / (wide_ * float(size))
        keep = time <= late[r]
        r, seed, low_, wide_, top, time = (x[keep] for x in (r, seed, low_, wide_, top, time))
        if not len(r):
            return
        where = mix(seed + _step(2 * turn + 1))
        part = ((where >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        height = low_ + ((where & np.uint64(0xFFFFFFFF)) * wide_.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        under = height < top
        np.minimum.at(flat, r[under] * size + part[under], time[under])
        some = np.unique(r)
        late[some] = np.minimum(late[some], out[some].max(axis=1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, t2, text) to the shingle total, the bands' bucket hashes and one byte for each component."""
    for batch in batches:
        for row, stop, words in column_words(batch.column(3), SPACED, limit=1 << 19):
            part, n = batch.slice(row, stop - row), stop - row
            of, item, count = multisets(words)
            times = sketch(of, item, count, n)
            total = np.bincount(of, count, n).astype(np.int64)
            some = total > 0
            bits = mix(np.where(some[:, None], times, 0).view(np.uint64))
            small = (bits >> np.uint64(56)).astype(np.uint8)
            bands = np.zeros((n, BANDS), np.uint64)
            for i in range(ROWS):
                bands = mix(bands * _GOLD + bits[:, i::ROWS])
            bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD).view(np.int64)
            sizes = np.where(some, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(bands[some].reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(total), lists, pa.array([s.tobytes() for s in small], pa.binary())], names=["doc_id", "t1", "t2", "total", "bands", "sketch"])


def sketches_alike(t: pa.Table) -> Alike:
    """Whether two rows' sketches agree in MAYBE of their components, and their totals by 4/5."""
    total = t.column("total").to_numpy()
    every = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SIZE)
    return lambda i, s, e: ((every[s:e] == every[i]).sum(axis=1) >= MAYBE * SIZE) & (5 * np.minimum(total[i], total[s:e]) >= 4 * np.maximum(total[i], total[s:e]))


def _names(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(-1)


def texts_alike(t: pa.Table) -> Alike:
    """Whether the multisets of two texts' shingles have a Jaccard similarity of at least 4/5, by their words themselves.

    Distinct words get numbers, and shingles numbers by doubling: equal numbers are equal words.
    """
    known: dict[bytes, int] = {}
    word, counts = [], []
    for text in t.column("text").cast(pa.binary()):
        own = (text.as_py() or b"").split()
        word += [known.setdefault(w, len(known) + 1) for w in own]
        counts.append(len(own))
    n, size, counts = len(counts), len(word), np.array(counts, np.int64)
    row = np.repeat(np.arange(n), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(size)
    # past a row's end stands 0, so that a row of fewer words has one shingle and its own end
    padded = np.concatenate([np.array(word, np.int64), np.zeros(SHINGLE, np.int64)])
    at = lambda k: np.where(left > k, padded[k : size + k], 0)
    shingle, wide = at(0), len(known) + 1
    for k in range(1, SHINGLE):
        shingle = _names(shingle * wide + at(k)) if size else shingle
    opens = (left >= SHINGLE) | (np.repeat(counts, counts) < SHINGLE) & (left == np.repeat(counts, counts))
    row, shingle = row[opens], shingle[opens]
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    nth = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    code = _names(shingle * (int(nth.max(initial=0)) + 1) + nth)
    total = np.bincount(row, minlength=n)
    has, heads = row[np.argsort(code, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(code))])
    first = np.concatenate([[0], np.cumsum(total)])

    def alike(i: int, s: int, e: int) -> np.ndarray:
        own = code[first[i] : first[i + 1]]
        sizes = heads[own + 1] - heads[own]
        place = np.repeat(heads[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        both = np.bincount(has[place], minlength=n)[s:e]
        return (both > 0) & (9 * both >= 4 * (total[i] + total[s:e]))

    return alike


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (t1, t2, doc_id, total, class) with the least id of each, and rows (doc_id, t1, t2); ``class`` numbers the classes."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.col("text").cast("string").alias("text"))
    known = rows.where("doc_id is not null")
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("t1", "t2", "total")), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    features = known.mapInArrow(_features, kind)
    nodes = features.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.first("total").alias("total"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    sets = member.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    # Buckets with the same members are one.
    kept = sets.where("members > 1").groupBy("members", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("members") / BLOCK_ROWS).alias("parts"))
    in_bucket = cut(member.join(kept, "bucket").join(nodes.select("node", "total", "sketch"), "node").select("bucket", "node", "parts", "total", "sketch"))
    clusters = cut(weak_components(linked(in_bucket, "bucket", sketches_alike, ("total", "sketch"), BLOCK_ROWS)))
    forget(in_bucket)
    # A written side lets the planner split the join where one cluster is large.
    load = cut(clusters.join(nodes.select("node", "total"), "node").groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("total") / BLOCK_SHINGLES)).alias("parts")))
    placed = cut(clusters.join(load, "component").join(nodes.select("node", "doc_id", "t1", "t2"), "node").select("node", F.col("component").alias("cluster"), "parts", "doc_id", "t1", "t2"))
    # The ids alone go to every task while they are few; else the join deals out the texts.
    few = placed.count() * 48 <= BROADCAST_BYTES
    texts = known.join(F.broadcast(placed) if few else placed, ["doc_id", "t1", "t2"]).dropDuplicates(["node"])
    texts = cut(texts.select("cluster", "node", "parts", "text"))
    found = cut(weak_components(linked(texts, "cluster", texts_alike, ("text",), BLOCK_ROWS, rows=2_000)))
    forget(texts)
    few = found.count() * 16 <= BROADCAST_BYTES
    classed = nodes.select("t1", "t2", "doc_id", "total", "node").join(F.broadcast(found) if few else found, "node", "left")
    return classed.select("t1", "t2", "doc_id", "total", F.coalesce("component", "node").alias("class"), F.col("component").isNotNull().alias("linked")), rows.select("doc_id", "t1", "t2")


def _least(nodes: DataFrame, value: Column) -> DataFrame:
    """nodes with the least value of their class as ``least``; only linked texts have to meet."""
    some = nodes.where("linked").groupBy("class").agg(F.min(value).alias("of_class"))
    return nodes.join(some, "class", "left").withColumn("least", F.coalesce("of_class", value)).drop("of_class")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_shingles) per row; class_id is the least doc_id of the class."""
    nodes, rows = text_classes(docs)
    by_text = _least(nodes, F.col("doc_id")).select("t1", "t2", F.col("least").alias("class_id"), F.col("total").alias("n_shingles"))
    return rows.join(by_text, ["t1", "t2"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "n_shingles")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: that of the least doc_id and, of its texts, the least by their hashes; rows without doc_id stay."""
    nodes, _ = text_classes(docs)
    # a text stands first in its class by its least id, and then by its hashes
    place = F.struct("doc_id", "t1", "t2")
    kept = _least(nodes, place).where(F.col("least") == place).select(F.col("doc_id").alias("id"), "t1", "t2")
    packed = docs.where("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    # a row's id and text stand for it, so repeated rows are one
    left = packed.join(kept, ["id", "t1", "t2"], "left_semi").dropDuplicates(["id", "t1", "t2"])
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns]).union(docs.where("doc_id is null"))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


#: Every pair of texts with a common shingle by brute force, and the components of those at 4/5.
ORACLE = r"""
WITH RECURSIVE nodes AS MATERIALIZED (SELECT row_number() OVER () AS node, text, min(doc_id) AS least FROM documents WHERE doc_id IS NOT NULL GROUP BY text),
split AS (SELECT node, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w FROM nodes),
shingle AS MATERIALIZED (SELECT node, k, count(*) AS n FROM (SELECT node, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)) GROUP BY ALL),
total AS MATERIALIZED (SELECT node, sum(n) AS n FROM shingle GROUP BY node),
pair AS MATERIALIZED (SELECT a.node AS x, b.node AS y, sum(least(a.n, b.n)) AS common FROM shingle a JOIN shingle b ON a.k = b.k AND a.node < b.node GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN total a ON a.node = x JOIN total b ON b.node = y WHERE 9 * common >= 4 * (a.n + b.n)),
links AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
part(node, component) USING KEY (node) AS (SELECT node, node FROM nodes UNION
  SELECT l.y, min(p.component) FROM part p JOIN links l ON l.x = p.node JOIN recurring.part r ON r.node = l.y WHERE p.component < r.component GROUP BY l.y),
class AS (SELECT component, min(least) AS class_id FROM part JOIN nodes USING (node) GROUP BY component)
SELECT d.doc_id, CASE WHEN d.doc_id IS NOT NULL THEN class_id END AS class_id, CASE WHEN nodes.node IS NOT NULL THEN CAST(coalesce(total.n, 0) AS BIGINT) END AS n_shingles
FROM documents d LEFT JOIN nodes ON nodes.text IS NOT DISTINCT FROM d.text LEFT JOIN part USING (node) LEFT JOIN class USING (component) LEFT JOIN total USING (node)
"""

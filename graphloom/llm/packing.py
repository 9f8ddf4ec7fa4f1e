"""Best-fit packing of tokenised documents after a Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity``
counts at any corpus size. The driver solves it on counts: first the reduction fixes every bin of
one or two items that provably dominates all bins with its largest item, then best fit decreasing
packs the rest, moving whole runs of equal bins at once. The plan is a list of runs, "items a to
a+q of length l go to sequences s to s+q at offset o", whose number depends on the lengths alone.
Rows find their run by their rank among the items of their length; ranks come from counts for each
partition and a prefix sum over these, so no task holds a whole length class.

Defined results: a null or empty text is one piece, the end token; a text is cut only if longer than
the capacity; repeated rows are packed each; a null doc_id is kept, and ids keep their type; an empty
table gives no sequences; further columns are not returned. Ties, items of equal length, go to places in
order of doc_id, piece, start and ids within each partition.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.store import cut, table
from graphloom.llm.wordpiece import byte_letters

CAPACITY, END_ID = 1024, 2
#: Characters beyond which a text goes to the tokenizer library; a run of about a million spaces overflows the fast splitter.
LONG = 1 << 18
# Fixed value: the split pattern that the vocabulary was made with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Byte-level BPE ids as little-endian bytes.

    The vocabulary file is the one of the tokenizer library. Where its pieces' ids are in the order of
    its merges they serve as merge ranks, and a rank encoder gives the same ids some five times
    faster. Tests hold the two against each other. The library itself takes texts that spell an added
    token, texts beyond LONG characters, as its splitter has no backtracking limit, and all texts of a
    vocabulary in another order.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        letter = {c: b for b, c in enumerate(byte_letters())}
        file = json.loads(Path(path).read_text())
        pieces, merges = file["model"]["vocab"], file["model"]["merges"]
        made = [pieces["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        self.in_order = all(a < b for a, b in pairwise(made))
        self.added = tuple(t["content"] for t in file.get("added_tokens", ()))
        ranks = {bytes(letter[c] for c in piece): i for piece, i in pieces.items()}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        """Loaded only where a text asks for it, as it takes some 100 MB."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if len(text) > LONG or not self.in_order or any(t in text for t in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each row's ids and the end id, cut where longer than the capacity; the first piece has the remainder."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    )
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, made = [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    view = memoryview(encode(text or "") + end)
                    n = len(view) // 4
                    start, size, k = 0, (n - 1) % capacity + 1, 0
                    while start < n:
                        rows.append(row)
                        made.append((k, start, size, zlib.crc32(view[4 * start : 4 * (start + size)])))
                        start, size, k = start + size, capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), *(pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins fixed by the reduction, as (lengths, how often), and the counts that are left.

    For an item w let x be the largest other item that fits beside it. {w, x} dominates every bin
    with w if whatever else fits beside w fits into the place of x: if x fills the bin, if no two
    items fit beside w, or if only two do and no such pair is larger than x. {w} alone dominates if
    nothing fits.
    """
    left = {k: v for k, v in counts.items() if v}
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for w in sorted(left, reverse=True):
            while left.get(w):
                room = capacity - w
                others = {k: v - (k == w) for k, v in left.items() if k <= room and v - (k == w) > 0}
                if not others:
                    fixed.append(((w,), left[w] if room < w else 1))
                    _take(left, w, fixed[-1][1])
                    changed = True
                    continue
                x = max(others)
                if x != room and not _no_better(others, room, x):
                    break
                times = left[w] // 2 if x == w else min(left[w], left[x])
                fixed.append(((w, x), times))
                _take(left, w, times)
                _take(left, x, times)
                changed = True
    return fixed, left


def _take(left: dict[int, int], key: int, times: int) -> None:
    left[key] -= times
    if not left[key]:
        del left[key]


def _smallest(others: dict[int, int], n: int) -> list[int]:
    out: list[int] = []
    for k in sorted(others):
        out += [k] * min(others[k], n - len(out))
        if len(out) == n:
            break
    return out


def _no_better(others: dict[int, int], room: int, x: int) -> bool:
    """No two or more of the others that fit together exceed x."""
    two = _smallest(others, 2)
    if len(two) < 2 or sum(two) > room:
        return True
    three = _smallest(others, 3)
    if len(three) == 3 and sum(three) <= room:
        return False
    keys = sorted(others)
    low, high = 0, len(keys) - 1
    while low <= high:
        total = keys[low] + keys[high]
        if total > room or low == high and others[keys[low]] < 2:
            high -= 1
        elif total > x:
            return False
        else:
            low += 1
    return True


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, how many, first sequence, offset) and the number of sequences: the reduction, then best fit decreasing."""
    runs: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    used = 0

    def put(length: int, how_many: int, sequence: int, offset: int) -> None:
        runs.append((length, rank[length], how_many, sequence, offset))
        rank[length] += how_many

    fixed, left = reduce_by_dominance(counts, capacity)
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for lengths, times in fixed:
        offset = 0
        for length in lengths:
            put(length, times, used, offset)
            offset += length
        free[capacity - offset].append((used, times))
        used += times
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            fits = [r for r in free if r >= length and free[r]]
            if not fits:
                break
            room = min(fits)
            first, bins = free[room].pop()
            some = min(bins, count)
            put(length, some, first, capacity - room)
            if some < bins:
                free[room].append((first + some, bins - some))
            free[room - length].append((first, some))
            count -= some
        each = capacity // length
        for bins, items in ((count // each, each), (1 if count % each else 0, count % each)):
            if bins:
                for k in range(items):
                    put(length, bins, used, k * length)
                free[capacity - items * length].append((used, bins))
                used += bins
    return runs, used


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to rows with a length of 1 to capacity; rows are told apart by nothing but their place."""
    rows = cut(found.withColumn("_part", F.spark_partition_id()))
    cells = rows.groupBy("_part", "length").count()
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs, _ = best_fit(counts, capacity)
    base = cells.withColumn("_base", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    nth = F.row_number().over(Window.partitionBy("_part", "length").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = rows.withColumn("_nth", nth).join(cut(base), ["_part", "length"]).withColumn("_rank", F.col("_base") + F.col("_nth") - 1).drop("_part", "_base", "_nth")
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    plan = rows.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*(f for f in ranked.schema if f.name != "_rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = plan.value.T
        starts = length << 40 | first
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            k = np.searchsorted(starts, batch.column(batch.schema.get_field_index("length")).to_numpy() << 40 | rank, "right") - 1
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])], names=names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(length, doc_id, piece, start, ids_crc32, sequence_id, offset) per piece of docs."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack(pieces(docs, vocabulary, capacity), capacity)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

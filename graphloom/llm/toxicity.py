"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own hashed embedding plus the mean of its hashed character n-gram embeddings,
so that unseen inflections of a known stem score alike. Two gated recurrent passes read a window of
words, attention weighs their states, and a linear layer gives the window's logit. A text scores as
its worst window; windows overlap by half and cover the whole text. Training is multiple-instance:
a text's label falls to its worst window.

Labels come from a bounded sample, SAMPLE_ROWS rows of each label of at most SAMPLE_CHARS
characters, the least by a hash of doc_id, drawn only from rows whose crc32(doc_id) is not a
multiple of five. Defined results: a null, empty or wordless text scores the sample's share of
toxic rows, or less than 0.5; rows with repeated ids are scored each; a null doc_id is never held
out; a text of any length is scored whole, in one task; an empty table of documents gives an empty
result, and without labels of both kinds all texts score alike, below 0.5; clashing or further columns
are neither read nor returned by ``score_documents`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.hashing import Words, byte_class, column_words, front, lanes, mix
from graphloom.llm.store import table

#: The bound of the sample that the model is fitted on: rows of each label, and characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 4000
WINDOW, STRIDE = 128, 64
EPOCHS, RATE, BATCH = 6, 0.01, 64
#: The hashed tables move this many times as fast.
TABLE_RATE = 3.0
#: A small sample is read over more often, until the weights have moved this many times.
LEAST_TURNS = 150
#: Embedding width, hidden units of a direction, rows of the two hashed tables.
WIDTH, HIDDEN, WORD_ROWS, GRAM_ROWS = 16, 8, 1 << 17, 1 << 17
#: Rows of the tables are learnt if their share of toxic texts is this far from chance; 1 would let one row of all pass by chance.
SURE = 0.4
GRAMS = (3, 4, 5)
#: Distinct words whose n-grams are looked up together, and bytes of text scored together.
VECTOR_ROWS, SCORE_BYTES = 8192, 1 << 19

LETTERS = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Network:
    """Weights; the recurrent ones hold both directions on their first axis."""

    words: np.ndarray
    grams: np.ndarray
    inputs: np.ndarray
    bias: np.ndarray
    recurrent: np.ndarray
    attention: np.ndarray
    output: np.ndarray
    offset: np.ndarray
    share: np.ndarray

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        g = np.random.default_rng(seed)
        f = lambda *shape, by=0.1: (g.standard_normal(shape) * by).astype(np.float32)
        return Network(np.zeros((WORD_ROWS, WIDTH), np.float32), f(GRAM_ROWS, WIDTH, by=0.03), f(2, WIDTH, 3 * HIDDEN, by=0.5), np.zeros((2, 3 * HIDDEN), np.float32), f(2, HIDDEN, 3 * HIDDEN, by=0.3), f(2 * HIDDEN), f(2 * HIDDEN, by=0.5), np.zeros(1, np.float32), np.full(1, 0.1, np.float32))


@dataclass
class Inputs:
    """Distinct words of a block: rows of the two tables; the words of the text by their code."""

    code: np.ndarray
    word_row: np.ndarray
    gram_row: np.ndarray
    gram_first: np.ndarray

    @staticmethod
    def of(words: Words) -> Inputs:
        value, first, code = np.unique(words.hashes, return_index=True, return_inverse=True)
        starts, ends = words.starts[first], words.ends[first]
        sizes = ends - starts + 2
        edges = np.concatenate([[0], np.cumsum(sizes)])
        # each distinct word between two marks
        text = np.empty(edges[-1], np.uint8)
        text[edges[:-1]], text[edges[1:] - 1] = ord("^"), ord("$")
        at = np.arange(edges[-1]) - np.repeat(edges[:-1], sizes)
        inner = (at > 0) & (at < np.repeat(sizes, sizes) - 1)
        text[inner] = words.raw[(np.repeat(starts, sizes) + at - 1)[inner]]
        left = np.repeat(sizes, sizes) - at
        owner = np.repeat(np.arange(len(first)), sizes)
        places, of, eight = [], [], lanes(text)
        for k in GRAMS:
            p = np.flatnonzero((left >= k) | ((at == 0) & (left < k)))
            places.append(mix(front(eight[p], np.minimum(k, left[p])) + np.uint64(k << 60)))
            of.append(owner[p])
        gram, of = np.concatenate(places), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return Inputs(code.reshape(-1), (value % np.uint64(WORD_ROWS)).astype(np.int64), (mix(gram)[order] % np.uint64(GRAM_ROWS)).astype(np.int64), np.searchsorted(of[order], np.arange(len(first) + 1)))

    def vectors(self, net: Network) -> np.ndarray:
        if not len(self.word_row):
            return np.zeros((0, WIDTH), np.float32)
        out = net.words[self.word_row]
        first = self.gram_first
        for at in range(0, len(out), VECTOR_ROWS):
            stop = min(at + VECTOR_ROWS, len(out))
            grams = net.grams[self.gram_row[first[at] : first[stop]]]
            sums = np.add.reduceat(grams, first[at:stop] - first[at], axis=0)
            out[at:stop] += sums / np.diff(first[at : stop + 1])[:, None].astype(np.float32)
        return out


def windows(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of the windows that cover each row of words, the longest windows first."""
    n = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first[row] + nth * STRIDE
    length = np.minimum(WINDOW, first[row] + counts[row] - start)
    order = np.argsort(-length, kind="stable")
    return row[order], start[order], length[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _direction(net: Network, d: int, gates: np.ndarray, index: list[np.ndarray], size: int, keep: list | None) -> np.ndarray:
    """States (steps, size, HIDDEN); index[t] has the word of each live window at step t, in order of the pass."""
    out = np.zeros((len(index), size, HIDDEN), np.float32)
    h = np.zeros((size, HIDDEN), np.float32)
    for t, words in enumerate(index):
        n = len(words)
        g, own = gates[words], h[:n]
        u = own @ net.recurrent[d]
        zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        new = c + z * (own - c)
        if keep is not None:
            keep.append((own.copy(), z, r, c, u[:, 2 * HIDDEN :]))
        h[:n] = new
        out[t, :n] = new
    return out


class Pass:
    """One forward pass over windows, with what the backward pass needs if asked for."""

    def __init__(self, net: Network, inputs: Inputs, start: np.ndarray, length: np.ndarray, learn: bool = False):
        self.net, self.inputs, self.length = net, inputs, length
        self.x = inputs.vectors(net)
        size, steps = len(start), int(length[0]) if len(length) else 0
        self.live = live = np.searchsorted(-length, -np.arange(steps), "left")
        self.index = [[inputs.code[start[:n] + t] for t, n in enumerate(live)], [inputs.code[start[:n] + length[:n] - 1 - t] for t, n in enumerate(live)]]
        self.kept: tuple[list | None, list | None] = ([], []) if learn else (None, None)
        self.states = []
        for d in (0, 1):
            gates = self.x @ net.inputs[d] + net.bias[d]
            self.states.append(_direction(net, d, gates, self.index[d], size, self.kept[d]))
        # step t of the second pass stands at word length - 1 - t
        if steps:
            self.back = np.maximum(length[None, :] - 1 - np.arange(steps)[:, None], 0)
            turned = np.take_along_axis(self.states[1], self.back[:, :, None], axis=0)
            score = self.states[0] @ net.attention[:HIDDEN] + turned @ net.attention[HIDDEN:]
            score[np.arange(steps)[:, None] >= length[None, :]] = -np.inf
            weight = np.exp(score - score.max(axis=0))
            self.weight = weight / weight.sum(axis=0)
            self.turned = turned
            self.pooled = np.concatenate([np.einsum("tb,tbh->bh", self.weight, self.states[0]), np.einsum("tb,tbh->bh", self.weight, turned)], axis=1)
        else:
            self.pooled = np.zeros((size, 2 * HIDDEN), np.float32)
        self.logit = self.pooled @ net.output + net.offset[0]

    def backward(self, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of sum(slope * logit)."""
        net = self.net
        grad = {f.name: np.zeros_like(getattr(net, f.name)) for f in fields(Network) if f.name not in ("words", "grams", "share")}
        grad["offset"][0] = slope.sum()
        grad["output"] = slope @ self.pooled
        by_pool = slope[:, None] * net.output
        both = (self.states[0], self.turned)
        by_weight = sum(np.einsum("tbh,bh->tb", s, by_pool[:, k * HIDDEN : (k + 1) * HIDDEN]) for k, s in enumerate(both))
        by_score = self.weight * (by_weight - (self.weight * by_weight).sum(axis=0))
        by_x = np.zeros_like(self.x)
        for d in (0, 1):
            part = slice(d * HIDDEN, (d + 1) * HIDDEN)
            grad["attention"][part] = np.einsum("tb,tbh->h", by_score, both[d])
            by_state = self.weight[:, :, None] * by_pool[None, :, part] + by_score[:, :, None] * net.attention[part]
            if d:
                by_state = np.take_along_axis(by_state, self.back[:, :, None], axis=0)
            by_gates = np.zeros((len(self.x), 3 * HIDDEN), np.float32)
            carry = np.zeros((len(slope), HIDDEN), np.float32)
            for t in range(len(self.live) - 1, -1, -1):
                n = self.live[t]
                own, z, r, c, uc = self.kept[d][t]
                dh = carry[:n] + by_state[t, :n]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (own - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                through = np.concatenate([dz, dr, dc * r], axis=1)
                grad["recurrent"][d] += own.T @ through
                carry[:n] = dh * z + through @ net.recurrent[d].T
                np.add.at(by_gates, self.index[d][t], np.concatenate([dz, dr, dc], axis=1))
            grad["bias"][d] = by_gates.sum(axis=0)
            grad["inputs"][d] = self.x.T @ by_gates
            by_x += by_gates @ net.inputs[d].T
        self.by_x = by_x
        return grad


def _known_rows(column: pa.Array, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Which rows of the two tables can't have their share of toxic texts by chance.

    By Chernoff's bound, n texts of which a share q is toxic, where a share p of all is, come about by
    chance with at most exp(-n KL(q, p)); that must be less than the number of rows looked at to the power of -SURE.
    """
    seen = {"words": np.zeros((2, WORD_ROWS)), "grams": np.zeros((2, GRAM_ROWS))}
    for row in range(len(column)):
        ((_, _, words),) = lower_words(column.slice(row, 1), 1 << 40)
        if len(words.starts):
            inputs = Inputs.of(words)
            seen["words"][int(labels[row]), np.unique(inputs.word_row)] += 1
            seen["grams"][int(labels[row]), np.unique(inputs.gram_row)] += 1
    p, out = float(labels.mean()), {}
    for name, (clean, toxic) in seen.items():
        n = clean + toxic
        with np.errstate(divide="ignore", invalid="ignore"):
            told = np.where(toxic > 0, toxic * np.log(toxic / n / p), 0) + np.where(clean > 0, clean * np.log(clean / n / (1 - p)), 0)
        out[name] = told > SURE * np.log(np.count_nonzero(n) + 1)
    return out


def lower_words(column: pa.Array, limit: int = SCORE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """The words of a text column in lower case."""
    return column_words(pc.utf8_lower(column), LETTERS, limit=limit)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over mini-batches of texts; each text's loss is that of its worst window, and classes weigh alike."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    labels = labels.astype(np.float32)
    net.share[0] = min(float(labels.mean()), 0.49) if len(labels) else 0.1
    if not len(labels) or labels.min() == labels.max():
        return net
    dense = [f.name for f in fields(Network) if f.name not in ("words", "grams", "share")]
    moments: dict[str, list] = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in dense} | {"words": [0.0], "grams": [0.0]}
    cost = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    column = pa.array(texts, pa.string())
    known = _known_rows(column, labels)
    net.grams[~known["grams"]] = 0
    a_round = -(-len(texts) // BATCH)
    epochs = max(epochs, -(-LEAST_TURNS // a_round))
    turn, turns = 0, epochs * a_round
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            ((_, _, words),) = lower_words(column.take(pa.array(some)), 1 << 40)
            row, start, length = windows(words.counts, words.first[:-1])
            if not len(row):
                continue
            inputs = Inputs.of(words)
            scan = Pass(net, inputs, start, length)
            # the worst window of each text, still the longest first
            best = np.lexsort((scan.logit, row))
            worst = np.sort(best[np.append(row[best][1:] != row[best][:-1], True)])
            learn = Pass(net, inputs, start[worst], length[worst], learn=True)
            y, w = labels[some][row[worst]], cost[some][row[worst]]
            slope = ((_sigmoid(learn.logit) - y) * w / len(worst)).astype(np.float32)
            grad = learn.backward(slope)
            turn += 1
            step = RATE * min(1.0, turn / 20) * (1 - turn / (turns + 1)) ** 0.5
            n_grams = np.diff(inputs.gram_first)
            sparse = {"words": (inputs.word_row, learn.by_x), "grams": (inputs.gram_row, np.repeat(learn.by_x / n_grams[:, None].astype(np.float32), n_grams, axis=0))}
            for name, (rows, g) in sparse.items():
                taught = known[name][rows]
                place, inverse = np.unique(rows[taught], return_inverse=True)
                sums = np.zeros((len(place), WIDTH), np.float32)
                np.add.at(sums, inverse.reshape(-1), g[taught])
                # One scale for a whole table: words of many texts, whose slopes agree, learn faster than chance ones.
                size = moments[name]
                size[0] += 0.05 * (float((sums * sums).mean()) - size[0]) if len(sums) else 0.0
                getattr(net, name)[place] -= TABLE_RATE * step * sums / (size[0] ** 0.5 + 1e-9)
            for name, g in grad.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value = getattr(net, name)
                value -= step * m / (np.sqrt(v) + 1e-6)
    return net


def score_words(net: Network, words: Words) -> np.ndarray:
    """The worst window's probability for each row; the sample's share of toxic rows where there are no words."""
    out = np.full(len(words.counts), -np.inf)
    row, start, length = windows(words.counts, words.first[:-1])
    if len(row):
        np.maximum.at(out, row, Pass(net, Inputs.of(words), start, length).logit.astype(np.float64))
    return np.where(np.isinf(out), float(net.share[0]), 1 / (1 + np.exp(-np.clip(out, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, toxic): the bounded sample; a document with more than one label counts as toxic if any label says so."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    slim = docs.where(F.length("text") <= chars).select("doc_id", F.xxhash64("text").alias("t")).distinct().join(marked, "doc_id")
    order = (F.xxhash64("doc_id"), "doc_id", "t")
    picked = slim.where("toxic = 1").orderBy(*order).limit(rows).unionAll(slim.where("toxic = 0").orderBy(*order).limit(rows))
    # 2 * rows rows of two numbers and a label at most; the texts stay where they are read
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(F.broadcast(picked), ["doc_id", "t"])
    return texts.dropDuplicates(["doc_id", "t"]).orderBy(*order).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> Network:
    found = sample(docs, labels).collect()  # at most 2 * SAMPLE_ROWS rows of SAMPLE_CHARS characters
    net = train([r["text"] for r in found], np.array([r["toxic"] for r in found], np.int64), epochs)
    share = labels.where(F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id"))).agg(F.avg("toxic").alias("share")).first()["share"]
    net.share[0] = min(0.49, share or 0.0)
    if share and share < 1:  # classes weighed alike in training; scores take the labels' own share as prior
        net.offset[0] += np.log(share / (1 - share))
    return net


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size: two tables of 2**17 rows, 16 MB, and small matrices
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for row, stop, words in lower_words(batch.column(2)):
                score = score_words(net, words)
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """docs, with all their columns, without the rows that score 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for row, stop, words in lower_words(batch.column(at)):
                yield batch.slice(row, stop - row).filter(pa.array(score_words(net, words) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))

"""Token counts of greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie: initial pieces hang from one root, continuations from another. Each node
has a failure link, the node that is reached when the longest pieces of its string are popped from
the left, and the count of the pieces so popped. Walking a word takes as many steps as it has
characters plus the links followed, and the sum of the counts is the number of its pieces; the
pieces themselves are never built, and no character is read again.

A word that cannot be split counts as one unknown piece, as in the greedy definition. Defined
results: a null or empty text has no words and no tokens; equal rows are counted each; a null doc_id
is kept, and ids keep their type; a text of any length is read whole, in one task; an empty table gives
an empty result; further columns are not returned.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graphloom.llm.store import table

#: Entries of a worker's cache of counted words; it is emptied when full.
CACHE = 400_000
#: Marks the initial pieces in the byte-level vocabulary.
SPACE_MARK = "Ġ"


class LongestMatch:
    """The automaton over strings; ``initial`` and ``continuing`` are the pieces at and after the start of a word."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        #: goto[node] maps a character to the child; node 0 is the start, node 1 the root of continuations.
        self.goto: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        ends = [set(), set()]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    child = self.goto[node].get(c)
                    if child is None:
                        child = len(self.goto)
                        self.goto[node][c] = child
                        self.goto.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                    node = child
                if piece:
                    ends[root].add(node)
        whole = ends[0] | ends[1]
        queue = deque((child, root, c) for root in (0, 1) for c, child in self.goto[root].items())
        while queue:
            node, parent, c = queue.popleft()
            if node in whole:
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, n = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.goto[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.goto[at][c], n
            queue.extend((child, node, k) for k, child in self.goto[node].items())

    def count(self, word: str) -> int:
        """How many pieces the greedy longest match takes from the word; 1 if it fails, 0 if the word is empty."""
        if not word:
            return 0
        goto, fail, popped = self.goto, self.fail, self.popped
        node = n = 0
        for c in word:
            child = goto[node].get(c)
            while child is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                child = goto[node].get(c)
            node = child
        while node != 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def byte_letters() -> list[str]:
    """The letter for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


def split_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Initial pieces, without their mark, and continuations of a byte-level vocabulary file."""
    pieces = json.loads(Path(path).read_text())["model"]["vocab"]
    return [p[1:] for p in pieces if p[0] == SPACE_MARK and len(p) > 1], [p for p in pieces if p[0] != SPACE_MARK]


_COUNTERS: dict[str, tuple[LongestMatch, dict[str, int], dict[int, str]]] = {}


def _counter(path: str) -> tuple[LongestMatch, dict[str, int], dict[int, str]]:
    if path not in _COUNTERS:
        initial, continuing = split_vocabulary(path)
        singles = set(byte_letters())
        # A word may begin with any single letter, so that every word can be split.
        _COUNTERS[path] = (LongestMatch([*initial, *singles], continuing), {}, dict(enumerate(byte_letters())))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens, n_longest) per row: words stand between white space (0x20, 0x09 to 0x0D); n_longest is the most pieces of one word."""
    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_longest", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known, letters = _counter(vocabulary)
        for batch in batches:
            words_, tokens, longest = [], [], []
            # Words are read as Latin-1, one character a byte, and only new words are spelt in the vocabulary's letters.
            for data in batch.column(1).cast(pa.binary()):
                words = (data.as_py() or b"").split()
                try:
                    counts = [known[w] for w in words]
                except KeyError:
                    if len(known) > CACHE:
                        known.clear()
                    for w in set(words).difference(known):
                        known[w] = machine.count(w.decode("latin-1").translate(letters))
                    counts = [known[w] for w in words]
                words_.append(len(counts))
                tokens.append(sum(counts))
                longest.append(max(counts, default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_, pa.int64()), pa.array(tokens, pa.int64()), pa.array(longest, pa.int64())], names=[key, "n_words", "n_tokens", "n_longest"])

    return docs.select(key, text).mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

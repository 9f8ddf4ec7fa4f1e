"""Chat transcripts: roles of lines by a hidden Markov model and Viterbi, then canonical turns.

A transcript is the lines of a conversation's pieces in order. A state is a role and whether the
line opens a turn or goes on with it. A line emits a speaker-marker class, a length class, whether
it asks, and how it begins, independent given the state. The model is counted by grouped aggregation
over labelled pieces.

Decoding is exact at any length: compact rows (codes of lines, no text) are range-partitioned by
(conversation, place), so a long conversation lies across neighbouring partitions. Each partition
sums up its first and last conversation as a max-plus matrix over states; the driver chains these, at
most two for each partition, and every partition then decodes its lines between known states. No
task ever holds a conversation that is larger than its partition.

Defined results: a null or empty piece has one empty line; repeated pieces of one (conversation,
place) are one piece, and every input row gets its result; pieces that differ at one place follow
each other by hash; a null conv_id is a conversation, a null place stands first; roles other than
user, assistant and system teach nothing; a piece of any length is read whole, and no conversation has
to fit into a task; an empty table gives an empty result; further columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.store import cut, table

ROLES = ("user", "assistant", "system")
STATES = 2 * len(ROLES)  # state r opens a turn of role r, state r + 3 goes on with it

# What speaker markers look like, by the class they stand for.
MARKERS = {
    "user": r"user|human|question|q|prompter|customer|instruction|me",
    "assistant": r"assistant|ai|answer|a|bot|agent|response|model",
    "system": r"system prompt|system|context|note|setup",
}
_LEAD, _TAIL = r"(?i)^\s*(?:#+\s*|<\|?|\[|\*\*)?(?:", r")(?:\|?>|\]|\*\*)?\s*(?::|>|$|(?<=[>\]*:]))\s*"
#: Upper bounds of the length classes of a line, in characters.
LENGTHS = (20, 80, 240)
SIZES = (len(ROLES) + 1, len(LENGTHS) + 1, 2, 3)
CODES = int(np.prod(SIZES))


def marker(role: str) -> str:
    return _LEAD + MARKERS[role] + _TAIL


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_code(line: Column) -> Column:
    """One number for the features of a line."""
    speaker = F.lit(0)
    for k, role in reversed(list(enumerate(ROLES, 1))):
        speaker = F.when(line.rlike(marker(role)), k).otherwise(speaker)
    size = F.lit(len(LENGTHS))
    for k, bound in reversed(list(enumerate(LENGTHS))):
        size = F.when(F.char_length(line) <= bound, k).otherwise(size)
    asks = F.when(line.rlike(r"\?\s*$"), 1).otherwise(0)
    begins = F.when(line.rlike(r"^\s*\p{Lu}"), 0).when(line.rlike(r"^\s*\p{Ll}"), 1).otherwise(2)
    return (((speaker * SIZES[1] + size) * SIZES[2] + asks) * SIZES[3] + begins).cast("int")


@dataclass
class Model:
    """Log probabilities: emission (STATES, CODES), moves (STATES + 1, STATES); the last move row is the start."""

    emission: np.ndarray
    moves: np.ndarray


def fit(pieces: DataFrame) -> Model:
    """Counts (conv_id, place, text, role); each piece is taken as one turn."""
    known = pieces.where(F.col("role").isin(*ROLES)).select("conv_id", "place", "role", F.transform(text_lines(F.col("text")), line_code).alias("codes"))
    lines = known.select("role", F.posexplode("codes").alias("at", "code")).groupBy("role", (F.col("at") > 0).alias("goes_on"), "code").count()
    sizes = known.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.size("codes") > 1).alias("longer"), F.sum(F.size("codes")).alias("lines"))
    opens = known.select("conv_id", "place", "role").distinct()
    after = opens.select("conv_id", F.try_add("place", F.lit(1)).alias("place"), F.col("role").alias("before"))
    pairs = opens.join(after, ["conv_id", "place"], "left").groupBy("before", "role").count()
    index = {r: i for i, r in enumerate(ROLES)}
    counts = np.zeros((STATES, *SIZES))
    for r in lines.collect():  # at most STATES * CODES rows
        counts[index[r["role"]] + len(ROLES) * r["goes_on"]][np.unravel_index(r["code"], SIZES)] += r["count"]
    emission = np.zeros((STATES, *SIZES))
    for axis, size in enumerate(SIZES, 1):
        own = counts.sum(axis=tuple(a for a in range(1, 5) if a != axis)) + 0.5
        emission += np.log(own / own.sum(axis=1, keepdims=True)).reshape(STATES, *[size if a == axis else 1 for a in range(1, 5)])
    follows = np.full((len(ROLES) + 1, len(ROLES)), 0.5)
    for r in pairs.collect():  # at most 12 rows
        follows[index[r["before"]] if r["before"] else len(ROLES), index[r["role"]]] += r["count"]
    follows /= follows.sum(axis=1, keepdims=True)
    moves = np.zeros((STATES + 1, STATES))
    moves[STATES, : len(ROLES)] = follows[len(ROLES)]
    stay = np.full((2, len(ROLES)), 0.5)
    for r in sizes.collect():  # three rows
        k = index[r["role"]]
        on = r["lines"] - r["n"]
        stay[:, k] = (r["longer"] + 1) / (r["n"] + 2), (on - r["longer"] + 1) / (on + 2)
    for k in range(len(ROLES)):
        for goes_on in (0, 1):
            state = k + len(ROLES) * goes_on
            moves[state, : len(ROLES)] = (1 - stay[goes_on, k]) * follows[k]
            moves[state, k + len(ROLES)] = stay[goes_on, k]
    with np.errstate(divide="ignore"):
        return Model(emission.reshape(STATES, CODES), np.maximum(np.log(moves), -1e6))


def span(model: Model, codes: np.ndarray) -> np.ndarray:
    """(STATES + 1, STATES): the best score of the lines from each state before them to each at their end."""
    best = model.moves + model.emission[:, codes[0]]
    for c in codes[1:]:
        best = (best[:, :, None] + model.moves[None, :STATES, :]).max(axis=1) + model.emission[:, c]
    return best


def viterbi(model: Model, codes: np.ndarray, enter: int = STATES, leave: int | None = None) -> np.ndarray:
    """The best states of the lines after state ``enter``, ending in ``leave`` if given."""
    score = model.moves[enter] + model.emission[:, codes[0]]
    back = np.zeros((len(codes), STATES), np.int8)
    inner = model.moves[:STATES]
    for t in range(1, len(codes)):
        step = score[:, None] + inner
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + model.emission[:, codes[t]]
    out = np.zeros(len(codes), np.int8)
    out[-1] = score.argmax() if leave is None else leave
    for t in range(len(codes) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, pa.Table, np.ndarray]]:
    """(number, key, rows, codes) of each conversation of a sorted partition."""
    held: list[pa.RecordBatch] = []
    key, number = None, 0

    def done() -> tuple[int, tuple, pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held)
        return number, key, t, t.column("codes").combine_chunks().flatten().to_numpy()

    for batch in batches:
        if not batch.num_rows:
            continue
        none, conv = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
        bounds = [0, *(np.flatnonzero((none[1:] != none[:-1]) | (conv[1:] != conv[:-1])) + 1).tolist(), batch.num_rows]
        for s, e in zip(bounds, bounds[1:], strict=False):
            own = (bool(none[s]), int(conv[s]))
            if held and own != key:
                yield done()
                held, number = [], number + 1
            key = own
            held.append(batch.slice(s, e - s))
    if held:
        yield done()


def _ends(model: Model):
    """A partition's first and last conversation as (part, last, none, conv, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        part = -1
        for number, key, rows, codes in _runs(batches):
            part = rows.column(0)[0].as_py()
            if number == 0:
                first = (key, codes)
            last = (key, codes, number)
        if first is None:
            return
        found = [(0, first)] + ([(1, last)] if last[2] else [])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(found), pa.int32()), pa.array([k for k, _ in found], pa.int32()), pa.array([x[0][0] for _, x in found]), pa.array([x[0][1] for _, x in found], pa.int64()), pa.array([span(model, x[1]).reshape(-1).tolist() for _, x in found])],
            names=["part", "last", "none", "conv", "matrix"],
        )

    return run


def chain(ends: list[tuple[int, int, tuple, np.ndarray]]) -> dict[tuple[int, int], tuple[int, int | None]]:
    """(part, last) to the states before and at the end of that stretch, by Viterbi over the matrices of each conversation's stretches."""
    out: dict[tuple[int, int], tuple[int, int | None]] = {}
    groups: list[list[tuple[int, int, tuple, np.ndarray]]] = []
    for x in sorted(ends, key=lambda e: (e[0], e[1])):
        if groups and groups[-1][-1][2] == x[2]:
            groups[-1].append(x)
        else:
            groups.append([x])
    for stretches in groups:
        before = np.full(STATES + 1, -np.inf)
        before[STATES] = 0
        seen = []
        for *_, matrix in stretches:
            seen.append(before[:, None] + matrix)
            before = np.append(seen[-1].max(axis=0), -np.inf)
        state = int(before.argmax())
        for (part, last, _, _), scores in zip(reversed(stretches), reversed(seen), strict=True):
            enter = int(scores[:, state].argmax())
            out[part, last] = (enter, state)
            state = enter
    return out


def _decode(model: Model, known: dict[tuple[int, int], tuple[int, int | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None

        def states(x: tuple, last: bool) -> pa.RecordBatch:
            number, _, rows, codes = x
            part = rows.column(0)[0].as_py()
            enter, leave = known[part, 0] if number == 0 else known[part, 1] if last else (STATES, None)
            found = viterbi(model, codes, enter, leave)
            lists = rows.column("codes").combine_chunks()
            values = pa.ListArray.from_arrays(pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py(), pa.int32()), pa.array(found.astype(np.int32)))
            return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in ("none", "conv", "place", "h1", "h2")), values], names=["none", "conv", "place", "h1", "h2", "states"])

        held: list[pa.RecordBatch] = []
        for x in _runs(batches):
            if waiting is not None:
                held.append(states(waiting, False))
            waiting = x
            if len(held) >= 500:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if waiting is not None:
            held.append(states(waiting, True))
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def parse_transcripts(pieces: DataFrame, model: Model) -> DataFrame:
    """(conv_id, place, text, states, rendered) per row of pieces (conv_id, place, text).

    ``states`` has a state for each line; ``rendered`` opens each turn with its role's tag on a line
    of its own and strips the speaker marker, and lines that go on with a turn stay as they are.
    """
    spark = pieces.sparkSession
    placed = pieces.select("conv_id", "place", "text").withColumns(
        {
            "none": F.col("conv_id").isNull(),
            "conv": F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")),
            "seat": F.coalesce(F.col("place").cast("long"), F.lit(-(2**63)).cast("long")),
            "h1": F.xxhash64("text"),
            "h2": F.xxhash64(F.lit(1), "text"),
        }
    )
    keys = ("none", "conv", "seat", "h1", "h2")
    codes = placed.select(*keys, F.transform(text_lines(F.col("text")), line_code).alias("codes")).groupBy(*keys).agg(F.first("codes").alias("codes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = codes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = cut(dealt.select(F.spark_partition_id().alias("part"), "none", "conv", F.col("seat").alias("place"), "h1", "h2", "codes"))
    ends = rows.mapInArrow(_ends(model), "part int, last int, none boolean, conv long, matrix array<double>").collect()  # two rows a partition at most
    known = chain([(r["part"], r["last"], (r["none"], r["conv"]), np.array(r["matrix"]).reshape(STATES + 1, STATES)) for r in ends])
    decoded = rows.mapInArrow(_decode(model, known), "none boolean, conv long, place long, h1 long, h2 long, states array<int>").withColumnRenamed("place", "seat")
    joined = placed.join(decoded, list(keys))
    lines = text_lines(F.col("text"))
    tag = lambda s: F.element_at(F.array(*[F.lit(f"<|{r}|>\n") for r in ROLES]), s + 1)
    bare = lambda x, s: F.when(s == 0, F.regexp_replace(x, marker(ROLES[0]), "")).when(s == 1, F.regexp_replace(x, marker(ROLES[1]), "")).otherwise(F.regexp_replace(x, marker(ROLES[2]), ""))
    drawn = F.zip_with(lines, "states", lambda x, s: F.when(s < len(ROLES), F.concat(tag(F.least(s, F.lit(len(ROLES) - 1))), bare(x, s))).otherwise(x))
    return joined.select("conv_id", "place", "text", "states", F.array_join(drawn, "\n").alias("rendered"))


# How the query's transcripts mark their speakers, one style a conversation.
STYLES = (("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "System prompt: "), ("Q: ", "A: ", "Note: "), ("<|user|>", "<|assistant|>", "<|system|>"), ("### Instruction: ", "### Response: ", "### Context: "))
#: One turn in this many has lost its marker.
UNMARKED = 7


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, text, role): stored turns as they would stand in a transcript, in a style by conversation, some without marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    sign = F.lit("")
    for k, marks in enumerate(STYLES):
        for role, mark in zip(ROLES, marks, strict=True):
            sign = F.when((style == k) & (F.col("role") == role), mark).otherwise(sign)
    lost = F.pmod(F.xxhash64("conv_id", "turn", F.lit(7)), F.lit(UNMARKED)) == 0
    return conversations.select("conv_id", F.col("turn").alias("place"), F.concat(F.when(lost, "").otherwise(sign), F.coalesce("text", F.lit(""))).alias("text"), "role")


def op1_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stored turn: how its lines were read, and the digest of its canonical rendering. The model is counted on four fifths of the conversations."""
    pieces = as_transcripts(table(spark, sf_dir, "conversations"))
    held_out = F.pmod(F.xxhash64(F.lit(5), "conv_id"), F.lit(5)) == 0
    out = parse_transcripts(pieces, fit(pieces.where(~held_out)))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.pmod(F.col("states")[0], F.lit(len(ROLES))) + 1)
    return out.select(
        "conv_id",
        F.col("place").alias("turn"),
        held_out.alias("held_out"),
        F.size("states").cast("long").alias("n_lines"),
        role.alias("first_role"),
        F.size(F.filter("states", lambda s: s < len(ROLES))).cast("long").alias("n_turns"),
        F.array_join(F.col("states").cast("array<string>"), "").alias("states"),
        F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"),
    )

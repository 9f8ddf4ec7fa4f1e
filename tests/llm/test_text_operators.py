import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bagminhash, decontamination, lines, repeats
from graphloom.llm.groups import forest, forest_across, linked, whole_groups
from graphloom.llm.hashing import SPACED, column_words
from tests.llm import cases


def clashing(df):
    """df with further columns whose names the operators use themselves."""
    for name in ("row", "text_", "gone", "t1", "t2", "row_hash", "node", "bucket", "copies", "w", "pos", "token", "site", "keys", "n_words", "class_id", "_kept", "_bad"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def test_words_and_grams():
    texts = ["ab cd ab", "", None, " x ab cd ", "cd", "q" * 10]
    for limit in (1 << 20, 4):
        seen = defaultdict(set)
        grams = Counter()
        for row, stop, words in column_words(pa.array(texts), SPACED, limit=limit):
            assert words.counts.tolist() == [len(cases.spaced(t)) for t in texts[row:stop]]
            for s, e, h in zip(words.starts, words.ends, words.hashes, strict=True):
                seen[words.raw[s:e].tobytes()].add(int(h))
            grams.update(words.grams(2)[0].tolist())
        assert all(len(h) == 1 for h in seen.values()) and len({next(iter(h)) for h in seen.values()}) == len(seen)
        assert sorted(grams.values()) == [1, 1, 1, 1, 2]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("broadcast", [True, False])
def test_repeats_match_brute_force(spark, seed, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(repeats, "BROADCAST_BYTES", -1)
    rows = cases.odd_docs(seed)
    got = repeats.drop_repeats(clashing(cases.docs_frame(spark, rows))).collect()
    want = cases.repeats(rows)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((d, *want[d, t]) for d, t in rows)
    for r in got:
        if r.kept is not None:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_repeats_of_other_lengths(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d y"), (3, "a b c"), (5, "b c d q")]
    got = {r.doc_id: r.n_removed for r in repeats.drop_repeats(cases.docs_frame(spark, rows), length=3).collect()}
    assert got == {d: cases.repeats(rows, 3)[d, t][1] for d, t in rows}


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("small_blocks", [False, True])
def test_classes_match_brute_force(spark, seed, small_blocks, monkeypatch):
    if small_blocks:
        monkeypatch.setattr(bagminhash, "BLOCK_ROWS", 3)
        monkeypatch.setattr(bagminhash, "BLOCK_SHINGLES", 200)
        monkeypatch.setattr(bagminhash, "BROADCAST_BYTES", -1)
    rows = cases.odd_docs(seed)
    base = rows[0][1].split(" ")
    for k in range(8):  # a chain of near copies, each near the next
        base[13 * k] = f"edit{k}"
        rows.append((100 + k, " ".join(base)))
    got = bagminhash.near_duplicate_classes(clashing(cases.docs_frame(spark, rows))).collect()
    want = cases.classes(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert {r.class_id for r in got if r.doc_id is None} == {None}


def test_one_of_each_class_stays_with_all_columns(spark):
    rows = cases.odd_docs(1)
    df = clashing(cases.docs_frame(spark, rows))
    out = bagminhash.keep_one_each(df)
    assert out.columns == df.columns
    want = cases.classes(rows)
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter([d for d in want if want[d] == d]) + Counter({None: 2})


@pytest.mark.parametrize("broadcast", [True, False])
def test_no_text_of_a_repeated_id_is_lost(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(bagminhash, "BROADCAST_BYTES", -1)
    text = {c: cases.prose(i, 60, 5000) for i, c in enumerate("ABCDEFG")}
    near = " ".join([*text["E"].split(" ")[:-1], "other"])
    for a, b in ("AB", "BA"):
        rows = [(5, text[a]), (5, text[b]), (3, text[b]), (3, text[b]), (7, text["C"]), (7, text["D"]), (8, text["E"]), (8, near), (9, text["F"]), (9, text["F"]), (None, text["G"])]
        got = [(r.doc_id, r.text) for r in bagminhash.keep_one_each(clashing(cases.docs_frame(spark, rows))).collect()]
        one = [x for x in got if x in {(8, text["E"]), (8, near)}]
        assert len(one) == 1 and Counter(got) == Counter([(5, text[a]), (3, text[b]), (7, text["C"]), (7, text["D"]), *one, (9, text["F"]), (None, text["G"])])


def test_sketches_agree_as_often_as_multisets_overlap():
    a = {i: 1 + i % 5 for i in range(300)}
    b = {i: 1 + (i * 7) % 4 for i in range(100, 400)}
    exact = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(400)) / sum(max(a.get(i, 0), b.get(i, 0)) for i in range(400))
    rates = []
    for salt in range(12):
        item = lambda d: np.array([hash((salt, i)) & (1 << 63) - 1 for i in d], np.uint64)  # noqa: B023, E731
        row = np.repeat([0, 1], [len(a), len(b)])
        t = bagminhash.sketch(row, np.concatenate([item(a), item(b)]), np.array([*a.values(), *b.values()]), 2)
        assert np.isfinite(t).all()
        rates.append((t[0] == t[1]).mean())
    assert abs(np.mean(rates) - exact) < 4 * (exact * (1 - exact) / (12 * bagminhash.SIZE)) ** 0.5


def test_empty_rows_have_no_sketch_and_weights_count():
    t = bagminhash.sketch(np.array([1, 2]), np.array([9, 9], np.uint64), np.array([1, 1000]), 3)
    assert np.isinf(t[0]).all() and (t[2] <= t[1]).all()


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination_matches_brute_force(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    rows = cases.odd_docs(2)
    passage = rows[11][1].split(" ")
    items = [(1, " ".join(passage[5:40])), (2, " ".join(passage[5:40]).upper()), (2, "w1 W2"), (3, None), (4, " .,! "), (5, "one"), (10, "x x x"), (11, "Déjà"), (None, "zz zz")]
    rows += [(40, "W1-w2, and One. w1 w2 w1 w2"), (41, "DÉJÀ déjà Déjà"), (42, "x " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    got = decontamination.contamination(clashing(cases.docs_frame(spark, rows)), bench).collect()
    want = cases.contamination(rows, [(i, t) for i, t in items if i is not None])
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((d, *want[d, t], want[d, t][1] > 0) for d, t in rows)
    df = clashing(cases.docs_frame(spark, rows))
    left = decontamination.drop_contaminated(df, bench)
    assert left.columns == df.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter((d, t) for d, t in rows if not want[d, t][1])


@pytest.mark.parametrize("broadcast", [True, False])
def test_clean_texts_without_id_of_their_own_stay(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    item = cases.prose(1, 12, 5000)
    rows = [(None, f"a {item} b"), (None, "clean one"), (None, None), (None, "clean one"), (1, "clean two"), (2, f"{item} d"), (2, "clean three"), (3, ""), (0, "clean one")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontamination.drop_contaminated(clashing(cases.docs_frame(spark, rows)), bench)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((d, t) for d, t in rows if item not in (t or ""))


def spread_by_hand(rows, several):
    sites, texts = defaultdict(set), defaultdict(set)
    for _, text, site in rows:
        if text is not None and site is not None:
            for line in text.split("\n"):
                sites[line].add(site)
                texts[line].add(text)
    gone = {line for line in sites if len(sites[line]) >= lines.MIN_SITES and line.strip(" ") and (not several or len(texts[line]) > 1)}
    return {text: None if text is None else "\n".join(x for x in text.split("\n") if x not in gone) for _, text, _ in rows}


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("several", [False, True])
def test_spread_lines_match_exact_counts(spark, broadcast, several, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    rows = [(i, f"own {i}\nmenu\n\n{'nine' if i < 9 else 'ten'}\nfoot", f"s{i}") for i in range(20)]
    rows += [(100 + i, "copied to many sites\nreally", f"s{i}") for i in range(20)]
    rows += [(200, None, "s1"), (201, "", "s2"), (202, "menu", None), (203, "menu\nfoot", "s3"), (203, "menu\nfoot", "s3"), (None, "own x\nfoot", "s4"), (204, " \n \nmenu ", "s5")]
    df = clashing(cases.docs_frame(spark, rows))
    out = lines.drop_spread_lines(df, counts=True, several_texts=several)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    want = spread_by_hand(rows, several)
    assert want["copied to many sites\nreally"] == ("copied to many sites\nreally" if several else "") and want["menu"] == ""
    names = out.columns
    got = Counter((r[names.index("doc_id")], r[names.index("text")]) for r in out.collect())
    assert got == Counter((d, want[t]) for d, t, _ in rows)


def test_estimates_do_not_decide_near_the_threshold(spark):
    rows = [(1000 * k + i, f"line {k}\nown {k} {i}", f"s{i}") for k in range(5, 16) for i in range(k)]
    gone = {r.doc_id // 1000 for r in lines.drop_spread_lines(cases.docs_frame(spark, rows)).collect() if not r.text.startswith("line")}
    assert gone == set(range(10, 16))


@pytest.mark.parametrize("broadcast", [True, False])
def test_all_sites_of_copied_texts_count(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    rows = [(10 * i + k, f"own {i}\nfooter\n{'ten' if i < 9 else 'more'}", site) for i in range(12) for k, site in enumerate([f"s{i}", "a mirror"])]
    rows += [(500 + i, "one text\non many sites", f"s{i}") for i in range(12)]
    rows += [(600 + i, f"{'first' if i < 2 else 'second'}\ntwo texts", f"s{i}") for i in range(12)]
    sites, texts = defaultdict(set), defaultdict(set)
    for _, text, site in rows:
        for line in text.split("\n"):
            sites[line].add(site)
            texts[line].add(text)
    gone = {x for x in sites if len(sites[x]) >= lines.MIN_SITES and len(texts[x]) > 1}
    assert gone == {"footer", "ten", "two texts"}
    got = {r.doc_id: r.text for r in lines.drop_spread_lines(cases.docs_frame(spark, rows), several_texts=True).collect()}
    assert got == {d: "\n".join(x for x in t.split("\n") if x not in gone) for d, t, _ in rows}


def test_empty_tables(spark):
    none = cases.docs_frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert repeats.drop_repeats(none).isEmpty()
    assert bagminhash.near_duplicate_classes(none).isEmpty() and bagminhash.keep_one_each(none).isEmpty()
    assert decontamination.contamination(none, bench).isEmpty()
    some = cases.docs_frame(spark, [(1, "a b"), (2, None)])
    assert {r.n_hit for r in decontamination.contamination(some, bench).collect()} == {0}
    assert lines.drop_spread_lines(none).isEmpty()


@pytest.mark.parametrize("k", [1, 2, 7])
def test_forests_span_all_pairs(k):
    rng = np.random.default_rng(k)
    for _ in range(60):
        n = int(rng.integers(1, 30))
        close = rng.random((n, n)) < k / n
        close |= close.T | np.eye(n, dtype=bool)
        want = cases.components(n, [(i, j) for i in range(n) for j in range(n) if close[i, j]])
        assert cases.components(n, forest(n, lambda i: close[i])) == want  # noqa: B023
        labels, rest = rng.integers(0, 3, n), rng.random(n) < 0.5
        asked = [(i, j) for i in range(n) for j in range(n) if labels[i] == labels[j] or close[i, j] and (rest[i] or rest[j])]
        same = [(i, j) for i in range(n) for j in range(n) if labels[i] == labels[j]]
        assert cases.components(n, same + forest_across(labels, rest, lambda i: close[i])) == cases.components(n, asked)  # noqa: B023


def test_a_clique_costs_a_comparison_a_row():
    calls = []
    assert len(forest(5000, lambda i: calls.append(i) or np.ones(5000, bool))) == 4999 and len(calls) == 1
    calls.clear()
    near = lambda i: calls.append(i) or (np.arange(5000) % 10 == 0) == (i % 10 == 0)
    assert len(forest(5000, near)) == 4998 and len(calls) <= 502


@pytest.mark.parametrize("parts,block", [(4, 16), (20, 2)])
def test_blocks_lose_no_link(spark, parts, block):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for key in range(3):
        at = np.cumsum(rng.integers(1, 4, 60)) + 1000 * key
        rows += [(key, int(a), parts, int(a)) for a in at]
        want += [(int(a), int(b)) for a in at for b in at if 0 < b - a <= 2]

    def kernel(t):
        place = t.column("place").to_numpy()
        return lambda i, s, e: np.abs(place[s:e] - place[i]) <= 2

    members = spark.createDataFrame(rows, "key long, node long, parts long, place long").checkpoint()
    got = [(r.source, r.target) for r in linked(members, "key", kernel, ("place",), block).collect()]
    nodes = {n: k for k, (_, n, *_) in enumerate(rows)}
    assert cases.components(len(rows), [(nodes[a], nodes[b]) for a, b in got]) == cases.components(len(rows), [(nodes[a], nodes[b]) for a, b in want])


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_sequences_that_cancel_in_polynomials_stay_apart(spark):
    bits = thue_morse(1024)
    word = {k: "".join("ab"[b ^ k] for b in bits) for k in (0, 1)}
    line = {k: " ".join(("left", "right")[b ^ k] for b in bits) for k in (0, 1)}
    shared = cases.prose(3, 49, 5000)
    rows = [(1, f"{shared} {word[0]}"), (2, f"{shared} {word[1]}"), (3, line[0]), (4, line[1]), (5, word[0]), (6, word[1])]
    got = {r.doc_id: r.n_removed for r in repeats.drop_repeats(cases.docs_frame(spark, rows)).collect()}
    assert got == {d: cases.repeats(rows)[d, t][1] for d, t in rows} and got[2] == got[6] == 0
    found = {r.doc_id: r.class_id for r in bagminhash.near_duplicate_classes(cases.docs_frame(spark, rows)).collect()}
    assert found == cases.classes(rows) and found[6] == 6
    for texts in (list(word.values()), list(line.values())):
        h = [int(w.grams(1024 if " " in texts[0] else 1)[0][0]) for _, _, w in column_words(pa.array(texts), SPACED, limit=1)]
        assert len(set(h)) == 2


@pytest.mark.parametrize("length,base", [(3, 1), (3, 25), (50, 7), (50, 25), (400, 25), (400, 400), (1, 1)])
def test_levels_climb_to_any_length(spark, length, base):
    below = repeats.climb(length, base)
    assert all(b == 2 * a for a, b in zip(below, below[1:], strict=False)) and below[-1] <= length <= 2 * below[-1]
    shared = cases.prose(9, 450, 9000)
    rows = [(1, f"a {shared} b"), (2, f"c d {shared}"), (3, " ".join(shared.split(" ")[20:430])), (4, " ".join(shared.split(" ")[:60])), (5, "x " * 500), (6, "x " * 450 + "y"), (7, cases.prose(10, 500, 4))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.drop_repeats(cases.docs_frame(spark, rows), length, base).collect()}
    want = cases.repeats(rows, length)
    assert got == {d: want[d, t] for d, t in rows}


def test_ids_keep_their_type(spark):
    rows = [(1, cases.prose(1, 80, 5000)), (2, cases.prose(1, 80, 5000)), (3, "x y")]
    df = cases.docs_frame(spark, rows).withColumn("doc_id", F.concat(F.lit("doc "), "doc_id"))
    assert {r.doc_id: r.n_removed for r in repeats.drop_repeats(df).collect()} == {"doc 1": 0, "doc 2": 80, "doc 3": 0}
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicate_classes(df).collect()} == {"doc 1": "doc 1", "doc 2": "doc 1", "doc 3": "doc 3"}
    assert sorted(r.doc_id for r in bagminhash.keep_one_each(df).collect()) == ["doc 1", "doc 3"]


def test_groups_come_whole_over_batches():
    keys = [1, 1, 2, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i])], names=["k", "v"]) for i, k in enumerate(keys)]
    got = []
    for t, bounds in whole_groups(iter(batches), 1, rows=2):
        got += [t.column(0).to_pylist()[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [[1, 1], [2], [3, 3, 3], [4]]

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, language, media_query, packing, tiff, toxicity, wordpiece
from tests.llm import cases

tokens = pytest.importorskip("public_tokenizers")
BPE = tokens.path("byte_bpe_50k.json")


# TIFF


@pytest.mark.parametrize("variant", tiff.VARIANTS)
@pytest.mark.parametrize("order", "<>")
def test_tiff_round_trip(variant, order):
    rng = random.Random(1)
    samples = [rng.randbytes(64), b"\0" * 640, bytes(rng.choices(b"abc  ", k=64 * 1100)), (b"the and " * 9000)[: 64 * 1025], rng.randbytes(64 * 300)]
    for payload in samples:
        pages = list(tiff.read_pages(tiff.write_pages(payload, *variant, order=order)))
        assert b"".join(p.samples for p in pages) == payload
        assert [p.page for p in pages] == list(range(len(pages))) and len(pages) == -(-len(payload) // 65536)


def planar_tiff(planes, width, height, rows_per_strip, predictor):
    """A file by hand, of one directory: deflate strips, plane after plane, or chunky if planes is one array of three samples a pixel."""
    per = 3
    separate = planes.shape[0] == per
    images = planes if separate else [planes[0]]
    strips = []
    for image in images:
        for y in range(0, height, rows_per_strip):
            part = image[y : y + rows_per_strip].astype(np.uint8)
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(np.uint8)
            strips.append(zlib.compress(part.tobytes()))
    n, body, places = len(strips), b"", []
    for strip in strips:
        places.append(8 + len(body))
        body += strip
    at = 8 + len(body)
    lists = struct.pack(f"<{n}I", *places) + struct.pack(f"<{n}I", *map(len, strips)) + struct.pack("<3H", 8, 8, 8)
    entries = [(256, 3, 1, width), (257, 3, 1, height), (258, 3, 3, at + 8 * n), (259, 3, 1, 8), (262, 3, 1, 2), (273, 4, n, at if n > 1 else places[0]), (277, 3, 1, per), (278, 3, 1, rows_per_strip), (279, 4, n, at + 4 * n if n > 1 else len(strips[0])), (284, 3, 1, 2 if separate else 1), (317, 3, 1, predictor)]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", at + len(lists)) + body + lists + directory


@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("rows", [2, 7])
def test_tiff_of_several_samples(predictor, rows):
    image = np.random.default_rng(3).integers(0, 256, (7, 5, 3))
    for planes in (image.transpose(2, 0, 1), image[None]):
        (page,) = tiff.read_pages(planar_tiff(planes, 5, 7, rows, predictor))
        assert page.samples == image.astype(np.uint8).tobytes() and (page.samples_per_pixel, page.width, page.height) == (3, 5, 7)


def feature_by_hand(text):
    """The feature's numbers from the padded bytes alone."""
    data = (text or "").encode()
    data += b"\0" * (64 - len(data) % 64)
    if text and len(text.encode()) % 64 == 0:
        data = text.encode()
    rows = [data[i : i + 64] for i in range(0, len(data), 64)]
    edges = sum(a != b for r in rows for a, b in zip(r, r[1:], strict=False))
    bins = Counter(b // 16 for b in data)
    return f"pages={-(-len(data) // 65536)};mean={sum(data) / len(data):.4f};edges={edges};bins={'.'.join(str(1000 * bins[k] // len(data)) for k in range(16))}"


def test_features_by_hand(spark):
    rows = cases.odd_docs(8) + [(90, "z" * 64), (91, "é" * 40_000), (92, "ab" * 32768)]
    df = cases.docs_frame(spark, rows).withColumn("doc_id", F.concat(F.lit("doc "), "doc_id"))
    got = Counter((r.doc_id, r.feature.split(";", 1)[1]) for r in media_query.media_digests(df).collect())
    assert got == Counter((d if d is None else f"doc {d}", feature_by_hand(t)) for d, t in rows)


def test_tiff_packbits_and_lzw_codes():
    # the worked example of the format's own text
    packed = bytes.fromhex("feaa0280002afdaa0380002a22f7aa")
    plain = bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")
    assert tiff.packbits_decode(packed, len(plain)) == plain
    for data in (b"", b"a", b"aaaa", bytes(range(256)) * 40, b"ab" * 5000):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


def test_tiff_faults_are_rows(spark):
    good = tiff.write_pages(b"a" * 64 * 2000, tiff.LZW)
    loop = bytearray(tiff.write_pages(b"b" * 64, tiff.NONE))
    loop[-4:] = loop[4:8]
    files = [(1, good), (2, None), (3, b""), (4, b"not a tiff"), (5, good[: len(good) // 2]), (6, bytes(loop)), (7, b"II*\0\xff\xff\xff\x7f"), (1, good)]
    df = spark.createDataFrame(files, "id long, media binary").withColumn("clash", F.lit(1))
    got = tiff.tiff_pages(df, "media", ("id", "clash")).collect()
    pages = Counter((r.id, r.page) for r in got)
    assert pages[1, 0] == pages[1, 1] == 2 and pages[6, 0] == 1
    errors = {r.id for r in got if r.error}
    assert errors == {2, 3, 4, 5, 6, 7} and all(r.page is None for r in got if r.error)
    with pytest.raises(ValueError):
        tiff.tiff_pages(df.withColumnRenamed("clash", "width"), "media", ("width",))
    assert tiff.tiff_pages(df.where("false"), "media", ("id",)).isEmpty()


def test_tiff_random_bytes_never_crash():
    rng = random.Random(3)
    good = tiff.write_pages(bytes(rng.choices(b"abcd", k=6400)), tiff.LZW, 2, True)
    for _ in range(300):
        data = bytearray(good)
        for _ in range(4):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            list(tiff.read_pages(bytes(data)))
        except tiff.TiffError:
            pass


def test_media_digests(spark):
    rows = cases.odd_docs(3) + [(90, "z" * 64), (91, "é" * 40_000)]
    got = media_query.media_digests(cases.docs_frame(spark, rows).withColumn("media", F.lit(1))).collect()
    want = Counter()
    for d, t in rows:
        data = (t or "").encode()
        full = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        want[d, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    stored = tiff.store_text("z" * 64)
    assert {(r.media_bytes, r.media_sha256) for r in got if r.doc_id == 90} == {(len(stored), hashlib.sha256(stored).hexdigest())}


# Packing


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    own = packing.encoder(BPE)
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "\x85", "\x1c", "'s", "1", "½", ".", "!!", "<|endoftext|>", "Ġ", "_", " word"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["w " * 700_000]
    for t in texts:
        assert np.frombuffer(own(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_a_vocabulary_in_another_order_goes_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    file = json.loads(open(BPE).read())
    merges = file["model"]["merges"][:2000]
    file["model"]["merges"] = merges[:10][::-1] + merges[10:]
    (tmp_path / "other.json").write_text(json.dumps(file))
    own, library = packing.encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not own.in_order and packing.encoder(BPE).in_order
    text = "the other thing in this order"
    assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_runs_of_white_space_equal_the_library():
    own = packing.encoder(BPE)
    for text in (f"a{' ' * 1_020_000}b", " " * 1_048_576, "\n" * packing.LONG, f"x <|endoftext|>{' ' * (packing.LONG + 1)}"):
        assert np.frombuffer(own(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    rows = cases.odd_docs(4) + [(90, "w " * 5000)]
    got = packing.pack_documents(cases.docs_frame(spark, rows).withColumn("length", F.lit("mine"))).collect()
    own = packing.encoder(BPE)
    want = Counter()
    for d, t in rows:
        ids = own(t or "") + np.array([2], "<u4").tobytes()
        n, start, size, k = len(ids) // 4, 0, (len(ids) // 4 - 1) % 1024 + 1, 0
        while start < n:
            want[d, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])] += 1
            start, size, k = start + size, 1024, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(cases.docs_frame(spark, [])).isEmpty()


def fewest(items, capacity):
    """The least number of bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            rest = list(bins)
            rest.remove(room)
            place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_never_costs_a_bin():
    rng = random.Random(7)
    for _ in range(150):
        capacity = rng.randint(6, 14)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        fixed, left = packing.reduce_by_dominance(Counter(items), capacity)
        used = Counter()
        for lengths, times in fixed:
            assert sum(lengths) <= capacity
            for x in lengths:
                used[x] += times
        assert used + Counter(left) == Counter(items)
        assert sum(t for _, t in fixed) + fewest(list(Counter(left).elements()), capacity) == fewest(items, capacity)


def test_best_fit_plans_are_sound_and_small():
    rng = random.Random(9)
    for _ in range(40):
        capacity = rng.choice([20, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 400)))
        runs, used = packing.best_fit(counts, capacity)
        placed, bins = Counter(), {}
        for length, first, n, sequence, offset in runs:
            assert first == placed[length]
            placed[length] += n
            for s in range(sequence, sequence + n):
                bins.setdefault(s, []).append((offset, length))
        assert placed == counts and sorted(bins) == list(range(used))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(k * v for k, v in counts.items())
        assert used <= 1.15 * total / capacity + 2
    few, _ = packing.best_fit({512: 10**12, 300: 10**12}, 1024)
    assert len(few) < 20


# Token counts


def greedy(word, initial, continuing):
    n = i = 0
    while i < len(word):
        pieces = continuing if i else initial
        end = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if end is None:
            return 1
        i, n = end, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(3)
    draw = lambda k: {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(k)}
    for _ in range(200):
        initial, continuing = draw(8), draw(8)
        machine = wordpiece.LongestMatch(initial, continuing)
        for _ in range(100):
            word = "".join(rng.choices("abc", k=rng.randint(0, 12)))
            assert machine.count(word) == greedy(word, initial, continuing)


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(wordpiece, "CACHE", 50)
    rows = cases.odd_docs(5)
    got = wordpiece.count_tokens(cases.docs_frame(spark, rows).withColumn("n_words", F.lit(1)), BPE).collect()
    initial, continuing = map(set, wordpiece.split_vocabulary(BPE))
    letters = wordpiece.byte_letters()
    initial |= set(letters)
    want = Counter()
    for d, t in rows:
        counts = [greedy("".join(letters[b] for b in w), initial, continuing) for w in (t or "").encode().split()]
        want[d, len(counts), sum(counts), max(counts, default=0)] += 1
    assert Counter(map(tuple, got)) == want
    assert wordpiece.count_tokens(cases.docs_frame(spark, []), BPE).isEmpty()


# Toxicity


def labelled(n, seed=0):
    """English insults and, in another language, an inflected stem, in random prose."""
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [f"{rng.choice(['th', 'er', 'on', 'an'])}{rng.choice(['ing', 'ed', 'tion'])}{rng.choice(['', 'a', 'or'])}" for _ in range(rng.randint(5, 200))]
        bad = rng.random() < 0.3
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["scumbag", "zorvek" + rng.choice(["u", "ei", "schaft", "ia", "ol", "min", "tar"])])
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def net():
    return toxicity.train(*labelled(600), epochs=8)


def scores(net, texts):
    return np.concatenate([toxicity.score_words(net, w) for _, _, w in column_words_of(texts)])


def column_words_of(texts):
    return toxicity.lower_words(pa.array(texts, pa.string()))


def test_toxicity_held_out_accuracy(net):
    texts, labels = labelled(400, seed=1)
    got = scores(net, texts)
    assert ((got >= 0.5) == labels).mean() > 0.97
    assert scores(net, ["thing " * 3000 + "ZorVekxyz " + "thing " * 3000])[0] > 0.5 > scores(net, ["thing " * 6000])[0]


def test_toxicity_gradients():
    net = toxicity.Network.fresh(1)
    net.words, net.grams = net.words.astype(np.float64), net.grams.astype(np.float64)
    for name in ("inputs", "bias", "recurrent", "attention", "output", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    ((_, _, words),) = column_words_of(["one two three two", "four one", "five"])
    _, start, length = toxicity.windows(words.counts, words.first[:-1])
    inputs = toxicity.Inputs.of(words)
    slope = np.array([0.3, -0.7, 1.1])
    grad = toxicity.Pass(net, inputs, start, length, learn=True).backward(slope)
    value = lambda: float(slope @ toxicity.Pass(net, inputs, start, length).logit)
    rng = np.random.default_rng(2)
    for name, g in grad.items():
        weights = getattr(net, name)
        for _ in range(4):
            k = tuple(rng.integers(s) for s in weights.shape)
            old = weights[k]
            weights[k] = old + 1e-3
            up = value()
            weights[k] = old - 1e-3
            down = value()
            weights[k] = old
            assert g[k] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def plain_logit(net, words, vector):
    """One window, word by word, with nothing shared between windows."""
    h, sigmoid = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    states = []
    for d, order in enumerate((words, words[::-1])):
        state, own = np.zeros(h), []
        for w in order:
            g, u = vector[w] @ net.inputs[d] + net.bias[d], state @ net.recurrent[d]
            z, r = sigmoid(g[:h] + u[:h]), sigmoid(g[h : 2 * h] + u[h : 2 * h])
            new = np.tanh(g[2 * h :] + r * u[2 * h :])
            state = z * state + (1 - z) * new
            own.append(state)
        states.append(own if d == 0 else own[::-1])
    both = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1)
    weight = np.exp(both @ net.attention)
    return float((weight / weight.sum()) @ both @ net.output + net.offset[0])


def test_scores_equal_a_plain_pass_over_each_window(net):
    rng = random.Random(4)
    vocabulary = ["thing", "scumbag", "ering", "zorvekia", "onted", "Ährentor", "7"]
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 5, 127, 128, 129, 400)]
    got = scores(net, texts)
    for text, score in zip(texts, got, strict=True):
        words = text.lower().split(" ")
        vector = {}
        for w in set(words):
            ((_, _, one),) = column_words_of([w])
            inputs, name = toxicity.Inputs.of(one), f"^{w}$".encode()
            grams = {k: [name[i : i + k] for i in range(max(1, len(name) - k + 1))] for k in toxicity.GRAMS}
            assert len(inputs.gram_row) == sum(map(len, grams.values()))
            vector[w] = net.words[inputs.word_row[0]] + net.grams[inputs.gram_row].mean(axis=0)
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        worst = max(plain_logit(net, words[s : s + toxicity.WINDOW], vector) for s in starts)
        assert score == pytest.approx(1 / (1 + np.exp(-worst)), abs=1e-3)


def test_chance_words_teach_nothing():
    texts = [f"w{i} common {'bad' if i % 4 == 0 else 'fine'} {'rare' if i == 4 else ''}" for i in range(200)]
    known = toxicity._known_rows(pa.array(texts), np.array([int(i % 4 == 0) for i in range(200)]))
    row = lambda w: toxicity.Inputs.of(next(column_words_of([w]))[2]).word_row[0]
    assert known["words"][row("bad")] and known["words"][row("fine")]
    assert not known["words"][row("rare")] and not known["words"][row("common")] and not known["words"][row("w8")]


@pytest.mark.parametrize("sf,recall,precision", [("sf0.01", 0.6, 0.5), ("sf0.1", 0.85, 0.9)])
def test_held_out_labels_of_the_tables(spark, sf, recall, precision):
    """Some held-out rows are labelled toxic without any toxic word: 6 of the 97 of sf0.1."""
    from pathlib import Path

    at = Path("/root/testdata") / sf
    if not at.exists():
        pytest.skip("the driver's tables are not here")
    got = toxicity.op3_toxicity(spark, str(at)).where("held_out")
    truth = spark.read.parquet(f"{at}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {(r.toxic, r.predicted): r["count"] for r in got.join(truth, "doc_id").groupBy("toxic", "predicted").count().collect()}
    caught = n.get((1, 1), 0)
    assert caught >= recall * (caught + n.get((1, 0), 0)) and caught >= precision * (caught + n.get((0, 1), 0))


def test_windows_cover_everything():
    counts = np.array([0, 1, 127, 128, 129, 192, 193, 1000])
    first = np.cumsum(counts) - counts
    row, start, length = toxicity.windows(counts, first)
    for r, n in enumerate(counts):
        own = sorted((s - first[r], s - first[r] + k) for s, k in zip(start[row == r], length[row == r], strict=True))
        seen = set()
        for a, b in own:
            seen |= set(range(a, b))
        assert seen == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in own)
    assert (np.diff(length) <= 0).all()


def test_toxicity_frames(spark, net):
    rows = cases.odd_docs(6)
    df = cases.docs_frame(spark, rows).withColumns({"score": F.lit("mine"), "label": F.lit(3)})
    got = toxicity.score_documents(df, net).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = toxicity.drop_toxic(df, net)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.score_documents(df.where("false"), net).isEmpty()


def test_toxicity_sample_is_bounded_and_leaves_the_held_out(spark):
    texts, labels = labelled(200, seed=2)
    docs = cases.docs_frame(spark, [*enumerate(texts), (500, "x" * 5000), (501, None)])
    marks = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(labels)] + [(500, 1, 1), (501, 1, 1), (None, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.sample(docs, marks, rows=20).collect()
    assert Counter(r.toxic for r in got) == {0: 20, 1: 20}
    assert not {r.text for r in got} & {t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 == 0}
    untaught = toxicity.fit(docs, marks.where("false"))
    assert {r.predicted for r in toxicity.score_documents(docs, untaught).collect()} <= {0, 1}


# Language


PAGES = "page_id long, url string, html string"


def language_tables(spark):
    rng = random.Random(4)
    stems = {"xx": ["kor", "mak", "tol"], "yy": ["liri", "siné", "vino"]}
    prose = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(["a", "u", "en"]) for _ in range(n))
    docs = [(i, prose(lang := "xx" if i % 2 else "yy", 40), lang, "s", 1) for i in range(60)] + [(99, None, "xx", "s", 1), (98, "?", None, "s", 1)]
    pages, truth = [], {}
    for i in range(200):
        lang = "xx" if i % 3 else "yy"
        truth[i] = lang
        pages.append((i, f"https://{'a' if lang == 'xx' else 'b'}.site{i % 2}.{'com' if lang == 'xx' else 'org'}:80/{i}", f'<html lang="{lang}-QQ"><script>liri sinu vinen</script><p>{prose(lang, 30)}&amp;</p></html>'))
    return spark.createDataFrame(docs, cases.DOCS), pages, truth


def test_language_fuses_evidence(spark):
    docs, pages, truth = language_tables(spark)
    odd = [(1000, "https://a.site0.com/x", "<html><p></p></html>"), (1001, "https://b.site1.org/", '<html lang="yy"></html>'), (1002, None, None), (1003, "no address", "<p>koru maken tola</p>"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages + odd, PAGES).withColumns({"host": F.lit(1), "lang": F.lit("zz")})
    got = language.identify(df, docs).collect()
    assert len(got) == len(pages) + len(odd)
    by_id = {r.page_id: r for r in got}
    assert all(by_id[i].lang == lang for i, lang in truth.items())
    # without text, the host, suffix and markup decide
    assert by_id[1000].lang == "xx" and by_id[1001].lang == "yy" and by_id[1003].lang == "xx"
    assert by_id[1002].host == "" and by_id[1002].lang in {"xx", "yy"} and 0 < by_id[1002].posterior <= 1
    assert Counter(r.page_id for r in got)[0] == 2


def posteriors(docs, pages):
    """The fusion in plain Python: (lang, posterior) by place, from the rows of both tables."""
    names, model = language.fit_text([(d[2], d[1]) for d in docs if d[1] is not None and d[2] is not None])
    k = range(len(names))
    rows = []
    for _, url, html in pages:
        code, _ = language._grams([language.visible(html or "")])
        n = len(code)
        mean = [sum(float(model[c, i]) for c in code) / max(n, 1) * min(n, language.TEMPER) for i in k]
        top = max(mean)
        odds = [math.exp(x - top) for x in mean]
        host = m[1].lower() if (m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")) else ""
        labels = host.split(".")
        rows.append((mean, [round(x / sum(odds) * 10**6) for x in odds], host, ".".join(labels[-2:]), labels[-1], language.declared(html or "")))
    count = [sum(r[1][i] for r in rows) / 10**6 for i in k]
    prior = [(c + 1) / (sum(count) + len(names)) for c in count]
    out = []
    for mean, own, host, domain, suffix, declared in rows:
        said = lambda at, key, i: sum(r[1][i] for r in rows if r[at] == key) / 10**6
        score = []
        for i in k:
            by_domain = (said(3, domain, i) + language.KAPPA * prior[i]) / (sum(said(3, domain, j) for j in k) + language.KAPPA)
            by_host = (said(2, host, i) - own[i] / 10**6 + language.KAPPA * by_domain) / (sum(said(2, host, j) - own[j] / 10**6 for j in k) + language.KAPPA)
            likely = [(said(at, key, i) + 1) / (count[i] + 50) for at, key in ((5, declared), (4, suffix))]
            score.append(mean[i] + math.log(by_host) + sum(map(math.log, likely)))
        best = max(score)
        out.append((names[score.index(best)], 1 / sum(math.exp(x - best) for x in score)))
    return out


@pytest.mark.parametrize("heavy", [1, 1000])
def test_posteriors_equal_plain_python(spark, heavy, monkeypatch):
    monkeypatch.setattr(language, "HEAVY", heavy)
    monkeypatch.setattr(language, "BROADCAST_BYTES", -1 if heavy == 1 else 1 << 20)
    docs, pages, _ = language_tables(spark)
    pages = pages[:60] + [(900, None, None), (901, "http://u@B.site1.ORG:8/x", "<p>koru"), (902, "x", '<html lang="zz">liri maken'), (903, "", "")]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, PAGES), docs).collect()}
    assert len(got) == len(pages)
    for page, (lang, p) in zip(pages, posteriors([tuple(r) for r in docs.collect()], pages), strict=True):
        assert got[page[0]].lang == lang and got[page[0]].posterior == pytest.approx(p, abs=2e-5)


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_CHARS", 30)
    rng = random.Random(8)
    names = [f"{a}{b}" for a, b in itertools.islice(itertools.product("abcdefghij", repeat=2), 65)]
    word = {n: ["".join(rng.choices("bdfgklmnprstaeiou", k=7)) for _ in range(3)] for n in names}
    docs = [(i, " ".join(word[n] * 4), n, "s", 1) for i, n in enumerate(names)]  # all longer than SAMPLE_CHARS
    pages = [(i, f"http://h{i}.net/", f"<p>{' '.join(word[n] * 5)}</p>") for i, n in enumerate(names)]
    got = language.identify(spark.createDataFrame(pages, PAGES), spark.createDataFrame(docs, cases.DOCS)).collect()
    assert {r.page_id: r.lang for r in got} == dict(enumerate(names))


def test_sample_reads_texts_of_a_parquet_table(spark, tmp_path):
    rows = [(1, "one text", "en", None, 8), (1, "another text", "en", None, 12), (None, "ein Text", "de", None, 8), (2, None, "de", None, 0)]
    spark.createDataFrame(rows, cases.DOCS).write.parquet(str(tmp_path / "docs"))
    got = language.sample(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert sorted(map(tuple, got)) == [("de", "ein Text"), ("en", "another text"), ("en", "one text")]


def test_language_without_rows(spark):
    docs, pages, _ = language_tables(spark)
    assert language.identify(spark.createDataFrame([], PAGES), docs).isEmpty()
    blind = language.identify(spark.createDataFrame(pages[:3], PAGES), docs.where("false")).collect()
    assert [r.lang for r in blind] == [None] * 3 and {r.declared for r in blind} == {"xx", "yy"}


# Chat


def speeches(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(2, 6)):
            role = chat.ROLES[t % 2]
            rows.append((c, t, role, "\n".join(" ".join(["Word"] + ["word"] * rng.randint(1, 3 if role == "user" else 30)) for _ in range(1 if role == "user" else 4))))
    return rows


@pytest.fixture(scope="module")
def pieces(spark):
    return chat.as_transcripts(spark.createDataFrame(speeches(60), "conv_id long, turn long, role string, text string"))


def one_run(model, pieces):
    """Whole-conversation Viterbi, without partitions."""
    by_conv = {}
    for r in pieces.select("conv_id", "place", "text", F.xxhash64("text").alias("h1"), F.transform(chat.text_lines(F.col("text")), chat.line_code).alias("codes")).distinct().collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    out = {}
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r.place is not None, r.place or 0, r.h1))
        states = chat.viterbi(model, np.concatenate([r.codes for r in rows]))
        at = 0
        for r in rows:
            out[conv, r.place, r.text] = states[at : at + len(r.codes)].tolist()
            at += len(r.codes)
    return out


def test_chat_recovers_roles(spark, pieces):
    model = chat.fit(pieces.where("conv_id % 5 <> 0"))
    got = {(r.conv_id, r.place): r for r in chat.parse_transcripts(pieces, model).collect()}
    truth = {(r.conv_id, r.place): r.role for r in pieces.collect()}
    right = [chat.ROLES[got[k].states[0] % 3] == role for k, role in truth.items() if k[0] % 5 == 0]
    assert sum(right) / len(right) > 0.9
    marked = next(r for r in got.values() if r.text.startswith("User: "))
    assert marked.rendered.startswith("<|user|>\nWord")


@pytest.mark.parametrize("parts", ["1", "4", "64"])
def test_chat_partitions_do_not_change_the_paths(spark, pieces, parts):
    long = [(7, k, chat.ROLES[k % 2], f"{'Q: ' if k % 2 == 0 else ''}Word {k}\nmore words here") for k in range(300)]
    odd = [(None, 1, "user", "User: hi"), (None, None, "user", None), (8, None, "tool", ""), (9, 1, "user", "same"), (9, 1, "user", "same"), (9, 1, "assistant", "other")]
    more = spark.createDataFrame([(c, p, t, r) for c, p, r, t in long + odd], "conv_id long, place long, text string, role string")
    every = pieces.where("conv_id > 20").unionByName(more)
    model = chat.fit(pieces)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = chat.parse_transcripts(every.withColumn("states", F.lit(1)), model).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = one_run(model, every)
    assert len(got) == every.count()
    assert {(r.conv_id, r.place, r.text): list(r.states) for r in got} == want


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(6)
    for _ in range(40):
        moves = np.log(rng.random((chat.STATES + 1, chat.STATES)))
        model = chat.Model(np.log(rng.random((chat.STATES, 5))), moves)
        codes = rng.integers(0, 5, int(rng.integers(1, 5)))
        enter = int(rng.integers(0, chat.STATES + 1))

        def score(path, enter=enter, codes=codes, model=model):
            return sum(model.moves[a, b] + model.emission[b, c] for a, b, c in zip((enter, *path), path, codes, strict=False))

        every = {p: score(p) for p in itertools.product(range(chat.STATES), repeat=len(codes))}
        assert tuple(chat.viterbi(model, codes, enter)) == max(every, key=every.get)
        leave = int(rng.integers(0, chat.STATES))
        ending = {p: v for p, v in every.items() if p[-1] == leave}
        assert tuple(chat.viterbi(model, codes, enter, leave)) == max(ending, key=ending.get)
        assert chat.span(model, codes)[enter, leave] == pytest.approx(max(ending.values()))


def test_features_of_a_line_by_hand(spark):
    lines = ["User: Hi", "Assistant: no?", "### Instruction: Do", "<|system|>", "Question the plan", "A: x", "a b c", "  Q: what? ", "", "1 thing", "x" * 300, "System prompt: be", "Human:"]
    speaker = {"User: Hi": 1, "Assistant: no?": 2, "### Instruction: Do": 1, "<|system|>": 3, "A: x": 2, "  Q: what? ": 1, "System prompt: be": 3, "Human:": 1}
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", chat.line_code(F.col("x")).alias("c")).collect()
    for r in got:
        x = r.x
        size = sum(len(x) > b for b in chat.LENGTHS)
        first = x.strip()[:1]
        begins = 0 if first.isupper() else 1 if first.islower() else 2
        asks = int(x.rstrip().endswith("?"))
        assert r.c == ((speaker.get(x, 0) * 4 + size) * 2 + asks) * 3 + begins, x


def test_chat_without_rows(spark, pieces):
    none = pieces.where("false")
    assert chat.parse_transcripts(none, chat.fit(none)).isEmpty()

"""Small tables with every odd case, and plain-Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def odd_docs(seed=0):
    """Nulls, empties, repeats, ties, near copies, shared passages, long texts, unusual characters."""
    rng = random.Random(seed)
    base = prose(seed, 120, 5000)
    near = base.split(" ")
    near[50] = "other"
    passage = prose(seed + 1, 70, 5000)
    rows = [(1, base), (2, base), (3, " ".join(near)), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one"), (None, base), (None, None)]
    rows += [(10 + i, f"{prose(seed + 10 + i, 30)} {passage} {prose(seed + 50 + i, 20)}") for i in range(4)]
    rows += [(20, prose(seed + 90, 20_000)), (21, "x " * 300), (22, "x " * 300 + "y"), (23, "naïve 日本語 \x85 déjà_vu\x1cz \U0001f600" * 30), (24, f"a\n{passage}\r\n\x0bb\x0cc")]
    rows += [(30 + i, prose(rng.randint(0, 10**6), rng.randint(1, 90), 30)) for i in range(20)]
    return rows


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(rows, length=50):
    """Expected (n_words, n_removed, digest) by (doc_id, text)."""
    least = {}
    for doc_id, text in rows:
        if doc_id is not None:
            w = spaced(text)
            for p in range(len(w) - length + 1):
                k = tuple(w[p : p + length])
                least[k] = min(least.get(k, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        w = spaced(text)
        dead = [False] * len(w)
        if doc_id is not None:
            for p in range(len(w) - length + 1):
                if least[tuple(w[p : p + length])] < doc_id:
                    dead[p : p + length] = [True] * length
        kept = [x for x, d in zip(w, dead, strict=True) if not d]
        out[doc_id, text] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def shingles(text, k=5):
    w = spaced(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def classes(rows):
    """Expected class by doc_id, with every pair compared."""
    ids = sorted({d for d, _ in rows if d is not None})
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(d, t, shingles(t)) for d, t in rows if d is not None]
    for i, (a, t, x) in enumerate(known):
        for b, u, y in known[:i]:
            both, either = sum((x & y).values()), sum((x | y).values())
            if t == u or (either and 5 * both >= 4 * either):
                a_, b_ = root(a), root(b)
                up[max(a_, b_)] = min(a_, b_)
    return {d: root(d) for d in ids}


def components(n, pairs):
    """The least row of each row's component."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(rows, items, length=10):
    """Expected (n_words, n_hit, n_items, digest) by (doc_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows[tuple(w[i : i + length])].add(str(item))
    out = {}
    for doc_id, text in rows:
        w, hit, found = plain_words(text), set(), set()
        for window, ids in windows.items():
            n = len(window)
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == window:
                    hit.update(range(p, p + n))
                    found |= ids
        out[doc_id, text] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out

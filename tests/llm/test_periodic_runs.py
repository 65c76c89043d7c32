"""Periodic runs against a scan of every lag."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from parcelweave.llm import periodic_runs, queries


def all_runs(w):
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in out.items())


def words(rng):
    k = rng.choice((1, 2, 3, 5, 40))
    w = [rng.randrange(k) for _ in range(rng.randrange(0, 40))]
    for _ in range(rng.randrange(0, 4)):
        p = rng.choice((1, 2, 3, 7, 11, 12, 13, 17, 30))
        unit = [rng.randrange(rng.choice((2, 3, 100))) for _ in range(p)]
        n = rng.randrange(p, 4 * p + 20)
        w += (unit * (n // p + 1))[:n] + [rng.randrange(k) for _ in range(rng.randrange(0, 6))]
        if rng.random() < 0.3:
            w = w + w
    return w[:400]


@pytest.mark.parametrize("rounds, pairs", [(64, 1 << 22), (0, 50), (1, 7)])
def test_runs_are_all_found(monkeypatch, rounds, pairs):
    """However far the splitting goes, and in whatever chunks places are looked at."""
    monkeypatch.setattr(periodic_runs, "ROUNDS", rounds)
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = random.Random(5)
    for _ in range(250):
        docs = [words(rng) for _ in range(rng.randrange(1, 5))]
        at = np.cumsum([0, *map(len, docs)])
        got = list(zip(*(x.tolist() for x in periodic_runs.find(np.array(sum(docs, []), np.int64), at))))
        assert got == [(s + at[k], e + at[k], q) for k, d in enumerate(docs) for s, q, e in all_runs(d)]


def test_splitting_leaves_what_repeats():
    w = np.array([9, 1, 2, 1, 2, 1, 2, 8, 3, 4, 5, 3, 4, 5, 7, 6, 6])
    s, e = periodic_runs.split(w, np.array([0]), np.array([len(w)]), 1, 3)
    assert list(zip(s, e)) == [(1, 7), (8, 14)]


def test_long_repeats_stay_cheap():
    """A text of one word, of two at random, and the Fibonacci word: n log n places, not all lags."""
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    for w in (np.zeros(30_000, np.int64), np.random.default_rng(1).integers(0, 2, 30_000), np.array(b[:30_000])):
        s, e, q = periodic_runs.find(w, np.array([0, len(w)]))
        assert all((w[x : z - y] == w[x + y : z]).all() for x, z, y in zip(s, e, q)) and len(s) >= 1


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    best = min(((-(e - s), s, q) for s, q, e in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else [None] * 4),
            sha("".join(f"{s},{e - s},{q}\n" for s, q, e in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_documents(spark, docs, rows):
    more = [(2000 + k, ("x\x0by z " * k), None, None, None) for k in range(30)]
    given = [r for r in [*rows, *more, (None, "no id", "en", "s1", 5)] if len(r[1] or "") < 20_000]
    both = docs.select("doc_id", "text", "key").where("text IS NULL OR length(text) < 20000").unionByName(spark.createDataFrame([(*r[:2], "k") for r in more], "doc_id long, text string, key string"))
    got = periodic_runs.digests(periodic_runs.collapse(both, queries.planted)).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted((expected(*r[:2]) for r in given), key=order)
    assert sum(r.n_runs for r in got) > 20


def test_collapsed_text(spark, nothing):
    df = spark.createDataFrame([(1, "a b " * 6 + "c"), (2, None), (3, " one\ttwo ")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs.collapse(df).collect()}
    assert got == {1: (13, [(0, 12, 2)], "a b c"), 2: (0, [], ""), 3: (2, [], "one two")}
    assert periodic_runs.digests(periodic_runs.collapse(nothing)).collect() == []

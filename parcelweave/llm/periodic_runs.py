"""Periodic runs of words: stretches that repeat themselves at least twice, found by recursive frequency splitting.

A run of period q is a longest stretch of words in which words q apart are equal, at least
``max(12, 2 q)`` long, q being the smallest such number.

1. Every word of a run stands in it twice or more.  So a word that occurs once in a segment of a document
   belongs to no run there, and splits the segment; what is left is counted anew, segment by segment,
   until nothing splits.  Segments below 12 words go.
2. Lags below 12 are scanned over the surviving segments: equal words at the lag, in long enough stretches.
3. For longer lags the same splitting is done with blocks of six words (in a run, two blocks that recur
   are at most six words apart).  In what survives, a run of period q holds two places k q and (k+1) q with
   the six words from there on, or up to there, equal; only these pairs of places are looked at, about
   n log n of them, and those that agree are extended both ways by ranks of blocks of 2, 4, 8, ... words.

A stretch found at a multiple of its period is the same stretch, so each keeps its smallest lag.  Splitting
only leaves places out that no run can hold; it stops after ``ROUNDS`` rounds at the latest, which changes
the work and never the result.  The work on a document is about n log n, whatever its words.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; a row without a
doc_id is treated like the others; equal rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, steps

#: words of a run at least, and times its period at least
LEAST, TIMES = 12, 2
#: words to a block; longer lags than twice as many are told by blocks
BLOCK = 6
ROUNDS = 64
#: pairs of places looked at in one step
PAIRS = 1 << 22
STEP = 8 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words between white space of all texts, end to end, and the n+1 places where each text's words begin."""
    solid = ~_IS_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begin[inner] = solid[inner]
    at = np.flatnonzero(begin)
    lost = np.cumsum(~solid) if len(data) else np.zeros(0, np.int64)
    kept = np.ascontiguousarray(data[solid])
    ends = np.append(at - lost[at], len(kept)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(kept)]), np.searchsorted(at, offsets)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one range after the other."""
    size = ends - starts
    skip = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
    return skip + np.arange(len(skip))


def split(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments that survive: stretches of ids repeated in their segment, at most ``width`` apart.

    ``ids[i]`` names the ``width`` words from i on.
    """
    done_s, done_e = [], []
    for left in range(ROUNDS, -1, -1):
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts) or not left:
            done_s.append(starts)
            done_e.append(ends)
            break
        at = _ranges(starts, ends - width + 1)
        seg = np.repeat(np.arange(len(starts)), ends - width + 1 - starts)
        order = np.lexsort((ids[at], seg))
        s, v = seg[order], ids[at][order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (v[1:] != v[:-1])])
        alone = new & np.append(new[1:], True)
        repeated = np.ones(len(at), bool)
        repeated[order[alone]] = False
        at, seg = at[repeated], seg[repeated]
        first = np.concatenate([[True], (seg[1:] != seg[:-1]) | (np.diff(at) > width)]) if len(at) else np.zeros(0, bool)
        last = np.append(first[1:], True) if len(at) else first
        new_s, new_e, of = at[first], at[last] + width, seg[first]
        stable = (new_s == starts[of]) & (new_e == ends[of])
        done_s.append(new_s[stable])
        done_e.append(new_e[stable])
        starts, ends = new_s[~stable], new_e[~stable]
    starts, ends = np.concatenate(done_s), np.concatenate(done_e)
    order = np.argsort(starts)
    return starts[order], ends[order]


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _short(x: np.ndarray, seg: np.ndarray, least: int) -> list[np.ndarray]:
    """Stretches (start, end, lag) at the lags below two blocks."""
    out = []
    for q in range(1, min(2 * BLOCK, len(x))):
        same = np.zeros(len(x) - q + 2, bool)
        same[1:-1] = (x[:-q] == x[q:]) & (seg[:-q] == seg[q:])
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, end = edge[::2], edge[1::2] + q
        keep = end - start >= max(least, TIMES * q)
        out.append(np.stack([start[keep], end[keep], np.full(int(keep.sum()), q)]))
    return out


def _pairs(starts: np.ndarray, ends: np.ndarray):
    """Chunks of (place, lag): the multiples of each lag in each segment that a run of the lag may hold."""
    long = ends - starts >= TIMES * TIMES * BLOCK
    starts, size = starts[long], (ends - starts)[long]
    lags = size // TIMES - 2 * BLOCK + 1
    seg = np.repeat(np.arange(len(starts)), lags)
    q = _ranges(np.full(len(starts), 2 * BLOCK), 2 * BLOCK + lags)
    count = (size[seg] - 1) // q
    total = np.cumsum(count)
    at = 0
    while at < len(q):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        lag = np.repeat(q[at:stop], count[at:stop])
        k = _ranges(np.zeros(stop - at, np.int64), count[at:stop])
        yield np.repeat(starts[seg[at:stop]], count[at:stop]) + k * lag, lag
        at = stop


class _Ranks:
    """How far two places agree, forwards and backwards, by names of blocks of 1, 2, 4, ... words."""

    def __init__(self, x: np.ndarray, most: int):
        self.names = [x]
        while (width := 1 << len(self.names)) <= most:
            half = self.names[-1]
            self.names.append(_named(half[: -(width // 2)], half[width // 2 :]))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from a on and from b on, b being the later place."""
        a, b = a.copy(), b.copy()
        first = b.copy()
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            for _ in range(2 if k == len(self.names) - 1 else 1):
                fits = b < len(name)
                fits[fits] = name[a[fits]] == name[b[fits]]
                a[fits] += 1 << k
                b[fits] += 1 << k
        return b - first

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before a and before b, a being the earlier place."""
        a, b = a.copy(), b.copy()
        first = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            name, width = self.names[k], 1 << k
            for _ in range(2 if k == len(self.names) - 1 else 1):
                fits = a >= width
                fits[fits] = name[a[fits] - width] == name[b[fits] - width]
                a[fits] -= width
                b[fits] -= width
        return first - a


def _long(w: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Stretches (start, end, lag) at the lags from two blocks on, in the words' own places."""
    starts, ends = starts[ends - starts >= TIMES * 2 * BLOCK], ends[ends - starts >= TIMES * 2 * BLOCK]
    if not len(starts):
        return []

    def blocks(x):
        two = _named(x[:-1], x[1:])
        four = _named(two[:-2], two[2:])
        return _named(four[:-2], four[2:])

    at = _ranges(starts, ends)
    x = np.full(len(w), -1, np.int64)
    x[at] = np.unique(w[at], return_inverse=True)[1]
    six = np.zeros(len(w), np.int64)
    six[at[: len(at) - BLOCK + 1]] = blocks(x[at])  # those over an edge of a segment are never asked for
    starts, ends = split(six, starts, ends, BLOCK, TIMES * 2 * BLOCK)
    if not len(starts):
        return []
    at = _ranges(starts, ends)
    # the segments side by side, a word of its own between them
    place = np.arange(len(at)) + np.repeat(np.arange(len(starts)), ends - starts)
    y = np.full(len(at) + len(starts), -1, np.int64)
    y[place] = x[at]
    y[y < 0] = x.max() + 1 + np.arange(len(starts))
    low = place[np.concatenate([[0], np.cumsum(ends - starts)[:-1]])]
    shift = starts - low
    b = blocks(y)
    ranks, out = None, []
    for a, lag in _pairs(low, low + (ends - starts)):
        fore = np.zeros(len(a), bool)
        inside = a + lag < len(b)
        fore[inside] = b[a[inside]] == b[a[inside] + lag[inside]]
        rear = a >= BLOCK - 1
        rear[rear] = b[a[rear] - BLOCK + 1] == b[a[rear] + lag[rear] - BLOCK + 1]
        some = fore | rear
        a, lag = a[some], lag[some]
        if not len(a):
            continue
        ranks = ranks or _Ranks(y, int((ends - starts).max()))
        begin = a - ranks.back(a, a + lag)
        end = a + lag + ranks.ahead(a, a + lag)
        keep = end - begin >= TIMES * lag
        found = np.unique(np.stack([begin[keep], end[keep], lag[keep]]), axis=1)
        of = np.searchsorted(low, found[0], "right") - 1
        out.append(found + np.stack([shift[of], shift[of], np.zeros(len(of), np.int64)]))
    return out


def find(w: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all documents, by start and period; ``w`` holds word numbers."""
    starts, ends = split(w, offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64), 1, LEAST)
    at = _ranges(starts, ends)
    seg = np.repeat(np.arange(len(starts)), ends - starts)
    found = [np.stack([at[s], at[e - 1] + 1, q]) for s, e, q in _short(w[at], seg, LEAST)] + _long(w, starts, ends)
    all_ = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    all_ = all_[:, np.lexsort((all_[2], all_[1], all_[0]))]
    first = np.concatenate([[True], (np.diff(all_[0]) != 0) | (np.diff(all_[1]) != 0)]) if all_.shape[1] else np.zeros(0, bool)
    all_ = all_[:, first]
    start, end, period = all_[:, np.lexsort((all_[2], all_[0]))]
    return start, end, period


RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def collapse(docs: DataFrame, arrange: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and the text without the repeats.

    Of each run the first period's words stay, where no other run drops them; the words left are joined
    by one blank.  ``arrange`` may give, for a doc_id and its number of words, the words to take instead
    (numbers of words, as many).
    """

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for step in steps(batches, "text", STEP):
            words, offsets = words_of(*joined_bytes(step.column(1)))
            n = np.diff(offsets)
            order = np.arange(len(words))
            if arrange:
                for k, doc_id in enumerate(step.column(0).to_pylist()):
                    other = arrange(doc_id, int(n[k]))
                    if other is not None:
                        order[offsets[k] : offsets[k + 1]] = offsets[k] + other
            number = np.asarray(words.dictionary_encode().indices).astype(np.int64)[order]
            start, end, period = find(number, offsets)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, end, -1)
            kept = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
            # the words left, each with a blank behind it
            ends = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
            data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
            low, size = ends[order[kept]], (ends[1:] - ends[:-1])[order[kept]]
            out_at = np.concatenate([[0], np.cumsum(size + 1)])
            out = np.full(out_at[-1], 32, np.uint8)
            out[_ranges(out_at[:-1], out_at[1:] - 1)] = data[_ranges(low, low + size)]
            cut = out_at[np.searchsorted(kept, offsets)]
            whole = out.tobytes()
            texts = [whole[a : max(a, b - 1)].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            doc = np.searchsorted(offsets[1:], start, "right")
            runs = pa.StructArray.from_arrays([pa.array(start - offsets[doc]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
            at = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, runs).cast(kind), pa.array(texts, pa.string())],
                                             ["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and digests of the runs and of the text left."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("CAST(1000 * best.length div -best.period AS BIGINT)").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("collapsed_sha256"))

"""Removal of repeated byte strings by sorting suffixes.

A byte goes when a string of ``LENGTH`` bytes that covers it starts anywhere else as well.  Sorting every
suffix of the corpus would move hundreds of bytes for each byte, so suffixes are first brought together:

1. Each window of LENGTH bytes has an anchor, the place of the least hash among its short substrings;
   equal windows have theirs at the same distance.  Windows with one anchor follow one another, so one row
   stands for all of them (about one row for 75 bytes): the windows that start 0 to grid-1 bytes before
   its reference place.  They share a middle of LENGTH-grid+1 bytes, whose hash is the row's key, and
   the hash of all their bytes is its context.
2. Rows alone with their key are done.  Rows that share key and context with another are repeated whole.
   What is left are keys with several contexts.
3. For each such key the suffixes behind the middle, and the reversed ones before it, are sorted deep and
   shallow: multikey quicksort to ``SHALLOW`` bytes, then blind tries for groups with longer common
   prefixes.  Windows are equal where both orders put them in the same class, read off the common
   prefixes of neighbours.
4. Keys with more than ``MOST_CONTEXTS`` contexts are not sorted in one task: their rows are dealt anew
   with a finer grid, the last one of which compares whole windows by key alone.

Counts are aggregates and joins, so a string that a third of all documents share is spread.

Defined results: a null or empty text has no bytes and the digest of the empty string; a text shorter than
LENGTH keeps all; repeated rows are repeats of each other; rows that share an id are told apart by their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage
from .common import identified, joined_bytes, mix64, picked, steps, text_or_empty
from .shingles import _powers

LENGTH = 400
#: bytes of the substring whose hash chooses an anchor
ANCHOR = 16
#: window starts to one row, at first and for keys with too many contexts; the last one leaves nothing to sort
GRIDS = (129, 17, 1)
SHALLOW = 24
MOST_CONTEXTS = 2048
#: bytes hashed at a time
BLOCK = 1 << 20
ROW = "key long, ctx long, doc_id long, h long, lo long, hi long, mid long"
NAMES = ["key", "ctx", "doc_id", "h", "lo", "hi", "mid"]
SALT = np.uint64(0xD6E8FEB86659FD93)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by block prefixes and suffixes."""
    n = len(x) - width + 1
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class _Hashes:
    """Hashes of any substring of a block."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(20, int(len(data)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _dealt(hashes: _Hashes, ref: np.ndarray, first: np.ndarray, last: np.ndarray, grid: int, salt=None):
    """Rows of the windows that start first..last bytes before each reference: (which, key, ctx, lo, hi, mid)."""
    out = []
    for j in range(int(first.min()) // grid, int(last.max()) // grid + 1) if len(ref) else ():
        l0, l1 = np.maximum(first, j * grid), np.minimum(last, (j + 1) * grid - 1)
        w = np.flatnonzero(l0 <= l1)
        l0, l1, mid = l0[w], l1[w], ref[w] - j * grid
        key = hashes(mid, mid - (grid - 1) + LENGTH) + np.uint64(j * int(SALT) % (1 << 64))
        key = mix64(key if salt is None else key + salt[w])
        lo, hi = ref[w] - l1, ref[w] - l0 + LENGTH
        ctx = mix64(hashes(lo, hi) + (mid - lo).astype(np.uint64) * SALT)
        out.append((w, key, ctx, lo, hi, mid))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


def anchored(data: np.ndarray, offsets: np.ndarray, block: int):
    """For the texts of a step: (text number, key, ctx, lo, hi, mid) with places relative to the text.

    ``block`` window starts are hashed at a time.  A run of windows that a block's end cuts is left to the next
    block, which begins with it: as two rows of one key it would count as a repeat of itself.
    """
    n, c = len(data), 0
    if block <= LENGTH:
        raise ValueError("a block has to be longer than a run of windows with one anchor")
    while c <= n - LENGTH:
        part = data[c : c + block + LENGTH - 1]
        m = len(part)
        hashes = _Hashes(part)
        at = np.arange(m - ANCHOR + 1)
        short = (hashes(at, at + ANCHOR) >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
        anchor = (_sliding_least(short, LENGTH - ANCHOR + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = len(anchor)
        # windows that would cross the end of a text don't count
        ends = offsets[(offsets > c) & (offsets < c + starts + LENGTH)] - c
        bad = np.zeros(starts + 1, np.int32)
        np.add.at(bad, np.clip(ends - LENGTH + 1, 0, starts), 1)
        np.add.at(bad, np.clip(ends, 0, starts), -1)
        good = np.cumsum(bad[:-1]) == 0
        edge = np.ones(starts, bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
        begin = np.flatnonzero(edge)
        stop = np.append(begin[1:], starts) - 1
        passed = starts
        if c + starts <= n - LENGTH and good[-1]:  # more windows follow
            passed, begin, stop = int(begin[-1]), begin[:-1], stop[:-1]
        begin, stop = begin[good[begin]], stop[good[begin]]
        ref = anchor[begin]
        w, key, ctx, lo, hi, mid = _dealt(hashes, ref, ref - stop, ref - begin, GRIDS[0])
        doc = np.searchsorted(offsets, lo + c, "right") - 1
        base = offsets[doc] - c
        yield doc, key, ctx, lo - base, hi - base, mid - base
        c += passed


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least ``known``."""
    low, high = known, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _blind_order(texts: list[bytes], group: list[int], depth: int) -> list[tuple[int, int]]:
    """(number, common prefix with the one before) in order.  A node keeps its depth and branching bytes only."""
    at = lambda s, d: s[d] if d < len(s) else -1
    root = [group[0]]  # a leaf is a list of equal texts; a node is (depth, {byte: child})
    for k in group[1:]:
        s, node = texts[k], root
        while isinstance(node, tuple):  # blind: take the branch that fits, or any
            node = node[1].get(at(s, node[0])) or next(iter(node[1].values()))
        other = texts[node[0]]
        same = _common(s, other, depth)
        if same == len(s) == len(other):
            node.append(k)
            continue
        above, node = None, root
        while isinstance(node, tuple) and node[0] < same:
            above, node = (node, at(s, node[0])), node[1][at(s, node[0])]
        if isinstance(node, tuple) and node[0] == same:
            node[1][at(s, same)] = [k]
        else:
            split = (same, {at(other, same): node, at(s, same): [k]})
            if above is None:
                root = split
            else:
                above[0][1][above[1]] = split
    out, todo = [], [(root, depth)]
    while todo:
        node, common = todo.pop()
        if isinstance(node, tuple):
            kids = sorted(node[1])
            todo += [(node[1][b], common if b == kids[0] else node[0]) for b in reversed(kids)]
        else:
            out += [(k, common if k == node[0] else len(texts[k])) for k in node]
    return out


def deep_shallow(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of the texts, and each one's common prefix with the one before it (0 for the first)."""
    order: list[int] = []
    prefix: list[int] = []
    todo = [(list(range(len(texts))), 0, 0)]
    while todo:  # multikey quicksort: three parts by the byte at the depth
        group, depth, common = todo.pop()
        if len(group) == 1:
            order.append(group[0])
            prefix.append(common)
        elif depth >= SHALLOW or all(len(texts[k]) <= depth for k in group):
            for n, (k, same) in enumerate(_blind_order(texts, group, depth)):
                order.append(k)
                prefix.append(same if n else common)
        else:
            byte = {k: texts[k][depth] if depth < len(texts[k]) else -1 for k in group}
            pivot = byte[group[len(group) // 2]]
            parts = [[k for k in group if byte[k] < pivot], [k for k in group if byte[k] == pivot], [k for k in group if byte[k] > pivot]]
            first = True
            new = []
            for part, d in zip(parts, (depth, depth + 1, depth)):
                if part:
                    new.append((part, d, common if first else depth))
                    first = False
            todo += reversed(new)
    if prefix:
        prefix[0] = 0
    return order, prefix


def repeated_windows(left: list[bytes], right: list[bytes], grid: int) -> np.ndarray:
    """[k, l]: whether the window that starts l bytes before the middle of context k is one of another context too."""
    n, steps_ = len(left), np.arange(grid)
    kinds = []
    for texts, need in ((left, steps_), (right, grid - 1 - steps_)):
        order, prefix = deep_shallow(texts)
        length = np.array([len(texts[k]) for k in order])
        cut = np.array(prefix)[None, :] < need[:, None]
        cut[:, 0] = False
        kind = np.empty((grid, n), np.int64)
        kind[:, order] = np.where(length[None, :] >= need[:, None], np.cumsum(cut, axis=1), -1)
        kinds.append(kind)
    both = kinds[0] * n + kinds[1]
    both[(kinds[0] < 0) | (kinds[1] < 0)] = -1
    rank = np.argsort(both, axis=1, kind="stable")
    ordered = np.take_along_axis(both, rank, axis=1)
    same = np.zeros((grid, n), bool)
    eq = (ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)
    same[:, 1:] |= eq
    same[:, :-1] |= eq
    out = np.empty((grid, n), bool)
    np.put_along_axis(out, rank, same, axis=1)
    return out.T


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` gathered by document, with its text."""
    by = rows.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "ctx", "lo", "hi", "mid", "copies")).alias("rows"))
    wanted = picked(docs, stage(rows.select("doc_id").distinct(), "suffix-ids"))
    return wanted.dropDuplicates(["doc_id", "h"]).join(by, ["doc_id", "h"]).select("doc_id", "h", "text", "rows")


def _sorted(docs: DataFrame, rows: DataFrame, grid: int) -> DataFrame:
    """doc_id, h, lo, hi of the windows of single contexts that another context of their key has too."""
    def cut(batches):
        for step in steps(batches, "text"):
            out = []
            for doc_id, h, text, own in zip(*(c.to_pylist() for c in step.columns)):
                data = text.encode()
                for r in own:
                    end = r["mid"] - (grid - 1) + LENGTH
                    out.append((r["key"], doc_id, h, r["lo"], r["hi"], r["mid"], r["copies"], data[max(0, r["mid"] - grid + 1) : r["mid"]][::-1], data[end : end + grid - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 9, [pa.int64()] * 7 + [pa.binary()] * 2)], names)

    def meet(batches):
        key, held = None, []

        def flush():
            hit = repeated_windows([r[6] for r in held], [r[7] for r in held], grid)
            out = []
            for (doc_id, h, lo, hi, mid, copies, _, _), row in zip(held, hit):
                if copies > 1:
                    continue
                own = np.zeros(grid + 2, np.int8)
                own[1:-1] = row
                own[: mid - (hi - LENGTH) + 1] = 0
                own[mid - lo + 2 :] = 0
                change = np.diff(own)
                for x, y in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1):
                    out.append((doc_id, h, mid - int(y), mid - int(x) + LENGTH))
            return out

        for batch in batches:
            found = []
            for k, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(held) > 1:
                        found += flush()
                    key, held = k, []
                held.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 4)], ["doc_id", "h", "lo", "hi"])
        if len(held) > 1 and (found := flush()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "h", "lo", "hi"])

    names = ["key", "doc_id", "h", "lo", "hi", "mid", "copies", "left", "right"]
    cuts = _with_text(docs, rows).mapInArrow(cut, "key long, doc_id long, h long, lo long, hi long, mid long, copies long, left binary, right binary")
    return cuts.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "doc_id long, h long, lo long, hi long")


def _finer(docs: DataFrame, rows: DataFrame, grid: int) -> DataFrame:
    """The rows dealt anew with a finer grid; only rows of one key meet again."""
    def cut(batches):
        for step in steps(batches, "text"):
            for doc_id, h, text, own in zip(*(c.to_pylist() for c in step.columns)):
                data = np.frombuffer(text.encode(), np.uint8)
                for r in own:
                    base = max(0, r["lo"])
                    hashes = _Hashes(data[base : r["hi"]])
                    ref = np.array([r["mid"] - base])
                    first, last = np.array([r["mid"] - (r["hi"] - LENGTH)]), np.array([r["mid"] - r["lo"]])
                    w, key, ctx, lo, hi, mid = _dealt(hashes, ref, first, last, grid, np.array([r["key"]], np.int64).astype(np.uint64))
                    # a context seen before counts as often as it was: it is sent twice
                    for _ in range(2 if r["copies"] > 1 else 1):
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, ctx, np.full(len(key), doc_id), np.full(len(key), h), lo + base, hi + base, mid + base)], NAMES)

    return _with_text(docs, rows).mapInArrow(cut, ROW)


def _repeats(docs: DataFrame, rows: DataFrame, grids: tuple[int, ...]) -> DataFrame:
    """doc_id, h, lo, hi of all repeated windows."""
    rows = stage(rows, "suffix-rows")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high")).where("n > 1")
    met = stage(rows.join(keys, "key").select(*NAMES, (F.col("low") == F.col("high")).alias("one")), "suffix-met")
    mixed = met.where("NOT one")
    contexts = stage(mixed.groupBy("key", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h", "lo", "hi", "mid")).alias("r"))
                     .select("key", "ctx", "copies", "r.*"), "suffix-contexts")
    columns = ["doc_id", "h", "lo", "hi"]
    found = met.where("one").select(*columns).unionByName(mixed.join(contexts.where("copies > 1").select("key", "ctx"), ["key", "ctx"]).select(*columns))
    many = contexts.groupBy("key").agg(F.count("*").alias("m"))
    large = stage(many.where(F.col("m") > MOST_CONTEXTS).select("key"), "suffix-large")
    if len(grids) == 1:
        return found
    found = found.unionByName(_sorted(docs, contexts.join(large, "key", "left_anti"), grids[0]))
    if not large.isEmpty():
        found = found.unionByName(_repeats(docs, _finer(docs, contexts.join(large, "key", "left_semi"), grids[1]), grids[1:]))
    return found


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = identified(docs, "doc_id", text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))

    def anchors(batches):
        for step in steps(batches, "text", BLOCK):
            data, offsets = joined_bytes(step.column(1))
            ids, hashes = step.column(0).to_numpy(), step.column(2).to_numpy()
            for doc, key, ctx, lo, hi, mid in anchored(data, offsets, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.astype(np.int64), ctx.astype(np.int64), ids[doc], hashes[doc], lo, hi, mid)], NAMES)

    def strip(batches):
        for step in steps(batches, "text"):
            out = []
            for doc_id, text, low, high in zip(*(c.to_pylist() for c in step.columns)):
                data = text.encode()
                spans: list[list[int]] = []
                for lo, hi in sorted(zip(low or [], high or [])):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                digest, at = hashlib.sha256(), 0
                for lo, hi in spans:
                    digest.update(data[at:lo])
                    at = hi
                digest.update(data[at:])
                out.append((doc_id, len(data), sum(hi - lo for lo, hi in spans), len(spans), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _repeats(rows, rows.where(F.octet_length("text") >= LENGTH).mapInArrow(anchors, ROW), GRIDS)
    spans = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("s")).select("doc_id", "h", F.col("s.lo").alias("low"), F.col("s.hi").alias("high"))
    whole = rows.join(spans, ["doc_id", "h"], "left").select("doc_id", "text", "low", "high")
    return whole.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

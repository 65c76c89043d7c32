"""N-gram Jaccard self-join over count vectors in R-trees.

A document is its set of distinct five-word shingles.  Shingles are hashed into groups; the vector of
group counts is a point, and the sum of coordinate minima of two points bounds their overlap from above.
Points are kept in an R-tree whose boxes hold the coordinate maxima below them, so a box whose bound is
too small is left with all its points; pairs that survive are verified on the shingles themselves.

A tree over all documents would be one task, so points meet by *route*: of two sets that link, the
rarest quarter of each must share a shingle (the prefix filter), so every document is sent along the
shingles of its prefix.  "Rare" needs only a common order; shingles that are frequent anywhere come last.

1. One pass digests the sets (equal sets form a class, one member stands for it), makes their count
   vectors and reports frequent shingles.
2. A second pass sends prefixes along, packed by bucket; documents without a partner of a fitting size
   and rest drop out of a route.
3. Star rounds: on each route one pivot is compared with the others.  Pairs whose count vectors bound
   the overlap too low fall out before a text moves; the rest are verified.  A group of near copies
   becomes one component this way with as many checks as members, never all pairs.
4. On routes that still lead through several components the trees search the count vectors alone: each
   point names its ``NAMED`` best partners, of as many other components.  The distinct pairs are verified.
5. Points that had more such partners, on routes still open after that, name partners once more by finer
   vectors, about a shingle to a group, which leave little but links.
6. Points that have more of those still, on routes still open, meet again with their texts, and every pair
   left of different components is verified inside the tree's task.  No link between different components
   is lost.

A pair also needs enough shingles from the shared one on, in the common order, in both sets: it is sure
to have them on the route of its first shared shingle, so other routes may leave it.  Of routes with the
same documents only the first in order, where most shingles are left, is searched.

Frequent routes are split: buckets by salted parts, trees by pairs of blocks of bounded rows and bytes,
pivots by groups of ``PIVOT_ROWS``.

Defined results: a null or empty text, or one without words, has 0 shingles and is alone; equal rows are
in one component; rows that share an id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage
from .common import identified, kept, mix64, picked, steps
from .components import components
from .shingles import set_digest, shingle_sets

#: a link needs 100 * intersection >= PERCENT * union
PERCENT = 75
#: shingles that count as frequent: so often within one task's slice of the corpus; and how many are told to all tasks (4 MB)
LOCAL_COUNT, MOST_FREQUENT = 3, 1 << 18
#: shingles counted, and prefix shingles packed, at a time within a task
COUNT_ROWS, PACK_ROWS = 1 << 21, 1 << 18
#: bytes of text, or of count vectors, that a step holds at a time; hashing them takes about twelve times as much
STEP = 2 << 20
#: postings of one bucket part, rows of one tree, checks of one pivot group
PART_ROWS, TREE_ROWS, PIVOT_ROWS = 1 << 18, 1024, 256
#: bytes of count vectors, and of shingles, of one block of a tree; folded points take four times as much
BLOCK_BYTES = 8 << 20
#: shingles to a group of the count vector, fewest and most groups
GROUP_SIZE, LEAST_GROUPS, MOST_GROUPS = 4, 16, 8192
#: the same of the finer vectors
FINE_SIZE, FINE_GROUPS = 1, 32768
#: partners that a point names before texts move
NAMED = 4
#: checks told to every task, so that texts move once, to their check; more meet them by a join
MOST_CHECKS = 1 << 19
STAR_ROUNDS = 2
FANOUT = 16


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def enough(overlap, a, b):
    """100 * intersection >= PERCENT * union, from the sizes of the sets."""
    return 100 * overlap >= PERCENT * (a + b - overlap)


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """The exact test, on sorted distinct shingles."""
    both = np.sort(np.concatenate([s, t]))
    return enough(int(np.count_nonzero(both[1:] == both[:-1])), len(s), len(t))


def count_vector(s: np.ndarray, size: int = GROUP_SIZE, most: int = MOST_GROUPS) -> np.ndarray:
    """Shingles by group, 255 standing for that many or more."""
    groups = LEAST_GROUPS
    while groups * size < len(s) and groups < most:
        groups *= 2
    return np.minimum(np.bincount((mix64(s) % np.uint64(groups)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def fold(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Vectors over fewer groups: hashes modulo a power of two, so counts just add."""
    v = vectors.astype(np.int32)
    v[vectors == 255] = 1 << 20
    return v.reshape(len(v), -1, groups).sum(1, dtype=np.int32)


def may_link(v: np.ndarray, w: np.ndarray, n: int, m: int) -> bool:
    """Whether the count vectors of sets of n and m shingles leave room for a link."""
    g = min(len(v), len(w))
    return enough(min(n, m), n, m) and enough(int(np.minimum(fold(v[None], g), fold(w[None], g)).sum()), n, m)


class CountTree:
    """An R-tree over count vectors, packed by size; boxes keep maxima of coordinates and rests, and least sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, rests: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.levels = [(vectors[self.order], sizes[self.order], rests[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            v, n, r = self.levels[-1]
            at = np.arange(0, len(v), FANOUT)
            self.levels.append((np.maximum.reduceat(v, at), np.minimum.reduceat(n, at), np.maximum.reduceat(r, at)))

    def search(self, vector: np.ndarray, size: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the points that may overlap enough, and the bounds of their overlaps."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, n, r = self.levels[depth]
            at = at[enough(np.minimum(r[at], rest), n[at], size)]
            bound = np.minimum(v[at], vector).sum(1)
            fits = enough(bound, n[at], size)
            at, bound = at[fits], bound[fits]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at], bound


def tree_partners(vectors: list[np.ndarray], sizes: np.ndarray, rests: np.ndarray, left: np.ndarray):
    """(i, all j) for points that may link, the likeliest j first; each pair comes once.

    ``rests`` are the shingles each set has from the route's one on; ``left`` tells two blocks apart (-1: one block, all pairs).
    """
    widths = np.array([len(v) for v in vectors])
    for g in np.unique(widths):
        # linked sets differ in size by less than a factor of two, so in groups by one step
        near = np.flatnonzero((widths == g) | (widths == 2 * g))
        points = np.concatenate([fold(vectors[k][None], g) for k in near])
        tree = CountTree(points, sizes[near], rests[near])
        for a, k in enumerate(near):
            if widths[k] == g:
                at, bound = tree.search(points[a], int(sizes[k]), int(rests[k]))
                j = near[at]
                fits = ((widths[j] != g) | (j > k)) & ((left[k] < 0) | (left[j] != left[k])) & enough(np.minimum(sizes[j], sizes[k]), sizes[j], sizes[k])
                j, bound = j[fits], bound[fits]
                if len(j):
                    yield int(k), j[np.lexsort((j, -(bound / (sizes[j] + sizes[k]))))]


def tree_pairs(vectors: list[np.ndarray], sizes: np.ndarray, rests: np.ndarray, left: np.ndarray):
    """The same as pairs (i, j)."""
    for k, partners in tree_partners(vectors, sizes, rests, left):
        for j in partners.tolist():
            yield k, j


def named_pairs(vectors: list[np.ndarray], sizes: np.ndarray, rests: np.ndarray, components_: np.ndarray, left: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs (i, j) of each point and its best partners in as many other components, and the points that have further pairs."""
    out, more = [], np.zeros(len(sizes), bool)
    for k, j in tree_partners(vectors, sizes, rests, left):
        j = j[components_[j] != components_[k]]
        _, best = np.unique(components_[j], return_index=True)
        chosen = np.sort(best)[:NAMED]
        out += [(k, x) for x in j[chosen].tolist()]
        if len(chosen) < len(j):
            more[np.delete(j, chosen)] = True
            more[k] = True
    return out, np.flatnonzero(more)


def tree_links(ids: list[int], sets: list[np.ndarray], rests: np.ndarray, components_: list[int], left: np.ndarray) -> list[tuple[int, int]]:
    """Verified links that join components, one for each two that meet; pairs within a component need no check."""
    root = {c: c for c in components_}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for k, j in tree_pairs([count_vector(s) for s in sets], np.array([len(s) for s in sets]), rests, left):
        a, b = find(components_[k]), find(components_[j])
        if a != b and linked(sets[k], sets[j]):
            root[a] = b
            out.append((ids[k], ids[j]))
    return out


def _digests(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, h1, h2, vec of each document; kind 1: frequent shingle h1 with its count n."""
    names = ["kind", "doc_id", "n", "h1", "h2", "vec"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        kept("shingles", set)  # lets go of another operator's tables
        held, rows, seen = [], 0, set()

        def frequent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL_COUNT
            v, c = values[often].astype(np.int64), counts[often]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.ones(len(v)), np.zeros(len(v)), c, v, np.zeros(len(v)), [None] * len(v)), kinds)], names)

        for step in steps(batches, "text", STEP):
            sets = shingle_sets(step.column(1))
            digests = [set_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), kinds[0]), step.column(0), pa.array([len(s) for s in sets], kinds[2]), pa.array([d[0] for d in digests], kinds[3]),
                                              pa.array([d[1] for d in digests], kinds[4]), pa.array([count_vector(s).tobytes() if len(s) else None for s in sets], kinds[5])], names)
            for s, d in zip(sets, digests):
                if len(s) and d not in seen:
                    seen.add(d)
                    held.append(s)
                    rows += len(s)
            if rows > COUNT_ROWS:
                yield frequent()
                held, rows = [], 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, "kind int, doc_id long, n long, h1 long, h2 long, vec binary")


def in_reach(t: np.ndarray, n: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Which postings, sorted by token and size, have a partner on their route: another one whose size and rest allow a link."""
    group = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]])).astype(np.int64) << 32
    keep = np.arange(len(t))
    for _ in range(2):  # the first sweep may leave others alone
        g, size, rest = group[keep], n[keep].astype(np.int64), r[keep].astype(np.int64)
        key = g + size
        low = -(-PERCENT * size // 100)
        high = np.minimum(100 * size // PERCENT, (100 + PERCENT) * rest // PERCENT - size)
        others = np.searchsorted(key, g + np.maximum(high, 0), "right") - np.searchsorted(key, g + low) - ((low <= size) & (size <= high))
        keep = keep[others > 0]
    out = np.zeros(len(t), bool)
    out[keep] = True
    return out


def _routes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int, parts: int) -> DataFrame:
    """(token, doc_id, n, rest) of every prefix shingle that two documents in reach of each other share; rest: shingles from it on, in the common order."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(frequent)

    def send(batches):
        values, counts = told.value
        seen, tokens, owners, sizes, rests, rows = set(), [], [], [], [], 0

        def packed():
            t, d, n, r = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes), np.concatenate(rests)
            hot = np.zeros(len(t), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, t), len(values) - 1)
                many = (values[at] == t) & (counts[at] > PART_ROWS)
                hot[many] = 1 + (mix64(d[many].astype(np.uint64)) % np.maximum(1, counts[at[many]] // PART_ROWS + 1).astype(np.uint64)).astype(np.int64)
            key = (mix64(t) % np.uint64(buckets)).astype(np.int64) * parts + hot % parts
            order = np.argsort(key, kind="stable")
            key, t, d, n, r = key[order], t[order], d[order], n[order], r[order]
            cuts = np.flatnonzero(np.diff(key)) + 1
            firsts = np.concatenate([[0], cuts])
            column = lambda x: pa.array([p.tobytes() for p in np.split(x, cuts)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(key[firsts], pa.int64()), column(t), column(d), column(n), column(r)], ["part", "t", "d", "n", "r"])

        for step in steps(batches, "text", STEP):
            for doc_id, s in zip(step.column(0).to_pylist(), shingle_sets(step.column(1))):
                if not len(s) or (d := set_digest(s)) in seen:
                    continue
                seen.add(d)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    rank = np.where(values[at] == s, counts[at], 0)
                    s_ = s[np.argsort(rank, kind="stable")[: prefix_size(len(s))]]
                else:
                    s_ = s[: prefix_size(len(s))]
                tokens.append(s_)
                owners.append(np.full(len(s_), doc_id, np.int64))
                sizes.append(np.full(len(s_), len(s), np.int32))
                rests.append(np.arange(len(s), len(s) - len(s_), -1, dtype=np.int32))
                rows += len(s_)
            if rows > PACK_ROWS:
                yield packed()
                tokens, owners, sizes, rests, rows = [], [], [], [], 0
        if rows:
            yield packed()

    def meet(key, frame):
        t = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["t"]])
        d = np.concatenate([np.frombuffer(x, np.int64) for x in frame["d"]])
        n, r = (np.concatenate([np.frombuffer(x, np.int32) for x in frame[c]]) for c in "nr")
        order = np.lexsort((n, t))
        t, d, n, r = t[order], d[order], n[order], r[order]
        same = in_reach(t, n, r)
        if len(values_ := told.value[0]):  # a split route may have its other documents in another part
            at = np.minimum(np.searchsorted(values_, t), len(values_) - 1)
            same |= (values_[at] == t) & (told.value[1][at] > PART_ROWS)
        import pandas as pd

        return pd.DataFrame({"token": t[same].astype(np.int64), "doc_id": d[same], "n": n[same].astype(np.int64), "rest": r[same].astype(np.int64)})

    sent = docs.mapInArrow(send, "part long, t binary, d binary, n binary, r binary")
    return sent.groupBy("part").applyInPandas(meet, "token long, doc_id long, n long, rest long")


def _bounded(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose count vectors (doc_id, n, vec) leave room for a link."""
    for side in ("a", "b"):
        pairs = pairs.join(points.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("vec").alias(f"v{side}")), side)

    def run(batches):
        for batch in batches:
            a, b, na, va, nb, vb = (batch.column(k).to_pylist() for k in range(6))
            keep = [may_link(np.frombuffer(v, np.uint8), np.frombuffer(w, np.uint8), n, m) for n, v, m, w in zip(na, va, nb, vb)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, keep) if k], pa.int64()), pa.array([x for x, k in zip(b, keep) if k], pa.int64())], ["a", "b"])

    return pairs.select("a", "b", "na", "va", "nb", "vb").mapInArrow(run, "a long, b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets link, as (u, v).  Groups of a's partners are split."""
    pairs = stage(pairs, "ngram-pairs")
    salted = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_ROWS).alias("salts")), "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    many = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    one = salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    checks = stage(many.unionByName(one), "ngram-checks")
    if checks.count() <= MOST_CHECKS:
        checks = F.broadcast(checks)
    else:
        docs = picked(docs, stage(checks.select("doc_id").distinct(), "ngram-ids"))

    def run(batches):
        current, own = None, []
        for step in steps(batches, "text", STEP):
            found = []
            for a, salt, role, doc_id, s in zip(*(step.column(k).to_pylist() for k in range(4)), shingle_sets(step.column(4))):
                if (a, salt) != current:
                    current, own = (a, salt), []
                if role == 0:
                    own.append(s)
                elif any(linked(s, p) for p in own if enough(min(len(s), len(p)), len(s), len(p))):
                    found.append((a, doc_id))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])

    met = docs.join(checks, "doc_id").select("a", "salt", "role", "doc_id", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return stage(met.mapInArrow(run, "u long, v long"), "ngram-links")


def _blocks(runs: DataFrame, bytes_) -> DataFrame:
    """Routes dealt into pairs (i, j) of blocks with few rows and bytes; ``mine`` is the block of a document."""
    blocks = runs.groupBy("token").agg(F.ceil(F.greatest(F.count("*") / TREE_ROWS, F.sum(bytes_) / BLOCK_BYTES)).alias("blocks"))
    rows = runs.join(blocks, "token").withColumn("mine", F.pmod(F.xxhash64("doc_id"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    return rows.select("token", "i", "j", "mine", "doc_id", "component_id", "n", "rest")


def _grouped(steps_):
    """Rows of equal (token, i, j), gathered over the steps: pairs of the key and its rows without the key."""
    key, held = None, []
    for columns in steps_:
        for t, i, j, *rest in zip(*columns):
            if (t, i, j) != key:
                if len(held) > 1:
                    yield key, held
                key, held = (t, i, j), []
            held.append(rest)
    if len(held) > 1:
        yield key, held


def _searched(runs: DataFrame) -> DataFrame:
    """Routes (token, doc_id, n, rest, component_id) on which a tree may find a link between components."""
    # a partner has the least size of the route at least, and PERCENT of one's own
    least = runs.groupBy("token").agg(F.min("n").alias("least"))
    partner = F.greatest(F.col("least").cast("double"), F.col("n") * (PERCENT / 100))
    runs = runs.join(least, "token").where((100 + PERCENT) * F.col("rest") >= PERCENT * (F.col("n") + partner) - 1e-6)
    # linked sets differ in size by 100 / PERCENT at most, so a partner is in the same class of sizes or the next one
    runs = runs.withColumn("class", F.floor(F.log("n") / math.log(100 / PERCENT)))
    places = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class")
    sizes = runs.groupBy("token", "class").agg(F.count("*").alias("m")).select("token", "m", places).groupBy("token", "class").agg(F.sum("m").alias("m")).where("m > 1")
    runs = runs.join(sizes.select("token", "class"), ["token", "class"], "left_semi")
    facts = runs.groupBy("token").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("s1"),
                                      F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("s2"), F.sum("rest").alias("rests")).where("low <> high")
    first = stage(facts.groupBy("m", "s1", "s2").agg(F.max_by("token", "rests").alias("token")).select("token"), "ngram-first")
    return stage(runs.join(first, "token", "left_semi").select("token", "doc_id", "component_id", "n", "rest"), "ngram-searched")


def _fine(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, n and finer vec of the documents of the given routes; only the vectors move."""
    def run(batches):
        for step in steps(batches, "text", STEP):
            sets = shingle_sets(step.column(1))
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([count_vector(s, FINE_SIZE, FINE_GROUPS).tobytes() for s in sets], pa.binary())], ["doc_id", "n", "vec"])

    texts = picked(docs, stage(runs.select("doc_id").distinct(), "ngram-ids"))
    return stage(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, vec binary").dropDuplicates(), "ngram-fine")


def _named(points: DataFrame, runs: DataFrame, most: int = MOST_GROUPS) -> DataFrame:
    """By the trees' count vectors: kind 0, pairs (a, b) that points name; kind 1, (token, doc_id) = (a, b) with further pairs."""
    rows = _blocks(runs, F.least(F.col("n") * (2 if most > MOST_GROUPS else 1), F.lit(most)))
    rows = rows.join(points.select("doc_id", "n", "vec"), ["doc_id", "n"]).select("token", "i", "j", "mine", "doc_id", "component_id", "n", "rest", "vec")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def run(batches):
        for key, held in _grouped(([c.to_pylist() for c in step.columns] for step in steps(batches, "vec", STEP))):
            mine, ids, components_, sizes, rests, vectors = zip(*held)
            left = np.array(mine) if key[1] != key[2] else np.full(len(held), -1)
            pairs, more = named_pairs([np.frombuffer(v, np.uint8) for v in vectors], np.array(sizes), np.array(rests), np.array(components_), left)
            kinds = [0] * len(pairs) + [1] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([ids[k] for k, _ in pairs] + [key[0]] * len(more), pa.int64()),
                                              pa.array([ids[j] for _, j in pairs] + [ids[k] for k in more.tolist()], pa.int64())], ["kind", "a", "b"])

    return stage(rows.mapInArrow(run, "kind int, a long, b long").distinct(), "ngram-named")


def _trees(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Links (u, v) between components that the trees of the given routes find, verified where they are found."""
    rows = stage(_blocks(runs, F.col("n") * 8), "ngram-left")
    texts = picked(docs, stage(rows.select("doc_id").distinct(), "ngram-ids"))
    rows = rows.join(texts, "doc_id").select("token", "i", "j", "mine", "doc_id", "component_id", "rest", "text").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def run(batches):
        for key, held in _grouped(([c.to_pylist() for c in step.columns[:7]] + [shingle_sets(step.column(7))] for step in steps(batches, "text", STEP))):
            left = np.array([h[0] if key[1] != key[2] else -1 for h in held])
            found = tree_links([h[1] for h in held], [h[4] for h in held], np.array([h[3] for h in held]), [h[2] for h in held], left)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])

    return stage(rows.mapInArrow(run, "u long, v long").distinct(), "ngram-links")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = identified(docs, "doc_id", "text")
    digests = stage(_digests(rows), "ngram-digests")
    points = digests.where("kind = 0").drop("kind", "vec")
    top = digests.where("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h1").limit(MOST_FREQUENT).toPandas()
    values, counts = top["h1"].to_numpy(np.int64).astype(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(values)
    frequent = (values[order], counts[order])
    total = points.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, total // (4 * PART_ROWS) + 1) * 4
    parts = int(counts.max() // PART_ROWS + 2) if len(counts) else 2
    routes = stage(_routes(rows, frequent, buckets, parts), "ngram-routes")
    # one member stands for each class of equal sets
    classes = points.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    member = stage(points.where("n > 0").join(classes, ["n", "h1", "h2"]).select("doc_id", "rep"), "ngram-members")

    # rows that share an id may have several sets
    vectors = stage(digests.where("kind = 0 AND n > 0").dropDuplicates(["doc_id", "n", "h1", "h2"]).select("doc_id", "n", "vec"), "ngram-vectors")

    def representatives(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(member.select(F.col("doc_id").alias(side), F.col("rep").alias(f"r{side}")), side)
        return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()

    ids = stage(member.select("doc_id").distinct(), "ngram-nodes")
    links, known = member.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), None

    def joined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = links.unionByName(found)
        roots = components(more, "ngram-components")
        return more, stage(ids.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")), "ngram-known")

    for number in range(STAR_ROUNDS + 1):
        placed = routes.join(known, "doc_id") if number else routes.withColumn("component_id", F.col("doc_id"))
        open_ = placed.groupBy("token").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.min(F.struct(F.xxhash64("doc_id", F.pmod("token", F.lit(1 + 3 * number))).alias("x"), "doc_id", "n", "rest", "component_id")).alias("p")).where("low <> high")
        if number:
            open_ = stage(open_, "ngram-open")
        if number < STAR_ROUNDS:
            # later rounds try several pivots, by the token, where documents share several routes
            star = placed.join(open_.select("token", "p"), "token").where("p.component_id <> component_id").where((100 + PERCENT) * F.least("rest", "p.rest") >= PERCENT * (F.col("n") + F.col("p.n")))
            pairs = representatives(star.select(F.col("p.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct())
            links, known = joined(_verified(rows, _bounded(vectors, pairs)))
    searched = _searched(placed.join(open_.select("token"), "token", "left_semi").select("token", "doc_id", "n", "rest", "component_id"))
    for fine in (False, True):
        named = _named(_fine(rows, searched), searched, FINE_GROUPS) if fine else _named(vectors, searched)
        links, known = joined(_verified(rows, representatives(named.where("kind = 0").select("a", "b"))))
        # points with further pairs, where components still meet
        left = searched.drop("component_id").join(named.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("doc_id")), ["token", "doc_id"], "left_semi").join(known, "doc_id")
        open_ = left.groupBy("token").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).where("low <> high")
        left = stage(left.join(open_.select("token"), "token", "left_semi").select("token", "doc_id", "component_id", "n", "rest"), "ngram-further")
        if left.isEmpty():
            break
        searched = left
    if not left.isEmpty():
        links, known = joined(_trees(rows, left))
    return points.select("doc_id", F.col("n").alias("n_shingles")).join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones, with all columns: the one with the smallest id.

    A row without an id cannot be linked to and stays.  Of rows that repeat an id and its text one stays.
    """
    lead = join(docs).where("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__m"))
    lead = stage(lead, "ngram-leads")
    id_ = docs["doc_id"]
    single = docs.join(lead.where("__m = 1"), id_ == F.col("__id"), "left_semi")
    repeated = docs.join(lead.where("__m > 1"), id_ == F.col("__id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).unionByName(docs.where(id_.isNull()))

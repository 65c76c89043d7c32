"""Embedding near-duplicates over a product-quantised inverted index.

Vectors of one label and equal components are one class.  Classes, scaled to length one, live in the
inverted list of their nearest coarse centroid and are coded by the product quantiser of their residual.
A query is looked up in every list that can hold a partner: with radius r = sqrt(2 - 2 * LEAST), a vector
within r of q has centroid c as its nearest only if d(q,c)^2 - d(q,e)^2 <= 2 r d(c,e) for every centroid e;
this is tried for the RIVALS nearest to q.
In a list, table look-ups give the asymmetric distance to every code; a vector stays when that is within
r plus the vector's own coding error.  Both bounds are exact, so probes are sufficient and no pair is
lost; the exact cosine of the stored doubles decides.

Centroids and codebooks are fitted on at most ``SAMPLE`` classes, chosen by hash; every row is indexed.
Long lists are split into blocks of ``BLOCK_ROWS`` members, their queries into parts of ``QUERY_ROWS``; each
block meets each part by itself, so no group grows with the table.  The part's queries pass by the members in
slices of ``SLICE_ROWS``.  A task reports, for each query, how many vectors it links to and one of them, and
for each member the root of its local component, never the pairs.

Defined results: a null label, a null or empty vector, one of length zero or with a null or non-finite
component links with nothing and is kept; vectors of different dimension do not link; equal rows link
with each other; rows that share an id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage
from .common import identified
from .components import components

LEAST = 0.98
#: classes that the index is fitted on, at most
SAMPLE = 8192
#: subspaces, codes of each, and rounds of fitting
SUBSPACES, CODES, ROUNDS = 8, 64, 8
MOST_LISTS, BLOCK_ROWS = 1024, 1024
#: queries that meet a block in one group, and those of them that a task holds at a time
QUERY_ROWS, SLICE_ROWS = 16384, 256
#: vector components compared at a time
PAIR_VALUES = 1 << 22
#: centroids that a list is compared with before it is probed
RIVALS = 32
SEED = 7


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centers)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


class Index:
    """Coarse centroids and codebooks, padded to a multiple of the subspaces."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng = np.random.default_rng(SEED)
        self.width = sample.shape[1]
        self.coarse = _k_means(sample, lists, rng)
        residual = sample - self.coarse[_nearest(sample, self.coarse)]
        self.parts = np.array_split(np.arange(self.width), min(SUBSPACES, self.width))
        self.books = [_k_means(residual[:, p], CODES, rng) for p in self.parts]
        self.between = np.sqrt(np.maximum(0, (self.coarse**2).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * self.coarse @ self.coarse.T))

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of one dimension, scaled to length one and padded."""
        out = np.zeros((len(vectors), self.width))
        out[:, : vectors.shape[1]] = vectors
        top = np.abs(out).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        out /= top
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector."""
        own = _nearest(u, self.coarse)
        residual = u - self.coarse[own]
        codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        rebuilt = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return own, codes, np.linalg.norm(residual - rebuilt, axis=1)

    def probes(self, u: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists that can hold a vector within the radius: no other centroid may be too much nearer, tried for the nearest ones."""
        d = (u**2).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * u @ self.coarse.T
        near = np.argsort(d, axis=1)[:, :RIVALS]
        fits = np.ones(d.shape, bool)
        for k in range(near.shape[1]):
            c = near[:, k]
            fits &= d - d[np.arange(len(u)), c][:, None] <= 2 * radius * self.between[c] + 1e-9
        return [np.flatnonzero(row) for row in fits]

    def distances(self, u: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of a list, by one table for each subspace."""
        residual, out = u - self.coarse[at], np.zeros((len(u), len(codes)))
        for m, (p, b) in enumerate(zip(self.parts, self.books)):
            r = residual[:, p]
            table = (r**2).sum(1)[:, None] + (b**2).sum(1) - 2 * r @ b.T
            out += table[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def _table(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(data).view(kind).reshape(len(column), -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable number of each of n nodes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Block:
    """The members of a block of a list.  Queries pass by in slices; only what is known of the members is kept."""

    def __init__(self, index: Index, at: int, ids, copies, units, codes, errors, least: float, radius: float):
        self.index, self.at, self.ids, self.copies, self.units, self.codes = index, at, ids, copies, units, codes
        self.reach, self.least, self.root = radius + errors + 1e-6, least, np.arange(len(ids))

    def ask(self, ids: np.ndarray, units: np.ndarray):
        """(id, vectors linked to, one of them) of the queries that link to a member."""
        a, b = np.nonzero(self.index.distances(units, self.at, self.codes) <= self.reach)
        other = ids[a] != self.ids[b]
        a, b = a[other], b[other]
        step = max(1, PAIR_VALUES // units.shape[1])
        hit = np.concatenate([np.einsum("ij,ij->i", units[a[s : s + step]], self.units[b[s : s + step]]) >= self.least for s in range(0, len(a), step)] or [np.zeros(0, bool)])
        a, b = a[hit], b[hit]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, self.copies[b])
        who, first, place = np.unique(a, return_index=True, return_inverse=True)
        lead = b[first]
        # members that one query links to are one component; what is known so far stays linked through its root
        self.root = _roots(len(self.ids), np.concatenate([lead[place], np.arange(len(self.ids))]), np.concatenate([b, self.root]))
        return ids[who], links[who], self.ids[lead]

    def own(self):
        """(id, 0, root) of the members that hang on another one."""
        k = np.flatnonzero(self.root != np.arange(len(self.ids)))
        return self.ids[k], np.zeros(len(k), np.int64), self.ids[self.root[k]]


def _dealt(placed: DataFrame) -> DataFrame:
    """Members and queries of each list, dealt so that any two meet in one (block, asks) and no such group grows with the table."""
    where = ["label", "dim", "list"]
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = placed.drop("codes", "error", "list").withColumn("list", F.explode("probes"))
    parts = (placed.groupBy(*where).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
             .join(asks.groupBy(*where).agg(F.ceil(F.count("*") / QUERY_ROWS).alias("parts")), where))
    members = placed.join(parts, where).withColumn("block", part(0, F.col("blocks"))).withColumn("asks", each("parts"))
    asks = asks.join(parts, where).withColumn("asks", part(1, F.col("parts"))).withColumn("block", each("blocks"))
    columns = [*where, "block", "asks", "id", "copies", "v"]
    return members.select(*columns, "codes", "error", F.lit(True).alias("member")).unionByName(asks.select(*columns, F.lit(b"").alias("codes"), F.lit(0.0).alias("error"), F.lit(False).alias("member")))


def link(embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = embeddings.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    rows = identified(embeddings, "vec_id", "embedding", "label")
    v = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.select("vec_id", "label", v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    good = rows.where("fine")
    key = ["label", "h1", "h2"]
    # a class is a label and a vector; its vector comes with its smallest member
    classes = stage(good.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.max_by("v", -F.col("vec_id")).alias("v")), "pq-classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = [r[0] for r in classes.orderBy(F.xxhash64("h1"), "id").limit(SAMPLE).select("v").collect()]
    empty = Index.__new__(Index)
    empty.width = width
    index = Index(np.concatenate([empty.unit(np.array([v for v in sample if len(v) == d])) for d in sorted(set(map(len, sample)))]), max(1, min(MOST_LISTS, int(n**0.5))))
    kind = "<f4" if embeddings.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    told = spark.sparkContext.broadcast(index)

    def place(batches):
        ix = told.value
        for batch in batches:
            dims, vectors = np.array(batch.column(1).to_pylist()), batch.column(2)
            for d in np.unique(dims):  # rows of one dimension at a time
                at = np.flatnonzero(dims == d)
                raw = np.array([vectors[int(k)].as_py() for k in at], np.float64)
                u = ix.unit(raw)
                own, codes, errors = ix.encode(u)
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary()), rows.column(3), rows.column(4), pa.array(own, pa.int32()),
                                                  pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.float64()), pa.array([p.tolist() for p in ix.probes(u, own, radius)], pa.list_(pa.int32()))],
                                                 ["label", "dim", "v", "id", "copies", "list", "codes", "error", "probes"])

    facts = classes.select(F.xxhash64("label").alias("label"), F.size("v").alias("dim"), "v", "id", "copies")
    placed = stage(facts.mapInArrow(place, "label long, dim int, v binary, id long, copies long, list int, codes binary, error double, probes array<int>"), "pq-placed")
    order = ["label", "dim", "list", "block", "asks"]

    def meet(batches):
        """A stream of rows sorted by label, dimension, list, block and part of the queries, members first."""
        ix = told.value
        key, held, block = None, [], None

        def begun():
            return _Block(ix, key[2], *(np.concatenate(x) for x in zip(*held)), least, radius)

        def told_of(found):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2, 3, 4, 10)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if (now := tuple(keys[a, :5].tolist())) != key:
                    if block:
                        yield told_of(block.own())
                    key, held, block = now, [], None
                for s in range(a, b, SLICE_ROWS):
                    part = batch.slice(s, min(b - s, SLICE_ROWS))
                    ids, units = part.column(5).to_numpy(), ix.unit(_table(part.column(7), kind))
                    if keys[a, 5]:
                        held.append((ids, part.column(6).to_numpy(), units, _table(part.column(8), "u1"), part.column(9).to_numpy()))
                    elif held or block:
                        if not block:
                            block, held = begun(), []
                        yield told_of(block.ask(ids, units))
        if block:
            yield told_of(block.own())

    met = _dealt(placed).select(*order, "id", "copies", "v", "codes", "error", "member").repartition(*order).sortWithinPartitions(*order, F.col("member").desc())
    found = stage(met.mapInArrow(meet, "id long, links long, root long"), "pq-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = good.join(classes.select(*key, "id", "copies"), key).select("vec_id", "id", "copies")
    edges = found.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(member.select(F.col("vec_id").alias("u"), F.col("id").alias("v")))
    roots = components(edges, "pq-components").withColumnRenamed("id", "vec_id")
    counted = member.join(links, "id", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    lonely = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = counted.unionByName(lonely).join(roots, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))

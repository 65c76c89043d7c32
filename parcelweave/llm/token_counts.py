"""Token counts with overlap resynchronisation for huge documents.

Texts up to ``chunk_chars`` are encoded whole, in batches, word by word through a bounded store.  Longer ones are cut into chunks that
overlap; each chunk is encoded on its own, with offsets, as a row of its own, so one huge document
spreads over many tasks.  Two neighbours are spliced at a boundary inside their overlap that is proven
stable: the character before it is white space (no token of the vocabulary crosses white space, and
neither normalisation nor the split into words looks past it), the last one of that kind whose
following tokens both chunks agree on to the end of the overlap.  Where a pair finds none, the overlap
is widened and the document encoded again, until all its pairs agree or one chunk holds the text.

Defined results: a null or empty text has 0 bytes and 0 tokens; equal rows give equal results; special
strings inside a text count as the library's default does; a text without any white space ends up
encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage
from .common import identified, steps, text_or_empty

#: longer texts are cut into chunks of this many code points
CHUNK_CHARS = 1 << 16
#: code points that two neighbouring chunks share at first, and the factor that widens them
OVERLAP_CHARS = 256
WIDEN = 16
#: tokens above which a document is over the limit
TOKEN_LIMIT = 2048
# fixed value: white space that every normaliser and pattern of the vocabulary treats as such
SPACES = " \n\t\r"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


KEY = ["doc_id", "hash", "n"]
CHUNK = "doc_id long, hash long, n long, k long, at long, piece string"
SUMMARY = ("doc_id long, hash long, n long, k long, tokens long, head_at array<long>, head_id array<long>, "
           "tail_at array<long>, tail_id array<long>, stable array<long>, cut long")


def chunks(text: str, chunk: int, overlap: int):
    """(number, start, piece) of the overlapping chunks of a text; one chunk when the overlap holds it all."""
    n = len(text)
    if overlap >= n:
        yield 0, 0, text
        return
    for k, at in enumerate(range(0, n, chunk)):
        yield k, at, text[at : at + chunk + overlap]
        if at + chunk + overlap >= n:  # a further one would lie inside it
            return


def summarise(tokenizer, n: int, at: int, piece: str, chunk: int, overlap: int) -> tuple:
    """Tokens of a chunk: their number, those in the overlaps with its neighbours, and the stable places of the later one."""
    found = tokenizer.encode(piece, add_special_tokens=False)
    tokens = [(s + at, i) for (s, _), i in zip(found.offsets, found.ids)]
    head = [x for x in tokens if x[0] < at + overlap] if at else []
    zone = at + chunk
    last = at + len(piece) >= n
    tail = [] if last else [x for x in tokens if x[0] >= zone]
    stable = [] if last else [zone + j + 1 for j, c in enumerate(piece[chunk:]) if c in SPACES]
    cut = max(stable, default=-1)
    return len(tokens), *map(list, zip(*head) if head else ([], [])), *map(list, zip(*tail) if tail else ([], [])), stable, cut


def splice(tail: list[tuple[int, int]], head: list[tuple[int, int]], stable: list[int], cut: int) -> int | None:
    """The first stable place from which both chunks have the same tokens, at least one, up to ``cut``, or None.

    What lies behind ``cut`` belongs to a word that the earlier chunk cuts, and is the later one's.
    """
    tail, head = [x for x in tail if x[0] < cut], [x for x in head if x[0] < cut]
    same = 0
    while same < min(len(tail), len(head)) and tail[-1 - same] == head[-1 - same]:
        same += 1
    if not same:
        return None
    parted = max((x[-1 - same][0] for x in (tail, head) if len(x) > same), default=-1)
    return next((p for p in stable if parted < p <= tail[-1][0]), None)


def _huge(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, hash, n, n_tokens (null where some pair of chunks did not align) for each distinct huge text."""
    def cut(batches):
        for batch in batches:
            for doc_id, hashed, n, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for k, at, piece in chunks(text, chunk, overlap):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "hash": hashed, "n": n, "k": k, "at": at, "piece": piece}])

    def encode(batches):
        tokenizer = load_tokenizer(path)
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            found = list(zip(*(summarise(tokenizer, n, at, piece, chunk, overlap) for n, at, piece in zip(cols[2], cols[4], cols[5]))))
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.int64()]
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, t) for c, t in zip(found, kinds))],
                                                 ["doc_id", "hash", "n", "k", "tokens", "head_at", "head_id", "tail_at", "tail_id", "stable", "cut"])

    def align(batches):
        for batch in batches:
            r = batch.to_pydict()
            places, drops = [], []
            for ta, ti, st, ct, ha, hi in zip(*(r[c] for c in ("tail_at", "tail_id", "stable", "cut", "next_at", "next_id"))):
                p = splice(list(zip(ta, ti)), list(zip(ha, hi)), st, ct)
                places.append(int(p is None))
                drops.append(0 if p is None else sum(x >= p for x in ta) + sum(x < p for x in ha))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(places, pa.int64()), pa.array(drops, pa.int64())],
                                             [*KEY, "failed", "twice"])

    # a given number of tasks is not merged at run time, however few the chunks
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.mapInArrow(cut, CHUNK).repartition(tasks, *KEY, "k")
    done = stage(pieces.mapInArrow(encode, SUMMARY).dropDuplicates([*KEY, "k"]), "token-chunks")
    right = done.select(*KEY, (F.col("k") - 1).alias("k"), F.col("head_at").alias("next_at"), F.col("head_id").alias("next_id"))
    pairs = done.drop("head_at", "head_id", "tokens").join(right, [*KEY, "k"]).select(*KEY, "tail_at", "tail_id", "stable", "cut", "next_at", "next_id")
    twice = pairs.mapInArrow(align, "doc_id long, hash long, n long, failed long, twice long").groupBy(*KEY).agg(F.sum("failed").alias("failed"), F.sum("twice").alias("twice"))
    return (done.groupBy(*KEY).agg(F.sum("tokens").alias("tokens")).join(twice, KEY, "left")
            .select(*KEY, F.when(F.coalesce("failed", F.lit(0)) == 0, F.col("tokens") - F.coalesce("twice", F.lit(0))).alias("n_tokens")))


def count(docs: DataFrame, tokenizer_path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
          limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    path = tokenizer_path or default_path()

    def small(batches):
        from .word_ids import word_ids

        coder = word_ids(path, terms=False)
        for step in steps(batches, "text"):
            _, offsets, _, _ = coder.encode(step.column(1))
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pc.binary_length(step.column(1)).cast(pa.int64()), pa.array(np.diff(offsets), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    rows = identified(docs, "doc_id", text_or_empty().alias("text"))
    whole = rows.where(F.length("text") <= chunk_chars).mapInArrow(small, "doc_id long, n_bytes long, n_tokens long")
    huge = rows.where(F.length("text") > chunk_chars).select("doc_id", F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("n"), "text")
    left, overlap, counted = huge, overlap_chars, None
    while True:  # a further round only for documents that did not align; the last one holds whole texts
        found = stage(_huge(left, path, chunk_chars, overlap), "token-huge")
        good = found.where(F.col("n_tokens").isNotNull())
        counted = good if counted is None else counted.unionByName(good)
        if found.where(F.col("n_tokens").isNull()).isEmpty():
            break
        left = huge.join(found.where(F.col("n_tokens").isNull()).select(*KEY), KEY, "left_semi").select("doc_id", "hash", "n", "text")
        overlap *= WIDEN
    sizes = huge.select(*KEY, F.octet_length("text").cast("long").alias("n_bytes"))
    spliced = sizes.join(counted, KEY).select("doc_id", "n_bytes", "n_tokens")
    return whole.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)

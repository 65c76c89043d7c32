"""Lexical retrieval packing: windows of tokens filled with related documents.

Documents are dealt by hash to shards of about ``SHARD_ROWS``; each shard is one BM25 inverted index over
its documents' words (statistics are the shard's own, as usual for sharded search).  A seed document asks
the index for unused neighbours, best first, and they fill its window of ``WINDOW`` tokens; the document
that no longer fits is cut and its rest seeds the next window, so a window is only short when its shard
is used up.  What is left then is cut into sequences whose lengths are powers of two: no padding at all.

Ids come from the vocabulary's own library, word by word through a bounded store.

Defined results: a null or empty text is the single end id; equal rows are packed each for itself; an
empty table gives an empty result; a document longer than a window fills several.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, steps, text_or_empty
from .token_counts import default_path
from .word_ids import word_ids

WINDOW = 4096
END_ID = 2
SHARD_ROWS = 512
#: BM25
K1, B = 1.2, 0.75
#: bytes of text whose words are looked up at a time, whole shards at least; encoding takes about ten times as much
STEP = 2 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ShardIndex:
    """BM25 postings of one shard, from the word numbers of its documents."""

    def __init__(self, words: list[np.ndarray]):
        n = len(words)
        doc = np.repeat(np.arange(n), [len(t) for t in words])
        names, terms = np.unique(np.concatenate(words), return_inverse=True)
        pair, count = np.unique(terms * n + doc, return_counts=True)
        term, doc = pair // n, pair % n
        length = np.array([len(t) for t in words], float)
        df = np.bincount(term, minlength=len(names))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, length.mean()))
        weight = idf[term] * count * (K1 + 1) / (count + norm[doc])
        shared = df[term] > 1  # a term of one document retrieves nothing
        term, doc, weight = term[shared], doc[shared], weight[shared]
        self.n, self.doc, self.weight = n, doc, weight
        self.at = np.searchsorted(term, np.arange(len(names) + 1))
        by_doc = np.argsort(doc, kind="stable")
        self.terms, self.terms_at = term[by_doc], np.searchsorted(doc[by_doc], np.arange(n + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents of the shard, by falling score for the seed's words."""
        terms = self.terms[self.terms_at[seed] : self.terms_at[seed + 1]]
        first, size = self.at[terms], self.at[terms + 1] - self.at[terms]
        skip = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(terms) else np.zeros(0, np.int64)
        at = np.arange(len(skip)) + skip
        scores = np.bincount(self.doc[at], self.weight[at], self.n)
        return np.argsort(-scores, kind="stable")


def fill(sizes: list[int], neighbours) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of one shard."""
    pieces, unused, room, sequence = [], np.array([s > 0 for s in sizes]), WINDOW, 0
    left = int(sum(sizes))
    tail = left % WINDOW
    full = left - tail  # so many tokens go to full windows, the rest to powers of two
    spans = [WINDOW] * (full // WINDOW) + [1 << k for k in range(11, -1, -1) if tail >> k & 1]
    order, at, offset = np.zeros(0, np.int64), 0, 0
    room = spans[0] if spans else 0
    current, start, next_seed = None, 0, 0
    while sequence < len(spans):
        if current is None:
            if offset == 0 or at >= len(order):
                while not unused[next_seed]:
                    next_seed += 1
                current, order, at = next_seed, neighbours(next_seed), 0
            else:
                while at < len(order) and not unused[order[at]]:
                    at += 1
                if at >= len(order):
                    continue
                current = int(order[at])
            unused[current], start = False, 0
        elif offset == 0 and start:
            order, at = neighbours(current), 0  # the rest of a cut document is the seed of its window
        take = min(room - offset, sizes[current] - start)
        pieces.append((current, start, take, sequence, offset))
        offset, start = offset + take, start + take
        if start == sizes[current]:
            current = None
        if offset == room:
            sequence, offset = sequence + 1, 0
            room = spans[sequence] if sequence < len(spans) else 0
    return pieces


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer_path or default_path()
    rows = identified(docs, "doc_id", text_or_empty().alias("text"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "text")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        """A stream of rows sorted by shard and id; words are looked up for several shards at once."""
        coder = word_ids(path)

        def emit(table):
            ids, at, terms, terms_at = coder.encode(table.column(2).combine_chunks())
            at, terms_at = at.tolist(), terms_at.tolist()
            shards, doc_ids = table.column(0).to_numpy(), table.column(1).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for low, high in zip(edges, edges[1:]):
                coded = [ids[a:b].astype("<u4").tobytes() + end for a, b in zip(at[low:high], at[low + 1 : high + 1])]
                sizes = [len(c) // 4 for c in coded]
                # numbered as they appear in the shard, whatever the store held before
                own, start = terms[terms_at[low] : terms_at[high]], terms_at[low]
                _, first, name = np.unique(own, return_index=True, return_inverse=True)
                own = np.argsort(np.argsort(first))[name]
                index = ShardIndex([own[a - start : b - start] for a, b in zip(terms_at[low:high], terms_at[low + 1 : high + 1])])
                shard = int(shards[low])
                out = [(doc_ids[low + k], start, length, zlib.crc32(coded[k][4 * start : 4 * (start + length)]), sizes[k], shard << 32 | sequence, offset)
                       for k, start, length, sequence, offset in fill(sizes, index.neighbours)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        held, size = [], 0
        for step in steps(batches, "text", STEP):
            held.append(step)
            size += step.nbytes
            if size > STEP:
                table = pa.Table.from_batches(held)
                shards = table.column(0).to_numpy()
                cut = int(np.searchsorted(shards, shards[-1]))  # the last shard may go on
                if cut:
                    yield from emit(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), sum(b.nbytes for b in table.slice(cut).to_batches())
        if held:
            yield from emit(pa.Table.from_batches(held))

    return rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "text").mapInArrow(run, PIECES)

"""Token ids in binary files, with keyed access through a minimal perfect hash.

Files below one folder, all written by Spark's committed writers, so a lost or repeated task leaves none
twice, and read by Spark's readers, so the folder may lie in any store:

* ``ids/``: shards in ascending doc_id order.  A shard begins with the raw ids of its documents, end to
  end, unsigned little-endian, 2 bytes each if the vocabulary fits, else 4.  Behind them stand, padded to
  8 bytes, its documents' ids and numbers of tokens (64 bits each) and a foot of eight 64-bit numbers
  (magic, bytes of an id, ids, documents, documents without a doc_id, part, place within the part, ids of
  the part before it); a line feed ends the file, and a shard without it is torn.
* ``shards/``: a table of the shards: number, file, ids before it, rows before it.
* ``index/``: one perfect hash for each bucket of keys; an entry holds shard, place and length.

A key is (doc_id, copy): rows that share an id are copies 0, 1, ... in the order they are written.  Writing
takes one shuffle of the texts, by ranges of (doc_id, hash of the text); everything else moves a few numbers
for each document.  Shards are cut by bytes while a task streams, so no task holds more than one shard and
one document.

Defined results: a null or empty text is the end id alone; documents without a doc_id come last, are
written, and have no key; rows of one id stand in the order of their texts' hashes, equal ones are
interchangeable; an empty table gives files without ids; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stages import stage
from ..session import checkpoint_dir
from . import perfect_hash
from .common import joined_bytes, steps
from .token_counts import default_path, load_tokenizer
from .word_ids import word_ids

END_ID = 1
#: bytes of text to a partition, and of ids and documents to a shard
PART_BYTES = 32 << 20
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: keys to a bucket of the index
BUCKET_KEYS = 1 << 15
#: copies of one id that are numbered as one block
COPY_BLOCK = 4096
MAGIC = 0x31_53_44_49
FOOT = 8
#: bytes of text encoded at a time
STEP = 4 << 20


def _ended(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id behind each document, and the new offsets."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def pack_shard(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, without: int, width: int, part: int, place: int, before: int) -> bytes:
    raw = ids.astype("<u2" if width == 2 else "<u4").tobytes()
    foot = np.array([MAGIC, width, len(ids), len(doc_ids), without, part, place, before], "<i8")
    return b"".join([raw, bytes(-len(raw) % 8), doc_ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), foot.tobytes()])


def open_shard(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Foot, ids, doc_ids and numbers of tokens of a file's bytes."""
    whole = memoryview(content)
    if len(whole) < 8 * FOOT + 1 or whole[-1] != 10:
        raise ValueError("torn shard")
    foot = np.frombuffer(whole[-1 - 8 * FOOT : -1], "<i8")
    if foot[0] != MAGIC:
        raise ValueError("no shard")
    width, n, docs = (int(x) for x in foot[1:4])
    at = -(-n * width // 8) * 8
    table = np.frombuffer(whole[at : at + 16 * docs], "<i8")
    return foot, np.frombuffer(whole[: n * width], "<u2" if width == 2 else "<u4"), table[:docs], table[docs:]


def _written(df: DataFrame, path: str, rows_to_a_file: int) -> None:
    """The one binary column as files: a row's bytes as they are, and a line feed."""
    df.select(F.col(df.columns[0]).cast("string")).write.option("maxRecordsPerFile", rows_to_a_file).option("compression", "none").mode("error").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "content")


class TokenFiles:
    """A folder of token files: ``write`` makes one, ``lookup``, ``digests`` and ``read`` use it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, end_id: int = END_ID) -> TokenFiles:
        """Encode every document and write shards, shard table and index."""
        spark = docs.sparkSession
        path = path or f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
        vocabulary = tokenizer_path or default_path()
        width = 2 if max(load_tokenizer(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        keyed = rows.withColumns({"none": F.col("doc_id").isNull(), "h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        order = ["none", "doc_id", "h", "row"]

        def shards(batches):
            from pyspark import TaskContext

            part, place, before = TaskContext.get().partitionId(), 0, 0
            coder = word_ids(vocabulary, terms=False)
            held: list[tuple] = []  # (ids, doc_ids, sizes, without)
            n_ids = n_docs = 0

            def flush():
                nonlocal place, before, held, n_ids, n_docs
                ids, doc_ids, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
                out = pack_shard(ids, doc_ids, sizes, sum(x[3] for x in held), width, part, place, before)
                place, before, held, n_ids, n_docs = place + 1, before + len(ids), [], 0, 0
                return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["shard"])

            for step in steps(batches, "text", STEP):
                ids, offsets, _, _ = coder.encode(step.column(1))
                ids, offsets = _ended(ids, offsets, end_id)
                doc_ids = step.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                without = np.asarray(step.column(0).is_null())
                at = 0
                while at < len(doc_ids):  # as many documents as the shard has room for, one at least
                    room = SHARD_BYTES // width - n_ids
                    stop = int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1
                    stop = min(max(stop, at if held else at + 1), at + SHARD_DOCS - n_docs, len(doc_ids))
                    if stop > at:
                        held.append((ids[offsets[at] : offsets[stop]], doc_ids[at:stop], np.diff(offsets[at : stop + 1]), int(without[at:stop].sum())))
                        n_ids, n_docs = n_ids + int(offsets[stop] - offsets[at]), n_docs + stop - at
                    at = stop
                    if at < len(doc_ids):
                        yield flush()
            if held:
                yield flush()

        parts = max(1, -(-total // PART_BYTES))
        dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
        _written(dealt.mapInArrow(shards, "shard binary"), f"{path}/ids", 1)
        made = cls(spark, path)
        made._index(made._places())
        return made

    def _places(self) -> DataFrame:
        """Writes the shard table; returns doc_id (null where there is none), position of the row, shard, place, length."""

        def tables(batches):
            for batch in batches:
                for file, content in zip(*batch.columns):
                    foot, _, doc_ids, sizes = open_shard(content.as_buffer())
                    n, k = len(doc_ids), np.arange(len(doc_ids))
                    same = lambda v: pa.array(np.full(n, v), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file.as_py()] * n, pa.string()), same(foot[5]), same(foot[6]), same(foot[7]), same(foot[2]), pa.array(k),
                         pa.array(doc_ids, pa.int64(), mask=k >= n - int(foot[4])), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes)],
                        ["file", "part", "place", "before", "n_ids", "k", "doc_id", "at", "size"])

        found = stage(_files(self.spark, f"{self.path}/ids").mapInArrow(
            tables, "file string, part long, place long, before long, n_ids long, k long, doc_id long, at long, size long"), "token-places")
        shards = found.groupBy("part", "place").agg(F.min("file").alias("file"), F.min("before").alias("before"), F.min("n_ids").alias("n_ids"), F.count("*").alias("n_rows"))
        # sums over the parts in order: one row for each PART_BYTES of text
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.sum("n_rows").alias("rows"), F.count("*").alias("shards"))
        sums = sums.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("ids", "rows", "shards")))
        inside = F.coalesce(F.sum("n_rows").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shards.join(sums, "part").select((F.col("shards") + F.col("place")).alias("shard"), "file", "part", "place", "n_ids", (F.col("ids") + F.col("before")).alias("ids_before"),
                                         (F.col("rows") + inside).alias("rows_before")).write.mode("error").parquet(f"{self.path}/shards")
        return found.join(self.shards().select("part", "place", "shard", "rows_before"), ["part", "place"]).select(
            "doc_id", (F.col("rows_before") + F.col("k")).alias("position"), "shard", "at", "size")

    def _index(self, places: DataFrame) -> None:
        """One perfect hash for each bucket of keys; rows of an id stand one behind the other, so their copies are numbered from the first."""
        keyed = stage(places.where("doc_id IS NOT NULL"), "token-keys")
        n = max(1, -(-keyed.count() // BUCKET_KEYS))
        several = keyed.groupBy("doc_id").agg(F.min("position").alias("first"), F.count("*").alias("n")).where("n > 1").select("doc_id", "first")
        keyed = keyed.join(several, "doc_id", "left").withColumn("copy", F.coalesce(F.col("position") - F.col("first"), F.lit(0)))

        def build(table: pa.Table) -> pa.Table:
            columns = [c.to_numpy() for c in table.select(["doc_id", "copy", "shard", "at", "size"]).columns]
            content = np.array([table.column("bucket")[0].as_py()], "<i8").tobytes() + perfect_hash.build(*columns[:2], [c.view(np.uint64) for c in columns[2:]])
            return pa.table({"content": pa.array([content], pa.binary())})

        _written(keyed.withColumn("bucket", _bucket(n)).groupBy("bucket").applyInArrow(build, "content binary"), f"{self.path}/index", 1)
        self.spark.range(1).select(F.lit(n).alias("buckets")).write.mode("error").parquet(f"{self.path}/meta")

    def shards(self) -> DataFrame:
        """shard, file, part, place, n_ids, ids_before, rows_before of every shard."""
        return self.spark.read.parquet(f"{self.path}/shards")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """doc_id, copy, shard, at, size of the keys (doc_id, copy) that the index holds."""
        n = self.spark.read.parquet(f"{self.path}/meta").first()[0]
        asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy")).where("doc_id IS NOT NULL AND copy IS NOT NULL")

        def opened(batches):
            for batch in batches:
                for content in batch.column(1):
                    data = content.as_buffer()
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, "<i8", 1)), pa.array([bytes(data[8:-1])], pa.binary())], ["bucket", "content"])

        def find(asked: pa.Table, index: pa.Table) -> pa.Table:
            names = ["doc_id", "copy", "shard", "at", "size"]
            if not index.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in names})
            ids, copies = (asked.column(c).to_numpy() for c in names[:2])
            here, *columns = perfect_hash.Index(index.column("content")[0].as_py()).find(ids, copies)
            return pa.table({c: pa.array(np.asarray(a)[here].astype(np.int64)) for c, a in zip(names, [ids, copies, *columns])})

        index = _files(self.spark, f"{self.path}/index").mapInArrow(opened, "bucket long, content binary")
        return (asked.withColumn("bucket", _bucket(n)).groupBy("bucket").cogroup(index.groupBy("bucket"))
                .applyInArrow(find, "doc_id long, copy long, shard long, at long, size long"))

    def digests(self) -> DataFrame:
        """shard, at, size, doc_id, ids_crc32 of every document, from the ids in the files."""

        def sums(batches):
            for batch in batches:
                for file, content in zip(*batch.columns):
                    foot, ids, doc_ids, sizes = open_shard(content.as_buffer())
                    raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
                    ends = np.cumsum(sizes)
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file.as_py()] * len(crc), pa.string()), pa.array(ends - sizes), pa.array(sizes),
                         pa.array(doc_ids, pa.int64(), mask=np.arange(len(crc)) >= len(crc) - int(foot[4])), pa.array(crc, pa.int64())], ["file", "at", "size", "doc_id", "ids_crc32"])

        found = _files(self.spark, f"{self.path}/ids").mapInArrow(sums, "file string, at long, size long, doc_id long, ids_crc32 long")
        return found.join(self.shards().select("file", "shard"), "file").drop("file")

    def read(self, keys: DataFrame) -> DataFrame:
        """doc_id, copy, ids of the keys that the index holds."""
        wanted = self.lookup(keys).groupBy("shard").agg(F.collect_list(F.struct("doc_id", "copy", "at", "size")).alias("wanted"))  # a shard's documents at most
        wanted = wanted.join(self.shards().select("shard", "file"), "shard").select("file", "wanted")

        def cut(batches):
            for batch in batches:
                for content, some in zip(batch.column(0), batch.column(1).to_pylist()):
                    ids = open_shard(content.as_buffer())[1]
                    for r in some:
                        yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"]], pa.int64()), pa.array([r["copy"]], pa.int64()),
                                                          pa.array([ids[r["at"] : r["at"] + r["size"]].astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "copy", "ids"])

        return _files(self.spark, f"{self.path}/ids").join(wanted, "file").select("content", "wanted").mapInArrow(cut, "doc_id long, copy long, ids array<long>")


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(n)).alias("bucket")


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, copy) of every row with an id; an id that many rows share is numbered in blocks."""
    counted = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    blocks = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPY_BLOCK))).alias("block"))
    first = F.col("block") * COPY_BLOCK
    return blocks.select("doc_id", F.explode(F.sequence(first, F.least(first + COPY_BLOCK, F.col("n")) - 1)).alias("copy"))


def written(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files of ``docs`` and returns, from them and by their keys, doc_id, start, n_tokens, ids_crc32 of every row."""
    files = TokenFiles.write(docs, tokenizer_path=tokenizer_path, end_id=end_id)
    sums = stage(files.digests(), "token-digests")
    found = files.lookup(keys(docs)).select("doc_id", "shard", "at").join(sums.select("shard", "at", "size", "ids_crc32"), ["shard", "at"])
    rest = sums.where("doc_id IS NULL").select("shard", "at", "doc_id", "size", "ids_crc32")
    both = found.select(*rest.columns).unionByName(rest)
    return both.join(files.shards().select("shard", "ids_before"), "shard").select(
        "doc_id", (F.col("ids_before") + F.col("at")).alias("start"), F.col("size").alias("n_tokens"), "ids_crc32")

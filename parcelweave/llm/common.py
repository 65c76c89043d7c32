"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text that one vectorised step inside a task holds at a time (a longer text is a step of its own)
STEP_BYTES = 8 << 20

#: white space of the word definition: blank, tab, line feed, vertical tab, form feed, carriage return
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_kept: dict[str, object] = {}


def kept(name: str, make):
    """What a worker keeps from task to task, of one operator at a time: workers outlive a stage, and the tables of all would add up."""
    if name not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Freed memory for the system: allocators keep it, and a worker that waits for its next task would hold it beside the busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """This package for the executors, once for each application, so tasks can import it wherever they run."""
    root = Path(__file__).resolve().parents[2]
    if spark.sparkContext.applicationId not in _shipped and root.is_dir():
        _shipped.add(spark.sparkContext.applicationId)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/parcelweave", "zip", root, "parcelweave"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def identified(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The named columns only, so further columns never clash.  A row without an id cannot be reported on and is left out."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), *columns)


#: ids told to every task (16 MB), so that documents are picked before they move; above it they meet by a join
MOST_TOLD = 1 << 21


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ``ids`` (distinct, stored); their number decides how."""
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_TOLD else ids, "doc_id", "left_semi")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def steps(batches, column: str, most: int = STEP_BYTES):
    """Slices of record batches with at most ``most`` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            stop = max(stop, at + 1)
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as bytes, and the n+1 offsets; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of the well-known splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

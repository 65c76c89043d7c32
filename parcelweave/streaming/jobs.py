"""Structured Streaming jobs over request, session and timing events."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import checkpoint_dir


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Events of a folder as a stream, time as a zoned timestamp for watermarks."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(df: DataFrame, name: str, mode: str = "append", path: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Process everything available into a table of the shared folder and return it.

    With ``keys`` later batches replace earlier rows of the same key.
    """
    spark = df.sparkSession
    import uuid
    root = path or f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch: a replayed batch overwrites itself
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
         .foreachBatch(write).start())
    q.awaitTermination()
    schema = StructType([*df.schema.fields, StructField("batch", IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{root}/data")
    return latest(rows, keys, "batch").drop("batch") if keys else rows.drop("batch")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key."""
    rest = [c for c in rows.columns if c not in keys and c != version]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r"), F.max(version).alias(version))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], version).select(*rows.columns)


def diagnose_stream(requests: DataFrame, diagnosed: DataFrame, key: str = "pnu") -> DataFrame:
    """Requests enriched with the current diagnosis of their parcel; unknown parcels stay visible."""
    known = diagnosed.withColumn("answered", F.lit(True))
    return requests.join(known, key, "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def dedupe_ttl(stream: DataFrame, keys: list[str], ttl_seconds: int = 900, time: str = "ts", order: str = "event_id", late: str = "10 minutes",
               buckets: int = 4096) -> DataFrame:
    """Events that are answered: the first of a key, and each one at least the time-to-live after the last answered.

    The state of a key is the time of its last answer.  It is dropped once the watermark is past the
    time-to-live, when any event still admitted would be answered anyway: state is bounded by the keys
    answered within ``ttl_seconds`` and ``late``, and the result does not depend on where batches end.
    Events that come more than ``late`` behind the newest of earlier batches, or without a time, are left out.
    Keys are dealt to ``buckets`` by hash, whose keys keep their state together: calling Python for
    each key costs far more than its few events.
    """
    columns = stream.columns

    def update(bucket: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        answered = json.loads(state.get[0]) if state.exists else {}
        frame = pd.concat(list(frames)).sort_values(["__us", order])
        keep = []
        for at, (key, t) in enumerate(zip(frame["__key"].tolist(), frame["__us"].tolist())):
            last = answered.get(key)
            if last is None or t - last >= ttl_seconds * 1_000_000:
                keep.append(at)
                answered[key] = t
        past = state.getCurrentWatermarkMs() * 1000
        state.update((json.dumps({k: t for k, t in answered.items() if t + ttl_seconds * 1_000_000 > past}),))
        state.setTimeoutTimestamp(_after(max(answered.values()), ttl_seconds))
        if keep:
            yield frame[columns].iloc[keep]

    key = F.to_json(F.struct(*keys), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    dealt = _timed(stream, time, late).withColumns({"__key": key, "__bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets))})
    return dealt.groupBy("__bucket").applyInPandasWithState(update, stream.schema, "answered string", "append", "EventTimeTimeout")


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """The stream with a watermark, and its time in microseconds, free of time zones."""
    return stream.withWatermark(time, late).where(F.col(time).isNotNull()).withColumn("__us", F.unix_micros(time))


def _after(last_us: int, seconds: int) -> int:
    """Milliseconds, rounded up, of the moment so many seconds after ``last_us``."""
    return -(-(last_us + seconds * 1_000_000) // 1000)


SESSION_STATE = "active string, last_intent string, parcels string, events long, restored long, last long"
SESSION_OUTPUT = "session long, active string, last_intent string, restored long, parcels long, events long"


def session_state(stream: DataFrame, idle_seconds: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Per-session state: active parcel, last intent, parcels seen, returns to a known parcel.

    ``stream`` holds session, event_id, ts, parcel, intent.  With ``idle_seconds`` a session that was
    silent for longer begins anew, by event time: the state goes when the watermark is past that moment,
    and an event behind such a gap starts from nothing whether or not the state is still there, so
    batches do not matter.  Rows are cumulative: the newest of a session replaces the ones before.
    Events without a time are left out, and with ``idle_seconds`` those more than ``late`` behind.
    """
    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active, intent, parcels, events, restored, last = state.get if state.exists else ("", "", "{}", 0, 0, None)
        context = json.loads(parcels)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for parcel, what, t in zip(rows["parcel"], rows["intent"], rows["__us"].tolist()):
            if idle_seconds is not None and last is not None and t - last > idle_seconds * 1_000_000:
                active, context, events, restored = "", {}, 0, 0
            if parcel != active and parcel in context:
                restored += 1  # back to a parcel seen before: its context applies again
            context[parcel] = what
            active, intent, events, last = parcel, what, events + 1, t if last is None else max(last, t)
        state.update((active, intent, json.dumps(context), int(events), int(restored), last))
        if idle_seconds is not None:
            state.setTimeoutTimestamp(_after(last, idle_seconds))
        yield pd.DataFrame([{"session": key[0], "active": active, "last_intent": intent, "restored": restored,
                             "parcels": len(context), "events": events}])

    timeout = "NoTimeout" if idle_seconds is None else "EventTimeTimeout"
    return _timed(stream, "ts", late).groupBy("session").applyInPandasWithState(update, SESSION_OUTPUT, SESSION_STATE, "append", timeout)


def latency(timings: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Latency per phase and window; the same function serves batch and stream."""
    timed = timings.withWatermark(time, late) if timings.isStreaming else timings
    return (timed.groupBy(F.window(time, window).alias("w"), "phase")
            .agg(F.count(F.lit(1)).alias("calls"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"),
                 F.percentile_approx("ms", 0.95, 10000).alias("p95_ms"))
            .select(F.col("w.start").alias("window_start"), "phase", "calls", "mean_ms", "max_ms", "p95_ms"))


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key; of equal versions the greatest remaining columns."""
    rest = [c for c in rows.columns if c not in keys and c != version]
    best = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in [version, *rest]]).select(*rows.columns)


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest version per key of the current table and the incoming rows."""
    return newest(current.unionByName(incoming), keys, version)


#: runs of one size class that are merged into one
RUNS = 8


class RunLog:
    """A table as runs of rows and a manifest that names them; a row is rewritten once for each size class it passes.

    A batch adds a run with the newest version of its keys, so it writes rows in proportion to itself.
    ``RUNS`` runs of one size class (a class spans a factor of ``RUNS`` in rows) are merged into one.  The
    manifest is written last and counts once it is complete, so readers always see a whole table; a
    replayed batch starts from the manifest before it and rewrites the same folders.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], version: str):
        self.spark, self.folder, self.schema, self.keys, self.version = spark, folder, schema, keys, version
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _named(self, kind: str) -> list[str]:
        at = self.path(self.folder)
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return [n for n in names if n.startswith(f"{kind}=")]

    def manifests(self) -> list[int]:
        """Numbers of the complete manifests in the folder, which outlives this process."""
        return sorted(int(n.split("=")[1]) for n in self._named("manifest") if self.fs.exists(self.path(f"{self.folder}/{n}/_SUCCESS")))

    def runs(self, before: int | None = None) -> dict[str, int]:
        """Runs and their rows, by the newest manifest (of an earlier batch)."""
        have = [m for m in self.manifests() if before is None or m < before]
        return json.loads(self.spark.read.text(f"{self.folder}/manifest={have[-1]}").first()[0]) if have else {}

    def rows(self, runs: list[str]) -> DataFrame:
        """The newest version of each key in the named runs."""
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return newest(self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{r}" for r in runs]), self.keys, self.version)

    def _write(self, rows: DataFrame, name: str) -> int:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}").count()  # from the footers

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        runs = self.runs(batch_id)
        runs[f"run={batch_id}-0"] = self._write(newest(batch, self.keys, self.version), f"run={batch_id}-0")
        for step in range(1, len(runs) + 1):
            classes: dict[int, list[str]] = {}
            for name, n in runs.items():
                classes.setdefault(int(math.log(max(n, 1), RUNS)), []).append(name)
            full = next((names for _, names in sorted(classes.items()) if len(names) >= RUNS), None)
            if full is None:
                break
            name = f"run={batch_id}-{step}"
            merged = self._write(self.rows(full), name)
            runs = {k: v for k, v in runs.items() if k not in full} | {name: merged}
        text = json.dumps({k: v for k, v in runs.items() if v})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest={batch_id}")

    def vacuum(self) -> None:
        """Remove what the newest manifest does not name; not while a batch runs or a reader holds an older table."""
        have = self.manifests()
        keep = set(self.runs()) | {f"manifest={m}" for m in have[-1:]}
        for name in self._named("run") + self._named("manifest"):
            if have and name not in keep:
                self.fs.delete(self.path(f"{self.folder}/{name}"), True)


def refresh(stream: DataFrame, keys: list[str], version: str, folder: str) -> Callable[[], DataFrame]:
    """Reference-table refresh: each batch adds to the log of the table.  Call the result for the newest table."""
    log = RunLog(stream.sparkSession, folder, stream.schema, keys, version)
    query: StreamingQuery = (stream.writeStream.foreachBatch(log.merge).option("checkpointLocation", f"{folder}/_state")
                             .trigger(availableNow=True).start())

    def table() -> DataFrame:
        query.awaitTermination()
        return log.rows(list(log.runs()))

    return table

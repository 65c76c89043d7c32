"""Streams give the same result however the input is cut into batches, and after a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelweave.streaming import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def events():
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return [(k, start + dt.timedelta(minutes=7 * k + rng.randrange(5)), rng.randrange(6), rng.choice("ab"), float(rng.randrange(100))) for k in range(400)]


def stored(spark, rows, folder, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("parts", [1, 5])
def test_time_to_live(spark, events, tmp_path, parts):
    stored(spark, events, tmp_path / "in", parts)
    got = jobs.run_available(jobs.dedupe_ttl(stream(spark, tmp_path / "in").select("ts", "event_id", "user_id", "event_type"), ["user_id", "event_type"], 3600), "t", path=str(tmp_path / "out"))
    last, want = {}, []
    for k, t, user, kind, _ in events:
        if (user, kind) not in last or t - last[user, kind] >= dt.timedelta(hours=1):
            last[user, kind] = t
            want.append(k)
    assert sorted(r.event_id for r in got.collect()) == want


@pytest.mark.parametrize("parts", [1, 5])
def test_latency_has_every_window(spark, events, tmp_path, parts):
    stored(spark, events, tmp_path / "in", parts)
    timings = lambda d: d.select("ts", F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    got = jobs.run_available(jobs.latency(timings(stream(spark, tmp_path / "in"))), "l", "update", path=str(tmp_path / "out"), keys=["window_start", "phase"])
    want = jobs.latency(timings(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_session_state(spark, events, tmp_path, parts):
    stored(spark, events, tmp_path / "in", parts)
    s = stream(spark, tmp_path / "in").selectExpr("user_id AS session", "event_id", "ts", "'P' || string(event_id % 7) AS parcel", "event_type AS intent")
    got = {r.session: r for r in jobs.run_available(jobs.session_state(s), "s", path=str(tmp_path / "out"), keys=["session"]).collect()}
    for user in {e[2] for e in events}:
        mine = [(f"P{e[0] % 7}", e[3]) for e in events if e[2] == user]
        back = sum(p != mine[n - 1][0] and p in {q for q, _ in mine[:n]} for n, (p, _) in enumerate(mine) if n)
        assert tuple(got[user])[1:] == (mine[-1][0], mine[-1][1], back, len({p for p, _ in mine}), len(mine))


def test_refresh_after_restart(spark, events, tmp_path):
    folder = tmp_path / "in"
    for n in (200, 400):
        stored(spark, events[n - 200 : n], folder, 2)
        newest = jobs.refresh(stream(spark, folder).select("user_id", "ts", "event_id"), ["user_id"], "ts", str(tmp_path / "out"))()
        want = {}
        for k, t, user, *_ in events[:n]:
            want[user] = max(want.get(user, (t, k)), (t, k))
        assert {r.user_id: r.event_id for r in newest.collect()} == {u: k for u, (_, k) in want.items()}


def hours(n, key):
    start = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    return [(k, start + dt.timedelta(minutes=20 * k), key(k), "a", 0.0) for k in range(n)]


def run_on(spark, out, folder):
    """Everything there is so far, with one checkpoint; the rows of state after each batch."""
    q = (out.writeStream.option("checkpointLocation", str(folder / "state")).trigger(availableNow=True)
         .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(str(folder / f"rows/batch={n}"))).start())
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_state_of_answered_keys_expires(spark, tmp_path):
    """Every key is new: state holds the keys of the last hour and little more, also after a restart, and answers stay right."""
    rows = hours(240, lambda k: k // 2)
    deduped = lambda: jobs.dedupe_ttl(stream(spark, tmp_path / "in").select("ts", "event_id", "user_id"), ["user_id"], 3600)
    stored(spark, rows[:120], tmp_path / "in", 12)
    kept = run_on(spark, deduped(), tmp_path / "out")
    stored(spark, rows[120:], tmp_path / "in", 12)
    kept += run_on(spark, deduped(), tmp_path / "out")
    assert len(kept) >= 24 and max(kept) <= 16 and kept[-1] <= 8  # 120 keys in all, 5 of them in each batch
    got = spark.read.parquet(str(tmp_path / "out/rows"))
    assert sorted(r.event_id for r in got.collect()) == [k for k, *_ in rows if k % 2 == 0]


def test_late_events_are_left_out(spark, tmp_path):
    """An event further behind than the bound neither opens a key again nor is answered."""
    rows = hours(30, lambda k: k)
    stored(spark, rows, tmp_path / "in", 3)
    stored(spark, [(99, rows[0][1], 0, "a", 0.0)], tmp_path / "in", 1)
    run_on(spark, jobs.dedupe_ttl(stream(spark, tmp_path / "in").select("ts", "event_id", "user_id"), ["user_id"], 3600), tmp_path / "out")
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()) == list(range(30))


@pytest.mark.parametrize("parts", [1, 9])
def test_idle_sessions_begin_anew(spark, tmp_path, parts):
    """Visits of four events, two hours apart: by event time, the same however batches are cut, and no state is left behind."""
    start = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    rows = [(k, start + dt.timedelta(hours=3 * (k // 4), minutes=5 * (k % 4)), k // 4 % 2, "ab"[k % 2], 0.0) for k in range(72)]
    stored(spark, rows, tmp_path / "in", parts)
    s = stream(spark, tmp_path / "in").selectExpr("user_id AS session", "event_id", "ts", "'P' || string(event_id % 2) AS parcel", "event_type AS intent")
    kept = run_on(spark, jobs.session_state(s, idle_seconds=7200), tmp_path / "out")
    got = jobs.latest(spark.read.parquet(str(tmp_path / "out/rows")), ["session"], "batch").collect()
    assert {(r.session, r.active, r.parcels, r.events, r.restored) for r in got} == {(0, "P1", 2, 4, 2), (1, "P1", 2, 4, 2)}
    assert max(kept) <= 2


def test_refresh_writes_in_proportion(spark, tmp_path):
    """A small batch on a large table writes its own rows only; many of them are merged by size; old runs can go."""
    schema, folder = "key long, version long, note string", str(tmp_path / "log")
    made = lambda lo, hi, v: spark.range(lo, hi).selectExpr("id AS key", f"{v}L AS version", f"'v{v}' AS note")
    log = jobs.RunLog(spark, folder, made(0, 0, 0).schema, ["key"], "version")
    log.merge(made(0, 5000, 0), 0)
    for n in range(1, 21):
        log.merge(made(n, n + 3, n), n)
    written = sum(spark.read.schema(schema).parquet(f"{folder}/{r}").count() for r in log._named("run")) - 5000
    assert written <= 20 * 3 * 3 and len(log.runs()) <= 2 * jobs.RUNS
    log.merge(made(20, 23, 20), 20)  # a replayed batch changes nothing
    table = lambda: {r.key: r.version for r in log.rows(list(log.runs())).collect()}
    want = {k: 0 for k in range(5000)} | {k: n for n in range(1, 21) for k in range(n, n + 3)}
    assert table() == want
    log.vacuum()
    assert set(log._named("run")) == set(log.runs()) and log.manifests() == [20] and table() == want
    # a batch without a complete manifest was never there
    spark.range(1).write.parquet(f"{folder}/run=21-0")
    assert table() == want and log.rows([]).count() == 0

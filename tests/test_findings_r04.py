"""Cases on which the plans of earlier versions did the same work several times over."""

import datetime as dt

import pytest
from parcelweave.operators import grid, legal_text, roads, search, verdict
from parcelweave.streaming import jobs
from pyspark.sql import functions as F


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_permit_rules_are_not_repeated_in_a_filter(spark):
    df = spark.createDataFrame(
        [("a", "", "allowed", "계획관리지역", "PERMIT_REQUIRED", "farmland", True, "NO_CADASTRAL_ROAD", "도로", [("생태·환경", "REVIEW", "x", "y")])],
        "pnu string, jurisdiction string, verdict string, zone string, conversion_status string, category string, has_buildings boolean, "
        "road_status string, road_unknowns string, findings array<struct<category:string,severity:string,label:string,basis:string>>")
    steps = verdict.permit_steps(df).select("pnu", F.inline("steps"))
    assert not any("array_sort" in line for line in optimized(steps).splitlines() if "Filter" in line)
    got = [r.id for r in steps.orderBy("sequence").collect()]
    assert got[:4] == ["demolition", "farmland_conversion", "road_review", "special_생태·환경"]


def test_planned_roads_are_joined_once(spark):
    box = lambda x0, y0, x1, y1: [[(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]]
    rings = "rings array<array<struct<x:double,y:double>>>"
    par = grid.with_shape(spark.createDataFrame([(k, box(100 * k, 0, 100 * k + 20, 20)) for k in range(5)], f"pnu long, {rings}"))
    line = grid.with_shape(spark.createDataFrame([(1, "소로1류", "1", "집행", box(-5, 20, 25, 26)), (2, "소로2류", "2", "미집행", box(95, 10, 125, 16)),
                                                  (3, "소로3류", "3", "", box(395, 20, 425, 26))],
                                                 f"road_id long, name string, road_no string, executed string, {rings}"))
    access = spark.createDataFrame([(k, "CADASTRAL_CONTACT" if k == 4 else "NO_CADASTRAL_ROAD") for k in range(5)], "pnu long, road_status string")
    named = spark.createDataFrame([(0, "중로1류", "접함"), (2, "중로1류", "접함"), (2, "중로2류", "접함"), (3, "중로1류", "저촉"), (4, "중로1류", "접함")],
                                  "pnu long, name string, relation string")
    df = roads.planned_roads(access, par, line, named)
    assert optimized(df).count("Generate explode(sequence") <= 4  # two axes of two sides
    got = {r.pnu: (r.road_status, r.planned, r.planned_names, r.planned_label) for r in df.collect()}
    assert got == {0: ("PLANNED_ROAD_ABUTS", 1, "소로1류", "도시계획도로 접함(개설)"),
                   1: ("PLANNED_ROAD_ABUTS", 1, "소로2류", "도시계획도로 미집행(미개설)"),
                   2: ("PLANNED_ROAD_ABUTS", 2, "중로1류·중로2류", "도시계획도로 접함(접도 검토)"),
                   3: ("NO_CADASTRAL_ROAD", 0, "", None), 4: ("CADASTRAL_CONTACT", 0, "", None)}


def test_grids_are_moved_once_and_not_sorted_by_scan_tasks(spark):
    cells = spark.range(50).selectExpr("id AS org", "explode(sequence(1, 3)) AS row").selectExpr("org", "row", "explode(array(0, 1, 2)) AS col") \
        .selectExpr("org", "row", "col", "CASE col WHEN 0 THEN '공장' WHEN 1 THEN '2미터' ELSE '1미터' END AS text")
    for rules, at in ((legal_text.grid_rules, 1.0), (legal_text.grid_rules_single, 2.0)):
        df = rules(cells)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        below = plan[plan.index("Exchange hashpartitioning"):]
        assert "Aggregate" not in below and "Sort" not in below
        got = df.collect()
        assert len(got) == 150 and {(r.use, r.adjacent_m) for r in got} == {("공장", at)}


@pytest.mark.parametrize("parts", [1, 4])
def test_keys_of_a_bucket_are_answered_each_on_its_own(spark, tmp_path, parts):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    # two events at each time, keys that only differ by a null or a comma, and gaps of just the time-to-live
    rows = [(k, start + dt.timedelta(minutes=3 * (k // 2)), None if k % 7 == 0 else k % 5, (None, "a", "a,b", "1, a")[k % 4]) for k in range(400)]
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts:(k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.dedupe_ttl(events, ["user_id", "event_type"], 900, buckets=3), "b", path=str(tmp_path / "out"))
    last, want = {}, []
    for k, t, *key in rows:
        if tuple(key) not in last or t - last[tuple(key)] >= dt.timedelta(minutes=15):
            last[tuple(key)] = t
            want.append(k)
    assert sorted(r.event_id for r in got.collect()) == want
    state = spark.read.format("statestore").load(str(tmp_path / "out" / "state"))
    assert state.count() <= 3


def test_postings_move_without_the_columns_of_their_chunk(spark):
    rows = [(k, "전국" if k % 2 else f"나라{k}시", "조례", "20200101", " ".join(f"w{j}" for j in range(60) if (k * 7 + j) % 3 == 0 or j == k)) for k in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_no long, jurisdiction string, kind string, effective_date string, text string")
    post, vocab = search.tfidf_index(chunks)
    counted = [line for line in optimized(post).splitlines() if "Aggregate [" in line and "term#" in line]
    assert counted and not any("jurisdiction" in line for line in counted)
    got = post.collect()
    assert len({(r.chunk_no, r.term) for r in got}) == len(got)
    norms = {}
    for r in got:
        norms[r.chunk_no] = norms.get(r.chunk_no, 0.0) + r.weight ** 2
        assert (r.jurisdiction, r.kind, r.effective_date) == rows[r.chunk_no][1:4]
    assert len(norms) == 40 and all(abs(v - 1) < 1e-9 for v in norms.values())

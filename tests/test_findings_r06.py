"""Cases on which earlier versions did work row by row, or moved more than needed."""

import numpy as np
import pandas as pd
import pytest
from parcelweave.functions import free_area
from parcelweave.operators import envelope, grid, measures, roads, spatial, verdict
from parcelweave.plans import catalog
from parcelweave.plans.registry import Inputs
from parcelweave.sources import fixtures
from pyspark.sql import functions as F

RINGS = "rings array<array<struct<x:double,y:double>>>"


def rect(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)


def cases(n):
    """Shapes, their edges with a band of 1.5 m, width and height: an L, one with a hole, two parts, and nothing."""
    out = []
    for k in range(n):
        x, y, w, h = 40.0 * k, 30.0 * (k % 7), 20.0 + k % 19, 24.0 + k % 13
        rings = [[np.array([(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h)])],
                 [rect(x, y, w, h), rect(x + w / 4, y + h / 4, w / 4, h / 4)[::-1]],
                 [rect(x + 0.8 * w, y, 0.2 * w, h), rect(x, y, 0.6 * w, h)], None][k % 4]
        edges = rings and np.concatenate([np.column_stack([r, np.roll(r, -1, axis=0), np.full(len(r), 1.5)]) for r in rings]).ravel()
        out.append((rings and np.concatenate([[len(r), *r.ravel()] for r in rings]), edges, w, h))
    return out


@pytest.fixture
def sweeps(monkeypatch):
    """How many rows each sweep takes on."""
    seen, sweep = [], free_area.largest_of
    monkeypatch.setattr(free_area, "largest_of", lambda rings, *more: seen.append(rings.rows) or sweep(rings, *more))
    return seen


def test_insets_of_a_batch_are_swept_together(sweeps):
    rows = cases(400)
    ratio = [0.7 + (k % 5) / 20 for k in range(len(rows))]
    got = list(envelope._even_inset.func([r[0] for r in rows], [r[1] for r in rows], ratio, [40.0] * len(rows)))
    assert len(sweeps) <= 3 and sum(sweeps) <= 600
    for k, ((_, _, w, h), p, depth) in enumerate(zip(rows, ratio, got)):
        if k % 4 == 3:
            assert pd.isna(depth)
            continue
        want = [(w + h - np.sqrt((w + h) ** 2 - 3 * w * h * (1 - p))) / 4, 15 * w * h / 16 * (1 - p) / (2.5 * (w + h)),
                (0.6 * w + h - np.sqrt((0.6 * w + h) ** 2 - 2.4 * w * h * (1 - p))) / 4][k % 4]
        assert abs(depth - want) < 1e-9


def test_insets_that_come_apart_are_sought_together(sweeps):
    """Two rooms and a gap between them 4 m wide: at 2 m they part, so the larger room alone has to be looked at."""
    rings = [np.array([(0, 0), (20, 0), (20, 8), (24, 8), (24, 0), (24 + w, 0), (24 + w, 20), (24, 20), (24, 12), (20, 12), (20, 20), (0, 20)], float) for w in (10, 12, 14, 16)]
    flat = [np.array([len(r), *r.ravel()]) for r in rings]
    edges = [np.column_stack([r, np.roll(r, -1, axis=0), np.zeros(len(r))]).ravel() for r in rings]
    got = list(envelope._even_inset.func(flat, edges, [0.25] * 4, [44.0] * 4))
    assert len(sweeps) < 60
    for w, depth in zip((10, 12, 14, 16), got):
        whole = 400 + 16 + 20 * w
        assert depth > 2 and abs((20 - 2 * depth) ** 2 - 0.25 * whole) < 1e-4


def test_envelopes_of_a_batch_are_swept_together(sweeps):
    rows, s = cases(400), 1.5
    none = [None if r[0] is None else np.zeros(0) for r in rows]
    got = list(envelope._free_area.func([r[0] for r in rows], [r[1] for r in rows], none))
    assert sweeps == [300]
    for k, ((_, _, w, h), area) in enumerate(zip(rows, got)):
        if k % 4 < 3:
            want = [(w - 2 * s) * (h - 2 * s) - w * h / 4, (w - 2 * s) * (h - 2 * s) - (w / 4 + 2 * s) * (h / 4 + 2 * s), (0.6 * w - 2 * s) * (h - 2 * s)][k % 4]
            assert abs(area - want) < 1e-9


def test_slices_of_bounded_size_change_nothing(monkeypatch):
    rows = [r for r in cases(60) if r[0] is not None]
    args = [r[0] for r in rows], [r[1] for r in rows], [np.zeros(0)] * len(rows)
    want = list(envelope._free_area.func(*args))
    monkeypatch.setattr(free_area, "SLICE", 100)
    assert list(envelope._free_area.func(*args)) == want


def test_tables_of_few_splits_are_spread_over_the_cores(spark, tmp_path):
    spark.range(0, 1000, numPartitions=2).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    inputs = Inputs(spark, str(tmp_path))
    inputs.view = lambda name: fixtures.table(spark, str(tmp_path), "orders")
    df = inputs._spread("fx_parcels", "orders")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 1000


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shaped(spark, rows, columns):
    return grid.with_shape(spark.createDataFrame(rows, f"{columns}, {RINGS}"))


def corners(x, y, w, h):
    return [[(float(a), float(b)) for a, b in rect(x, y, w, h)]]


def test_unions_are_taken_where_the_join_left_the_pieces(spark):
    # over the cell line at 320 m: in each cell two features of one zone that overlap, and a copy
    par = shaped(spark, [(7, 800.0, corners(300, 0, 40, 20))], "id long, geom_area double")
    zones = shaped(spark, [(k, z, corners(*b)) for k, (z, b) in enumerate([
        ("계획관리지역", (290, -5, 25, 30)), ("계획관리지역", (305, -5, 20, 15)), ("계획관리지역", (305, -5, 20, 15)), ("보전관리지역", (330, -5, 30, 30))])],
        "feature_id long, zone_name string")
    df = spatial.zone_shares(par, zones, "id")
    got = {r.zone: (r.area_m2, r.share_pct) for r in df.collect()}
    assert got == {"계획관리지역": (15 * 20 + 10 * 10.0, 50.0), "보전관리지역": (200.0, 25.0)}
    lists = [line for line in planned(df).splitlines() if "collect_list(walls" in line]
    assert lists and all("keys=[cx" in line or "key=[cx" in line for line in lists)


def test_road_widths_come_with_the_neighbours(spark):
    par = shaped(spark, [(1, "대", corners(0, 0, 20, 20)), (2, "도", corners(20, 0, 3, 40)), (3, "전", corners(0, 20, 20, 20))], "id long, jimok string")
    adj = spatial.adjacency(roads.with_road_width(par), "id", keep=("width_m",))
    df = roads.road_access(par, adj, parcel_id="id", also=(F.sum(envelope.narrow_contact(F.col("n_width_m")).cast("bigint")).alias("strips"),))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # neighbours in a cell, and all parcels
    got = {r.id: (r.road_status, r.widest_m, r.narrow_road, r.strips or 0) for r in df.collect()}
    assert got == {1: ("CADASTRAL_CONTACT", 3.0, True, 1), 2: ("NO_CADASTRAL_ROAD", 0.0, False, 0), 3: ("CADASTRAL_CONTACT", 3.0, True, 1)}


def test_planned_roads_move_the_parcels_once(spark):
    par = shaped(spark, [(k, corners(100 * k, 0, 20, 20)) for k in range(3)], "pnu long")
    # beside the first parcel, all over the second, away from the third
    line = shaped(spark, [(1, "소로1류", "1", "집행", corners(-5, 20, 30, 6)), (2, "소로2류", "2", "", corners(90, -10, 60, 60))],
                  "road_id long, name string, road_no string, executed string")
    access = spark.createDataFrame([(k, "NO_CADASTRAL_ROAD") for k in range(3)], "pnu long, road_status string")
    df = roads.planned_roads(access, par, line, spark.createDataFrame([], "pnu long, name string, relation string"))
    assert "LeftSemi" not in planned(df)
    assert {r.pnu: r.planned_names for r in df.collect()} == {0: "소로1류", 1: "소로2류", 2: ""}


def test_neighbours_are_looked_at_once_for_a_division(spark):
    assert planned(catalog.QUERIES["division"](spark, "/root/testdata/sf0.001")).count("MapInArrow") == 1


def test_branches_of_the_verdict_stay_where_the_parcels_are(spark):
    plan = planned(catalog.QUERIES["final_verdict"](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(pnu" not in plan and "hashpartitioning(jurisdiction" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(zone" in line and "zone_name" not in line]


def test_parcels_without_a_piece_keep_their_columns(spark):
    rows = [(1, 300.0, True, 60.0, 200.0, "a"), (1, 100.0, True, 20.0, 100.0, "a"), (2, None, False, None, None, "b"), (3, 50.0, True, 40.0, 80.0, "c")]
    df = spark.createDataFrame(rows, "id long, area_m2 double, found boolean, bcr_max_pct double, far_max_pct double, name string")
    got = {r.id: (r.weighting, r.weighted_bcr_pct, r.name) for r in measures.weighted_limits(df, "id", (F.first("name").alias("name"),)).collect()}
    assert got == {1: ("WEIGHTED", 50.0, "a"), 2: (None, None, "b"), 3: ("UNCHANGED", None, "c")}


def test_steps_are_counted_without_being_made(spark):
    find = [("생태·환경", "REVIEW", "x", "y"), ("재해", "REVIEW", "z", "y"), ("재해", "INFO", "w", "y")]
    df = spark.createDataFrame(
        [("a", "", "allowed", "계획관리지역", "PERMIT_REQUIRED", "farmland", True, "NO_CADASTRAL_ROAD", "도로", find),
         ("b", "", "not_allowed", None, "CLEAR", "other", None, "CADASTRAL_CONTACT", None, [])],
        "pnu string, jurisdiction string, verdict string, zone string, conversion_status string, category string, has_buildings boolean, "
        "road_status string, road_unknowns string, findings array<struct<category:string,severity:string,label:string,basis:string>>")
    counted = verdict.emitted_steps(df)
    assert "steps" not in counted.columns
    assert {r.pnu: r.emitted for r in counted.collect()} == {r.pnu: r.emitted for r in verdict.permit_steps(df).collect()}

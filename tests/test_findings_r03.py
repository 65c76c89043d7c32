"""Cases on which earlier versions gave other rows or took far longer."""

import math

import numpy as np
from parcelweave.functions import free_area
from parcelweave.operators import envelope, grid, spatial
from pyspark.sql import functions as F


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def shaped(spark, rows, columns):
    rows = [(*r[:-1], [[(float(x), float(y)) for x, y in ring] for ring in r[-1]]) for r in rows]
    return grid.with_shape(spark.createDataFrame(rows, f"{columns}, rings array<array<struct<x:double,y:double>>>"))


def test_envelope_tells_how_each_row_was_cut(spark):
    df = shaped(spark, [(1, [box(0, 0, 20, 20)]), (2, [[(0, 0), (40, 0), (40, 20), (20, 20), (20, 40), (0, 40)]])], "pnu long")
    df = df.withColumns({"road_len": F.lit(None).cast("array<double>"), "front_m": F.lit(3.0), "adjacent_m": F.lit(1.0), "north_m": F.lit(0.0)})
    got = {r.pnu: r.method for r in envelope.setback_envelope(df).collect()}
    assert got == {1: "clip", 2: "sweep"}


def test_half_way_shares_and_areas_round_to_even(spark):
    par = shaped(spark, [(1, 1000.0, [box(10123, 51200, 10148, 51240)])], "pnu long, geom_area double")
    x0, y0, x1, y1, cut = 9865, 51045, 10210, 51270, 105
    lay = shaped(spark, [(2245, [[(x0, y0), (x1, y0), (x1, y1 - cut), (x1 - cut, y1), (x0, y1)]])], "feature_id long")
    (r,) = spatial.overlay(par, lay, keep=()).collect()
    assert (r.area_m2, r.share_pct) == (915.5, 91.6)  # 91.55 %

    par = shaped(spark, [(1, 800.0, [box(2280, 30523, 2320, 30543)])], "pnu long, geom_area double")
    bow = shaped(spark, [(1350, [[(2250, 30350), (2400, 30450), (2250, 30550)], [(2550, 30350), (2550, 30550), (2400, 30450)]])], "feature_id long")
    (r,) = spatial.overlay(par, bow, keep=()).collect()
    assert r.area_m2 == 36.8  # 36.75 m2


def test_slanted_edges_touch_only_where_they_are_near(spark):
    apart = [(0, 0), (10, 10), (0, 10)], [(5, 0), (10, 0), (10, 4)]
    par = shaped(spark, [(k, "대", [ring]) for k, ring in enumerate([*apart, [(0, 10), (10, 10), (10, 20)]])], "pnu long, jimok string")
    got = {(r.pnu, r.n_id): r.contact_length_m for r in spatial.adjacency(par).collect()}
    assert set(got) == {(0, 2), (2, 0)}  # boxes of 0 and 1 overlap, but their edges are metres apart
    assert got[0, 2] >= 10


def test_geometry_is_not_repeated_in_filters_below_a_join(spark):
    par = shaped(spark, [(1, "대", [box(0, 0, 20, 20)])], "pnu long, jimok string")
    plan = spatial.adjacency(par)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("array_min" in line or "array_max" in line for line in plan.splitlines() if "Filter" in line)


def test_even_insets_need_few_sweeps(monkeypatch):
    seen = []
    sweep = free_area.parts
    monkeypatch.setattr(free_area, "parts", lambda *a: seen.append(1) or sweep(*a))
    ell = np.array([(0, 0), (40, 0), (40, 15), (20, 15), (20, 30), (0, 30)], float)
    square, hole = np.array(box(0, 0, 40, 40), float), np.array([(10, 10), (10, 20), (20, 20), (20, 10)], float)
    for rings, want in (([ell], (70 - math.sqrt(70 * 70 - 3 * 1200 * 0.25)) / 4), ([square, hole], 1500 * 0.25 / 200)):
        seen.clear()
        edges = np.concatenate([np.column_stack([r, np.roll(r, -1, axis=0)]) for r in rings])
        (depth,) = envelope._even_inset.func(*([v] for v in (
            np.concatenate([[len(r), *r.ravel()] for r in rings]), np.column_stack([edges, np.zeros(len(edges))]).ravel(), 0.75, 40.0)))
        assert abs(depth - want) < 1e-12 and len(seen) <= 2

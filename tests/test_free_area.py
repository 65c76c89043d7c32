"""Exact envelopes: closed forms, dense sampling, parts, and sizes that depend on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelweave.functions import fixed_values as fv
from parcelweave.functions import free_area
from parcelweave.operators import envelope, grid

SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100)]
HOLE = [(40, 40), (40, 60), (60, 60), (60, 40)]
SECOND = [(120, 0), (130, 0), (130, 10), (120, 10)]
ELL = [(0, 0), (40, 0), (40, 20), (20, 20), (20, 40), (0, 40)]


def edges(ring, d):
    r = np.array(ring, float)
    return np.column_stack([r, np.roll(r, -1, axis=0), np.full(len(r), d)])


def left(rings, d):
    return free_area.parts([np.array(r, float) for r in rings], [b for r in rings for b in free_area.bands(edges(r, d))])


def shaped(spark, shapes):
    rows = [(k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in shapes]
    return grid.with_shape(spark.createDataFrame(rows, "pnu long, rings array<array<struct<x:double,y:double>>>"))


@pytest.mark.parametrize("rings, d, want", [
    ([SQUARE], 1, [98 * 98]), ([SQUARE], 50, []), ([SQUARE, HOLE], 1, [98 * 98 - 22 * 22]), ([SQUARE, HOLE, SECOND], 1, [98 * 98 - 22 * 22, 64]),
    ([ELL], 2, [36 * 36 - 400]), ([SQUARE, HOLE], 0, [9600]), ([], 1, [])])
def test_closed_forms(rings, d, want):
    assert np.allclose(left(rings, d), want)


def test_sharp_and_slanted_corners_against_sampling():
    rng = np.random.default_rng(0)
    g = np.linspace(-21, 21, 500)
    p = np.stack(np.meshgrid(g, g), -1).reshape(-1, 2) + 0.0123

    def inside(ring):
        c = np.zeros(len(p), bool)
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
            k = (y1 > p[:, 1]) != (y2 > p[:, 1])
            c ^= k & (p[:, 0] < (x2 - x1) * (p[:, 1] - y1) / (y2 - y1 if y2 != y1 else 1) + x1)
        return c

    for _ in range(20):
        t = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(5, 12)))
        ring = np.stack([np.cos(t), np.sin(t)], 1) * rng.uniform(5, 20, len(t))[:, None]
        taken = free_area.bands(edges(ring, 1.0))
        free = inside(ring)
        for b in taken:
            free &= ~inside(b)
        assert abs(free_area.parts([ring], taken).sum() - free.sum() * (g[1] - g[0]) ** 2) < 0.5


def test_flat_ends_where_only_some_edges_step_back():
    """Beside an obtuse corner the band ends square to its edge; nothing beyond is taken."""
    ring = [(0, 0), (10, 0), (14, 10), (0, 10)]
    e = edges(ring, 0.0)
    e[0, 4] = 2.0
    assert math.isclose(free_area.largest([np.array(ring, float)], free_area.bands(e)), 120 - 20)


def test_envelopes_of_any_parcel(spark):
    df = shaped(spark, [(1, [SQUARE]), (2, [SQUARE, HOLE]), (3, [SQUARE, HOLE, SECOND]), (4, [ELL]), (5, [[(0, 0), (10, 0), (14, 10), (0, 10)]])])
    df = df.withColumns({"road_len": F.lit(None).cast("array<double>"), "front_m": F.lit(9.0), "adjacent_m": F.lit(1.0), "north_m": F.lit(0.0)})
    got = {r.pnu: r.envelope_area_m2 for r in envelope.setback_envelope(df).collect()}
    assert np.allclose([got[k] for k in (1, 2, 3, 4)], [9604, 9120, 9120, 38 * 38 - 400])
    assert math.isclose(got[5], (10 + 0.4 * 5 - math.hypot(1, 0.4) - 1) * 8)


def test_north_edges_of_the_largest_part(spark):
    from parcelweave.operators import shape

    df = shaped(spark, [(1, [SECOND, SQUARE, HOLE]), (2, [ELL]), (3, [HOLE])])
    got = sorted(tuple(r) for r in shape.north_boundary(df).collect())
    assert got == [(1, 100, 100, 0, 100), (2, 20, 40, 0, 40), (2, 40, 20, 20, 20), (3, 60, 60, 40, 60)]


def test_massing_on_an_ell(spark):
    """Height, floors and area step by step, as on a plain parcel, over the exact area of each round."""
    df = shaped(spark, [(1, [ELL])]).withColumns({
        "road_len": F.lit(None).cast("array<double>"), "front_m": F.lit(0.0), "adjacent_m": F.lit(2.0), "setback_status": F.lit("APPLIED"),
        "zone": F.lit(fv.NORTH_DAYLIGHT_ZONES[0] if isinstance(fv.NORTH_DAYLIGHT_ZONES, (list, tuple)) else sorted(fv.NORTH_DAYLIGHT_ZONES)[0]),
        "building_area_m2": F.lit(720.0), "gross_floor_area_m2": F.lit(2400.0), "floors": F.lit(5), "mass_height_m": F.lit(16.5), "applied_surface_m2": F.lit(0.0)})
    (row,) = envelope.constrained_massing(df).collect()
    area = lambda n: 36 * 36 - 400 - max(0, n - 2) * 18 - max(0, n - 2) * 16
    height, adj = 16.5, 720.0
    for _ in range(6):
        north = 1.5 if height <= 10 else height / 2
        adj = min(720.0, area(north), 1200.0)
        floors = min(max(1, math.ceil(2400.0 / adj - 1e-9)), 5)
        done, height = abs(floors * fv.FLOOR_HEIGHT_M - height) < 0.1, floors * fv.FLOOR_HEIGHT_M
        if done:
            break
    assert (row.adjusted_area_m2, row.north_setback_m, row.height_settled) == (round(adj, 2), round(north, 1), done)


def test_inset_of_any_parcel(spark):
    df = shaped(spark, [(1, [ELL]), (2, [SQUARE, HOLE]), (3, [SQUARE]), (4, [SECOND, SQUARE])]).withColumn("ratio", F.lit(0.5))
    got = {r.pnu: r.inset_m for r in envelope.inset_for_area(df).collect()}
    plain = (200 - math.sqrt(200**2 - 4 * 10_000 * 0.5)) / 4
    assert np.allclose([got[k] for k in (1, 2, 3, 4)], [(80 - math.sqrt(6400 - 2400)) / 4, 4800 / 480, plain, plain], atol=1e-6)

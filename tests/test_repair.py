"""Crossing rings, their repair, and the way between plane systems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelweave.functions import noding
from parcelweave.operators import repair, shape
from parcelweave.sources import layers

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
BOW = [(0, 0), (10, 10), (10, 0), (0, 10)]
SPIKE = [(0, 0), (10, 0), (10, 10), (5, 10), (5, 15), (5, 10), (0, 10)]
EIGHT = [(0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10)]


def rings(*given):
    return [np.array(r, float) for r in given]


def area(r):
    return 0.5 * float(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]))


@pytest.mark.parametrize("given, crossed, simple, areas", [
    ([SQUARE], False, True, [100]), ([BOW], True, False, [25, 25]), ([SPIKE], False, False, [100]), ([EIGHT], False, True, [25, 25]),
    ([SQUARE, [(2, 2), (2, 4), (4, 4), (4, 2)]], False, True, [-4, 100]), ([SQUARE, SQUARE], False, False, []),
    ([SQUARE, [(5, 5), (15, 5), (15, 15), (5, 15)]], True, False, [75, 75]), ([[(0, 0), (5, 5), (10, 10)]], False, False, []), ([], False, True, [])])
def test_shapes(given, crossed, simple, areas):
    given = rings(*given)
    assert noding.crosses(given) == crossed and noding.simple(given) == simple
    assert sorted(round(area(r), 9) for r in noding.repaired(given)) == areas


def test_star():
    t = np.arange(5) * 4 * np.pi / 5
    found = noding.repaired([np.stack([np.cos(t), np.sin(t)], 1)])
    assert len(found) == 5 and np.ptp([area(r) for r in found]) < 1e-9


def test_same_inside_by_the_even_odd_rule():
    """Random rings, also on whole numbers, where edges lie on one another and end inside others."""
    rng = np.random.default_rng(1)
    g = np.linspace(0, 10, 200) + 0.00123
    p = np.stack(np.meshgrid(g, g), -1).reshape(-1, 2)

    def inside(given):
        c = np.zeros(len(p), bool)
        for r in given:
            for (x1, y1), (x2, y2) in zip(r, np.roll(r, -1, axis=0)):
                k = (y1 > p[:, 1]) != (y2 > p[:, 1])
                c ^= k & (p[:, 0] < (x2 - x1) * (p[:, 1] - y1) / (y2 - y1 if y2 != y1 else 1) + x1)
        return c

    for it in range(40):
        given = [np.round(rng.uniform(0, 10, (rng.integers(4, 10), 2)), 0 if it % 2 else 3) for _ in range(rng.integers(1, 3))]
        found = noding.repaired(given)
        assert (inside(given) != inside(found)).mean() < 2e-3
        assert all(not noding.crosses([r]) for r in found)


def test_many_edges_meet_few():
    t = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    big = np.stack([np.cos(t), np.sin(t)], 1) * (1 + 0.1 * np.sin(37 * t))[:, None]
    assert noding.simple([big])
    big[[100, 9000]] = big[[9000, 100]]
    assert noding.crosses([big])


def frame(spark, shapes):
    rows = [(k, [[(float(x), float(y)) for x, y in r] for r in given], "kept") for k, given in shapes]
    return spark.createDataFrame(rows, "feature_id long, rings array<array<struct<x:double,y:double>>>, name string")


def test_reasons(spark):
    df = frame(spark, [(1, [BOW]), (2, [SQUARE]), (3, [[(0, 0), (1, 1), (2, 2)]]), (4, [EIGHT])])
    assert {r.feature_id: r.reason for r in shape.validate_geometry(df).collect()} == {1: "self_crossing", 2: "ok", 3: "zero_area", 4: "self_touching"}


def test_repair_of_rows(spark):
    df = repair.repair(frame(spark, [(1, [BOW]), (2, [SQUARE]), (3, [[(0, 0), (1, 1), (2, 2)]]), (4, [])]))
    got = {r.feature_id: (r.repaired, [[tuple(p) for p in x] for x in r.rings], r.name) for r in df.collect()}
    assert got[2] == (False, [[tuple(map(float, p)) for p in SQUARE]], "kept") and got[3] == (True, [], "kept") and got[4] == (False, [], "kept")
    assert got[1][0] and sorted(len(r) for r in got[1][1]) == [3, 3]


def test_ingest_repairs_and_drops_what_has_no_inside(spark):
    df = layers.prepare_layer(frame(spark, [(1, [BOW]), (2, [SQUARE]), (3, [[(0, 0), (1, 1), (2, 2)]]), (4, [])]), "EPSG:5186", "EPSG:4326")
    got = {r.feature_id: r for r in df.collect()}
    assert sorted(got) == [1, 2] and len(got[1].rings) == 2 and 124.8 < got[2].minx < 124.9 and 32.5 < got[2].miny < 32.6


@pytest.mark.parametrize("system", ["EPSG:5174", "EPSG:5179", "EPSG:5181", "EPSG:5186"])
def test_there_and_back(spark, system):
    spots = [(lon, lat) for lon in (124.7, 126.0, 127.0, 128.4, 129.9) for lat in (33.2, 36.0, 38.0, 38.6)]
    df = frame(spark, [(1, [spots])])
    df = df.withColumn("m", F.expr(layers.project("rings", "EPSG:4326", system))).withColumn("b", F.expr(layers.project("m", system, "EPSG:4326")))
    (row,) = df.collect()
    for (lon, lat), p in zip(spots, row.b[0]):
        assert abs(p.x - lon) * 111_320 < 0.01 and abs(p.y - lat) * 111_320 < 0.01


def test_origins_and_datum(spark):
    """A system's origin, and a shift of some 300 m between the datums."""
    df = frame(spark, [(1, [[(127.0, 38.0), (128.0, 38.0), (127.0, 37.0)]])])
    (row,) = df.select(F.expr(layers.project("rings", "EPSG:4326", "EPSG:5186")).alias("n"), F.expr(layers.project("rings", "EPSG:4326", "EPSG:5174")).alias("o")).collect()
    assert abs(row.n[0][0].x - 200_000) < 1e-6 and abs(row.n[0][0].y - 600_000) < 1e-6
    east, north = row.o[0][0].x - (200_000 - 0.0028902777778 * 87_700), row.o[0][0].y - 500_000
    assert 100 < np.hypot(east, north) < 600
    with pytest.raises(ValueError, match="unknown system"):
        layers.project("rings", "EPSG:1", "EPSG:5186")

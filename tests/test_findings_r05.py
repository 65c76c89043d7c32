"""Cases on which earlier versions measured more than needed."""

import math
import random

from parcelweave.operators import grid, roads
from pyspark.sql import functions as F

RINGS = "rings array<array<struct<x:double,y:double>>>"


def test_only_outlets_near_the_nearest_are_measured(spark, monkeypatch):
    rng = random.Random(5)
    boxes = [(k, "도" if k % 3 == 0 else "대", x, y, x + rng.randrange(2, 9), y + rng.randrange(2, 9))
             for k, (x, y) in enumerate((rng.randrange(0, 300), rng.randrange(0, 300)) for _ in range(150))]
    boxes += [(900, "대", 2000, 0, 2010, 10), (901, "도", 2080, 0, 2085, 5), (902, "대", 4000, 0, 4010, 10)]  # one far outlet, none
    rows = [(k, j, [[(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]]) for k, j, a, b, c, d in boxes]
    par = grid.with_shape(spark.createDataFrame(rows, f"pnu long, jimok string, {RINGS}"))
    drained = par.select("pnu", (F.col("jimok") == "도").alias("public_outlet"))
    measured, plain = [], grid.cell_join

    def recorded(left, right, *args, **more):
        pairs = plain(left, right, *args, **more)
        measured.extend([pairs] if "edges" in right.columns else [])
        return pairs

    monkeypatch.setattr(grid, "cell_join", recorded)
    got = {r.pnu: (r.outlet_id, r.length_m) for r in roads.nearest_outlet(par, drained, reach=100.0).collect()}

    def gap(point, box):
        (x, y), (_, _, a, b, c, d) = point, box
        return math.hypot(max(a - x, x - c, 0), max(b - y, y - d, 0)) if not (a < x < c and b < y < d) else min(x - a, c - x, y - b, d - y)

    want, pairs = {}, 0
    for p in boxes:
        if p[1] == "도":
            continue
        near = [q for q in boxes if q[1] == "도" and q[2] <= p[4] + 100 and q[4] >= p[2] - 100 and q[3] <= p[5] + 100 and q[5] >= p[3] - 100]
        pairs += len(near)
        best = min(((gap(((p[2] + p[4]) / 2, (p[3] + p[5]) / 2), q), q[0]) for q in near), default=None)
        if best and best[0] >= 0.5:
            want[p[0]] = best[1]
    assert {k: o for k, (o, _) in got.items()} == want and got[900][0] == 901 and 902 not in got
    assert len(measured) == 1 and measured[0].count() < pairs / 2

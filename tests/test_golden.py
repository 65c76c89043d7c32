"""Known cases with exact expected values, and geometry against brute force."""

import math
import random

from pyspark.sql import functions as F

from parcelweave.functions import fixed_values as fv
from parcelweave.functions import geometry as geo
from parcelweave.operators import envelope, grid, measures, rules, spatial, verdict


def one(df):
    return df.collect()[0].asDict()


def shaped(spark, rows):
    """rows: (id, [(x, y), ...])"""
    data = [(i, [[{"x": float(x), "y": float(y)} for x, y in ring]]) for i, ring in rows]
    return grid.with_shape(spark.createDataFrame(data, "id int, rings array<array<struct<x:double,y:double>>>"))


def test_weighted_limits_applies_to_small_pieces(spark):
    df = spark.createDataFrame([("p", 647.0, True, 60.0, 250.0), ("p", 62.0, True, 20.0, 100.0),
                                ("q", 647.0, True, 60.0, 250.0), ("q", 331.0, True, 20.0, 100.0)],
                               "pnu string, area_m2 double, found boolean, bcr_max_pct double, far_max_pct double")
    out = {r.pnu: r for r in measures.weighted_limits(df).collect()}
    assert (out["p"].weighting, out["p"].weighted_bcr_pct, out["p"].weighted_far_pct) == ("WEIGHTED", 56.5, 236.9)
    assert out["q"].weighting == "UNCHANGED"


def test_conversion_charges(spark):
    df = spark.createDataFrame([("farmland", 100.0, 100000, "CLEAR", None), ("farmland", 100.0, 1000000, "OVERLAP", None),
                                ("forest", 100.0, 1000000, "CLEAR", "UFM110"), ("forest", 0.0, 1000000, "CLEAR", "UFM110")],
                               "category string, conversion_area_m2 double, price_won_m2 long, agriculture_status string, forest_code string")
    rows = measures.conversion_charge(df).select("charge_unit_won", "charge_won").collect()
    assert [tuple(r) for r in rows] == [(20000, 2000000), (50000, 5000000), (11840, 1184000), (None, None)]


def test_parking(spark):
    df = spark.createDataFrame([("업무시설", 451.0), ("단독주택", 120.0), ("단독주택", 251.0), ("시설물", 900.0)], "building_use string, g double")
    rows = measures.parking(df.withColumn("parking_strategy", F.lit("surface")), "g").collect()
    assert [r.spaces for r in rows] == [4, 1, 3, 0]
    assert rows[0].surface_area_m2 == 100.0


def test_terrain_bands_sum_to_hundred(spark):
    dem = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(10) for c in range(10)], "r long, c long, elev double")
    par = shaped(spark, [(1, [(35, 35), (205, 35), (205, 205), (35, 205)])])
    row = one(measures.terrain(dem, par, 30.0, "id"))
    assert row["terrain_status"] == "REFERENCE_AVAILABLE" and row["cells"] == 36
    assert abs(sum(row[f"band{k}_pct"] for k in range(5)) - 100) < 0.3


def _clip_area(subject, clip):
    """Sutherland-Hodgman area of subject ∩ convex clip, an independent check."""
    out = subject
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        src, out = out, []
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        for p, q in zip(src, src[1:] + src[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
        if not out:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1]))) / 2


def _convex(rng, cx, cy, r, n):
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))]


def test_overlap_of_random_polygons_across_cells(spark):
    rng = random.Random(5)
    parcels = [(k, _convex(rng, rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(20, 60), 7)) for k in range(30)]
    star = [(150 + (140 if k % 2 else 70) * math.cos(k * math.pi / 9), 150 + (140 if k % 2 else 70) * math.sin(k * math.pi / 9)) for k in range(18)]
    features = [(k, _convex(rng, rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(50, 150), 9)) for k in range(8)] + [(99, star)]
    par = shaped(spark, parcels).withColumnsRenamed({"id": "pnu"}).withColumn("geom_area", F.expr(geo.area("rings")))
    lay = shaped(spark, features).withColumnRenamed("id", "feature_id")
    got = {(r.pnu, r.feature_id): r.area for r in spatial.overlay_raw(par, lay, size=64.0).collect()}
    salted = {(r.pnu, r.feature_id): r.area for r in spatial.overlay_raw(par, lay, size=64.0, salts=3).collect()}
    for pid, p in parcels:
        for fid, f in features:
            want = _clip_area(f, p)
            assert abs(got.get((pid, fid), 0.0) - want) < 1e-6, (pid, fid)
            assert abs(salted.get((pid, fid), 0.0) - want) < 1e-6


def test_union_counts_overlapping_pieces_once(spark):
    square = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    df = shaped(spark, [(1, square(0, 0, 10, 10))])
    others = shaped(spark, [(1, square(0, 0, 6, 10)), (2, square(4, 0, 4, 5)), (3, [(5, 5), (12, 5), (12, 12)])])
    pieces = others.agg(F.collect_list("walls").alias("pieces"))
    area = one(df.join(pieces, F.lit(True)).select(F.expr(geo.union_area("walls", "pieces")).alias("a")))["a"]
    # 60 + right part of the second (2x5) + triangle part not already covered
    n, hit = 2000, 0
    inside = lambda x, y: x < 6 or (4 <= x < 8 and y < 5) or (x >= 5 and y >= 5 and y - 5 <= x - 5)
    for a in range(n):
        for b in range(0, n, 20):
            hit += inside((a + .5) * 10 / n, (b + 10) * 10 / n)
    assert abs(area - hit / (n * (n // 20)) * 100) < 0.3


def test_contact_and_adjacency(spark):
    square = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    par = shaped(spark, [(1, square(0, 0, 40, 40)), (2, square(40, 0, 10, 40)), (3, square(40.3, 45, 10, 10)), (4, square(100, 0, 5, 5))])
    par = par.withColumn("jimok", F.lit("도")).withColumn("pnu", F.col("id"))
    got = {(r.pnu, r.n_id): r.contact_length_m for r in spatial.adjacency(par).collect()}
    # shared side plus 0.35 m of each adjoining side
    assert got[(1, 2)] == 40.7 and (1, 3) not in got and (1, 4) not in got


def test_zone_share_of_duplicate_features(spark):
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    par = shaped(spark, [(1, square(0, 0, 10))]).withColumn("pnu", F.lit("p")).withColumn("geom_area", F.lit(100.0))
    zones = shaped(spark, [(1, square(-5, -5, 30)), (2, square(-5, -5, 30))]).withColumnRenamed("id", "feature_id").withColumn("zone_name", F.lit("농림지역"))
    rows = spatial.zone_shares(par, zones).collect()
    assert [(r.zone, r.share_pct) for r in rows] == [("농림지역", 100.0)]


def test_constraints_scope_and_used_notes(spark):
    df = spark.createDataFrame([(["가축사육제한구역", "문화유산보호구역", "문화유산 주변"], "농막"), (["가축사육제한구역"], "축사")],
                               "districts array<string>, facility_text string")
    a, b = rules.constraints(df).collect()
    assert [c.name for c in a.constraints] == ["문화유산보호구역"]
    assert [c.name for c in b.constraints] == ["가축사육제한구역"]


def test_conversion_unknown_is_not_clear(spark):
    df = spark.createDataFrame([("other", "UNAVAILABLE", "CLEAR"), ("farmland", "NOT_CONFIGURED", "CLEAR"), ("other", "CLEAR", "CLEAR")],
                               "category string, agriculture_status string, forest_status string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("forest_code", "forest_name", "terrain_status")}).withColumn("has_inventory", F.lit(False))
    assert [r.conversion_status for r in verdict.assess_conversion(df).collect()] == ["UNKNOWN", "UNKNOWN", "CLEAR"]


def test_permit_steps_order_dependencies_and_conditions(spark):
    df = spark.createDataFrame([("가시", True, "forest", "NO_CADASTRAL_ROAD", "x", "농림지역", None,
                                 [("재해", "REVIEW", "a", "b1"), ("재해", "REVIEW", "c", "b2"), ("습지", "INFO", "d", "b3")])],
                               "jurisdiction string, has_buildings boolean, category string, road_status string, road_unknowns string, zone string, "
                               "verdict string, findings array<struct<category:string,severity:string,label:string,basis:string>>")
    steps = one(verdict.permit_steps(df))["steps"]
    assert [s.id for s in steps] == ["demolition", "forest_conversion", "road_review", "special_재해", "development_activity", "building_permission"]
    by = {s.id: s for s in steps}
    assert by["development_activity"].depends_on == ["forest_conversion", "road_review"]
    assert by["building_permission"].depends_on == [s.id for s in steps[:-1]]
    assert by["special_재해"].basis == "b1" and by["demolition"].department == "가시 건축 담당부서"


def test_rule_operators(spark):
    df = spark.createDataFrame([("a", 1), (None, 0)], "verdict string, has_buildings int")
    paths = lambda **c: {"path": "regulation.verdict", **c}
    run = lambda cond: [r[0] for r in df.select(verdict.condition(cond, {"s": ["a"]})).collect()]
    assert run(paths(op="equals", value="a")) == [True, False]
    assert run(paths(op="not_equals", value="a")) == [False, True]
    assert run(paths(op="in_set_or_missing", set="s")) == [True, True]
    assert run(paths(op="in_set", set="s")) == [True, False]
    assert run(paths(op="not_in", value=["a"])) == [False, True]
    assert run(paths(op="nonempty")) == [True, False]
    assert run({"not": {"all": [{"path": "existing_buildings.has_buildings", "op": "truthy"}]}}) == [False, True]


def test_inset_and_concave_envelope(spark):
    ell = [(0, 0), (40, 0), (40, 20), (20, 20), (20, 40), (0, 40)]
    df = shaped(spark, [(1, ell), (2, [(0, 0), (40, 0), (40, 40), (0, 40)])])
    df = df.withColumns({"road_len": F.lit(None).cast("array<double>"), "front_m": F.lit(0.0), "adjacent_m": F.lit(2.0), "north_m": F.lit(0.0)})
    rows = {r.id: r for r in envelope.setback_envelope(df).collect()}
    assert abs(rows[2].envelope_area_m2 - 36 * 36) < 1e-6
    # the inner corner is mitred
    assert abs(rows[1].envelope_area_m2 - (36 * 36 - 20 * 20)) < 1e-6


def test_massing_caps_target(spark):
    df = spark.createDataFrame([(100.0, 50.0, 200.0, 300.0), (100.0, 60.0, 200.0, None)],
                               "area_m2 double, bcr_max_pct double, far_max_pct double, far_target_pct double")
    a, b = measures.massing(df).collect()
    assert (a.exceeds_far_limit, a.far_applied_pct, a.floors, a.top_floor_ratio) == (True, 200.0, 4, 1.0)
    assert (b.floors, b.full_floors, b.top_floor_ratio, b.mass_height_m) == (4, 3, 0.333, 13.2)


def test_use_names_are_consistent():
    assert set(fv.PARKING_RULES) <= set(fv.USE_MATRIX)


def test_polygons_with_holes(spark):
    """A square with a square hole, from both text formats and either ring direction."""
    from parcelweave.functions import geometry as geo
    from parcelweave.operators import grid, spatial
    from parcelweave.sources import layers
    import json
    outer, hole = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[2, 2], [8, 2], [8, 8], [2, 8], [2, 2]]
    far = [[20, 0], [22, 0], [22, 2], [20, 2], [20, 0]]
    shapes = {"ccw": {"type": "Polygon", "coordinates": [outer, hole]}, "cw": {"type": "Polygon", "coordinates": [outer[::-1], hole[::-1]]},
              "multi": {"type": "MultiPolygon", "coordinates": [[outer, hole], [far[::-1]]]}}
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in shapes.items()], "feature_id string, g string").withColumn("rings", layers.rings_from_geojson(F.col("g")))
    wkt = spark.createDataFrame([("wkt", "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 8, 8 8, 8 2, 2 2)), ((20 0, 22 0, 22 2, 20 2, 20 0)))")], "feature_id string, g string")
    both = grid.with_shape(raw.unionByName(wkt.withColumn("rings", layers.rings_from_wkt(F.col("g")))))
    area = {r[0]: r[1] for r in both.select("feature_id", F.expr(geo.area("rings"))).collect()}
    assert area == {"ccw": 64.0, "cw": 64.0, "multi": 68.0, "wkt": 68.0}
    parcel = grid.with_shape(spark.sql("SELECT 1 AS pnu, 64D AS geom_area"), geo.rectangle("1", "1", "9", "9")).withColumn("geom_area", F.lit(64.0))
    found = spatial.overlay(parcel, both, keep=()).collect()
    assert {r.feature_id: r.area_m2 for r in found} == dict.fromkeys(area, 28.0)  # 8 x 8 less 6 x 6
    inside = both.select("feature_id", F.expr(geo.contains("walls", "5D", "5D")).alias("a"), F.expr(geo.contains("walls", "1D", "5D")).alias("b")).collect()
    assert all((r.a, r.b) == (False, True) for r in inside)

"""Queries over single shapes, layer catalogue and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import geometry as geo
from ..operators import shape, spatial, verdict
from ..sources import layers
from ..streaming import jobs
from .registry import REGISTRY_CTE, Inputs, query, sql, values


@query("project", sql("fx_parcels", """
SELECT id, round(1000000 + 0.9996::DOUBLE * n * (q + (1 - t + c) * power(q, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * power(q, 5) / 120), 2) AS x,
  round(2000000 + 0.9996::DOUBLE * (m - m0 + n * tan(phi) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * power(q, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * power(q, 6) / 720)), 2) AS y
FROM (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * power(sin(phi), 2)) AS n, power(tan(phi), 2) AS t, ep * power(cos(phi), 2) AS c, lam * cos(phi) AS q,
   6378137.0::DOUBLE * (k0 * phi - k2 * sin(2 * phi) + k4 * sin(4 * phi) - k6 * sin(6 * phi)) AS m, 6378137.0::DOUBLE * (k0 * p0 - k2 * sin(2 * p0) + k4 * sin(4 * p0) - k6 * sin(6 * p0)) AS m0
  FROM (SELECT *, e2 / (1 - e2) AS ep, 1 - e2 / 4 - 3 * power(e2, 2) / 64 - 5 * power(e2, 3) / 256 AS k0, 3 * e2 / 8 + 3 * power(e2, 2) / 32 + 45 * power(e2, 3) / 1024 AS k2,
    15 * power(e2, 2) / 256 + 45 * power(e2, 3) / 1024 AS k4, 35 * power(e2, 3) / 3072 AS k6 FROM (SELECT id, radians(37 + y0 / 100000) AS phi, radians(38.0::DOUBLE) AS p0, radians(127 + x0 / 100000 - 127.5::DOUBLE) AS lam,
     0.006694380022900787::DOUBLE AS e2 FROM fx_parcels) a) b) c"""))
def project(i: Inputs):
    ring = geo.rectangle("127 + x0 / 100000", "37 + y0 / 100000", "127 + x1 / 100000", "37 + y1 / 100000")
    moved = i.view("fx_parcels").withColumn("m", F.expr(layers.project(ring, "EPSG:4326", "EPSG:5179")))
    return moved.select("id", F.round(F.expr("m[0][0].x"), 2).alias("x"), F.round(F.expr("m[0][0].y"), 2).alias("y"))


@query("shape_metrics", sql("fx_layer", """
SELECT feature_id, x1 - x0 AS width_m, y1 - y0 AS depth_m, round((x0 * 2 + x1 * 2 + x1 - cut) / 5, 6) AS mean_x, round((x1 - x0) * 2 + (y1 - y0) * 2 - 2 * cut + cut * sqrt(2), 6) AS perimeter_m,
  round(greatest(x1 - x0, y1 - y0), 6) AS longest_edge_m, CASE WHEN x1 - x0 >= y1 - y0 THEN 180.0 ELSE 270.0 END AS bearing_deg FROM fx_layer"""))
def shape_metrics(i: Inputs):
    return shape.shape_metrics(i.layer().select("feature_id", "rings")).select(
        "feature_id", "width_m", "depth_m", F.round("mean_x", 6).alias("mean_x"), F.round("perimeter_m", 6).alias("perimeter_m"),
        F.round("longest_edge_m", 6).alias("longest_edge_m"), "bearing_deg")


@query("north_edges", sql("fx_layer", """
SELECT feature_id, x1, y1 - cut AS y1, x1 - cut AS x2, y1 AS y2 FROM fx_layer UNION ALL SELECT feature_id, x1 - cut, y1, x0, y1 FROM fx_layer"""))
def north_edges(i: Inputs):
    return shape.north_boundary(i.layer(), "feature_id")


@query("validate_geometry", sql("fx_layer", """
SELECT feature_id, CAST(2 AS BIGINT) AS parts, CAST(CASE WHEN feature_id % 3 = 2 THEN 0 ELSE 1 END AS BIGINT) AS bad_parts, CASE feature_id % 3 WHEN 0 THEN 'too_few_vertices' WHEN 1 THEN 'zero_area' ELSE 'ok' END AS reason,
  CAST(CASE WHEN feature_id % 3 = 2 THEN 1 ELSE 2 END AS BIGINT) AS removed_vertices, 1 AS largest_part, (x1 - x0) * (y1 - y0) AS largest_area FROM fx_layer"""))
def validate_geometry(i: Inputs):
    p = lambda x, y: f"named_struct('x', double({x}), 'y', double({y}))"
    bad = (f"CASE feature_id % 3 WHEN 0 THEN array({p('x0', 'y0')}, {p('x0', 'y0')}, {p('x1', 'y1')}) "
           f"WHEN 1 THEN array({p('x0', 'y0')}, {p('x0', 'y0')}, {p('x0 + 1', 'y0 + 1')}, {p('x0 + 2', 'y0 + 2')}) "
           f"ELSE array({p('x0', 'y0')}, {p('x0 + 1', 'y0')}, {p('x0', 'y0 + 1')}) END")
    good = f"array({p('x0', 'y0')}, {p('x1', 'y0')}, {p('x1', 'y0')}, {p('x1', 'y1')}, {p('x0', 'y1')})"
    return shape.validate_geometry(i.view("fx_layer").select("feature_id", F.expr(f"array({bad}, {good})").alias("rings")))


CROSSED = """
SELECT feature_id, feature_id % 3 AS kind, x1 - x0 AS w, y1 - y0 AS h FROM fx_layer"""


@query("self_crossing", sql("fx_layer", f"""
SELECT feature_id, CASE WHEN kind = 2 THEN 'ok' ELSE 'self_crossing' END AS reason FROM ({CROSSED}) t"""))
def self_crossing(i: Inputs):
    return shape.validate_geometry(i.crossed_layer()).select("feature_id", "reason")


@query("repair_rings", sql("fx_layer", f"""
SELECT feature_id, kind < 2 AS repaired, CASE WHEN kind < 2 THEN 2 ELSE 1 END AS n_rings,
  round(CASE kind WHEN 0 THEN w * h / 2 WHEN 1 THEN w / 2 * h + w / 2 * 10 ELSE w * h END, 6) AS area_m2 FROM ({CROSSED}) t"""))
def repair_rings(i: Inputs):
    """Through the ingest of a layer: crossings are taken apart before anything is measured."""
    return layers.prepare_layer(i.crossed_layer()).select(
        "feature_id", "repaired", F.size("rings").alias("n_rings"), F.round(F.expr(geo.area("rings")), 6).alias("area_m2"))


# overlap of parcel rectangles with the two triangles of a bow tie: its height over x is linear between the listed places
@query("overlay_repaired", sql("fx_parcels fx_layer", """
SELECT pnu, feature_id, round_even(area, 1) AS area_m2 FROM (
  SELECT pnu, feature_id, list_sum([(b[i + 1] - b[i]) * (greatest(0, least(v1, abs(b[i])) - greatest(v0, -abs(b[i]))) + greatest(0, least(v1, abs(b[i + 1])) - greatest(v0, -abs(b[i + 1])))) / 2 FOR i IN range(1, len(b))]) / k AS area
  FROM (SELECT *, list_sort(list_distinct(list_filter([u0, u1, 0, v0, -v0, v1, -v1], lambda x: x >= u0 AND x <= u1))) AS b FROM (
    SELECT p.pnu, l.feature_id, (l.x1 - l.x0) / (l.y1 - l.y0) AS k, greatest(p.x0, l.x0) - (l.x0 + l.x1) / 2 AS u0, least(p.x1, l.x1) - (l.x0 + l.x1) / 2 AS u1,
      (greatest(p.y0, l.y0) - (l.y0 + l.y1) / 2) * ((l.x1 - l.x0) / (l.y1 - l.y0)) AS v0, (least(p.y1, l.y1) - (l.y0 + l.y1) / 2) * ((l.x1 - l.x0) / (l.y1 - l.y0)) AS v1
    FROM fx_parcels p JOIN fx_layer l ON l.feature_id % 3 = 0 AND p.x0 < l.x1 AND p.x1 > l.x0 AND p.y0 < l.y1 AND p.y1 > l.y0) a) b0) c
WHERE area > 0.000001"""))
def overlay_repaired(i: Inputs):
    bows = layers.prepare_layer(i.crossed_layer().where("feature_id % 3 = 0"))
    return spatial.overlay(i.parcels(), bows).select("pnu", "feature_id", "area_m2")


def _shift_sql(lon: str, lat: str, source: tuple, target: tuple, sign: int) -> tuple[str, str]:
    """Longitude and latitude after the datum shift, as SQL of its own."""
    (a, e2), (a2, f2) = source, target
    tx, ty, tz, rx, ry, rz, ppm = layers.OLD_DATUM
    n = f"({a!r}::DOUBLE / sqrt(1 - {e2!r}::DOUBLE * power(sin(radians({lat})), 2)))"
    g = [f"({n} * cos(radians({lat})) * cos(radians({lon})))", f"({n} * cos(radians({lat})) * sin(radians({lon})))", f"({n} * {1 - e2!r}::DOUBLE * sin(radians({lat})))"]
    t = [f"{v!r}::DOUBLE" for v in (tx, ty, tz)]
    if sign < 0:
        g, t = [f"({v} - {w})" for v, w in zip(g, t)], ["0"] * 3
    turn = [f"radians({sign * v!r}::DOUBLE / 3600)" for v in (rx, ry, rz)]
    m = f"power(1 + {ppm!r}::DOUBLE / 1000000, {sign})"
    x = f"({t[0]} + {m} * ({g[0]} - {turn[2]} * {g[1]} + {turn[1]} * {g[2]}))"
    y = f"({t[1]} + {m} * ({turn[2]} * {g[0]} + {g[1]} - {turn[0]} * {g[2]}))"
    z = f"({t[2]} + {m} * ({g[2]} - {turn[1]} * {g[0]} + {turn[0]} * {g[1]}))"
    b2 = f"({a2!r}::DOUBLE * sqrt(1 - {f2!r}::DOUBLE))"
    p = f"sqrt({x} * {x} + {y} * {y})"
    th = f"atan2({z} * {a2!r}::DOUBLE, {p} * {b2})"
    return (f"degrees(atan2({y}, {x}))", f"degrees(atan2({z} + {f2 / (1 - f2)!r}::DOUBLE * {b2} * power(sin({th}), 3), {p} - {f2!r}::DOUBLE * {a2!r}::DOUBLE * power(cos({th}), 3)))")


_OLD = _shift_sql("127 + x0 / 100000", "37 + y0 / 100000", layers.GRS80, layers.BESSEL, -1)


@query("datum_shift", sql("fx_parcels", f"""
SELECT id, round({_OLD[0]}, 7) AS lon, round({_OLD[1]}, 7) AS lat, true AS back_within_cm, true AS sheet_within_cm FROM fx_parcels"""))
def datum_shift(i: Inputs):
    """Corners on the older datum, and the way there and back: through the old plane system, and from the newer plane to it and back."""
    spot = "named_struct('x', 127 + x0 / 100000, 'y', 37 + y0 / 100000)"
    old = geo.datum_shift(f"{spot}.x", f"{spot}.y", layers.GRS80, layers.BESSEL, layers.OLD_DATUM, back=True)
    ring = geo.rectangle("127 + x0 / 100000", "37 + y0 / 100000", "127 + x1 / 100000", "37 + y1 / 100000")
    df = i.view("fx_parcels").withColumns({"o": F.expr(old), "r": F.expr(ring)})
    df = df.withColumn("m", F.expr(layers.project("r", "EPSG:4326", "EPSG:5174"))).withColumn("b", F.expr(layers.project("m", "EPSG:5174", "EPSG:4326")))
    df = df.withColumn("s", F.expr(layers.project("r", "EPSG:4326", "EPSG:5186"))).withColumn(
        "t", F.expr(layers.project(layers.project("s", "EPSG:5186", "EPSG:5174"), "EPSG:5174", "EPSG:5186")))
    off = lambda a, b, metres: F.expr(f"forall(zip_with({a}[0], {b}[0], (p, q) -> hypot(p.x - q.x, p.y - q.y) * {metres}D < 0.01D), t -> t)")
    return df.select("id", F.round("o.x", 7).alias("lon"), F.round("o.y", 7).alias("lat"), off("r", "b", 111_320.0).alias("back_within_cm"), off("s", "t", 1.0).alias("sheet_within_cm"))


@query("normalize_layer", sql("fx_layer", """
SELECT feature_id, 'forest_class' AS layer_id, CASE WHEN code = 'UFM110' THEN '임업용산지' WHEN code = 'UFM200' THEN '준보전산지' ELSE name END AS name, code FROM fx_layer WHERE code <> '' UNION ALL
SELECT feature_id, 'ecological_nature', CASE WHEN feature_id % 3 = 0 THEN '생태·자연도' ELSE '생태·자연도 ' || code || '등급' END, CASE WHEN feature_id % 3 = 0 THEN '' ELSE code END FROM fx_layer UNION ALL
SELECT feature_id, 'ecological_separate_management', CASE WHEN forest_type = '' THEN '국립공원: ' || species ELSE '국립공원: ' || species || ' / 비고: ' || forest_type END, 'SPECIAL' FROM fx_layer"""))
def normalize_layer(i: Inputs):
    raw = i.view("fx_layer")
    forest = raw.select("feature_id", F.expr("map('UCODE', CASE WHEN code LIKE 'UFM%' THEN 'x ' || lower(code) ELSE code END, 'ALIAS', name, 'uname', '')").alias("properties"))
    eco = raw.select("feature_id", F.expr("map('생태자연도', CASE WHEN feature_id % 3 = 0 THEN ' ' ELSE code || ' ' END)").alias("properties"))
    sep = raw.select("feature_id", F.expr("map('국립공원', species, '비고', forest_type)").alias("properties"))
    parts = [shape.normalize_layer(df, lid).select("feature_id", F.lit(lid).alias("layer_id"), "name", "code")
             for df, lid in ((forest, "forest_class"), (eco, "ecological_nature"), (sep, "ecological_separate_management"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("layer_catalog", sql("fx_layer", """
SELECT r.layer_id, r.title, r.provider, r.ready AND r.available AS usable, count(l.feature_id) AS feature_count, count(DISTINCT l.code) AS codes, min(l.x0) AS minx, max(l.x1) AS maxx
FROM registry r LEFT JOIN fx_layer l ON l.layer_id = r.layer_id GROUP BY ALL""", REGISTRY_CTE))
def layer_catalog(i: Inputs):
    return shape.layer_catalog(i.layer(), i.registry())


@query("assume_demolished", sql("fx_cases", """
SELECT id, lift AS assume_demolished, pr AND NOT lift AS placement_restricted, CASE WHEN lift THEN 'conditional' ELSE CASE WHEN pr THEN 'not_allowed' ELSE 'allowed' END END AS display_verdict
FROM (SELECT *, pr AND hb AND NOT bl AS lift FROM (SELECT id, id % 2 = 0 AS hb, geom_area < 1000 AS bl, id % 2 = 0 OR geom_area < 1000 AS pr FROM fx_cases) a) b"""))
def assume_demolished(i: Inputs):
    df = i.view("fx_cases").selectExpr("id", "id % 2 = 0 AS has_buildings", "geom_area < 1000 AS below_min_lot",
                                       "id % 2 = 0 OR geom_area < 1000 AS placement_restricted",
                                       "CASE WHEN id % 2 = 0 OR geom_area < 1000 THEN 'not_allowed' ELSE 'allowed' END AS display_verdict",
                                       "'' AS presentation_label")
    return verdict.assume_demolished(df).select("id", "assume_demolished", "placement_restricted", "display_verdict")


# --- streams: events are the request log (user = session, type = phase, value = milliseconds) ------


@query("latency_batch", sql("", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS phase, count(*) AS calls, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events GROUP BY 1, 2"""))
def latency_batch(i: Inputs):
    timings = i.view("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    out = jobs.latency(timings).drop("p95_ms")
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "mean_ms": F.round("mean_ms", 6)})


@query("latency_stream", sql("", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS phase, count(*) AS calls, round(avg(value), 6) AS mean_ms, max(value) AS max_ms,
  list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS p95_ms FROM events GROUP BY 1, 2"""))
def latency_stream(i: Inputs):
    stream = jobs.event_stream(i.spark, i.sf_dir).select("ts", F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    out = jobs.run_available(jobs.latency(stream), "latency", "update", keys=["window_start", "phase"])
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "mean_ms": F.round("mean_ms", 6)})


@query("dedupe_ttl_stream", sql("", """
SELECT ts, event_id, user_id, event_type FROM (WITH RECURSIVE o AS MATERIALIZED (SELECT ts, event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
 w AS (SELECT *, ts AS last, true AS answered FROM o WHERE rn = 1 UNION ALL
  SELECT o.*, CASE WHEN o.ts - w.last >= INTERVAL 15 MINUTE THEN o.ts ELSE w.last END, o.ts - w.last >= INTERVAL 15 MINUTE FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.rn = w.rn + 1)
 SELECT * FROM w) x WHERE answered"""))
def dedupe_ttl_stream(i: Inputs):
    stream = jobs.event_stream(i.spark, i.sf_dir).select("ts", "event_id", "user_id", "event_type")
    out = jobs.run_available(jobs.dedupe_ttl(stream, ["user_id", "event_type"]), "dedupe")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("session_state_stream", sql("", """
SELECT user_id AS session, arg_max(parcel, (ts, event_id)) AS active, arg_max(event_type, (ts, event_id)) AS last_intent, count(*) FILTER (parcel <> prev AND seen) AS restored, count(DISTINCT parcel) AS parcels, count(*) AS events
FROM (SELECT *, lag(parcel) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, row_number() OVER (PARTITION BY user_id, parcel ORDER BY ts, event_id) > 1 AS seen
 FROM (SELECT *, 'P' || CAST(event_id % 7 AS STRING) AS parcel FROM events) a) b GROUP BY user_id"""))
def session_state_stream(i: Inputs):
    stream = jobs.event_stream(i.spark, i.sf_dir).selectExpr("user_id AS session", "event_id", "ts", "'P' || string(event_id % 7) AS parcel", "event_type AS intent")
    return jobs.run_available(jobs.session_state(stream), "session", keys=["session"])


@query("diagnose_stream", sql("fx_cases fx_statutory", """
SELECT e.event_id, e.event_id % 997 AS id, c.pnu, c.zone, c.id IS NOT NULL AS answered FROM events e LEFT JOIN fx_cases c ON c.id = e.event_id % 997"""))
def diagnose_stream(i: Inputs):
    requests = jobs.event_stream(i.spark, i.sf_dir).selectExpr("event_id", "event_id % 997 AS id")
    return jobs.run_available(jobs.diagnose_stream(requests, i.view("fx_cases").select("id", "pnu", "zone"), "id"), "diagnose")


@query("refresh_stream", sql("", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id"""))
def refresh_stream(i: Inputs):
    import uuid
    from ..session import checkpoint_dir
    stream = jobs.event_stream(i.spark, i.sf_dir).select("user_id", "ts", "event_id")
    latest = jobs.refresh(stream, ["user_id"], "ts", f"{checkpoint_dir(i.spark)}/refresh-{uuid.uuid4().hex}")
    return latest().withColumn("ts", F.col("ts").cast("timestamp_ntz"))

"""Queries over geometry, grid and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import geometry as geo
from ..operators import grid, spatial
from .registry import LAYER_REGISTRY, REGISTRY_CTE, Inputs, query, sql

# overlap of a parcel rectangle with a layer rectangle whose top right corner is cut at 45 degrees, less its rectangular hole
OVERLAP_CTE = """
ov_box AS (SELECT p.pnu, p.id, p.geom_area, l.feature_id, l.layer_id, l.name, l.code, l.forest_type, l.species, l.updated_year,
    greatest(p.x0, l.x0) AS ax, least(p.x1, l.x1) AS bx, greatest(p.y0, l.y0) AS ay, least(p.y1, l.y1) AS by_,
    l.x1 + l.y1 - l.cut AS lim, CASE WHEN l.feature_id % 3 = 0 THEN
      greatest(least(p.x1, (l.x0 + l.x1) / 2) - greatest(p.x0, l.x0 + (l.x1 - l.x0) / 4), 0) * greatest(least(p.y1, (l.y0 + l.y1) / 2) - greatest(p.y0, l.y0 + (l.y1 - l.y0) / 4), 0) ELSE 0 END AS hole
  FROM fx_parcels p JOIN fx_layer l ON p.x0 < l.x1 AND p.x1 > l.x0 AND p.y0 < l.y1 AND p.y1 > l.y0),
ov_area AS (SELECT *, (bx - ax) * (by_ - ay) - (
    power(greatest(bx + by_ - lim, 0), 2) - power(greatest(ax + by_ - lim, 0), 2)
    - power(greatest(bx + ay - lim, 0), 2) + power(greatest(ax + ay - lim, 0), 2)) / 2 - hole AS area FROM ov_box),
ov AS (SELECT pnu, id, feature_id, layer_id, name, code, forest_type, species, updated_year, round_even(area, 1) AS area_m2,
    round_even(area * 100 / geom_area, 1) AS share_pct FROM ov_area WHERE area > 0.000001)"""

# union of same-zone rectangles on each parcel: slabs between distinct x, merged spans in y
SHARES_CTE = """
zp AS (SELECT p.pnu, p.geom_area, z.zone_name AS zone, greatest(p.x0, z.x0) AS ax, least(p.x1, z.x1) AS bx,
    greatest(p.y0, z.y0) AS ay, least(p.y1, z.y1) AS by_
  FROM fx_parcels p JOIN fx_zones z ON p.x0 < z.x1 AND p.x1 > z.x0 AND p.y0 < z.y1 AND p.y1 > z.y0
  WHERE z.zone_name LIKE '%지역'),
zx AS (SELECT DISTINCT pnu, zone, x FROM (SELECT pnu, zone, ax AS x FROM zp UNION ALL SELECT pnu, zone, bx FROM zp) u),
zs AS (SELECT pnu, zone, x AS sa, lead(x) OVER (PARTITION BY pnu, zone ORDER BY x) AS sb FROM zx),
zi AS (SELECT zs.pnu, zs.zone, sa, sb, ay, by_, max(by_) OVER (PARTITION BY zs.pnu, zs.zone, sa ORDER BY ay, by_
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM zs JOIN zp ON zp.pnu = zs.pnu AND zp.zone = zs.zone AND zp.ax <= sa AND zp.bx >= sb WHERE sb IS NOT NULL),
za AS (SELECT pnu, zone, sum((sb - sa) * greatest(by_ - greatest(ay, coalesce(prev, ay)), 0)) AS area FROM zi GROUP BY pnu, zone),
shares AS (SELECT za.pnu, za.zone, round_even(least(area, geom_area), 1) AS area_m2,
    round_even(least(least(area, geom_area) / geom_area * 100, 100.0), 1) AS share_pct
  FROM za JOIN fx_parcels p ON p.pnu = za.pnu
  WHERE round_even(least(least(area, geom_area) / geom_area * 100, 100.0), 1) >= 1.0)"""

# contact of rectangle a's boundary with the 0.35 m neighbourhood of rectangle b
ADJ_CTE = """
adj_pair AS (SELECT p.pnu, p.id, q.pnu AS n_id, q.jimok AS n_jimok, p.x0, p.y0, p.x1, p.y1, q.x0 AS qx0, q.y0 AS qy0, q.x1 AS qx1, q.y1 AS qy1
  FROM fx_parcels p JOIN fx_parcels q ON q.gx BETWEEN p.gx - 2 AND p.gx + 2 AND q.gy BETWEEN p.gy - 2 AND p.gy + 2 AND p.id <> q.id
    AND q.x0 <= p.x1 + 0.35 AND q.x1 >= p.x0 - 0.35 AND q.y0 <= p.y1 + 0.35 AND q.y1 >= p.y0 - 0.35),
adj_edge AS (
  SELECT pnu, n_id, n_jimok, 'h' AS k, x0 AS lo, x1 AS hi, qx0 AS blo, qx1 AS bhi, greatest(qy0 - y0, y0 - qy1, 0) AS d FROM adj_pair UNION ALL
  SELECT pnu, n_id, n_jimok, 'h', x0, x1, qx0, qx1, greatest(qy0 - y1, y1 - qy1, 0) FROM adj_pair UNION ALL
  SELECT pnu, n_id, n_jimok, 'v', y0, y1, qy0, qy1, greatest(qx0 - x0, x0 - qx1, 0) FROM adj_pair UNION ALL
  SELECT pnu, n_id, n_jimok, 'v', y0, y1, qy0, qy1, greatest(qx0 - x1, x1 - qx1, 0) FROM adj_pair),
adj_len AS (SELECT pnu, n_id, n_jimok, sum(CASE WHEN d > 0.35 THEN 0 ELSE
    greatest(least(hi, bhi + sqrt(0.1225 - d * d)) - greatest(lo, blo - sqrt(0.1225 - d * d)), 0) END) AS len
  FROM adj_edge GROUP BY pnu, n_id, n_jimok),
adj AS (SELECT pnu, n_id, n_jimok, round_even(len, 1) AS contact_length_m FROM adj_len WHERE len > 0.0000001)"""


@query("layer_ingest", sql("fx_layer", """
SELECT l.feature_id, l.layer_id, c.cx, c.cy, l.x0 AS minx, l.y0 AS miny, l.x1 AS maxx, l.y1 AS maxy
FROM fx_layer l JOIN (SELECT DISTINCT a.cx, b.cy FROM
   (SELECT unnest(range(-2, 400)) AS cx) a, (SELECT unnest(range(-2, 4000)) AS cy) b) c
 ON c.cx BETWEEN floor(l.x0 / 320) AND floor(l.x1 / 320) AND c.cy BETWEEN floor(l.y0 / 320) AND floor(l.y1 / 320)"""))
def layer_ingest(i: Inputs):
    from ..sources.layers import prepare_layer
    raw = i.layer().select("feature_id", "layer_id", "name", "code", "rings")
    prepared = prepare_layer(raw, src_crs=None)
    return grid.with_cells(prepared, 320.0).select("feature_id", "layer_id", "cx", "cy", "minx", "miny", "maxx", "maxy")


@query("grid_cells", sql("fx_parcels", """
SELECT id, cx, cy FROM (SELECT id, x0, x1, y0, y1, CAST(floor(x0 / 160) AS BIGINT) + dx AS cx, CAST(floor(y0 / 160) AS BIGINT) + dy AS cy
  FROM fx_parcels, (SELECT unnest([0, 1]) AS dx) a, (SELECT unnest([0, 1]) AS dy) b) t
WHERE cx <= floor(x1 / 160) AND cy <= floor(y1 / 160)"""))
def grid_cells(i: Inputs):
    return grid.with_cells(i.parcels(), 160.0).select("id", "cx", "cy")


@query("window_query", sql("fx_layer", """
SELECT feature_id, layer_id, name FROM fx_layer WHERE x0 <= 5200 AND x1 >= 1000 AND y0 <= 900.5 AND y1 >= 310"""))
def window_query(i: Inputs):
    stored = grid.with_cells(i.layer(), 320.0)
    return grid.bbox_filter_cells(stored, 320.0, 1000.0, 310.0, 5200.0, 900.5).select("feature_id", "layer_id", "name")


@query("outer_rings", sql("fx_layer", """
SELECT feature_id, CAST(0 AS BIGINT) AS part, CAST(seq AS BIGINT) AS seq, x, y FROM (
  SELECT feature_id, 0 AS seq, x0 AS x, y0 AS y FROM fx_layer UNION ALL SELECT feature_id, 1, x1, y0 FROM fx_layer UNION ALL
  SELECT feature_id, 2, x1, y1 - cut FROM fx_layer UNION ALL SELECT feature_id, 3, x1 - cut, y1 FROM fx_layer UNION ALL
  SELECT feature_id, 4, x0, y1 FROM fx_layer) t"""))
def outer_rings(i: Inputs):
    outer = F.expr(geo.keep("rings", lambda r: f"{geo.ring_area(r)} > 0"))
    rings = i.layer().select("feature_id", F.posexplode(outer).alias("part", "ring"))
    return rings.select("feature_id", F.col("part").cast("bigint").alias("part"), F.posexplode("ring").alias("seq", "pt")) \
        .select("feature_id", "part", F.col("seq").cast("bigint").alias("seq"), F.col("pt.x").alias("x"), F.col("pt.y").alias("y"))


@query("polygon_area", sql("fx_layer", """
SELECT feature_id, (x1 - x0) * (y1 - y0) - cut * cut / 2 - CASE WHEN feature_id % 3 = 0 THEN (x1 - x0) * (y1 - y0) / 16 ELSE 0 END AS area_m2 FROM fx_layer"""))
def polygon_area(i: Inputs):
    return i.layer().select("feature_id", F.expr(geo.area("rings")).alias("area_m2"))


@query("geodesic_area", sql("fx_parcels", """
SELECT id, round(6378137.0 * 6378137.0 / 2 * radians((x1 - x0) / 100000) * (
   0.9933056200098587 * (sin(radians(37 + y1 / 100000)) / (1 - 0.0066943799901413165 * power(sin(radians(37 + y1 / 100000)), 2))
     - ln((1 - 0.08181919084262149 * sin(radians(37 + y1 / 100000))) / (1 + 0.08181919084262149 * sin(radians(37 + y1 / 100000)))) / (2 * 0.08181919084262149))
 - 0.9933056200098587 * (sin(radians(37 + y0 / 100000)) / (1 - 0.0066943799901413165 * power(sin(radians(37 + y0 / 100000)), 2))
     - ln((1 - 0.08181919084262149 * sin(radians(37 + y0 / 100000))) / (1 + 0.08181919084262149 * sin(radians(37 + y0 / 100000)))) / (2 * 0.08181919084262149))), 1) AS area_m2
FROM fx_parcels"""))
def geodesic_area(i: Inputs):
    ring = geo.rectangle("127 + x0 / 100000", "37 + y0 / 100000", "127 + x1 / 100000", "37 + y1 / 100000")
    return i.view("fx_parcels").select("id", F.round(F.expr(geo.geodesic_area(ring)), 1).alias("area_m2"))


@query("locate_parcel", sql("fx_points fx_parcels", """
SELECT p.event_id, p.px, p.py, coalesce(i.id, n.id) AS id,
  round(CASE WHEN i.id IS NOT NULL THEN 0 ELSE n.d END, 3) AS distance,
  CASE WHEN i.id IS NOT NULL THEN 'contains' WHEN n.id IS NOT NULL THEN 'nearest' ELSE 'none' END AS matched
FROM fx_points p LEFT JOIN inside i ON i.event_id = p.event_id LEFT JOIN near n ON n.event_id = p.event_id""", """
inside AS (SELECT event_id, min(id) AS id FROM fx_points JOIN fx_parcels
   ON gx BETWEEN floor(px / 40) - 1 AND floor(px / 40) + 1 AND gy BETWEEN floor(py / 40) - 1 AND floor(py / 40) + 1
   AND px >= x0 AND px < x1 AND py >= y0 AND py < y1 GROUP BY event_id),
near AS (SELECT event_id, id, d FROM (SELECT event_id, id, d, row_number() OVER (PARTITION BY event_id ORDER BY d, id) AS rn FROM (
   SELECT event_id, id, sqrt(power(greatest(x0 - px, px - x1, 0), 2) + power(greatest(y0 - py, py - y1, 0), 2)) AS d
   FROM fx_points JOIN fx_parcels ON gx BETWEEN floor(px / 40) - 2 AND floor(px / 40) + 2 AND gy BETWEEN floor(py / 40) - 2 AND floor(py / 40) + 2
   AND x0 <= px + 15 AND x1 >= px - 15 AND y0 <= py + 15 AND y1 >= py - 15) a) b WHERE rn = 1)"""))
def locate_parcel(i: Inputs):
    out = spatial.locate(i.view("fx_points"), i.parcels(), "event_id", "id")
    return out.withColumn("distance", F.round("distance", 3))


@query("zones_at_point", sql("fx_parcels fx_zones", """
SELECT p.id, coalesce(string_agg(name, ',' ORDER BY layer_no, feature_id) FILTER (name LIKE '%지역'), '') AS zones,
  coalesce(string_agg(name, ',' ORDER BY layer_no, feature_id) FILTER (name NOT LIKE '%지역'), '') AS districts,
  CASE WHEN count(*) FILTER (name LIKE '%지역') > 0 THEN 'FOUND' ELSE 'UNKNOWN' END AS status
FROM fx_parcels p LEFT JOIN firsts f ON f.id = p.id GROUP BY p.id""", """
hit AS (SELECT p.id, z.zone_name AS name, z.layer_no, z.feature_id,
   row_number() OVER (PARTITION BY p.id, z.zone_name ORDER BY z.layer_no, z.feature_id) AS rn
  FROM fx_parcels p JOIN fx_zones z ON (p.x0 + p.x1) / 2 >= z.x0 AND (p.x0 + p.x1) / 2 < z.x1
   AND (p.y0 + p.y1) / 2 >= z.y0 AND (p.y0 + p.y1) / 2 < z.y1),
firsts AS (SELECT * FROM hit WHERE rn = 1)"""))
def zones_at_point(i: Inputs):
    return spatial.zones_at(spatial.interior_point(i.parcels()), i.zones(), "id")


@query("overlay", sql("fx_parcels fx_layer", "SELECT pnu, feature_id, layer_id, name, code, area_m2, share_pct FROM ov", OVERLAP_CTE))
def overlay(i: Inputs):
    return spatial.overlay(i.parcels(), i.layer())


LAYER_STATUS_CTE = OVERLAP_CTE + ", " + REGISTRY_CTE + """,
ov_eff AS (SELECT * FROM ov WHERE share_pct > 0 AND area_m2 > 0),
lstat AS (SELECT p.pnu, r.layer_id, r.title,
   CASE WHEN NOT r.ready THEN 'NOT_CONFIGURED' WHEN NOT r.available THEN 'UNAVAILABLE' WHEN o.n > 0 THEN 'OVERLAP' ELSE 'CLEAR' END AS status,
   CAST(CASE WHEN r.ready AND r.available THEN coalesce(o.n, 0) ELSE 0 END AS BIGINT) AS n_overlaps
  FROM fx_parcels p CROSS JOIN registry r LEFT JOIN (SELECT pnu, layer_id, count(*) AS n FROM ov GROUP BY 1, 2) o
   ON o.pnu = p.pnu AND o.layer_id = r.layer_id),
lcomp AS (SELECT s.pnu, s.layer_id, s.title, CASE WHEN s.status = 'OVERLAP' AND coalesce(e.n, 0) = 0 THEN 'CLEAR' ELSE s.status END AS status,
   CAST(coalesce(e.n, 0) AS BIGINT) AS kept
  FROM lstat s LEFT JOIN (SELECT pnu, layer_id, count(*) AS n FROM ov_eff GROUP BY 1, 2) e ON e.pnu = s.pnu AND e.layer_id = s.layer_id)"""


@query("inspect_layers", sql("fx_parcels fx_layer", "SELECT * FROM lstat", LAYER_STATUS_CTE))
def inspect_layers(i: Inputs):
    par = i.parcels()
    return spatial.inspect_layers(par, spatial.overlay(par, i.layer()), LAYER_REGISTRY)


@query("compact_layers", sql("fx_parcels fx_layer", "SELECT pnu, layer_id, status, kept FROM lcomp", LAYER_STATUS_CTE))
def compact_layers(i: Inputs):
    par = i.parcels()
    ov = spatial.overlay(par, i.layer())
    return spatial.compact_layers(spatial.inspect_layers(par, ov, LAYER_REGISTRY), ov).select("pnu", "layer_id", "status", "kept")


@query("zone_shares", sql("fx_parcels fx_zones", "SELECT * FROM shares", SHARES_CTE))
def zone_shares(i: Inputs):
    return spatial.zone_shares(i.parcels(), i.zones())


LEDGER_CTE = """
led AS (SELECT id, ledger_area FROM (SELECT id, ledger_area, row_number() OVER (PARTITION BY id ORDER BY std_year DESC, updated DESC, ledger_area DESC) AS rn
   FROM fx_ledger WHERE ledger_area IS NOT NULL AND ledger_area <> 0) t WHERE rn = 1),
area AS (SELECT p.id, p.pnu, round_even(CASE WHEN l.ledger_area > 0 THEN l.ledger_area ELSE p.geom_area END, 1) AS area_m2,
   CASE WHEN l.ledger_area > 0 THEN 'ledger' ELSE 'geometry' END AS area_source
   FROM fx_parcels p LEFT JOIN led l ON l.id = p.id)"""
RESCALE_CTE = LEDGER_CTE + ", " + SHARES_CTE.strip() + """,
rescaled AS (SELECT s.pnu, s.zone, CASE WHEN a.area_m2 > 0 AND abs(a.area_m2 - p.geom_area) > 0.05
    THEN round_even(s.area_m2 * (a.area_m2 / p.geom_area), 1) ELSE s.area_m2 END AS area_m2, s.share_pct
  FROM shares s JOIN fx_parcels p ON p.pnu = s.pnu JOIN area a ON a.pnu = s.pnu)"""


@query("rescale_shares", sql("fx_parcels fx_zones fx_ledger", "SELECT * FROM rescaled", RESCALE_CTE))
def rescale_shares(i: Inputs):
    from ..operators import keys
    par = i.parcels()
    sized = keys.resolve_area(par, i.view("fx_ledger"))
    return spatial.rescale_shares(spatial.zone_shares(par, i.zones()), sized)


@query("adjacency", sql("fx_parcels", "SELECT pnu, n_id, n_jimok, contact_length_m FROM adj", ADJ_CTE))
def adjacency(i: Inputs):
    return spatial.adjacency(i.parcels()).drop("edge_contacts")


@query("region_scan", sql("fx_parcels fx_zones", """
SELECT pnu, px, py, zone FROM (SELECT p.pnu, (p.x0 + p.x1) / 2 AS px, (p.y0 + p.y1) / 2 AS py, z.zone_name AS zone,
   row_number() OVER (PARTITION BY p.pnu ORDER BY z.feature_id) AS rn
  FROM fx_parcels p JOIN fx_zones z ON (p.x0 + p.x1) / 2 >= z.x0 AND (p.x0 + p.x1) / 2 < z.x1
   AND (p.y0 + p.y1) / 2 >= z.y0 AND (p.y0 + p.y1) / 2 < z.y1
  WHERE z.zone_name IN (""" + ", ".join(f"'{z}'" for z in fv.CANDIDATE_ZONES) + """)) t WHERE rn = 1"""))
def region_scan(i: Inputs):
    return spatial.region_scan(i.parcels(), i.zones())

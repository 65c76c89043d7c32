"""Queries over measures, charges, terrain, roads and drainage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import keys, measures, roads, rules, spatial
from .registry import Inputs, query, sql, values
from .rule_queries import CONSTRAINT_CTE, JIMOK_CTE, constraints as constraint_rows, limits_cte
from .spatial_queries import ADJ_CTE, OVERLAP_CTE, SHARES_CTE

WEIGHT_CTE = SHARES_CTE.strip() + """,
zj AS (SELECT p.id, s.pnu, s.zone, p.jurisdiction, s.area_m2 FROM shares s JOIN fx_parcels p ON p.pnu = s.pnu),
""" + limits_cte("zl", "zj") + """,
wt AS (SELECT z.pnu, count(*) AS pieces, CASE WHEN count(*) >= 2 AND min(z.area_m2) <= 330 THEN CASE WHEN bool_and(l.found) THEN 'WEIGHTED' ELSE 'UNRESOLVED' END
    ELSE 'UNCHANGED' END AS weighting, CAST(sum(CAST(z.area_m2 AS DECIMAL(18,1)) * CAST(l.bcr_max_pct AS DECIMAL(9,1))) AS DOUBLE) / CAST(sum(CAST(z.area_m2 AS DECIMAL(18,1))) AS DOUBLE) AS b, CAST(sum(CAST(z.area_m2 AS DECIMAL(18,1)) * CAST(l.far_max_pct AS DECIMAL(9,1))) AS DOUBLE) / CAST(sum(CAST(z.area_m2 AS DECIMAL(18,1))) AS DOUBLE) AS f
  FROM zj z JOIN zl l ON l.id = z.id AND l.zone = z.zone WHERE z.area_m2 > 0 GROUP BY z.pnu)"""


def share_limits(i: Inputs, par=None):
    par = par if par is not None else i.parcels()
    sh = spatial.zone_shares(par, i.zones()).join(i.view("fx_parcels").select("pnu", "jurisdiction"), "pnu")
    return keys.resolve_limits(sh, i.view("fx_statutory"), i.view("fx_ordinance"))


@query("weighted_limits", sql("fx_parcels fx_zones fx_statutory fx_ordinance", """
SELECT pnu, pieces, weighting, CASE WHEN weighting = 'WEIGHTED' THEN round_even(b, 1) END AS weighted_bcr_pct,
  CASE WHEN weighting = 'WEIGHTED' THEN round_even(f, 1) END AS weighted_far_pct FROM wt""", WEIGHT_CTE))
def weighted_limits(i: Inputs):
    return measures.weighted_limits(share_limits(i))


MASS_CTE = limits_cte("lim", "fx_cases") + """,
m0 AS (SELECT c.id, c.building_use, c.parking_strategy, c.geom_area AS area_m2, l.bcr_max_pct, l.far_max_pct, coalesce(c.far_target > l.far_max_pct, false) AS exceeds_far_limit,
   CASE WHEN c.far_target > l.far_max_pct THEN l.far_max_pct ELSE c.far_target END AS far_applied_pct
  FROM fx_cases c JOIN lim l ON l.id = c.id WHERE l.found),
m1 AS (SELECT *, area_m2 * bcr_max_pct / 100.0 AS ba, area_m2 * far_applied_pct / 100.0 AS gfa FROM m0),
m2 AS (SELECT *, gfa / ba AS fl, greatest(1, CAST(ceil(gfa / ba - 1e-9) AS INTEGER)) AS floors, greatest(0, CAST(floor(gfa / ba + 1e-9) AS INTEGER)) AS full_floors FROM m1),
mass AS (SELECT id, building_use, parking_strategy, far_applied_pct, exceeds_far_limit, round_even(ba, 2) AS building_area_m2, round_even(gfa, 2) AS gross_floor_area_m2,
   round_even(fl, 2) AS floors_theoretical, floors, full_floors, round_even(CASE WHEN floors = full_floors THEN 1.0 ELSE fl - full_floors END, 3) AS top_floor_ratio,
   round_even(floors * 3.3, 1) AS mass_height_m FROM m2)"""


def case_massing(i: Inputs):
    c = i.view("fx_cases")
    lim = keys.resolve_limits(c, i.view("fx_statutory"), i.view("fx_ordinance")).filter("found")
    return measures.massing(lim.withColumns({"area_m2": F.col("geom_area"), "far_target_pct": F.col("far_target")}))


@query("massing", sql("fx_cases fx_statutory fx_ordinance", "SELECT * EXCLUDE (building_use, parking_strategy) FROM mass", MASS_CTE))
def massing(i: Inputs):
    return case_massing(i).select("id", "far_applied_pct", "exceeds_far_limit", "building_area_m2", "gross_floor_area_m2",
                                  "floors_theoretical", "floors", "full_floors", "top_floor_ratio", "mass_height_m")


PARK_RULES_CTE = values([(u, m, n) for u, (m, n) in fv.PARKING_RULES.items()], "prules", "use, mode, unit")


@query("parking", sql("fx_cases fx_statutory fx_ordinance", """
SELECT id, building_use, gross_floor_area_m2, spaces, spaces * 25.0 AS surface_area_m2,
  CASE WHEN parking_strategy = 'surface' THEN 'APPLIED' WHEN parking_strategy IN ('underground', 'mechanical', 'mixed') THEN 'DESIGN_REQUIRED' ELSE 'NEEDS_SELECTION' END AS parking_status,
  CASE WHEN parking_strategy = 'surface' THEN spaces * 25.0 ELSE 0 END AS applied_surface_m2
FROM (SELECT m.*, CAST(CASE r.mode WHEN 'detached_house' THEN CASE WHEN gross_floor_area_m2 <= 50 THEN 0 WHEN gross_floor_area_m2 <= 150 THEN 1
    ELSE 1 + ceil((gross_floor_area_m2 - 150) / r.unit) END WHEN 'household_proxy' THEN greatest(1, ceil(gross_floor_area_m2 / r.unit))
    WHEN 'area_ratio' THEN ceil(gross_floor_area_m2 / r.unit) ELSE 0 END AS BIGINT) AS spaces FROM mass m LEFT JOIN prules r ON r.use = m.building_use) t""",
    MASS_CTE + ", " + PARK_RULES_CTE))
def parking(i: Inputs):
    return measures.parking(case_massing(i)).select("id", "building_use", "gross_floor_area_m2", "spaces", "surface_area_m2",
                                                    "parking_status", "applied_surface_m2")


PRICE_CTE = """
price AS (SELECT id, price_won_m2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY std_year DESC, std_month DESC, notice_date DESC, price_won_m2 DESC) AS rn
   FROM fx_prices WHERE price_won_m2 > 0) t WHERE rn = 1)"""
CHARGE_CTE = JIMOK_CTE + ", " + PRICE_CTE + ", " + OVERLAP_CTE + """,
ag AS (SELECT DISTINCT id FROM ov WHERE layer_id = 'agricultural_promotion' AND share_pct > 0 AND area_m2 > 0),
fo AS (SELECT id, code FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area_m2 DESC, feature_id) AS rn FROM ov
   WHERE layer_id = 'forest_class' AND share_pct > 0 AND area_m2 > 0) t WHERE rn = 1),
ci AS (SELECT c.id, j.category, c.geom_area / 2 AS area, CAST(p.price_won_m2 AS DOUBLE) AS price, ag.id IS NOT NULL AS promo, fo.code
  FROM fx_cases c JOIN jcat j ON j.id = c.id LEFT JOIN price p ON p.id = c.id LEFT JOIN ag ON ag.id = c.id LEFT JOIN fo ON fo.id = c.id),
cu AS (SELECT *, CASE WHEN code IN ('UFM100', 'UFM110', 'UFM120') THEN 10840.0::DOUBLE ELSE 8340.0::DOUBLE END AS base FROM ci),
cw AS (SELECT *, CASE WHEN category = 'farmland' THEN least(price * CASE WHEN promo THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END, 50000) ELSE base + least(price * 0.001::DOUBLE, base) END AS unit FROM cu)"""


def largest_overlap(ov, layer_id: str):
    """Code and name of the largest effective overlap of one layer per parcel."""
    return (spatial.effective(ov).filter(F.col("layer_id") == layer_id).groupBy("pnu")
            .agg(F.min(F.struct((-F.col("area_m2")).alias("a"), "feature_id", "code", "name")).alias("b")))


@query("conversion_charge", sql("fx_cases fx_parcels fx_prices fx_layer", """
SELECT id, CASE WHEN price > 0 THEN CASE category WHEN 'farmland' THEN 'farmland_conservation' WHEN 'forest' THEN 'forest_replacement' END END AS charge_type,
  CASE WHEN price > 0 AND category IN ('farmland', 'forest') THEN CAST(round_even(unit, 0) AS BIGINT) END AS charge_unit_won,
  CASE WHEN price > 0 AND category IN ('farmland', 'forest') THEN CAST(round_even(area * unit, 0) AS BIGINT) END AS charge_won FROM cw""", CHARGE_CTE))
def conversion_charge(i: Inputs):
    ov = spatial.overlay(i.parcels(), i.layer())
    ag = spatial.effective(ov).filter("layer_id = 'agricultural_promotion'").select("pnu").distinct().withColumn("agriculture_status", F.lit("OVERLAP"))
    fo = largest_overlap(ov, "forest_class").select("pnu", F.col("b.code").alias("forest_code"))
    df = (rules.classify_jimok(i.view("fx_cases")).withColumn("conversion_area_m2", F.col("geom_area") / 2)
          .join(keys.latest_price(i.view("fx_prices")), "id", "left").join(ag, "pnu", "left").join(fo, "pnu", "left"))
    return measures.conversion_charge(df).select("id", "charge_type", "charge_unit_won", "charge_won")


SIDO_CTE = values([(n, k, s) for n, (k, s) in enumerate(fv.SIDO_KEYS)], "sidos", "pos, k, sido") + ", " + \
    values([(s, c, a) for s, (c, a) in fv.DEV_REGIONS.items()], "stats", "sido, n, amt")


@query("development_charge", sql("fx_cases", """
SELECT id, CAST(CASE WHEN need THEN thr END AS INTEGER) AS dev_threshold_m2, CASE WHEN need THEN area_m2 >= thr END AS dev_applicable,
  CASE WHEN need THEN coalesce(sido, '전국') END AS dev_region,
  CASE WHEN need THEN CAST(round_even(coalesce(amt * 1000000.0::DOUBLE / n, 372979 * 1000000.0::DOUBLE / 4498), 0) AS BIGINT) END AS dev_region_avg_won,
  CASE WHEN need THEN CAST(round_even(372979 * 1000000.0::DOUBLE / 4498, 0) AS BIGINT) END AS dev_national_avg_won
FROM (SELECT a.*, s.n, s.amt, CASE WHEN contains(zone, '관리지역') OR contains(zone, '농림지역') OR contains(zone, '자연환경보전지역') THEN 1650
   WHEN a.sido IN ('서울', '부산', '대구', '인천', '광주', '대전', '울산') THEN 660 ELSE 990 END AS thr
  FROM (SELECT c.id, c.zone, c.geom_area AS area_m2, j.category IN ('farmland', 'forest') AS need,
    (SELECT k.sido FROM sidos k WHERE contains(c.jurisdiction || ' ' || c.address, k.k) ORDER BY k.pos LIMIT 1) AS sido
   FROM fx_cases c JOIN jcat j ON j.id = c.id) a LEFT JOIN stats s ON s.sido = a.sido) t""", JIMOK_CTE + ", " + SIDO_CTE))
def development_charge(i: Inputs):
    df = rules.classify_jimok(i.view("fx_cases")).withColumn("area_m2", F.col("geom_area"))
    return measures.development_charge(df).select("id", "dev_threshold_m2", "dev_applicable", "dev_region", "dev_region_avg_won", "dev_national_avg_won")


@query("inventory_summary", sql("fx_parcels fx_layer", """
SELECT pnu, forest_type, species, updated_year, round_even(sum(area_m2), 1) AS area_m2, round_even(least(sum(share_pct), 100.0), 1) AS share_pct
FROM ov WHERE layer_id = 'forest_inventory' AND share_pct > 0 AND area_m2 > 0 GROUP BY 1, 2, 3, 4""", OVERLAP_CTE))
def inventory_summary(i: Inputs):
    attrs = ["forest_type", "species", "updated_year"]
    ov = spatial.overlay(i.parcels(), i.layer().filter("layer_id = 'forest_inventory'"), keep=tuple(attrs))
    return measures.inventory_summary(spatial.effective(ov), attrs)


@query("terrain", sql("fx_parcels fx_dem", """
SELECT p.pnu, a.cells, a.elevation_min_m, a.elevation_max_m, a.elevation_mean_m, a.slope_mean_deg, a.slope_max_deg, band0_pct, band1_pct, band2_pct, band3_pct, band4_pct,
  CASE WHEN a.cells > 0 THEN 'REFERENCE_AVAILABLE' ELSE 'NO_COVERAGE' END AS terrain_status
FROM fx_parcels p LEFT JOIN (SELECT p.pnu, count(*) AS cells, round(min(elev), 1) AS elevation_min_m, round(max(elev), 1) AS elevation_max_m, round(avg(elev), 1) AS elevation_mean_m,
   round(avg(slope), 1) AS slope_mean_deg, round(max(slope), 1) AS slope_max_deg,
   round_even(count(*) FILTER (slope < 5) / count(*) * 100, 1) AS band0_pct, round_even(count(*) FILTER (slope >= 5 AND slope < 10) / count(*) * 100, 1) AS band1_pct,
   round_even(count(*) FILTER (slope >= 10 AND slope < 15) / count(*) * 100, 1) AS band2_pct, round_even(count(*) FILTER (slope >= 15 AND slope < 20) / count(*) * 100, 1) AS band3_pct,
   round_even(count(*) FILTER (slope >= 20) / count(*) * 100, 1) AS band4_pct
  FROM fx_parcels p JOIN slope s ON p.x0 < (s.c + 1) * 30 AND p.x1 > s.c * 30 AND p.y0 < (s.r + 1) * 30 AND p.y1 > s.r * 30 WHERE slope IS NOT NULL GROUP BY p.pnu) a ON a.pnu = p.pnu""", """
nb AS (SELECT r, c, elev, lag(elev) OVER (PARTITION BY r ORDER BY c) AS l, lead(elev) OVER (PARTITION BY r ORDER BY c) AS rt,
   lag(elev) OVER (PARTITION BY c ORDER BY r) AS u, lead(elev) OVER (PARTITION BY c ORDER BY r) AS d FROM fx_dem),
slope AS (SELECT r, c, elev, degrees(atan(sqrt(power((coalesce(rt, elev) - coalesce(l, elev)) / nullif(30 * ((rt IS NOT NULL)::INT + (l IS NOT NULL)::INT), 0), 2)
   + power((coalesce(d, elev) - coalesce(u, elev)) / nullif(30 * ((d IS NOT NULL)::INT + (u IS NOT NULL)::INT), 0), 2)))) AS slope FROM nb)"""))
def terrain(i: Inputs):
    return measures.terrain(i.view("fx_dem"), i.parcels())


@query("compare_limits", sql("fx_statutory fx_ordinance", "SELECT * FROM cmp", cmp_cte := """
jz AS (SELECT s.zone, j.jurisdiction, s.bcr_max AS sb, s.far_max AS sf, o.bcr_max AS ob, o.far_max AS of_ FROM fx_statutory s CROSS JOIN (SELECT DISTINCT jurisdiction FROM fx_ordinance) j
   LEFT JOIN fx_ordinance o ON o.zone = s.zone AND o.jurisdiction = j.jurisdiction),
cmp AS (SELECT zone, '법정 상한' AS jurisdiction, true AS regulated, bcr_max AS bcr_max_pct, far_max AS far_max_pct, 0.0 AS bcr_gap, 0.0 AS far_gap FROM fx_statutory UNION ALL
 SELECT zone, jurisdiction, coalesce(ob, of_) IS NOT NULL, CASE WHEN coalesce(ob, of_) IS NOT NULL THEN coalesce(ob, sb) END, CASE WHEN coalesce(ob, of_) IS NOT NULL THEN coalesce(of_, sf) END,
  CASE WHEN coalesce(ob, of_) IS NOT NULL THEN sb - coalesce(ob, sb) END, CASE WHEN coalesce(ob, of_) IS NOT NULL THEN sf - coalesce(of_, sf) END FROM jz)"""))
def compare_limits(i: Inputs):
    return measures.compare_limits(i.view("fx_statutory"), i.view("fx_ordinance"))


@query("largest_gaps", sql("fx_statutory fx_ordinance", """
SELECT zone, jurisdiction, metric, applied, gap FROM (SELECT zone, jurisdiction, '용적률' AS metric, far_max_pct AS applied, far_gap AS gap FROM cmp WHERE regulated AND jurisdiction <> '법정 상한'
  UNION ALL SELECT zone, jurisdiction, '건폐율', bcr_max_pct, bcr_gap FROM cmp WHERE regulated AND jurisdiction <> '법정 상한') t WHERE gap <> 0
ORDER BY gap DESC, zone, jurisdiction, metric DESC LIMIT 10""", cmp_cte))
def largest_gaps(i: Inputs):
    return measures.largest_gaps(compare_limits(i), 10)


@query("accuracy_report", sql("fx_ordinance fx_auto_limits", """
SELECT count(*) AS ground_truth_values, count(*) FILTER (a = m) AS agree, count(*) FILTER (a <> m) AS disagree, count(*) FILTER (a IS NULL) AS auto_missing,
  round_even(100 * count(*) FILTER (a = m) / count(*), 1) AS accuracy_pct
FROM (SELECT o.bcr_max AS m, x.bcr_max AS a FROM fx_ordinance o LEFT JOIN fx_auto_limits x USING (jurisdiction, zone) UNION ALL
  SELECT o.far_max, x.far_max FROM fx_ordinance o LEFT JOIN fx_auto_limits x USING (jurisdiction, zone)) t WHERE m IS NOT NULL"""))
def accuracy_report(i: Inputs):
    return measures.accuracy_report(i.view("fx_auto_limits"), i.view("fx_ordinance"))


@query("coverage_report", sql("fx_chunks", """
SELECT coalesce(kind, '*') AS kind, coalesce(jurisdiction, '*') AS jurisdiction, CAST(CASE WHEN kind IS NULL THEN 3 WHEN jurisdiction IS NULL THEN 1 ELSE 0 END AS INTEGER) AS level,
  count(*) AS chunks, count(*) FILTER (trim(text) = '') AS blank_texts, CAST(0 AS BIGINT) AS missing_dates FROM fx_chunks GROUP BY ROLLUP (kind, jurisdiction)"""))
def coverage_report(i: Inputs):
    return measures.coverage_report(i.view("fx_chunks"))


@query("limits_collection", sql("fx_auto_limits", """
SELECT review_status, count(DISTINCT jurisdiction) AS jurisdictions, count(*) FILTER (bcr_max IS NOT NULL OR far_max IS NOT NULL) AS zones_filled
FROM fx_auto_limits GROUP BY review_status"""))
def limits_collection(i: Inputs):
    return measures.limits_collection_report(i.view("fx_auto_limits"))


# --- roads ---------------------------------------------------------------------------

ROAD_CTE = ADJ_CTE + """,
rw AS (SELECT pnu AS n_id, round_even(least(x1 - x0, y1 - y0), 1) AS width_m FROM fx_parcels WHERE jimok IN ('도', '도로')),
ra AS (SELECT p.pnu, p.id, CASE WHEN a.roads > 0 THEN 'CADASTRAL_CONTACT' ELSE 'NO_CADASTRAL_ROAD' END AS road_status, coalesce(a.roads, 0) AS roads, a.road_contact_m,
   coalesce(a.widest, 0) AS widest_m, coalesce(a.widest, 0) > 0 AND coalesce(a.widest, 0) < 4 AS narrow_road, coalesce(a.nonroads, 0) AS nonroads
  FROM fx_parcels p LEFT JOIN (SELECT a.pnu, count(*) FILTER (n_jimok = '도') AS roads, max(contact_length_m) FILTER (n_jimok = '도') AS road_contact_m,
     max(width_m) AS widest, count(*) FILTER (n_jimok <> '도') AS nonroads FROM adj a LEFT JOIN rw ON rw.n_id = a.n_id GROUP BY a.pnu) a ON a.pnu = p.pnu)"""


def road_neighbours(par, key: str = "pnu"):
    """Adjacency with the width of neighbouring roads."""
    return spatial.adjacency(roads.with_road_width(par), key, keep=("width_m",)).drop("edge_contacts")


def access(i: Inputs, par=None):
    par = par if par is not None else i.parcels()
    return roads.road_access(par, road_neighbours(par))


@query("road_width", sql("fx_layer fx_parcels", """
SELECT feature_id AS id, round_even(least(x1 - x0, y1 - y0), 1) AS width_m FROM fx_layer UNION ALL SELECT id, round_even(least(x1 - x0, y1 - y0), 1) FROM fx_parcels"""))
def road_width(i: Inputs):
    shapes = i.layer().select(F.col("feature_id").alias("id"), "rings").unionByName(i.parcels().select("id", "rings"))
    return roads.road_width(shapes).select("id", "width_m")


@query("road_access", sql("fx_parcels", "SELECT * EXCLUDE (id) FROM ra", ROAD_CTE))
def road_access(i: Inputs):
    return access(i)


@query("nonroad_neighbours", sql("fx_parcels", "SELECT pnu, n_jimok AS jimok, count(*) AS parcels FROM adj WHERE n_jimok <> '도' GROUP BY 1, 2", ADJ_CTE))
def nonroad_neighbours(i: Inputs):
    return roads.nonroad_neighbours(spatial.adjacency(i.parcels()))


PLANNED_CTE = ROAD_CTE + """,
oc AS (SELECT ra.id, ra.pnu, p.x0, p.y0, p.x1, p.y1 FROM ra JOIN fx_parcels p ON p.pnu = ra.pnu WHERE road_status = 'NO_CADASTRAL_ROAD'),
pl AS (SELECT pnu, name, road_no, arg_min(executed, road_id) AS executed FROM oc JOIN fx_planned_roads r ON r.x0 <= oc.x1 + 1.1 AND r.x1 >= oc.x0 - 1.1 AND r.y0 <= oc.y1 + 1.1 AND r.y1 >= oc.y0 - 1.1
   WHERE power(greatest(r.x0 - oc.x1, oc.x0 - r.x1, 0), 2) + power(greatest(r.y0 - oc.y1, oc.y0 - r.y1, 0), 2) < 1.21 GROUP BY 1, 2, 3),
pf AS (SELECT pnu, name, executed FROM pl UNION ALL SELECT oc.pnu, d.name, '' FROM oc JOIN fx_designations d ON d.id = oc.id
   WHERE d.relation = '접함' AND regexp_matches(d.name, '광로|대로|중로|소로') AND oc.pnu NOT IN (SELECT pnu FROM pl)),
pg AS (SELECT pnu, count(*) AS planned, array_to_string(list_sort(list_distinct(list(name))), '·') AS planned_names, bool_or(contains(executed, '미집행')) AS un, bool_or(executed <> '' AND NOT contains(executed, '미집행')) AS op FROM pf GROUP BY pnu),
pr AS (SELECT ra.* REPLACE (CASE WHEN pg.planned > 0 THEN 'PLANNED_ROAD_ABUTS' ELSE road_status END AS road_status), coalesce(planned, 0) AS planned, coalesce(planned_names, '') AS planned_names,
   CASE WHEN op THEN '도시계획도로 접함(개설)' WHEN un THEN '도시계획도로 미집행(미개설)' WHEN planned > 0 THEN '도시계획도로 접함(접도 검토)' END AS planned_label
  FROM ra LEFT JOIN pg ON pg.pnu = ra.pnu)"""


def planned(i: Inputs, par=None):
    par = par if par is not None else i.parcels()
    des = i.view("fx_designations").join(i.view("fx_parcels").select("id", "pnu"), "id")
    return roads.planned_roads(access(i, par), par, i.planned_roads(), des)


@query("planned_roads", sql("fx_parcels fx_planned_roads fx_designations", "SELECT pnu, road_status, planned, planned_names, planned_label FROM pr", PLANNED_CTE))
def planned_roads(i: Inputs):
    return planned(i).select("pnu", "road_status", "planned", "planned_names", "planned_label")


DRAIN_CTE = ADJ_CTE + """,
dr AS (SELECT pnu, CASE n_jimok WHEN '도' THEN '도로(도로측구)' WHEN '구' THEN '구거' WHEN '천' THEN '하천' END AS outlet, max(CASE WHEN n_jimok = '도' THEN 1e12 ELSE contact_length_m END) AS rk
  FROM adj WHERE n_jimok IN ('도', '구', '천') GROUP BY 1, 2),
drain AS (SELECT p.pnu, coalesce(string_agg(outlet, '·' ORDER BY rk DESC, outlet), '') AS outlets, count(outlet) > 0 AS public_outlet FROM fx_parcels p LEFT JOIN dr ON dr.pnu = p.pnu GROUP BY p.pnu)"""


@query("drainage", sql("fx_parcels", "SELECT * FROM drain", DRAIN_CTE))
def drainage(i: Inputs):
    par = i.parcels()
    return roads.drainage(par, spatial.adjacency(par))


ROUTE_CTE = DRAIN_CTE + """,
src AS (SELECT p.*, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM fx_parcels p JOIN drain d ON d.pnu = p.pnu AND NOT d.public_outlet),
rcand AS (SELECT s.pnu, s.px, s.py, q.pnu AS outlet_id, q.jimok AS outlet_jimok, least(greatest(s.px, q.x0), q.x1) AS qx, least(greatest(s.py, q.y0), q.y1) AS qy
  FROM src s JOIN fx_parcels q ON q.gx BETWEEN s.gx - 6 AND s.gx + 6 AND q.gy BETWEEN s.gy - 6 AND s.gy + 6 AND q.id <> s.id AND q.jimok IN ('도', '구', '천')
   AND q.x0 <= s.x1 + 180 AND q.x1 >= s.x0 - 180 AND q.y0 <= s.y1 + 180 AND q.y1 >= s.y0 - 180),
rdist AS (SELECT *, sqrt(power(qx - px, 2) + power(qy - py, 2)) AS d FROM rcand),
route AS MATERIALIZED (SELECT pnu, px, py, outlet_id, outlet_jimok, qx, qy, d FROM (SELECT *, row_number() OVER (PARTITION BY pnu ORDER BY d, outlet_id) AS rn FROM rdist) t WHERE rn = 1 AND d >= 0.5)"""


def routes(i: Inputs, par):
    return roads.nearest_outlet(par, roads.drainage(par, spatial.adjacency(par)))


@query("nearest_outlet", sql("fx_parcels", "SELECT pnu, px, py, outlet_id, outlet_jimok, qx, qy, round_even(d, 1) AS length_m FROM route", ROUTE_CTE))
def nearest_outlet(i: Inputs):
    return routes(i, i.parcels())


OWNER_SQL = """
op AS (SELECT id, seq, owner, CASE WHEN seq % 3 = 2 THEN NULL WHEN seq % 3 = 0 THEN owner WHEN owner <> '불명' THEN owner END AS owner_name FROM fx_owner_payloads),
own AS MATERIALIZED (SELECT id, seq, owner_name, CASE WHEN owner_name IN ('국유지', '군유지') THEN '국공유' WHEN owner_name IN ('개인', '법인', '기타 단체') THEN '사유' END AS ownership FROM op)"""
CROSS_CTE = ROUTE_CTE + """,
cl AS (SELECT r.pnu, q.pnu AS hit_id, q.id AS hit_no, q.jimok AS hit_jimok, r.d, r.px, r.py, r.qx, r.qy,
   CASE WHEN qx = px THEN CASE WHEN px >= q.x0 AND px < q.x1 THEN 0 ELSE 2 END ELSE least((q.x0 - px) / (qx - px), (q.x1 - px) / (qx - px)) END AS tx0,
   CASE WHEN qx = px THEN CASE WHEN px >= q.x0 AND px < q.x1 THEN 1 ELSE -1 END ELSE greatest((q.x0 - px) / (qx - px), (q.x1 - px) / (qx - px)) END AS tx1,
   CASE WHEN qy = py THEN CASE WHEN py >= q.y0 AND py < q.y1 THEN 0 ELSE 2 END ELSE least((q.y0 - py) / (qy - py), (q.y1 - py) / (qy - py)) END AS ty0,
   CASE WHEN qy = py THEN CASE WHEN py >= q.y0 AND py < q.y1 THEN 1 ELSE -1 END ELSE greatest((q.y0 - py) / (qy - py), (q.y1 - py) / (qy - py)) END AS ty1
  FROM route r JOIN fx_parcels q ON q.gx BETWEEN floor(r.px / 40) - 6 AND floor(r.px / 40) + 6 AND q.gy BETWEEN floor(r.py / 40) - 6 AND floor(r.py / 40) + 6
   AND q.pnu <> r.pnu AND q.jimok NOT IN ('도', '구', '천')),
crossed AS MATERIALIZED (SELECT pnu, hit_id, hit_no, hit_jimok, round_even(len, 1) AS cross_length_m FROM (SELECT *, d * (least(tx1, ty1, 1) - greatest(tx0, ty0, 0)) AS len FROM cl) t WHERE len > 0.05)"""


@query("crossed_parcels", sql("fx_parcels", "SELECT pnu, hit_id, hit_jimok, cross_length_m FROM crossed", CROSS_CTE))
def crossed_parcels(i: Inputs):
    par = i.parcels()
    return roads.crossed_parcels(routes(i, par), par)


@query("encroachment", sql("fx_parcels fx_owner_payloads fx_buildings", """
SELECT r.pnu, r.outlet_id, round_even(r.d, 1) AS length_m, coalesce(g.crossed, 0) AS crossed, coalesce(g.crosses_private, false) AS crosses_private,
  CAST(coalesce(g.built, 0) AS BIGINT) AS built_crossings, g.longest AS longest_crossing_m
FROM route r LEFT JOIN (SELECT c.pnu, count(*) AS crossed, bool_or(coalesce(o.ownership <> '국공유', true)) AS crosses_private,
   count(*) FILTER (bd.id IS NOT NULL) AS built, max(cross_length_m) AS longest
  FROM crossed c LEFT JOIN (SELECT DISTINCT id FROM fx_buildings) bd ON bd.id = c.hit_no
  LEFT JOIN (SELECT id, coalesce(ownership, '') AS ownership FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, coalesce(ownership, '')) AS rn FROM own) u WHERE rn = 1) o ON o.id = c.hit_no GROUP BY c.pnu) g ON g.pnu = r.pnu""",
    CROSS_CTE + ", " + OWNER_SQL))
def encroachment(i: Inputs):
    from ..operators import payloads
    par = i.parcels()
    ids = i.view("fx_parcels").select("id", F.col("pnu").alias("hit_id"))
    own = (payloads.parse_ownership(i.view("fx_owner_payloads")).groupBy("id")
           .agg(F.min(F.struct("seq", F.coalesce("ownership", F.lit("")).alias("o")))["o"].alias("ownership"))
           .join(ids, "id").select("hit_id", "ownership"))
    built = i.view("fx_buildings").select("id").distinct().join(ids, "id").select("hit_id", F.lit(True).alias("has_building"))
    return roads.encroachment(routes(i, par), par, own, built)


@query("restriction_rollup", sql("fx_parcels fx_zones fx_designations fx_cases fx_layer", """
SELECT pnu, label, round_even(sum(area_m2), 1) AS area_m2, round_even(sum(share_pct), 1) AS share_pct,
  CASE WHEN contains(label, '3등급') THEN '#9E9E9E' WHEN contains(label, '준보전산지') THEN '#F9A825'
   WHEN regexp_matches(label, '개발제한|맹지|도로 접촉 없음|보전산지|상수원|농업진흥|1등급|재해|위험') THEN '#C62828' ELSE '#F9A825' END AS color
FROM (SELECT pnu, name AS label, area_m2, share_pct FROM ov WHERE share_pct > 0 AND area_m2 > 0 AND layer_id <> 'forest_inventory' UNION ALL
  SELECT pnu, '도로 접촉 없음(맹지 가능성)', NULL, NULL FROM ra WHERE road_status = 'NO_CADASTRAL_ROAD' UNION ALL
  SELECT p.pnu, con.name, NULL, NULL FROM con JOIN fx_parcels p ON p.id = con.id) t GROUP BY pnu, label""",
    ROAD_CTE + ", " + OVERLAP_CTE + ", " + CONSTRAINT_CTE))
def restriction_rollup(i: Inputs):
    par = i.parcels()
    ov = spatial.effective(spatial.overlay(par, i.layer().filter("layer_id <> 'forest_inventory'")))
    no_road = access(i, par).filter("road_status = 'NO_CADASTRAL_ROAD'").select("pnu", F.lit(fv.NO_ROAD_LABEL).alias("label"))
    named = constraint_rows(i).join(i.view("fx_parcels").select("id", "pnu"), "id").select("pnu", F.col("name").alias("label"))
    return measures.restriction_rollup(ov.withColumnRenamed("name", "label"), no_road.unionByName(named))

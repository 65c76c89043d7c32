"""Queries over keys, limits and rule joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import geometry as geo
from ..operators import keys, rules
from .registry import Inputs, query, sql, values
from .spatial_queries import LEDGER_CTE

# manual aliases of the test data; one points at a jurisdiction without data
MANUAL_ALIASES = [("나라7군", "부산광역시 나라9시"), ("강원특별자치도 나라2구", "강원특별자치도 나라2구"), ("마을1리", "없는 관할")]
SEPARATE = [("경기도 나라6시", "마을3리"), ("서울특별시 나라0시", "마을1")]

MATRIX_CTE = values([(u, z, st) for u, (a, c) in fv.USE_MATRIX.items() for st, zs in (("allowed", a), ("conditional", c)) for z in zs],
                    "matrix", "building_use, zone, status")
USES_CTE = values([(u, n) for n, u in enumerate(fv.USE_MATRIX)], "uses", "building_use, use_order")
KW_CTE = values([(n, k, t) for n, (k, t) in enumerate(fv.CONSTRAINT_KEYWORDS)], "kws", "pos, kw, note")
SCOPE_CTE = values([(k, t) for k, ts in fv.FACILITY_SCOPE.items() for t in ts], "kwscope", "kw, term")
RURAL = ", ".join(f"'{z}'" for z in fv.NON_URBAN_ZONES)

BUILDINGS_CTE = """
lots AS (SELECT sigungu, bjdong, plat_gb, bun, ji, count(*) AS n, sum(total_area_m2) AS fa FROM fx_buildings GROUP BY ALL),
lot_pnu AS (SELECT DISTINCT p.pnu, l.n, l.fa FROM fx_parcels p JOIN lots l ON l.sigungu || l.bjdong || CASE l.plat_gb WHEN '1' THEN '2' ELSE '1' END || l.bun || l.ji = p.pnu),
bld AS (SELECT p.id, coalesce(a.n, b.n, 0) AS buildings, coalesce(a.fa, b.fa, 0) AS floor_area_m2,
   CASE WHEN a.n IS NOT NULL THEN 'pnu' WHEN b.n IS NOT NULL THEN 'address' ELSE 'none' END AS via,
   coalesce(a.n, b.n, 0) > 0 AS has_buildings
  FROM fx_parcels p LEFT JOIN lot_pnu a ON a.pnu = p.pnu LEFT JOIN fx_address_index x ON x.address = p.address
  LEFT JOIN lot_pnu b ON b.pnu = x.register_pnu)"""

LIMITS_SELECT = """SELECT c.id, c.zone, c.jurisdiction, coalesce(s.bcr_max IS NOT NULL AND (coalesce(o.bcr_max, o.far_max) IS NOT NULL OR c.zone NOT IN (%s)), false) AS found,
   coalesce(s.bcr_max IS NOT NULL AND coalesce(o.bcr_max, o.far_max) IS NULL AND c.zone IN (%s), false) AS requires_ordinance,
   s.bcr_max AS s_bcr, s.far_max AS s_far, s.far_min AS s_min, o.bcr_max AS o_bcr, o.far_max AS o_far
  FROM %s c LEFT JOIN fx_statutory s ON s.zone = c.zone LEFT JOIN fx_ordinance o ON o.zone = c.zone AND o.jurisdiction = c.jurisdiction"""


def limits_cte(name: str, source: str) -> str:
    return f"""{name}_raw AS ({LIMITS_SELECT % (RURAL, RURAL, source)}),
{name} AS (SELECT id, zone, jurisdiction, found, requires_ordinance, CASE WHEN found THEN coalesce(o_bcr, s_bcr) END AS bcr_max_pct,
   CASE WHEN found THEN coalesce(o_far, s_far) END AS far_max_pct, CASE WHEN found THEN s_min END AS far_min_pct,
   CASE WHEN found THEN CASE WHEN coalesce(o_bcr, o_far) IS NOT NULL THEN 'ordinance' ELSE 'statutory' END END AS limit_source FROM {name}_raw)"""


@query("split_pnu", sql("fx_parcels", """
SELECT id, true AS valid, substr(pnu, 1, 5) AS sigungu, substr(pnu, 6, 5) AS bjdong, CASE substr(pnu, 11, 1) WHEN '2' THEN '1' ELSE '0' END AS plat_gb,
  substr(pnu, 12, 4) AS bun, substr(pnu, 16, 4) AS ji FROM fx_parcels"""))
def split_pnu(i: Inputs):
    return keys.split_pnu(i.view("fx_parcels").select("id", "pnu")).drop("pnu")


@query("latest_price", sql("fx_prices", """
SELECT id, price_won_m2, std_year AS price_year, notice_date AS price_date FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY std_year DESC, std_month DESC, notice_date DESC, price_won_m2 DESC) AS rn FROM fx_prices WHERE price_won_m2 > 0) t WHERE rn = 1"""))
def latest_price(i: Inputs):
    return keys.latest_price(i.view("fx_prices"))


@query("resolve_area", sql("fx_parcels fx_ledger", "SELECT id, area_m2, area_source FROM area", LEDGER_CTE))
def resolve_area(i: Inputs):
    return keys.resolve_area(i.view("fx_parcels"), i.view("fx_ledger")).select("id", "area_m2", "area_source")


@query("merge_reviewed", sql("fx_ordinance fx_auto_limits", """
SELECT jurisdiction, zone, bcr_max, far_max, 'verified' AS source FROM fx_ordinance UNION ALL
SELECT jurisdiction, zone, bcr_max, far_max, 'auto' FROM fx_auto_limits WHERE review_status = 'auto_extracted'
  AND jurisdiction NOT IN (SELECT jurisdiction FROM fx_ordinance)"""))
def merge_reviewed(i: Inputs):
    return keys.merge_reviewed(i.view("fx_ordinance"), i.view("fx_auto_limits"))


ZONE_DISTRICTS_CTE = """
zd AS (SELECT p.id, z.zone_name AS name, min(z.layer_no) AS pos FROM fx_parcels p JOIN fx_zones z
   ON (p.x0 + p.x1) / 2 >= z.x0 AND (p.x0 + p.x1) / 2 < z.x1 AND (p.y0 + p.y1) / 2 >= z.y0 AND (p.y0 + p.y1) / 2 < z.y1
  WHERE z.zone_name NOT LIKE '%지역' GROUP BY 1, 2),
dist_all AS (SELECT id, name, 0 AS src, CAST(pos AS BIGINT) AS pos FROM zd UNION ALL
  SELECT id, name, 1, CAST(seq AS BIGINT) FROM fx_designations WHERE (relation_code IN ('1', '2') OR relation IN ('포함', '저촉'))
   AND NOT (length(code) = 6 AND substr(code, 1, 3) IN ('UQA', 'UQB', 'UQC', 'UQD'))),
dist AS (SELECT id, name, src, pos FROM (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY src, pos) AS rn FROM dist_all) t WHERE rn = 1)"""


def zone_districts(i: Inputs):
    from ..operators import spatial
    hits = spatial.points_in(spatial.interior_point(i.parcels()).select("id", "px", "py"),
                             i.zones().filter(~F.col("zone_name").endswith("지역")), spatial.LAYER_CELL)
    return hits.groupBy("id", F.col("zone_name").alias("name")).agg(F.min("layer_no").alias("pos"))


@query("districts", sql("fx_parcels fx_zones fx_designations", "SELECT id, name, src, pos FROM dist", ZONE_DISTRICTS_CTE))
def districts(i: Inputs):
    return keys.districts(i.view("fx_designations"), zone_districts(i)).select("id", "name", "ord.src", "ord.pos")


@query("existing_buildings", sql("fx_parcels fx_buildings fx_address_index", "SELECT * FROM bld", BUILDINGS_CTE))
def existing_buildings(i: Inputs):
    return keys.existing_buildings(i.view("fx_parcels"), i.view("fx_buildings"), i.view("fx_address_index"))


ALIAS_CTE = """
jn AS (SELECT DISTINCT jurisdiction, regexp_extract(jurisdiction, '([^ ]+)$', 1) AS last FROM fx_jurisdictions),
ju AS (SELECT *, count(*) OVER (PARTITION BY last) AS n, regexp_replace(last, '(특별자치시|특별자치도|광역시|특별시|시|군|구)$', '') AS stem FROM jn),
gen AS (SELECT jurisdiction, replace(jurisdiction, ' ', '') AS alias, 'full' AS kind FROM ju UNION ALL
  SELECT jurisdiction, last, 'last' FROM ju WHERE n = 1 UNION ALL SELECT jurisdiction, stem, 'stem' FROM ju WHERE n = 1 AND length(stem) >= 2)"""


@query("build_aliases", sql("fx_jurisdictions", "SELECT * FROM gen", ALIAS_CTE))
def build_aliases(i: Inputs):
    return keys.build_aliases(i.view("fx_jurisdictions"))


def alias_table(i: Inputs):
    jur = i.view("fx_jurisdictions")
    manual = i.rows(MANUAL_ALIASES, "alias string, jurisdiction string").join(jur.select("jurisdiction"), "jurisdiction", "left_semi")
    return (keys.build_aliases(jur).select("alias", "jurisdiction", F.lit(1).alias("priority"))
            .unionByName(manual.select("alias", "jurisdiction", F.lit(0).alias("priority"))))


DETECT_CTE = ALIAS_CTE + ", " + values(MANUAL_ALIASES, "man", "alias, jurisdiction") + ", " + values(SEPARATE, "sep", "jurisdiction, district") + """,
al AS (SELECT alias, jurisdiction, 1 AS pr FROM gen UNION ALL SELECT replace(alias, ' ', ''), jurisdiction, 0 FROM man
   WHERE jurisdiction IN (SELECT jurisdiction FROM fx_jurisdictions)),
ad AS (SELECT id, replace(address, ' ', '') AS t FROM fx_parcels),
det AS (SELECT ad.id, b.jurisdiction, exists(SELECT 1 FROM sep WHERE sep.jurisdiction = b.jurisdiction AND contains(ad.t, sep.district)) AS separate_ordinance
  FROM ad LEFT JOIN (SELECT id, jurisdiction, row_number() OVER (PARTITION BY id ORDER BY pr, length(alias) DESC, jurisdiction) AS rn
     FROM ad JOIN al ON contains(ad.t, al.alias)) b ON b.id = ad.id AND b.rn = 1)"""


@query("detect_jurisdiction", sql("fx_parcels fx_jurisdictions", "SELECT * FROM det", DETECT_CTE))
def detect_jurisdiction(i: Inputs):
    return keys.detect_jurisdiction(i.view("fx_parcels"), alias_table(i), i.rows(SEPARATE, "jurisdiction string, district string"))


@query("resolve_limits", sql("fx_cases fx_statutory fx_ordinance", "SELECT * FROM lim", limits_cte("lim", "fx_cases")))
def resolve_limits(i: Inputs):
    return keys.resolve_limits(i.view("fx_cases").select("id", "zone", "jurisdiction"), i.view("fx_statutory"), i.view("fx_ordinance"))


@query("use_verdict", sql("fx_cases fx_statutory fx_ordinance", """
SELECT c.id, c.zone, c.building_use, CASE WHEN NOT l.found THEN 'unknown' ELSE coalesce(m.status, 'not_allowed') END AS verdict
FROM fx_cases c JOIN lim l ON l.id = c.id LEFT JOIN matrix m ON m.building_use = c.building_use AND m.zone = c.zone""",
    limits_cte("lim", "fx_cases") + ", " + MATRIX_CTE))
def use_verdict(i: Inputs):
    lim = keys.resolve_limits(i.view("fx_cases").select("id", "zone", "jurisdiction", "building_use"), i.view("fx_statutory"), i.view("fx_ordinance"))
    return rules.use_verdict(lim.withColumn("n_constraints", F.lit(0)), rules.use_matrix(i.spark)).select("id", "zone", "building_use", "verdict")


@query("uses_for_zone", sql("fx_cases", """
SELECT z.zone, coalesce(string_agg(u.building_use, ',' ORDER BY use_order) FILTER (m.status = 'allowed'), '') AS allowed,
  coalesce(string_agg(u.building_use, ',' ORDER BY use_order) FILTER (m.status = 'conditional'), '') AS conditional,
  coalesce(string_agg(u.building_use, ',' ORDER BY use_order) FILTER (m.status IS NULL), '') AS not_allowed
FROM (SELECT DISTINCT zone FROM fx_cases) z CROSS JOIN uses u LEFT JOIN matrix m ON m.building_use = u.building_use AND m.zone = z.zone GROUP BY z.zone""",
    MATRIX_CTE + ", " + USES_CTE))
def uses_for_zone(i: Inputs):
    return rules.uses_for_zone(i.view("fx_cases"), rules.use_matrix(i.spark))


CONSTRAINT_CTE = ZONE_DISTRICTS_CTE + ", " + KW_CTE + ", " + SCOPE_CTE + """,
con_hit AS (SELECT d.id, d.name, d.src, d.pos AS dpos, k.pos, k.kw, k.note, row_number() OVER (PARTITION BY d.id, d.name ORDER BY k.pos) AS rk
  FROM dist d JOIN kws k ON contains(d.name, k.kw)),
con_ok AS (SELECT h.* FROM con_hit h JOIN fx_cases c ON c.id = h.id WHERE h.rk = 1 AND (h.kw NOT IN (SELECT kw FROM kwscope)
  OR exists(SELECT 1 FROM kwscope s WHERE s.kw = h.kw AND contains(CASE WHEN c.facility <> '' THEN c.facility ELSE c.building_use END, s.term)))),
con AS (SELECT id, name, note FROM (SELECT *, row_number() OVER (PARTITION BY id, note ORDER BY src, dpos, name) AS rn FROM con_ok) t WHERE rn = 1)"""


def district_lists(i: Inputs):
    """Ordered district names per parcel; bounded by the number of distinct names."""
    d = keys.districts(i.view("fx_designations"), zone_districts(i))
    return d.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]).alias("districts"))


@query("constraints", sql("fx_parcels fx_zones fx_designations fx_cases", "SELECT * FROM con", CONSTRAINT_CTE))
def constraints(i: Inputs):
    df = i.view("fx_cases").select("id", "building_use", "facility").join(district_lists(i), "id").withColumn(
        "facility_text", F.when(F.col("facility") != "", F.col("facility")).otherwise(F.col("building_use")))
    return rules.constraints(df).select("id", F.inline("constraints"))


def setback_cte(name: str, source: str) -> str:
    return f"""{name}_m AS MATERIALIZED (SELECT c.id, c.building_use AS case_use, r.*, row_number() OVER (PARTITION BY c.id, c.building_use ORDER BY CASE WHEN r.use = '*' THEN 1 ELSE 0 END, r.rule_order) AS rn
  FROM {source} c JOIN fx_setback_rules r ON r.jurisdiction = c.jurisdiction AND r.use IN (c.building_use, '*')
   AND (r.min_gross IS NULL OR c.gross >= r.min_gross) AND (r.max_gross_excl IS NULL OR c.gross < r.max_gross_excl)
   AND (r.zone IS NULL OR r.zone = c.zone) AND (r.zone_contains IS NULL OR contains(c.zone, r.zone_contains))
   AND (r.zone_not_contains IS NULL OR NOT contains(c.zone, r.zone_not_contains))
   AND (r.zone_in IS NULL OR list_contains(string_split(r.zone_in, '|'), c.zone))
   AND (r.not_zone_in IS NULL OR NOT list_contains(string_split(r.not_zone_in, '|'), c.zone))),
{name} AS (SELECT c.id, c.building_use, CASE WHEN j.jurisdiction IS NULL THEN 'NOT_COLLECTED' WHEN m.needs_subtype THEN 'NEEDS_SUBTYPE' ELSE 'APPLIED' END AS setback_status,
   CASE WHEN j.jurisdiction IS NULL OR m.needs_subtype THEN NULL ELSE coalesce(m.front_m, 0) END AS front_m,
   CASE WHEN j.jurisdiction IS NULL OR m.needs_subtype THEN NULL ELSE coalesce(m.adjacent_m, 0) END AS adjacent_m,
   CASE WHEN m.needs_subtype THEN m.preview_front_m END AS preview_front_m, m.rule_order
  FROM {source} c LEFT JOIN (SELECT DISTINCT jurisdiction FROM fx_setback_rules) j ON j.jurisdiction = c.jurisdiction
  LEFT JOIN {name}_m m ON m.id = c.id AND m.case_use = c.building_use AND m.rn = 1)"""


CASE_GROSS_CTE = "cg AS (SELECT id, jurisdiction, building_use, zone, geom_area * 1.5 AS gross FROM fx_cases)"


def case_gross(i: Inputs):
    return i.view("fx_cases").select("id", "jurisdiction", "building_use", "zone", (F.col("geom_area") * 1.5).alias("gross"))


@query("setbacks", sql("fx_cases fx_setback_rules", "SELECT * FROM sb", CASE_GROSS_CTE + ", " + setback_cte("sb", "cg")))
def setbacks(i: Inputs):
    return rules.setbacks(case_gross(i), i.view("fx_setback_rules")).select(
        "id", "building_use", "setback_status", "front_m", "adjacent_m", "preview_front_m", "rule_order")


@query("applicable_setbacks", sql("fx_cases fx_setback_rules", """
SELECT id, building_use, setback_status, front_m, adjacent_m FROM sb WHERE setback_status = 'NEEDS_SUBTYPE' OR front_m > 0 OR adjacent_m > 0""",
    CASE_GROSS_CTE + """, cu AS MATERIALIZED (SELECT c.id, c.jurisdiction, u.use AS building_use, c.zone, c.gross FROM cg c
   JOIN (SELECT DISTINCT jurisdiction, use FROM fx_setback_rules) u ON u.jurisdiction = c.jurisdiction), """ + setback_cte("sb", "cu")))
def applicable_setbacks(i: Inputs):
    return rules.applicable_setbacks(case_gross(i), i.view("fx_setback_rules")).select(
        "id", "building_use", "setback_status", "front_m", "adjacent_m")


JIMOK_CTE = values(list(fv.JIMOK_CODES.items()), "codes", "code, full_name") + """,
jim AS (SELECT c.id, coalesce(k.full_name, c.jimok) AS jimok_name FROM fx_cases c LEFT JOIN codes k ON k.code = c.jimok),
jcat AS (SELECT id, jimok_name, CASE WHEN jimok_name IN ('전', '답', '과수원') THEN 'farmland' WHEN jimok_name = '임야' THEN 'forest'
   WHEN jimok_name IN ('대', '공장용지', '창고용지', '학교용지', '주차장', '주유소용지', '종교용지') THEN 'buildable' ELSE 'other' END AS category FROM jim)"""


@query("classify_jimok", sql("fx_cases", """
SELECT id, jimok_name, category, category IN ('farmland', 'forest') AS requires_conversion,
  CASE category WHEN 'farmland' THEN '농업진흥지역' WHEN 'forest' THEN '보전산지구분,경사도(DEM)' ELSE '' END AS check_layers FROM jcat""", JIMOK_CTE))
def classify_jimok(i: Inputs):
    return rules.classify_jimok(i.view("fx_cases")).select("id", "jimok_name", "category", "requires_conversion", "check_layers")


MIN_LOT_SQL = ("CASE WHEN contains({z}, '주거') THEN 60 WHEN contains({z}, '상업') THEN 150 WHEN contains({z}, '공업') THEN 150 "
               "WHEN contains({z}, '녹지') THEN 200 ELSE 60 END")


@query("min_lot", sql("fx_cases", f"""
SELECT id, {MIN_LOT_SQL.format(z="zone")} AS min_lot_m2, geom_area / 8 < {MIN_LOT_SQL.format(z="zone")} AS below_min_lot FROM fx_cases"""))
def min_lot(i: Inputs):
    return rules.min_lot(i.view("fx_cases").withColumn("area_m2", F.col("geom_area") / 8)).select("id", "min_lot_m2", "below_min_lot")


@query("facility_verdict", sql("fx_cases", """
SELECT c.id, c.facility, CASE WHEN j.category <> 'farmland' THEN NULL WHEN contains(c.facility, '움막') THEN 'not_allowed'
  WHEN contains(c.facility, '농막') THEN 'conditional' END AS facility_verdict FROM fx_cases c JOIN jcat j ON j.id = c.id""", JIMOK_CTE))
def facility_verdict(i: Inputs):
    return rules.facility_verdict(rules.classify_jimok(i.view("fx_cases"))).select("id", "facility", "facility_verdict")


@query("plan_evidence", sql("fx_parcels fx_zones fx_designations fx_plan_sources", """
SELECT p.id, s.plan_name, CASE WHEN s.needs_check THEN 'LATEST_NOTICE_CHECK_REQUIRED' ELSE 'VERIFIED' END AS verification
FROM fx_parcels p JOIN dl ON dl.id = p.id JOIN pick k ON k.jurisdiction = p.jurisdiction JOIN fx_plan_sources s ON s.org = k.org
WHERE contains(dl.names, '지구단위계획') AND exists(SELECT 1 FROM (SELECT unnest(string_split(s.terms, '|')) AS t) u
  WHERE contains(p.address || ' ' || p.pnu || ' ' || dl.names, u.t))""", ZONE_DISTRICTS_CTE + """,
dl AS (SELECT id, string_agg(name, ' ' ORDER BY src, pos, name) AS names FROM dist GROUP BY id),
pick AS (SELECT jurisdiction, org FROM (SELECT j.jurisdiction, s.org, row_number() OVER (PARTITION BY j.jurisdiction ORDER BY s.source_no) AS rn
  FROM (SELECT DISTINCT jurisdiction FROM fx_parcels) j JOIN fx_plan_sources s ON ends_with(j.jurisdiction, s.org) OR ends_with(s.org, j.jurisdiction)) t WHERE rn = 1)"""))
def plan_evidence(i: Inputs):
    df = i.view("fx_parcels").select("id", "pnu", "address", "jurisdiction").join(district_lists(i), "id")
    return rules.plan_evidence(df, i.view("fx_plan_sources")).select("id", "plan_name", "verification")


RESTRICT_CTE = MATRIX_CTE + ", " + values([(n, t, u) for n, (t, us) in enumerate(fv.AMBIGUOUS_USE_TERMS) for u in us], "terms", "pos, term, use") + ", " + \
    values([(t,) for t in fv.SHOP_TERMS], "shops", "term") + """,
rq AS (SELECT id, zone, facility || ' ' || building_use AS request FROM fx_cases),
rt AS (SELECT id, zone, request, (SELECT t.term FROM terms t WHERE contains(rq.request, t.term) ORDER BY t.pos LIMIT 1) AS term FROM rq),
rb AS (SELECT rt.*, (SELECT count(*) FROM terms t JOIN matrix m ON m.building_use = t.use AND m.zone = rt.zone WHERE t.term = rt.term) AS buildable,
   rt.term IN (SELECT term FROM shops) AND exists(SELECT 1 FROM matrix m WHERE m.building_use = '제1종근린생활시설' AND m.zone = rt.zone) AS shop_ok,
   (SELECT string_agg(t.use, '·') FROM terms t WHERE t.term = rt.term) AS uses,
   zone = '제1종전용주거지역' AND (contains(request, '원룸') OR contains(request, '다가구') OR contains(request, '다중주택')) AS special FROM rt)"""


@query("use_restriction", sql("fx_cases", """
SELECT id, zone, CASE WHEN special THEN 'verification_required' WHEN bad THEN 'blocked' END AS restriction,
  CASE WHEN special THEN '다가구·원룸' WHEN bad THEN term END AS term, CASE WHEN NOT special AND bad THEN uses ELSE '' END AS blocked
FROM (SELECT *, coalesce(term IS NOT NULL AND NOT shop_ok AND buildable = 0, false) AS bad FROM rb) t""", RESTRICT_CTE))
def use_restriction(i: Inputs):
    df = i.view("fx_cases").select("id", "zone", F.concat_ws(" ", "facility", "building_use").alias("request"))
    return rules.use_restriction(df, rules.use_matrix(i.spark)).select("id", "zone", "restriction", "term", "blocked")

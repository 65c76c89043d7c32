"""Input views derived from the star-schema tables.

Each view is one SQL text in the subset that Spark SQL and ANSI engines share.
Table and view references are written ``{name}``; :func:`view` resolves them to
DataFrames, :func:`with_clause` renders the same text as a WITH list for an
independent check.  All legal limits in these views are synthetic.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed_values as fv

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


_STR = "CAST({} AS STRING)".format

FIXTURES: dict[str, str] = {}

FIXTURES["fx_jurisdictions"] = f"""
SELECT n_nationkey AS nationkey,
       {_case("n_nationkey % 5", ["서울특별시", "경기도", "강원특별자치도", "충청북도", "부산광역시"])}
         || ' 나라' || {_STR("n_nationkey % 23")} || {_case("(n_nationkey % 23) % 3", ["시", "군", "구"])}
         AS jurisdiction,
       r_name
FROM {{nation}} n JOIN {{region}} r ON n.n_regionkey = r.r_regionkey"""

FIXTURES["fx_parcels"] = f"""
SELECT id, gx, gy, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + w AS DOUBLE) AS x1,
       CAST(y0 + h AS DOUBLE) AS y1, CAST(w * h AS DOUBLE) AS geom_area,
       lpad({_STR("41110 + nationkey")}, 5, '0') || lpad({_STR("gy % 100000")}, 5, '0')
         || CASE WHEN id % 9 = 0 THEN '2' ELSE '1' END
         || lpad({_STR("gx")}, 4, '0') || lpad({_STR("gy % 10000")}, 4, '0') AS pnu,
       CASE WHEN id % 41 = 0 THEN '미상' ELSE jurisdiction END || ' 마을' || {_STR("gy")} || '리 '
         || CASE WHEN id % 9 = 0 THEN '산 ' ELSE '' END || {_STR("id")} AS address,
       {_STR("id")} || CASE WHEN id % 2 = 0 THEN ' ' ELSE '' END
         || {_case("id % 12", ["전", "답", "과", "임", "대", "도", "구", "천", "장", "창", "잡", "대"])} AS jibun,
       nationkey, jurisdiction,
       {_case("id % 12", ["전", "답", "과", "임", "대", "도", "구", "천", "장", "창", "잡", "대"])} AS jimok,
       {_case("id % 10", list(fv.USE_MATRIX))} AS building_use
FROM (
  SELECT o.o_orderkey AS id, o.o_orderkey % 256 AS gx, CAST(floor(o.o_orderkey / 256) AS BIGINT) AS gy,
         (o.o_orderkey % 256) * 40 + CASE WHEN o.o_orderkey % 3 = 0 THEN (o.o_orderkey * 7) % 4 ELSE 0 END AS x0,
         CAST(floor(o.o_orderkey / 256) AS BIGINT) * 40
           + CASE WHEN o.o_orderkey % 5 = 0 THEN (o.o_orderkey * 11) % 4 ELSE 0 END AS y0,
         CASE WHEN o.o_orderkey % 3 = 0 THEN 20 + (o.o_orderkey * 13) % 17 ELSE 40 END AS w,
         CASE WHEN o.o_orderkey % 5 = 0 THEN 20 + (o.o_orderkey * 17) % 17 ELSE 40 END AS h,
         c.c_nationkey AS nationkey, j.jurisdiction
  FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey
       JOIN {{fx_jurisdictions}} j ON c.c_nationkey = j.nationkey) t"""

FIXTURES["fx_zones"] = f"""
SELECT p.p_partkey + 1000000000 * d.k AS feature_id, (p.p_partkey * 5) % 21 AS zone_id,
       CASE WHEN p.p_partkey % 17 = 0 THEN '자연경관지구' ELSE {_case("(p.p_partkey * 5) % 21", fv.STANDARD_ZONES)} END
         AS zone_name,
       CAST(1 + p.p_partkey % 4 AS BIGINT) AS layer_no,
       CAST((p.p_partkey % 128) * 80 - 13 AS DOUBLE) AS x0,
       CAST((p.p_partkey % 128) * 80 + 67 + CASE WHEN p.p_partkey % 6 = 0 THEN 9 ELSE 0 END AS DOUBLE) AS x1,
       CAST(CAST(floor(p.p_partkey / 128) AS BIGINT) * 150 - 27 AS DOUBLE) AS y0,
       CAST(CAST(floor(p.p_partkey / 128) AS BIGINT) * 150 + 123 + d.k * (p.p_size % 2) * 10 AS DOUBLE) AS y1
FROM {{part}} p JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) d ON d.k = 0 OR p.p_size > 45"""

FIXTURES["fx_prices"] = """
SELECT l_orderkey AS id, CAST(year(l_shipdate) AS BIGINT) AS std_year, CAST(month(l_shipdate) AS BIGINT) AS std_month,
       CAST(CAST(l_shipdate AS DATE) AS STRING) AS notice_date,
       CASE WHEN l_tax = 0 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS price_won_m2
FROM {lineitem}"""

FIXTURES["fx_ledger"] = """
SELECT l.l_orderkey AS id, CAST(2018 + l.l_linenumber AS BIGINT) AS std_year,
       CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS updated,
       CASE WHEN l.l_discount = 0 THEN NULL ELSE p.geom_area + l.l_linenumber - 3 END AS ledger_area
FROM {lineitem} l JOIN {fx_parcels} p ON l.l_orderkey = p.id"""

FIXTURES["fx_designations"] = f"""
SELECT l_orderkey AS id, l_linenumber AS seq,
       'UQ' || {_case("l_partkey % 5", ["A", "B", "Q", "M", "L"])} || lpad({_STR("l_partkey % 1000")}, 3, '0') AS code,
       {_case("l_suppkey % 8", ["지구단위계획구역", "중점경관관리구역", "가축사육제한구역", "자연재해위험개선지구",
                               "수변구역", "소로2류", "도시자연공원구역", "교육환경보호구역(학교)"])} AS name,
       {_STR("l_linenumber % 3 + 1")} AS relation_code,
       {_case("l_linenumber % 3", ["포함", "저촉", "접함"])} AS relation,
       CAST(CAST(l_shipdate AS DATE) AS STRING) AS updated_at
FROM {{lineitem}}"""

FIXTURES["fx_designation_payloads"] = """
SELECT id, seq, CASE
  WHEN seq = 7 THEN '"oops"'
  WHEN seq = 6 THEN '{{"landUses": {{"resultCode": "INVALID_KEY", "field": []}}}}'
  WHEN seq = 5 THEN '{{"landUses": "' || replace('{{~field~: {{~prposAreaDstrcCodeNm~: ~' || name
       || '~, ~prposAreaDstrcCode~: ~' || code || '~, ~cnflcAt~: ~' || relation_code
       || '~, ~lastUpdtDt~: ~' || updated_at || '~}}}}', '~', chr(92) || '"') || '"}}'
  ELSE '{{"landUses": {{"resultCode": "OK", "field": [{{"prposAreaDstrcCodeNm": " ' || name
       || '", "prposAreaDstrcCode": "' || code || '", "cnflcAtNm": "' || relation || '", "lastUpdtDt": "' || updated_at
       || '"}}, {{"prposAreaDstrcCodeNm": "' || name || '", "prposAreaDstrcCode": "' || code || '", "cnflcAtNm": "'
       || relation || '", "lastUpdtDt": "' || updated_at || '"}}, "text", {{"prposAreaDstrcCode": "UQA000"}}]}}}}' END AS payload
FROM {fx_designations}"""

FIXTURES["fx_buildings"] = """
SELECT p.id, l.l_linenumber AS seq, substring(p.pnu, 1, 5) AS sigungu, substring(p.pnu, 6, 5) AS bjdong,
       CASE WHEN substring(p.pnu, 11, 1) = '2' THEN '1' ELSE '0' END AS plat_gb,
       substring(p.pnu, 12, 4) AS bun, substring(p.pnu, 16, 4) AS ji,
       'bld' || CAST(l.l_partkey AS STRING) AS name, l.l_quantity AS total_area_m2
FROM {lineitem} l JOIN {fx_parcels} p ON l.l_orderkey = p.id
WHERE l.l_returnflag = 'R' AND l.l_discount >= 0.09"""

FIXTURES["fx_address_index"] = """
SELECT p.address, r.pnu AS register_pnu
FROM {fx_parcels} p JOIN {fx_parcels} r ON r.id = p.id - p.id % 4"""

FIXTURES["fx_register_payloads"] = """
SELECT id, seq, CASE
  WHEN seq = 1 THEN '{{"response": {{"body": {{"items": {{"item": {{"bldNm": "' || name || '", "totArea": '
       || CAST(CAST(total_area_m2 AS BIGINT) AS STRING) || '}}}}, "totalCount": 7}}}}}}'
  WHEN seq = 2 THEN '{{"response": {{"body": {{"items": "", "totalCount": 0}}}}}}'
  ELSE '{{"response": {{"body": {{"items": {{"item": [{{"bldNm": "' || name || '", "totArea": 10}}, {{"dongNm": "d'
       || CAST(seq AS STRING) || '", "totArea": 5}}]}}}}}}}}' END AS payload, name, total_area_m2
FROM {fx_buildings}"""

FIXTURES["fx_owner_payloads"] = f"""
SELECT l_orderkey AS id, l_linenumber AS seq,
       {_case("l_suppkey % 6", ["개인", "국유지", "군유지", "법인", "기타 단체", "불명"])} AS owner,
       CASE WHEN l_linenumber % 3 = 0
            THEN '{{{{"possessions": {{{{"field": [{{{{"ownshipChgCauseCodeNm": "개인 이전", "posesnSeCodeNm": "'
                 || {_case("l_suppkey % 6", ["개인", "국유지", "군유지", "법인", "기타 단체", "불명"])} || '"}}}}]}}}}}}}}'
            WHEN l_linenumber % 3 = 1
            THEN '{{{{"data": {{{{"a": "x", "owner": "' || {_case("l_suppkey % 6", ["개인", "국유지", "군유지", "법인", "기타 단체", "불명"])}
                 || '"}}}}}}}}'
            ELSE '{{{{"data": []}}}}' END AS payload
FROM {{lineitem}}"""

FIXTURES["fx_statutory"] = f"""
SELECT zone_id, {_case("zone_id", fv.STANDARD_ZONES)} AS zone,
       CAST(20 + (zone_id % 5) * 15 AS DOUBLE) AS bcr_max, CAST(50 + zone_id * 50 AS DOUBLE) AS far_max,
       CAST(CASE WHEN zone_id < 16 THEN 50 ELSE NULL END AS DOUBLE) AS far_min
FROM (SELECT DISTINCT (p_partkey * 5) % 21 AS zone_id FROM {{part}}) z"""

FIXTURES["fx_ordinance"] = """
SELECT j.jurisdiction, z.zone,
       CAST(CASE WHEN (j.nationkey + z.zone_id) % 7 = 0 THEN NULL
                 ELSE 20 + (z.zone_id % 5) * 15 - (j.nationkey % 3) * 5 END AS DOUBLE) AS bcr_max,
       CAST(CASE WHEN (j.nationkey + z.zone_id) % 7 <= 1 THEN NULL
                 ELSE 50 + z.zone_id * 50 - (j.nationkey % 4) * 10 END AS DOUBLE) AS far_max,
       CAST(NULL AS DOUBLE) AS far_min
FROM {fx_jurisdictions} j CROSS JOIN {fx_statutory} z
WHERE j.jurisdiction NOT LIKE '부산%'"""

FIXTURES["fx_auto_limits"] = """
SELECT j.jurisdiction, z.zone,
       CASE WHEN (j.nationkey + z.zone_id) % 4 = 0 THEN NULL ELSE z.bcr_max - (j.nationkey + z.zone_id) % 3 * 5 END AS bcr_max,
       CASE WHEN (j.nationkey * z.zone_id) % 6 = 0 THEN NULL ELSE z.far_max - (j.nationkey % 4) * 10 END AS far_max,
       CASE WHEN j.nationkey % 4 = 1 THEN 'needs_review' ELSE 'auto_extracted' END AS review_status
FROM {fx_jurisdictions} j CROSS JOIN {fx_statutory} z"""

FIXTURES["fx_layer"] = f"""
SELECT s_suppkey AS feature_id, layer_id, code,
       CASE layer_id WHEN 'forest_class' THEN CASE code WHEN 'UFM110' THEN '임업용산지' ELSE '준보전산지' END
            WHEN 'agricultural_promotion' THEN '농업진흥구역'
            WHEN 'ecological_nature' THEN '생태·자연도 ' || code || '등급' ELSE '침엽수림' END AS name,
       CAST(x0 AS DOUBLE) AS x0, CAST(x0 + w AS DOUBLE) AS x1, CAST(y0 AS DOUBLE) AS y0, CAST(y0 + h AS DOUBLE) AS y1,
       CAST(cut AS DOUBLE) AS cut,
       {_case("s_suppkey % 3", ["인공림", "천연림", ""])} AS forest_type,
       {_case("s_suppkey % 4", ["소나무", "잣나무", "상수리", "낙엽송"])} AS species, '2' || {_STR("s_suppkey % 3")} AS updated_year
FROM (
  SELECT s_suppkey, {_case("s_suppkey % 4", ["forest_class", "agricultural_promotion", "ecological_nature", "forest_inventory"])} AS layer_id,
         CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_suppkey % 8 = 0 THEN 'UFM110' ELSE 'UFM200' END
              WHEN 1 THEN 'UEA110' WHEN 2 THEN {_STR("CAST(floor(s_suppkey / 4) AS BIGINT) % 3 + 1")} ELSE '11' END AS code,
         (s_suppkey * 97) % 9900 AS x0, 300 + s_suppkey % 50 AS w,
         CAST(floor(s_suppkey / 100) AS BIGINT) * 2300 + (s_suppkey * 61) % 2100 AS y0, 200 + s_suppkey % 30 AS h,
         20 + s_suppkey % 90 AS cut
  FROM {{supplier}}) t"""

FIXTURES["fx_dem"] = """
SELECT CAST(floor(event_id / 342) AS BIGINT) AS r, event_id % 342 AS c, CAST((event_id * 17) % 97 AS DOUBLE) AS elev
FROM {events}"""

FIXTURES["fx_chunks"] = f"""
SELECT doc_id AS chunk_no, 'c' || lpad({_STR("doc_id")}, 12, '0') AS chunk_id,
       CASE WHEN source = 'src0' THEN '{fv.NATIONAL}' ELSE j.jurisdiction END AS jurisdiction,
       CASE WHEN source = 'src0' THEN '법령-조문' ELSE '도시계획조례' END AS kind,
       {_STR("20200101 + doc_id % 28")} AS effective_date, source AS ordinance, '제' || {_STR("doc_id % 90")} || '조' AS article, text
FROM {{documents}} d JOIN {{fx_jurisdictions}} j ON j.nationkey = d.doc_id % 25"""

FIXTURES["fx_search"] = f"""
SELECT item_id AS query_id, text AS query, j.jurisdiction,
       {_STR("20200101 + item_id % 28")} AS effective_on
FROM {{benchmark}} b JOIN {{fx_jurisdictions}} j ON j.nationkey = b.item_id % 25"""


def _zone_line(k: int, no: int) -> str:
    zone = _case(f"(c_custkey + {k}) % 21", fv.STANDARD_ZONES)
    value = f"20 + ((c_custkey + {k}) % 21 % 5) * 15 + CASE WHEN c_acctbal < 1000 THEN 10 ELSE 0 END"
    return f"' {no}. ' || {zone} || ' : ' || {_STR(value)} || '퍼센트 이하'"


_BCR_LINES = " || ".join(_zone_line(k, k + 1) for k in range(16))
_FAR_LINES = " || ".join(
    f"' {k}. ' || {_case(f'(c_custkey + {k}) % 21', fv.STANDARD_ZONES)} || '은 ' || {_STR(f'100 + (c_custkey + {k}) % 21 * 40')} || '%'"
    for k in range(6)
)
FIXTURES["fx_law_docs"] = f"""
SELECT c_custkey AS doc_no, j.jurisdiction AS org, CASE WHEN c_mktsegment = 'MACHINERY' THEN '규칙' ELSE '조례' END AS kind,
       j.jurisdiction || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ' 주차장 조례' ELSE ' 도시계획 조례' END AS name,
       {_STR("20190101 + c_custkey % 1097")} AS effective_date,
       '<자치법규명><![CDATA[' || j.jurisdiction || ' 도시계획 조례]]></자치법규명><시행일자>' || {_STR("20190101 + c_custkey % 1097")}
         || '</시행일자><조제목>목적</조제목><조내용>제1조(목적) 이 조례는 <b>건축선</b>의 후퇴와  이격 기준을 정한다.</조내용>'
         || '<조제목>(완화)</조제목><조내용>제2조(완화) 영 제84조제4항. 준주거지역 : 90퍼센트</조내용>'
         || '<조제목>제30조(용도지역 안에서의 건폐율)</조제목><조내용><![CDATA[제30조 영 제84조 제1항에 따른 건폐율은' || {_BCR_LINES}
         || ']]></조내용><조제목>제35조(용적률)</조제목><조내용>제35조의2 영 제85조제1항에 따라' || {_FAR_LINES}
         || '</조내용><별표내용>별표 1 대지 안의 공지 기준: 건축선에서 ' || {_STR("c_custkey % 5 + 1")} || '미터 이상 이격</별표내용>' AS xml
FROM {{customer}} c JOIN {{fx_jurisdictions}} j ON c.c_nationkey = j.nationkey"""

FIXTURES["fx_requests"] = f"""
SELECT c.conv_id, c.turn, CASE c.turn % 5
    WHEN 0 THEN p.address || '에 ' || {_case("c.conv_id % 4", ["공장", "카페 상가", "다세대 주택", "업무시설"])} || ' 지을 수 있어? 용적률 '
         || {_STR("100 + c.conv_id % 7 * 50")} || '% 지하주차'
    WHEN 1 THEN p.address || ' 건물 신축 가능?'
    WHEN 2 THEN '경도 ' || {_STR("127 + CAST(c.conv_id % 8 AS DOUBLE) / 8")} || ', 위도 37.5 창고 지상주차'
    WHEN 3 THEN p.address || ' 알려줘'
    ELSE '' END || ' ' || c.text AS text
FROM {{conversations}} c JOIN {{fx_parcels}} p ON p.id = c.conv_id"""

FIXTURES["fx_setback_rules"] = f"""
SELECT j.jurisdiction, r.rule_order, r.use, r.min_gross, r.max_gross_excl, r.zone, r.zone_contains, r.zone_not_contains,
       r.zone_in, r.not_zone_in, r.front_m, r.adjacent_m, r.needs_subtype, r.preview_front_m, r.preview_adjacent_m
FROM {{fx_jurisdictions}} j CROSS JOIN (
  SELECT 1 AS rule_order, '공장' AS use, 1000.0 AS min_gross, CAST(NULL AS DOUBLE) AS max_gross_excl, '준공업지역' AS zone,
         CAST(NULL AS STRING) AS zone_contains, CAST(NULL AS STRING) AS zone_not_contains, CAST(NULL AS STRING) AS zone_in,
         CAST(NULL AS STRING) AS not_zone_in, 1.5 AS front_m, 1.0 AS adjacent_m, false AS needs_subtype,
         CAST(NULL AS DOUBLE) AS preview_front_m, CAST(NULL AS DOUBLE) AS preview_adjacent_m
  UNION ALL SELECT 2, '공장', 500.0, NULL, NULL, NULL, NULL, NULL, '전용공업지역|일반공업지역|준공업지역', 3.0, 2.0, false, NULL, NULL
  UNION ALL SELECT 3, '창고시설', NULL, 1000.0, NULL, NULL, '주거', NULL, NULL, 2.0, 1.0, false, NULL, NULL
  UNION ALL SELECT 4, '공동주택', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true, 3.0, 2.0
  UNION ALL SELECT 5, '단독주택', NULL, NULL, NULL, '전용주거지역', NULL, NULL, NULL, 0.0, 1.0, false, NULL, NULL
  UNION ALL SELECT 6, '단독주택', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.0, 0.5, false, NULL, NULL
  UNION ALL SELECT 7, '판매시설', NULL, NULL, NULL, NULL, NULL, '중심상업지역|일반상업지역', NULL, 3.0, 1.0, false, NULL, NULL
  UNION ALL SELECT 8, '*', 2000.0, NULL, NULL, '상업지역', NULL, NULL, NULL, 2.0, 0.0, false, NULL, NULL
  UNION ALL SELECT 9, '*', NULL, NULL, NULL, NULL, '녹지', NULL, NULL, 1.0, 0.5, false, NULL, NULL) r
WHERE j.jurisdiction NOT LIKE '강원%'"""

FIXTURES["fx_planned_roads"] = """
SELECT s_suppkey AS road_id, '소로' || CAST(s_suppkey % 3 + 1 AS STRING) || '류' AS name, CAST(s_suppkey % 7 AS STRING) AS road_no,
       CASE s_suppkey % 3 WHEN 0 THEN '미집행' WHEN 1 THEN '집행' ELSE '' END AS executed,
       CAST((s_suppkey * 131) % 9000 AS DOUBLE) AS x0, CAST((s_suppkey * 131) % 9000 + 900 AS DOUBLE) AS x1,
       CAST(CAST(floor(s_suppkey / 100) AS BIGINT) * 2300 + (s_suppkey * 53) % 2200 AS DOUBLE) AS y0,
       CAST(CAST(floor(s_suppkey / 100) AS BIGINT) * 2300 + (s_suppkey * 53) % 2200 + 6 AS DOUBLE) AS y1
FROM {supplier}"""

FIXTURES["fx_points"] = """
SELECT event_id, CAST((event_id * 37) % 10300 AS DOUBLE) + 0.5 AS px,
       CAST((event_id * 11) % 2400 + CAST(floor(event_id / 10000) AS BIGINT) * 2400 AS DOUBLE) + 0.5 AS py
FROM {events}"""


#: what is asked for a parcel; fx_cases adds it to the parcels row by row
CASE_COLUMNS = {
    "facility": _case("id % 7", ["", "농막", "움막", "축사", "호텔", "원룸 카페", "상가 점포"]),
    "far_target": "CAST(100 + id % 9 * 75 AS DOUBLE)",
    "parking_strategy": _case("id % 5", ["", "surface", "underground", "mixed", "unspecified"]),
}

FIXTURES["fx_cases"] = f"""
SELECT id, pnu, address, jurisdiction, jimok, building_use, geom_area,
       {_case("id % 22", fv.STANDARD_ZONES + ["미지정지역"])} AS zone,
       {CASE_COLUMNS["facility"]} AS facility,
       {CASE_COLUMNS["far_target"]} AS far_target,
       {CASE_COLUMNS["parking_strategy"]} AS parking_strategy
FROM {{fx_parcels}}"""

FIXTURES["fx_region_requests"] = f"""
SELECT nationkey AS request_id, CAST(CASE WHEN nationkey % 3 = 2 AND nationkey % 2 = 0 THEN 2 ELSE nationkey % 2 END AS BIGINT) AS kind,
       substring(jurisdiction, position(' ' IN jurisdiction) + 1) AS county,
       substring(jurisdiction, 1, position(' ' IN jurisdiction) - 1) AS sido,
       CASE WHEN nationkey % 3 = 2 AND nationkey % 2 = 0 THEN '한국 나라' WHEN nationkey % 2 = 0 THEN jurisdiction
            ELSE jurisdiction || ' 마을1리' END AS region,
       jurisdiction || ' 마을900리' AS broad_region,
       {_case("nationkey % 4", ["", "농막", "움막", "공장"])} AS building_use,
       {_case("nationkey % 3", ["창고 지을 땅", "텃밭 추천", "산지전용 가능한 임야"])} AS query
FROM {{fx_jurisdictions}}"""

FIXTURES["fx_plan_sources"] = f"""
SELECT n_nationkey AS source_no, '나라' || {_STR("n_nationkey % 23")} || {_case("(n_nationkey % 23) % 3", ["시", "군", "구"])} AS org,
       '지구' || {_STR("n_nationkey")} AS plan_name, '마을' || {_STR("n_nationkey % 5 + 1")} || '|가축' AS terms,
       n_nationkey % 2 = 0 AS needs_check
FROM {{nation}} WHERE n_regionkey <> 2"""


def dependencies(text: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(text) if f))


@functools.lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    out: list[str] = []
    for dep in dependencies(FIXTURES[name]):
        if dep in FIXTURES:
            out.extend(d for d in _closure(dep) if d not in out)
    return tuple(out) + (name,)


def with_clause(*names: str) -> str:
    """``WITH`` list text for the named views and all they depend on."""
    order: list[str] = []
    for name in names:
        order.extend(n for n in _closure(name) if n not in order)
    parts = []
    for name in order:
        text = FIXTURES[name]
        parts.append(f"{name} AS ({text.format(**{d: d for d in dependencies(text)})})")
    return ",\n".join(parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as it is stored; one of a single split is spread, so what moves is never more than one split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df


_PLANS: dict[tuple, DataFrame] = {}


def cached_plan(spark: SparkSession, key: tuple, make) -> DataFrame:
    """Analyse a lazy plan once per session and reuse it (no data is held)."""
    full = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), *key)
    if full not in _PLANS:
        _PLANS[full] = make()
    return _PLANS[full]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` (or a base table) as a lazy DataFrame."""
    def make() -> DataFrame:
        if name in TABLES:
            return table(spark, sf_dir, name)
        text = FIXTURES[name]
        return spark.sql(text, **{d: view(spark, sf_dir, d) for d in dependencies(text)})
    return cached_plan(spark, (sf_dir, name), make)

"""Fixed values.

Everything in this module is a value that results depend on (names, codes,
tables of limits, keyword lists).  They are kept in their natural order because
several lookups are "first entry wins".  No logic lives here.
"""

# --- zones, land categories, uses (fixed values) ------------------------------

STANDARD_ZONES = [
    "제1종전용주거지역", "제2종전용주거지역", "제1종일반주거지역", "제2종일반주거지역",
    "제3종일반주거지역", "준주거지역", "중심상업지역", "일반상업지역", "근린상업지역",
    "유통상업지역", "전용공업지역", "일반공업지역", "준공업지역", "보전녹지지역",
    "생산녹지지역", "자연녹지지역", "보전관리지역", "생산관리지역", "계획관리지역",
    "농림지역", "자연환경보전지역",
]

NON_URBAN_ZONES = ["계획관리지역", "생산관리지역", "보전관리지역", "농림지역", "자연환경보전지역"]

CANDIDATE_ZONES = NON_URBAN_ZONES + ["생산녹지지역", "보전녹지지역", "자연녹지지역"]

NORTH_DAYLIGHT_ZONES = [
    "제1종전용주거지역", "제2종전용주거지역", "제1종일반주거지역", "제2종일반주거지역",
    "제3종일반주거지역",
]

JIMOK_CODES = {
    "전": "전", "답": "답", "과": "과수원", "목": "목장용지", "임": "임야", "광": "광천지",
    "염": "염전", "대": "대", "장": "공장용지", "학": "학교용지", "차": "주차장",
    "주": "주유소용지", "창": "창고용지", "도": "도로", "철": "철도용지", "제": "제방",
    "천": "하천", "구": "구거", "유": "유지", "양": "양어장", "수": "수도용지",
    "공": "공원", "체": "체육용지", "원": "유원지", "종": "종교용지", "사": "사적지",
    "묘": "묘지", "잡": "잡종지",
}

JIMOK_FARMLAND = ["전", "답", "과수원"]
JIMOK_FOREST = ["임야"]
JIMOK_BUILDABLE = ["대", "공장용지", "창고용지", "학교용지", "주차장", "주유소용지", "종교용지"]
JIMOK_CHECK_LAYERS = {"farmland": ["농업진흥지역"], "forest": ["보전산지구분", "경사도(DEM)"]}

ROAD_JIMOK = ["도", "도로"]
DRAIN_JIMOK = {"구": "구거", "구거": "구거", "천": "하천", "하천": "하천"}
PUBLIC_DRAIN_JIMOK = ["도", "도로", "구", "구거", "천", "하천"]
ROAD_OUTLET_LABEL = "도로(도로측구)"

GENERIC_USE = "시설물"

# use -> (allowed zones, conditional zones)
USE_MATRIX = {
    "단독주택": (
        ["제1종전용주거지역", "제2종전용주거지역", "제1종일반주거지역", "제2종일반주거지역",
         "제3종일반주거지역", "준주거지역"],
        ["근린상업지역", "일반상업지역", "자연녹지지역", "계획관리지역", "생산관리지역",
         "보전관리지역"],
    ),
    "공동주택": (
        ["제2종전용주거지역", "제2종일반주거지역", "제3종일반주거지역", "준주거지역"],
        ["제1종일반주거지역", "근린상업지역", "일반상업지역", "준공업지역"],
    ),
    "제1종근린생활시설": (
        ["제1종전용주거지역", "제2종전용주거지역", "제1종일반주거지역", "제2종일반주거지역",
         "제3종일반주거지역", "준주거지역", "중심상업지역", "일반상업지역", "근린상업지역",
         "유통상업지역", "전용공업지역", "일반공업지역", "준공업지역"],
        ["자연녹지지역", "생산녹지지역", "계획관리지역"],
    ),
    "제2종근린생활시설": (
        ["준주거지역", "중심상업지역", "일반상업지역", "근린상업지역", "유통상업지역",
         "일반공업지역", "준공업지역"],
        ["제1종일반주거지역", "제2종일반주거지역", "제3종일반주거지역", "자연녹지지역",
         "계획관리지역"],
    ),
    "업무시설": (
        ["준주거지역", "중심상업지역", "일반상업지역", "근린상업지역", "준공업지역"],
        ["제2종일반주거지역", "제3종일반주거지역", "유통상업지역", "일반공업지역"],
    ),
    "판매시설": (
        ["중심상업지역", "일반상업지역", "유통상업지역", "근린상업지역"],
        ["준주거지역", "준공업지역"],
    ),
    "숙박시설": (
        ["중심상업지역", "일반상업지역", "유통상업지역"],
        ["근린상업지역", "계획관리지역", "자연녹지지역"],
    ),
    "공장": (
        ["전용공업지역", "일반공업지역", "준공업지역"],
        ["계획관리지역", "생산녹지지역", "자연녹지지역"],
    ),
    "창고시설": (
        ["유통상업지역", "전용공업지역", "일반공업지역", "준공업지역"],
        ["계획관리지역", "생산녹지지역", "자연녹지지역", "생산관리지역", "농림지역"],
    ),
    "교육연구시설": (
        ["제1종일반주거지역", "제2종일반주거지역", "제3종일반주거지역", "준주거지역",
         "중심상업지역", "일반상업지역", "근린상업지역"],
        ["제1종전용주거지역", "제2종전용주거지역", "준공업지역", "일반공업지역",
         "자연녹지지역", "생산녹지지역", "보전녹지지역", "계획관리지역", "생산관리지역",
         "보전관리지역", "농림지역"],
    ),
}

# --- measures (fixed values) ----------------------------------------------------

FLOOR_HEIGHT_M = 3.3
MIN_FOOTPRINT_M2 = 10.0
STRADDLE_MAX_PIECE_M2 = 330.0
PARKING_SPACE_M2 = 25.0
PYEONG_M2 = 3.3058

# use -> (mode, m2 per unit); the detached-house steps follow below
PARKING_RULES = {
    "단독주택": ("detached_house", 100.0),
    "공동주택": ("household_proxy", 85.0),
    "업무시설": ("area_ratio", 150.0),
    "판매시설": ("area_ratio", 150.0),
    "제1종근린생활시설": ("area_ratio", 200.0),
    "제2종근린생활시설": ("area_ratio", 200.0),
    "숙박시설": ("area_ratio", 200.0),
    "공장": ("area_ratio", 350.0),
    "창고시설": ("area_ratio", 400.0),
}
DETACHED_FREE_M2 = 50.0
DETACHED_ONE_SPACE_M2 = 150.0

MIN_LOT_M2 = {"주거": 60, "상업": 150, "공업": 150, "녹지": 200}
MIN_LOT_OTHER_M2 = 60

FARM_RATE_PROMOTION = 0.3
FARM_RATE_OUTSIDE = 0.2
FARM_UNIT_CAP_WON = 50000.0
FOREST_BASE_CONSERVATION_WON = 10840.0
FOREST_BASE_QUASI_WON = 8340.0
FOREST_PRICE_RATE = 0.001
CONSERVATION_FOREST_CODES = ["UFM100", "UFM110", "UFM120"]
CONSERVATION_FOREST_NAMES = ["보전산지", "임업용산지", "공익용산지"]

METRO_REGIONS = ["서울", "부산", "대구", "인천", "광주", "대전", "울산"]
NON_URBAN_TERMS = ["관리지역", "농림지역", "자연환경보전지역"]
DEV_AREA_NON_URBAN, DEV_AREA_METRO, DEV_AREA_OTHER = 1650, 660, 990
DEV_NATIONAL = (4498, 372979)
DEV_REGIONS = {
    "서울": (15, 11249), "부산": (47, 2953), "대구": (42, 2148), "인천": (142, 7300),
    "광주": (29, 4429), "대전": (29, 681), "울산": (41, 2085), "세종": (41, 1261),
    "경기": (2589, 253170), "강원": (186, 25675), "충북": (214, 5015), "충남": (248, 15613),
    "전북": (43, 1768), "전남": (46, 2436), "경북": (206, 8024), "경남": (152, 8232),
    "제주": (428, 20940),
}
SIDO_KEYS = [
    ("서울", "서울"), ("부산", "부산"), ("대구", "대구"), ("인천", "인천"), ("광주", "광주"),
    ("대전", "대전"), ("울산", "울산"), ("세종", "세종"), ("경기", "경기"), ("강원", "강원"),
    ("충청북", "충북"), ("충북", "충북"), ("충청남", "충남"), ("충남", "충남"),
    ("전라북", "전북"), ("전북", "전북"), ("전라남", "전남"), ("전남", "전남"),
    ("경상북", "경북"), ("경북", "경북"), ("경상남", "경남"), ("경남", "경남"), ("제주", "제주"),
]

SLOPE_BANDS = [0.0, 5.0, 10.0, 15.0, 20.0]

# --- designations and constraints (fixed values) ---------------------------------

ZONING_CODE_PREFIXES = ["UQA", "UQB", "UQC", "UQD"]

CONSTRAINT_KEYWORDS = [
    ("지구단위계획", "지구단위계획으로 용도·밀도·높이가 별도 지정되므로 계획 내용 확인 필요"),
    ("경관", "높이·형태·색채 제한. 경관심의 대상 여부 확인 필요"),
    ("고도지구", "최고 높이가 별도 지정되어 용적률 상한을 못 쓸 수 있음"),
    ("방화지구", "건축물 주요 구조부 내화구조 의무"),
    ("개발제한", "원칙적으로 건축 불가. 예외 허가 대상만 가능"),
    ("문화재", "현상변경 허가 및 문화재청(국가유산청) 협의 필요"),
    ("문화유산", "현상변경 허가 및 국가유산청 협의 필요"),
    ("문화유산보호", "현상변경 허가 및 국가유산청 협의 필요"),
    ("역사문화환경", "지정문화유산 역사문화환경 보존지역 — 건설공사 시 현상변경 허가 및 국가유산청(지자체) 영향검토 필요"),
    ("학교", "정화구역이면 숙박·유흥시설 등 금지시설 존재 — 교육환경 확인 필요"),
    ("상수원보호", "건축·행위 제한. 상수원보호구역 규제 확인 필요"),
    ("수질보전특별대책", "수질보전 특별대책지역 — 권역별로 오수·폐수 배출과 건축·개발이 제한. 행위제한 권역 확인 및 유역환경청 협의 필요"),
    ("특별대책지역", "환경정책기본법상 특별대책지역 — 오수·폐수 배출과 건축·개발 행위가 제한. 권역별 기준 확인 필요"),
    ("배출시설설치제한", "폐수·오수 배출시설 설치제한지역 — 배출시설 설치·운영이 제한되어 오수처리계획 확인 필요"),
    ("수변구역", "한강수계 등 수변구역 — 오수 배출·건축 행위 제한. 유역환경청 확인 필요"),
    ("군사", "군사기지·시설보호구역이면 국방부(관할 부대) 협의 필요"),
    ("비행안전", "고도 제한. 공항 주변 비행안전구역 확인 필요"),
    ("가축사육제한", "가축분뇨법상 축사 제한 — 축산 시설이면 확인 필요"),
]
FACILITY_SCOPE = {
    "가축사육제한": ["축사", "축산", "가축", "우사", "돈사", "계사", "양계", "양돈", "사육",
                 "축분", "퇴비", "젖소", "종축", "부화"],
    "학교": ["숙박", "여관", "호텔", "모텔", "유흥", "단란", "위험물", "노래연습장", "당구장",
           "게임", "피시방", "PC", "만화", "담배", "폐기물", "장례"],
}

SCREEN_CATEGORIES = [
    ("재해", ["자연재해위험", "재해위험", "방재지구", "붕괴위험", "침수위험"],
     "자연재해대책법 및 해당 재해 관련 법령"),
    ("생태·환경", ["생태·경관보전", "생태경관보전", "야생생물보호", "환경보전해역"],
     "자연환경보전법 및 환경 관련 법령"),
    ("상수원·수질", ["상수원보호", "수변구역", "수질보전", "특별대책지역", "배출시설설치제한"],
     "수도법·물환경보전법 및 상수원 관련 법령"),
    ("자연공원", ["자연공원", "공원구역", "국립공원", "도립공원", "군립공원"], "자연공원법"),
    ("습지", ["습지보호", "습지주변관리"], "습지보전법"),
    ("국가유산", ["문화재", "국가유산", "역사문화", "보존유적"],
     "국가유산영향진단법 및 국가유산 관련 법령"),
]
SCREEN_DISASTER_BASIS = "자연재해대책법에 따른 재해위험지구"
SCREEN_ECO_BASIS = "자연환경보전법에 따른 생태·자연도"
SCREEN_SEPARATE_BASIS = "생태·자연도 별도관리지역 공간자료와 개별 보호 법령"
UNKNOWN_DISASTER = "재해위험지구 전국 공간자료"
UNKNOWN_ECO = "생태·자연도 등급"

AGRICULTURE_NAMES = {"UEA110": "농업진흥구역", "UEA120": "농업보호구역"}
FOREST_CLASS_NAMES = {
    "UFM000": "보전준보전산지미분류", "UFM100": "보전산지", "UFM110": "임업용산지",
    "UFM120": "공익용산지", "UFM200": "준보전산지", "UFM999": "보전준보전산지기타",
}
FOREST_NAME_FIELDS = ["uname", "scls_nm", "zone_name", "alias", "remark"]
FOREST_CODE_FIELDS = ["ucode", "mnum", "scls_cd", "zone_code"]

RESTRICTION_RED = ["개발제한", "맹지", "도로 접촉 없음", "보전산지", "상수원", "농업진흥",
                   "1등급", "재해", "위험"]
COLOR_RED, COLOR_ORANGE, COLOR_GREY = "#C62828", "#F9A825", "#9E9E9E"
NO_ROAD_LABEL = "도로 접촉 없음(맹지 가능성)"

# --- spatial layers (fixed values): id, title, provider ---------------------------

LAYERS = [
    ("agricultural_promotion", "농업진흥지역", "농림축산식품부"),
    ("forest_class", "산지구분", "산림청"),
    ("forest_inventory", "1:5,000 임상도", "산림청"),
    ("ecological_nature", "생태·자연도", "국립생태원"),
    ("ecological_separate_management", "생태·자연도 별도관리지역", "국립생태원"),
    ("disaster_risk_zone", "재해위험지구", "국토교통부 국가공간정보센터"),
]

CONTACT_TOLERANCE_M = 0.35
ROAD_MIN_WIDTH_M = 4.0
DRAIN_SEARCH_M = 180.0

# --- ownership (fixed values) -------------------------------------------------------

PUBLIC_OWNER_TOKENS = ["국유", "공유", "시유", "도유", "군유", "구유", "국·공유", "공공"]
PRIVATE_OWNER_TOKENS = ["개인", "법인", "사유", "종중", "종교", "외국인", "민유", "기타"]

# --- legal conflicts (fixed values) --------------------------------------------------
# rule id, priority, path, value, status, blocks, consult

CONFLICT_RULES = [
    ("conflict.explicit_prohibition", 100, "regulation.verdict", "not_allowed", "BLOCKED", True, False),
    ("conflict.restricted_conversion", 90, "land_conversion.status", "RESTRICTED_REVIEW",
     "UNRESOLVED_CONFLICT", True, True),
    ("conflict.farmland_cumulative", 50, "jimok_info.category", "farmland",
     "CUMULATIVE_REQUIREMENTS", False, True),
    ("conflict.forest_cumulative", 50, "jimok_info.category", "forest",
     "CUMULATIVE_REQUIREMENTS", False, True),
]

# --- permit steps (fixed values) -------------------------------------------------------

PERMIT_SETS = {
    "non_urban_zones": NON_URBAN_ZONES,
    "buildable_verdicts": ["allowed", "conditional", "unknown"],
}
PERMIT_RULES = [
    {
        "rule_id": "permit.demolition", "order": 10,
        "when": {"path": "existing_buildings.has_buildings", "op": "truthy"},
        "emit": {
            "id": "demolition", "phase": "site_preparation",
            "name": "기존 건축물 해체허가·신고 및 멸실 정리",
            "department": "${authority} 건축 담당부서",
            "basis": "건축물관리법 및 건축물대장 관련 규정",
            "legal_ref_ids": ["law.building_management.demolition"],
        },
    },
    {
        "rule_id": "permit.farmland_conversion", "order": 20,
        "when": {"path": "jimok_info.category", "op": "equals", "value": "farmland"},
        "emit": {
            "id": "farmland_conversion", "phase": "land_conversion", "name": "농지전용허가·협의",
            "department": "${authority} 농지 담당부서", "basis": "농지법 제34조",
            "legal_ref_ids": ["law.farmland.article_34"],
        },
    },
    {
        "rule_id": "permit.forest_conversion", "order": 20,
        "when": {"path": "jimok_info.category", "op": "equals", "value": "forest"},
        "emit": {
            "id": "forest_conversion", "phase": "land_conversion", "name": "산지전용허가",
            "department": "${authority} 산림 담당부서",
            "basis": "산지관리법 제14조 및 같은 법 시행규칙",
            "legal_ref_ids": ["law.mountainous_district.article_14",
                              "law.mountainous_district.enforcement_rule"],
        },
    },
    {
        "rule_id": "permit.road_review", "order": 30,
        "when": {"any": [
            {"path": "road_access.status", "op": "not_equals", "value": "CADASTRAL_CONTACT"},
            {"path": "road_access.unknowns", "op": "nonempty"},
        ]},
        "emit": {
            "id": "road_review", "phase": "site_access", "name": "건축법상 도로·접도 확인",
            "department": "${authority} 건축·도로 담당부서",
            "basis": "건축법 제2조제1항제11호 및 제44조",
            "legal_ref_ids": ["law.building.article_2_road", "law.building.article_44"],
        },
    },
    {
        "rule_id": "permit.special_review", "order": 40,
        "for_each": "regulatory_screen.findings",
        "when": {"path": "item.severity", "op": "equals", "value": "REVIEW"},
        "emit": {
            "id": "special_${item.category}", "phase": "agency_review",
            "name": "${item.category} 관련 협의·영향진단",
            "department": "${authority} 관련 전문부서", "basis": "${item.basis}",
            "legal_ref_ids": [],
        },
    },
    {
        "rule_id": "permit.development_activity", "order": 50,
        "when": {"any": [
            {"path": "regulation.zone", "op": "in_set", "set": "non_urban_zones"},
            {"path": "jimok_info.category", "op": "in", "value": ["farmland", "forest"]},
        ]},
        "emit": {
            "id": "development_activity", "phase": "development_permission",
            "name": "개발행위허가", "department": "${authority} 도시계획·개발행위 담당부서",
            "basis": "국토의 계획 및 이용에 관한 법률 제56조",
            "legal_ref_ids": ["law.national_land_planning.article_56"],
            "depends_on_if_present": ["farmland_conversion", "forest_conversion", "road_review"],
        },
    },
    {
        "rule_id": "permit.building_permission", "order": 90,
        "when": {"path": "regulation.verdict", "op": "in_set_or_missing",
                 "set": "buildable_verdicts"},
        "emit": {
            "id": "building_permission", "phase": "building_permission",
            "name": "건축허가 또는 건축신고", "department": "${authority} 건축 담당부서",
            "basis": "건축법 제11조·제14조",
            "legal_ref_ids": ["law.building.article_11", "law.building.article_14"],
            "depends_on_all_previous": True,
        },
    },
]
DEFAULT_AUTHORITY = "관할 시·군·구"

# --- candidate search (fixed values) -----------------------------------------------------

FARM_TARGET_JIMOK = ["전", "답", "과수원"]
FOREST_TARGET_JIMOK = ["임"]
GENERAL_TARGET_JIMOK = ["대", "잡종지", "공장용지", "창고용지", "전", "답", "과수원", "목장용지"]
FARM_HINTS = ["농막", "농지", "밭", "논", "텃밭", "농사", "영농", "과수"]
FOREST_HINTS = ["산지전용", "산지", "임야", "임업", "산 지", "산림"]
BUILT_UP_JIMOK = ["대", "잡종지", "공장용지", "창고용지", "학교용지", "종교용지"]

# --- request wording (fixed values) -------------------------------------------------------

SHOP_TERMS = ["상가", "점포", "상점", "마트", "쇼핑", "백화점", "음식점", "식당", "카페",
              "주점", "술집", "상업시설", "상업"]
AMBIGUOUS_USE_TERMS = [
    ("다가구", ["단독주택"]), ("다세대", ["공동주택"]), ("원룸", ["단독주택", "공동주택"]),
    ("상업시설", ["제1종근린생활시설", "제2종근린생활시설", "판매시설"]),
    ("상업", ["제1종근린생활시설", "제2종근린생활시설", "판매시설"]),
    ("상가", ["판매시설", "제2종근린생활시설"]), ("점포", ["판매시설", "제2종근린생활시설"]),
    ("상점", ["판매시설"]), ("마트", ["판매시설"]), ("쇼핑", ["판매시설"]),
    ("백화점", ["판매시설"]), ("음식점", ["제2종근린생활시설"]), ("식당", ["제2종근린생활시설"]),
    ("카페", ["제2종근린생활시설"]), ("주점", ["제2종근린생활시설"]),
    ("술집", ["제2종근린생활시설"]), ("모텔", ["숙박시설"]), ("호텔", ["숙박시설"]),
    ("펜션", ["숙박시설"]), ("공장", ["공장"]), ("창고", ["창고시설"]),
    ("학교", ["교육연구시설"]), ("교육연구시설", ["교육연구시설"]),
    ("주택", ["단독주택", "공동주택"]),
]
PARKING_WORDS = [("지하주차", "underground"), ("기계식주차", "mechanical"),
                 ("지상주차", "surface"), ("혼합주차", "mixed")]

# --- legal text (fixed values) ---------------------------------------------------------------

CHUNK_KEYWORDS = (
    "건폐율|용적률|용도지역|높이|이격|공지|층수|용도|별표|건축선|일조|경관|지구단위|"
    "녹지|관리지역|주거지역|상업지역|공업지역|취락|개발진흥"
)
ORDINANCE_SUFFIXES = ["도시계획 조례", "군계획 조례", "도시계획조례", "군계획조례"]
BCR_INLINE, FAR_INLINE = "용도지역안에서의건폐율", "용도지역안에서의용적률"
BCR_CLAUSE, FAR_CLAUSE = "제84조제1항", "제85조제1항"
CHUNK_CHARS = 1200
PASSAGE_CHARS = 1500
SNIPPET_CHARS = 280
NATIONAL = "전국"

SETBACK_PASSAGE = "대지.{0,6}공지|인접.{0,4}대지경계|건축선.{0,6}후퇴|이격|공지.{0,4}기준"
LAW_KEYWORDS = (
    "토지|대지|필지|개발행위|건축|용도지역|용도지구|용도구역|건폐율|용적률|농지|산지|전용|도로|접도|"
    "건축선|주차|재해|환경|생태|상수원|수질|공원|습지|국가유산|매장유산|허가|신고|협의|심의|부담금|복구|준공"
)
USE_KEYWORDS = [
    ("창고", "창고시설"), ("물류", "창고시설"), ("공장", "공장"), ("아파트", "공동주택"),
    ("빌라", "공동주택"), ("원룸", "단독주택"), ("다가구", "단독주택"), ("주택", "단독주택"),
    ("집", "단독주택"), ("사무", "업무시설"), ("빌딩", "업무시설"), ("오피스", "업무시설"),
    ("상업시설", "판매시설"), ("상업", "판매시설"), ("학교", "교육연구시설"),
    ("교육연구시설", "교육연구시설"), ("상가", "제1종근린생활시설"),
    ("근린생활", "제1종근린생활시설"), ("마트", "판매시설"), ("판매", "판매시설"),
    ("호텔", "숙박시설"), ("펜션", "숙박시설"), ("모텔", "숙박시설"),
]
FEASIBLE_SUBJECTS = ["건물", "건축", "신축", "시설", "주택", "집", "개발", "건축허가", "허가"]
FEASIBLE_ACTION = "지을|짓|지어|세울|세워|올릴|올려|들어갈|신축"
FEASIBLE_WORDING = (
    "가능|지을|짓|지어|지어도|세울|세워|올릴|올려도|들어갈|들어오|입지|신축|개발할|개발해도|"
    "할수있|될수있|날수있|허가나|허가날|해도돼|해도되|돼|되나|되니|될까|되는지|허용|가능여부|검토"
)
SPECIAL_OBJECT = "([가-힣A-Za-z0-9]{2,12})\\s*(?:을|를)?\\s*(?:지을|지어|짓|설치|세우|세울|올릴|올려|들일|들여)"
GENERIC_OBJECTS = ["건물", "건축물", "시설물", "여기", "거기", "이곳", "그곳", "무엇", "무얼", "개발", "허가", "이곳에"]
COORDINATES = "경도\\s*(-?\\d+(?:\\.\\d+)?)[^\\d-]+위도\\s*(-?\\d+(?:\\.\\d+)?)"
PARCEL_ADDRESS = ("((?:[가-힣0-9]+(?:특별시|광역시|특별자치시|특별자치도|도|시|군|구|읍|면|동|리)\\s+)+"
                  "(?:산\\s*)?\\d+(?:-\\d+)?)")
PARCEL_ADDRESS_TEST = "(?:읍|면|동|리)\\s+(?:산\\s*)?\\d+(?:-\\d+)?(?:\\D|$)"
LAW_NAME = "([가-힣·\\s]+?(?:법률|법|시행령|시행규칙))(?=\\s*제?\\d|\\s*(?:및|,|·|$))"
SAME_LAW = "(?:및|,|·)?\\s*같은\\s+법\\s+(?:시행령|시행규칙)"
ARTICLE_HEADING = r"^\s*제\d+조(?:의\d+)?\s*\([^)]*\)"
LOT_MENTION = "(?:([가-힣]{1,12}(?:동|리|가))\\s*)?(산\\s*)?(\\d{1,4})(?:\\s*[-－]\\s*(\\d{1,4}))?"

# appendix tables: text in a cell -> building use, in test order
GRID_USES = [
    ("공동주택", "공동주택"), ("아파트", "공동주택"), ("연립주택", "공동주택"), ("다세대", "공동주택"),
    ("단독주택", "단독주택"), ("전용주거지역에서 건축", "단독주택"), ("공장", "공장"),
    ("창고", "창고시설"), ("판매시설", "판매시설"), ("숙박시설", "숙박시설"),
    ("제1종근린생활시설", "제1종근린생활시설"), ("제2종근린생활시설", "제2종근린생활시설"),
    ("근린생활시설", "제2종근린생활시설"), ("업무시설", "업무시설"), ("의료시설", "의료시설"),
    ("교육연구시설", "교육연구시설"), ("위락시설", "위락시설"),
]
GRID_DISTANCE = "(\\d+(?:\\.\\d+)?)\\s*(?:미터|m|M)(?![A-Za-z0-9])"
GRID_GROSS = "(\\d[\\d,]*)\\s*(?:제곱미터|㎡|m2|평방미터)"
GRID_SUB_GROSS = "(\\d[\\d,]*)\\s*(?:제곱미터|㎡)\\s*(미만|이상)"
MAX_GRID_DISTANCE_M = 12
SPECIAL_ECOLOGY_FIELDS = ["산림보호", "국립공원", "도립공원", "군립공원", "천연기념물", "야생동식물",
                          "수산자원", "습지보호", "백두대간", "생태경관", "비고"]

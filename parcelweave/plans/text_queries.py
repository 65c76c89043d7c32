"""Queries over legal text, retrieval and payload parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import geometry as geo
from ..operators import legal_text, payloads, search
from .registry import Inputs, query, sql, values
from .rule_queries import zone_districts

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace({}, '<!\[CDATA\[|\]\]>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""
ART_CTE = r"""
ar AS (SELECT doc_no, unnest(range(0, len(t))) AS pos, unnest(t) AS t, unnest(b) AS b FROM (SELECT doc_no, regexp_extract_all(xml, '(?s)<조제목>(.*?)</조제목>.*?<조내용>(.*?)</조내용>', 1) AS t,
   regexp_extract_all(xml, '(?s)<조제목>(.*?)</조제목>.*?<조내용>(.*?)</조내용>', 2) AS b FROM fx_law_docs) x),
art AS (SELECT doc_no, CAST(pos AS INTEGER) AS pos, """ + CLEAN.format("t") + " AS title, " + CLEAN.format("b") + """ AS body FROM ar),
app AS (SELECT doc_no, """ + CLEAN.format(r"regexp_extract(xml, '(?s)<별표내용>(.*?)</별표내용>', 1)") + " AS body FROM fx_law_docs)"
ZONES_CTE = values([(n, z) for n, z in enumerate(fv.STANDARD_ZONES)], "zn", "n, zone")


def _base_cte(kind: str, inline: str, clause: str) -> str:
    return rf"""
{kind}_s AS (SELECT a.doc_no, a.pos, a.body, count(*) FILTER (regexp_matches(a.body, zn.zone || '\s*(?::|은|는)?\s*\d{{1,4}}\s*(?:퍼센트|%)')) AS score FROM art a CROSS JOIN zn
  WHERE contains(replace(CASE WHEN regexp_matches(a.title, '\([^)]*\)') THEN regexp_extract(a.title, '\(([^)]*)\)', 1) ELSE a.title END || ' ' || regexp_extract(a.body, '^\s*제\d+조(?:의\d+)?\s*\([^)]*\)', 0), ' ', ''), '{inline}')
   OR contains(replace(a.body, ' ', ''), '{clause}') GROUP BY 1, 2, 3),
{kind} AS (SELECT doc_no, pos, score, body FROM (SELECT *, row_number() OVER (PARTITION BY doc_no ORDER BY score DESC, pos) AS rn FROM {kind}_s WHERE score > 0) t WHERE rn = 1),
{kind}_v AS (SELECT doc_no, zone, CAST(v AS INTEGER) AS value FROM (SELECT doc_no, zone, regexp_extract(body, zone || '\s*(?::|은|는)?\s*(\d{{1,4}})\s*(?:퍼센트|%)', 1) AS v FROM {kind} CROSS JOIN zn) t WHERE v <> '')"""


BASE_CTE = ",".join([ART_CTE, ZONES_CTE, _base_cte("bcr", fv.BCR_INLINE, fv.BCR_CLAUSE), _base_cte("far", fv.FAR_INLINE, fv.FAR_CLAUSE)])


@query("extract_articles", sql("fx_law_docs", "SELECT * FROM art", ART_CTE))
def extract_articles(i: Inputs):
    return legal_text.extract_articles(i.view("fx_law_docs"))


@query("latest_ordinance", sql("fx_law_docs", """
SELECT org, doc_no FROM (SELECT org, doc_no, row_number() OVER (PARTITION BY org ORDER BY effective_date DESC, doc_no DESC) AS rn FROM fx_law_docs
 WHERE kind = '조례' AND regexp_matches(name, '(도시계획|군계획) ?조례$')) t WHERE rn = 1"""))
def latest_ordinance(i: Inputs):
    return legal_text.latest_ordinance(i.view("fx_law_docs"))


@query("base_article", sql("fx_law_docs", "SELECT doc_no, 'bcr' AS kind, pos, CAST(score AS INTEGER) AS score FROM bcr UNION ALL SELECT doc_no, 'far', pos, CAST(score AS INTEGER) FROM far", BASE_CTE))
def base_article(i: Inputs):
    art = legal_text.extract_articles(i.view("fx_law_docs"))
    one = lambda k: legal_text.base_article(art, k).select("doc_no", F.lit(k).alias("kind"), "pos", "score")
    return one("bcr").unionByName(one("far"))


def extracted(i: Inputs, kind: str):
    return legal_text.zone_values(legal_text.base_article(legal_text.extract_articles(i.view("fx_law_docs")), kind))


@query("zone_values", sql("fx_law_docs", "SELECT * FROM bcr_v", BASE_CTE))
def zone_values(i: Inputs):
    return extracted(i, "bcr")


@query("validate_limits", sql("fx_law_docs fx_statutory", """
SELECT c.doc_no, zone, bcr, far, CAST(d.flags AS BIGINT) AS flags, CAST(d.filled AS BIGINT) AS zones_filled, d.confidence, CASE WHEN d.flags > 0 OR d.confidence = 'low' THEN 'needs_review' ELSE 'auto_extracted' END AS review_status
FROM chk c JOIN (SELECT *, CASE WHEN filled >= 15 THEN 'high' WHEN filled >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT doc_no, sum(fb + ff) AS flags, count(*) FILTER (bcr IS NOT NULL OR far IS NOT NULL) AS filled FROM chk GROUP BY doc_no) x) d ON d.doc_no = c.doc_no
WHERE bcr IS NOT NULL OR far IS NOT NULL""", BASE_CTE + """,
chk AS (SELECT coalesce(b.doc_no, f.doc_no) AS doc_no, coalesce(b.zone, f.zone) AS zone, CASE WHEN b.value > s.bcr_max THEN NULL ELSE b.value END AS bcr, CASE WHEN f.value > s.far_max THEN NULL ELSE f.value END AS far,
   CASE WHEN b.value > s.bcr_max THEN 1 ELSE 0 END AS fb, CASE WHEN f.value > s.far_max THEN 1 ELSE 0 END AS ff
  FROM bcr_v b FULL JOIN far_v f ON f.doc_no = b.doc_no AND f.zone = b.zone LEFT JOIN fx_statutory s ON s.zone = coalesce(b.zone, f.zone))"""))
def validate_limits(i: Inputs):
    return legal_text.validate_limits(extracted(i, "bcr"), extracted(i, "far"), i.view("fx_statutory"))


@query("setback_passages", sql("fx_law_docs", r"""
SELECT doc_no, pos, nullif(regexp_extract(body, '제\d+조(?:의\d+)?', 0), '') AS article, CASE WHEN regexp_matches(src, '\([^)]*\)') THEN regexp_extract(src, '\(([^)]*)\)', 1) ELSE '대지 안의 공지' END AS title, body AS text
FROM (SELECT *, CASE WHEN title <> '' THEN title ELSE regexp_extract(body, '^\s*제\d+조(?:의\d+)?\s*\([^)]*\)', 0) END AS src FROM art WHERE regexp_matches(body, '대지.{0,6}공지|인접.{0,4}대지경계|건축선.{0,6}후퇴|이격|공지.{0,4}기준')) t""", ART_CTE))
def setback_passages(i: Inputs):
    return legal_text.setback_passages(legal_text.extract_articles(i.view("fx_law_docs")))


@query("build_chunks", sql("fx_law_docs", r"""
SELECT doc_no, kind, article, title, CAST(part AS INTEGER) AS part, text, 'ord-' || substr(sha256(org || '|' || coalesce(article, '') || '|' || CAST(part AS STRING) || '|' || text), 1, 20) AS chunk_id, effective_date
FROM (SELECT d.doc_no, d.org, d.effective_date, c.kind, c.article, c.title, p.part, substr(c.body, CAST(p.part * 1200 + 1 AS BIGINT), 1200) AS text FROM (
  SELECT doc_no, '도시계획조례' AS kind, nullif(regexp_extract(body, '제\d+조(?:의\d+)?', 0), '') AS article, CASE WHEN regexp_matches(title, '\([^)]*\)') THEN regexp_extract(title, '\(([^)]*)\)', 1) ELSE title END AS title, body FROM art
   WHERE regexp_matches(title || ' ' || body, '""" + fv.CHUNK_KEYWORDS + r"""') UNION ALL
  SELECT doc_no, '도시계획조례-별표', '별표', '별표', body FROM app WHERE length(body) >= 20 AND regexp_matches(body, '""" + fv.CHUNK_KEYWORDS + r"""')) c
 JOIN fx_law_docs d ON d.doc_no = c.doc_no JOIN (SELECT unnest(range(0, 200)) AS part) p ON p.part * 1200 < length(c.body)) t""", ART_CTE))
def build_chunks(i: Inputs):
    return legal_text.build_chunks(i.view("fx_law_docs")).select("doc_no", "kind", "article", "title", "part", "text", "chunk_id", "effective_date")


@query("law_chunks", sql("fx_law_docs", r"""
SELECT doc_no, 'law-' || substr(sha256(law || '|' || article || '|' || text), 1, 20) AS chunk_id, '전국' AS jurisdiction, law, article, title, text, '법령-조문' AS kind
FROM (SELECT a.doc_no, d.org AS law, CAST(pos AS STRING) AS article, title, body AS text FROM art a JOIN fx_law_docs d ON d.doc_no = a.doc_no) t WHERE text <> '' AND regexp_matches(title || ' ' || text, '""" + fv.LAW_KEYWORDS + "')", ART_CTE))
def law_chunks(i: Inputs):
    docs = i.view("fx_law_docs")
    laws = legal_text.extract_articles(docs).join(docs.select("doc_no", F.col("org").alias("law")), "doc_no") \
        .select("doc_no", "law", F.col("pos").cast("string").alias("article"), "title", F.col("body").alias("text"))
    return legal_text.law_chunks(laws)


def _tok_cte(name: str, source: str, key: str, text: str) -> str:
    return rf"""
{name}_t AS (SELECT {key}, replace({text}, '퍼센트', '%') AS t FROM {source}),
{name}_r AS (SELECT {key}, unnest(regexp_extract_all(t, '[가-힣]{{2,}}')) AS run FROM {name}_t),
{name}_a AS (SELECT {key}, unnest(regexp_extract_all(t, '[가-힣A-Za-z0-9]+')) AS term FROM {name}_t UNION ALL
  SELECT {key}, substr(run, CAST(i AS BIGINT), 2) FROM (SELECT {key}, run, unnest(range(1, length(run))) AS i FROM {name}_r) g UNION ALL
  SELECT {key}, substr(run, CAST(i AS BIGINT), 3) FROM (SELECT {key}, run, unnest(range(1, length(run) - 1)) AS i FROM {name}_r) g),
{name} AS (SELECT {key}, term, count(*) AS tf FROM {name}_a GROUP BY 1, 2)"""


@query("tokenize", sql("fx_law_docs", "SELECT doc_no, term, tf FROM tk", _tok_cte("tk", "fx_law_docs", "doc_no", "xml")))
def tokenize(i: Inputs):
    return search.tokenize(i.view("fx_law_docs"), "doc_no", "xml")


INDEX_CTE = _tok_cte("tf", "fx_chunks", "chunk_no", "text") + """,
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
voc AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfq, (SELECT count(*) AS n FROM fx_chunks) c WHERE df >= 2 AND df <= 0.6::DOUBLE * n),
pw AS (SELECT tf.chunk_no, tf.term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc ON voc.term = tf.term),
post AS (SELECT chunk_no, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_no)) AS weight FROM pw)"""


@query("tfidf_index", sql("fx_chunks", "SELECT chunk_no, term, round(weight, 6) AS weight FROM post", INDEX_CTE))
def tfidf_index(i: Inputs):
    return search.tfidf_index(i.view("fx_chunks"), meta=())[0].select("chunk_no", "term", F.round("weight", 6).alias("weight"))


@query("search", sql("fx_chunks fx_search", """
SELECT query_id, chunk_no, CAST(rank AS INTEGER) AS rank, round(s, 4) AS score FROM (SELECT query_id, chunk_no, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_no DESC) AS rank FROM (
  SELECT q.query_id, p.chunk_no, sum(q.qw * p.weight) AS s FROM qn q JOIN post p ON p.term = q.term JOIN fx_chunks c ON c.chunk_no = p.chunk_no JOIN fx_search f ON f.query_id = q.query_id
   WHERE (c.jurisdiction = '전국' OR c.jurisdiction = f.jurisdiction OR ends_with(c.jurisdiction, ' ' || f.jurisdiction) OR ends_with(f.jurisdiction, ' ' || c.jurisdiction)) AND c.effective_date <= f.effective_on
   GROUP BY 1, 2) x WHERE s > 0) y WHERE rank <= 5""", INDEX_CTE + "," + _tok_cte("qt", "fx_search", "query_id", "query") + """,
qw AS (SELECT qt.query_id, qt.term, (1 + ln(qt.tf)) * idf AS w FROM qt JOIN voc ON voc.term = qt.term),
qn AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qw FROM qw)"""))
def search_query(i: Inputs):
    post, vocab = search.tfidf_index(i.view("fx_chunks"))
    return search.search(i.view("fx_search"), post, vocab, 5)


@query("merge_evidence", sql("fx_chunks fx_designations", """
SELECT id, law, article, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY id, law, article ORDER BY part, pos) AS rn FROM (
  SELECT id, seq AS pos, name AS law, code AS article, 'direct' AS source, 0 AS part FROM fx_designations WHERE relation = '포함' UNION ALL
  SELECT id, seq, name, code, 'search', 1 FROM fx_designations WHERE relation <> '포함' UNION ALL SELECT id, seq + 10, name, code, 'search', 1 FROM fx_designations) a) t WHERE rn = 1"""))
def merge_evidence(i: Inputs):
    d = i.view("fx_designations").select("id", F.col("seq").alias("pos"), F.col("name").alias("law"), F.col("code").alias("article"), "relation")
    hits = d.filter("relation <> '포함'").unionByName(d.withColumn("pos", F.col("pos") + 10))
    return legal_text.merge_evidence(d.filter("relation = '포함'"), hits)


BASES = [r["emit"]["basis"] for r in fv.PERMIT_RULES if "$" not in r["emit"]["basis"]] + [b for _, _, b in fv.SCREEN_CATEGORIES] + [
    "산지관리법 제19조, 같은 법 시행령 제24조 및 연도별 산림청 고시", "농지법 제38조, 농지법 시행령 제53조, 농지법 시행규칙 제47조의2", ""]
BASES_CTE = values([(n, b) for n, b in enumerate(BASES)], "bases", "n, basis") + f""",
pick AS (SELECT p.id, b.k, s.basis FROM fx_parcels p CROSS JOIN (SELECT unnest([0, 1]) AS k) b JOIN bases s ON s.n = (p.id * (1 + 3 * b.k) + b.k) % {len(BASES)})""" + r""",
pl AS (SELECT *, regexp_replace(basis, '(?:및|,|·)?\s*같은\s+법\s+(?:시행령|시행규칙)', '', 'g') AS rest FROM pick),
nm AS (SELECT id, k, unnest(range(0, len(m))) AS j, regexp_replace(trim(regexp_replace(unnest(m), '\s+', ' ', 'g')), '^[ ·,]+|[ ·,]+$', '', 'g') AS name
  FROM (SELECT id, k, regexp_extract_all(rest, '([가-힣·\s]+?(?:법률|법|시행령|시행규칙))(?:\s*제?\d|\s*(?:및|,|·|$))', 1) AS m FROM pl) x),
sm AS (SELECT pl.id, pl.k, 1000 + unnest(range(0, len(regexp_extract_all(basis, '같은\s+법\s+(시행령|시행규칙)', 1)))) AS j,
   regexp_replace(nm.name, '\s+(시행령|시행규칙)$', '') || ' ' || unnest(regexp_extract_all(basis, '같은\s+법\s+(시행령|시행규칙)', 1)) AS name FROM pl JOIN nm ON nm.id = pl.id AND nm.k = pl.k AND nm.j = 0),
ln AS (SELECT id, name, min(k * 10000 + j) AS o FROM (SELECT * FROM nm WHERE name <> '' UNION ALL SELECT * FROM sm) u GROUP BY 1, 2),
laws AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS rn FROM ln) t)"""


def basis_lists(i: Inputs):
    arr = F.array(*[F.lit(b) for b in BASES])
    at = lambda k: F.get(arr, ((F.col("id") * (1 + 3 * k) + k) % len(BASES)).cast("int"))
    return legal_text.law_names(i.view("fx_parcels").select("id", F.array(at(0), at(1)).alias("bases")))


@query("law_names", sql("fx_parcels", "SELECT p.id, coalesce(string_agg(l.name, ',' ORDER BY l.rn), '') AS laws FROM fx_parcels p LEFT JOIN laws l ON l.id = p.id GROUP BY p.id", BASES_CTE))
def law_names(i: Inputs):
    return basis_lists(i).select("id", F.array_join("laws", ",").alias("laws"))


LAW_CATALOG = [(1, "건축법", "20250101"), (2, "산지관리법 시행령", "20240301"), (3, "산지관리법", "20240401"), (4, "농지법 시행령", "20230101"),
               (5, "물환경보전법", "20220101"), (6, "국토의 계획 및 이용에 관한 법률", "20250301"), (7, "농지법 시행규칙", "20230201")]


@query("verify_laws", sql("fx_parcels", """
SELECT p.id, CASE WHEN count(l.name) = 0 THEN 'NO_BASIS' WHEN count(h.title) > 0 THEN 'VERIFIED' ELSE 'UNAVAILABLE' END AS status, count(h.title) AS sources, coalesce(string_agg(h.title, ',' ORDER BY l.rn), '') AS titles
FROM fx_parcels p LEFT JOIN laws l ON l.id = p.id LEFT JOIN (SELECT name, title FROM (SELECT n.name, c.title, row_number() OVER (PARTITION BY n.name ORDER BY c.title <> n.name, c.pos) AS rn
   FROM (SELECT DISTINCT name FROM laws) n JOIN catalog c ON contains(c.title, n.name)) t WHERE rn = 1) h ON h.name = l.name GROUP BY p.id""", BASES_CTE + ", " + values(LAW_CATALOG, "catalog", "pos, title, effective_date")))
def verify_laws(i: Inputs):
    return legal_text.verify_laws(basis_lists(i), i.rows(LAW_CATALOG, "pos int, title string, effective_date string"))


@query("lot_mentions", sql("fx_requests fx_parcels", r"""
SELECT id, label, CAST(min(position(m IN text) - 1) AS INTEGER) AS start FROM (SELECT id, text, m, trim(coalesce(dong, '') || CASE WHEN san <> '' THEN ' 산 ' ELSE ' ' END || main || CASE WHEN sub <> '' THEN '-' || sub ELSE '' END) AS label, dong, san
  FROM (SELECT id, text, unnest(regexp_extract_all(text, pat, 0)) AS m, unnest(regexp_extract_all(text, pat, 1)) AS dong, unnest(regexp_extract_all(text, pat, 2)) AS san, unnest(regexp_extract_all(text, pat, 3)) AS main, unnest(regexp_extract_all(text, pat, 4)) AS sub
   FROM (SELECT id, address || ' 일원 및 역삼동 ' || CAST(id % 900 + 1 AS STRING) || '-' || CAST(id % 7 AS STRING) || ', 용적률 200' AS text, '(?:([가-힣]{1,12}(?:동|리|가))\s*)?(산\s*)?(\d{1,4})(?:\s*[-－]\s*(\d{1,4}))?' AS pat FROM fx_parcels) a) b) c
WHERE dong <> '' OR san <> '' GROUP BY id, label"""))
def lot_mentions(i: Inputs):
    text = i.view("fx_parcels").selectExpr("id", "address || ' 일원 및 역삼동 ' || string(id % 900 + 1) || '-' || string(id % 7) || ', 용적률 200' AS text")
    return legal_text.lot_mentions(text).select("id", "label", "start")


USE_WORDS = [(u, u) for u in [fv.GENERIC_USE, *fv.USE_MATRIX]] + fv.USE_KEYWORDS


@query("extract_requests", sql("fx_requests", r"""
SELECT conv_id, turn, ok AS resolved, CASE WHEN ok THEN CASE WHEN lon IS NULL THEN addr ELSE '' END END AS req_address, CASE WHEN ok THEN coalesce(use, '시설물') END AS req_use, CASE WHEN ok THEN use IS NULL END AS inferred,
  CASE WHEN ok THEN CASE WHEN contains(text, '지하주차') THEN 'underground' WHEN contains(text, '기계식주차') THEN 'mechanical' WHEN contains(text, '지상주차') THEN 'surface' WHEN contains(text, '혼합주차') THEN 'mixed' ELSE 'unspecified' END END AS parking_strategy,
  CASE WHEN ok THEN CAST(nullif(regexp_extract(text, '용적률\s*(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE) END AS far_target_pct, CASE WHEN ok THEN lon END AS lon
FROM (SELECT *, (lon IS NOT NULL OR addr <> '') AND (use IS NOT NULL OR (intent AND (obj = '' OR obj IN ('건물', '건축물', '시설물', '여기', '거기', '이곳', '그곳', '무엇', '무얼', '개발', '허가', '이곳에')))) AS ok FROM (
  SELECT r.*, CAST(nullif(regexp_extract(text, '경도\s*(-?\d+(?:\.\d+)?)[^\d-]+위도\s*(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS lon,
   trim(regexp_extract(text, '((?:[가-힣0-9]+(?:특별시|광역시|특별자치시|특별자치도|도|시|군|구|읍|면|동|리)\s+)+(?:산\s*)?\d+(?:-\d+)?)', 1)) AS addr,
   (SELECT w.use FROM words w WHERE contains(r.text, w.kw) ORDER BY w.n LIMIT 1) AS use,
   regexp_matches(regexp_replace(lower(text), '[^0-9a-z가-힣%]', '', 'g'), '건물|건축|신축|시설|주택|집|개발|허가|지을|짓|지어|세울|세워|올릴|올려|들어갈')
    AND regexp_matches(regexp_replace(lower(text), '[^0-9a-z가-힣%]', '', 'g'), '""" + fv.FEASIBLE_WORDING + r"""') AS intent,
   regexp_replace(regexp_extract(text, '([가-힣A-Za-z0-9]{2,12})\s*(?:을|를)?\s*(?:지을|지어|짓|설치|세우|세울|올릴|올려|들일|들여)', 1), '(에다|에서|에|으로|로|다)$', '') AS obj FROM fx_requests r) a) b""",
    values([(n, k, u) for n, (k, u) in enumerate(USE_WORDS)], "words", "n, kw, use")))
def extract_requests(i: Inputs):
    return legal_text.extract_requests(i.view("fx_requests")).select(
        "conv_id", "turn", "resolved", "req_address", "req_use", "inferred", "parking_strategy", "far_target_pct", "lon")


@query("parse_jibun", sql("fx_parcels", r"""
SELECT id, regexp_extract(trim(jibun), '([가-힣]+)\s*$', 1) AS jimok_code, regexp_matches(address, '(?:읍|면|동|리)\s+(?:산\s*)?\d+(?:-\d+)?(?:\D|$)') AS is_parcel_address FROM fx_parcels"""))
def parse_jibun(i: Inputs):
    return legal_text.parse_jibun(i.view("fx_parcels")).select("id", "jimok_code", "is_parcel_address")


# appendix tables derived from the customers: one small table per document, both layouts
GRID_ROWS = [
    (0, "대상 건축물", "건축선으로부터 띄어야 하는 거리", "인접대지경계선으로부터 띄어야 하는 거리"),
    (1, "공장 (500㎡ 이상)", "", ""), (2, "준공업지역", "1.5미터", "#미터"), (3, "준공업지역 외의 지역", "3미터 이상", "1.5미터"),
    (4, "창고 1,000제곱미터 미만 / 1,000제곱미터 이상", "#미터 3미터", "1미터 2미터"), (5, "판매시설 상업지역", "3m", "-"),
    (6, "전용주거지역 건축물(공동주택은 제외)", "-", "1미터"), (7, "기타 설명", "", ""), (8, "공동주택", "20미터", "3미터"),
]
GRID_SINGLE = [(0, "용도", "규모", "띄어야 하는 거리"), (1, "공장", "500㎡ 이상", "•준공업지역 : 1.5m •준공업지역 외 : #m"),
               (2, "숙박시설", "", "3미터"), (3, "", "1,000㎡ 이상", "• 상업지역 4 m • 그 밖 13미터")]


def grid_cells_table(i: Inputs, rows):
    flat = i.rows([(r[0], n, t) for r in rows for n, t in enumerate(r[1:])], "row int, col int, t string")
    docs = i.view("customer").select(F.col("c_custkey").alias("org"), (F.col("c_custkey") % 4 + 1).cast("string").alias("d"))
    return docs.join(flat, F.lit(True)).select("org", "row", "col", F.replace("t", F.lit("#"), F.col("d")).alias("text"))


_OUT = "전용공업지역|일반공업지역|준공업지역"


@query("grid_rules", sql("", f"""
SELECT c_custkey AS org, r.* REPLACE (CASE WHEN front_m IS NULL THEN c_custkey % 4 + 1 ELSE front_m END AS front_m, CASE WHEN adjacent_m IS NULL THEN c_custkey % 4 + 1 ELSE adjacent_m END AS adjacent_m)
FROM customer CROSS JOIN expected r""", values([
    (2, 0, "공장", 500, None, "준공업지역", None, None, 1.5, None), (3, 0, "공장", 500, None, None, None, _OUT, 3.0, 1.5),
    (4, 0, "창고시설", 1000, 1000, None, None, None, None, 1.0), (4, 1, "창고시설", 1000, None, None, None, None, 3.0, 2.0),
    (5, 0, "판매시설", None, None, None, "상업지역", None, 3.0, 0.0), (6, 0, "단독주택", None, None, None, "전용주거지역", None, 0.0, 1.0)],
    "expected", "row, pair, use, min_gross, max_gross_excl, zone, zone_contains, not_zone_in, front_m, adjacent_m")))
def grid_rules(i: Inputs):
    return legal_text.grid_rules(grid_cells_table(i, GRID_ROWS))


@query("grid_rules_single", sql("", """
SELECT c_custkey AS org, r.* REPLACE (coalesce(front_m, c_custkey % 4 + 1) AS front_m, coalesce(adjacent_m, c_custkey % 4 + 1) AS adjacent_m) FROM customer CROSS JOIN expected r""", values([
    (1, 0, "공장", 500, None, "준공업지역", None, None, 1.5, 1.5), (1, 1, "공장", 500, None, None, None, _OUT, None, None),
    (2, 0, "숙박시설", None, None, None, None, None, 3.0, 3.0), (3, 0, "숙박시설", 1000, None, None, "상업지역", None, 4.0, 4.0)],
    "expected", "row, pair, use, min_gross, max_gross_excl, zone, zone_contains, not_zone_in, front_m, adjacent_m")))
def grid_rules_single(i: Inputs):
    return legal_text.grid_rules_single(grid_cells_table(i, GRID_SINGLE))


# --- payloads -----------------------------------------------------------------------------------


@query("parse_designations", sql("fx_designations", """
SELECT id, seq, status, code, name, relation_code, relation, updated_at, active, length(code) = 6 AND substr(code, 1, 3) IN ('UQA', 'UQB', 'UQC', 'UQD') AS is_zoning FROM (
  SELECT DISTINCT id, seq, 'AVAILABLE' AS status, code, name, CASE WHEN seq = 5 THEN relation_code ELSE '' END AS relation_code, CASE WHEN seq = 5 THEN '' ELSE relation END AS relation, max(updated_at) OVER (PARTITION BY id, seq, code, name) AS updated_at,
   CASE WHEN seq = 5 THEN relation_code IN ('1', '2') ELSE relation IN ('포함', '저촉') END AS active FROM fx_designations WHERE seq NOT IN (6, 7)
  UNION ALL SELECT DISTINCT id, seq, 'UNAVAILABLE', '', '', '', '', NULL, false FROM fx_designations WHERE seq IN (6, 7)) t"""))
def parse_designations(i: Inputs):
    return payloads.parse_designations(i.view("fx_designation_payloads"))


@query("parse_ownership", sql("fx_owner_payloads", """
SELECT id, seq, owner_name, CASE WHEN owner_name IN ('국유지', '군유지') THEN '국공유' WHEN owner_name IN ('개인', '법인', '기타 단체') THEN '사유' END AS ownership FROM (
 SELECT id, seq, CASE WHEN seq % 3 = 0 THEN owner WHEN seq % 3 = 1 AND owner <> '불명' THEN owner END AS owner_name FROM fx_owner_payloads) t"""))
def parse_ownership(i: Inputs):
    return payloads.parse_ownership(i.view("fx_owner_payloads")).select("id", "seq", "owner_name", "ownership")


@query("parse_register", sql("fx_buildings", """
SELECT id, seq, name, CASE WHEN seq = 2 THEN 'CLEAR' ELSE 'FOUND' END AS status, CAST(CASE WHEN seq = 1 THEN 7 WHEN seq = 2 THEN 0 ELSE 2 END AS INTEGER) AS count FROM fx_buildings"""))
def parse_register(i: Inputs):
    return payloads.parse_register(i.view("fx_register_payloads").drop("total_area_m2"))[1].select("id", "seq", "name", "status", "count")


@query("register_buildings", sql("fx_buildings", """
SELECT id, seq, building, floor_area FROM (SELECT id, seq, name AS building, floor(total_area_m2) AS floor_area FROM fx_buildings WHERE seq = 1 UNION ALL
 SELECT id, seq, name, 10 FROM fx_buildings WHERE seq > 2 UNION ALL SELECT id, seq, 'd' || CAST(seq AS STRING), 5 FROM fx_buildings WHERE seq > 2) t"""))
def register_buildings(i: Inputs):
    return payloads.parse_register(i.view("fx_register_payloads"))[0].select("id", "seq", "building", "floor_area")

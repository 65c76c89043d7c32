"""Ordinance and law text: articles, limits in text, chunks, extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import geometry as geo
from .rules import contains_any, first_match


def clean_markup(text: Column) -> Column:
    no_cdata = F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(no_cdata, "<[^>]+>", " "), r"\s+", " "))


def tag(xml: Column, name: str) -> Column:
    """Trimmed content of the first element ``name``, CDATA unwrapped; empty when absent."""
    return F.trim(F.regexp_extract(xml, rf"(?s)<{name}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1))


def extract_articles(docs: DataFrame, key: str = "doc_no") -> DataFrame:
    """(key, pos, title, body) of every article, markup cleaned."""
    pair = r"(?s)<조제목>(.*?)</조제목>.*?<조내용>(.*?)</조내용>"
    titles, bodies = (F.regexp_extract_all("xml", F.lit(pair), F.lit(n)) for n in (1, 2))
    rows = docs.select(key, F.posexplode(F.arrays_zip(titles.alias("t"), bodies.alias("b"))).alias("pos", "a"))
    return rows.select(key, "pos", clean_markup(F.col("a.t")).alias("title"), clean_markup(F.col("a.b")).alias("body"))


def extract_appendices(docs: DataFrame, key: str = "doc_no") -> DataFrame:
    rows = docs.select(key, F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<별표내용>(.*?)</별표내용>"), 1)).alias("pos", "t"))
    return rows.select(key, "pos", clean_markup(F.col("t")).alias("body"))


def latest_ordinance(docs: DataFrame) -> DataFrame:
    """Newest planning ordinance of each organisation, by effective date then document."""
    kept = docs.filter((F.col("kind") == "조례") & reduce(lambda a, b: a | b, [F.col("name").endswith(s) for s in fv.ORDINANCE_SUFFIXES]))
    return kept.groupBy("org").agg(F.max(F.struct("effective_date", "doc_no"))["doc_no"].alias("doc_no"))


def zone_value_pattern(zone: str, capture: bool = False) -> str:
    digits = r"(\d{1,4})" if capture else r"\d{1,4}"
    return zone + r"\s*(?::|은|는)?\s*" + digits + r"\s*(?:퍼센트|%)"


def base_article(articles: DataFrame, kind: str, key: str = "doc_no") -> DataFrame:
    """The article holding the base table of coverage (bcr) or floor-area (far) limits.

    It cites the delegating clause or carries the inline title; most zone values wins,
    the first of equals; no zone value at all → none.
    """
    inline, clause = (fv.BCR_INLINE, fv.BCR_CLAUSE) if kind == "bcr" else (fv.FAR_INLINE, fv.FAR_CLAUSE)
    paren = F.regexp_extract("title", r"\(([^)]*)\)", 1)
    core = F.when(F.col("title").rlike(r"\([^)]*\)"), paren).otherwise(F.col("title"))
    squash = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    head = squash(F.concat(core, F.lit(" "), F.regexp_extract("body", fv.ARTICLE_HEADING, 0)))
    base = F.contains(head, F.lit(inline)) | F.contains(squash(F.col("body")), F.lit(clause))
    score = sum((F.col("body").rlike(zone_value_pattern(z)).cast("int") for z in fv.STANDARD_ZONES), F.lit(0))
    scored = articles.filter(base).select(key, F.struct(score.alias("score"), (-F.col("pos")).alias("neg"), "body").alias("s"))
    return (scored.groupBy(key).agg(F.max("s").alias("s")).filter(F.col("s.score") > 0)
            .select(key, (-F.col("s.neg")).alias("pos"), F.col("s.score").alias("score"), F.col("s.body").alias("body")))


def zone_values(articles: DataFrame, key: str = "doc_no") -> DataFrame:
    """First percentage after each zone name in the base article."""
    found = F.array(*[F.struct(F.lit(z).alias("zone"), F.regexp_extract("body", zone_value_pattern(z, True), 1).alias("v"))
                      for z in fv.STANDARD_ZONES])
    return (articles.select(key, F.inline(F.filter(found, lambda x: x["v"] != "")))
            .select(key, "zone", F.col("v").cast("int").alias("value")))


def validate_limits(bcr: DataFrame, far: DataFrame, statutory: DataFrame, key: str = "doc_no") -> DataFrame:
    """Extracted limits checked against the statutory caps, with confidence per document.

    A value above the cap is dropped and forces a review; zones left without any value
    do not count.  One row per document and kept zone.
    """
    both = (bcr.select(key, "zone", F.col("value").alias("bcr")).join(far.select(key, "zone", F.col("value").alias("far")), [key, "zone"], "full")
            .join(statutory.select("zone", "bcr_max", "far_max"), "zone", "left"))
    over_b, over_f = (F.coalesce(F.col(v) > F.col(m), F.lit(False)) for v, m in (("bcr", "bcr_max"), ("far", "far_max")))
    checked = both.select(key, "zone", F.when(~over_b, F.col("bcr")).alias("bcr"), F.when(~over_f, F.col("far")).alias("far"),
                          (over_b.cast("int") + over_f.cast("int")).alias("flags"))
    filled = F.col("bcr").isNotNull() | F.col("far").isNotNull()
    doc = checked.groupBy(key).agg(F.sum("flags").alias("flags"), F.sum(filled.cast("int")).alias("zones_filled"))
    conf = F.when(F.col("zones_filled") >= 15, "high").when(F.col("zones_filled") >= 5, "medium").otherwise("low")
    doc = doc.withColumn("confidence", conf).withColumn("review_status", F.when(
        (F.col("flags") > 0) | (F.col("confidence") == "low"), "needs_review").otherwise("auto_extracted"))
    return checked.filter(filled).drop("flags").join(doc, key)


def setback_passages(articles: DataFrame, key: str = "doc_no") -> DataFrame:
    """Articles speaking of open space or setbacks, whole text, with their number and title."""
    hit = articles.filter(F.col("body").rlike(fv.SETBACK_PASSAGE))
    source = F.when(F.col("title") != "", F.col("title")).otherwise(F.regexp_extract("body", fv.ARTICLE_HEADING, 0))
    return hit.select(key, "pos", F.nullif(F.regexp_extract("body", r"제\d+조(?:의\d+)?", 0), F.lit("")).alias("article"),
                      F.when(source.rlike(r"\([^)]*\)"), F.regexp_extract(source, r"\(([^)]*)\)", 1)).otherwise("대지 안의 공지").alias("title"),
                      F.col("body").alias("text"))


def _parts(text: Column, size: int) -> Column:
    """Whole text as consecutive pieces of at most ``size`` characters."""
    return F.transform(F.sequence(F.lit(0), ((F.length(text) - 1) / size).cast("int")),
                       lambda i: F.substring(text, i * size + 1, F.lit(size)))


def build_chunks(docs: DataFrame, key: str = "doc_no", size: int = fv.CHUNK_CHARS) -> DataFrame:
    """Search chunks of ordinance documents: articles and appendices that concern building.

    Long texts continue in further parts instead of being cut; the identifier hashes
    organisation, article and text.
    """
    meta = docs.select(key, F.col("org").alias("jurisdiction"), F.col("name").alias("ordinance"), "effective_date")
    art = extract_articles(docs, key)
    core = F.when(F.col("title") != "", F.col("title")).otherwise(F.regexp_extract("body", fv.ARTICLE_HEADING, 0))
    art = art.filter(F.concat_ws(" ", core, F.col("body")).rlike(fv.CHUNK_KEYWORDS)).select(
        key, "pos", F.nullif(F.regexp_extract("body", r"제\d+조(?:의\d+)?", 0), F.lit("")).alias("article"),
        F.when(core.rlike(r"\([^)]*\)"), F.regexp_extract(core, r"\(([^)]*)\)", 1)).otherwise(core).alias("title"),
        "body", F.lit("도시계획조례").alias("kind"))
    app = extract_appendices(docs, key).filter((F.length("body") >= 20) & F.col("body").rlike(fv.CHUNK_KEYWORDS)).select(
        key, "pos", F.lit("별표").alias("article"), F.lit("별표").alias("title"), "body", F.lit("도시계획조례-별표").alias("kind"))
    rows = art.unionByName(app).join(meta, key)
    rows = rows.select("*", F.posexplode(_parts(F.col("body"), size)).alias("part", "text")).drop("body")
    return rows.withColumn("chunk_id", F.concat(F.lit("ord-"), F.substring(F.sha2(F.concat_ws(
        "|", "jurisdiction", F.coalesce("article", F.lit("")), F.col("part").cast("string"), "text"), 256), 1, 20)))


def law_chunks(laws: DataFrame, key: str = "doc_no") -> DataFrame:
    """Chunks of national law units (law, article, title, text) concerning land and building."""
    kept = laws.filter((F.col("text") != "") & F.concat_ws(" ", "title", "text").rlike(fv.LAW_KEYWORDS))
    return kept.select(key, F.concat(F.lit("law-"), F.substring(F.sha2(F.concat_ws("|", "law", "article", "text"), 256), 1, 20)).alias("chunk_id"),
                       F.lit(fv.NATIONAL).alias("jurisdiction"), "law", "article", "title", "text", F.lit("법령-조문").alias("kind"))


# --- other extractions -----------------------------------------------------------------------


def law_names(df: DataFrame, bases: str = "bases") -> DataFrame:
    """Distinct law names of a row's basis texts in order, "같은 법 시행령" spelled out."""
    def of(basis):
        same = F.regexp_extract_all(basis, F.lit(r"같은\s+법\s+(시행령|시행규칙)"), 1)
        rest = F.regexp_replace(basis, fv.SAME_LAW, "")
        tidy = lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"\s+", " "), "^[ ·,]+|[ ·,]+$", ""))
        names = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(fv.LAW_NAME), 1), tidy), lambda n: n != "")
        stem = F.regexp_replace(F.get(names, F.lit(0)), r"\s+(시행령|시행규칙)$", "")
        return F.concat(names, F.when(F.size(names) > 0, F.transform(same, lambda s: F.concat(stem, F.lit(" "), s)))
                        .otherwise(F.array().cast("array<string>")))
    return df.withColumn("laws", F.array_distinct(F.flatten(F.transform(bases, of))))


def verify_laws(names: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """Law names matched to a catalogue: exact title first, else the first title containing it.

    ``names`` holds arrays ``laws``; ``catalog`` (pos, title, effective_date).  Containment is
    an equi-join of the distinct names with the substrings of the titles.
    """
    flat = names.select(key, F.posexplode("laws").alias("n", "law"))
    wanted = flat.select("law").distinct()
    lens = F.sequence(F.lit(2), F.greatest(F.length("title"), F.lit(2)))
    subs = F.array_distinct(F.flatten(F.transform(lens, lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("title") - n + 1, F.lit(1))), lambda at: F.substring(F.col("title"), at, n)))))
    hit = (catalog.withColumn("law", F.explode(subs)).join(wanted, "law")
           .groupBy("law").agg(F.min(F.struct((F.col("title") != F.col("law")).alias("inexact"), "pos", "title", "effective_date")).alias("b")))
    j = flat.join(hit, "law", "left")
    g = j.groupBy(key).agg(F.count("b").alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("b").isNotNull(), F.struct("n", F.col("b.title").alias("t"))))), lambda s: s["t"]), ",").alias("titles"))
    out = names.select(key, F.size("laws").alias("n_laws")).join(g, key, "left")
    status = F.when(F.col("n_laws") == 0, "NO_BASIS").when(F.col("sources") > 0, "VERIFIED").otherwise("UNAVAILABLE")
    return out.select(key, status.alias("status"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("titles", F.lit("")).alias("titles"))


def lot_mentions(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Lot numbers named with a village or a mountain mark, distinct labels with offsets."""
    pat = F.lit(fv.LOT_MENTION)
    groups = F.arrays_zip(*[F.regexp_extract_all(F.col(text), pat, F.lit(n)).alias(a) for n, a in enumerate(["m", "dong", "san", "main", "sub"])])
    # offsets: walk the matches, each searched from the end of the one before
    walk = F.aggregate(
        groups, F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,dong:string,san:string,main:string,sub:string,m:string>>").alias("out")),
        lambda acc, g: F.struct(
            (F.call_function("locate", g["m"], F.col(text), acc["at"]) + F.length(g["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (F.call_function("locate", g["m"], F.col(text), acc["at"]) - 1).alias("start"), g["dong"].alias("dong"), g["san"].alias("san"),
                g["main"].alias("main"), g["sub"].alias("sub"), g["m"].alias("m")))).alias("out")),
        lambda acc: acc["out"])
    rows = df.select(key, F.explode(walk).alias("g")).filter((F.col("g.dong") != "") | (F.col("g.san") != ""))
    label = F.trim(F.concat(F.col("g.dong"), F.when(F.col("g.san") != "", " 산 ").otherwise(" "), F.col("g.main"),
                            F.when(F.col("g.sub") != "", F.concat(F.lit("-"), F.col("g.sub"))).otherwise("")))
    return (rows.select(key, label.alias("label"), F.col("g.start").alias("start"), (F.col("g.start") + F.length("g.m")).alias("end"))
            .groupBy(key, "label").agg(F.min(F.struct("start", "end")).alias("p")).select(key, "label", "p.start", "p.end"))


def parse_jibun(df: DataFrame) -> DataFrame:
    """Land-category code at the end of a lot label; whether an address is a lot address."""
    return df.withColumns({"jimok_code": F.regexp_extract(F.trim("jibun"), r"([가-힣]+)\s*$", 1),
                           "is_parcel_address": F.col("address").rlike(fv.PARCEL_ADDRESS_TEST)})


def extract_requests(df: DataFrame, text: str = "text") -> DataFrame:
    """Address or coordinates, use, parking and target ratio of a request, by rules only.

    ``resolved`` is false where the wording needs interpretation: no place, no use and no
    building intent, or a special facility named as the thing to build.
    """
    q = F.col(text)
    lon, lat = (F.nullif(F.regexp_extract(q, fv.COORDINATES, n), F.lit("")).cast("double") for n in (1, 2))
    addr = F.trim(F.regexp_extract(q, fv.PARCEL_ADDRESS, 1))
    use = F.coalesce(first_match(q, [(u, u) for u in [fv.GENERIC_USE, *fv.USE_MATRIX]]), first_match(q, fv.USE_KEYWORDS))
    plain = F.regexp_replace(F.lower(q), "[^0-9a-z가-힣%]", "")
    intent = (contains_any(plain, fv.FEASIBLE_SUBJECTS) | plain.rlike(fv.FEASIBLE_ACTION)) & plain.rlike(fv.FEASIBLE_WORDING)
    obj = F.regexp_replace(F.regexp_extract(q, fv.SPECIAL_OBJECT, 1), "(에다|에서|에|으로|로|다)$", "")
    special = (obj != "") & ~obj.isin(*fv.GENERIC_OBJECTS, *fv.USE_MATRIX, fv.GENERIC_USE)
    df = df.withColumns({"lon": lon, "lat": lat, "_addr": addr, "_use": use, "_intent": intent, "_special": special})
    has_place = F.col("lon").isNotNull() | (F.col("_addr") != "")
    ok = has_place & (F.col("_use").isNotNull() | (F.col("_intent") & ~F.col("_special")))
    far = F.nullif(F.regexp_extract(q, r"용적률\s*(\d+(?:\.\d+)?)\s*%", 1), F.lit("")).cast("double")
    return df.withColumn("resolved", ok).withColumns({
        "req_address": F.when(F.col("resolved"), F.when(F.col("lon").isNotNull(), "").otherwise(F.col("_addr"))),
        "req_use": F.when(F.col("resolved"), F.coalesce("_use", F.lit(fv.GENERIC_USE))),
        "inferred": F.when(F.col("resolved"), F.col("_use").isNull()),
        "parking_strategy": F.when(F.col("resolved"), first_match(q, fv.PARKING_WORDS, "unspecified")),
        "far_target_pct": F.when(F.col("resolved"), far),
        "lon": F.when(F.col("resolved"), F.col("lon")), "lat": F.when(F.col("resolved"), F.col("lat"))}).drop("_addr", "_use", "_intent", "_special")


def merge_evidence(direct: DataFrame, hits: DataFrame, key: str = "id") -> DataFrame:
    """Direct rule references first, then search hits; one row per (law, article) in first position."""
    cols = [key, "pos", "law", "article", "source"]
    rows = (direct.select(key, "pos", "law", "article", F.lit("direct").alias("source"))
            .unionByName(hits.select(key, "pos", "law", "article", F.lit("search").alias("source")))).select(*cols)
    rows = rows.withColumns({"law": F.trim(F.coalesce("law", F.lit(""))), "article": F.trim(F.coalesce("article", F.lit("")))}).filter("law <> ''")
    return (rows.groupBy(key, "law", "article").agg(F.min(F.struct((F.col("source") != "direct").alias("later"), "pos", "source")).alias("b"))
            .select(key, "law", "article", "b.source", "b.pos"))


# --- appendix grids ---------------------------------------------------------------------------


def _use_of(text: Column) -> Column:
    excluded = text.rlike(r"공동주택[을은]?\s*제외")
    plain = first_match(text, fv.GRID_USES)
    without = first_match(F.replace(text, F.lit("공동주택"), F.lit("")), fv.GRID_USES)
    single = F.contains(text, F.lit("전용주거지역")) | F.contains(text, F.lit("단독주택"))
    return F.when(excluded & single, "단독주택").when(excluded, without).otherwise(plain)


def _number(col: Column) -> Column:
    return F.nullif(F.replace(col, F.lit(","), F.lit("")), F.lit("")).cast("int")


def _by_table(cells: DataFrame) -> DataFrame:
    """Cells of one table together, in as many parts as any shuffle has.

    All that follows groups by table, so nothing moves again and no scan task sorts its cells first.
    Cells repeat much and shrink when written, so parts are not merged by their written size.
    """
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "org")


def grid_rules(cells: DataFrame) -> DataFrame:
    """Setback rules from appendix tables laid out as target | front | adjacent.

    ``cells`` (org, row, col, text).  Use, size and zone carry down from the rows above
    within a table; several distances in a cell pair up; distances over 12 m are errors.
    """
    from pyspark.sql import Window
    rows = _by_table(cells).groupBy("org", "row").agg(*[F.max(F.when(F.col("col") == n, F.col("text"))).alias(f"c{n}") for n in range(3)])
    rows = rows.filter(F.col("c2").isNotNull() & ~((F.contains("c1", F.lit("건축선")) & F.contains("c1", F.lit("거리"))) | F.contains("c2", F.lit("인접대지경계선"))))

    def dists(c):
        found = F.transform(F.regexp_extract_all(F.col(c), F.lit(fv.GRID_DISTANCE), 1), lambda d: d.cast("double"))
        dash = F.trim(F.col(c)).isin("-", "－", "ㅡ")
        return F.when(F.size(found) > 0, found).when(dash, F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))

    text = F.col("c0")
    gross = F.when(F.contains(text, F.lit("이상")), _number(F.regexp_extract(text, fv.GRID_GROSS, 1)))
    outside = F.contains(text, F.lit("준공업지역 외")) | F.contains(text, F.lit("준공업지역외"))
    zone = (F.when(F.contains(text, F.lit("준공업지역")) & ~F.contains(text, F.lit("외")), "준공업지역").when(outside, "outside")
            .when(F.contains(text, F.lit("상업지역")), "상업지역"))
    rows = rows.withColumns({"use": _use_of(text), "gross": gross, "zone": zone, "front": dists("c1"), "adj": dists("c2")})
    # a table is one appendix, so the carry-down window stays small
    w = Window.partitionBy("org").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ctx_use", F.last("use", ignorenulls=True).over(w))
    rows = rows.withColumn("block", F.sum(F.col("use").isNotNull().cast("int")).over(w))
    b = Window.partitionBy("org", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    has = (F.size("front") > 0) | (F.size("adj") > 0)
    rows = rows.withColumns({"ctx_gross": F.last("gross", ignorenulls=True).over(b),
                             "ctx_zone": F.last(F.when(~has & F.col("use").isNull(), F.col("zone")), ignorenulls=True).over(b)})
    rows = rows.filter(has & F.col("ctx_use").isNotNull())
    n = F.greatest(F.size("front"), F.size("adj"), F.lit(1))
    at = lambda c: F.when(F.size(c) == 0, 0.0).otherwise(F.coalesce(F.get(c, F.col("i")), F.element_at(c, -1)))
    vals = F.regexp_extract_all(text, F.lit(fv.GRID_SUB_GROSS), 1)
    kinds = F.regexp_extract_all(text, F.lit(fv.GRID_SUB_GROSS), 2)
    rows = rows.withColumns({"n": n, "vals": vals, "kinds": kinds}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    paired = (F.size("vals") == F.col("n")) & (F.col("n") > 1)
    value, kind = _number(F.get("vals", F.col("i"))), F.get("kinds", F.col("i"))
    z = F.coalesce("zone", "ctx_zone")
    out = rows.select(
        "org", "row", F.col("i").alias("pair"), F.col("ctx_use").alias("use"),
        F.when(paired & (kind == "이상"), value).otherwise(F.col("ctx_gross")).alias("min_gross"),
        F.when(paired & (kind == "미만"), value).alias("max_gross_excl"),
        F.when(z == "준공업지역", "준공업지역").alias("zone"),
        F.when((F.col("ctx_use") == "단독주택") & F.contains(text, F.lit("전용주거지역")), "전용주거지역").when(z == "상업지역", "상업지역").alias("zone_contains"),
        F.when(z == "outside", "전용공업지역|일반공업지역|준공업지역").alias("not_zone_in"),
        at("front").alias("front_m"), at("adj").alias("adjacent_m"))
    return out.filter((F.col("front_m") <= fv.MAX_GRID_DISTANCE_M) & (F.col("adjacent_m") <= fv.MAX_GRID_DISTANCE_M))


def grid_rules_single(cells: DataFrame) -> DataFrame:
    """Setback rules from tables with one distance column whose cell lists labelled distances."""
    from pyspark.sql import Window
    marked = _by_table(cells).withColumns({"is_dist": F.col("text").rlike(fv.GRID_DISTANCE), "use": _use_of(F.col("text")),
                                "gross": F.when(F.contains("text", F.lit("이상")), _number(F.regexp_extract("text", fv.GRID_GROSS, 1)))})
    dist_col = F.min(F.when(F.col("is_dist"), F.struct("col", "text")))
    rows = marked.groupBy("org", "row").agg(
        dist_col["text"].alias("dist"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]), " ").alias("joined"),
        F.min(F.when(~F.col("is_dist") & F.col("use").isNotNull(), F.struct("col", "use")))["use"].alias("use"),
        F.max(F.when(~F.col("is_dist") & F.col("gross").isNotNull(), F.struct("col", "gross")))["gross"].alias("gross"))
    header = (F.contains("joined", F.lit("띄어야")) & F.contains("joined", F.lit("거리")) & F.contains("joined", F.lit("용도"))) | F.contains("joined", F.lit("대상 건축물"))
    rows = rows.filter(~header)
    w = Window.partitionBy("org").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"ctx_use": F.last("use", ignorenulls=True).over(w), "block": F.sum(F.col("use").isNotNull().cast("int")).over(w)})
    b = Window.partitionBy("org", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ctx_gross", F.last("gross", ignorenulls=True).over(b)).filter("dist IS NOT NULL AND ctx_use IS NOT NULL")
    bullets = F.split("dist", r"[•·▪◦･]|(?:^|\s)-\s+")
    units = F.split("dist", r"(?<=미터)\s+(?=[가-힣(])|(?<=[mM])\s+(?=[가-힣(])")
    parts = F.filter(F.when(F.size(bullets) > 1, bullets).otherwise(units), lambda p: p.rlike(fv.GRID_DISTANCE))
    one = rows.select("org", "row", F.col("ctx_use").alias("use"), "ctx_gross", F.posexplode(parts).alias("pair", "part"))
    label = F.regexp_replace(F.regexp_extract("part", r"^(.*?)" + fv.GRID_DISTANCE, 1), "^[ :：·▪-]+|[ :：·▪-]+$", "")
    one = one.withColumns({"label": label, "d": F.regexp_extract("part", fv.GRID_DISTANCE, 1).cast("double")})
    outside = F.contains("label", F.lit("준공업지역 외")) | F.contains("label", F.lit("준공업지역외"))
    return one.filter(F.col("d") <= fv.MAX_GRID_DISTANCE_M).select(
        "org", "row", "pair", "use", F.col("ctx_gross").alias("min_gross"), F.lit(None).cast("int").alias("max_gross_excl"),
        F.when(F.contains("label", F.lit("준공업지역")) & ~F.contains("label", F.lit("외")), "준공업지역").alias("zone"),
        F.when(F.contains("label", F.lit("상업지역")), "상업지역").alias("zone_contains"),
        F.when(outside, "전용공업지역|일반공업지역|준공업지역").alias("not_zone_in"),
        F.col("d").alias("front_m"), F.col("d").alias("adjacent_m"))

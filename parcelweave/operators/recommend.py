"""Candidate parcels per region request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..plans.stages import stage
from . import rules


def region_terms(region: Column) -> Column:
    """Tokens of a region that an address must contain (city, county, district, village)."""
    tokens = F.transform(F.split(F.trim(region), r"\s+"), lambda t: F.regexp_replace(t, "[^가-힣0-9]", ""))
    return F.filter(tokens, lambda t: (F.length(t) > 1) & t.rlike("(시|군|구|읍|면|동|리)$"))


def region_core(region: Column) -> Column:
    """Name of the last city, county or district without its suffix, else the last token."""
    tokens = F.split(F.trim(region), r"\s+")
    named = F.filter(tokens, lambda t: (F.length(t) > 1) & t.rlike("(시|군|구)$"))
    last = F.get(F.slice(named, -1, 1), F.lit(0))
    return F.coalesce(F.regexp_replace(last, ".$", ""), F.element_at(tokens, -1))


def address_keys(df: DataFrame, address: str = "address") -> DataFrame:
    """One row per distinct word of the address, the equi-join key of the region filter."""
    words = F.array_distinct(F.split(F.trim(F.col(address)), r"\s+"))
    return df.withColumn("word", F.explode(words))


def region_filter(parcels: DataFrame, regions: DataFrame, key: str = "pnu") -> DataFrame:
    """(request, parcel) pairs whose address contains all tokens of the requested region.

    The join runs on the last token, found in the address words by equality or as the
    start of a word; the remaining tokens are checked on the joined rows.
    """
    req = regions.withColumn("terms", region_terms(F.col("region")))
    req = req.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.array(region_core(F.col("region")))))
    req = req.withColumn("anchor", F.element_at("terms", -1))
    # addresses repeat their region words, so the words are matched once per distinct word
    words = address_keys(parcels.select(key, "address"))
    lens = F.sequence(F.lit(1), F.length("word"))
    # "contains" per word: every substring of a distinct word, joined by equality
    subs = F.array_distinct(F.flatten(F.transform(lens, lambda n: F.transform(
        F.sequence(F.lit(1), F.length("word") - n + 1), lambda at: F.substring(F.col("word"), at, n)))))
    anchors = (words.select("word").distinct().withColumn("anchor", F.explode(subs))
               .join(req.select("anchor").distinct(), "anchor"))
    hit = words.join(anchors, "word").select(key, "anchor").distinct()
    full = hit.join(parcels, key).join(req, "anchor")
    return full.filter(F.forall("terms", lambda t: F.contains(F.col("address"), t))).drop("anchor", "terms")


def target_jimok(use: Column, query: Column) -> Column:
    """Land categories a request looks for: forest words beat farm words, else buildable."""
    blob = F.concat_ws(" ", F.coalesce(use, F.lit("")), F.coalesce(query, F.lit("")))
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (F.when(rules.contains_any(blob, fv.FOREST_HINTS), arr(fv.FOREST_TARGET_JIMOK))
            .when(rules.contains_any(blob, fv.FARM_HINTS), arr(fv.FARM_TARGET_JIMOK)).otherwise(arr(fv.GENERAL_TARGET_JIMOK)))


def candidates(parcels: DataFrame, scanned: DataFrame, regions: DataFrame, key: str = "pnu") -> DataFrame:
    """All candidates of each request.

    ``scanned`` (key, px, py, zone) are the parcels in non-urban zones.  Rows at the same
    rounded point count once; facilities that farmland rules forbid are left out.
    """
    base = parcels.join(scanned, key)
    hits = region_filter(base, regions, key)
    wanted = hits.filter(F.array_contains(target_jimok(F.col("building_use"), F.col("query")), F.col("jimok")))
    w = Window.partitionBy("request_id", F.round("px", 4), F.round("py", 4)).orderBy(key)
    once = wanted.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    fit = rules.facility_verdict(rules.classify_jimok(once.withColumn("facility", F.col("building_use"))))
    return fit.filter(F.coalesce("facility_verdict", F.lit("")) != "not_allowed")


def recommend(pool: DataFrame, conversion: DataFrame, buildings: DataFrame, k: int, key: str = "pnu") -> DataFrame:
    """The ``k`` largest candidates per request that can be built on, and why others cannot.

    ``conversion`` (key, conversion_status): a missing status excludes the candidate;
    ``buildings`` (key, has_buildings): checked only for built-up land, missing passes.
    """
    j = pool.join(conversion, key, "left").join(
        buildings.select(key, "has_buildings"), key, "left")
    j = rules.min_lot(j)
    occupied = F.col("jimok").isin(*fv.BUILT_UP_JIMOK) & F.coalesce("has_buildings", F.lit(False))
    reason = (F.when(F.col("conversion_status").isNull(), "conversion_unchecked")
              .when(F.col("conversion_status") == "RESTRICTED_REVIEW", "conversion_restricted")
              .when(F.col("below_min_lot"), "below_minimum_lot").when(occupied, "existing_building"))
    j = j.withColumn("excluded", reason)
    # accepted ones alone are ranked, so only k rows of each task travel
    w = Window.partitionBy("request_id").orderBy(F.desc("area_m2"), key)
    best = j.filter("excluded IS NULL").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.unionByName(j.filter("excluded IS NOT NULL").withColumn("rank", F.lit(None).cast("int")))


def recommend_with_broadening(regions: DataFrame, search) -> DataFrame:
    """Drop the last region token until a candidate is accepted; all levels run as one job.

    ``search`` maps (request_id, region, building_use, query) rows to accepted candidates.
    The most specific level with any wins.
    """
    parts = F.split(F.trim(F.col("region")), r"\s+")
    levels = regions.select("request_id", "building_use", "query", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, 1, n), " ").alias("region")))).alias("l"))
    flat = levels.select(F.concat_ws("#", F.col("request_id").cast("string"), F.col("l.level").cast("string")).alias("request_id"),
                         "building_use", "query", "l.region")
    found = stage(search(flat), "broadening")
    split = found.withColumns({"level": F.element_at(F.split("request_id", "#"), 2).cast("int"),
                               "request_id": F.element_at(F.split("request_id", "#"), 1).cast("bigint")})
    best = split.groupBy("request_id").agg(F.max("level").alias("level"))
    return split.join(best, ["request_id", "level"])

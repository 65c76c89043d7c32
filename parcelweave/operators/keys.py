"""Keys, latest-version lookups and limit resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import geometry as geo


def split_pnu(df: DataFrame, pnu: str = "pnu") -> DataFrame:
    """Register key parts of a 19-digit parcel number; other lengths are invalid (null)."""
    d = F.regexp_replace(F.col(pnu), "[^0-9]", "")
    ok = F.length(d) == 19
    part = lambda at, n: F.when(ok, F.substring(d, at, n))
    return df.withColumns({
        "valid": F.coalesce(ok, F.lit(False)), "sigungu": part(1, 5), "bjdong": part(6, 5),
        "plat_gb": F.when(ok, F.when(F.substring(d, 11, 1) == "2", "1").otherwise("0")),
        "bun": part(12, 4), "ji": part(16, 4)})


def latest_price(history: DataFrame, key: str = "id") -> DataFrame:
    """Most recent positive price per key by (year, month, notice date).

    A partial ``max`` per task, so a key with very many rows costs nothing extra.
    """
    best = F.max(F.struct("std_year", "std_month", F.coalesce("notice_date", F.lit("")).alias("notice_date"), "price_won_m2"))
    return (history.filter(F.col("price_won_m2").isNotNull() & (F.col("price_won_m2") != 0))
            .groupBy(key).agg(best.alias("b"))
            .select(key, F.col("b.price_won_m2").alias("price_won_m2"), F.col("b.std_year").alias("price_year"),
                    F.col("b.notice_date").alias("price_date")))


def latest_ledger(history: DataFrame, key: str = "id") -> DataFrame:
    best = F.max(F.struct("std_year", F.coalesce("updated", F.lit("")).alias("updated"), "ledger_area"))
    return (history.filter(F.col("ledger_area").isNotNull() & (F.col("ledger_area") != 0))
            .groupBy(key).agg(best.alias("b")).select(key, F.col("b.ledger_area").alias("ledger_area")))


def resolve_area(parcels: DataFrame, ledger: DataFrame, key: str = "id") -> DataFrame:
    """Ledger area where positive, else the drawn area, with its source named."""
    use = F.col("ledger_area") > 0
    return (parcels.join(latest_ledger(ledger, key), key, "left")
            .withColumn("area_m2", geo.bround(F.when(use, F.col("ledger_area")).otherwise(F.col("geom_area")), 1))
            .withColumn("area_source", F.when(use, "ledger").otherwise("geometry")).drop("ledger_area"))


def merge_reviewed(verified: DataFrame, auto: DataFrame) -> DataFrame:
    """Verified jurisdictions replace the automatic ones as a whole.

    Automatic rows survive only when marked ``auto_extracted``.
    """
    trusted = auto.filter(F.col("review_status") == "auto_extracted")
    extra = trusted.join(verified.select("jurisdiction").distinct(), "jurisdiction", "left_anti")
    cols = ["jurisdiction", "zone", "bcr_max", "far_max"]
    return (verified.select(*cols, F.lit("verified").alias("source"))
            .unionByName(extra.select(*cols, F.lit("auto").alias("source"))))


def is_zoning_code(code: Column) -> Column:
    return (F.length(code) == 6) & F.substring(code, 1, 3).isin(*fv.ZONING_CODE_PREFIXES)


def is_active(relation_code: Column, relation: Column) -> Column:
    return F.coalesce(relation_code.isin("1", "2"), F.lit(False)) | F.coalesce(relation.isin("포함", "저촉"), F.lit(False))


def districts(designations: DataFrame, zone_districts: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Distinct district names per parcel: layer districts first, then active designations.

    ``zone_districts``, if any, holds (key, name, pos).  Zoning codes and merely adjacent
    designations are left out.  The result has one row per (key, name) with its order.
    """
    active = (designations.filter(is_active(F.col("relation_code"), F.col("relation")) & ~is_zoning_code(F.col("code")))
              .select(key, "name", F.struct(F.lit(1).alias("src"), F.col("seq").cast("bigint").alias("pos")).alias("ord")))
    if zone_districts is not None:
        active = zone_districts.select(key, "name", F.struct(F.lit(0).alias("src"), F.col("pos").cast("bigint").alias("pos")).alias("ord")).unionByName(active)
    # by the key alone, so lists made of the names of a key need no further shuffle
    return active.repartition(key).groupBy(key, "name").agg(F.min("ord").alias("ord"))


def existing_buildings(parcels: DataFrame, buildings: DataFrame, address_index: DataFrame, key: str = "id") -> DataFrame:
    """Building count per parcel; parcels with none are retried by their address's lot.

    ``address_index`` maps an address to the parcel number the register uses.  The
    retry touches only the misses and only replaces the answer when it finds buildings.
    """
    rk = ["sigungu", "bjdong", "plat_gb", "bun", "ji"]
    per_lot = buildings.groupBy(*rk).agg(F.count(F.lit(1)).alias("n"), F.sum("total_area_m2").alias("floor_area"))
    keyed = split_pnu(parcels.select(key, "pnu", "address"))
    first = keyed.join(per_lot, rk, "left").select(key, "pnu", "address", "valid", "n", "floor_area")
    hits = first.filter(F.col("n").isNotNull())
    misses = first.filter(F.col("n").isNull()).select(key, "pnu", "address", "valid")
    retry = split_pnu(misses.join(address_index, "address", "left").drop("valid"), "register_pnu")
    second = retry.join(per_lot, rk, "left").select(key, "n", "floor_area")
    both = (hits.select(key, "n", "floor_area", F.lit("pnu").alias("via"))
            .unionByName(second.withColumn("via", F.when(F.col("n").isNotNull(), "address").otherwise("none"))))
    return both.select(key, F.coalesce("n", F.lit(0)).alias("buildings"),
                       F.coalesce("floor_area", F.lit(0.0)).alias("floor_area_m2"), "via",
                       (F.coalesce("n", F.lit(0)) > 0).alias("has_buildings"))


def build_aliases(jurisdictions: DataFrame) -> DataFrame:
    """Address aliases of each jurisdiction name.

    The full name always; its last word and the word's stem only when no other
    jurisdiction ends with the same word, and the stem only from two characters on.
    """
    names = (jurisdictions.select("jurisdiction").distinct()
             .withColumn("last", F.element_at(F.split(F.trim("jurisdiction"), r"\s+"), -1)))
    counts = names.groupBy("last").agg(F.count(F.lit(1)).alias("n"))
    stem = F.regexp_replace("last", "(특별자치시|특별자치도|광역시|특별시|시|군|구)$", "")
    rows = names.join(counts, "last").select("jurisdiction", F.filter(F.array(
        F.struct(F.regexp_replace("jurisdiction", r"\s+", "").alias("alias"), F.lit("full").alias("kind")),
        F.struct(F.when(F.col("n") == 1, F.col("last")).alias("alias"), F.lit("last").alias("kind")),
        F.struct(F.when((F.col("n") == 1) & (F.length(stem) >= 2), stem).alias("alias"), F.lit("stem").alias("kind")),
    ), lambda a: a["alias"].isNotNull()).alias("a"))
    return rows.select("jurisdiction", F.inline("a"))


def detect_jurisdiction(df: DataFrame, aliases: DataFrame, separate: DataFrame, key: str = "id") -> DataFrame:
    """Jurisdiction of each address: manual aliases first, then generated, longest first.

    ``aliases`` holds (alias, jurisdiction, priority) with priority 0 = manual.  The
    "alias occurs in address" test becomes an equi-join: each distinct name part of an
    address (lot number dropped) is expanded into its substrings of the alias lengths,
    so nothing is compared all against all.  ``separate`` lists (jurisdiction, district)
    with an ordinance of their own; addresses naming one are flagged.
    """
    text = df.select(key, F.regexp_replace("address", r"\s+", "").alias("_t"))
    # the trailing lot number repeats for no other parcel; names repeat for many
    named = text.withColumn("_n", F.regexp_replace("_t", r"(산)?[0-9-]+$", ""))
    distinct = named.select("_n").distinct()
    n = F.length("_n")
    ali = aliases.select(F.regexp_replace("alias", r"\s+", "").alias("alias"), "jurisdiction", "priority").filter("alias <> ''")
    lengths = [r[0] for r in ali.select(F.length("alias")).distinct().collect()]  # as many as aliases have lengths
    subs = F.array_distinct(F.flatten(F.transform(
        F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda k: k <= n),
        lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substring(F.col("_n"), at, k)))))
    hit = (distinct.withColumn("alias", F.explode(subs)).join(ali, "alias")
           .groupBy("_n").agg(F.min(F.struct("priority", (-F.length("alias")).alias("neg"), "jurisdiction")).alias("b"))
           .select("_n", F.col("b.jurisdiction").alias("jurisdiction")))
    sep = separate.groupBy("jurisdiction").agg(F.collect_set("district").alias("own"))
    return (named.join(hit, "_n", "left").join(sep, "jurisdiction", "left")
            .select(key, "jurisdiction",
                    F.coalesce(F.exists("own", lambda d: F.contains(F.col("_t"), d)), F.lit(False)).alias("separate_ordinance")))


def resolve_limits(df: DataFrame, statutory: DataFrame, ordinance: DataFrame) -> DataFrame:
    """Coverage and floor-area limits for (zone, jurisdiction) rows.

    A regulated ordinance entry (either limit set) wins, its nulls fall back to the
    statutory value; non-urban zones never use the statutory value alone; unknown
    zones are not found.
    """
    known = ordinance.select("jurisdiction").distinct().withColumn("collected", F.lit(True))
    st = statutory.select("zone", F.col("bcr_max").alias("s_bcr"), F.col("far_max").alias("s_far"), F.col("far_min").alias("s_min"))
    od = ordinance.select("jurisdiction", "zone", F.col("bcr_max").alias("o_bcr"), F.col("far_max").alias("o_far"),
                          F.col("far_min").alias("o_min"))
    j = (df.join(st, "zone", "left").join(od, ["jurisdiction", "zone"], "left").join(known, "jurisdiction", "left"))
    listed = F.col("s_bcr").isNotNull()
    regulated = F.col("o_bcr").isNotNull() | F.col("o_far").isNotNull()
    rural = F.col("zone").isin(*fv.NON_URBAN_ZONES)
    found = F.coalesce(listed & (regulated | ~rural), F.lit(False))
    pick = lambda o, s: F.when(found, F.when(regulated, F.coalesce(o, s)).otherwise(F.col(s)))
    return (j.withColumns({
        "found": found,
        "requires_ordinance": F.coalesce(listed & ~regulated & rural, F.lit(False)),
        "bcr_max_pct": pick("o_bcr", "s_bcr"), "far_max_pct": pick("o_far", "s_far"), "far_min_pct": pick("o_min", "s_min"),
        "limit_source": F.when(found & regulated, "ordinance").when(found, "statutory")})
        .drop("s_bcr", "s_far", "s_min", "o_bcr", "o_far", "o_min", "collected"))

"""The full diagnosis: one row per parcel, every branch a subplan joined on the parcel key."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import envelope, grid, keys, measures, roads, rules, spatial, verdict
from .stages import stage


@dataclass
class Tables:
    """Inputs of a diagnosis.  ``parcels`` carry id, pnu, address, jimok, building_use,
    geom_area and shape columns; ``registry`` is the layer configuration."""

    parcels: DataFrame
    zones: DataFrame
    layer: DataFrame
    registry: list[tuple]
    prices: DataFrame
    ledger: DataFrame
    designations: DataFrame
    buildings: DataFrame
    address_index: DataFrame
    aliases: DataFrame
    separate: DataFrame
    statutory: DataFrame
    ordinance: DataFrame
    setback_rules: DataFrame
    planned_roads: DataFrame


def staged(t: Tables) -> Tables:
    """Tables with the parcel geometry computed once and stored, since every branch reads it.

    The limit and rule tables are stored too: their true size is known then, so small ones do not make parcels move.
    """
    return replace(t, parcels=stage(t.parcels, "parcels"), **{n: stage(getattr(t, n), n) for n in (
        "statutory", "ordinance", "setback_rules", "aliases")})


#: keys the branches: every one is joined on it, so what is partitioned by it once stays where it is
KEY = "id"


def _named_points(t: Tables) -> DataFrame:
    """Zone at the interior point of each parcel, and the district names there with their order."""
    points = spatial.interior_point(t.parcels).select(KEY, "px", "py")
    hits = (spatial.points_in(points, t.zones.select("feature_id", "zone_name", "layer_no", "rings", "edges", "walls",
                                                     "minx", "miny", "maxx", "maxy"), spatial.LAYER_CELL))
    is_zone = F.col("zone_name").endswith("지역")
    named = hits.select(KEY, "zone_name", "layer_no", "feature_id").repartition(KEY).groupBy(KEY, F.col("zone_name").alias("name"), is_zone.alias("is_zone")).agg(
        F.min("layer_no").alias("pos"), F.min(F.struct("layer_no", "feature_id")).alias("at"))
    ordered = F.struct(F.struct(F.lit(0).alias("src"), F.col("pos").cast("bigint").alias("pos")).alias("ord"), "name")
    return named.groupBy(KEY).agg(F.min(F.when(F.col("is_zone"), F.struct("at", "name")))["name"].alias("point_zone"),
                                  F.collect_list(F.when(~F.col("is_zone"), ordered)).alias("point_districts"))


def situation(t: Tables) -> DataFrame:
    """Who, where and what: area, price, zone, limits, districts, buildings and shape of each parcel."""
    par = t.parcels
    base = keys.resolve_area(par.select(KEY, "pnu", "address", "jimok", "building_use", "facility", "far_target_pct",
                                        "parking_strategy", "geom_area", "rings"), t.ledger)
    base = base.join(keys.latest_price(t.prices), KEY, "left")
    base = base.join(keys.detect_jurisdiction(par.select(KEY, "address"), t.aliases, t.separate), KEY, "left")

    # one row for each zone piece of a parcel, at least one, until the limits of the pieces are weighted
    shares = spatial.zone_shares(par, t.zones, KEY)
    pieces = spatial.rescale_shares(shares, base, KEY, how="right")
    pieces = keys.resolve_limits(pieces, t.statutory, t.ordinance)
    top = F.min(F.when(F.col("zone").isNotNull(), F.struct((-F.col("area_m2")).alias("a"), "zone")))["zone"].alias("share_zone")
    same = [F.first(c).alias(c if c != "ledger" else "parcel_m2") for c in (*(c for c in base.columns if c not in (KEY, "area_m2")), "ledger")]
    out = measures.weighted_limits(pieces, KEY, (top, *same)).withColumnRenamed("parcel_m2", "area_m2")

    # the designations of a parcel come after the districts at its point; of one name the first stays
    active = keys.districts(t.designations).groupBy(KEY).agg(F.collect_list(F.struct("ord", "name")).alias("active"))
    built = keys.existing_buildings(par.select(KEY, "pnu", "address"), t.buildings, t.address_index).select(KEY, "has_buildings")
    out = out.join(_named_points(t), KEY, "left").join(active, KEY, "left").join(built, KEY, "left")
    none = F.array().cast(active.schema["active"].dataType)
    names = F.array_sort(F.concat(F.coalesce(F.col("point_districts").cast(active.schema["active"].dataType), none), F.coalesce("active", none)))
    out = out.withColumns({"zone": F.coalesce("share_zone", "point_zone"), "districts": F.array_distinct(F.transform(names, lambda s: s["name"])),
                           "has_buildings": F.coalesce("has_buildings", F.lit(False))}).drop("share_zone", "point_zone", "point_districts", "active")
    out = keys.resolve_limits(out, t.statutory, t.ordinance)
    return out.withColumns({"bcr_max_pct": F.coalesce("weighted_bcr_pct", "bcr_max_pct"),
                            "far_max_pct": F.coalesce("weighted_far_pct", "far_max_pct")})


def judged(t: Tables) -> DataFrame:
    """Situation plus conversion, road, screening and the final verdict."""
    par = t.parcels
    s = rules.min_lot(rules.facility_verdict(rules.classify_jimok(situation(t))))
    s = s.withColumn("facility_text", F.when(F.coalesce("facility", F.lit("")) != "", F.col("facility")).otherwise(F.col("building_use")))
    s = rules.constraints(s).withColumn("n_constraints", F.size("constraints"))
    s = rules.use_verdict(s, rules.use_matrix(par.sparkSession))
    s = s.withColumn("placement_restricted", F.col("below_min_lot") | F.col("has_buildings"))

    adj = spatial.adjacency(roads.with_road_width(par), KEY, keep=("width_m",))
    access = roads.road_access(par, adj, parcel_id=KEY, edges=True)
    access = roads.planned_roads(access, par, t.planned_roads, t.designations, KEY)

    # statuses and findings of the overlaps in one pass, over the cells that the zones have moved
    s = spatial.wide_layer_summary(s, spatial.overlay(par, t.layer, KEY), t.registry, KEY, verdict.screen_overlaps())
    s = s.join(access, KEY, "left")
    s = verdict.assess_conversion(s.withColumn("terrain_status", F.lit(None).cast("string")))
    s = verdict.regulatory_screen(s)
    s = s.withColumns({"no_building_model": F.lit(False), "road_unknowns": F.lit("건축법상 도로 지정 여부")})
    return verdict.final_verdict(s)


def diagnose(t: Tables) -> DataFrame:
    """Verdict, size, charges and number of permit steps of every parcel."""
    t = staged(t)
    steps = verdict.permit_steps(judged(t))
    buildable = F.coalesce(F.col("verdict").isin("allowed", "conditional") & (F.coalesce("bcr_max_pct", F.lit(0.0)) > 0), F.lit(False))
    j = stage(steps.select(
        "pnu", "jurisdiction", "address", "zone", "category", "requires_conversion", "area_m2", "verdict", "display_verdict", "presentation_label",
        "bcr_max_pct", "far_max_pct", "weighting", "conversion_status", "road_status", "screen_status", "conflict_status", "building_use",
        "far_target_pct", "parking_strategy", "price_won_m2", "agriculture_status", "forest_code", F.size("steps").alias("permit_step_count"),
        buildable.alias("buildable"), *[F.when(buildable, F.col(c)).alias(c) for c in ("road_len", "rings")]), "judged")

    # what may be built is worked out beside the other columns, so nothing is joined on again
    done = ["adjusted_area_m2", "achievable_gfa_m2", "final_floors", "final_height_m", "layout_feasible", "setback_status", "spaces"]
    rest = [c for c in j.columns if c not in ("rings", "road_len")]
    sized = measures.parking(measures.massing(j.filter("buildable")))
    sized = rules.setbacks(sized.withColumn("gross", F.col("gross_floor_area_m2")), t.setback_rules)
    built = envelope.constrained_massing(grid.with_shape(sized)).select(*rest, *done)
    out = built.unionByName(j.filter("NOT buildable").select(*rest, *[F.lit(None).cast(built.schema[c].dataType).alias(c) for c in done]))
    out = measures.conversion_charge(out.withColumn("conversion_area_m2", F.col("adjusted_area_m2")))
    shown = F.col("display_verdict").isin("allowed", "conditional") & F.col("buildable")
    out = measures.development_charge(out.withColumn("_rc", F.col("requires_conversion"))
                                      .withColumn("requires_conversion", F.col("requires_conversion") & shown))
    return out.select(
        "pnu", "jurisdiction", "zone", "category", "area_m2", "verdict", "display_verdict", "presentation_label", "bcr_max_pct",
        "far_max_pct", "weighting", "conversion_status", "road_status", "screen_status", "conflict_status", "setback_status",
        "adjusted_area_m2", "achievable_gfa_m2", "final_floors", "final_height_m", "layout_feasible", "spaces", "charge_type",
        "charge_won", "dev_applicable", "permit_step_count")

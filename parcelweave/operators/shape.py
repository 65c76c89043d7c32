"""Shape measures and checks of single geometries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import geometry as geo
from .envelope import main_ring, north_edges
from .repair import self_crossing

METRES_PER_DEGREE = 111320.0


def shape_metrics(df: DataFrame, lonlat: bool = False) -> DataFrame:
    """Width, depth, vertex mean, perimeter, longest edge and the view bearing (edge + 90°).

    The ring with most vertices is measured.  With ``lonlat`` widths use the cosine of
    the middle latitude; otherwise coordinates are metres.
    """
    ring = "array_max(transform(rings, r -> named_struct('n', size(r), 'r', r))).r"
    df = df.withColumn("_ring", F.expr(ring))
    xs, ys = (f"transform(_ring, p -> p.{c})" for c in "xy")
    n = "size(_ring)"
    pairs = geo._pairs("_ring")
    scale = lambda e: f"cos(radians(({e}.y1 + {e}.y2) / 2))" if lonlat else "1D"
    longest = (f"array_max({geo.each(pairs, lambda e: geo.let(lambda dx, dy: f'''named_struct('sq', {dx} * {dx} + {dy} * {dy}, 'east', {dx}, 'north', {dy})''', dx=f'({e}.x2 - {e}.x1) * {scale(e)}', dy=f'{e}.y2 - {e}.y1'))})")
    unit = METRES_PER_DEGREE if lonlat else 1.0
    mid = f"cos(radians((array_min({ys}) + array_max({ys})) / 2))" if lonlat else "1D"
    df = df.withColumn("_l", F.expr(longest))
    bearing = F.pmod(F.degrees(F.atan2(F.col("_l.east"), F.col("_l.north"))) + 90, F.lit(360.0))
    return df.withColumns({
        "width_m": F.expr(f"(array_max({xs}) - array_min({xs})) * {unit}D * {mid}"),
        "depth_m": F.expr(f"(array_max({ys}) - array_min({ys})) * {unit}D"),
        "mean_x": F.expr(f"{geo.total(xs)} / {n}"), "mean_y": F.expr(f"{geo.total(ys)} / {n}"),
        "perimeter_m": F.expr(geo.total(geo.each(pairs, lambda e: f"hypot({e}.x2 - {e}.x1, {e}.y2 - {e}.y1)")) + f" * {unit}D"),
        "longest_edge_m": F.sqrt("_l.sq") * unit, "bearing_deg": geo.bround(bearing, 1)}).drop("_ring", "_l")


def north_boundary(df: DataFrame, key: str = "pnu") -> DataFrame:
    """Edges facing north of the largest part's outer ring, one row each."""
    facing = north_edges(geo._pairs(main_ring("rings")))
    return df.select(key, F.explode(F.expr(facing)).alias("e")).select(key, "e.x1", "e.y1", "e.x2", "e.y2")


def validate_geometry(df: DataFrame, key: str = "feature_id") -> DataFrame:
    """Per geometry: bad rings by reason, repeated vertices removed, the largest part kept.

    A ring is bad with under three distinct vertices, when its edges cross, without area, or when it
    touches itself at a vertex.
    """
    rings = F.posexplode_outer("rings")
    r = df.select(key, rings.alias("part", "ring"))
    r = r.withColumn("clean", F.expr(
        "transform(filter(zip_with(ring, concat(slice(ring, -1, 1), slice(ring, 1, greatest(size(ring) - 1, 0))), (p, q) -> "
        "named_struct('p', p, 'new', p.x <> q.x OR p.y <> q.y)), s -> s.new), s -> s.p)"))
    distinct = F.size(F.array_distinct("clean"))
    area = F.expr(geo.ring_area_abs("clean"))
    r = r.withColumns({"area": area, "removed": F.size("ring") - F.size("clean")})
    r = r.withColumn("crossed", F.coalesce(self_crossing("array(clean)"), F.lit(False)))
    reason = (F.when(F.col("ring").isNull() | (distinct < 3), "too_few_vertices").when(F.col("crossed"), "self_crossing").when(F.col("area") == 0, "zero_area")
              .when(distinct < F.size("clean"), "self_touching"))
    r = r.withColumn("reason", reason)
    return r.groupBy(key).agg(
        F.count("part").alias("parts"), F.count("reason").alias("bad_parts"),
        F.coalesce(F.min("reason"), F.lit("ok")).alias("reason"), F.sum(F.coalesce("removed", F.lit(0))).alias("removed_vertices"),
        F.max(F.when(F.col("reason").isNull() | (F.col("reason") == "self_touching"), F.struct("area", "part")))["part"].alias("largest_part"),
        F.max("area").alias("largest_area"))


def normalize_layer(df: DataFrame, layer_id: str) -> DataFrame:
    """Code and name of raw features from their ``properties`` map."""
    lowered = F.transform_keys("properties", lambda k, v: F.lower(k))
    pick = lambda fields: F.coalesce(*[F.nullif(F.element_at("_p", f), F.lit("")) for f in fields], F.lit(""))
    if layer_id == "forest_class":
        df = df.withColumn("_p", lowered)
        raw = pick(fv.FOREST_CODE_FIELDS)
        ufm = F.regexp_extract(F.upper(raw), r"UFM\d{3}", 0)
        df = df.withColumn("code", F.when(ufm != "", ufm).otherwise(raw))
        names = F.create_map(*[F.lit(x) for kv in fv.FOREST_CLASS_NAMES.items() for x in kv])
        return df.withColumn("name", F.coalesce(F.element_at(names, F.col("code")), pick(fv.FOREST_NAME_FIELDS))).drop("_p")
    value = lambda f: F.nullif(F.trim(F.element_at("properties", f)), F.lit(""))
    if layer_id == "ecological_nature":
        grade = value("생태자연도")
        return df.withColumns({"name": F.when(grade.isNotNull(), F.concat(F.lit("생태·자연도 "), grade, F.lit("등급"))).otherwise("생태·자연도"),
                               "code": F.coalesce(grade, F.lit(""))})
    label = F.concat_ws(" / ", *[F.when(value(f).isNotNull(), F.concat(F.lit(f"{f}: "), value(f))) for f in fv.SPECIAL_ECOLOGY_FIELDS])
    return df.withColumns({"name": F.when(label != "", label).otherwise("별도관리지역"), "code": F.lit("SPECIAL")})


def layer_catalog(features: DataFrame, registry: DataFrame) -> DataFrame:
    """Feature counts and extents per registered layer; registered but empty layers show zero."""
    g = features.groupBy("layer_id").agg(F.count(F.lit(1)).alias("feature_count"), F.countDistinct("code").alias("codes"),
                                         F.min("minx").alias("minx"), F.max("maxx").alias("maxx"))
    return (registry.join(g, "layer_id", "left")
            .select("layer_id", "title", "provider", (F.col("ready") & F.col("available")).alias("usable"),
                    F.coalesce("feature_count", F.lit(0)).alias("feature_count"), F.coalesce("codes", F.lit(0)).alias("codes"), "minx", "maxx"))

"""Spatial joins: containment, overlay, adjacency and nearest partner."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import contacts
from ..functions import fixed_values as fv
from ..functions import geometry as geo
from . import grid

CELL = 160.0
LAYER_CELL = 320.0


def interior_point(df: DataFrame) -> DataFrame:
    """A point inside each polygon: middle of the widest span on the mid-height line."""
    y = "((miny + maxy) / 2)"
    xs = geo.each(geo.keep("edges", lambda e: f"least({e}.y1, {e}.y2) <= {y} AND {y} < greatest({e}.y1, {e}.y2)"),
                  lambda e: f"{e}.x1 + ({y} - {e}.y1) * ({e}.x2 - {e}.x1) / ({e}.y2 - {e}.y1)")
    spans = geo.let(lambda v: geo.each(
        f"filter(sequence(1, greatest(size({v}) - 1, 1)), k -> k % 2 = 1)",
        lambda i: f"named_struct('w', get({v}, {i}) - get({v}, {i} - 1), 'x', (get({v}, {i}) + get({v}, {i} - 1)) / 2)"),
        v=f"array_sort({xs})")
    return df.withColumns({"px": F.expr(f"array_max({spans}).x"), "py": F.expr(y)})


def points_in(points: DataFrame, polygons: DataFrame, size: float = CELL) -> DataFrame:
    """All (point, polygon) containments; a point meets only the pieces in its own cell."""
    pieces = grid.cut_to_cells(polygons, size).drop("rings", "edges", "minx", "miny", "maxx", "maxy")
    pts = points.drop("rings", "edges", "walls", "minx", "miny", "maxx", "maxy")
    joined = grid.point_cell(pts, size).join(pieces, ["cx", "cy"])
    return joined.filter(F.expr(geo.contains("walls", "px", "py"))).drop("cx", "cy", "walls")


def locate(points: DataFrame, parcels: DataFrame, point_id: str, parcel_id: str, reach: float = 15.0,
           size: float = CELL) -> DataFrame:
    """Parcel at each point; points in no parcel take the nearest within ``reach``.

    Ties (stacked parcels, equal distance) go to the lowest parcel id.  Points with
    neither are returned with a null parcel.
    """
    pts = points.select(point_id, "px", "py")
    par = parcels.select(parcel_id, "rings", "edges", "walls", "minx", "miny", "maxx", "maxy")
    inside = (points_in(pts, par, size).groupBy(point_id).agg(F.min(parcel_id).alias(parcel_id))
              .withColumns({"distance": F.lit(0.0), "matched": F.lit("contains")}))
    misses = pts.join(inside.select(point_id), point_id, "left_anti")
    boxed = misses.withColumns({"minx": F.col("px"), "maxx": F.col("px"), "miny": F.col("py"), "maxy": F.col("py")})
    near = (grid.cell_join(boxed, par.drop("rings", "walls"), size, pad=reach)
            .withColumn("distance", F.expr(geo.nearest_on("edges", "px", "py") + ".d"))
            .groupBy(point_id).agg(F.min(F.struct("distance", parcel_id)).alias("b"))
            .select(point_id, F.col(f"b.{parcel_id}").alias(parcel_id), F.col("b.distance").alias("distance"),
                    F.lit("nearest").alias("matched")))
    found = inside.unionByName(near)
    return pts.join(found, point_id, "left").withColumn("matched", F.coalesce("matched", F.lit("none")))


def zones_at(points: DataFrame, features: DataFrame, point_id: str, size: float = LAYER_CELL) -> DataFrame:
    """Names of all zoning features at each point, distinct, ordered by layer then feature.

    Splits zones (names ending in the zone suffix) from districts; a point in no zone
    has status UNKNOWN rather than an empty answer.
    """
    hits = (points_in(points, features, size)
            .groupBy(point_id, F.col("zone_name").alias("name"))
            .agg(F.min(F.struct("layer_no", "feature_id")).alias("pos")))
    is_zone = F.col("name").endswith("지역")
    ordered = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(cond, F.struct("pos", "name")))), lambda s: s["name"]), ",")
    # one entry per distinct name, so the list is bounded by the number of zone names
    lists = hits.groupBy(point_id).agg(ordered(is_zone).alias("zones"), ordered(~is_zone).alias("districts"))
    return (points.select(point_id).join(lists, point_id, "left")
            .select(point_id, F.coalesce("zones", F.lit("")).alias("zones"),
                    F.coalesce("districts", F.lit("")).alias("districts"))
            .withColumn("status", F.when(F.col("zones") == "", "UNKNOWN").otherwise("FOUND")))


def overlay_raw(parcels: DataFrame, layer: DataFrame, parcel_id: str = "pnu", keep: tuple[str, ...] = (),
                size: float = LAYER_CELL, salts: int = 1) -> DataFrame:
    """Unrounded intersection area per (parcel, feature); parcels need ``geom_area``."""
    pieces = _pieces(parcels, layer, parcel_id, keep, size, salts)
    return (pieces.groupBy(parcel_id, "geom_area", "feature_id", *keep).agg(F.sum("area").alias("area"))
            .filter(F.col("area") > 1e-6))


def _pieces(parcels: DataFrame, layer: DataFrame, parcel_id: str, keep: tuple[str, ...], size: float,
            salts: int = 1) -> DataFrame:
    """Overlap of each parcel with the part of each feature in each cell."""
    par = parcels.select(parcel_id, F.col("geom_area"), F.col("walls").alias("pw"), "minx", "miny", "maxx", "maxy")
    cut = grid.cut_to_cells(layer, size).select("feature_id", *keep, "walls", "cx", "cy",
                                                *[F.col(c).alias(f"r_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    left, keys = grid.with_cells(par, size), ["cx", "cy"]
    if salts > 1:
        left = left.withColumn("salt", F.pmod(F.xxhash64(parcel_id), F.lit(salts)))
        cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        keys.append("salt")
    meet = ((F.col("r_minx") < F.col("maxx")) & (F.col("r_maxx") > F.col("minx"))
            & (F.col("r_miny") < F.col("maxy")) & (F.col("r_maxy") > F.col("miny")))
    near = left.join(cut, keys).filter(meet)
    # as a generator: computed once, and pieces without area vanish before the shuffle
    sized = geo.keep(f"array(named_struct('area', {geo.overlap_area('pw', 'walls', 'miny')}))", lambda v: f"{v}.area > 1e-9D")
    return near.select("cx", "cy", parcel_id, "geom_area", "feature_id", *keep, "pw", "walls", F.expr(f"inline({sized})"))


def overlay(parcels: DataFrame, layer: DataFrame, parcel_id: str = "pnu",
            keep: tuple[str, ...] = ("layer_id", "name", "code"), size: float = LAYER_CELL) -> DataFrame:
    """Overlap area and share per (parcel, feature), one decimal, positive only.

    Areas are taken to the square millimetre first, so what lies half way between two
    decimals is rounded to even whatever the order of the sums before.
    """
    raw = overlay_raw(parcels, layer, parcel_id, keep, size).withColumn("area", geo.bround("area", 6))
    return raw.select(parcel_id, "feature_id", *keep, geo.bround(F.col("area"), 1).alias("area_m2"),
                      geo.bround(F.col("area") * 100 / F.col("geom_area"), 1).alias("share_pct"))


def inspect_layers(parcels: DataFrame, overlaps: DataFrame, registry: list[tuple], parcel_id: str = "pnu") -> DataFrame:
    """Status of every (parcel, registered layer): a missing layer is never CLEAR.

    ``registry`` is the layer configuration: (layer_id, title, provider, ready, available).
    """
    hit = (overlaps.groupBy(parcel_id, "layer_id")
           .agg(F.count(F.lit(1)).alias("n_overlaps"), F.max("area_m2").alias("max_area_m2")))
    layers = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("layer_id", "title", "provider", "ready", "available"))]) for r in registry]))
    grid_rows = parcels.select(parcel_id, layers.alias("l")).select(parcel_id, "l.*")
    status = (F.when(~F.col("ready"), "NOT_CONFIGURED").when(~F.col("available"), "UNAVAILABLE")
              .when(F.col("n_overlaps") > 0, "OVERLAP").otherwise("CLEAR"))
    usable = F.col("ready") & F.col("available")
    return (grid_rows.join(hit, [parcel_id, "layer_id"], "left")
            .select(parcel_id, "layer_id", "title", status.alias("status"),
                    F.when(usable, F.coalesce("n_overlaps", F.lit(0))).otherwise(0).alias("n_overlaps")))


def wide_layer_summary(parcels: DataFrame, overlaps: DataFrame, registry: list[tuple], parcel_id: str = "pnu",
                       also: tuple[Column, ...] = ()) -> DataFrame:
    """Parcels with the statuses after sliver removal and the leading overlaps.

    Same rules as :func:`inspect_layers` and :func:`compact_layers`, in one aggregate of
    the overlaps instead of one row per parcel and layer.  ``registry`` is the layer
    configuration: (layer_id, title, provider, ready, available).  ``also`` are further aggregates
    of the overlaps, taken in the same pass.
    """
    config = {r[0]: r for r in registry}

    def missing(layer):
        if layer not in config or not config[layer][3]:
            return "NOT_CONFIGURED"
        return None if config[layer][4] else "UNAVAILABLE"

    used = [layer for layer in config if missing(layer) is None]
    counts = is_effective() & F.col("layer_id").isin(*used)
    top = lambda layer: F.min(F.when(counts & (F.col("layer_id") == layer), F.struct((-F.col("area_m2")).alias("a"), "feature_id", "code", "name")))
    g = overlaps.groupBy(parcel_id).agg(*[top(layer).alias(f"top_{layer}") for layer in config], *also)
    j = parcels.join(g, parcel_id, "left")

    def status(layer):
        gap = missing(layer)
        if gap:
            return F.lit(gap)
        return F.when(F.col(f"top_{layer}").isNotNull(), "OVERLAP").otherwise("CLEAR")

    has = lambda layer: F.col(f"top_{layer}").isNotNull() if layer in config else F.lit(False)
    return j.withColumns({
        "agriculture_status": status("agricultural_promotion"), "forest_status": status("forest_class"),
        "forest_code": F.col("top_forest_class.code"), "forest_name": F.col("top_forest_class.name"),
        "has_inventory": has("forest_inventory"), "disaster_status": status("disaster_risk_zone"),
        "eco_status": status("ecological_nature"), "separate_status": status("ecological_separate_management"),
    }).drop(*[f"top_{layer}" for layer in config])


def is_effective() -> Column:
    """Whether an overlap counts: rounded share above zero and area unknown or above zero."""
    return (F.col("share_pct") > 0) & (F.col("area_m2").isNull() | (F.col("area_m2") > 0))


def effective(overlaps: DataFrame) -> DataFrame:
    return overlaps.filter(is_effective())


def compact_layers(status: DataFrame, overlaps: DataFrame, parcel_id: str = "pnu") -> DataFrame:
    """Status after sliver removal: OVERLAP with nothing left becomes CLEAR."""
    left = effective(overlaps).groupBy(parcel_id, "layer_id").agg(F.count(F.lit(1)).alias("kept"))
    return (status.join(left, [parcel_id, "layer_id"], "left")
            .withColumn("kept", F.coalesce("kept", F.lit(0)))
            .withColumn("status", F.when((F.col("status") == "OVERLAP") & (F.col("kept") == 0), "CLEAR")
                        .otherwise(F.col("status"))))


def zone_shares(parcels: DataFrame, zoning: DataFrame, parcel_id: str = "pnu", size: float = LAYER_CELL) -> DataFrame:
    """Area and share of each zone on each parcel; same-zone pieces are dissolved.

    Copies of a feature collapse before the join.  A zone touching a parcel with one
    feature needs no dissolve; the exact union is evaluated only where several
    different features of one zone meet on a parcel.  Features are cut at the cells, so
    unions are taken cell by cell, where the join left the pieces, and areas alone move.
    """
    zones = (zoning.filter(F.col("zone_name").endswith("지역"))
             .groupBy(F.xxhash64("rings").alias("_g"), "zone_name", "minx", "miny", "maxx", "maxy")
             .agg(F.min("feature_id").alias("feature_id"), F.first("walls").alias("walls")))
    pieces = _pieces(parcels, zones, parcel_id, ("zone_name",), size)
    group = pieces.groupBy("cx", "cy", parcel_id, "geom_area", "zone_name").agg(
        (F.min("feature_id") != F.max("feature_id")).alias("several"), F.sum("area").alias("area"),
        F.first("pw").alias("pw"), F.collect_list("walls").alias("pieces"))
    covered = F.expr(f"CASE WHEN several THEN {geo.union_area('pw', 'pieces')} ELSE area END")
    # by the parcel alone, so what is joined or summed up by parcel afterwards stays where it is
    area = (group.select(parcel_id, "geom_area", "zone_name", covered.alias("area")).repartition(parcel_id)
            .groupBy(parcel_id, "geom_area", "zone_name").agg(F.least(F.sum("area"), F.col("geom_area")).alias("area")))
    share = area.select(parcel_id, F.col("zone_name").alias("zone"), F.explode(F.array(F.struct(
        geo.bround("area", 1).alias("area_m2"),
        geo.bround(F.least(F.col("area") / F.col("geom_area") * 100, F.lit(100.0)), 1).alias("share_pct")))).alias("s"))
    return share.select(parcel_id, "zone", "s.area_m2", "s.share_pct").filter(F.col("share_pct") >= 1.0)


def rescale_shares(shares: DataFrame, parcels: DataFrame, parcel_id: str = "pnu", how: str = "left") -> DataFrame:
    """Piece areas scaled to the ledger area when it differs from the drawn area.

    With ``how="right"`` all parcels stay, with all their columns; their own area is then called ``ledger``.
    """
    right = how == "right"
    own = parcels if right else parcels.select(parcel_id, "area_m2", "geom_area")
    own = own.withColumnRenamed("area_m2", "ledger")
    both = own.join(shares, parcel_id, "left") if right else shares.join(own, parcel_id, "left")
    differs = (F.col("ledger") > 0) & (F.col("geom_area") > 0) & (F.abs(F.col("ledger") - F.col("geom_area")) > 0.05)
    return both.withColumn("area_m2", F.when(
        differs, geo.bround(F.col("area_m2") * (F.col("ledger") / F.col("geom_area")), 1)).otherwise(F.col("area_m2"))) \
        .drop(*(() if right else ("ledger", "geom_area")))


def adjacency(parcels: DataFrame, parcel_id: str = "pnu", tol: float = fv.CONTACT_TOLERANCE_M,
              size: float = CELL, keep: tuple[str, ...] = ()) -> DataFrame:
    """Neighbouring parcels within ``tol`` with the contact length and per-edge contacts.

    ``keep`` names further columns of the neighbour, which get the prefix ``n_``.
    """
    box, keep = ["minx", "miny", "maxx", "maxy"], ("jimok", *keep)
    cells = grid.with_cells(parcels.select(parcel_id, *keep, F.expr(geo.flat_edges("edges")).alias("flat"), *box), size, tol)
    # both sides hold the same columns of the same rows, so they are computed and shuffled once
    side = lambda mark: cells.select("cx", "cy", *[F.col(c).alias(f"{mark}_{c}") for c in (parcel_id, *keep, "flat", *box)])
    lo = lambda c: F.floor(F.greatest(F.col(f"l_min{c}") - tol, F.col(f"r_min{c}")) / size).cast("bigint")
    meet = [(F.col(f"r_min{c}") <= F.col(f"l_max{c}") + tol) & (F.col(f"r_max{c}") >= F.col(f"l_min{c}") - tol) for c in "xy"]
    pairs = (side("l").join(side("r"), ["cx", "cy"]).filter(F.col(f"l_{parcel_id}") != F.col(f"r_{parcel_id}"))
             .filter(meet[0] & meet[1] & (F.col("cx") == lo("x")) & (F.col("cy") == lo("y"))))
    held = [f"n_{c}" for c in keep]
    # the left side's columns stay too, else the two sides would not be the same
    pairs = pairs.select(F.col(f"l_{parcel_id}").alias(parcel_id), F.col(f"r_{parcel_id}").alias("n_id"),
                         *[F.col(f"r_{c}").alias(f"n_{c}") for c in keep], *[f"l_{c}" for c in keep], "l_flat", "r_flat")

    def touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_at, each, whole = _contacts(batch, "l_flat", "r_flat", tol)
            lists = pa.ListArray.from_arrays(pa.array(a_at, pa.int32()), pa.array(each))
            names = [parcel_id, "n_id", *held, "edge_contacts", "contact_raw"]
            out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-2]), lists, pa.array(whole)], names=names)
            yield out.filter(pa.array(whole > 0))

    schema = T.StructType([*pairs.select(parcel_id, "n_id", *held).schema, T.StructField("edge_contacts", T.ArrayType(T.DoubleType())),
                           T.StructField("contact_raw", T.DoubleType())])
    found = pairs.mapInArrow(touching, schema)
    return found.select(parcel_id, "n_id", *held, "edge_contacts", geo.bround("contact_raw", 1).alias("contact_length_m"))


def with_contact(pairs: DataFrame, a: str, b: str, tol: float) -> DataFrame:
    """Add ``contact_raw``: how much of the flat edges ``a`` lies within ``tol`` of ``b``."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _contacts(batch, a, b, tol)[2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.float64())], names=[*batch.schema.names, "contact_raw"])

    return pairs.mapInArrow(measured, T.StructType([*pairs.schema, T.StructField("contact_raw", T.DoubleType())]))


def _contacts(batch: pa.RecordBatch, a: str, b: str, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the edges of each pair begin, the contact length of each edge, and that of each pair."""
    (left, at), (right, right_at) = (_edge_lists(batch.column(n)) for n in (a, b))
    each = contacts.contact_lengths(left, at, right, right_at, tol)
    return at, each, np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(at)), each, batch.num_rows)


def _edge_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all rows as rows of four numbers, and where each row's begin."""
    return (column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4),
            np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64) // 4)


def region_scan(parcels: DataFrame, zoning: DataFrame, parcel_id: str = "pnu",
                zones: tuple[str, ...] = tuple(fv.CANDIDATE_ZONES), size: float = LAYER_CELL) -> DataFrame:
    """Parcels whose interior point lies in one of ``zones``, with that zone's name."""
    pts = interior_point(parcels).select(parcel_id, "px", "py")
    hits = points_in(pts, zoning.filter(F.col("zone_name").isin(*zones)), size)
    return (hits.groupBy(parcel_id, "px", "py")
            .agg(F.min(F.struct("feature_id", "zone_name")).alias("z"))
            .select(parcel_id, "px", "py", F.col("z.zone_name").alias("zone")))

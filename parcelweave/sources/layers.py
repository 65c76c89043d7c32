"""Reading, preparing and storing polygon layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import grid
from ..operators.repair import repair

_COORDS = "array<array<array<double>>>"


def rings_from_geojson(geometry: Column) -> Column:
    """Outer rings and holes of a GeoJSON Polygon or MultiPolygon string."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    as_points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    poly = F.from_json(coords, _COORDS)
    multi = F.from_json(coords, f"array<{_COORDS}>")
    parts = (F.when(kind == "Polygon", F.array(F.transform(poly, as_points)))
             .when(kind == "MultiPolygon", F.transform(multi, lambda p: F.transform(p, as_points)))
             .otherwise(F.array().cast("array<array<array<struct<x:double,y:double>>>>")))
    return _oriented(parts)


def _oriented(parts: Column) -> Column:
    """Parts (outer ring, then holes) as rings whose direction tells solid from hole."""
    def area(ring):
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        o = ring[0]
        twice = F.zip_with(ring, following, lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"]))
        return F.reduce(twice, F.lit(0.0), lambda a, v: a + v)

    solid = lambda r: F.when(area(r) >= 0, r).otherwise(F.reverse(r))
    hole = lambda r: F.when(area(r) <= 0, r).otherwise(F.reverse(r))
    full = F.transform(parts, lambda p: F.filter(p, lambda r: F.size(r) > 0))
    return F.flatten(F.transform(F.filter(full, lambda p: F.size(p) > 0), lambda p: F.concat(
        F.array(solid(p[0])), F.transform(F.slice(p, 2, F.size(p)), hole))))


def rings_from_wkt(text: Column) -> Column:
    """Outer ring and holes of each part of a WKT POLYGON or MULTIPOLYGON."""
    body = F.regexp_replace(F.upper(text), r"^\s*(MULTI)?POLYGON\s*Z?\s*", "")
    # a part opens with two brackets; holes follow inside the part after "),("
    parts = F.regexp_extract_all(body, F.lit(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"), 1)
    rings = F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"\(([^()]*)\)"), 1))
    points = lambda r: F.transform(
        F.split(F.trim(r), r"\s*,\s*"),
        lambda p: F.struct(F.element_at(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("x"),
                           F.element_at(F.split(F.trim(p), r"\s+"), 2).cast("double").alias("y")))
    return _oriented(F.transform(rings, lambda p: F.transform(p, points)))


# ellipsoids: semi-major axis, first eccentricity squared
GRS80 = (geo.EARTH_A, 0.006694380022900787)
BESSEL = (6377397.155, 0.006674372231802145)
# fixed value: older national datum to the geocentric one, metres, arc seconds (position vector), parts per million
OLD_DATUM = (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)

# projected systems of the source layers: central meridian, origin latitude, scale, false easting/northing
CRS = {
    "EPSG:5174": dict(lon0=127.0028902777778, lat0=38.0, k0=1.0, fe=200000.0, fn=500000.0),
    "EPSG:5179": dict(lon0=127.5, lat0=38.0, k0=0.9996, fe=1000000.0, fn=2000000.0),
    "EPSG:5181": dict(lon0=127.0, lat0=38.0, k0=1.0, fe=200000.0, fn=500000.0),
    "EPSG:5186": dict(lon0=127.0, lat0=38.0, k0=1.0, fe=200000.0, fn=600000.0),
}
OLDER = {"EPSG:5174"}
LONLAT = "EPSG:4326"


def project(rings: str, src: str, dst: str) -> str:
    """Rings from one system to another with native arithmetic, through longitude and latitude.

    Systems on the older datum are shifted through geocentric coordinates.
    """
    for system in (src, dst):
        if system != LONLAT and system not in CRS:
            raise ValueError(f"unknown system {system}")
    if src == dst:
        return rings
    old = lambda system: BESSEL if system in OLDER else GRS80

    def point(p):
        def ahead(q):
            if dst == LONLAT:
                return f"named_struct('x', {q}.x, 'y', {q}.y)"
            a, e2 = old(dst)
            return geo.transverse_mercator(f"{q}.x", f"{q}.y", **CRS[dst], a=a, e2=e2)

        def shifted(q):
            if old(src) == old(dst):
                return ahead(q)
            return geo.let(ahead, q=geo.datum_shift(f"{q}.x", f"{q}.y", old(src), old(dst), OLD_DATUM, back=dst in OLDER))

        if src == LONLAT:
            return shifted(p)
        a, e2 = old(src)
        return geo.let(shifted, q=geo.inverse_transverse_mercator(f"{p}.x", f"{p}.y", **CRS[src], a=a, e2=e2))

    return geo.each(rings, lambda r: geo.each(r, point))


def clean_rings(rings: str, least: int = 1) -> str:
    """Drop consecutive duplicate vertices and rings without area."""
    def dedupe(r):
        prev = f"concat(slice({r}, -1, 1), slice({r}, 1, size({r}) - 1))"
        pairs = f"zip_with({r}, {prev}, (p, q) -> named_struct('p', p, 'new', p.x <> q.x OR p.y <> q.y))"
        return geo.each(geo.keep(pairs, lambda s: f"{s}.new"), lambda s: f"{s}.p")

    cleaned = geo.each(geo.keep(rings, lambda r: f"size({r}) > 0"), dedupe)
    return geo.keep(cleaned, lambda r: f"size({r}) >= 3 AND abs({geo.ring_area(r)}) > 0") if least else cleaned


def clean_spots(rings: str) -> str:
    """Drop consecutive duplicate vertices and rings under three; rings without area may still cross themselves."""
    return geo.keep(clean_rings(rings, 0), lambda r: f"size({r}) >= 3")


def prepare_layer(raw: DataFrame, src_crs: str | None = None, dst_crs: str | None = None) -> DataFrame:
    """Repair, reproject and index raw features; empty geometry is dropped, all other columns stay."""
    clean = repair(raw.withColumn("rings", F.expr(clean_spots("rings")))).filter(F.size("rings") > 0)
    return grid.with_shape(clean, project("rings", src_crs, dst_crs) if src_crs and dst_crs else "rings")


def write_layer(prepared: DataFrame, path: str, size: float) -> None:
    """Store layers one row per (feature, cell), sorted by cell so scans prune; other layers in the folder stay."""
    cells = grid.with_cells(prepared.drop("walls", "edges"), size)
    (cells.repartitionByRange("cx", "cy").sortWithinPartitions("cx", "cy")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer_id").parquet(path))


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """Features from newline-delimited GeoJSON, properties kept as a map."""
    lines = spark.read.text(path)
    feat = lines.select(
        F.from_json(F.get_json_object("value", "$.properties"), "map<string,string>").alias("properties"),
        rings_from_geojson(F.get_json_object("value", "$.geometry")).alias("rings"))
    return feat.filter(F.size("rings") > 0)

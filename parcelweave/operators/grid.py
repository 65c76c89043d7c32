"""Grid cells: the equi-join key that stands in for a spatial index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo


def with_shape(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Add ``edges``, ``walls`` and bbox columns once, for reuse by every operator.

    As a generator they are computed once a row; filters that joins derive from box columns
    would otherwise be pushed down to the scan with all of the geometry in them.
    """
    keep = [c for c in df.columns if c not in ("rings", "edges", "minx", "miny", "maxx", "maxy")]
    df = df.withColumn("rings", F.expr(rings)).select(*keep, "rings", F.expr(f"inline(array({geo.outline('rings')}))"))
    return df.withColumn("walls", F.expr(geo.walls("edges")))


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("bigint")


def with_cells(df: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """One row per grid cell touched by the (padded) bounding box."""
    lo = lambda c: _cell(F.col(c) - pad, size)
    hi = lambda c: _cell(F.col(c) + pad, size)
    return (df.withColumn("cx", F.explode(F.sequence(lo("minx"), hi("maxx"))))
              .withColumn("cy", F.explode(F.sequence(lo("miny"), hi("maxy")))))


def point_cell(df: DataFrame, size: float, x: str = "px", y: str = "py") -> DataFrame:
    return df.withColumns({"cx": _cell(F.col(x), size), "cy": _cell(F.col(y), size)})


def cut_to_cells(df: DataFrame, size: float) -> DataFrame:
    """Cut every polygon at the grid lines: one row per cell with only the local walls.

    A polygon spanning a thousand cells becomes a thousand small rows, so no join
    partner ever carries a whole large geometry, and the areas of the pieces add up.
    """
    s = f"{float(size)}D"
    local = geo.clip_walls("walls", f"(cx * {s})", f"(cy * {s})", f"((cx + 1) * {s})", f"((cy + 1) * {s})")
    inside = f"floor(minx / {s}) = floor(maxx / {s}) AND floor(miny / {s}) = floor(maxy / {s})"
    return with_cells(df, size).withColumn("walls", F.expr(f"CASE WHEN {inside} THEN walls ELSE {local} END"))


def bbox_filter(layer: DataFrame, w: float, s: float, e: float, n: float) -> DataFrame:
    """Features whose bounding box meets the window; four pushed-down range filters."""
    return layer.filter((F.col("minx") <= e) & (F.col("maxx") >= w)
                        & (F.col("miny") <= n) & (F.col("maxy") >= s))


def bbox_filter_cells(layer: DataFrame, size: float, w: float, s: float, e: float, n: float) -> DataFrame:
    """Window query on a layer stored by cell: prunes to the touched cells first.

    A feature stored in several cells is reported from the one holding the lower
    left corner of its overlap with the window, so no de-duplication is needed.
    """
    fl = lambda v: int(v // size)
    hit = bbox_filter(layer.filter(F.col("cx").between(fl(w), fl(e)) & F.col("cy").between(fl(s), fl(n))), w, s, e, n)
    return hit.filter((F.col("cx") == _cell(F.greatest(F.col("minx"), F.lit(float(w))), size))
                      & (F.col("cy") == _cell(F.greatest(F.col("miny"), F.lit(float(s))), size)))


def cell_join(left: DataFrame, right: DataFrame, size: float, pad: float = 0.0, how: str = "inner",
              salts: int = 1) -> DataFrame:
    """Pairs whose (padded) boxes meet, each pair exactly once, no de-dup shuffle.

    Both sides come with bbox columns; the right side's are renamed ``r_*``.  A pair
    meeting in several cells is kept only in the cell of its shared lower left corner.
    ``salts`` > 1 spreads each cell of the left side over that many keys and copies the
    right side; skewed cells are otherwise split at run time by adaptive skew joins.
    """
    box = ["minx", "miny", "maxx", "maxy"]
    right = right.select([F.col(c).alias(f"r_{c}") if c in box else F.col(c) for c in right.columns])
    lc = with_cells(left, size, pad)
    rc = (right.withColumn("cx", F.explode(F.sequence(_cell(F.col("r_minx"), size), _cell(F.col("r_maxx"), size))))
               .withColumn("cy", F.explode(F.sequence(_cell(F.col("r_miny"), size), _cell(F.col("r_maxy"), size)))))
    keys = ["cx", "cy"]
    if salts > 1:
        lc = lc.withColumn("salt", F.pmod(F.xxhash64("minx", "miny", "maxx", "maxy"), F.lit(salts)))
        rc = rc.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        keys.append("salt")
    lo_x = F.greatest(F.col("minx") - pad, F.col("r_minx"))
    lo_y = F.greatest(F.col("miny") - pad, F.col("r_miny"))
    near = [F.col("r_minx") <= F.col("maxx") + pad, F.col("r_maxx") >= F.col("minx") - pad,
            F.col("r_miny") <= F.col("maxy") + pad, F.col("r_maxy") >= F.col("miny") - pad]
    out = lc.join(rc, keys, how)
    return out.filter(reduce(lambda a, b: a & b, near)) \
              .filter((F.col("cx") == _cell(lo_x, size)) & (F.col("cy") == _cell(lo_y, size))) \
              .drop(*keys)

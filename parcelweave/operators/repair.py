"""Repair of polygons whose boundary crosses itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import free_area, noding
from ..functions import geometry as geo


@F.pandas_udf(T.BooleanType())
def _crossing(rings: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else noding.crosses(free_area.rings_of(r)) for r in rings], dtype="object")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _simple_rings(rings: pd.Series) -> pd.Series:
    """x and y of the points of each simple ring, or null where nothing has to be repaired."""
    def one(flat):
        shape = free_area.rings_of(flat)
        return None if noding.simple(shape) else [r.ravel().tolist() for r in noding.repaired(shape)]

    return pd.Series([None if r is None else one(r) for r in rings], dtype="object")


# not to be copied into the expressions above it: each shape is looked at once
_simple_rings = _simple_rings.asNondeterministic()


def self_crossing(rings: str) -> Column:
    """Whether any two edges of the rings cross."""
    return _crossing(F.expr(geo.flat_rings(rings)))


def repair(df: DataFrame) -> DataFrame:
    """``rings`` without crossings, overlaps and spikes, by the even-odd rule; ``repaired`` tells which rows changed.

    Simple shapes keep their rings as they are.  Repaired ones have outer rings to the left and holes to the
    right, which touch at points at most; a shape without any inside has no rings left.
    """
    points = geo.each("_new", lambda r: geo.let(
        lambda v: f"transform(sequence(0, size({v}) div 2 - 1), i -> named_struct('x', {v}[2 * i], 'y', {v}[2 * i + 1]))", v=r))
    df = df.withColumn("_new", _simple_rings(F.expr(geo.flat_rings("rings"))))
    return df.withColumns({"repaired": F.col("_new").isNotNull(), "rings": F.expr(f"CASE WHEN _new IS NULL THEN rings ELSE {points} END")}).drop("_new")

"""Connected components of a graph given as edges, by alternating stars.

Large star: every node hands the smallest id among itself and its neighbours to its larger neighbours.
Small star: every node does so with its smaller ones and itself.  The edges shrink to one star for each
component in a number of rounds that grows with the logarithm of the longest path.  Every round is a
minimum and a join; a node with very many edges is spread by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component_id) for every node with an edge other than the smallest of its component.

    ``edges`` has columns u and v; nulls, loops and repeated edges do no harm.
    """
    e = stage(_tidy(edges.where("u IS NOT NULL AND v IS NOT NULL")), name)
    while True:
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        ends = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if ends.where("below > 1 OR below = 1 AND above = 1").isEmpty():  # every node hangs on one root
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = stage(_tidy(small), name)

"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import geometry as geo
from ..operators import grid
from ..session import code_table, ship
from ..sources.fixtures import cached_plan, table, view, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[["Inputs"], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def sql(views: str, body: str, ctes: str = "") -> str:
    """WITH list of the named views, extra CTEs, then the body."""
    head = with_clause(*views.split()) if views else ""
    parts = [p for p in (head, ctes.strip().rstrip(",")) if p]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def values(rows: list[tuple], alias: str, columns: str) -> str:
    """A CTE of literal rows."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{alias} AS (SELECT * FROM (VALUES {body}) AS t({columns}))"


class Inputs:
    """The test-data views with geometry attached."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        """A rule table whose size is fixed in the code."""
        return code_table(self.spark, rows, schema)

    def _shaped(self, name: str, rings: str, kind: str = "shape", rows: DataFrame | None = None) -> DataFrame:
        return cached_plan(self.spark, (self.sf_dir, kind, name), lambda: grid.with_shape(self.view(name) if rows is None else rows, rings))

    def _spread(self, name: str, source: str) -> DataFrame:
        """A view on whose rows much is worked out; where its table has fewer splits than there are cores, its rows are spread."""
        cores = self.spark.sparkContext.defaultParallelism
        few = table(self.spark, self.sf_dir, source).rdd.getNumPartitions() < cores
        return self.view(name).repartition(cores) if few else self.view(name)

    def parcels(self) -> DataFrame:
        return self._shaped("fx_parcels", geo.rectangle("x0", "y0", "x1", "y1"))

    def shaped_parcels(self) -> DataFrame:
        """Parcels as plain, L-shaped, U-shaped, holed, two-part and dumbbell polygons, by ``kind``."""
        at = lambda *points: geo.polygon(*((f"x0 + (x1 - x0) * {fx}D", f"y0 + (y1 - y0) * {fy}D") for fx, fy in points))
        third, two = repr(1 / 3), repr(2 / 3)
        ell = at((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))
        cup = at((0, 0), (1, 0), (1, 1), (two, 1), (two, third), (third, third), (third, 1), (0, 1))
        hole = at((0.25, 0.25), (0.25, 0.5), (0.5, 0.5), (0.5, 0.25))
        rooms = at((0, 0), (0.5, 0), (0.5, 0.4), (0.7, 0.4), (0.7, 0), (1, 0), (1, 1), (0.7, 1), (0.7, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))
        box = geo.rectangle("x0", "y0", "x1", "y1")
        parts = f"concat({at((0.8, 0), (1, 0), (1, 1), (0.8, 1))}, {at((0, 0), (0.6, 0), (0.6, 1), (0, 1))})"
        rings = f"CASE id % 6 WHEN 1 THEN {ell} WHEN 2 THEN {cup} WHEN 3 THEN concat({box}, {hole}) WHEN 4 THEN {parts} WHEN 5 THEN {rooms} ELSE {box} END"
        return self._shaped("fx_parcels", rings, "outlines", self._spread("fx_parcels", "orders")).withColumn("kind", F.expr("CAST(id % 6 AS INT)"))

    def zones(self) -> DataFrame:
        return self._shaped("fx_zones", geo.rectangle("x0", "y0", "x1", "y1"))

    def layer(self) -> DataFrame:
        """Rectangles with a cut corner; every third one has a rectangular hole."""
        outer = geo.polygon(("x0", "y0"), ("x1", "y0"), ("x1", "y1 - cut"), ("x1 - cut", "y1"), ("x0", "y1"))
        hole = geo.rectangle("x0 + (x1 - x0) / 4", "y0 + (y1 - y0) / 4", "(x0 + x1) / 2", "(y0 + y1) / 2")
        return self._shaped("fx_layer", f"CASE WHEN feature_id % 3 = 0 THEN {geo.oriented(f'array(concat({outer}, {hole}))')} ELSE {outer} END")

    def crossed_layer(self) -> DataFrame:
        """Layer features as rings that cross themselves: bow ties, a loop that leaves its box below, and plain boxes."""
        bow = geo.polygon(("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1"))
        mid = "(x0 + x1) / 2"
        loop = geo.polygon(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), (mid, "y1"), (mid, "y0 - 10"), ("x0", "y0 - 10"))
        rings = f"CASE feature_id % 3 WHEN 0 THEN {bow} WHEN 1 THEN {loop} ELSE {geo.rectangle('x0', 'y0', 'x1', 'y1')} END"
        return self.view("fx_layer").withColumn("rings", F.expr(rings))

    def planned_roads(self) -> DataFrame:
        return self._shaped("fx_planned_roads", geo.rectangle("x0", "y0", "x1", "y1"))

    def registry(self) -> DataFrame:
        return self.rows(LAYER_REGISTRY, "layer_id string, title string, provider string, ready boolean, available boolean")


# test registry: one layer not configured, one whose source does not answer
LAYER_REGISTRY = [(i, t, p, i != "ecological_separate_management", i != "disaster_risk_zone") for i, t, p in fv.LAYERS]
REGISTRY_CTE = values(LAYER_REGISTRY, "registry", "layer_id, title, provider, ready, available")

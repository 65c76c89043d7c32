"""Access to roads and drainage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import geometry as geo
from . import grid, spatial


def road_width(df: DataFrame) -> DataFrame:
    """Width estimate: short side of the smallest enclosing rectangle, one decimal.

    Candidate directions are all vertex pairs, which include the sides of the hull.
    """
    pts = "flatten(rings)"

    def box(p, q):
        along = lambda v: f"{v}.x * ux + {v}.y * uy"
        def sized(ux, uy):
            proj = lambda a, b: geo.each(pts, lambda v: f"({v}.x * {a} + {v}.y * {b})")
            return geo.let(lambda s, t: geo.let(
                lambda w, h: f"CASE WHEN hypot({ux}, {uy}) > 0 THEN named_struct('a', {w} * {h}, 'short', least("
                             f"CASE WHEN {w} > 0.05D THEN {w} END, CASE WHEN {h} > 0.05D THEN {h} END)) END",
                w=f"array_max({s}) - array_min({s})", h=f"array_max({t}) - array_min({t})"),
                s=proj(ux, uy), t=proj(f"(-{uy})", ux))
        return geo.let(lambda d: geo.let(sized, ux=f"({q}.x - {p}.x) / {d}", uy=f"({q}.y - {p}.y) / {d}"),
                       d=f"nullif(hypot({q}.x - {p}.x, {q}.y - {p}.y), 0D)")

    boxes = f"array_compact(flatten({geo.each(pts, lambda p: geo.each(pts, lambda q: box(p, q)))}))"
    return df.withColumn("width_m", geo.bround(F.expr(f"array_min({boxes}).short"), 1))


def with_road_width(parcels: DataFrame) -> DataFrame:
    """Add ``width_m`` of road parcels, null elsewhere: :func:`spatial.adjacency` carries it to the neighbours, so no join follows."""
    wide = road_width(parcels.withColumn("_r", F.col("rings")).withColumn(
        "rings", F.when(F.col("jimok").isin(*fv.ROAD_JIMOK), F.col("rings"))))
    return wide.drop("rings").withColumnRenamed("_r", "rings")


def road_access(parcels: DataFrame, adj: DataFrame, widths: DataFrame | None = None, parcel_id: str = "pnu",
                unavailable: DataFrame | None = None, edges: bool = False, also: tuple[Column, ...] = ()) -> DataFrame:
    """Cadastral road contact of every parcel.

    ``widths`` (n_id, width_m) covers road parcels; without it ``adj`` carries ``n_width_m``.  ``also`` are further
    sums over the neighbours, taken in the same pass.  With ``edges`` the per-edge road
    contact is summed into ``road_len`` in the same pass (one entry per road neighbour).  Parcels listed in ``unavailable``
    could not be checked and are UNAVAILABLE, never "no road".
    """
    road = F.col("n_jimok").isin(*fv.ROAD_JIMOK)
    near = adj.withColumn("width_m", F.col("n_width_m")) if widths is None else adj.join(widths, "n_id", "left")
    known = {parcel_id, "roads", "road_contact_m", "widest_m", "nonroads", "_ec"}
    g = (near.groupBy(parcel_id).agg(
        F.sum(road.cast("bigint")).alias("roads"), F.max(F.when(road, F.col("contact_length_m"))).alias("road_contact_m"),
        F.max(F.when(road, F.coalesce("width_m", F.lit(0.0)))).alias("widest_m"),
        F.sum((~road).cast("bigint")).alias("nonroads"),
        *([F.collect_list(F.when(road, F.col("edge_contacts"))).alias("_ec")] if edges else []), *also))
    out = parcels.select(parcel_id).join(g, parcel_id, "left")
    out = (out.withColumn("_na", F.lit(False)) if unavailable is None else
           out.join(unavailable.select(parcel_id).distinct().withColumn("_na", F.lit(True)), parcel_id, "left"))
    roads = F.coalesce("roads", F.lit(0))
    na = F.coalesce("_na", F.lit(False))
    status = F.when(na, "UNAVAILABLE").when(roads > 0, "CADASTRAL_CONTACT").otherwise("NO_CADASTRAL_ROAD")
    widest = F.coalesce("widest_m", F.lit(0.0))
    return out.select(parcel_id, status.alias("road_status"), F.when(na, 0).otherwise(roads).alias("roads"),
                      F.when(~na, F.col("road_contact_m")).alias("road_contact_m"),
                      F.when(~na, widest).alias("widest_m"),
                      (~na & (widest > 0) & (widest < fv.ROAD_MIN_WIDTH_M)).alias("narrow_road"),
                      F.when(na, 0).otherwise(F.coalesce("nonroads", F.lit(0))).alias("nonroads"),
                      *([F.expr("CASE WHEN size(_ec) > 0 THEN transform(_ec[0], (v, i) -> "
                                "aggregate(_ec, 0D, (s, c) -> s + c[i])) END").alias("road_len")] if edges else []),
                      *[c for c in g.columns if c not in known])


def nonroad_neighbours(adj: DataFrame, parcel_id: str = "pnu") -> DataFrame:
    """Neighbours that are not roads, counted by land category."""
    return (adj.filter(~F.col("n_jimok").isin(*fv.ROAD_JIMOK))
            .groupBy(parcel_id, F.coalesce("n_jimok", F.lit("미상")).alias("jimok")).agg(F.count(F.lit(1)).alias("parcels")))


def planned_roads(access: DataFrame, parcels: DataFrame, roads: DataFrame, designations: DataFrame,
                  parcel_id: str = "pnu", tol: float = 1.1) -> DataFrame:
    """Planned roads of parcels without a cadastral road upgrade them to PLANNED_ROAD_ABUTS.

    Where the layer shows nothing, adjacent road designations of the parcel count instead.
    All parcels enter the spatial join: to pick the open cases first would move their geometry once more.
    """
    left = parcels.select(parcel_id, F.expr(geo.flat_edges("edges")).alias("a_flat"), "minx", "miny", "maxx", "maxy")
    right = roads.select("road_id", "name", "road_no", "executed", F.expr(geo.flat_edges("edges")).alias("b_flat"), "minx", "miny", "maxx", "maxy")
    near = grid.cell_join(left, right, spatial.LAYER_CELL, pad=tol).select(
        parcel_id, "name", "road_no", "road_id", "executed", "miny", "a_flat", "b_flat")
    near = spatial.with_contact(near, "a_flat", "b_flat", tol)
    # contact along the edges settles most pairs, overlap is looked at for the rest
    wall = lambda flat: geo.walls(geo.edges_of_flat(flat))
    overlap = geo.let(lambda a, b: geo.overlap_area(a, b, "miny"), a=wall("a_flat"), b=wall("b_flat"))
    layer = (near.filter(F.expr(f"CASE WHEN contact_raw > 0 THEN true ELSE {overlap} > 1e-9D END")).groupBy(parcel_id, "name", "road_no")
             .agg(F.min(F.struct("road_id", "executed")).alias("r"))
             .select(parcel_id, "name", F.col("r.executed").alias("executed"), F.lit(0).alias("rank")))
    named = (designations.filter((F.col("relation") == "접함") & F.col("name").rlike("(광로|대로|중로|소로)"))
             .select(parcel_id, "name", F.lit("").alias("executed"), F.lit(1).alias("rank")))
    # both kinds of evidence are summed up beside each other, so the spatial join is done once
    found = layer.unionByName(named).repartition(parcel_id).groupBy(parcel_id, "rank").agg(
        F.count(F.lit(1)).alias("planned"), F.array_join(F.array_sort(F.collect_set("name")), "·").alias("planned_names"),
        F.max(F.col("executed").contains("미집행")).alias("unexecuted"),
        F.max((F.col("executed") != "") & ~F.col("executed").contains("미집행")).alias("opened"))
    found = found.groupBy(parcel_id).agg(F.min(F.struct("rank", "planned", "planned_names", "unexecuted", "opened")).alias("f"))
    open_case = F.coalesce(F.col("road_status").isin("NO_CADASTRAL_ROAD", "UNAVAILABLE"), F.lit(False))
    j = access.join(found, parcel_id, "left")
    j = j.select(*access.columns, *[F.when(open_case, F.col(f"f.{c}")).alias(c) for c in ("planned", "planned_names", "unexecuted", "opened")])
    up = F.col("planned") > 0
    label = (F.when(F.col("opened"), "도시계획도로 접함(개설)").when(F.col("unexecuted"), "도시계획도로 미집행(미개설)")
             .otherwise("도시계획도로 접함(접도 검토)"))
    return j.withColumns({"road_status": F.when(up, "PLANNED_ROAD_ABUTS").otherwise(F.col("road_status")),
                          "planned_label": F.when(up, label), "planned": F.coalesce("planned", F.lit(0)),
                          "planned_names": F.coalesce("planned_names", F.lit(""))}).drop("unexecuted", "opened")


def drainage(parcels: DataFrame, adj: DataFrame, parcel_id: str = "pnu") -> DataFrame:
    """Public drainage outlets next to each parcel: road gutter first, then by contact length."""
    name = F.create_map(*[F.lit(x) for kv in fv.DRAIN_JIMOK.items() for x in kv])[F.col("n_jimok")]
    road = F.col("n_jimok").isin(*fv.ROAD_JIMOK)
    outlets = (adj.withColumn("outlet", F.when(road, fv.ROAD_OUTLET_LABEL).otherwise(name)).filter(F.col("outlet").isNotNull())
               .groupBy(parcel_id, "outlet").agg(F.max(F.when(road, 1e12).otherwise(F.col("contact_length_m"))).alias("rank")))
    # at most three outlet kinds per parcel
    lists = outlets.groupBy(parcel_id).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "outlet"))), lambda s: s["outlet"]), "·").alias("outlets"))
    return (parcels.select(parcel_id).join(lists, parcel_id, "left")
            .select(parcel_id, F.coalesce("outlets", F.lit("")).alias("outlets"), F.col("outlets").isNotNull().alias("public_outlet")))


def nearest_outlet(parcels: DataFrame, drained: DataFrame, parcel_id: str = "pnu",
                   reach: float = fv.DRAIN_SEARCH_M) -> DataFrame:
    """Straight route from parcels without an outlet to the nearest public outlet parcel.

    Starts at the interior point; candidates are outlet parcels whose box meets the
    parcel's box widened by ``reach``; routes under 0.5 m are dropped.

    The far corner of a candidate's box bounds the nearest distance from above, so a first
    pass over boxes alone leaves each parcel a small window, and only outlets that meet it
    are measured edge by edge.
    """
    todo = parcels.join(drained.filter(~F.col("public_outlet")).select(parcel_id), parcel_id, "left_semi")
    left = spatial.interior_point(todo).select(parcel_id, "px", "py", "minx", "miny", "maxx", "maxy")
    right = (parcels.filter(F.col("jimok").isin(*fv.PUBLIC_DRAIN_JIMOK))
             .select(F.col(parcel_id).alias("outlet_id"), F.col("jimok").alias("outlet_jimok"), "edges", "minx", "miny", "maxx", "maxy"))
    other = F.col(parcel_id) != F.col("outlet_id")
    far = F.hypot(*[F.greatest(F.abs(F.col(f"r_min{c}") - F.col(f"p{c}")), F.abs(F.col(f"r_max{c}") - F.col(f"p{c}"))) for c in "xy"])
    bound = (grid.cell_join(left, right.drop("edges", "outlet_jimok"), reach, pad=reach).filter(other)
             .groupBy(*left.columns).agg((F.min(far) + 0.01).alias("within")))  # sure to hold the nearest despite rounding
    window = bound.select(parcel_id, "px", "py", *[w.alias(f"{m}{c}") for c in "xy" for m, w in (
        ("min", F.greatest(F.col(f"min{c}") - reach, F.col(f"p{c}") - F.col("within"))),
        ("max", F.least(F.col(f"max{c}") + reach, F.col(f"p{c}") + F.col("within"))))])
    pairs = grid.cell_join(window, right, reach).filter(other)
    best = (pairs.withColumn("n", F.expr(geo.nearest_on("edges", "px", "py")))
            .groupBy(parcel_id, "px", "py").agg(F.min(F.struct(F.col("n.d").alias("d"), F.col("outlet_id"), "outlet_jimok",
                                                               F.col("n.x").alias("qx"), F.col("n.y").alias("qy"))).alias("b")))
    return best.select(parcel_id, "px", "py", "b.outlet_id", "b.outlet_jimok", "b.qx", "b.qy",
                       geo.bround("b.d", 1).alias("length_m"), F.col("b.d").alias("_d")) \
        .filter(F.col("_d") >= 0.5).drop("_d")


def crossed_parcels(routes: DataFrame, parcels: DataFrame, parcel_id: str = "pnu", size: float = spatial.CELL) -> DataFrame:
    """Private parcels a drainage route passes through, with the length inside each."""
    left = routes.select(parcel_id, "px", "py", "qx", "qy", F.least("px", "qx").alias("minx"), F.least("py", "qy").alias("miny"),
                         F.greatest("px", "qx").alias("maxx"), F.greatest("py", "qy").alias("maxy"))
    right = (parcels.filter(~F.col("jimok").isin(*fv.PUBLIC_DRAIN_JIMOK))
             .select(F.col(parcel_id).alias("hit_id"), F.col("jimok").alias("hit_jimok"), "edges", "walls", "minx", "miny", "maxx", "maxy"))
    pairs = grid.cell_join(left, right, size).filter(F.col(parcel_id) != F.col("hit_id"))

    def cut(e):  # position along the route where it meets the line of an edge
        den = f"((qx - px) * ({e}.y2 - {e}.y1) - (qy - py) * ({e}.x2 - {e}.x1))"
        return (f"CASE WHEN {den} <> 0 THEN least(greatest((({e}.x1 - px) * ({e}.y2 - {e}.y1) - ({e}.y1 - py) * ({e}.x2 - {e}.x1)) / {den}, 0D), 1D) END")

    def inside(ts):
        def piece(t, u):
            return geo.let(lambda x, y: f"CASE WHEN {geo.contains('walls', x, y)} THEN {u} - {t} ELSE 0D END",
                           x=f"px + (qx - px) * ({t} + {u}) / 2", y=f"py + (qy - py) * ({t} + {u}) / 2")
        return geo.total(f"zip_with(slice({ts}, 1, size({ts}) - 1), slice({ts}, 2, size({ts}) - 1), (ta, tb) -> {piece('ta', 'tb')})")

    part = geo.let(inside, ts=f"array_sort(array_distinct(array_compact(concat(array(0D, 1D), {geo.each('edges', cut)}))))")
    sized = geo.keep(f"array(named_struct('len', hypot(qx - px, qy - py) * {part}))", lambda v: f"{v}.len > 0.05D")
    return pairs.select(parcel_id, "hit_id", "hit_jimok", F.expr(f"inline({sized})")) \
        .select(parcel_id, "hit_id", "hit_jimok", geo.bround("len", 1).alias("cross_length_m"))


def encroachment(routes: DataFrame, parcels: DataFrame, owners: DataFrame, buildings: DataFrame,
                 parcel_id: str = "pnu") -> DataFrame:
    """Whether each route is blocked by land that is not public.

    Every crossing gets its ownership (hit_id, ownership) and building flag (hit_id,
    has_building); one of unknown ownership counts as private.
    """
    hits = crossed_parcels(routes, parcels, parcel_id)
    known = hits.join(owners, "hit_id", "left").join(buildings, "hit_id", "left")
    own = F.col("ownership")
    g = known.groupBy(parcel_id).agg(
        F.count(F.lit(1)).alias("crossed"), F.max(F.coalesce(own != "국공유", F.lit(True))).alias("crosses_private"),
        F.sum(F.coalesce("has_building", F.lit(False)).cast("bigint")).alias("built_crossings"),
        F.max("cross_length_m").alias("longest_crossing_m"))
    return (routes.select(parcel_id, "outlet_id", "length_m").join(g, parcel_id, "left")
            .withColumns({"crossed": F.coalesce("crossed", F.lit(0)), "crosses_private": F.coalesce("crosses_private", F.lit(False)),
                          "built_crossings": F.coalesce("built_crossings", F.lit(0))}))

"""Buildable envelope, constrained massing, division and what-ifs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import free_area
from ..functions import geometry as geo
from . import measures, rules

def north_edges(edge_array: str = "edges") -> str:
    """Edges whose outward normal points north (component above 0.25), longer than 5 cm."""
    return geo.keep(edge_array, lambda e: geo.let(
        lambda ln: f"{ln} > 0.05D AND ({e}.x1 - {e}.x2) / {ln} > 0.25D", ln=f"hypot({e}.x2 - {e}.x1, {e}.y2 - {e}.y1)"))


def main_ring(rings: str) -> str:
    """Outer ring, counter-clockwise, of the part with the largest area less its holes."""
    def net(r, rs):
        inside = geo.let(lambda w: geo.total(geo.each(
            geo.keep(rs, lambda h: f"{geo.ring_area(h)} < 0 AND {geo.contains(w, f'{h}[0].x', f'{h}[0].y')}"), geo.ring_area)), w=geo.walls(geo._pairs(r)))
        return f"named_struct('a', {geo.ring_area(r)} + {inside}, 'r', {r})"

    def best(rs):
        return f"array_max({geo.each(geo.keep(rs, lambda r: f'{geo.ring_area(r)} > 0'), lambda r: net(r, rs))}).r"

    return geo.let(lambda rs: f"CASE WHEN size({rs}) = 1 THEN {geo.turned(f'{rs}[0]')} ELSE {best(rs)} END", rs=geo.keep(rings, lambda r: f"size({r}) >= 3"))


def right_cornered(rings: str, ring: str) -> str:
    """One ring whose corners all turn by a right angle or more, so the band beside an edge spans all that lies along it."""
    a, b = geo._var(), geo._var()
    return geo.let(lambda es: (
        f"size({rings}) = 1 AND forall(zip_with({es}, concat(slice({es}, 2, greatest(size({es}) - 1, 0)), slice({es}, 1, 1)), ({a}, {b}) -> "
        f"({a}.x2 - {a}.x1) * ({b}.y2 - {b}.y1) - ({a}.y2 - {a}.y1) * ({b}.x2 - {b}.x1) > 0 AND "
        f"({a}.x2 - {a}.x1) * ({b}.x2 - {b}.x1) + ({a}.y2 - {a}.y1) * ({b}.y2 - {b}.y1) <= 1e-9D), t -> t)"), es=geo._pairs(ring))


def _flat_edges(edges: str, distance: str = "") -> str:
    return "flatten(" + geo.each(edges, lambda e: f"array({e}.x1, {e}.y1, {e}.x2, {e}.y2, {distance or f'{e}.d'})") + ")"


def _stacked(lists) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows one after another, and how many each row has."""
    return np.concatenate([np.zeros(0), *lists]), np.fromiter(map(len, lists), int, len(lists))


def _rings_of(lists) -> free_area.Rings:
    return free_area.Rings.read(*_stacked(lists))


def _edges_of(lists) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all rows, and the row of each."""
    flat, counts = _stacked(lists)
    return flat.reshape(-1, 5), np.repeat(np.arange(len(counts)), counts // 5)


def _asked(rings, *others) -> tuple[np.ndarray, list[list]]:
    """Places of the rows that have rings, and what these rows hold."""
    at = [k for k, r in enumerate(rings) if r is not None]
    return np.array(at, int), [[v[k] for k in at] for v in (rings, *others)]


@F.pandas_udf(T.DoubleType())
def _free_area(rings: pd.Series, bands: pd.Series, north: pd.Series) -> pd.Series:
    """Largest part outside the bands; null rings give null."""
    at, (r, b, n) = _asked(rings, bands, north)
    out = np.full(len(rings), np.nan)
    out[at] = free_area.largest_of(_rings_of(r), (free_area.band_corners(*_edges_of(b)), free_area.band_corners(*_edges_of(n), joined=False)))
    return _nullable(out, at)


def _nullable(values: np.ndarray, at: np.ndarray) -> pd.Series:
    """Values of the rows at these places, null elsewhere."""
    gone = np.ones(len(values), bool)
    gone[at] = False
    return pd.Series(pd.arrays.FloatingArray(values, gone))


@F.pandas_udf(T.StructType().add("n", "double").add("adj", "double").add("done", "boolean"))
def _settled(rings: pd.Series, bands: pd.Series, north: pd.Series, needs: pd.DataFrame) -> pd.DataFrame:
    """North setback and area once the height no longer moves; null rings give nulls."""
    at, (r, b, n) = _asked(rings, bands, north)
    need = needs.iloc[at]
    gross, floors, building, room = (need[c].to_numpy(float) for c in ("gross", "floors", "building", "room"))
    height, daylight = need["height"].to_numpy(float), need["daylight"].to_numpy(bool)
    shapes, fixed, (edges, row) = _rings_of(r), free_area.band_corners(*_edges_of(b)), _edges_of(n)
    depth, adj, done = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at), bool)
    rest, left, known = np.arange(len(at)), np.zeros(len(at)), np.full(len(at), np.nan)
    for _ in range(ROUNDS):
        depth[rest] = np.where(~daylight[rest], 0.0, np.where(height[rest] <= 10, 1.5, height[rest] / 2))
        new = rest[known[rest] != depth[rest]]
        if len(new):
            place = np.full(len(at), -1)
            place[new] = np.arange(len(new))
            one, some = place[fixed[1]] >= 0, place[row] >= 0
            along = np.column_stack([edges[some, :4], depth[row[some]]])
            left[new] = free_area.largest_of(shapes.only(new), ((fixed[0][one], place[fixed[1][one]]), free_area.band_corners(along, place[row[some]], joined=False)))
            known[new] = depth[new]
        adj[rest] = np.minimum(np.minimum(building[rest], left[rest]), np.maximum(0.0, room[rest]))
        with np.errstate(divide="ignore", invalid="ignore"):
            wanted = np.where(adj[rest] > 0, np.maximum(1, np.ceil(gross[rest] / adj[rest] - 1e-9)), 0)
        now = np.where(floors[rest] > 0, np.minimum(wanted, floors[rest]), 0) * fv.FLOOR_HEIGHT_M
        done[rest], height[rest] = np.abs(now - height[rest]) < 0.1, now
        rest = rest[~done[rest]]
        if not len(rest):
            break
    out = pd.DataFrame({"n": None, "adj": None, "done": None}, index=range(len(rings)), dtype=object)
    out.iloc[at] = np.column_stack([depth.astype(object), adj.astype(object), done.astype(object)])
    return out


@F.pandas_udf(T.DoubleType())
def _even_inset(rings: pd.Series, edges: pd.Series, ratio: pd.Series, reach: pd.Series) -> pd.Series:
    """Depth of the inset whose largest part keeps the share of the largest part's area; null rings give null."""
    at, (r, e, s, f) = _asked(rings, edges, ratio, reach)
    shapes, share = _rings_of(r), np.array(s, float)
    whole = free_area.largest_of(shapes)
    out = np.full(len(rings), np.nan)
    out[at] = free_area.inset_depths(shapes, *_edges_of(e), share * whole, np.array(f, float), whole * (1 - share))
    return _nullable(out, at)


def front_edges(parcels: DataFrame, adj: DataFrame, parcel_id: str = "pnu") -> DataFrame:
    """Add ``road_len``: per parcel edge the length touching road parcels."""
    road = (adj.filter(F.col("n_jimok").isin(*fv.ROAD_JIMOK))
            .select(parcel_id, F.posexplode("edge_contacts").alias("pos", "len"))
            .groupBy(parcel_id, "pos").agg(F.sum("len").alias("len")))
    per = road.groupBy(parcel_id).agg(F.map_from_entries(F.collect_list(F.struct("pos", "len"))).alias("m"))
    j = parcels.join(per, parcel_id, "left")
    return j.withColumn("road_len", F.expr("transform(edges, (e, i) -> coalesce(element_at(m, i), 0D))")).drop("m")


def _main_part(df: DataFrame) -> DataFrame:
    """``_ring``, the largest part's outer ring; ``_plain`` where native clipping of it is exact; ``ring_area``, the area of all parts."""
    # as a generator: every mention of the ring reads it instead of working it out again
    main = geo.let(lambda r: f"named_struct('_ring', {r}, '_plain', {right_cornered('rings', r)}, 'ring_area', {geo.area('rings')})", r=main_ring("rings"))
    return df.select("*", F.expr(f"inline(array({main}))"))


def _others(value: str) -> Column:
    """A value for the rows that need the exact sweep, null for the others."""
    return F.expr(f"CASE WHEN NOT _plain THEN {value} END")


def _setback_edges(edge_array: str, distance) -> str:
    return (f"transform({edge_array}, (e, i) -> named_struct('x1', e.x1, 'y1', e.y1, 'x2', e.x2, 'y2', e.y2, 'd', {distance('e', 'i')}))")


def _with_bands(df: DataFrame) -> DataFrame:
    df = _main_part(df)
    base = lambda e, i: (f"CASE WHEN get(road_len, {i}) > hypot({e}.x2 - {e}.x1, {e}.y2 - {e}.y1) / 2 "
                         f"THEN coalesce(front_m, 0D) ELSE coalesce(adjacent_m, 0D) END")
    df = df.withColumns({"_bands": F.expr(_setback_edges("edges", base)),
                         "_north": F.expr(_setback_edges(north_edges(geo._pairs("_ring")), lambda e, i: "coalesce(north_m, 0D)"))})
    return df.withColumn("_base", F.expr(f"CASE WHEN _plain THEN {geo.inset('_ring', '_bands')} END"))


def setback_envelope(df: DataFrame) -> DataFrame:
    """Area of the largest part left after front, adjacent and north setbacks, exact for every parcel.

    Needs rings, edges, bbox, ``road_len`` per edge, front_m, adjacent_m, north_m.  An edge is a front edge
    when more than half of it touches a road.  A setback takes the band beside an edge, on both sides and
    with flat ends; bands of neighbouring edges with one distance are mitred.  North setbacks lie along
    the north edges of the largest part's outer ring, each for itself.  ``method`` tells rows clipped
    natively (``clip``) from rows swept (``sweep``).
    """
    df = _with_bands(df)
    swept = _free_area(_others(geo.flat_rings("rings")), _others(_flat_edges("_bands")), _others(_flat_edges("_north")))
    clipped = F.expr(f"CASE WHEN _plain THEN {geo.ring_area_abs(geo.inset('_base', '_north'))} END")
    method = F.when(F.col("_plain"), "clip").otherwise("sweep")
    return df.withColumns({"method": method, "envelope_area_m2": F.coalesce(clipped, swept)}).drop("_ring", "_plain", "_bands", "_north", "_base")


#: rounds of height against area
ROUNDS = 6


def constrained_massing(df: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Building size under setbacks and surface parking, all rows at once.

    The north setback depends on the height and the height on the remaining area, so a
    bounded number of rounds runs inside each row; rows that settled keep their values.  Needs the
    envelope inputs plus building_area_m2, gross_floor_area_m2, floors, mass_height_m,
    zone, setback_status, applied_surface_m2.  ``height_settled`` tells rows whose height still moved
    in the last round.
    """
    applied = F.col("setback_status") == "APPLIED"
    df = df.withColumns({"front_m": F.when(applied, F.coalesce("front_m", F.lit(0.0))).otherwise(0.0),
                         "adjacent_m": F.when(applied, F.coalesce("adjacent_m", F.lit(0.0))).otherwise(0.0),
                         "north_daylight": F.col("zone").isin(*fv.NORTH_DAYLIGHT_ZONES),
                         "north_m": F.lit(0.0)})
    df = _with_bands(df).withColumn("_env0", F.expr(geo.ring_area_abs("_base")))

    def advance(s):
        def sized(nn):
            north = _setback_edges("_north", lambda e, i: nn)
            env = f"CASE WHEN {nn} = 0 THEN _env0 ELSE {geo.ring_area_abs(geo.inset('_base', north))} END"
            return geo.let(lambda a: geo.let(
                lambda nh: f"named_struct('h', {nh}, 'done', abs({nh} - {s}.h) < 0.1D, 'n', {nn}, 'adj', {a})",
                nh=f"double(CASE WHEN floors > 0 THEN least(CASE WHEN {a} > 0 THEN greatest(1, ceil(gross_floor_area_m2 / {a} - 1e-9D)) "
                   f"ELSE 0 END, floors) ELSE 0 END) * {fv.FLOOR_HEIGHT_M}D"),
                a=f"least(building_area_m2, {env}, greatest(0D, ring_area - applied_surface_m2))")
        return geo.let(sized, nn=f"CASE WHEN NOT north_daylight THEN 0D WHEN {s}.h <= 10 THEN 1.5D ELSE {s}.h / 2 END")

    # one fold with a bounded number of rounds; settled rows pass their state through
    fold = (f"aggregate(sequence(1, {rounds}), named_struct('h', mass_height_m, 'done', false, 'n', 0D, 'adj', building_area_m2), "
            f"(s, k) -> CASE WHEN s.done THEN s ELSE {advance('s')} END)")
    needs = F.struct(F.col("gross_floor_area_m2").alias("gross"), F.col("floors").cast("int").alias("floors"), F.col("building_area_m2").alias("building"),
                     F.col("mass_height_m").alias("height"), (F.col("ring_area") - F.col("applied_surface_m2")).alias("room"), F.col("north_daylight").alias("daylight"))
    df = df.withColumns({"_s": F.expr(f"CASE WHEN _plain THEN {fold} END"),
                         "_t": _settled(_others(geo.flat_rings("rings")), _others(_flat_edges("_bands")), _others(_flat_edges("_north")), needs)})
    df = df.withColumns({"_n": F.coalesce("_s.n", "_t.n"), "_adj": F.coalesce("_s.adj", "_t.adj"), "height_settled": F.coalesce("_s.done", "_t.done")}).drop("_s", "_t")
    ok = F.col("_adj") >= fv.MIN_FOOTPRINT_M2
    df = df.withColumns({"layout_feasible": ok, "_adj": F.when(ok, F.col("_adj")).otherwise(0.0)})
    df = df.withColumn("_gfa", F.when(F.col("floors") > 0, F.least(F.col("gross_floor_area_m2"), F.col("_adj") * F.col("floors"))).otherwise(0.0))
    df = df.withColumn("_fl", F.when(F.col("_adj") > 0, F.col("_gfa") / F.col("_adj")).otherwise(0.0))
    floors = F.when(F.col("_adj") > 0, F.greatest(F.lit(1), F.ceil(F.col("_fl") - 1e-9))).otherwise(0).cast("int")
    df = df.withColumn("final_floors", floors)
    density = F.col("building_area_m2")
    return df.withColumns({
        "adjusted_area_m2": geo.bround("_adj", 2), "reduction_m2": geo.bround(F.greatest(F.lit(0.0), density - F.col("_adj")), 2),
        "reduction_pct": F.when(density > 0, geo.bround((1 - F.col("_adj") / density) * 100, 1)).otherwise(0.0),
        "north_setback_m": geo.bround("_n", 1), "achievable_gfa_m2": geo.bround("_gfa", 2),
        "final_height_m": F.when(F.col("final_floors") > 0, geo.bround(F.col("final_floors") * fv.FLOOR_HEIGHT_M, 1)).otherwise(0.0),
    }).drop("_n", "_adj", "_gfa", "_fl", "_bands", "_north", "_base", "_env0", "_ring", "_plain")


def inset_for_area(df: DataFrame, ratio: str = "ratio") -> DataFrame:
    """Depth of an even inset whose largest part keeps the target share of the largest part's area.

    Parcels with right corners only keep all their sides until nothing is left, so their area is a square function
    of the depth and is solved in closed form; elsewhere exact sweeps check or search the depth.
    """
    df = _main_part(df)
    share = f"greatest(0.001D, least(1D, {ratio}))"
    reach = "greatest(maxx - minx, maxy - miny)"
    a, b = geo._var(), geo._var()
    length = lambda e: f"hypot({e}.x2 - {e}.x1, {e}.y2 - {e}.y1)"
    # tangent of half the turn at each corner
    bend = lambda es: geo.total(
        f"zip_with({es}, concat(slice({es}, 2, greatest(size({es}) - 1, 0)), slice({es}, 1, 1)), ({a}, {b}) -> "
        f"(({a}.x2 - {a}.x1) * ({b}.y2 - {b}.y1) - ({a}.y2 - {a}.y1) * ({b}.x2 - {b}.x1)) / ({length(a)} * {length(b)} "
        f"+ ({a}.x2 - {a}.x1) * ({b}.x2 - {b}.x1) + ({a}.y2 - {a}.y1) * ({b}.y2 - {b}.y1)))")
    solved = geo.let(lambda es: geo.let(
        lambda p, k, lost: f"2 * {lost} / ({p} + sqrt(greatest({p} * {p} - 4 * {k} * {lost}, 0D)))",
        p=geo.total(geo.each(es, length)), k=bend(es), lost=f"ring_area * (1 - {share})"), es=geo._pairs("_ring"))
    sought = f"{ratio} < 0.999999D AND NOT _plain"
    swept = _even_inset(*(F.expr(f"CASE WHEN {sought} THEN {v} END") for v in (geo.flat_rings("rings"), _flat_edges("edges", "0D"), share, reach)))
    depth = F.expr(f"CASE WHEN {ratio} >= 0.999999D THEN 0D WHEN _plain THEN {solved} END")
    return df.withColumn("inset_m", F.coalesce(depth, swept)).drop("_ring", "_plain")


def narrow_contact(width: Column, contact: str = "contact_length_m") -> Column:
    """Whether a neighbour is a road that is narrower than four metres and touches."""
    return (width > 0) & (width < fv.ROAD_MIN_WIDTH_M) & (F.col(contact) > 0)


def road_setback(adj_roads: DataFrame) -> DataFrame:
    """Strip lost to widening roads narrower than four metres: contact × (4 − width) / 2.

    ``adj_roads`` holds road neighbours with contact_length_m, width_m and parcel area_m2.
    """
    narrow = adj_roads.filter(narrow_contact(F.col("width_m")))
    strip = geo.bround(F.col("contact_length_m") * ((fv.ROAD_MIN_WIDTH_M - F.col("width_m")) / 2), 1)
    narrow = narrow.withColumn("strip_m2", strip)
    return narrow.withColumn("remaining_m2", F.greatest(geo.bround(F.col("area_m2") - F.col("strip_m2"), 1), F.lit(0.0)))


LANDLOCKED = ["NO_CADASTRAL_ROAD", "NO_ROAD", "UNAVAILABLE"]


def division(parcels: DataFrame, shares: DataFrame, overlaps: DataFrame, strips: DataFrame | None = None, parcel_id: str = "pnu") -> DataFrame:
    """Whether splitting a parcel can yield a buildable lot.

    ``parcels``: one row with zone, area_m2, road_status; ``shares``: zone pieces;
    ``overlaps``: effective farmland/forest overlaps; ``strips``: from road_setback, or none
    where the parcels bring their number as ``road_methods``.
    """
    pieces = shares.filter(F.col("area_m2") > 0).groupBy(parcel_id).agg(
        F.count(F.lit(1)).alias("n"), F.sum((geo.bround("area_m2", 1) >= rules.minimum_lot(F.col("zone"))).cast("int")).alias("fit"))
    by_zone = pieces.filter(F.col("n") >= 2).select(parcel_id, F.col("fit").alias("zone_methods"))
    free = lambda share: geo.bround(F.col("area_m2") * (1 - share / 100), 1)
    lot = F.when(F.length("zone") > 0, rules.minimum_lot(F.col("zone"))).otherwise(0)
    # the overlaps of a parcel as a list: they meet its zone and area without the parcels being made a second time
    by_rule = (overlaps.filter((F.col("share_pct") > 0) & (F.col("share_pct") < 100))
               .groupBy(parcel_id).agg(F.collect_list("share_pct").alias("_shares")))
    j = parcels
    for part in (by_zone, by_rule, *([] if strips is None else [strips.groupBy(parcel_id).agg(F.count(F.lit(1)).alias("road_methods"))])):
        j = j.join(part, parcel_id, "left")
    j = j.withColumn("rule_methods", F.when((F.col("area_m2") > 0) & F.col("_shares").isNotNull(), F.size(F.filter("_shares", lambda s: free(s) >= lot)))).drop("_shares")
    count = sum((F.coalesce(c, F.lit(0)) for c in ("zone_methods", "rule_methods", "road_methods")), F.lit(0)).cast("bigint")
    locked = F.coalesce(F.col("road_status").isin(*LANDLOCKED), F.lit(False))
    status = F.when(locked, "NOT_FEASIBLE").when(F.col("methods") > 0, "FEASIBLE").otherwise("NOT_APPLICABLE")
    permit = rules.contains_any(F.coalesce("zone", F.lit("")), ["녹지", "관리지역", "농림", "자연환경보전"])
    return (j.withColumn("methods", count)
            .withColumns({"division_status": status, "landlocked": locked, "needs_dev_permit": permit,
                          "division_recommendation": F.when(F.col("methods") > 0, "OPTIONAL").otherwise("NONE")})
            .drop("zone_methods", "rule_methods", "road_methods"))


def largest_piece(shares: DataFrame, parcel_id: str = "pnu") -> DataFrame:
    """Largest zone piece of straddling parcels; becomes the lot after a division."""
    return (shares.filter(F.col("area_m2") > 0).groupBy(parcel_id).agg(
        F.count(F.lit(1)).alias("pieces"), F.min(F.struct((-F.col("area_m2")).alias("a"), "zone")).alias("b"))
        .filter(F.col("pieces") >= 2).select(parcel_id, F.col("b.zone").alias("zone"), (-F.col("b.a")).alias("area_m2")))


def divide_and_recompute(pieces: DataFrame, statutory: DataFrame, ordinance: DataFrame) -> DataFrame:
    """Limits, size and charges of the lot left after splitting off the largest zone piece.

    ``pieces`` carries the columns the charges need.  The piece's limits are its own
    zone's, not the weighted ones; pieces with unresolved limits are left out.
    """
    from .keys import resolve_limits
    lim = resolve_limits(pieces, statutory, ordinance).filter("found").withColumn("far_target_pct", F.lit(None).cast("double"))
    sized = measures.massing(lim).withColumn("conversion_area_m2", F.col("building_area_m2"))
    return measures.development_charge(measures.conversion_charge(sized))


def evaluate_uses(parcels: DataFrame, matrix: DataFrame, setback_rules: DataFrame, uses: list[str]) -> DataFrame:
    """Verdict and setbacks of every supported use on every parcel.

    Where a rule needs the subtype, its provisional preview distances are shown and
    marked.  ``uses`` is the fixed list of uses, so rows grow by that factor only.
    """
    all_uses = parcels.drop("building_use").withColumn("building_use", F.explode(F.array(*map(F.lit, uses))))
    judged = rules.setbacks(rules.use_verdict(all_uses, matrix), setback_rules)
    preview = F.col("setback_status") == "NEEDS_SUBTYPE"
    return judged.withColumns({
        "shown_front_m": F.when(preview, F.col("preview_front_m")).otherwise(F.col("front_m")),
        "shown_adjacent_m": F.when(preview, F.col("preview_adjacent_m")).otherwise(F.col("adjacent_m")),
        "provisional": preview & F.col("preview_front_m").isNotNull()})

"""Polygon mathematics as native SQL expressions.

A geometry is ``rings``, an array of arrays of (x, y) structs.  A single ring is
solid whatever its direction; of several, counter-clockwise ones are solid and
clockwise ones are holes (``oriented`` makes them so).  Everything that needs area or containment works on ``walls``: the
non-vertical ring edges written left to right as (lx, yl, rx, yr) with a sign,
+1 where the polygon lies below the edge and -1 where it lies above.  A polygon
is the signed sum of the regions under its walls, so areas, overlaps and point
tests are plain sums over walls: no predicates, no special cases for concave
shapes, and sums can be split over grid cells.

Functions take and return SQL text (one parse per expression instead of one
driver call per operation); ``let`` names intermediate values, because lambda
bodies are evaluated as trees and would recompute a value at every mention.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_A = 6378137.0  # WGS84 semi-major axis, m
EARTH_E2 = 0.0066943799901413165  # WGS84 first eccentricity squared

_names = itertools.count()


def _var() -> str:
    return f"v{next(_names)}"


def let(body, **values: str) -> str:
    """``body`` is called with names that stand for the given values."""
    v = _var()
    fields = ", ".join(f"'{k}', {x}" for k, x in values.items())
    return f"transform(array(named_struct({fields})), {v} -> {body(*[f'{v}.{k}' for k in values])})[0]"


def total(values: str) -> str:
    a, v = _var(), _var()
    return f"aggregate({values}, 0D, ({a}, {v}) -> {a} + {v})"


def each(array: str, body) -> str:
    v = _var()
    return f"transform({array}, {v} -> {body(v)})"


def keep(array: str, test) -> str:
    v = _var()
    return f"filter({array}, {v} -> {test(v)})"


def polygon(*points: tuple[str, str]) -> str:
    """Single-part geometry from (x, y) expressions."""
    pts = ", ".join(f"named_struct('x', double({x}), 'y', double({y}))" for x, y in points)
    return f"array(array({pts}))"


def rectangle(x0: str, y0: str, x1: str, y1: str) -> str:
    return polygon((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def _next(ring: str) -> str:
    return f"concat(slice({ring}, 2, greatest(size({ring}) - 1, 0)), slice({ring}, 1, 1))"


def _pairs(ring: str) -> str:
    """Directed edges of a ring; closes it and drops zero-length edges."""
    p, q = _var(), _var()
    edges = (f"zip_with({ring}, {_next(ring)}, ({p}, {q}) -> named_struct("
             f"'x1', {p}.x, 'y1', {p}.y, 'x2', {q}.x, 'y2', {q}.y))")
    return keep(edges, lambda e: f"{e}.x1 <> {e}.x2 OR {e}.y1 <> {e}.y2")


def ring_area(ring: str) -> str:
    """Signed planar area (positive when counter-clockwise)."""
    p, q = _var(), _var()
    ox, oy = f"{ring}[0].x", f"{ring}[0].y"
    return total(f"zip_with({ring}, {_next(ring)}, ({p}, {q}) -> "
                 f"(({p}.x - {ox}) * ({q}.y - {oy}) - ({q}.x - {ox}) * ({p}.y - {oy})) / 2)")


def turned(ring: str, hole: bool = False) -> str:
    """The ring counter-clockwise, or clockwise for a hole."""
    return f"CASE WHEN {ring_area(ring)} {'<=' if hole else '>='} 0 THEN {ring} ELSE reverse({ring}) END"


def oriented(parts: str) -> str:
    """Rings of polygons given as arrays of an outer ring and its holes."""
    return "flatten(" + each(keep(parts, lambda p: f"size({p}) > 0"), lambda p: (
        f"concat(array({turned(f'{p}[0]')}), {each(f'slice({p}, 2, size({p}))', lambda r: turned(r, True))})")) + ")"


def flat_rings(rings: str) -> str:
    """Rings as one array of numbers: the number of points, then x and y of each, ring by ring."""
    return "flatten(" + each(rings, lambda r: f"concat(array(double(size({r}))), flatten({each(r, lambda p: f'array({p}.x, {p}.y)')}))") + ")"


def flat_edges(edge_array: str) -> str:
    """Edges as one array of numbers, x1, y1, x2, y2 of each: less to move than structs."""
    return f"flatten({each(edge_array, lambda e: f'array({e}.x1, {e}.y1, {e}.x2, {e}.y2)')})"


def edges_of_flat(flat: str) -> str:
    at = _var()
    return (f"transform(filter(sequence(0, size({flat})), {at} -> {at} % 4 = 0 AND {at} < size({flat})), {at} -> named_struct("
            + ", ".join(f"'{c}', {flat}[{at} + {k}]" for k, c in enumerate(("x1", "y1", "x2", "y2"))) + "))")


def edges(rings: str) -> str:
    """Directed edges of all parts, the inside to their left."""
    def of(rs):
        return (f"flatten({each(rs, lambda r: f'CASE WHEN size({rs}) > 1 OR {ring_area(r)} >= 0 THEN {_pairs(r)} ELSE ' + _pairs(f'reverse({r})') + ' END')})")
    return let(of, rs=keep(rings, lambda r: f"size({r}) >= 3"))


def area(rings: str) -> str:
    """Planar area: solid rings less holes, rings under 3 points skipped."""
    return "abs(" + total(each(keep(rings, lambda r: f"size({r}) >= 3"), ring_area)) + ")"


def _authalic_q(lat: str) -> str:
    e = EARTH_E2 ** 0.5
    return let(lambda s: f"{1 - EARTH_E2!r}D * ({s} / (1 - {EARTH_E2!r}D * {s} * {s}) "
                         f"- ln((1 - {e!r}D * {s}) / (1 + {e!r}D * {s})) / {2 * e!r}D)", s=f"sin(radians({lat}))")


def geodesic_area(rings: str) -> str:
    """Ellipsoidal area (m2) of lon/lat rings.

    Uses the equal-area cylindrical image (x = a*lon, y = a*q(lat)/2) whose planar
    area is the area on the ellipsoid; edges are straight in that image, which for
    parcel-sized polygons agrees with geodesic edges to well below 0.1 m2.
    """
    return area(each(rings, lambda r: each(r, lambda p: (
        f"named_struct('x', radians({p}.x) * {EARTH_A}D, 'y', {_authalic_q(f'{p}.y')} * {EARTH_A / 2}D)"))))


def walls(edge_array: str) -> str:
    return each(keep(edge_array, lambda e: f"{e}.x1 <> {e}.x2"), lambda e: (
        f"CASE WHEN {e}.x1 < {e}.x2 THEN named_struct('lx', {e}.x1, 'yl', {e}.y1, 'rx', {e}.x2, 'yr', {e}.y2, 's', -1D) "
        f"ELSE named_struct('lx', {e}.x2, 'yl', {e}.y2, 'rx', {e}.x1, 'yr', {e}.y1, 's', 1D) END"))


def wall_y(w: str, x: str) -> str:
    return f"({w}.yl + ({w}.yr - {w}.yl) * ({x} - {w}.lx) / ({w}.rx - {w}.lx))"


def _under_both(a: str, b: str, base: str) -> str:
    """Signed area under both walls and above ``base`` (integral of the lower one)."""
    def lower(x0, x1):
        return let(lambda a0, a1, b0, b1: let(
            lambda d0, d1: (
                f"{a}.s * {b}.s * ({x1} - {x0}) * ({a0} + {a1} + {b0} + {b1} - CASE WHEN {d0} * {d1} >= 0 "
                f"THEN abs({d0} + {d1}) ELSE ({d0} * {d0} + {d1} * {d1}) / (abs({d0}) + abs({d1})) END) / 4"),
            d0=f"{a0} - {b0}", d1=f"{a1} - {b1}"),
            a0=f"{wall_y(a, x0)} - {base}", a1=f"{wall_y(a, x1)} - {base}",
            b0=f"{wall_y(b, x0)} - {base}", b1=f"{wall_y(b, x1)} - {base}")
    return let(lambda x0, x1: f"CASE WHEN {x1} > {x0} THEN {lower(x0, x1)} ELSE 0D END",
               x0=f"greatest({a}.lx, {b}.lx)", x1=f"least({a}.rx, {b}.rx)")


def overlap_area(walls_a: str, walls_b: str, base: str) -> str:
    """Exact area of the intersection of two polygons given by their walls.

    ``base`` is any y reference near the shapes; it cancels and only keeps the
    numbers small.
    """
    return total(each(walls_a, lambda a: total(each(walls_b, lambda b: _under_both(a, b, base)))))


def contains(wall_array: str, x: str, y: str) -> str:
    """Half-open even-odd point test: left/bottom boundary in, right/top out."""
    return total(each(wall_array, lambda w: (
        f"CASE WHEN {w}.lx <= {x} AND {x} < {w}.rx AND {y} < {wall_y(w, x)} THEN {w}.s ELSE 0D END"))) + " > 0.5D"


def _spans(wall_array: str, x: str) -> str:
    """Inside intervals (lo, hi) of a polygon along the vertical line at ``x``."""
    ys = each(keep(wall_array, lambda w: f"{w}.lx <= {x} AND {x} < {w}.rx"), lambda w: wall_y(w, x))
    i, k = _var(), _var()
    return let(lambda v: (
        f"transform(filter(sequence(0, greatest(size({v}) - 2, 0)), {k} -> {k} % 2 = 0 AND size({v}) >= 2), "
        f"{i} -> named_struct('lo', {v}[{i}], 'hi', {v}[{i} + 1]))"), v=f"array_sort({ys})")


def union_area(walls_a: str, pieces: str) -> str:
    """Area of polygon ``a`` covered by at least one of ``pieces`` (array of wall arrays).

    Between two neighbouring vertex or crossing positions every wall keeps its order,
    so the covered length at the middle of each such slab times its width is exact.
    """
    def crossing(p, q):
        def at(sp, sq):
            x = f"({q}.yl - {p}.yl + {sp} * {p}.lx - {sq} * {q}.lx) / ({sp} - {sq})"
            return let(lambda x: f"CASE WHEN {x} > greatest({p}.lx, {q}.lx) AND {x} < least({p}.rx, {q}.rx) THEN {x} END",
                       x=f"CASE WHEN {sp} <> {sq} THEN {x} END")
        slope = lambda w: f"({w}.yr - {w}.yl) / ({w}.rx - {w}.lx)"
        return let(at, sp=slope(p), sq=slope(q))

    def slabs(every):
        ends = f"concat({each(every, lambda w: f'{w}.lx')}, {each(every, lambda w: f'{w}.rx')})"
        cross = f"flatten({each(every, lambda p: each(every, lambda q: crossing(p, q)))})"
        cuts = f"array_sort(array_distinct(array_compact(concat({ends}, {cross}))))"
        return let(covered, c=cuts)

    def covered(c):
        p, q = _var(), _var()
        return total(f"zip_with(slice({c}, 1, size({c}) - 1), slice({c}, 2, size({c}) - 1), ({p}, {q}) -> "
                     f"({q} - {p}) * {let(length, m=f'({p} + {q}) / 2')})")

    def length(m):
        clipped = (f"flatten({each(_spans(walls_a, m), lambda u: each(f'flatten({each(pieces, lambda b: _spans(b, m))})', lambda s: (
            f'named_struct("lo", greatest({u}.lo, {s}.lo), "hi", least({u}.hi, {s}.hi))'.replace(chr(34), chr(39)))))})")
        acc, s, out = _var(), _var(), _var()
        return (f"aggregate(array_sort({keep(clipped, lambda s: f'{s}.hi > {s}.lo')}), "
                f"named_struct('len', 0D, 'end', double('-inf')), ({acc}, {s}) -> named_struct("
                f"'len', {acc}.len + greatest({s}.hi - greatest({s}.lo, {acc}.end), 0D), 'end', greatest({acc}.end, {s}.hi)), "
                f"{out} -> {out}.len)")

    return let(slabs, every=f"concat({walls_a}, flatten({pieces}))")


def clip_walls(wall_array: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Walls of the polygon cut to a box: x is trimmed, y is clamped.

    Clamping keeps the signed sum exact inside the box, so pieces of one polygon in
    different grid cells add up to the whole.
    """
    def clamp(v):
        return f"least(greatest({v}, {y0}), {y1})"

    def pieces(w):
        def cross(level, xa, xb):
            hit = (f"CASE WHEN {w}.yr <> {w}.yl THEN {w}.lx + ({level} - {w}.yl) * ({w}.rx - {w}.lx) / ({w}.yr - {w}.yl) END")
            return f"least(greatest(coalesce({hit}, {xa}), {xa}), {xb})"

        def piece(a, b):
            return (f"named_struct('lx', {a}, 'yl', {clamp(wall_y(w, a))}, 'rx', {b}, 'yr', {clamp(wall_y(w, b))}, 's', {w}.s)")

        return let(lambda xa, xb: let(
            lambda c0, c1: let(
                lambda lo, hi: f"array({piece(xa, lo)}, {piece(lo, hi)}, {piece(hi, xb)})",
                lo=f"least({c0}, {c1})", hi=f"greatest({c0}, {c1})"),
            c0=cross(y0, xa, xb), c1=cross(y1, xa, xb)),
            xa=f"greatest({w}.lx, {x0})", xb=f"least({w}.rx, {x1})")

    near = keep(wall_array, lambda w: f"{w}.lx < {x1} AND {w}.rx > {x0}")
    return keep(f"flatten({each(near, pieces)})", lambda w: f"{w}.rx > {w}.lx")


def bbox(rings: str) -> dict[str, Column]:
    xs, ys = (f"flatten({each(rings, lambda r: each(r, lambda p: f'{p}.{c}'))})" for c in "xy")
    return {"minx": F.expr(f"array_min({xs})"), "miny": F.expr(f"array_min({ys})"),
            "maxx": F.expr(f"array_max({xs})"), "maxy": F.expr(f"array_max({ys})")}


def outline(rings: str) -> str:
    """Struct of the edges and the box of a geometry."""
    xs, ys = (f"flatten({each(rings, lambda r: each(r, lambda p: f'{p}.{c}'))})" for c in "xy")
    return let(lambda e, xs, ys: (f"named_struct('edges', {e}, 'minx', array_min({xs}), 'miny', array_min({ys}), "
                                  f"'maxx', array_max({xs}), 'maxy', array_max({ys}))"), e=edges(rings), xs=xs, ys=ys)


def _nearest_on_edge(px: str, py: str, e: str) -> str:
    """(d, x, y): distance to and position of the closest point of an edge."""
    def at(t):
        return let(lambda nx, ny: f"named_struct('d', hypot({px} - {nx}, {py} - {ny}), 'x', {nx}, 'y', {ny})",
                   nx=f"{e}.x1 + {t} * ({e}.x2 - {e}.x1)", ny=f"{e}.y1 + {t} * ({e}.y2 - {e}.y1)")
    along = (f"(({px} - {e}.x1) * ({e}.x2 - {e}.x1) + ({py} - {e}.y1) * ({e}.y2 - {e}.y1)) / "
             f"(({e}.x2 - {e}.x1) * ({e}.x2 - {e}.x1) + ({e}.y2 - {e}.y1) * ({e}.y2 - {e}.y1))")
    return let(at, t=f"least(greatest({along}, 0D), 1D)")


def nearest_on(edge_array: str, px: str, py: str) -> str:
    """Closest boundary point as (d, x, y); equal distances resolve to the lowest (x, y)."""
    return f"array_min({each(edge_array, lambda e: _nearest_on_edge(px, py, e))})"


def _near_interval(a: str, b: str, tol: float) -> str:
    """Part (t0, t1) of edge ``a`` within ``tol`` of edge ``b`` (a capsule, hence one interval).

    ``a`` carries its unit direction and length (ux, uy, ln); positions run along it.
    """
    span = lambda t0, t1: f"named_struct('t0', {t0}, 't1', {t1})"

    def disc(px, py):
        return let(lambda at, off: (
            f"CASE WHEN abs({off}) <= {tol}D THEN "
            + span(f"{at} - sqrt({tol * tol!r}D - {off} * {off})", f"{at} + sqrt({tol * tol!r}D - {off} * {off})") + " END"),
            at=f"({px} - {a}.x1) * {a}.ux + ({py} - {a}.y1) * {a}.uy",
            off=f"({px} - {a}.x1) * {a}.uy - ({py} - {a}.y1) * {a}.ux")

    def slab(start, rate, lo, hi):
        return let(lambda s, r: (
            f"CASE WHEN abs({r}) < 1e-12D THEN CASE WHEN {s} >= {lo} AND {s} <= {hi} THEN {span('-1e18D', '1e18D')} END ELSE "
            + let(lambda p, q: span(f"least({p}, {q})", f"greatest({p}, {q})"),
                  p=f"({lo} - {s}) / {r}", q=f"({hi} - {s}) / {r}") + " END"), s=start, r=rate)

    def merged(p, q, d, e):
        return let(lambda k, s0, s1: span(
            f"greatest(least(CASE WHEN {k} THEN {s0} END, {d}.t0, {e}.t0), 0D)",
            f"least(greatest(CASE WHEN {k} THEN {s1} END, {d}.t1, {e}.t1), {a}.ln)"),
            k=f"{p}.t0 IS NOT NULL AND {q}.t0 IS NOT NULL AND greatest({p}.t0, {q}.t0) <= least({p}.t1, {q}.t1)",
            s0=f"greatest({p}.t0, {q}.t0)", s1=f"least({p}.t1, {q}.t1)")

    def spans(lb):
        def inner(vx, vy):
            rx, ry = f"({a}.x1 - {b}.x1)", f"({a}.y1 - {b}.y1)"
            return let(merged,
                       p=slab(f"{rx} * {vx} + {ry} * {vy}", f"{a}.ux * {vx} + {a}.uy * {vy}", "0D", lb),
                       q=slab(f"{rx} * {vy} - {ry} * {vx}", f"{a}.ux * {vy} - {a}.uy * {vx}", f"{-tol}D", f"{tol}D"),
                       d=disc(f"{b}.x1", f"{b}.y1"), e=disc(f"{b}.x2", f"{b}.y2"))
        return let(inner, vx=f"({b}.x2 - {b}.x1) / {lb}", vy=f"({b}.y2 - {b}.y1) / {lb}")

    return let(spans, lb=f"hypot({b}.x2 - {b}.x1, {b}.y2 - {b}.y1)")


def contact_lengths(edges_a: str, edges_b: str, tol: float) -> str:
    """Per edge of ``a``: its length lying within ``tol`` of boundary ``b``."""
    def with_direction(a):
        return let(lambda ln: (
            f"named_struct('x1', {a}.x1, 'y1', {a}.y1, 'ux', ({a}.x2 - {a}.x1) / {ln}, 'uy', ({a}.y2 - {a}.y1) / {ln}, 'ln', {ln}, "
            f"'lo_x', least({a}.x1, {a}.x2) - {tol}D, 'hi_x', greatest({a}.x1, {a}.x2) + {tol}D, "
            f"'lo_y', least({a}.y1, {a}.y2) - {tol}D, 'hi_y', greatest({a}.y1, {a}.y2) + {tol}D)"),
            ln=f"hypot({a}.x2 - {a}.x1, {a}.y2 - {a}.y1)")

    def per_edge(a):
        close = keep(edges_b, lambda b: (
            f"least({b}.x1, {b}.x2) <= {a}.hi_x AND greatest({b}.x1, {b}.x2) >= {a}.lo_x AND "
            f"least({b}.y1, {b}.y2) <= {a}.hi_y AND greatest({b}.y1, {b}.y2) >= {a}.lo_y"))
        spans = keep(each(close, lambda b: _near_interval(a, b, tol)), lambda s: f"{s}.t1 > {s}.t0")
        acc, s, out = _var(), _var(), _var()
        return (f"aggregate(array_sort({spans}), named_struct('len', 0D, 'end', -1D), ({acc}, {s}) -> named_struct("
                f"'len', {acc}.len + greatest({s}.t1 - greatest({s}.t0, {acc}.end), 0D), 'end', greatest({acc}.end, {s}.t1)), "
                f"{out} -> {out}.len)")

    return each(each(edges_a, with_direction), per_edge)


def clip_half_plane(ring: str, nx: str, ny: str, c: str) -> str:
    """Part of a convex ring with nx*x + ny*y <= c."""
    p, q = _var(), _var()
    sided = each(ring, lambda v: f"named_struct('x', {v}.x, 'y', {v}.y, 'd', {nx} * {v}.x + {ny} * {v}.y - {c})")

    def cut(r):
        point = f"named_struct('x', {p}.x, 'y', {p}.y)"
        cross = (f"named_struct('x', {p}.x + ({q}.x - {p}.x) * {p}.d / ({p}.d - {q}.d), "
                 f"'y', {p}.y + ({q}.y - {p}.y) * {p}.d / ({p}.d - {q}.d))")
        return (f"flatten(zip_with({r}, {_next(r)}, ({p}, {q}) -> CASE "
                f"WHEN {p}.d <= 0 AND ({p}.d < 0 AND {q}.d > 0) THEN array({point}, {cross}) "
                f"WHEN {p}.d <= 0 THEN array({point}) WHEN {q}.d < 0 THEN array({cross}) "
                f"ELSE array_remove(array({point}), {point}) END))")
    return let(cut, r=sided)


def inset(ring: str, setbacks: str) -> str:
    """Convex ring cut back from each edge; ``setbacks`` holds (x1, y1, x2, y2, d) structs."""
    acc, e = _var(), _var()
    nx, ny = f"({e}.y2 - {e}.y1)", f"({e}.x1 - {e}.x2)"  # outward, length of the edge
    step = clip_half_plane(acc, nx, ny, f"({nx} * {e}.x1 + {ny} * {e}.y1 - {e}.d * hypot({nx}, {ny}))")
    return f"aggregate({setbacks}, {ring}, ({acc}, {e}) -> {step})"


def ring_area_abs(ring: str) -> str:
    return let(lambda r: f"CASE WHEN size({r}) >= 3 THEN abs({ring_area(r)}) ELSE 0D END", r=ring)


def transverse_mercator(lon: str, lat: str, lon0: float, lat0: float, k0: float, fe: float, fn: float,
                        a: float = EARTH_A, e2: float = 0.006694380022900787) -> str:
    """Forward transverse Mercator series (Snyder) as an (x, y) struct in metres."""
    ep2 = e2 / (1 - e2)

    def meridian(p):
        return (f"{a}D * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r}D * {p} "
                f"- {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r}D * sin(2 * {p}) "
                f"+ {15 * e2**2 / 256 + 45 * e2**3 / 1024!r}D * sin(4 * {p}) - {35 * e2**3 / 3072!r}D * sin(6 * {p}))")

    def series(n, t, c, q, tan, m):
        x = (f"{fe}D + {k0}D * {n} * ({q} + (1 - {t} + {c}) * power({q}, 3) / 6 "
             f"+ (5 - 18 * {t} + {t} * {t} + 72 * {c} - {58 * ep2!r}D) * power({q}, 5) / 120)")
        y = (f"{fn}D + {k0}D * ({m} + {n} * {tan} * ({q} * {q} / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * power({q}, 4) / 24 "
             f"+ (61 - 58 * {t} + {t} * {t} + 600 * {c} - {330 * ep2!r}D) * power({q}, 6) / 720))")
        return f"named_struct('x', {x}, 'y', {y})"

    return let(lambda phi, lam: let(
        series, n=f"{a}D / sqrt(1 - {e2!r}D * sin({phi}) * sin({phi}))", t=f"tan({phi}) * tan({phi})",
        c=f"{ep2!r}D * cos({phi}) * cos({phi})", q=f"{lam} * cos({phi})", tan=f"tan({phi})",
        m=f"{meridian(phi)} - {meridian(f'radians({lat0}D)')}"),
        phi=f"radians({lat})", lam=f"radians({lon} - {lon0}D)")


def inverse_transverse_mercator(x: str, y: str, lon0: float, lat0: float, k0: float, fe: float, fn: float,
                                a: float = EARTH_A, e2: float = 0.006694380022900787) -> str:
    """Longitude and latitude, in degrees, as an (x, y) struct: the series back from metres (Snyder)."""
    ep2 = e2 / (1 - e2)
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    scale = a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    p0 = math.radians(lat0)
    m0 = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p0 - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p0)
              + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p0) - 35 * e2**3 / 3072 * math.sin(6 * p0))

    def foot(mu):
        return (f"{mu} + {3 * e1 / 2 - 27 * e1**3 / 32!r}D * sin(2 * {mu}) + {21 * e1**2 / 16 - 55 * e1**4 / 32!r}D * sin(4 * {mu}) "
                f"+ {151 * e1**3 / 96!r}D * sin(6 * {mu}) + {1097 * e1**4 / 512!r}D * sin(8 * {mu})")

    def degrees(phi, n, r, t, c, d):
        lat = (f"{phi} - {n} * tan({phi}) / {r} * ({d} * {d} / 2 - (5 + 3 * {t} + 10 * {c} - 4 * {c} * {c} - {9 * ep2!r}D) * power({d}, 4) / 24 "
               f"+ (61 + 90 * {t} + 298 * {c} + 45 * {t} * {t} - {252 * ep2!r}D - 3 * {c} * {c}) * power({d}, 6) / 720)")
        lon = (f"({d} - (1 + 2 * {t} + {c}) * power({d}, 3) / 6 + (5 - 2 * {c} + 28 * {t} - 3 * {c} * {c} + {8 * ep2!r}D + 24 * {t} * {t}) * power({d}, 5) / 120) / cos({phi})")
        return f"named_struct('x', {lon0!r}D + degrees({lon}), 'y', degrees({lat}))"

    def curved(phi, s):
        return let(lambda phi, n, r: let(lambda phi, n, r, t, c, d: degrees(phi, n, r, t, c, d), phi=phi, n=n, r=r, t=f"tan({phi}) * tan({phi})",
                                         c=f"{ep2!r}D * cos({phi}) * cos({phi})", d=f"({x} - {fe!r}D) / ({n} * {k0!r}D)"),
                   phi=phi, n=f"{a!r}D / sqrt({s})", r=f"{a * (1 - e2)!r}D / power({s}, 1.5D)")

    return let(lambda mu: let(lambda phi: let(lambda phi, s: curved(phi, s), phi=phi, s=f"1 - {e2!r}D * sin({phi}) * sin({phi})"), phi=foot(mu)),
               mu=f"({m0!r}D + ({y} - {fn!r}D) / {k0!r}D) / {scale!r}D")


def datum_shift(lon: str, lat: str, source: tuple[float, float], target: tuple[float, float], shift: tuple[float, ...], back: bool = False) -> str:
    """Degrees on another ellipsoid, at height 0: a similarity transform of geocentric coordinates.

    Ellipsoids are (semi-major axis, first eccentricity squared); ``shift`` holds three metres, three arc
    seconds (position vector rotation) and parts per million; ``back`` undoes it.
    """
    (a, e2), (a2, f2) = source, target
    tx, ty, tz = shift[:3]
    rx, ry, rz = (math.radians(s / 3600) for s in shift[3:6])
    m = 1 + shift[6] * 1e-6
    b2 = a2 * (1 - f2) ** 0.5

    def moved(x, y, z):
        if back:
            return let(lambda x, y, z: rotated(x, y, z, -rx, -ry, -rz, 1 / m, 0.0, 0.0, 0.0), x=f"{x} - {tx!r}D", y=f"{y} - {ty!r}D", z=f"{z} - {tz!r}D")
        return rotated(x, y, z, rx, ry, rz, m, tx, ty, tz)

    def rotated(x, y, z, rx, ry, rz, m, tx, ty, tz):
        return let(geodetic, x=f"{tx!r}D + {m!r}D * ({x} - {rz!r}D * {y} + {ry!r}D * {z})", y=f"{ty!r}D + {m!r}D * ({rz!r}D * {x} + {y} - {rx!r}D * {z})",
                   z=f"{tz!r}D + {m!r}D * ({z} - {ry!r}D * {x} + {rx!r}D * {y})")

    def geodetic(x, y, z):
        return let(lambda p, t: (
            f"named_struct('x', degrees(atan2({y}, {x})), 'y', degrees(atan2({z} + {f2 / (1 - f2) * b2!r}D * power(sin({t}), 3), {p} - {f2 * a2!r}D * power(cos({t}), 3))))"),
            p=f"hypot({x}, {y})", t=f"atan2({z} * {a2!r}D, hypot({x}, {y}) * {b2!r}D)")

    return let(lambda lam, phi, n: let(moved, x=f"{n} * cos({phi}) * cos({lam})", y=f"{n} * cos({phi}) * sin({lam})", z=f"{n} * {1 - e2!r}D * sin({phi})"),
               lam=f"radians({lon})", phi=f"radians({lat})", n=f"{a!r}D / sqrt(1 - {e2!r}D * power(sin(radians({lat})), 2))")


def bround(col: Column | str, digits: int = 0) -> Column:
    """Half-even rounding, the rule used for every reported number."""
    col = F.col(col) if isinstance(col, str) else col
    if digits == 0:
        return F.rint(col)
    scale = float(10 ** digits)
    return F.rint(col * scale) / scale

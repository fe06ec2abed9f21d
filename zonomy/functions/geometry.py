"""Boxes, rings, segments and map projections as column expressions.

A box is ``struct<minx, miny, maxx, maxy>``; a ring is ``array<struct<x, y>>`` without a
repeated last point. Everything is in metres unless a name says lon/lat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from zonomy.functions.common import col

# WGS84 ellipsoid, mean Earth radius in km, authalic cylinder at 30 degrees.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
EARTH_KM = 6371.0088
STANDARD_PARALLEL = 30.0


def box(minx: Column | str, miny: Column | str, maxx: Column | str, maxy: Column | str) -> Column:
    d = lambda c, n: col(c).cast("double").alias(n)
    return F.struct(d(minx, "minx"), d(miny, "miny"), d(maxx, "maxx"), d(maxy, "maxy"))


def point_box(x: Column | str, y: Column | str) -> Column:
    return box(x, y, x, y)


def width(b: Column) -> Column:
    return b["maxx"] - b["minx"]


def height(b: Column) -> Column:
    return b["maxy"] - b["miny"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def perimeter(b: Column) -> Column:
    return 2 * (width(b) + height(b))


def centre(b: Column) -> tuple[Column, Column]:
    return (b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2


def expand(b: Column, by: Column | float) -> Column:
    d = by if isinstance(by, Column) else F.lit(float(by))
    return box(b["minx"] - d, b["miny"] - d, b["maxx"] + d, b["maxy"] + d)


def intersects(a: Column, b: Column) -> Column:
    """Closed test: a shared edge or corner counts."""
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def overlaps(a: Column, b: Column) -> Column:
    """Positive shared area."""
    return (a["minx"] < b["maxx"]) & (b["minx"] < a["maxx"]) & (a["miny"] < b["maxy"]) & (b["miny"] < a["maxy"])


def contains(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["minx"]) & (a["maxx"] >= b["maxx"]) & (a["miny"] <= b["miny"]) & (a["maxy"] >= b["maxy"])


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["minx"], b["maxx"]) & y.between(b["miny"], b["maxy"])


def intersection(a: Column, b: Column) -> Column:
    return box(
        F.greatest(a["minx"], b["minx"]), F.greatest(a["miny"], b["miny"]),
        F.least(a["maxx"], b["maxx"]), F.least(a["maxy"], b["maxy"]),
    )


def shared_area(a: Column, b: Column) -> Column:
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def shared_edge(a: Column, b: Column) -> Column:
    """Length of the common side of two boxes that touch without overlapping."""
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.when((w == 0) & (h > 0), h).when((h == 0) & (w > 0), w).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    dx = F.greatest(a["minx"] - b["maxx"], b["minx"] - a["maxx"], F.lit(0.0))
    dy = F.greatest(a["miny"] - b["maxy"], b["miny"] - a["maxy"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def shape_index(area_: Column, perimeter_: Column) -> Column:
    """P^2 / (4 pi A): 1 for a circle, 1.273 for a square, infinite without area."""
    return F.when(area_ > 0, perimeter_ * perimeter_ / (4 * math.pi * area_)).otherwise(F.lit(float("inf")))


def compactness(area_: Column, perimeter_: Column) -> Column:
    return F.when(perimeter_ > 0, 4 * math.pi * area_ / (perimeter_ * perimeter_)).otherwise(F.lit(0.0))


def elongation(b: Column) -> Column:
    long_ = F.greatest(width(b), height(b))
    return F.when(long_ > 0, 1 - F.least(width(b), height(b)) / long_).otherwise(F.lit(0.0))


def fits_square(b: Column, side: float) -> Column:
    return (F.least(width(b), height(b)) > side)


def small_or_thin(b: Column, min_area: float, corridor: float) -> Column:
    """Below the area floor, or nothing left after shrinking by half the corridor width."""
    return (area(b) < min_area) | (F.least(width(b), height(b)) <= corridor)


def oversize_core(b: Column, limit_m2: float = 1.5e6, radius: float = 350.0) -> Column:
    """Shapes above the area limit shrink to the square of ``radius`` around their centre."""
    cx, cy = centre(b)
    core = intersection(b, box(cx - radius, cy - radius, cx + radius, cy + radius))
    return F.when(area(b) > limit_m2, core).otherwise(b)


def shape_id(aoi: Column | str, b: Column) -> Column:
    """Stable 16-hex id of an area name and the coordinates of a shape."""
    coords = F.concat_ws(",", *[F.format_string("%.3f", b[n]) for n in ("minx", "miny", "maxx", "maxy")])
    return F.substring(F.sha2(F.concat_ws("|", col(aoi), coords), 256), 1, 16)


# ── rings ────────────────────────────────────────────────────────────────────


def ring_of(b: Column) -> Column:
    p = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(p("minx", "miny"), p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy"))


def _edges(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct(
        a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def _fold(ring: Column, f) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + f(e))


def ring_signed_area(ring: Column) -> Column:
    return _fold(ring, lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(ring_signed_area(ring))


def ring_perimeter(ring: Column) -> Column:
    return _fold(ring, lambda e: F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    cross = lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]
    six_a = 6 * ring_signed_area(ring)
    return (
        _fold(ring, lambda e: (e["x0"] + e["x1"]) * cross(e)) / six_a,
        _fold(ring, lambda e: (e["y0"] + e["y1"]) * cross(e)) / six_a,
    )


def ring_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting; a point on the lower or left edge is inside, on the upper or right edge outside."""
    hits = F.filter(_edges(ring), lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (
        x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]))
    return F.size(hits) % 2 == 1


def finite_ring(ring: Column) -> Column:
    """At least three points, all coordinates finite, positive area."""
    big = float("inf")
    bad = F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])
                   | (F.abs(p["x"]) == big) | (F.abs(p["y"]) == big))
    return ring.isNotNull() & (F.size(ring) >= 3) & ~bad & (ring_area(ring) > 0)


# ── segments ─────────────────────────────────────────────────────────────────


def clipped_length(x0: Column, y0: Column, x1: Column, y1: Column, b: Column) -> Column:
    """Length of the part of a segment inside a box (Liang-Barsky parameters)."""
    dx, dy = x1 - x0, y1 - y0

    def bounds(d: Column, p: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, z = (low - p) / d, (high - p) / d
        inside = p.between(low, high)
        enter = F.when(d == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(a, z))
        leave = F.when(d == 0, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(a, z))
        return enter, leave

    ex, lx = bounds(F.when(dx != 0, dx).otherwise(F.lit(0.0)), x0, b["minx"], b["maxx"])
    ey, ly = bounds(F.when(dy != 0, dy).otherwise(F.lit(0.0)), y0, b["miny"], b["maxy"])
    t0, t1 = F.greatest(ex, ey, F.lit(0.0)), F.least(lx, ly, F.lit(1.0))
    return F.when(t1 > t0, (t1 - t0) * F.hypot(dx, dy)).otherwise(F.lit(0.0))


# ── lon/lat ──────────────────────────────────────────────────────────────────


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def utm_zone(lon: Column | str) -> Column:
    return (F.floor((col(lon) + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column | str, lat: Column | str) -> Column:
    return F.when(col(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def utm_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def equal_area_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area coordinates on the ellipsoid."""
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    s0 = math.sin(math.radians(STANDARD_PARALLEL))
    k0 = math.cos(math.radians(STANDARD_PARALLEL)) / math.sqrt(1 - e2 * s0 * s0)
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return F.radians(lon) * (WGS84_A * k0), q * (WGS84_A / (2 * k0))


_N = WGS84_F / (2 - WGS84_F)
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Third-order series of the transverse Mercator projection and its inverse.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _sinh(x: Column) -> Column:
    return (F.exp(x) - F.exp(-x)) / 2


def _cosh(x: Column) -> Column:
    return (F.exp(x) + F.exp(-x)) / 2


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def utm_xy(lon: Column, lat: Column, meridian: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing of a zone given by its central meridian."""
    e_ = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    t = _sinh(_atanh(s) - e_ * _atanh(e_ * s))
    d = F.radians(lon - meridian)
    xi = F.atan2(t, F.cos(d))
    eta = _atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        x = x + a * F.cos(2 * j * xi) * _sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * _cosh(2 * j * eta)
    shift = F.when(south if south is not None else lat < 0, F.lit(1.0e7)).otherwise(F.lit(0.0))
    return x * (0.9996 * _RECT) + 500000.0, y * (0.9996 * _RECT) + shift


def utm_lonlat(x: Column, y: Column, meridian: Column, south: Column) -> tuple[Column, Column]:
    """Inverse of ``utm_xy``."""
    xi0 = (y - F.when(south, F.lit(1.0e7)).otherwise(F.lit(0.0))) / (0.9996 * _RECT)
    eta0 = (x - 500000.0) / (0.9996 * _RECT)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, start=1):
        xi = xi - b * F.sin(2 * j * xi0) * _cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * _sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / _cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, start=1):
        lat = lat + d * F.sin(2 * j * chi)
    return meridian + F.degrees(F.atan2(_sinh(eta), F.cos(xi))), F.degrees(lat)


def local_factor(tile_res_m: float, lat: Column) -> Column:
    """Degrees of latitude-corrected longitude per tile pixel at a centre point."""
    return F.lit(tile_res_m / 111320.0) / F.cos(F.radians(lat))

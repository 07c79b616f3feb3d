"""Geographic expressions: sphere, Lambert conformal conic plane, planar rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius in metres.
EARTH_RADIUS_M = 6_371_000.0

# Fixed values of EPSG:2154 (GRS80, two standard parallels).
LCC_A, LCC_F = 6378137.0, 1 / 298.257222101
LCC_LAT0, LCC_LON0, LCC_LAT1, LCC_LAT2 = 46.5, 3.0, 49.0, 44.0
LCC_X0, LCC_Y0 = 700000.0, 6600000.0
LCC_E = math.sqrt(LCC_F * (2 - LCC_F))


def _lcc_m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (LCC_E * math.sin(lat)) ** 2)


def _lcc_t(lat: float) -> float:
    s = LCC_E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (LCC_E / 2)


_P0, _P1, _P2 = (math.radians(x) for x in (LCC_LAT0, LCC_LAT1, LCC_LAT2))
LCC_N = (math.log(_lcc_m(_P1)) - math.log(_lcc_m(_P2))) / (math.log(_lcc_t(_P1)) - math.log(_lcc_t(_P2)))
LCC_C = _lcc_m(_P1) / (LCC_N * _lcc_t(_P1) ** LCC_N)
LCC_RHO0 = LCC_A * LCC_C * _lcc_t(_P0) ** LCC_N


def lcc_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Plane metres of a longitude and latitude in degrees; null stays null."""
    phi = F.radians(lat)
    s = LCC_E * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(LCC_E / 2))
    rho = LCC_A * LCC_C * F.pow(t, F.lit(LCC_N))
    theta = LCC_N * F.radians(lon - LCC_LON0)
    return LCC_X0 + rho * F.sin(theta), LCC_Y0 + LCC_RHO0 - rho * F.cos(theta)


def lcc_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of plane metres; the latitude by five fixed-point steps."""
    dx, dy = x - LCC_X0, LCC_RHO0 - (y - LCC_Y0)
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / (LCC_A * LCC_C), F.lit(1 / LCC_N))
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(5):
        s = LCC_E * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(LCC_E / 2)))
    return LCC_LON0 + F.degrees(F.atan2(dx, dy)) / LCC_N, F.degrees(phi)


def great_circle_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance in metres on the sphere."""
    p, q = F.radians(lat_a), F.radians(lat_b)
    u = F.sin((q - p) / 2)
    v = F.sin(F.radians(lon_b - lon_a) / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(u * u + F.cos(p) * F.cos(q) * v * v)))


def usable_place(lat: Column, lon: Column) -> Column:
    """False for null, NaN, out of range and the placeholder (0, 0); never null."""
    inside = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(inside, F.lit(False))


def polygon_rings(wkt: Column) -> Column:
    """Rings of a WKT POLYGON or MULTIPOLYGON as ``array<array<struct<x,y>>>``; null if there is none.

    Holes and parts are listed alike: the even-odd rule needs no more.
    """
    body = F.regexp_extract(wkt, r"(?is)^\s*(?:SRID\s*=\s*\d+\s*;\s*)?(?:MULTI)?POLYGON\s*Z?\s*\((.*)\)\s*$", 1)
    flat = F.regexp_replace(body, r"\)\s*,\s*\(", "|")
    flat = F.regexp_replace(flat, r"[()]", "")
    point = lambda p: F.struct(
        F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).try_cast("double").alias("x"),
        F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y"),
    )
    rings = F.transform(F.split(flat, r"\|"), lambda r: F.transform(F.split(r, ","), point))
    good = F.forall(rings, lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.when((F.length(F.trim(flat)) > 0) & good, rings)


def ring_edges(rings: Column) -> Column:
    """Edges ``array<struct<ax,ay,bx,by>>`` of all rings; an open ring is closed."""

    def edges(r: Column) -> Column:
        following = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
        return F.zip_with(
            r, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
        )

    return F.flatten(F.transform(rings, edges))


def on_boundary(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(
        edges,
        lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"]))
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )


def inside_rings(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point; either ring direction, holes and parts included."""
    crossings = F.aggregate(
        edges,
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def ring_area(edges: Column) -> Column:
    """Signed planar area (shoelace) of the edges."""
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2

"""Areas of intersections: polygons over polygons, and buffers around points over polygons.

Candidates meet in an equi-join of grid cells on the plane; areas are computed in Arrow batches
by clipping. Any ring is cut into signed triangles from one of its points, and the intersection
of two triangles is a convex clip; sums of signed areas then hold for concave rings, holes and
parts. A ring that crosses itself is first split into simple lobes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from landweave.functions.columns import natural_class
from landweave.functions.geo import lcc_forward, lcc_inverse, polygon_rings
from landweave.operators.ranks import smallest_by_digest
from landweave.operators.regions import box_level, grid_index
from landweave.operators.scale import evaluated
from landweave.session import cut_lineage

#: Corners of the polygon that stands for a circle.
CORNERS = 64

Ring = list[tuple[float, float]]


def _signed_area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def simple_lobes(ring: Ring) -> list[Ring]:
    """The ring cut where it crosses itself, each lobe counter-clockwise; a simple ring as it is, counter-clockwise."""
    points = [p for i, p in enumerate(ring) if p != ring[i - 1]]
    n = len(points)
    for i in range(n):
        a, b = points[i], points[(i + 1) % n]
        for j in range(i + 2, n if i else n - 1):
            c, d = points[j], points[(j + 1) % n]
            cross = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if cross == 0:
                continue
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / cross
            u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / cross
            if 0 < t < 1 and 0 < u < 1:
                x = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                return simple_lobes([x, *points[i + 1 : j + 1]]) + simple_lobes([x, *points[j + 1 :], *points[: i + 1]])
    if n < 3:
        return []
    return [points if _signed_area(points) >= 0 else points[::-1]]


def signed_triangles(rings: list[Ring]) -> list[tuple[int, Ring]]:
    """Triangles whose signed sum is the region of the rings by the even-odd rule.

    A ring inside an odd number of others is a hole and counts negatively.
    """
    lobes = [lobe for r in rings for lobe in simple_lobes([tuple(p) for p in r])]

    def inside(p: tuple[float, float], ring: Ring) -> bool:
        odd = False
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
        return odd

    result = []
    for i, lobe in enumerate(lobes):
        middle = ((lobe[0][0] + lobe[1][0] + lobe[2][0]) / 3, (lobe[0][1] + lobe[1][1] + lobe[2][1]) / 3) if len(lobe) == 3 else ((lobe[0][0] + lobe[1][0]) / 2, (lobe[0][1] + lobe[1][1]) / 2)
        depth = sum(inside(middle, other) for j, other in enumerate(lobes) if j != i)
        sign = -1 if depth % 2 else 1
        for b, c in zip(lobe[1:], lobe[2:]):
            area = _signed_area([lobe[0], b, c])
            if area > 0:
                result.append((sign, [lobe[0], b, c]))
            elif area < 0:
                result.append((-sign, [lobe[0], c, b]))
    return result


def clip_area(subject: Ring, convex: Ring) -> float:
    """Area of the part of ``subject`` inside a counter-clockwise ``convex`` ring."""
    points = subject
    for a, b in zip(convex, convex[1:] + convex[:1]):
        dx, dy = b[0] - a[0], b[1] - a[1]
        sides = [dx * (p[1] - a[1]) - dy * (p[0] - a[0]) for p in points]
        kept: Ring = []
        for i, (p, s) in enumerate(zip(points, sides)):
            q, r = points[i - 1], sides[i - 1]
            if (s >= 0) != (r >= 0):
                t = r / (r - s)
                kept.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if s >= 0:
                kept.append(p)
        points = kept
        if len(points) < 3:
            return 0.0
    return abs(_signed_area(points))


def convex_ring(rings: list[Ring]) -> Ring | None:
    """The only ring counter-clockwise, if it is convex and winds once; else None."""
    if len(rings) != 1:
        return None
    ring = [p for i, p in enumerate(rings[0]) if p != rings[0][i - 1]]
    if len(ring) < 3:
        return None
    turns, turned = 0.0, []
    for i in range(len(ring)):
        a, b, c = ring[i - 2], ring[i - 1], ring[i]
        u, v = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
        cross = u[0] * v[1] - u[1] * v[0]
        turned.append(cross)
        turns += math.atan2(cross, u[0] * v[0] + u[1] * v[1])
    if abs(abs(turns) - 2 * math.pi) > 1e-6 or not (min(turned) >= 0 or max(turned) <= 0):
        return None
    return ring if turns > 0 else ring[::-1]


def region_area(a: list[Ring], b: list[Ring]) -> float:
    """Area of the intersection of two regions."""
    one, two = convex_ring(a), convex_ring(b)
    parts_a = [(1, one)] if one else signed_triangles(a)
    parts_b = [(1, two)] if two else signed_triangles(b)
    return max(0.0, sum(s * t * clip_area(x, y) for s, x in parts_a for t, y in parts_b))


def convex_parts(rings: list[Ring]) -> list[tuple[int, Ring]]:
    """Convex rings whose signed sum is the region: the only ring itself if it is convex, else triangles."""
    one = convex_ring(rings)
    return [(1, one)] if one else signed_triangles(rings)


def disc_areas(shapes: list[list[Ring]], radii: list[float]) -> np.ndarray:
    """Areas of regions inside the polygons that stand for circles around the origin, one row per region, one column per radius.

    Where no edge comes near a circle there is nothing to clip; what remains is clipped for all
    regions of a batch at once, edge by edge.
    """
    out = np.zeros((len(shapes), len(radii)))
    if not shapes:
        return out
    corners = [[p for r in rings for p in r] for rings in shapes]
    follow = [[p for r in rings for p in [*r[1:], r[0]]] for rings in shapes]
    a, b = (np.array([p for c in side for p in c], dtype=float).reshape(-1, 2) for side in (corners, follow))
    starts = np.r_[0, np.cumsum([len(c) for c in corners])]
    d = b - a
    length = (d * d).sum(1)
    t = np.clip(np.divide(-(a * d).sum(1), length, out=np.zeros(len(a)), where=length > 0), 0, 1)
    nearest2 = ((a + t[:, None] * d) ** 2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = 0 < d[:, 0] * -a[:, 1] / d[:, 1] + a[:, 0]
    crossing = ((a[:, 1] > 0) != (b[:, 1] > 0)) & right
    nearest2, odd = np.minimum.reduceat(nearest2, starts[:-1]), np.add.reduceat(crossing.astype(int), starts[:-1]) % 2 == 1
    whole = CORNERS / 2 * math.sin(2 * math.pi / CORNERS)
    for k, radius in enumerate(radii):
        far = nearest2 >= radius * radius
        out[far & odd, k] = whole * radius * radius
        near = np.flatnonzero(~far)
        if len(near):
            parts = [(i, sign, ring) for i in near for sign, ring in convex_parts(shapes[i])]
            clipped = _clip_discs([ring for _, _, ring in parts], radius)
            out[:, k] += np.bincount([i for i, _, _ in parts], weights=clipped * [sign for _, sign, _ in parts], minlength=len(shapes))
    return np.maximum(out, 0.0)


def _clip_discs(convex: list[Ring], radius: float) -> np.ndarray:
    """Areas of the circle's polygon inside counter-clockwise convex rings, all at once.

    A half-plane cuts a convex polygon in at most two places, so a polygon gains at most one
    corner by it. Polygons are rows of corners of equal width; unused places repeat the last
    corner, which changes no area.
    """
    if not convex:
        return np.zeros(0)
    points = np.repeat(np.array(circle(0.0, 0.0, radius))[None], len(convex), 0)
    size = np.array([len(r) for r in convex])
    width = int(size.max())
    rings = np.array([[*r, *[r[-1]] * (width - len(r))] for r in convex], dtype=float)
    rows = np.arange(len(convex))
    for e in range(width):
        last = e >= size - 1
        at, to = np.where(e >= size, size - 1, e), np.where(last, 0, e + 1)
        p, q = rings[rows, at], rings[rows, to]
        d = q - p
        side = d[:, None, 0] * (points[:, :, 1] - p[:, None, 1]) - d[:, None, 1] * (points[:, :, 0] - p[:, None, 0])
        side[e >= size] = 1.0  # this ring has no further edge
        before, before_side = np.roll(points, 1, axis=1), np.roll(side, 1, axis=1)
        cuts = (side >= 0) != (before_side >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(cuts, before_side / (before_side - side), 0.0)
        met = before + t[:, :, None] * (points - before)
        n = points.shape[1]
        both = np.empty((len(convex), 2 * n, 2))
        both[:, ::2], both[:, 1::2] = met, points
        keep = np.empty((len(convex), 2 * n), dtype=bool)
        keep[:, ::2], keep[:, 1::2] = cuts, side >= 0
        count = keep.sum(1)
        most = max(1, int(count.max()))
        order = np.argsort(~keep, axis=1, kind="stable")[:, :most]
        order = np.where(np.arange(most)[None] < count[:, None], order, order[rows, np.maximum(count - 1, 0)][:, None])
        points = both[rows[:, None], order]
        points[count == 0] = 0.0
    following = np.roll(points, -1, axis=1)
    return np.abs((points[:, :, 0] * following[:, :, 1] - following[:, :, 0] * points[:, :, 1]).sum(1)) / 2


def circle(x: float, y: float, radius: float) -> Ring:
    return [(x + radius * math.cos(2 * math.pi * k / CORNERS), y + radius * math.sin(2 * math.pi * k / CORNERS)) for k in range(CORNERS)]


# ---- planar tables -----------------------------------------------------------------------------


def planar(regions: DataFrame, key: str, wkt: str, keep: list[str], *, project: bool = True) -> DataFrame:
    """``key, keep, rings, minx, miny, maxx, maxy`` in plane metres (or in given units); unreadable and repeated rows dropped."""
    rows = regions.where(F.col(key).isNotNull()).select(key, *keep, wkt).distinct()
    rings = polygon_rings(F.col(wkt))
    if project:
        point = lambda p: F.struct(*[v.alias(n) for v, n in zip(lcc_forward(p["x"], p["y"]), "xy")])
        rings = F.transform(rings, lambda r: F.transform(r, point))
    read = evaluated(rows, {"rings": rings}).where(F.col("rings").isNotNull()).drop(wkt)
    side = lambda pick, axis: pick(F.transform(F.flatten("rings"), lambda p: p[axis]))
    box = {"minx": side(F.array_min, "x"), "maxx": side(F.array_max, "x"), "miny": side(F.array_min, "y"), "maxy": side(F.array_max, "y")}
    return evaluated(read, box).where(F.col("minx").isNotNull())


#: Width of the plane that the grid divides; coordinates are within it on both sides of 0.
SPAN = 2.0**26
#: Finest resolution of that grid; far below a metre, so that shapes in degrees have theirs as well.
FINEST = 44


def _entered(df: DataFrame, used: list[int], prefix: str) -> DataFrame:
    """Every row once for each cell that its box touches, at its own resolution (``own``) and all coarser ones in use.

    At none of them it touches more than four.
    """
    levels = F.filter(F.array(*[F.lit(n) for n in used]).cast("array<int>"), lambda n: n <= F.col("_level"))
    rows = df.withColumn("_at", F.explode(levels))
    span = lambda a, b: F.sequence(grid_index(F.col(a), F.col("_at"), SPAN), grid_index(F.col(b), F.col("_at"), SPAN))
    placed = rows.withColumn("_i", F.explode(span("minx", "maxx"))).withColumn("_j", F.explode(span("miny", "maxy")))
    named = placed.withColumn("_own", F.col("_at") == F.col("_level")).drop("_level")
    return named.select("_at", "_i", "_j", *[F.col(c).alias(f"{prefix}{c}") for c in named.columns if c not in ("_at", "_i", "_j")])


def box_candidates(left: DataFrame, right: DataFrame, *, extent: float | None = None) -> DataFrame:
    """Pairs of rows whose boxes meet, each once; the columns of ``right`` get the prefix ``r_``.

    Both sides are entered in a grid of several resolutions, and a pair meets at the coarser of
    its two own ones, in the cell of the lower left corner of the common box; so neither a huge
    box nor a tiny one multiplies rows, and nothing has to be made distinct. A cell with much
    more than its share is split by the adaptive planner. ``extent`` is the width of all boxes
    of ``left`` if it is one; then their resolution is known without looking at them.
    """
    sides = [df.withColumn("_level", box_level(SPAN, FINEST)) for df in (left, right)]
    if extent is not None:
        # one coarser than fits, so that rounding of a box's corners does no harm
        known = min(FINEST, max(0, math.floor(math.log2(SPAN / extent)) - 1))
        sides[0] = left.withColumn("_level", F.lit(known))
    levels = sides[1].select("_level") if extent is not None else sides[0].select("_level").unionByName(sides[1].select("_level"))
    used = sorted({r[0] for r in levels.distinct().collect()} | ({known} if extent is not None else set()))
    l, r = _entered(sides[0], used, ""), _entered(sides[1], used, "r_")
    corner = lambda a, b: grid_index(F.greatest(F.col(a), F.col(b)), F.col("_at"), SPAN)
    meets = (F.col("minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("maxx")) & (F.col("miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("maxy"))
    first = (F.col("_i") == corner("minx", "r_minx")) & (F.col("_j") == corner("miny", "r_miny"))
    return l.join(r, ["_at", "_i", "_j"]).where((F.col("_own") | F.col("r__own")) & meets & first).drop("_at", "_i", "_j", "_own", "r__own")


def _flat(rings: Column) -> Column:
    """Rings as flat arrays of numbers, which Arrow hands over without an object per point."""
    return F.transform(rings, lambda r: F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"]))))


def _read(rings: np.ndarray, x: float = 0.0, y: float = 0.0) -> list[Ring]:
    shapes = []
    for r in rings:
        flat = r.tolist()
        shapes.append([(a - x, b - y) for a, b in zip(flat[::2], flat[1::2])])
    return shapes


@F.pandas_udf(DoubleType())
def _intersection(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([region_area(_read(x), _read(y)) for x, y in zip(a, b)], dtype=float)


def _in_circles(radii: list[float]) -> Callable[..., Column]:
    """Areas of a region inside the circles of all radii around a point."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def areas(rings: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        found = disc_areas([_read(shape, cx, cy) for shape, cx, cy in zip(rings, x, y)], radii)
        return pd.Series(list(found), dtype=object)

    return areas


def overlay_shares(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """``key, label, area, share``: area of each label inside each region, and its share of what is covered.

    Both sides come from ``planar``. The share is of the intersected area, not of the region.
    """
    pairs = box_candidates(left.select(key, "rings", "minx", "miny", "maxx", "maxy"), right.select(label, "rings", "minx", "miny", "maxx", "maxy"))
    areas = pairs.withColumn("area", _intersection(_flat(F.col("rings")), _flat(F.col("r_rings")))).where(F.col("area") > 0)
    sums = areas.groupBy(key, F.col(f"r_{label}").alias(label)).agg(F.sum("area").alias("area"))
    totals = sums.groupBy(key).agg(F.sum("area").alias("_total"))
    return sums.join(totals, key).select(key, label, "area", (F.col("area") / F.col("_total")).alias("share"))


def overlapping(regions: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """``key`` of the regions that share area with any of the others; touching is not enough. Both sides come from ``planar``."""
    box = ["rings", "minx", "miny", "maxx", "maxy"]
    pairs = box_candidates(regions.select(key, *box), others.select(*box))
    return pairs.where(_intersection(_flat(F.col("rings")), _flat(F.col("r_rings"))) > 0).select(key).distinct()


def buffer_shares(points: DataFrame, regions: DataFrame, label: str, radii: list[float]) -> DataFrame:
    """``point columns, radius, label, share``: share of the buffer around a point that each label covers.

    ``points`` has plane coordinates ``x, y``; shares are of the buffer polygon's own area. A
    buffer that meets nothing gives no row. A region meets a point once, for all radii.
    """
    most = max(float(r) for r in radii)
    boxes = points.withColumns({"minx": F.col("x") - most, "maxx": F.col("x") + most, "miny": F.col("y") - most, "maxy": F.col("y") + most})
    pairs = box_candidates(boxes, regions.select(label, "rings", "minx", "miny", "maxx", "maxy"), extent=2 * most)
    whole = CORNERS / 2 * math.sin(2 * math.pi / CORNERS)
    covered = pairs.withColumn("_areas", _in_circles([float(r) for r in radii])(_flat(F.col("r_rings")), "x", "y"))
    each = F.array(*[F.struct(F.lit(float(r)).alias("radius"), (F.get("_areas", F.lit(i)) / (whole * r * r)).alias("share")) for i, r in enumerate(radii)])
    shares = covered.select(*points.columns, F.col(f"r_{label}").alias("label"), F.inline(each)).where(F.col("share") > 0)
    return shares.groupBy(*points.columns, "radius", "label").agg(F.sum("share").alias("share"))


def entropy(shares: Column) -> Column:
    """Shannon entropy (natural) of an array of shares; what is not positive does not count."""
    kept = F.filter(shares, lambda s: s > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, s: a - s / total * F.ln(s / total))).otherwise(0.0)


def normalized_entropy(shares: Column) -> Column:
    kept = F.filter(shares, lambda s: s > 0)
    return F.when(F.size(kept) > 1, entropy(shares) / F.ln(F.size(kept))).otherwise(0.0)


def spatial_confidence(points: DataFrame, shares: DataFrame, key: str, point_label: str, radii: list[float]) -> DataFrame:
    """Per point and radius: dominant label, shares, entropy, coverage; one row for each, even if nothing is covered."""
    spine = points.select(key, point_label).withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    per = shares.groupBy(key, "radius").agg(F.array_sort(F.collect_list(F.struct("label", "share"))).alias("list"))
    rows = spine.join(per, [key, "radius"], "left").withColumn("list", F.coalesce("list", F.expr("array()").cast("array<struct<label:string,share:double>>")))
    values = F.transform("list", lambda s: s["share"])
    best = F.array_max(values)
    dominant = F.element_at(F.filter("list", lambda s: s["share"] == best), 1)["label"]
    of_point = F.element_at(F.filter("list", lambda s: s["label"] == F.col(point_label)), 1)["share"]
    none = F.size("list") == 0
    return rows.select(
        key, point_label, F.col("radius").cast("int").alias("radius"),
        F.when(~none, dominant).alias("dominant_label"),
        F.when(none, 0.0).otherwise(best).alias("dominant_share"),
        F.coalesce(F.when(~none, of_point), F.lit(0.0)).alias("point_label_share"),
        F.when(none, False).otherwise(F.coalesce(dominant == F.col(point_label), F.lit(False))).alias("dominant_matches_point_label"),
        F.size("list").alias("num_labels"), entropy(values).alias("entropy"), normalized_entropy(values).alias("normalized_entropy"),
        F.least(F.aggregate(values, F.lit(0.0), lambda a, s: a + s), F.lit(1.0)).alias("coverage_share"),
        F.aggregate(F.filter("list", lambda s: s["label"].startswith("1")), F.lit(0.0), lambda a, s: a + s["share"]).alias("artificial_share"),
        F.map_from_entries("list").alias("label_shares"),
    )


def spatial_confidence_wide(long: DataFrame, key: str, point_label: str, radii: list[int]) -> DataFrame:
    """One row per point, nine columns per radius."""
    names = [c for c in long.columns if c not in (key, point_label, "radius")]
    picks = [F.any_value(F.when(F.col("radius") == r, F.col(n)), True).alias(f"{n}_{r}m") for r in radii for n in names]
    return long.groupBy(key, point_label).agg(*picks)


# ---- polygons by themselves --------------------------------------------------------------------

#: Square metres that a polygon must have to be shown on a map.
LEAST_MAP_AREA = 15_000.0


def _moments(rings: Column) -> Column:
    """STRUCT of signed area and first moments of the rings around their first point; holes must run against their outer ring."""
    origin = rings[0][0]

    def edge(a: Column, b: Column) -> Column:
        ax, ay, bx, by = a["x"] - origin["x"], a["y"] - origin["y"], b["x"] - origin["x"], b["y"] - origin["y"]
        cross = ax * by - bx * ay
        return F.struct((cross / 2).alias("a"), ((ax + bx) * cross / 6).alias("x"), ((ay + by) * cross / 6).alias("y"))

    def edges(r: Column) -> Column:
        return F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), edge)

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(F.flatten(F.transform(rings, edges)), zero, lambda s, e: F.struct((s["a"] + e["a"]).alias("a"), (s["x"] + e["x"]).alias("x"), (s["y"] + e["y"]).alias("y")))


def planar_areas(regions: DataFrame) -> DataFrame:
    """``regions`` of ``planar`` with ``area`` and the centre ``x, y``; rings and boxes are left out.

    A polygon without area has the first point for its centre.
    """
    rows = evaluated(regions, {"_m": _moments(F.col("rings"))})
    flat = F.col("_m")["a"] == 0
    at = lambda axis: F.col("rings")[0][0][axis] + F.when(flat, 0.0).otherwise(F.col("_m")[axis] / F.col("_m")["a"])
    measured = rows.withColumns({"area": F.abs(F.col("_m")["a"]), "x": at("x"), "y": at("y")})
    return measured.drop("_m", "rings", "minx", "miny", "maxx", "maxy")


def sample_polygons(polygons: DataFrame, n: int, *, level: int = 2, seed: int = 42, exclude_artificial: bool = False) -> DataFrame:
    """``id, code_18, class_label, geometry, x, y, lon, lat`` of ``n`` polygons by digest, with their centres on the plane and in degrees.

    ``class_label`` are the first ``level`` characters of the code; an unreadable polygon has no
    centre. More polygons than there are is an error.
    """
    rows = polygons.where(natural_class(F.col("code_18"))) if exclude_artificial else polygons
    # one rank over all: by digest buckets, so the polygons are never gathered
    drawn = smallest_by_digest(rows.withColumns({"_all": F.lit(0), "_n": F.lit(n)}), ["_all"], ["id"], "_n", seed).select("id", "code_18", "geometry")
    drawn = cut_lineage(drawn)
    if (have := drawn.count()) < n:
        raise ValueError(f"cannot sample {n} polygons of {have}{' that are not artificial' if exclude_artificial else ''}")
    centres = planar_areas(planar(drawn, "id", "geometry", [])).select("id", "x", "y")
    lon, lat = lcc_inverse(F.col("x"), F.col("y"))
    label = F.substring("code_18", 1, level)
    return drawn.join(F.broadcast(centres), "id", "left").select("id", "code_18", label.alias("class_label"), "geometry", "x", "y", lon.alias("lon"), lat.alias("lat"))

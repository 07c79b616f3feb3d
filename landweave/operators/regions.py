"""The region around a point: a grid of several resolutions, then the exact even-odd test.

Every region is entered at a resolution at which its bounding box touches few cells: at most
four, and more if it has many corners. A cell holds only those edges of the region that a ray
from a point in the cell to the right can meet, so neither a huge region nor one of very many
corners brings its whole outline to every point. A point asks one cell of each resolution that
is in use, and both sides meet in an equi-join, which the adaptive planner (on by default)
splits where one cell has much more than its share of the points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions.geo import inside_rings, on_boundary, polygon_rings, ring_edges
from landweave.operators.scale import evaluated

#: Finest resolution: cells of world / 2**LEVELS.
LEVELS = 24
#: A region of more edges than this is entered in finer cells, at most FINER resolutions finer.
EDGES, FINER = 16, 5


def prepared_regions(regions: DataFrame, key: str, wkt: str, keep: list[str]) -> DataFrame:
    """``key``, ``keep``, ``edges`` and the bounding box; unreadable and repeated rows are dropped."""
    rows = regions.where(F.col(key).isNotNull()).select(key, *keep, wkt).distinct()
    edges = evaluated(rows.select(key, *keep, wkt), {"edges": ring_edges(polygon_rings(F.col(wkt)))}).drop(wkt)
    side = lambda pick, axis: pick(F.transform("edges", lambda e: e[axis]))
    box = {"minx": side(F.array_min, "ax"), "maxx": side(F.array_max, "ax"), "miny": side(F.array_min, "ay"), "maxy": side(F.array_max, "ay")}
    return evaluated(edges.where(F.size("edges") >= 3), box)


def box_level(span: float, finest: int = LEVELS) -> Column:
    """The finest resolution at which the bounding box is no larger than a cell, so that it touches four at most."""
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(span / 2**finest))
    return F.least(F.lit(finest), F.greatest(F.lit(0), F.floor(F.log2(span / extent)))).cast("int")


def grid_index(value: Column, level: Column, span: float) -> Column:
    return F.floor(value * F.pow(F.lit(2.0), level) / span).cast("long")


def _cells(regions: DataFrame, span: float) -> DataFrame:
    """Every region once for each cell of its resolution that its box touches, with the edges that count there."""
    finer = F.least(F.lit(FINER), F.greatest(F.lit(0), F.floor(F.log2(F.size("edges") / EDGES) / 2))).cast("int")
    leveled = regions.withColumn("_level", F.least(F.lit(LEVELS), box_level(span) + finer))
    across = F.sequence(grid_index(F.col("minx"), F.col("_level"), span), grid_index(F.col("maxx"), F.col("_level"), span))
    down = F.sequence(grid_index(F.col("miny"), F.col("_level"), span), grid_index(F.col("maxy"), F.col("_level"), span))
    placed = leveled.withColumn("_i", F.explode(across)).withColumn("_j", F.explode(down))
    size = F.lit(span) / F.pow(F.lit(2.0), F.col("_level"))
    slack = span * 1e-12
    left, low, high = F.col("_i") * size - slack, F.col("_j") * size - slack, (F.col("_j") + 1) * size + slack
    near = F.filter("edges", lambda e: (F.greatest(e["ax"], e["bx"]) >= left) & (F.greatest(e["ay"], e["by"]) >= low) & (F.least(e["ay"], e["by"]) <= high))
    # a region of a few edges is not worth looking through
    return placed.withColumn("edges", F.when(F.size("edges") > EDGES, near).otherwise(F.col("edges")))


def locate(points: DataFrame, x: str, y: str, regions: DataFrame, *, span: float = 360.0, boundary: bool = True) -> DataFrame:
    """Inner join of ``points`` with the prepared ``regions`` that contain them.

    ``boundary`` tells whether points on an edge count. All columns of both sides come out but
    the regions' edges and boxes, so their names must differ; a point with a null coordinate or
    in no region gives no row.
    """
    cells = _cells(regions, span)
    # which resolutions are in use: at most LEVELS + 1 numbers
    used = sorted(r[0] for r in cells.select("_level").distinct().collect())
    asked = (
        points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .withColumn("_level", F.explode(F.array(*[F.lit(n) for n in used]).cast("array<int>")))
        .withColumns({"_i": grid_index(F.col(x), F.col("_level"), span), "_j": grid_index(F.col(y), F.col("_level"), span)})
    )
    inside = inside_rings(F.col("edges"), F.col(x), F.col(y))
    edge = on_boundary(F.col("edges"), F.col(x), F.col(y))
    exact = (inside | edge) if boundary else (inside & ~edge)
    return (
        asked.join(cells, ["_level", "_i", "_j"])
        .where(F.col(x).between(F.col("minx"), F.col("maxx")) & F.col(y).between(F.col("miny"), F.col("maxy")))
        .where(exact)
        .drop("_level", "_i", "_j", "edges", "minx", "maxx", "miny", "maxy")
    )

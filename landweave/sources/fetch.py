"""Contracts of external sources: what is asked for, tile by tile, and what is kept of the answers.

The network itself is behind a callable, so that a batch can be planned, resumed and tested
without it. Requests run inside ``mapInPandas``, one task per group of tiles or ids.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions.columns import bound, surely


def tiles(spark: SparkSession, *, west: float, south: float, east: float, north: float, width: float = 0.26, height: float = 0.18) -> DataFrame:
    """``i, j, west, south, east, north`` of the tiles of a bounding box, cut at its far edges."""
    n_x, n_y = max(1, math.ceil(round((east - west) / width, 9))), max(1, math.ceil(round((north - south) / height, 9)))
    grid = spark.range(n_x * n_y).select((F.col("id") % n_x).alias("i"), F.floor(F.col("id") / n_x).alias("j"))
    low = lambda start, step, at: F.lit(start) + F.col(at) * step
    return grid.select(
        "i", "j", F.round(low(west, width, "i"), 6).alias("west"), F.round(low(south, height, "j"), 6).alias("south"),
        F.round(F.least(F.lit(west) + (F.col("i") + 1) * width, F.lit(east)), 6).alias("east"),
        F.round(F.least(F.lit(south) + (F.col("j") + 1) * height, F.lit(north)), 6).alias("north"),
    )


def with_retries(ask: Callable[..., object], *args: object, attempts: int = 5, wait: float = 2.0, limited: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call ``ask`` until it answers; a ``BlockingIOError`` means "too many requests" and waits longer."""
    for attempt in range(attempts):
        try:
            return ask(*args)
        except BlockingIOError:
            pause = limited * (attempt + 1)
        except OSError:
            pause = wait * (attempt + 1)
        if attempt + 1 < attempts:
            sleep(pause)
    raise ConnectionError(f"no answer after {attempts} attempts")


def fetch_tiles(grid: DataFrame, ask: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows of all tiles; ``ask`` gets one tile and returns rows of ``schema``."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tile in batch.to_dict("records"):
                rows = with_retries(ask, tile)
                yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return grid.mapInPandas(run, schema)


def fetch_by_key(keys: DataFrame, key: str, ask: Callable[[list], dict], schema: str, batch: int = 50) -> DataFrame:
    """Rows for keys, asked in batches; keys that came back empty are asked once more, one by one."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            wanted = list(dict.fromkeys(frame[key]))
            for at in range(0, len(wanted), batch):
                part = wanted[at : at + batch]
                found = dict(with_retries(ask, part))
                for k in part:
                    if not found.get(k):
                        found |= with_retries(ask, [k]) or {}
                yield pd.DataFrame([[found[k].get(n) for n in names] for k in part if found.get(k)], columns=names)

    return keys.select(key).distinct().mapInPandas(run, schema)


def closed_ring(points: Column) -> Column:
    """A ring of at least four points that ends where it begins."""
    return surely((F.size(points) >= 4) & (points[0] == F.element_at(points, -1)))


def simple_ring(points: Column) -> Column:
    """A closed ring that covers an area and does not cross itself; false for null."""

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"]))

    def crossing(e: Column, f: Column) -> Column:
        a, b, c, d = e["a"], e["b"], f["a"], f["b"]
        return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)

    n = F.size(points)
    edges = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    area = F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])
    good = lambda es: (area != 0) & ~F.exists(es, lambda e: F.exists(es, lambda f: crossing(e, f)))
    return F.when(closed_ring(points), surely(bound(edges, good))).otherwise(False)


def elements_to_polygons(elements: DataFrame) -> DataFrame:
    """``osm_id`` (type/id), tags as columns, and ``geometry`` of elements whose ring is closed, covers an area and does not cross itself.

    ``elements`` has ``type, id, tags`` (map) and ``points`` (array of struct lon, lat).
    """
    ring = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["lon"], p["lat"])), ", ")
    tags = [F.col("tags")[n].alias(n) for n in ("name", "landuse", "natural", "leisure", "amenity", "building")]
    return elements.where(simple_ring(F.col("points"))).select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("osm_id"), *tags, F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("geometry")
    )

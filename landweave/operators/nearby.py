"""Points near other points: grid cells sized by the radius, neighbouring cells, exact distance.

The sphere is cut into latitude bands as high as the radius. Every band has its own number of
cells, so that a cell is never narrower than the radius allows at that latitude; the scheme
holds at the poles and across the antimeridian. A place looks only eastward in its own band
and to both sides in the next band, so each pair of cells meets once.

Places are joined, not rows: pages on one and the same coordinate form one place. A cell with
more than ``cell_rows`` places, and a place with more than so many rows, is split over parts on
one side and repeated for them on the other, so that neither ends in one task. Both are few (at
most one in ``cell_rows`` of all), and which they are is broadcast if their number is small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions.geo import EARTH_RADIUS_M, great_circle_m, usable_place
from landweave.operators.scale import evaluated, few, heavy_join
from landweave.session import cut_lineage


def _band_height(radius_m: float) -> float:
    return math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)


def _widest(band: Column, reach: int, radius_m: float) -> Column:
    """Greatest longitude difference, in degrees, of two places within the radius in the bands
    ``band - reach`` to ``band + 1``; 360 where any difference is possible."""
    h = _band_height(radius_m)
    edge = F.greatest(F.abs((band - reach) * h - 90), F.abs((band + 2) * h - 90))
    ratio = math.sin(min(radius_m / (2 * EARTH_RADIUS_M), math.pi / 2)) / F.cos(F.radians(F.least(edge, F.lit(90.0))))
    # the half-angle grows fast near the poles; there one cell takes the whole band
    return F.when((edge >= 89.999) | (ratio >= 1), 360.0).otherwise(F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))


def _cells(band: Column, radius_m: float) -> Column:
    """Number of cells of a band: one, or at least four."""
    n = F.floor(360.0 / _widest(band, 1, radius_m)).cast("long")
    return F.when(n >= 4, n).otherwise(F.lit(1).cast("long"))


def _cell(band: Column, n: Column, lon: Column) -> Column:
    """The cell of a longitude in a band of ``n`` cells."""
    return F.struct(band.alias("band"), F.pmod(F.floor((lon + 180.0) / (360.0 / n)).cast("long"), n).alias("cell"))


def near_places(places: DataFrame, radius_m: float, cell_rows: int = 2000) -> DataFrame:
    """Pairs of different rows of ``places`` (``place``, ``lat``, ``lon``) at most ``radius_m`` apart.

    ``place`` must be unique and orderable; the result has ``place_a < place_b`` and ``metres``.
    Unusable coordinates have no place. An empty input gives an empty result.
    """
    if not radius_m > 0:
        raise ValueError("the radius must be positive")
    h = _band_height(radius_m)
    own, up = F.col("band"), F.col("band") + 1
    base = evaluated(places.where(usable_place(F.col("lat"), F.col("lon"))).select("place", "lat", "lon"), {"band": F.floor((F.col("lat") + 90.0) / h).cast("long")})
    # sines and their like once per place, not once per use
    base = evaluated(base, {"wide": _widest(own, 0, radius_m), "n": _cells(own, radius_m), "n_up": _cells(up, radius_m)})
    lon, wide, n, n_up = (F.col(c) for c in ("lon", "wide", "n", "n_up"))
    base = base.withColumn("at", _cell(own, n, lon))
    reach = F.array_distinct(
        F.array(F.col("at"), _cell(own, n, lon + wide), _cell(up, n_up, lon - wide), _cell(up, n_up, lon), _cell(up, n_up, lon + wide))
    )
    home = base.select("place", "lat", "lon", "at")
    probe = base.select(
        F.col("place").alias("p_place"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("at").alias("p_home"), F.explode(reach).alias("at"),
    )
    counts = home.groupBy("at").count().where(F.col("count") > cell_rows).select("at", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts"))
    crowded = cut_lineage(counts)
    if crowded.isEmpty():
        home, probe = home.withColumn("part", F.lit(0)), probe.withColumn("part", F.lit(0))
    else:
        parts, crowded = F.coalesce(F.col("parts"), F.lit(1)), few(crowded)
        home = home.join(crowded, "at", "left").withColumn("part", F.pmod(F.xxhash64("place"), parts).cast("int")).drop("parts")
        probe = probe.join(crowded, "at", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")

    metres = great_circle_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    pairs = (
        probe.join(home, ["at", "part"])
        .where((F.col("p_place") != F.col("place")) & ((F.col("at") != F.col("p_home")) | (F.col("p_place") < F.col("place"))))
        .where(F.abs(F.col("lat") - F.col("p_lat")) <= 2 * h)
        .withColumn("metres", metres)
        .where(F.col("metres") <= radius_m)
    )
    return pairs.select(
        F.least("p_place", "place").alias("place_a"), F.greatest("p_place", "place").alias("place_b"), "metres"
    )


def _places(points: DataFrame, key: str) -> DataFrame:
    """Key and place of every usable point; a place is an exact coordinate. -0.0 is 0.0."""
    rows = points.where(F.col(key).isNotNull() & usable_place(F.col("lat"), F.col("lon")))
    lat, lon = F.col("lat").cast("double") + F.lit(0.0), F.col("lon").cast("double") + F.lit(0.0)
    return rows.select(F.col(key).alias("key"), F.struct(lat.alias("lat"), lon.alias("lon")).alias("place"))


def _grouped(rows: DataFrame) -> DataFrame:
    """``place, lat, lon, n, first``: every place once, its number of keys and the smallest of them; written once and read often."""
    places = rows.groupBy("place").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    return cut_lineage(places.select("place", F.col("place.lat").alias("lat"), F.col("place.lon").alias("lon"), "n", "first"))


def near_pairs(points: DataFrame, key: str, radius_m: float, cell_rows: int = 2000) -> DataFrame:
    """Pairs ``key_a < key_b`` of different keys with points at most ``radius_m`` apart.

    ``points`` has one row per key, or several: then a pair counts if any two of its points do.
    Null keys and unusable places give no pairs; further columns are ignored. The keys of one
    coordinate are all pairs of each other, as asked; ``near_groups`` and ``near_links`` say the
    same in rows that do not grow with the square.
    """
    members = _places(points, key).distinct()
    places = _grouped(members)
    near = near_places(places, radius_m, cell_rows).select("place_a", "place_b")
    several = places.where(F.col("n") > 1)
    pairs = near.unionByName(several.select(F.col("place").alias("place_a"), F.col("place").alias("place_b")))
    left = members.select(F.col("key").alias("left"), F.col("place").alias("place_a"))
    right = members.select(F.col("key").alias("right"), F.col("place").alias("place_b"))
    crowded = places.where(F.col("n") > cell_rows).select("place", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    if not crowded.isEmpty():
        crowded, parts = few(crowded), F.coalesce(F.col("parts"), F.lit(1))
        for side in ("place_a", "place_b"):
            named = crowded.withColumnRenamed("place", side)
            pairs = pairs.join(named, side, "left").withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
            spread = lambda df, column: df.join(named, side, "left").withColumn(f"part_{side}", F.pmod(F.xxhash64(column), parts).cast("int")).drop("parts")  # noqa: B023, E731
            left, right = (spread(left, "left"), right) if side == "place_a" else (left, spread(right, "right"))
    on = lambda side: [c for c in (side, f"part_{side}") if c in pairs.columns]
    met = pairs.join(left, on("place_a")).join(right, on("place_b"))
    # every pair of places comes once, but for a place with itself
    met = met.where((F.col("left") != F.col("right")) & ((F.col("place_a") != F.col("place_b")) | (F.col("left") < F.col("right"))))
    return met.select(F.least("left", "right").alias("key_a"), F.greatest("left", "right").alias("key_b")).distinct()


def near_groups(points: DataFrame, key: str, radius_m: float, cell_rows: int = 2000) -> DataFrame:
    """One row per key with a usable place: ``place_key``, ``n_near`` other keys within the radius, ``nearest_m``.

    ``place_key`` is the smallest key on the same coordinate and stands for the place in
    ``near_links``. Copies of a coordinate are counted, never expanded into pairs. With several
    points of one key each counts by itself; give one row per key.
    """
    rows = _places(points, key).distinct()
    places = _grouped(rows)
    near = near_places(places, radius_m, cell_rows)
    both = near.unionByName(near.select(F.col("place_b").alias("place_a"), F.col("place_a").alias("place_b"), "metres"))
    sizes = places.select(F.col("place").alias("place_b"), "n")
    around = both.join(sizes, "place_b").groupBy(F.col("place_a").alias("place")).agg(F.sum("n").alias("others"), F.min("metres").alias("metres"))
    summary = places.select("place", "n", "first").join(around, "place", "left").select(
        "place", "n", F.col("first").alias("place_key"),
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"),
        F.when(F.col("n") > 1, 0.0).otherwise(F.col("metres")).alias("nearest_m"),
    )
    total = places.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return heavy_join(rows, summary, "place", "n", total).select(F.col("key").alias(key), "place_key", "n_near", "nearest_m")


def near_links(points: DataFrame, key: str, radius_m: float, cell_rows: int = 2000) -> DataFrame:
    """``key_a < key_b, metres``: pairs of places at most ``radius_m`` apart, each named by the smallest key on it."""
    places = _grouped(_places(points, key).distinct())
    near = near_places(places, radius_m, cell_rows)
    names = places.select("place", "first")
    a, b = (names.select(F.col("place").alias(f"place_{x}"), F.col("first").alias(x)) for x in "ab")
    return near.join(a, "place_a").join(b, "place_b").select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), "metres")

"""Points near points and regions, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landweave.functions import geo
from landweave.operators.nearby import near_groups, near_links, near_pairs
from landweave.operators.regions import locate, prepared_regions
from landweave.operators.scale import heavy_join


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    u, v = math.sin((q - p) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    return 2 * geo.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(u * u + math.cos(p) * math.cos(q) * v * v)))


def brute(points, radius):
    good = [(k, p) for k, p in points if None not in p and abs(p[0]) <= 90 and abs(p[1]) <= 180 and p != (0, 0)]
    return {(a, b) for a, p in good for b, q in good if a < b and metres(p, q) <= radius}


def frame(spark, points):
    return spark.createDataFrame([(k, lat, lon, "x") for k, (lat, lon) in points], "id long, lat double, lon double, key string")


@pytest.mark.parametrize("lat, lon", [(48.0, 7.0), (89.9995, 0.0), (-89.999, 179.9), (0.0001, 179.9999), (-30.0, -179.9999)])
@pytest.mark.parametrize("radius", [250.0, 30000.0])
def test_near_pairs_everywhere(spark, lat, lon, radius):
    random.seed(7)
    reach = math.degrees(radius / geo.EARTH_RADIUS_M) * 3
    points = []
    for i in range(120):
        la = max(-90.0, min(90.0, lat + random.uniform(-reach, reach)))
        lo = lon + random.uniform(-reach, reach) / max(0.0003, math.cos(math.radians(la)))
        points.append((i, (la, (lo + 180) % 360 - 180)))
    found = near_pairs(frame(spark, points), "id", radius, cell_rows=7)
    assert {(r.key_a, r.key_b) for r in found.collect()} == brute(points, radius)
    counts = {r.id: r.n_near for r in near_groups(frame(spark, points), "id", radius, cell_rows=7).collect()}
    pairs = brute(points, radius)
    links = {(r.key_a, r.key_b): r.metres for r in near_links(frame(spark, points), "id", radius, cell_rows=7).collect()}
    assert set(links) == pairs and all(m == pytest.approx(metres(points[a][1], points[b][1]), abs=1e-6) for (a, b), m in links.items())
    assert counts == {i: sum(i in p for p in pairs) for i, _ in points}


def test_near_pairs_of_dirty_places(spark):
    points = [(1, (48.0, 7.0)), (2, (48.0, 7.0)), (3, (48.0, 7.0)), (3, (48.0, 7.0)), (4, (None, 7.0)), (5, (0.0, 0.0)), (6, (0.0, 0.0)), (7, (248.0, 7.0)), (8, (float("nan"), 7.0))]
    found = near_pairs(frame(spark, points), "id", 250.0).collect()
    assert {(r.key_a, r.key_b) for r in found} == {(1, 2), (1, 3), (2, 3)} and len(found) == 3
    assert near_pairs(frame(spark, []), "id", 250.0).count() == 0
    assert near_groups(frame(spark, []), "id", 250.0).count() == 0
    with pytest.raises(ValueError):
        near_pairs(frame(spark, points), "id", 0.0)


def test_a_place_with_a_third_of_all_rows(spark, monkeypatch):
    # sixty pages on the placeholder, neighbours of it, and others far away
    points = [(i, (48.0, 7.0)) for i in range(60)] + [(i, (48.0 + (i - 60) * 1e-5, 7.0)) for i in range(61, 80)] + [(i, (i - 100.0, 7.0)) for i in range(80, 130)] + [(200, (48.000155, 7.0)), (201, (48.000155, 7.0))]
    for broadcast in (100_000, 0):
        monkeypatch.setattr("landweave.operators.scale.BROADCAST", broadcast)
        found = near_pairs(frame(spark, points), "id", 250.0, cell_rows=10).collect()
        assert {(r.key_a, r.key_b) for r in found} == brute(points, 250.0) and len(found) == len(brute(points, 250.0))
    groups = {r.id: (r.place_key, r.n_near) for r in near_groups(frame(spark, points), "id", 250.0, cell_rows=10).collect()}
    assert groups[5] == (0, 80) and groups[201][0] == 200 and groups[90] == (90, 0)
    links = {(r.key_a, r.key_b) for r in near_links(frame(spark, points), "id", 250.0, cell_rows=10).collect()}
    assert (0, 200) in links and not any(0 < a < 60 or b < 60 for a, b in links) and len(links) == 21 * 20 // 2


def in_ring(x, y, ring):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def test_locate_against_brute_force(spark):
    random.seed(3)
    shapes = []
    for i in range(60):
        cx, cy, r = random.uniform(-5, 5), random.uniform(-5, 5), random.choice([0.001, 0.1, 2.0])
        ring = [(cx + r * math.cos(t) * random.uniform(0.5, 1), cy + r * math.sin(t)) for t in [k * math.pi / 4 for k in range(8)]]
        shapes.append((i, ring if i % 2 else ring[::-1]))
    wkt = lambda ring: "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + "))"
    rows = [(i, "311", wkt(r)) for i, r in shapes] + [(0, "311", wkt(shapes[0][1])), (90, None, None), (91, "1", "POLYGON EMPTY"), (92, "1", "rubbish"), (93, "1", "")]
    polygons = spark.createDataFrame(rows, "id int, code string, geometry string")
    points = [(i, random.uniform(-5, 5), random.uniform(-5, 5)) for i in range(300)] + [(i + 300, r[0][0] * 0.99 + r[4][0] * 0.01, r[0][1]) for i, r in shapes]
    located = locate(spark.createDataFrame([*points, (999, None, 1.0)], "p int, x double, y double"), "x", "y", prepared_regions(polygons, "id", "geometry", ["code"]))
    found = [(r.p, r.id) for r in located.collect()]
    assert sorted(found) == sorted((p, i) for p, x, y in points for i, r in shapes if in_ring(x, y, r))


def test_a_region_of_many_corners(spark):
    # a ring of 3,000 corners is entered in fine cells that hold a part of its edges each
    ring = [(10 * math.cos(t) * (1 + 0.2 * math.sin(40 * t)), 10 * math.sin(t) * (1 + 0.2 * math.sin(40 * t))) for t in [k * math.tau / 3000 for k in range(3000)]]
    wkt = "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + "))"
    regions = prepared_regions(spark.createDataFrame([(1, wkt), (2, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")], "id int, wkt string"), "id", "wkt", [])
    from landweave.operators.regions import _cells

    cells = _cells(regions.where("id = 1"), 360.0).selectExpr("size(edges) as n").collect()
    assert len(cells) > 30 and max(c.n for c in cells) < 1000
    random.seed(2)
    points = [(i, random.uniform(-13, 13), random.uniform(-13, 13)) for i in range(800)]
    found = {r.p for r in locate(spark.createDataFrame(points, "p int, x double, y double"), "x", "y", regions).where("id = 1").collect()}
    assert found == {p for p, x, y in points if in_ring(x, y, ring)}


def test_a_cell_with_most_points_is_split(spark):
    # a third of the points in one cell: with thresholds for so few rows the adaptive planner splits it
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        shapes = spark.createDataFrame([(i, f"POLYGON (({i} 0, {i + 1} 0, {i + 1} 1, {i} 1, {i} 0))") for i in range(40)], "id int, wkt string")
        points = spark.range(60_000).repartition(8).select("id", F.when(F.col("id") % 3 == 0, 5.5).otherwise(F.col("id") % 40 + 0.3).alias("x"), F.lit(0.5).alias("y"))
        found = locate(points.withColumnRenamed("id", "p"), "x", "y", prepared_regions(shapes, "id", "wkt", []))
        assert {(r.id, r.n) for r in found.groupBy("id").agg(F.count("*").alias("n")).where("id = 5").collect()} == {(5, 21_000)}
        rows = found.select("p", "id")
        assert rows.count() == 60_000
        executed = rows.collect() and rows._jdf.queryExecution().executedPlan().toString()
        assert "skewed" in executed or "skew=true" in executed
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_holes_parts_and_edges(spark):
    rows = [(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), (2, "MULTIPOLYGON (((20 0, 21 0, 21 1, 20 1, 20 0)), ((30 0, 31 0, 31 1, 30 1, 30 0)))")]
    regions = prepared_regions(spark.createDataFrame(rows, "id int, wkt string"), "id", "wkt", [])
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 30.5, 0.5), (4, 10.0, 5.0), (5, 4.0, 5.0)], "p int, x double, y double")
    assert {(r.p, r.id) for r in locate(points, "x", "y", regions).collect()} == {(2, 1), (3, 2), (4, 1), (5, 1)}
    assert {(r.p, r.id) for r in locate(points, "x", "y", regions, boundary=False).collect()} == {(2, 1), (3, 2)}
    empty = prepared_regions(spark.createDataFrame([], "id int, wkt string"), "id", "wkt", [])
    assert locate(points, "x", "y", empty).count() == 0


def test_lambert_round_trip(spark):
    df = spark.createDataFrame([(3.0, 46.5), (7.5, 48.2), (-4.0, 42.0)], "lon double, lat double")
    x, y = geo.lcc_forward(F.col("lon"), F.col("lat"))
    lon, lat = geo.lcc_inverse(F.col("x"), F.col("y"))
    rows = df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect()
    assert abs(rows[0].x - 700000) < 1e-6 and abs(rows[0].y - 6600000) < 1e-6
    assert all(abs(r.lon - r.lon2) < 1e-10 and abs(r.lat - r.lat2) < 1e-10 for r in rows)


def test_heavy_join_equals_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "i int, k string")
    side = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.length("k"))
    for light in (0, 100, 10_000):
        joined = heavy_join(rows, side, "k", "n", 3000, light)
        assert joined.select("i", "v").exceptAll(rows.join(side, "k").select("i", "v")).count() == 0 and joined.count() == 3000

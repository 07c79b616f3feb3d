"""Overlays, buffers, truth and spatial confidence on toy shapes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landweave.functions.columns import level2, natural_class, tag_labels
from landweave.operators import overlay
from landweave.operators.regions import prepared_regions
from landweave.operators.truth import in_either, labeled_regions, multi_label_truth, single_label_truth


def box(a, b, c, d):
    return f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))"


def polygons(spark, *rows):
    return spark.createDataFrame([(i, code, shape) for i, (code, shape) in enumerate(rows)], "id int, code_18 string, geometry string")


def truth(spark, points, *rows):
    df = spark.createDataFrame([(str(k), x, y) for k, x, y in points], "pageid string, lon double, lat double")
    regions = labeled_regions(polygons(spark, *rows), level2(F.col("code_18")), natural_class(F.col("code_18")))
    return {r.pageid: r.target for r in single_label_truth(df, regions).collect()}


def test_single_label_truth(spark):
    assert truth(spark, [(100, 0.5, 0.5), (200, 2.5, 2.5)], ("211", box(0, 0, 1, 1)), ("311", box(2, 2, 3, 3))) == {"100": "21", "200": "31"}
    assert truth(spark, [(1, 0.5, 0.5)], ("211", box(0, 0, 1, 1)), ("311", box(0, 0, 1, 1))) == {}
    assert truth(spark, [(1, 5.0, 5.0)], ("211", box(0, 0, 1, 1))) == {}
    assert truth(spark, [(1, 1.0, 0.5)], ("311", box(0, 0, 1, 1)), ("312", box(1, 0, 2, 1))) == {"1": "31"}
    assert truth(spark, [(1, 1.0, 0.5)], ("211", box(0, 0, 1, 1)), ("311", box(1, 0, 2, 1))) == {}
    assert truth(spark, [(1, 0.5, 0.5)], ("112", box(0, 0, 1, 1)), (None, box(0, 0, 1, 1))) == {}


def test_multi_label_truth_and_either(spark):
    tags = spark.createDataFrame([(1, "meadow", None, box(0, 0, 1, 1)), (2, None, "wood", box(0, 0, 1, 1)), (3, "residential", None, box(0, 0, 1, 1)), (4, "meadow", "wood", box(5, 5, 6, 6))], "id int, landuse string, natural string, geometry string")
    rows = tags.withColumn("labels", tag_labels(F.col("landuse"), F.col("natural"))).where(F.size("labels") > 0)
    regions = prepared_regions(rows, "id", "geometry", ["labels"])
    points = spark.createDataFrame([("a", 0.5, 0.5), ("b", 5.5, 5.5), ("c", 9.0, 9.0)], "pageid string, lon double, lat double")
    assert {r.pageid: r.target for r in multi_label_truth(points, regions).collect()} == {"a": ["meadow", "wood"], "b": ["meadow", "wood"]}
    other = prepared_regions(polygons(spark, ("311", box(8, 8, 10, 10))), "id", "geometry", [])
    assert {r.pageid for r in in_either(points, regions, other).collect()} == {"a", "b", "c"}
    assert {r.pageid for r in in_either(points, None, other).collect()} == {"c"} and in_either(points, None, None).count() == 3


def test_overlay(spark):
    left = overlay.planar(spark.createDataFrame([("o", box(0, 0, 10, 10))], "osm_id string, geometry string"), "osm_id", "geometry", [], project=False)
    right = overlay.planar(polygons(spark, ("311", box(0, 0, 4, 10)), ("112", box(4, 0, 10, 10))), "id", "geometry", ["code_18"], project=False)
    rows = {r.code_18: (round(r.area, 9), round(r.share, 9)) for r in overlay.overlay_shares(left, right, "osm_id", "code_18").collect()}
    assert rows == {"311": (40.0, 0.4), "112": (60.0, 0.6)}
    half = overlay.planar(polygons(spark, ("311", box(0, 0, 5, 5)), ("311", box(0, 5, 5, 10))), "id", "geometry", ["code_18"], project=False)
    assert [(r.area, r.share) for r in overlay.overlay_shares(left, half, "osm_id", "code_18").collect()] == [(50.0, 1.0)]
    assert overlay.overlay_shares(left, half.limit(0), "osm_id", "code_18").count() == 0


def test_region_area_against_sampling():
    random.seed(4)
    star = [(math.cos(k * math.pi / 5) * (3 if k % 2 else 1.2), math.sin(k * math.pi / 5) * (3 if k % 2 else 1.2)) for k in range(10)]
    hole = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]
    other = [(-1.0, -2.0), (2.5, -1.0), (0.3, 0.2), (1.0, 2.5), (-2.0, 1.0)]

    def inside(p, ring):
        odd = False
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
        return odd

    n = 40_000
    hits = sum((inside(p, star) and not inside(p, hole) and inside(p, other)) for p in ((random.uniform(-3, 3), random.uniform(-3, 3)) for _ in range(n)))
    for a in (star, star[::-1]):
        assert overlay.region_area([a, hole], [other]) == pytest.approx(36 * hits / n, rel=0.03)
    assert overlay.region_area([[(0, 0), (2, 2), (2, 0), (0, 2)]], [[(0, 0), (2, 0), (2, 2), (0, 2)]]) == pytest.approx(2.0)
    assert overlay.convex_ring([other]) is None and overlay.convex_ring([hole[::-1]]) is not None
    shapes = [[[(x + shift, y) for x, y in ring] for ring in rings] for shift in (0.0, 0.3, 0.7, 1.5, 3.0, 9.0) for rings in ([star], [star, hole], [hole], [[(0, 0), (2, 2), (2, 0), (0, 2)]], [[(-9, -9), (9, -9), (9, 9), (-9, 9)]], [hole[::-1]], [other], [hole[:3]])]
    found = overlay.disc_areas(shapes, [1.0, 2.5, 0.01])
    for row, shape in zip(found, shapes):
        assert row == pytest.approx([overlay.region_area(shape, [overlay.circle(0, 0, r)]) for r in (1.0, 2.5, 0.01)], abs=1e-9)
    assert overlay.disc_areas([], [1.0]).shape == (0, 1)


def test_box_candidates_against_brute_force(spark):
    random.seed(6)
    boxes = [(i, *(c := (random.uniform(-50, 50), random.uniform(-50, 50))), c[0] + random.choice([0.0, 1e-4, 0.1, 3.0, 80.0]), c[1] + random.choice([0.0, 1e-4, 0.1, 3.0, 80.0])) for i in range(160)]
    df = spark.createDataFrame(boxes, "id int, minx double, miny double, maxx double, maxy double")
    left, right = df.where("id < 80"), df.where("id >= 80")
    found = [(r.id, r.r_id) for r in overlay.box_candidates(left, right).collect()]
    meets = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    assert sorted(found) == sorted((a[0], b[0]) for a in boxes[:80] for b in boxes[80:] if meets(a, b))
    assert overlay.box_candidates(left, right.limit(0)).count() == 0


def test_overlapping_is_more_than_touching(spark):
    tags = overlay.planar(polygons(spark, ("a", box(0, 0, 1, 1)), ("b", box(2, 0, 3, 1)), ("c", box(7, 7, 8, 8)), ("d", box(0, 0, 20, 20))), "id", "geometry", [], project=False)
    cover = overlay.planar(polygons(spark, ("311", box(1, 0, 2.5, 1)), ("211", box(30, 30, 31, 31))), "id", "geometry", [], project=False)
    assert {r.id for r in overlay.overlapping(tags, cover, "id").collect()} == {1, 3}


def confidence(spark, rows, label="31"):
    points = spark.createDataFrame([("p", label, 0.0, 0.0)], "pageid string, point_label string, x double, y double")
    regions = overlay.planar(polygons(spark, *rows).withColumn("label", level2(F.col("code_18"))), "id", "geometry", ["label"], project=False)
    shares = overlay.buffer_shares(points, regions, "label", [250.0])
    return overlay.spatial_confidence(points, shares, "pageid", "point_label", [250.0]).first()


def test_spatial_confidence(spark):
    pure = confidence(spark, [("311", box(-1000, -1000, 1000, 1000))])
    assert (pure.dominant_label, pure.num_labels, pure.entropy, pure.dominant_matches_point_label) == ("31", 1, 0.0, True) and pure.coverage_share == pytest.approx(1.0)
    split = confidence(spark, [("311", box(-1000, -1000, 0, 1000)), ("112", box(0, -1000, 1000, 1000))])
    assert split.label_shares == pytest.approx({"11": 0.5, "31": 0.5}, abs=0.01) and split.dominant_label == "11" and split.artificial_share == pytest.approx(0.5)
    assert split.entropy == pytest.approx(math.log(2)) and split.normalized_entropy == pytest.approx(1.0)
    none = confidence(spark, [("311", box(5000, 5000, 6000, 6000))])
    assert none.dominant_label is None and (none.num_labels, none.coverage_share, none.label_shares) == (0, 0.0, {})
    bow = confidence(spark, [("311", "POLYGON ((-300 -300, 300 300, 300 -300, -300 300, -300 -300))")])
    assert 0 < bow.dominant_share <= 1

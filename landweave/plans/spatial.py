"""Queries on points and polygons: D1 to D8, E14 to E19, A5 to A7, A35."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions.columns import level2, lookup, natural_class, surely, tag_labels
from landweave.functions.geo import lcc_forward, ring_area
from landweave.operators.overlay import buffer_shares, entropy, normalized_entropy, overlay_shares, planar, spatial_confidence, spatial_confidence_wide
from landweave.operators.regions import prepared_regions
from landweave.operators.truth import in_either, labeled_regions, multi_label_truth, single_label_truth
from landweave.plans import inputs
from landweave.plans.inputs import CODE_LANDUSE, CODE_NATURAL, case_sql, with_sql
from landweave.session import cut_lineage

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _natural(spark: SparkSession, folder: str) -> DataFrame:
    return labeled_regions(inputs.polygons(spark, folder), level2(F.col("code_18")), natural_class(F.col("code_18")))


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    tags = tag_labels(lookup(F.col("code_18"), CODE_LANDUSE), lookup(F.col("code_18"), CODE_NATURAL))
    rows = inputs.polygons(spark, folder).withColumn("labels", tags).where(F.size("labels") > 0)
    return prepared_regions(rows, "id", "geometry", ["labels"])


@query(with_sql("articles", "corners", "hits") + "SELECT pageid, min(left(code_18, 2)) AS target FROM hits WHERE code_18 NOT LIKE '1%' GROUP BY pageid HAVING count(DISTINCT left(code_18, 2)) = 1")
def d1_point_polygon_single_label(spark: SparkSession, folder: str) -> DataFrame:
    return single_label_truth(inputs.articles(spark, folder), _natural(spark, folder))


_LU, _NA = case_sql("code_18", {k: v for k, v in CODE_LANDUSE.items() if v not in ("residential", "industrial")}), case_sql("code_18", {k: v for k, v in CODE_NATURAL.items() if v != "hedge"})


@query(with_sql("articles", "corners", "hits") + f"SELECT pageid, array_to_string(list_sort(list(DISTINCT l)), ',') AS target FROM (SELECT pageid, unnest([{_LU}, {_NA}]) AS l FROM hits) WHERE l IS NOT NULL GROUP BY pageid")
def d2_point_polygon_multi_label(spark: SparkSession, folder: str) -> DataFrame:
    rows = multi_label_truth(inputs.articles(spark, folder), _tagged(spark, folder))
    return rows.select("pageid", F.array_join("target", ",").alias("target"))


@query(with_sql("articles", "corners", "hits") + f"SELECT DISTINCT pageid FROM hits WHERE code_18 NOT LIKE '1%' OR {_LU} IS NOT NULL OR {_NA} IS NOT NULL")
def d3_semi_join_either(spark: SparkSession, folder: str) -> DataFrame:
    return in_either(inputs.articles(spark, folder), _natural(spark, folder), _tagged(spark, folder)).select("pageid")


def _boxes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Boxes around articles, and bounding boxes of polygons, as WKT in degrees."""
    box = lambda a, b, c, d: F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", x, y) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]), F.lit("))"))
    lon, lat = F.col("lon"), F.col("lat")
    around = inputs.articles(spark, folder).select("pageid", box(lon - 0.01, lat - 0.01, lon + 0.01, lat + 0.01).alias("geometry"))
    rows = prepared_regions(inputs.polygons(spark, folder), "id", "geometry", ["code_18"]).where(F.col("code_18").isNotNull())
    bounds = rows.select("id", "code_18", box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")).alias("geometry"))
    return planar(around, "pageid", "geometry", [], project=False), planar(bounds, "id", "geometry", ["code_18"], project=False)


_OVERLAY = """, boxes AS (SELECT id, code_18, list_min(x) AS minx, list_max(x) AS maxx, list_min(y) AS miny, list_max(y) AS maxy FROM corners WHERE code_18 IS NOT NULL),
  cuts AS (SELECT a.pageid, b.code_18, (least(a.lon + 0.01, b.maxx) - greatest(a.lon - 0.01, b.minx)) * (least(a.lat + 0.01, b.maxy) - greatest(a.lat - 0.01, b.miny)) AS area
    FROM articles a JOIN boxes b ON a.lon - 0.01 < b.maxx AND a.lon + 0.01 > b.minx AND a.lat - 0.01 < b.maxy AND a.lat + 0.01 > b.miny),
  sums AS (SELECT pageid, code_18, sum(area) AS area FROM cuts GROUP BY ALL)"""


@query(with_sql("articles", "corners").rstrip() + _OVERLAY + " SELECT pageid, code_18, round(area * 1e6, 4) AS area, round(area / sum(area) OVER (PARTITION BY pageid), 6) AS share FROM sums")
def d5_overlay_share(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _boxes(spark, folder)
    shares = overlay_shares(left, right, "pageid", "code_18")
    return shares.select("pageid", "code_18", F.round(F.col("area") * 1e6, 4).alias("area"), F.round("share", 6).alias("share"))


@query(with_sql("articles", "corners").rstrip() + _OVERLAY + """, shares AS (SELECT pageid, area / sum(area) OVER (PARTITION BY pageid) AS p FROM sums)
  SELECT pageid, count(*) AS n_labels, round(-sum(p * ln(p)) + 0, 5) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 5) AS normalized_entropy FROM shares GROUP BY pageid""")
def e14_entropy(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _boxes(spark, folder)
    lists = overlay_shares(left, right, "pageid", "code_18").groupBy("pageid").agg(F.collect_list("share").alias("p"))
    return lists.select("pageid", F.size("p").cast("long").alias("n_labels"), F.round(entropy(F.col("p")) + 0.0, 5).alias("entropy"), F.round(normalized_entropy(F.col("p")) + 0.0, 5).alias("normalized_entropy"))


def _planar_points(spark: SparkSession, folder: str) -> DataFrame:
    """Places on the plane with the only label around them, artificial surfaces included."""
    every = labeled_regions(inputs.polygons(spark, folder), level2(F.col("code_18")), F.lit(True))
    places = inputs.articles(spark, folder)
    labels = single_label_truth(places, every).withColumnRenamed("target", "point_label")
    x, y = lcc_forward(F.col("lon"), F.col("lat"))
    return places.join(labels, "pageid").select("pageid", "point_label", x.alias("x"), y.alias("y"))


def confidence_by_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Spatial confidence in buffers of 250 m and 500 m, a row for each."""
    points = cut_lineage(_planar_points(spark, folder))  # read for the buffers and for the rows that come out
    rows = inputs.polygons(spark, folder).withColumn("label", level2(F.col("code_18"))).where(F.col("label").isNotNull())
    shares = buffer_shares(points, cut_lineage(planar(rows, "id", "geometry", ["label"])), "label", [250.0, 500.0])
    return spatial_confidence(points, shares, "pageid", "point_label", [250.0, 500.0])


@query()
def e16_spatial_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of land cover in buffers of 250 m and 500 m, wide."""
    return spatial_confidence_wide(confidence_by_radius(spark, folder), "pageid", "point_label", [250, 500])


@query()
def d5_landcover_around_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Area in square metres and share of each code in a box around every article, on the plane."""
    box = lambda a, b, c, d: F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", x, y) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]), F.lit("))"))
    lon, lat = F.col("lon"), F.col("lat")
    around = inputs.articles(spark, folder).select("pageid", box(lon - 0.005, lat - 0.005, lon + 0.005, lat + 0.005).alias("geometry"))
    cover = inputs.polygons(spark, folder).where(F.col("code_18").isNotNull())
    return overlay_shares(planar(around, "pageid", "geometry", []), planar(cover, "id", "geometry", ["code_18"]), "pageid", "code_18")


@query(with_sql("corners") + "SELECT round(min(list_min(x)), 7) AS min_lon, round(min(list_min(y)), 7) AS min_lat, round(max(list_max(x)), 7) AS max_lon, round(max(list_max(y)), 7) AS max_lat FROM corners")
def a6_bounds(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared_regions(inputs.polygons(spark, folder), "id", "geometry", [])
    return rows.agg(F.min("minx").alias("min_lon"), F.min("miny").alias("min_lat"), F.max("maxx").alias("max_lon"), F.max("maxy").alias("max_lat"))


@query(with_sql("corners") + """, areas AS (SELECT id, abs(list_sum(list_transform(range(1, 5), lambda i: x[i] * y[i+1] - x[i+1] * y[i]))) / 2 AS a FROM corners)
  SELECT id, round(a * 1e6, 3) AS area_micro FROM areas WHERE a * 1e6 >= 500""")
def c15_minimum_area(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared_regions(inputs.polygons(spark, folder), "id", "geometry", [])
    area = F.abs(ring_area(F.col("edges"))) * 1e6
    return rows.withColumn("a", area).where(F.col("a") >= 500).select("id", F.round("a", 3).alias("area_micro"))


@query("SELECT DISTINCT left(code_18, 2) AS label FROM landcover_polygons WHERE code_18 NOT LIKE '1%' AND length(code_18) >= 2")
def c2_level2_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.polygons(spark, folder).where(natural_class(F.col("code_18")))
    return rows.select(level2(F.col("code_18")).alias("label")).where(F.col("label").isNotNull()).distinct()


@query(with_sql("articles", "corners", "hits") + """, per AS (SELECT pageid, count(DISTINCT left(code_18, 2)) AS n FROM hits WHERE code_18 IS NOT NULL GROUP BY pageid), h AS (SELECT n, count(*) AS c FROM per GROUP BY n)
  SELECT n AS n_classes, c AS n_pages, round_even(100.0 * c / sum(c) OVER (), 2) AS pct_pages FROM h""")
def e18_class_count_histogram(spark: SparkSession, folder: str) -> DataFrame:
    from landweave.operators.reports import class_count_summary
    from landweave.operators.regions import locate

    every = labeled_regions(inputs.polygons(spark, folder), level2(F.col("code_18")), F.lit(True))
    found = locate(inputs.articles(spark, folder).select("pageid", "lon", "lat"), "lon", "lat", every)
    return class_count_summary(found.select("pageid", "label").distinct(), "pageid").withColumnsRenamed({"n_groups": "n_pages", "pct_groups": "pct_pages"})


@query("SELECT left(code_18, 1) AS level1, count(*) AS n, count(DISTINCT code_18) AS n_codes FROM (SELECT DISTINCT id, code_18, geometry FROM landcover_polygons) WHERE code_18 IS NOT NULL GROUP BY 1")
def e19_level1_distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.polygons(spark, folder).where(F.col("code_18").isNotNull())
    return rows.groupBy(F.substring("code_18", 1, 1).alias("level1")).agg(F.count("*").alias("n"), F.count_distinct("code_18").alias("n_codes"))


@query("""WITH t AS (SELECT i, j, 5.8 + i * 0.26 AS west, least(5.8 + (i + 1) * 0.26, 8.3) AS east, 47.4 + j * 0.18 AS south, least(47.4 + (j + 1) * 0.18, 49.1) AS north
    FROM range(0, 10) a(i), range(0, 10) b(j))
  SELECT i, j, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM t""")
def a35_tiles(spark: SparkSession, folder: str) -> DataFrame:
    from landweave.sources.fetch import tiles

    return tiles(spark, west=5.8, south=47.4, east=8.3, north=49.1, width=0.26, height=0.18)


@query(with_sql("articles") + "SELECT pageid FROM articles WHERE lat BETWEEN 47.4 AND 49.1 AND lon BETWEEN 5.8 AND 8.3")
def c14_in_bounds(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.articles(spark, folder)
    return rows.where(surely(F.col("lat").between(47.4, 49.1) & F.col("lon").between(5.8, 8.3))).select("pageid")

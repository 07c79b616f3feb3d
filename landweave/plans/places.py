"""Queries on places: p3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions.geo import usable_place
from landweave.operators.nearby import near_groups, near_links, near_pairs
from landweave.operators.regions import locate, prepared_regions
from landweave.plans.inputs import with_sql
from landweave.sources.tables import current_rows, table

#: The distance that ``point_label_share_250m`` looks at.
RADIUS_M = 250.0


def current_places(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rows(table(spark, folder, "wiki_articles"), "pageid", "fetched_at", ["lat", "lon"])
    return rows.where(usable_place(F.col("lat"), F.col("lon")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of pages whose current places lie at most 250 m apart."""
    pairs = near_pairs(current_places(spark, folder), "pageid", RADIUS_M)
    return pairs.select(F.col("key_a").alias("pageid_a"), F.col("key_b").alias("pageid_b"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per placed page: how many others lie within 250 m, and the nearest of them."""
    counts = near_groups(current_places(spark, folder), "pageid", RADIUS_M)
    return counts.select("pageid", "n_near", F.round("nearest_m", 3).alias("nearest_m"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per placed page: the smallest page on the same coordinate, and how many others lie within 250 m."""
    return near_groups(current_places(spark, folder), "pageid", RADIUS_M).drop("nearest_m")


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of coordinates at most 250 m apart, each named by its smallest page."""
    links = near_links(current_places(spark, folder), "pageid", RADIUS_M)
    return links.select(F.col("key_a").alias("page_a"), F.col("key_b").alias("page_b"), F.round("metres", 3).alias("metres"))


def p3_region(spark: SparkSession, folder: str) -> DataFrame:
    """One row per placed page: the polygon around it (smallest id on a shared edge) or null."""
    places = current_places(spark, folder)
    polygons = prepared_regions(table(spark, folder, "landcover_polygons"), "id", "geometry", ["code_18"])
    hits = locate(places, "lon", "lat", polygons).groupBy("pageid").agg(F.min(F.struct("id", F.col("code_18").isNull(), "code_18")).alias("hit"))
    return places.select("pageid").join(hits, "pageid", "left").select("pageid", F.col("hit.id").alias("polygon_id"), F.col("hit.code_18").alias("code_18"))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p3_groups": p3_groups, "p3_links": p3_links, "p3_region": p3_region}

_PLACES = """
placed AS (
  SELECT pageid, lat, lon FROM (
    SELECT pageid, lat, lon, row_number() OVER (PARTITION BY pageid ORDER BY fetched_at DESC, lat DESC, lon DESC) AS rn
    FROM wiki_articles WHERE pageid IS NOT NULL)
  WHERE rn = 1 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
near AS (
  SELECT a.pageid AS a, b.pageid AS b,
    2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS m
  FROM placed a JOIN placed b ON a.pageid <> b.pageid AND abs(a.lat - b.lat) < 0.0023)"""

ORACLE = {
    "p3_found": f"WITH {_PLACES} SELECT a AS pageid_a, b AS pageid_b FROM near WHERE m <= 250 AND a < b",
    "p3_counts": f"""WITH {_PLACES}
      SELECT pageid, count(a) AS n_near, round(min(m), 3) AS nearest_m
      FROM placed LEFT JOIN near ON a = pageid AND m <= 250 GROUP BY pageid""",
    "p3_groups": f"""WITH {_PLACES}, n AS (SELECT pageid, count(a) AS n_near FROM placed LEFT JOIN near ON a = pageid AND m <= 250 GROUP BY pageid)
      SELECT pageid, min(pageid) OVER (PARTITION BY lat, lon) AS place_key, n_near FROM placed JOIN n USING (pageid)""",
    "p3_links": f"""WITH {_PLACES}, firsts AS (SELECT min(pageid) AS p FROM placed GROUP BY lat, lon)
      SELECT a AS page_a, b AS page_b, round(m, 3) AS metres FROM near WHERE m <= 250 AND a < b AND a IN (SELECT p FROM firsts) AND b IN (SELECT p FROM firsts)""",
    "p3_region": with_sql("articles", "corners", "hits").rstrip() + """, best AS (SELECT pageid, min(id) AS id FROM hits GROUP BY pageid)
      SELECT CAST(a.pageid AS BIGINT) AS pageid, b.id AS polygon_id, max(h.code_18) FILTER (WHERE h.id = b.id) AS code_18
      FROM articles a LEFT JOIN best b USING (pageid) LEFT JOIN hits h USING (pageid) GROUP BY a.pageid, b.id""",
}

"""Inputs of the queries: views over the tables, as DataFrames and as SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions.columns import lookup, usable_class
from landweave.functions.geo import usable_place
from landweave.sources.tables import current_rows, table

#: Which text source a tier of the split table stands for.
TIER_SOURCE = {
    "all": "content",
    "spatial_only": "content_shuffled",
    "quality_spatial": "summary",
    "text_spatial_agreement": "summary_shuffled",
    "eval_strict": "landuse_evidence_summary",
    "eval_repeated": "evidence_card",
    "eval_spatial_block": "evidence_card_shuffled",
}
#: Tags that stand for land-cover codes.
CODE_LANDUSE = {"211": "farmland", "221": "vineyard", "222": "orchard", "231": "meadow", "242": "allotments", "311": "forest", "312": "forest", "112": "residential", "121": "industrial"}
CODE_NATURAL = {"311": "wood", "313": "wood", "321": "grassland", "322": "heath", "324": "scrub", "332": "bare_rock", "411": "wetland", "511": "water", "512": "water", "243": "hedge"}


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """``pageid`` (text), ``title, lat, lon`` of pages with a usable place."""
    rows = current_rows(table(spark, folder, "wiki_articles"), "pageid", "fetched_at", ["title", "lat", "lon"])
    return rows.where(usable_place(F.col("lat"), F.col("lon"))).withColumn("pageid", F.col("pageid").cast("string"))


def contents(spark: SparkSession, folder: str, columns: Sequence[str] = ("title", "content")) -> DataFrame:
    """Current contents; only the columns that are asked for are read and shuffled."""
    return current_rows(table(spark, folder, "article_contents"), "pageid", "fetched_at", list(columns))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["title", "landuse_evidence_summary", "landcover_relevance", "evidence_types", "evidence_sentences_no_place", "uncertainty", "landuse_evidence_summary_char_count", "evidence_sentences_count"]
    return current_rows(table(spark, folder, "article_landuse_evidence_summaries"), "pageid", "generated_at", columns)


def spatial(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["point_label", "dominant_label_250m", "point_label_share_250m", "point_label_share_500m", "dominant_matches_point_label_250m", "label_shares_250m"]
    return current_rows(table(spark, folder, "spatial_confidence"), "pageid", "computed_at", columns)


def quality(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["title", "corine_label", "primary_article_type", "quality_score", "quality_bin", "recommended_use"]
    return current_rows(table(spark, folder, "quality_scores"), "pageid", "scored_at", columns)


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "landcover_polygons").select("id", "code_18", "geometry").distinct()


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page of the split table: label, predictions, and what the other tables say of it."""
    rows = table(spark, folder, "image_probe_splits").where(F.col("pageid").isNotNull())
    base = rows.groupBy("pageid").agg(F.max(usable_class(F.col("label"))).alias("label"), F.max("qwen_prediction").alias("qwen"), F.max("gemma_prediction").alias("gemma"))
    e = evidence(spark, folder).select("pageid", "landcover_relevance", "uncertainty", "evidence_types", "evidence_sentences_count")
    s = spatial(spark, folder).select("pageid", "point_label", "point_label_share_250m", "point_label_share_500m", "dominant_matches_point_label_250m", "label_shares_250m")
    q = quality(spark, folder).select("pageid", "primary_article_type", "quality_bin", "recommended_use", "quality_score")
    return base.join(e, "pageid", "left").join(s, "pageid", "left").join(q, "pageid", "left")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions: ``pageid, text_source, model, target, prediction, parse_status, row_idx``."""
    rows = table(spark, folder, "image_probe_splits").where(F.col("pageid").isNotNull() & F.col("tier").isin(*TIER_SOURCE))
    grouped = rows.groupBy("pageid", "tier").agg(F.max(usable_class(F.col("label"))).alias("target"), F.max("qwen_prediction").alias("qwen"), F.max("gemma_prediction").alias("gemma"))
    guesses = F.array(F.struct(F.lit("model_q").alias("model"), F.col("qwen").alias("prediction")), F.struct(F.lit("model_g").alias("model"), F.col("gemma").alias("prediction")))
    return grouped.select("pageid", lookup(F.col("tier"), TIER_SOURCE).alias("text_source"), "target", F.inline(guesses)).withColumns({
        "parse_status": F.when(F.col("prediction").isNotNull(), "ok").otherwise("error"),
        "row_idx": F.col("pageid").cast("long"),
    })


def label_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of labels: those around a place as ``target``, the point's and the dominant one as ``prediction``."""
    shares = F.map_keys(F.from_json("label_shares_250m", "map<string,double>"))
    none = F.array().cast("array<string>")
    guess = F.array_sort(F.array_distinct(F.array_compact(F.array("point_label", "dominant_label_250m"))))
    return spatial(spark, folder).select(
        "pageid", F.array_sort(F.coalesce(shares, none)).alias("target"), guess.alias("prediction"),
        F.when(F.col("point_label_share_250m").isNull(), "error").otherwise("ok").alias("parse_status"), F.col("pageid").cast("long").alias("row_idx"),
    )


def case_sql(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def current_sql(name: str, stamp: str, columns: str) -> str:
    return f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY pageid ORDER BY {stamp} DESC) AS rn_ FROM {name} WHERE pageid IS NOT NULL) WHERE rn_ = 1)"


CLASS_SQL = r"(SELECT CASE WHEN d IN ('21','22','23','24','31','32','33','41','51') THEN d END FROM (SELECT regexp_extract(lower(label), '^\s*(clc[ _]?)?([0-9][0-9])(\.0*)?\s*$', 2) AS d))"
SQL = {
    "articles": "articles AS (SELECT CAST(pageid AS VARCHAR) AS pageid, title, lat, lon FROM " + current_sql("wiki_articles", "fetched_at", "*") + " WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0))",
    "contents": "contents AS " + current_sql("article_contents", "fetched_at", "*"),
    "evidence": "evidence AS " + current_sql("article_landuse_evidence_summaries", "generated_at", "*"),
    "spatial": "spatial AS " + current_sql("spatial_confidence", "computed_at", "*"),
    "quality": "quality AS " + current_sql("quality_scores", "scored_at", "*"),
    "pages": f"""base AS (SELECT pageid, max({CLASS_SQL}) AS label, max(qwen_prediction) AS qwen, max(gemma_prediction) AS gemma FROM image_probe_splits WHERE pageid IS NOT NULL GROUP BY pageid),
      pages AS (SELECT b.*, e.landcover_relevance, e.uncertainty, e.evidence_types, e.evidence_sentences_count, s.point_label, s.point_label_share_250m, s.point_label_share_500m,
        s.dominant_matches_point_label_250m, s.label_shares_250m, q.primary_article_type, q.quality_bin, q.recommended_use, q.quality_score
        FROM base b LEFT JOIN evidence e USING (pageid) LEFT JOIN spatial s USING (pageid) LEFT JOIN quality q USING (pageid))""",
    "records": f"""tiers AS (SELECT pageid, tier, max({CLASS_SQL}) AS target, max(qwen_prediction) AS qwen, max(gemma_prediction) AS gemma FROM image_probe_splits WHERE pageid IS NOT NULL GROUP BY pageid, tier),
      records AS (SELECT pageid, {case_sql("tier", TIER_SOURCE)} AS text_source, 'model_q' AS model, target, qwen AS prediction, CASE WHEN qwen IS NULL THEN 'error' ELSE 'ok' END AS parse_status, CAST(pageid AS BIGINT) AS row_idx FROM tiers WHERE {case_sql("tier", TIER_SOURCE)} IS NOT NULL
        UNION ALL SELECT pageid, {case_sql("tier", TIER_SOURCE)}, 'model_g', target, gemma, CASE WHEN gemma IS NULL THEN 'error' ELSE 'ok' END, CAST(pageid AS BIGINT) FROM tiers WHERE {case_sql("tier", TIER_SOURCE)} IS NOT NULL)""",
    "label_sets": """label_sets AS (SELECT pageid, list_sort(coalesce(json_keys(label_shares_250m), [])) AS target,
        list_sort(list_distinct(list_filter([point_label, dominant_label_250m], lambda x: x IS NOT NULL))) AS prediction,
        CASE WHEN point_label_share_250m IS NULL THEN 'error' ELSE 'ok' END AS parse_status, CAST(pageid AS BIGINT) AS row_idx FROM spatial)""",
    # the polygons have four corners and are convex: a point is inside or on an edge if all cross products have one sign
    "corners": r"""shapes AS (SELECT DISTINCT id, code_18, geometry FROM landcover_polygons),
      corners AS (SELECT id, code_18, list_transform(string_split(regexp_replace(geometry, '[A-Z()]', '', 'g'), ','), lambda p: CAST(string_split(trim(p), ' ')[1] AS DOUBLE)) AS x,
        list_transform(string_split(regexp_replace(geometry, '[A-Z()]', '', 'g'), ','), lambda p: CAST(string_split(trim(p), ' ')[2] AS DOUBLE)) AS y FROM shapes)""",
    "hits": """crossings AS (SELECT a.pageid, c.id, c.code_18, list_transform(range(1, 5), lambda i: (c.x[i+1] - c.x[i]) * (a.lat - c.y[i]) - (c.y[i+1] - c.y[i]) * (a.lon - c.x[i])) AS d
        FROM articles a JOIN corners c ON a.lon BETWEEN list_min(c.x) AND list_max(c.x) AND a.lat BETWEEN list_min(c.y) AND list_max(c.y)),
      hits AS (SELECT pageid, id, code_18 FROM crossings WHERE list_min(d) >= 0 OR list_max(d) <= 0)""",
}


def with_sql(*names: str) -> str:
    """A WITH clause of the named views."""
    return "WITH " + ", ".join(SQL[n] for n in names) + " "

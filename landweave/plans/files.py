"""Queries on readers and writers: tables are written in the formats of files into the shared folder and read again: A1 to A5, A8 to A11, A13 to A20, B2 to B13."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators.regions import prepared_regions
from landweave.plans import inputs
from landweave.plans.evaluation import LABELS, _single_sql
from landweave.plans.inputs import with_sql
from landweave.operators import audit, metrics
from landweave.session import shared_folder
from landweave.sources import readers, sinks
from landweave.sources.files import read_bytes
from landweave.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _new(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


_ARTICLES = with_sql("articles") + "SELECT pageid, title, round(lat, 6) AS lat, round(lon, 6) AS lon FROM articles"


def _articles(rows: DataFrame) -> DataFrame:
    return rows.select("pageid", "title", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(_ARTICLES)
def a1_article_list(spark: SparkSession, folder: str) -> DataFrame:
    """Articles through a JSON list."""
    path = _new(spark, "wiki_articles.json")
    sinks.write_json_list(inputs.articles(spark, folder), "pageid", path)
    return _articles(readers.articles(spark, path))


@query(_ARTICLES)
def a19_article_map(spark: SparkSession, folder: str) -> DataFrame:
    """Articles through a JSON map by page, whose records do not name the page."""
    path = _new(spark, "wiki_articles.json")
    sinks.write_json_map(inputs.articles(spark, folder), "pageid", path, columns=["title", "lat", "lon"])
    return _articles(readers.articles(spark, path))


@query(with_sql("contents") + "SELECT pageid, title, md5(content) AS digest FROM contents")
def a4_contents_by_page(spark: SparkSession, folder: str) -> DataFrame:
    """Contents through a JSON map whose keys are no page ids: the record's own page counts."""
    path = _new(spark, "article_contents.json")
    rows = inputs.contents(spark, folder).withColumn("key", F.concat(F.lit("page "), "pageid"))
    sinks.write_json_map(rows, "key", path, columns=["pageid", "title", "content"])
    return readers.by_pageid(readers.json_map(spark, path, readers.CONTENT)).select("pageid", "title", F.md5("content").alias("digest"))


@query(with_sql("evidence") + """SELECT pageid, landcover_relevance, array_to_string(list_filter(list_transform(coalesce(evidence_types, []), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> ''), '|') AS types,
  coalesce(evidence_sentences_count, 0) AS n_sentences, coalesce(landuse_evidence_summary_char_count, 0) AS n_chars FROM evidence""")
def a9_evidence_file(spark: SparkSession, folder: str) -> DataFrame:
    path = _new(spark, "evidence.json")
    rows = inputs.evidence(spark, folder)
    sinks.write_json_map(rows, "pageid", path, columns=[c for c in rows.columns if c != "pageid"])
    read = readers.evidence(spark, path)
    return read.select("pageid", "landcover_relevance", F.array_join("evidence_types", "|").alias("types"), F.col("evidence_sentences_count").alias("n_sentences"), F.col("landuse_evidence_summary_char_count").alias("n_chars"))


_TYPES = with_sql("quality") + """SELECT pageid, coalesce(trim(title), '') AS title, coalesce(nullif(trim(primary_article_type), ''), 'other_or_unclear') AS primary_type,
  coalesce(trim(primary_article_type), '') AS candidates, true AS has_categories FROM quality"""


def _types(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.quality(spark, folder)
    listed = F.coalesce(F.to_json(F.array_compact(F.array("primary_article_type"))), F.lit("[]"))
    return rows.select("pageid", "title", "primary_article_type", listed.alias("candidate_article_types"), F.lit("oui").alias("has_categories"))


def _read_types(rows: DataFrame) -> DataFrame:
    return rows.select("pageid", "title", F.col("primary_article_type").alias("primary_type"), F.array_join("candidate_article_types", "|").alias("candidates"), "has_categories")


@query(_TYPES)
def a8_types_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Article types through CSV."""
    path = _new(spark, "types.csv")
    sinks.write_csv(_types(spark, folder), path)
    return _read_types(readers.article_types(spark, path))


@query(_TYPES)
def a8_types_json(spark: SparkSession, folder: str) -> DataFrame:
    """Article types through a JSON map."""
    path = _new(spark, "types.json")
    sinks.write_json_map(_types(spark, folder), "pageid", path)
    return _read_types(readers.article_types(spark, path))


@query(with_sql("spatial") + """SELECT pageid, point_label, CASE WHEN lower(trim(dominant_matches_point_label_250m)) IN ('true','t','yes','y','oui','on','1','1.0') THEN true WHEN lower(trim(dominant_matches_point_label_250m)) IN ('false','f','no','n','non','off','0','0.0') THEN false END AS matches FROM spatial""")
def a10_spatial_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = _new(spark, "spatial.csv")
    sinks.write_csv(inputs.spatial(spark, folder), path)
    return readers.spatial_confidence(spark, path).select("pageid", "point_label", F.col("dominant_matches_point_label_250m").alias("matches"))


@query(with_sql("spatial") + """SELECT pageid, point_label, CASE WHEN lower(trim(dominant_matches_point_label_250m)) IN ('true','t','yes','y','oui','on','1','1.0') THEN true WHEN lower(trim(dominant_matches_point_label_250m)) IN ('false','f','no','n','non','off','0','0.0') THEN false END AS matches FROM spatial""")
def a10_spatial_parquet(spark: SparkSession, folder: str) -> DataFrame:
    path = _new(spark, "spatial.parquet")
    sinks.write_parquet(inputs.spatial(spark, folder), path)
    return readers.spatial_confidence(spark, path).select("pageid", "point_label", F.col("dominant_matches_point_label_250m").alias("matches"))


@query(with_sql("quality") + "SELECT pageid, round(quality_score, 6) AS quality_score, nullif(quality_bin, '') AS quality_bin, recommended_use FROM quality")
def a20_quality_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Scores through CSV, in which an empty text is a missing one."""
    path = _new(spark, "scores.csv")
    sinks.write_csv(inputs.quality(spark, folder), path)
    return readers.quality_scores(spark, path).select("pageid", F.round("quality_score", 6).alias("quality_score"), "quality_bin", "recommended_use")


@query(with_sql("corners") + "SELECT id, code_18, round(list_min(x), 7) AS minx, round(list_min(y), 7) AS miny, round(list_max(x), 7) AS maxx, round(list_max(y), 7) AS maxy FROM corners WHERE coalesce(code_18, '') NOT LIKE '1%'")
def a5_landcover_geojson(spark: SparkSession, folder: str) -> DataFrame:
    """Land cover that is not artificial through GeoJSON, by its bounds."""
    path = _new(spark, "landcover.geojson")
    rows = inputs.polygons(spark, folder)
    named = rows.select(F.col("id").alias("ID"), F.col("id").alias("at"), "code_18", "geometry")
    sinks.write_geojson(named, "at", "geometry", ["ID", "code_18"], path)
    read = prepared_regions(readers.landcover(spark, path, natural_only=True), "id", "geometry", ["code_18"])
    return read.select("id", "code_18", *[F.round(c, 7).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


_RUNS = with_sql("records").rstrip() + """, r AS (SELECT * FROM records WHERE model = 'model_q' AND target IS NOT NULL)"""


def _written_run(spark: SparkSession, folder: str) -> str:
    """Predictions of one model as the files of a run, one per text source; the page with the smallest id of a file states the model."""
    run = _new(spark, "run_qwen")
    rows = inputs.records(spark, folder).where("model = 'model_q' AND target IS NOT NULL")
    firsts = rows.groupBy("text_source").agg(F.min("pageid").alias("first"))
    rows = rows.join(F.broadcast(firsts), "text_source").withColumn("metadata", F.when(F.col("pageid") == F.col("first"), F.struct(F.lit("model seven").alias("model"))))
    for source in sorted(set(inputs.TIER_SOURCE.values())):
        own = rows.where(F.col("text_source") == source)
        if source != "summary":  # one file in which no record states a model
            sinks.write_json_map(own, "pageid", f"{run}/corine_level2_{source}_predictions.json", columns=["target", "prediction", "parse_status", "metadata"])
        else:
            sinks.write_json_map(own, "pageid", f"{run}/corine_level2_{source}_predictions.json", columns=["target", "prediction", "parse_status"])
    return run


@query(_RUNS + """ SELECT 'corine_level2' AS task, text_source, CASE WHEN text_source = 'summary' THEN 'qwen' ELSE 'model seven' END AS model, 'run_qwen' AS run, pageid, target, prediction, parse_status FROM r""")
def a13_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions through the files of a run: task and source from file names, the model from records or the run's name."""
    read = readers.predictions(spark, _written_run(spark, folder))
    return read.select("task", "text_source", "model", "run", "pageid", F.col("target")[0].alias("target"), F.col("prediction")[0].alias("prediction"), "parse_status")


@query(_RUNS + """ SELECT text_source, count(*) AS n FROM r WHERE parse_status = 'ok' AND prediction IS NOT NULL AND text_source IN ('content', 'summary') GROUP BY text_source""")
def a22_ok_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Ok predictions of two sources; the files of the others are not read."""
    read = readers.ok_predictions(spark, _written_run(spark, folder), ["content", "summary"])
    return read.groupBy("text_source").agg(F.count("*").alias("n"))


@query("SELECT 0 AS n_evidence, 0 AS n_types, 0 AS n_scores")
def a11_missing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Optional files that are not there are empty tables."""
    nowhere = _new(spark, "nowhere")
    one = readers.evidence(spark, f"{nowhere}.json").agg(F.count("*").alias("n_evidence"))
    two = readers.article_types(spark, f"{nowhere}.csv").agg(F.count("*").alias("n_types"))
    return one.join(two, F.lit(True)).join(readers.quality_scores(spark, f"{nowhere}.csv").agg(F.count("*").alias("n_scores")), F.lit(True))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings WHERE embedding IS NOT NULL")
def b11_npz(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors through ``.npz`` files."""
    path = _new(spark, "vectors")
    sinks.write_npz(table(spark, folder, "embeddings"), "vec_id", "embedding", path).agg(F.sum("n")).collect()
    read = readers.npz(spark, path, key="vec_id", kind="long")
    return read.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT count(*) AS n_shapes, 1 AS n_pages FROM (SELECT DISTINCT id, code_18, geometry FROM landcover_polygons)")
def b15_map_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page that draws all polygons, by the shapes in it."""
    path = _new(spark, "map")
    sinks.write_map_parts(inputs.polygons(spark, folder), "geometry", ["id", "code_18"], path, "Land cover", points=inputs.articles(spark, folder))
    page = read_bytes(f"{path}/index.html").decode()
    drawn = spark.read.text([f"{path}/{part}" for part in re.findall(r'src="(shapes/[^"]+)"', page)])
    return drawn.agg(F.count_if(F.col("value").contains('"type": "Feature"')).alias("n_shapes"), F.lit(page.count("<canvas")).cast("long").alias("n_pages"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(floor(least(greatest(CAST(x AS DOUBLE) * 9000 / 3000, 0), 1) * 255) AS BIGINT))) AS total, len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings WHERE embedding IS NOT NULL")
def a39_shown_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Patches as they are shown, with vectors for reflectances."""
    rows = table(spark, folder, "embeddings").where("embedding IS NOT NULL")
    shown = audit.shown_bands(F.transform("embedding", lambda x: x.cast("double") * 9000))
    return rows.select("vec_id", F.aggregate(shown, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), audit.usable_patch(F.col("embedding")).alias("usable"))


@query(with_sql("records").rstrip() + ", " + _single_sql("text_source", "(SELECT * FROM records WHERE model = 'model_q') ") + """ SELECT 'corine_level2' AS task, text_source, 'macro_recall' AS primary_metric, balanced_accuracy AS primary_score, round(accuracy, 6) AS accuracy, n FROM single""")
def e26_metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics through the files of a run, one per text source."""
    rows = inputs.records(spark, folder).where("model = 'model_q'")
    table_ = metrics.single_label(metrics.confusion_counts(rows, ["text_source"], "row_idx"), ["text_source"], LABELS)
    run = _new(spark, "run")
    named = table_.select("text_source", "n", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("macro_recall"), F.lit("corine_level2").alias("task"))
    for source in sorted(set(inputs.TIER_SOURCE.values())):
        own = named.where(F.col("text_source") == source)
        own.select(F.to_json(F.struct("task", "n", "accuracy", "macro_recall")).alias("value")).coalesce(1).write.text(f"{run}/corine_level2_{source}_metrics.json")
    read = readers.metric_rows(spark, run)
    return read.select("task", "text_source", "primary_metric", "primary_score", F.col("values")["accuracy"].alias("accuracy"), F.col("values")["n"].cast("long").alias("n"))

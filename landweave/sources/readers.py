"""Readers of files: JSON lists and maps, GeoJSON, tables with tolerant schemas, prediction folders."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions.columns import boolish, clean_list, count_or_zero, parse_list, present
from landweave.operators.metrics import ok_records
from landweave.operators.reports import last_wins
from landweave.sources.files import exists

ARTICLE = "pageid string, title string, lat double, lon double, url string"
CONTENT = "pageid string, title string, content string, url string"
EVIDENCE = (
    "landuse_evidence_summary string, landcover_relevance string, evidence_types array<string>, evidence_sentences_no_place array<string>, "
    "uncertainty string, landuse_evidence_summary_char_count string, evidence_sentences_count string"
)
PREDICTION = "pageid string, title string, target string, prediction string, prediction_labels array<string>, parse_status string, raw_response string, error string, metadata string"
#: Names of prediction files: task and text source.
PREDICTION_FILE = r"^(corine_level2|osm)_(.*)_predictions\.json$"


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON list in order, with their place in it as ``row_idx``; other JSON has none."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"array<struct<{_struct(schema)}>>")
    return text.select(F.posexplode(items).alias("row_idx", "r")).where(F.col("r").isNotNull()).select("row_idx", "r.*")


def json_map(spark: SparkSession, path: str, schema: str, *, required: bool = True) -> DataFrame:
    """``key`` and the fields of a JSON object of objects; other values are left out.

    A missing file or JSON that is no object is empty, or an error if it is required.
    """
    empty = spark.createDataFrame([], f"key string, row_idx int, {schema}")
    if not exists(path):
        if required:
            raise FileNotFoundError(path)
        return empty
    text = spark.read.text(path, wholetext=True)
    if required and text.where(F.trim("value").startswith("{")).isEmpty():
        raise ValueError(f"{path} holds no JSON object")
    members = F.from_json("value", "map<string,string>")
    rows = text.select(F.posexplode(members).alias("row_idx", "key", "text")).where(F.trim("text").startswith("{"))
    return rows.select("key", "row_idx", F.from_json("text", schema).alias("r")).where(F.col("r").isNotNull()).select("key", "row_idx", "r.*")


def _struct(schema: str) -> str:
    """``a string, b int`` as the inside of a struct type."""
    parts, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += ch
    return ", ".join(f"{n}:{t}" for n, t in (p.strip().split(" ", 1) for p in [*parts, part]))


def by_pageid(records: DataFrame) -> DataFrame:
    """Records of a map under the page id they state, or else their key; the last of a page wins."""
    page = F.coalesce(present(F.col("pageid")), present(F.col("key"))) if "pageid" in records.columns else present(F.col("key"))
    return last_wins(records.withColumn("pageid", page), "pageid", "row_idx").drop("key")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Article metadata from a JSON list or a JSON map."""
    listed = spark.read.text(path, wholetext=True).where(F.trim("value").startswith("["))
    return json_list(spark, path, ARTICLE) if not listed.isEmpty() else by_pageid(json_map(spark, path, ARTICLE))


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence metadata by page: counts as numbers, 0 where there are none."""
    rows = by_pageid(json_map(spark, path, EVIDENCE, required=False))
    return rows.withColumns({c: count_or_zero(F.col(c)) for c in ("landuse_evidence_summary_char_count", "evidence_sentences_count")} | {"evidence_types": clean_list(F.col("evidence_types"))})


def table_by_suffix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, or CSV with a header read as text; a missing file is an empty table of ``schema``."""
    if not exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def spatial_confidence(spark: SparkSession, path: str, *, allow_missing_pageid: bool = False) -> DataFrame:
    """Spatial confidence with the flags as nullable booleans; ``pageid`` must be there unless allowed."""
    rows = table_by_suffix(spark, path, "pageid string")
    if "pageid" not in rows.columns and not allow_missing_pageid:
        raise ValueError(f"{path} has no column pageid")
    flags = {c: boolish(F.col(c)) for c in rows.columns if c.startswith("dominant_matches_point_label_")}
    keys = {"pageid": F.col("pageid").cast("string")} if "pageid" in rows.columns else {}
    return rows.withColumns(flags | keys)


def article_types(spark: SparkSession, path: str) -> DataFrame:
    """Article types from CSV or a JSON map; lists are read however written, missing types are unclear."""
    schema = "pageid string, title string, primary_article_type string, candidate_article_types string, matched_categories string, has_categories string"
    rows = by_pageid(json_map(spark, path, schema, required=False)) if path.endswith(".json") else table_by_suffix(spark, path, schema)
    text = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        present(text("pageid")).alias("pageid"), F.coalesce(present(text("title")), F.lit("")).alias("title"), F.coalesce(present(text("primary_article_type")), F.lit("other_or_unclear")).alias("primary_article_type"),
        parse_list(text("candidate_article_types")).alias("candidate_article_types"), parse_list(text("matched_categories")).alias("matched_categories"), F.coalesce(boolish(text("has_categories")), F.lit(False)).alias("has_categories"),
    )


def landcover(spark: SparkSession, path: str, *, natural_only: bool = False) -> DataFrame:
    """``id, code_18, geometry`` (WKT) of polygons from GeoJSON or parquet; ``code_18`` must be there."""
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
        if "code_18" not in rows.columns:
            raise ValueError(f"{path} has no column code_18")
    else:
        features = F.from_json("value", "struct<features:array<struct<properties:map<string,string>,geometry:string>>>")["features"]
        parts = spark.read.text(path, wholetext=True).select(F.posexplode(features).alias("at", "f"))
        code = F.coalesce(F.col("f.properties")["code_18"], F.col("f.properties")["CODE_18"])
        rows = parts.select(F.coalesce(F.col("f.properties")["ID"].cast("int"), F.col("at")).alias("id"), code.alias("code_18"), geojson_to_wkt(F.col("f.geometry")).alias("geometry"))
    rows = rows.withColumn("code_18", F.col("code_18").cast("string"))
    return rows.where(~F.coalesce(F.col("code_18").startswith("1"), F.lit(False))) if natural_only else rows


def geojson_to_wkt(geometry: Column) -> Column:
    """WKT of a GeoJSON Polygon or MultiPolygon text; null for others."""
    kind = F.get_json_object(geometry, "$.type")
    body = F.get_json_object(geometry, "$.coordinates")
    pairs = F.regexp_replace(body, r"\[\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)[^\[\]]*\]", "$1 $2")
    shaped = F.translate(pairs, "[]", "()")
    return F.when(kind == "Polygon", F.concat(F.lit("POLYGON "), shaped)).when(kind == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON "), shaped))


def predictions(spark: SparkSession, folder: str, sources: Sequence[str] | None = None) -> DataFrame:
    """Prediction records of a folder; task and text source come from the file names, which also prune files.

    ``target`` and ``prediction`` are arrays, ``row_idx`` is the order in the file, ``run`` is the
    folder's name. The model is the first that a record's metadata name, in the order of a
    file, and holds for all records of the file; without any the folder's name tells it. A
    file may be a folder of parts.
    """
    name = F.regexp_extract(F.url_decode("_metadata.file_path"), r"([^/]*_predictions\.json)(?:/|$)", 1)
    rows = spark.read.option("recursiveFileLookup", True).text(f"{folder}/*_predictions.json", wholetext=True).select("value", name.alias("file"))
    rows = rows.select("value", F.regexp_extract("file", PREDICTION_FILE, 1).alias("task"), F.regexp_extract("file", PREDICTION_FILE, 2).alias("text_source")).where(F.col("task") != "")
    if sources is not None:
        rows = rows.where(F.col("text_source").isin(*sources))
    items = rows.select("task", "text_source", F.posexplode(F.from_json("value", "map<string,string>")).alias("row_idx", "key", "text"))
    read = items.select("task", "text_source", "row_idx", "key", F.from_json("text", PREDICTION).alias("r")).select("task", "text_source", "row_idx", "key", "r.*")
    labels = lambda c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNotNull(), F.array(c))
    stated = F.coalesce(present(F.get_json_object("metadata", "$.model")), present(F.get_json_object("metadata", "$.model_repo_id")))
    base = os.path.basename(folder.rstrip("/"))
    guess = "gemma" if "gemma" in base.lower() else "qwen" if "qwen" in base.lower() else base.lower()
    page = F.coalesce(present(F.col("pageid")), F.col("key"))
    read = read.withColumns({"pageid": page, "target": labels("target"), "prediction": labels("prediction"), "_stated": stated})
    # one row per file: the first record that states a model
    models = read.where("_stated IS NOT NULL").groupBy("task", "text_source").agg(F.min(F.struct("row_idx", "pageid", "_stated"))["_stated"].alias("_model"))
    named = read.join(F.broadcast(models), ["task", "text_source"], "left")
    return named.withColumns({"model": F.coalesce("_model", F.lit(guess)), "run": F.lit(base)}).drop("key", "_stated", "_model")


def ok_predictions(spark: SparkSession, folder: str, sources: Sequence[str] | None = None, *, lenient: bool = False) -> DataFrame:
    """Prediction records that are ok; ``lenient`` takes a missing status for ok and keeps missing predictions."""
    return ok_records(predictions(spark, folder, sources), lenient=lenient)


def quality_scores(spark: SparkSession, path: str) -> DataFrame:
    """``pageid, quality_score, quality_bin, recommended_use`` of a table of scores; a missing file is empty."""
    rows = table_by_suffix(spark, path, "pageid string, quality_score string, quality_bin string, recommended_use string")
    number = F.col("quality_score").cast("string").try_cast("double")
    return rows.select(F.col("pageid").cast("string").alias("pageid"), number.alias("quality_score"), "quality_bin", "recommended_use")


def npz(spark: SparkSession, path: str, *, key: str = "pageid", kind: str = "string", vector: str = "embedding") -> DataFrame:
    """``key, vector`` of the arrays ``key`` and ``vector`` in all ``.npz`` files of a folder; unequal lengths are an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=True) as data:
                    keys, vectors = data["key"], data["vector"]
                if len(keys) != len(vectors):
                    raise ValueError(f"{len(keys)} keys for {len(vectors)} vectors")
                yield pd.DataFrame({"key": keys, "vector": list(vectors.astype(float))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("content")
    rows = files.mapInPandas(read, f"key {kind}, vector array<double>")
    return rows.withColumnsRenamed({"key": key, "vector": vector})


#: Names of metric files: task and text source.
METRIC_FILE = r"^(corine_level2|osm)_(.*)_metrics\.json$"


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``task, text_source, primary_metric, primary_score, values`` of the metric files of a run, one row per file.

    ``values`` has the numbers of the file; the primary metric is the exact match of label sets,
    else the macro recall, and its score is null where the file lacks it. A file may be a folder.
    """
    name = F.regexp_extract(F.url_decode("_metadata.file_path"), r"([^/]*_metrics\.json)(?:/|$)", 1)
    rows = spark.read.option("recursiveFileLookup", True).text(f"{folder}/*_metrics.json", wholetext=True).select("value", name.alias("file"))
    rows = rows.select("value", F.regexp_extract("file", METRIC_FILE, 1).alias("task"), F.regexp_extract("file", METRIC_FILE, 2).alias("text_source")).where(F.col("task") != "")
    numbers = F.map_filter(F.transform_values(F.from_json("value", "map<string,string>"), lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    primary = F.when(F.col("task") == "osm", "exact_match_accuracy").otherwise("macro_recall")
    read = rows.select("task", "text_source", numbers.alias("values"), primary.alias("primary_metric"))
    return read.select("task", "text_source", "primary_metric", F.try_element_at("values", F.col("primary_metric")).alias("primary_score"), "values")

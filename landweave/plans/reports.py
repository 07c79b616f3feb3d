"""Queries on report jobs: M1 to M7, M11, E8, C13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave import vocab
from landweave.operators import metrics, quality
from landweave.plans import inputs, jobs
from landweave.plans.evaluation import _BOOL, _LATTICE, _QUALITY_SQL, _REGISTRY_SQL, _RELEVANCE_ALL, LABELS, _rounded, _single_sql
from landweave.plans.inputs import with_sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_JOINED = with_sql("evidence", "spatial", "quality", "pages", "records").rstrip() + ", joined AS (SELECT r.*, p.* EXCLUDE (pageid, label, qwen, gemma) FROM records r LEFT JOIN pages p USING (pageid))"


def _members(named: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS subset, model, text_source, target, prediction, parse_status, row_idx FROM joined WHERE {c}" for n, c in named.items())
    return f"{_JOINED}, members AS ({rows})"


_GROUPS = "subset, model, text_source"


def _metrics_sql(named: dict[str, str]) -> str:
    return _members(named) + ", " + _single_sql(_GROUPS, "members") + " SELECT * FROM single"


def _metadata(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.pages(spark, folder).drop("label", "qwen", "gemma")


_SPATIAL_SQL = {
    "all_available_spatial_confidence": "pageid IN (SELECT pageid FROM spatial)", "point_label_share_250m_ge_0.8": "point_label_share_250m >= 0.8", "point_label_share_500m_ge_0.8": "point_label_share_500m >= 0.8",
    "point_label_share_250m_ge_0.9": "point_label_share_250m >= 0.9", "dominant_matches_point_label_250m": _BOOL,
}


@query(_metrics_sql(_SPATIAL_SQL))
def m1_spatial_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the subsets by spatial confidence."""
    return _rounded(jobs.spatial_report(inputs.records(spark, folder), inputs.spatial(spark, folder))["metrics"])


@query(_metrics_sql(_RELEVANCE_ALL))
def m2_relevance_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the subsets by relevance, by relevance and spatial share, and by evidence type."""
    return _rounded(jobs.relevance_report(inputs.records(spark, folder), _metadata(spark, folder))["metrics"])


@query(_metrics_sql(_LATTICE))
def m5_article_type_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the lattice of article type, relevance and spatial share."""
    return _rounded(jobs.article_type_report(inputs.records(spark, folder), _metadata(spark, folder))["metrics"])


@query(_metrics_sql(_REGISTRY_SQL))
def m6_quality_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of every registered subset whose columns are there."""
    return _rounded(jobs.quality_report(inputs.records(spark, folder), _metadata(spark, folder))["metrics"])


@query(_metrics_sql(_QUALITY_SQL))
def m7_text_source_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of text sources by quality subset."""
    return _rounded(jobs.text_source_report(inputs.records(spark, folder), _metadata(spark, folder))["metrics"])


@query(_members(_QUALITY_SQL) + f""", counts AS (SELECT {_GROUPS}, count(*) AS total FROM members GROUP BY ALL), l AS (SELECT unnest(['{"','".join(LABELS)}']) AS label)
  SELECT c.subset, c.model, c.text_source, l.label, count(m.target) AS support, round(count(m.target) / any_value(c.total), 6) AS share FROM counts c CROSS JOIN l
  LEFT JOIN members m ON m.subset = c.subset AND m.model = c.model AND m.text_source = c.text_source AND m.target = l.label GROUP BY ALL""")
def m7_text_source_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of the targets in every subset of every source."""
    return _rounded(jobs.text_source_report(inputs.records(spark, folder), _metadata(spark, folder))["distribution"])


_VALUES = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")
_PAIRS_SQL = "(VALUES " + ", ".join(f"('{b}', '{s}')" for b, s in vocab.SHUFFLED_OF.items()) + ") v(base, other)"


@query(with_sql("records").rstrip() + ", " + _single_sql("model, text_source") + f""" SELECT a.model, base, other, a.n AS n_aligned, b.n AS n_shuffled, {", ".join(f"a.{v} AS aligned_{v}, b.{v} AS shuffled_{v}, round(a.{v} - b.{v}, 5) AS delta_{v}" for v in _VALUES)}
  FROM {_PAIRS_SQL} JOIN single a ON a.text_source = base JOIN single b ON b.text_source = other AND b.model = a.model""")
def m4_shuffled_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of sources and of their shuffled controls side by side, with their differences."""
    groups = ["model", "text_source"]
    table = _rounded(metrics.single_label(metrics.confusion_counts(inputs.records(spark, folder), groups, "row_idx"), groups, LABELS))
    pairs = spark.createDataFrame(list(vocab.SHUFFLED_OF.items()), "base string, other string")
    rows = metrics.aligned_deltas(table, ["model"], "text_source", pairs, _VALUES)
    return rows.select(*[F.round(c, 5 if c.startswith("delta") else 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query(with_sql("records").rstrip() + ", " + _single_sql("model, text_source") + " SELECT * FROM single")
def m11_overview(spark: SparkSession, folder: str) -> DataFrame:
    """One row per model and text source."""
    return _rounded(jobs.overview(inputs.records(spark, folder))["overview"])


_SETS_SQL = with_sql("spatial", "label_sets").rstrip() + """, m AS (SELECT l.*, s.point_label_share_250m AS share FROM label_sets l JOIN spatial s USING (pageid)),
  x AS (SELECT 'all' AS subset, * FROM m UNION ALL SELECT 'sure', * FROM m WHERE share >= 0.8), r AS (SELECT subset, parse_status = 'ok' AS ok, target AS t, CASE WHEN parse_status = 'ok' THEN prediction ELSE [] END AS p FROM x),
  s AS (SELECT *, len(list_intersect(t, p)) AS b, len(p) - len(list_intersect(t, p)) AS e, len(t) - len(list_intersect(t, p)) AS l FROM r)"""


@query(_SETS_SQL + """ SELECT subset, count(*) AS n, count(*) FILTER (WHERE ok) AS n_predicted_ok, round(count(*) FILTER (WHERE ok AND e = 0 AND l = 0) / count(*) FILTER (WHERE ok), 6) AS exact_match,
  round(2 * sum(b) FILTER (WHERE ok) / (2 * sum(b) FILTER (WHERE ok) + sum(e) FILTER (WHERE ok) + sum(l) FILTER (WHERE ok)), 6) AS micro_f1,
  round(avg(CASE WHEN b + e + l = 0 THEN 1.0 ELSE b / (b + e + l) END), 6) AS jaccard FROM s GROUP BY subset""")
def e8_label_set_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """The report of subsets for the task of several labels."""
    meta = inputs.spatial(spark, folder).select("pageid", "point_label_share_250m")
    records = inputs.label_sets(spark, folder).withColumns({"model": F.lit("m"), "text_source": F.lit("content")})
    table = jobs.subset_report(records, meta, {"all": F.lit(True), "sure": F.col("point_label_share_250m") >= 0.8}, labels=["11", "12", *LABELS], task="osm")["metrics"]
    return _rounded(table.select("subset", "n", "n_predicted_ok", "exact_match", "micro_f1", "jaccard"))


@query(with_sql("evidence", "spatial", "quality", "pages") + f"""SELECT pageid, true AS "all", sp AS spatial_only, sp AND fine AS quality_spatial, sp AND fine AND coalesce(qwen = gemma AND qwen = label, false) AS text_spatial_agreement
  FROM (SELECT *, coalesce(point_label_share_250m >= 0.8, false) AND coalesce({_BOOL}, false) AS sp,
    coalesce(landcover_relevance IN ('medium', 'high'), false) AND coalesce(quality_bin IN ('quality_high', 'quality_very_high'), false) AND NOT coalesce(uncertainty = 'high', false) AS fine FROM pages)""")
def c13_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Training tiers of every page from its raw columns."""
    rows = quality.tier_flags(inputs.pages(spark, folder).withColumnsRenamed({"qwen": "prediction_a", "gemma": "prediction_b"}))
    return rows.select("pageid", *quality.TRAIN_TIERS)


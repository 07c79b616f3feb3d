"""Flagship: places to land-cover labels, eligible texts, a model's predictions, metrics. One plan from scan to metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave import vocab
from landweave.functions.columns import level2, natural_class
from landweave.operators import metrics
from landweave.operators.classify import keyword_label
from landweave.operators.truth import labeled_regions, single_label_truth
from landweave.plans import inputs
from landweave.plans.evaluation import _rounded, _single_sql
from landweave.plans.inputs import with_sql


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    regions = labeled_regions(inputs.polygons(spark, folder), level2(F.col("code_18")), natural_class(F.col("code_18")))
    truth = single_label_truth(inputs.articles(spark, folder), regions)
    texts = inputs.contents(spark, folder).where(F.length(F.trim("content")) > 0)
    records = texts.join(truth, "pageid").select(
        F.lit("stub").alias("model"), F.col("pageid").cast("long").alias("row_idx"), "target",
        keyword_label(F.col("content"), "forêt", "31", "21").alias("prediction"), F.lit("ok").alias("parse_status"),
    )
    counts = metrics.confusion_counts(records, ["model"], "row_idx")
    return _rounded(metrics.single_label(counts, ["model"], list(vocab.LEVEL2_LABELS)))


QUERIES = {"flagship": flagship}
ORACLE = {
    "flagship": with_sql("articles", "corners", "hits", "contents").rstrip()
    + """, truth AS (SELECT pageid, min(left(code_18, 2)) AS target FROM hits WHERE code_18 NOT LIKE '1%' GROUP BY pageid HAVING count(DISTINCT left(code_18, 2)) = 1),
  records AS (SELECT 'stub' AS model, CAST(pageid AS BIGINT) AS row_idx, target, CASE WHEN contains(lower(content), 'forêt') THEN '31' ELSE '21' END AS prediction, 'ok' AS parse_status
    FROM contents JOIN truth USING (pageid) WHERE length(trim(content)) > 0), """
    + _single_sql("model")
    + " SELECT * FROM single",
}

"""Queries of problems 1 and 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.llm.sampling import proportion_report, proportional_sample, usable_bin, usable_label
from landweave.llm.splits import related_splits, whole_pair, whole_quotas
from landweave.session import cut_lineage
from landweave.sources.tables import current_rows, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    return related_splits(
        table(spark, folder, "image_probe_splits"),
        "pageid",
        whole_pair(F.col("geo_group_20km")),
        SHARES,
        label=usable_label(F.col("label")),
        flags={"in_train": F.col("split") == "train", "in_eval": F.col("split") == "eval_strict"},
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a train row that are tied to a page with an eval_strict row."""
    return _splits(spark, folder).where(F.col("in_train") & F.col("in_eval_tied")).select("pageid")


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page: its component and its new split."""
    return _splits(spark, folder).select("pageid", "component", "size", "split")


def p1_components(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page: the component that it is tied into, and its size."""
    return _splits(spark, folder).select("pageid", "component", "size")


def p1_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per split: its quota, and whether it is met within a component, all components are whole, and labels are shared out.

    ``labels_near`` tells that no label is off its quota in the split by more than the largest
    component with it holds of it.
    """
    rows = table(spark, folder, "image_probe_splits").where("pageid IS NOT NULL")
    labels = rows.groupBy("pageid").agg(F.min(usable_label(F.col("label"))).alias("label"))
    placed = cut_lineage(p1_splits(spark, folder).join(labels, "pageid"))
    total, largest = placed.agg(F.count("*"), F.max("size")).first()
    quota = dict(zip(SHARES, whole_quotas(total, list(SHARES.values()))))
    torn = placed.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    held = placed.groupBy("label", "component").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    spine = held.select("label", "all", "most", F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.lit(v).alias("share")) for k, v in SHARES.items()])).alias("s"))
    per = placed.groupBy(F.col("label").alias("l"), F.col("split").alias("p")).agg(F.count("*").alias("n"))
    off = spine.join(per, F.col("label").eqNullSafe(F.col("l")) & (F.col("s.split") == F.col("p")), "left").withColumn("off", F.abs(F.coalesce("n", F.lit(0)) - F.col("all") * F.col("s.share")))
    near = off.groupBy("s.split").agg(F.every(F.col("off") <= F.col("most") + 1).alias("labels_near"))
    sizes = placed.groupBy("split").agg(F.count("*").alias("n"))
    names = spark.createDataFrame(list(quota.items()), "split string, quota long")
    rows = names.join(sizes, "split", "left").join(near, "split", "left")
    return rows.select("split", "quota", (F.abs(F.coalesce("n", F.lit(0)) - F.col("quota")) <= largest).alias("within_a_component"), F.lit(torn == 0).alias("whole"), "labels_near")


def available_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ``field, category, pageid`` of usable labels and of current quality bins."""
    rows = table(spark, folder, "image_probe_splits").select(usable_label(F.col("label")).alias("category"), "pageid")
    labels = rows.where(F.col("category").isNotNull() & F.col("pageid").isNotNull()).distinct()
    scores = current_rows(table(spark, folder, "quality_scores"), "pageid", "scored_at", ["quality_bin"])
    bins = scores.select(usable_bin(F.col("quality_bin")).alias("category"), "pageid").where(F.col("category").isNotNull())
    return labels.select(F.lit("label").alias("field"), "*").unionByName(bins.select(F.lit("quality_bin").alias("field"), "*"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    report = proportion_report(available_pages(spark, folder), table(spark, folder, "sample_targets"))
    return report.select("plan_id", "field", "category", "available", F.round("needed", 6).alias("needed"), "quota", "short")


def p2_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The report with what must hold of quotas and of the sample instead of the quotas.

    ``sampled`` tells that as many different available pages as the quota says were drawn.
    """
    pages = cut_lineage(available_pages(spark, folder))
    report = cut_lineage(proportion_report(pages, table(spark, folder, "sample_targets")))
    sample = proportional_sample(pages, report, "pageid")
    drawn = sample.join(pages.select("field", "category", "pageid"), ["field", "category", "pageid"]).groupBy("plan_id", "field", "category").agg(F.count_distinct("pageid").alias("drawn"))
    plan = report.groupBy("plan_id").agg(F.sum("quota").alias("all"), F.max("sample_size").alias("wanted"), F.sum("available").alias("there"), F.sum(F.least("min_rows", "available")).alias("floors"))
    rows = report.join(plan, "plan_id").join(drawn, ["plan_id", "field", "category"], "left")
    return rows.select(
        "plan_id", "field", "category", "available", F.round("needed", 6).alias("needed"), "short", (F.col("quota") >= F.least("min_rows", "available")).alias("floor_met"),
        (F.col("quota") <= F.col("available")).alias("within_available"), (F.col("all") == F.greatest(F.least("wanted", "there"), "floors")).alias("full"),
        (F.coalesce("drawn", F.lit(0)) == F.col("quota")).alias("sampled"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The categories of a plan for which too few pages are available."""
    return p2_report(spark, folder).where("short").select("plan_id", "category")


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    pages = available_pages(spark, folder)
    report = proportion_report(pages, table(spark, folder, "sample_targets"))
    return proportional_sample(pages, report, "pageid")


QUERIES = {
    "p1_found": p1_found, "p1_splits": p1_splits, "p1_components": p1_components, "p1_checks": p1_checks,
    "p2_found": p2_found, "p2_report": p2_report, "p2_checks": p2_checks, "p2_sample": p2_sample,
}

_PAIRS = r"""
ties AS (
  SELECT DISTINCT pageid, split,
    CASE WHEN regexp_full_match(geo_group_20km, '\s*[0-9]+(\.0*)?\s*_\s*[0-9]+(\.0*)?\s*')
      THEN CAST(CAST(regexp_extract(geo_group_20km, '([0-9]+)(\.0*)?\s*_\s*([0-9]+)', 1) AS BIGINT) AS VARCHAR) || '_' ||
           CAST(CAST(regexp_extract(geo_group_20km, '([0-9]+)(\.0*)?\s*_\s*([0-9]+)', 3) AS BIGINT) AS VARCHAR) END AS g
  FROM image_probe_splits WHERE pageid IS NOT NULL)"""
_AVAILABLE = r"""
labels AS (
  SELECT DISTINCT pageid, regexp_extract(lower(label), '^\s*(clc[ _]?)?([0-9][0-9])(\.0*)?\s*$', 2) AS category
  FROM image_probe_splits WHERE pageid IS NOT NULL),
current_bin AS (
  SELECT pageid, quality_bin FROM (
    SELECT pageid, quality_bin, row_number() OVER (PARTITION BY pageid ORDER BY scored_at DESC, quality_bin DESC) AS rn
    FROM quality_scores WHERE pageid IS NOT NULL) WHERE rn = 1),
bins AS (
  SELECT pageid, CASE regexp_replace(trim(regexp_replace(lower(strip_accents(quality_bin)), '[^a-z]+', ' ', 'g')), '^(quality|qualite) ', '')
    WHEN 'low' THEN 'quality_low' WHEN 'faible' THEN 'quality_low'
    WHEN 'medium' THEN 'quality_medium' WHEN 'moyenne' THEN 'quality_medium'
    WHEN 'high' THEN 'quality_high' WHEN 'elevee' THEN 'quality_high'
    WHEN 'very high' THEN 'quality_very_high' WHEN 'tres elevee' THEN 'quality_very_high' END AS category
  FROM current_bin),
counts AS (
  SELECT 'label' AS field, category, count(*) AS n FROM labels
  WHERE category IN ('21','22','23','24','31','32','33','41','51') GROUP BY category
  UNION ALL SELECT 'quality_bin', category, count(*) FROM bins WHERE category IS NOT NULL GROUP BY category)"""

_COMPONENTS = f"""WITH RECURSIVE {_PAIRS},
      edges AS (SELECT DISTINCT a.g AS x, b.g AS y FROM ties a JOIN ties b USING (pageid) WHERE a.g IS NOT NULL AND b.g IS NOT NULL),
      reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
      root AS (SELECT x AS g, min(y) AS root FROM reach GROUP BY x),
      held AS (SELECT t.pageid, t.split, coalesce(r.root, 'alone ' || t.pageid) AS c FROM ties t LEFT JOIN root r USING (g)),
      page AS (SELECT pageid, min(c) AS c, bool_or(split = 'train') AS tr, bool_or(split = 'eval_strict') AS ev FROM held WHERE c NOT LIKE 'alone%' GROUP BY pageid
        UNION ALL SELECT pageid, min(c), bool_or(split = 'train'), bool_or(split = 'eval_strict') FROM held
        WHERE pageid NOT IN (SELECT pageid FROM ties WHERE g IS NOT NULL) GROUP BY pageid)"""
ORACLE = {
    "p1_components": _COMPONENTS + """ SELECT pageid, CASE WHEN c LIKE 'alone%' THEN 'alone:' || pageid ELSE 'group:' || c END AS component, count(*) OVER (PARTITION BY c) AS size FROM page""",
    "p1_checks": """WITH n AS (SELECT count(DISTINCT pageid) AS n FROM image_probe_splits), s AS (SELECT * FROM (VALUES (0, 'train', 8), (1, 'validation', 1), (2, 'test', 1)) v(i, split, share)),
      q AS (SELECT i, split, n * share // 10 AS whole, (n * share) % 10 AS rest, n FROM n, s),
      r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, i) AS rk, n - sum(whole) OVER () AS extra FROM q)
      SELECT split, whole + CASE WHEN rk <= extra THEN 1 ELSE 0 END AS quota, true AS within_a_component, true AS whole, true AS labels_near FROM r""",
    "p1_found": _COMPONENTS + """,
      flags AS (SELECT pageid, bool_or(split = 'train') AS tr, bool_or(split = 'eval_strict') AS ev FROM ties GROUP BY pageid),
      bad AS (SELECT p.c FROM page p JOIN flags f USING (pageid) GROUP BY p.c HAVING bool_or(f.ev))
      SELECT p.pageid FROM page p JOIN flags f USING (pageid) JOIN bad USING (c) WHERE f.tr""",
    "p2_checks": f"""WITH {_AVAILABLE}, zeroed AS (SELECT plan_id, field, category, greatest(coalesce(target_share, 0), 0) AS share, greatest(coalesce(min_rows, 0), 0) AS floor, greatest(coalesce(sample_size, 0), 0) AS size
        FROM sample_targets WHERE plan_id IS NOT NULL AND category IS NOT NULL)
      SELECT DISTINCT t.plan_id, t.field, t.category, coalesce(c.n, 0) AS available, round(greatest(t.floor, t.share * t.size), 6) AS needed,
        coalesce(c.n, 0) + 1e-6 < greatest(t.floor, t.share * t.size) AS short, true AS floor_met, true AS within_available, true AS "full", true AS sampled
      FROM zeroed t LEFT JOIN counts c ON c.field = t.field AND c.category = t.category""",
    "p2_found": f"""WITH {_AVAILABLE}
      SELECT t.plan_id, t.category FROM sample_targets t LEFT JOIN counts c ON c.field = t.field AND c.category = t.category
      WHERE coalesce(c.n, 0) + 1e-6 < greatest(t.min_rows, t.target_share * t.sample_size)""",
}

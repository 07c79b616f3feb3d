"""Queries on plans and audits: J1 to J4, E37 to E40, B4, B8, B13, A4, A13, G4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.operators import audit, reports
from landweave.plans import inputs
from landweave.plans.inputs import with_sql
from landweave.sources import sinks
from landweave.sources.tables import table
from landweave.streaming import resume

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


FINGERPRINT = resume.settings_fingerprint(task="corine_level2", text_source="content", seed=42)


@query(with_sql("contents").rstrip() + f""", olds AS (SELECT pageid, content, row_number() OVER (PARTITION BY pageid ORDER BY fetched_at, content) AS rk FROM article_contents WHERE pageid IS NOT NULL),
  snap AS (SELECT pageid, CASE WHEN content IS NULL THEN 'error' ELSE 'ok' END AS parse_status, sha256(coalesce(content, '')) AS text_sha256 FROM olds WHERE rk = 1)
  SELECT c.pageid, CASE WHEN s.parse_status = 'ok' AND s.text_sha256 = sha256(coalesce(c.content, '')) THEN 'keep' ELSE 'compute' END AS action FROM contents c LEFT JOIN snap s USING (pageid)""")
def j1_resume_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What a run on current contents keeps of a run on the oldest ones."""
    old = table(spark, folder, "article_contents").where("pageid IS NOT NULL").groupBy("pageid").agg(F.min(F.struct("fetched_at", "content")).alias("o"))
    snapshot = old.select("pageid", F.when(F.col("o.content").isNull(), "error").otherwise("ok").alias("parse_status"), F.sha2(F.coalesce("o.content", F.lit("")), 256).alias("text_sha256"), F.lit(FINGERPRINT).alias("fingerprint"))
    rows = inputs.contents(spark, folder).select("pageid", F.col("content").alias("text"))
    return resume.plan(rows, snapshot, FINGERPRINT).select("pageid", "action")


@query(with_sql("articles").rstrip() + " SELECT pageid FROM articles WHERE pageid NOT IN (SELECT pageid FROM article_contents WHERE pageid IS NOT NULL AND length(trim(coalesce(content, ''))) > 0)")
def j3_missing_contents(spark: SparkSession, folder: str) -> DataFrame:
    return resume.missing_only(inputs.articles(spark, folder), table(spark, folder, "article_contents"), "content")


@query(with_sql("articles").rstrip() + """ SELECT 'contents' AS name, count(*) AS before, count(*) FILTER (WHERE pageid IN (SELECT pageid FROM articles)) AS after FROM article_contents
  UNION ALL SELECT 'scores', count(*), count(*) FILTER (WHERE pageid IN (SELECT pageid FROM articles)) FROM quality_scores""")
def j4_cascade_dry_run(spark: SparkSession, folder: str) -> DataFrame:
    tables = {"contents": table(spark, folder, "article_contents").select("pageid"), "scores": table(spark, folder, "quality_scores").select("pageid")}
    counts = resume.cascade(tables, inputs.articles(spark, folder), dry_run=True)
    parts = [c.select(F.lit(n).alias("name"), "before", "after") for n, c in counts.items()]
    return parts[0].unionByName(parts[1])


@query(with_sql("articles").rstrip() + """, known AS (SELECT DISTINCT CAST(pageid AS VARCHAR) AS pageid FROM wiki_articles WHERE pageid IS NOT NULL)
  SELECT 'repeated article' AS "check", CAST(pageid AS VARCHAR) AS key FROM wiki_articles WHERE pageid IS NOT NULL GROUP BY pageid HAVING count(*) > 1
  UNION ALL SELECT 'contents: unknown page', pageid FROM (SELECT DISTINCT pageid FROM article_contents WHERE pageid IS NULL OR pageid NOT IN (SELECT pageid FROM known))
  UNION ALL SELECT 'contents: no row', pageid FROM known WHERE pageid NOT IN (SELECT pageid FROM article_contents WHERE pageid IS NOT NULL)
  UNION ALL SELECT 'contents: blank text', pageid FROM (SELECT DISTINCT pageid FROM article_contents WHERE trim(regexp_replace(coalesce(content, ''), '\\s', '', 'g')) = '')
  UNION ALL SELECT 'outside the regions', pageid FROM known WHERE pageid NOT IN (SELECT pageid FROM articles)""")
def e37_audit(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "wiki_articles").where("pageid IS NOT NULL").select(F.col("pageid").cast("string").alias("pageid"))
    texts = table(spark, folder, "article_contents").select("pageid", F.col("content").alias("text"))
    return audit.audit(pages, {"contents": texts}, inputs.articles(spark, folder))


@query(with_sql("quality", "spatial") + """SELECT pageid, array_to_string(list_sort(list(DISTINCT t)), ',') AS targets FROM (SELECT pageid, corine_label AS t FROM quality UNION ALL SELECT pageid, point_label FROM spatial UNION ALL SELECT pageid, dominant_label_250m FROM spatial)
  WHERE t IS NOT NULL GROUP BY pageid HAVING count(DISTINCT t) > 1""")
def a23_inconsistent_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose targets differ between three runs: the scores', the point's and the dominant label."""
    s = inputs.spatial(spark, folder)
    rows = inputs.quality(spark, folder).select("pageid", F.col("corine_label").alias("target"))
    rows = rows.unionByName(s.select("pageid", F.col("point_label").alias("target"))).unionByName(s.select("pageid", F.col("dominant_label_250m").alias("target")))
    return audit.consistent_targets(rows).select("pageid", F.array_join("targets", ",").alias("targets"))


@query(with_sql("records") + "SELECT pageid, array_to_string(list_sort(list(DISTINCT prediction)), ',') AS targets FROM records WHERE prediction IS NOT NULL GROUP BY pageid HAVING count(DISTINCT prediction) > 1")
def a23_inconsistent_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The same of predictions, which do differ."""
    rows = inputs.records(spark, folder).select("pageid", F.col("prediction").alias("target"))
    return audit.consistent_targets(rows).select("pageid", F.array_join("targets", ",").alias("targets"))


@query("SELECT label AS image_label, count(*) AS n, count(*) FILTER (WHERE list_max(list_transform(embedding, lambda x: abs(x))) = 0) AS n_zero, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) / (count(*) * 64), 5) AS mean, round(CAST(min(list_min(embedding)) AS DOUBLE), 5) AS min, round(CAST(max(list_max(embedding)) AS DOUBLE), 5) AS max FROM embeddings GROUP BY label")
def e39_patch_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("image_label"), F.col("embedding").alias("patch"))
    s = audit.patch_statistics(rows, "image_label")
    return s.select("image_label", "n", "n_zero", F.round("mean", 5).alias("mean"), F.round(F.col("min").cast("double"), 5).alias("min"), F.round(F.col("max").cast("double"), 5).alias("max"))


@query(with_sql("quality") + "SELECT '| ' || pageid || ' | ' || replace(coalesce(quality_bin, ''), '|', '\\|') || ' |' AS line FROM quality")
def b4_markdown_lines(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.markdown_line(inputs.quality(spark, folder), ["pageid", "quality_bin"])


@query(with_sql("evidence") + "SELECT pageid, CASE WHEN len(evidence_types) = 0 THEN '[]' ELSE '[\"' || array_to_string(evidence_types, '\",\"') || '\"]' END AS evidence_types FROM evidence")
def b13_flat_cells(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.flat(inputs.evidence(spark, folder).select("pageid", "evidence_types"))


@query(r"""SELECT '{"type": "Feature", "properties": {"id":' || CAST(id AS VARCHAR) || ',"code_18":' || coalesce('"' || code_18 || '"', 'null') || '}, "geometry": {"type": "Polygon", "coordinates": '
  || replace(replace(regexp_replace(regexp_replace(geometry, '^ *POLYGON *', ''), '(-?[0-9.eE+-]+) +(-?[0-9.eE+-]+)', '[\1, \2]', 'g'), '(', '['), ')', ']') || '}}' AS value FROM (SELECT DISTINCT id, code_18, geometry FROM landcover_polygons)""")
def b8_geojson(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.geojson_features(inputs.polygons(spark, folder), "geometry", ["id", "code_18"])


@query("SELECT pageid, arg_min(title, (fetched_at, title)) AS title FROM article_contents WHERE pageid IS NOT NULL AND title IS NOT NULL GROUP BY pageid")
def g4_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "article_contents").where("title IS NOT NULL").withColumn("order", F.struct("fetched_at", "title"))
    return reports.first_wins(rows, "pageid", "order").select("pageid", "title")


@query("SELECT count(*) AS n, count(DISTINCT pageid) AS n_pages FROM article_contents")
def a1_scan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_contents").agg(F.count("*").alias("n"), F.count_distinct("pageid").alias("n_pages"))

"""Queries on text sources, shuffled controls, payload checks, samples: A18, F26, F39, F40, K14, K15, M20, M23, E35, C17, C20, F35, F38, F41."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave import vocab
from landweave.functions import columns as C
from landweave.functions import payloads
from landweave.operators import controls
from landweave.operators.classify import keyword_label
from landweave.operators.reports import beats, interval_text, model_key, rounded_cell
from landweave.plans import inputs
from landweave.plans.evaluation import LABELS
from landweave.plans.inputs import with_sql
from landweave.plans.texts import _SQUEEZE, _WS
from landweave.sources import texts
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


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"contents": inputs.contents(spark, folder), "evidence": inputs.evidence(spark, folder)}


@query(with_sql("contents", "evidence") + """SELECT 'content' AS text_source, pageid, md5(coalesce(content, '')) AS digest FROM contents
  UNION ALL SELECT 'landuse_evidence_summary_shuffled', pageid, md5(landuse_evidence_summary) FROM evidence""")
def a18_text_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Texts by source name; a shuffled source has the texts of its base."""
    parts = [texts.text_source(s, _tables(spark, folder)).select(F.lit(s).alias("text_source"), "pageid", F.md5("text").alias("digest")) for s in ("content", "landuse_evidence_summary_shuffled")]
    return parts[0].unionByName(parts[1])


_LABELED = with_sql("contents").rstrip() + ", base AS (SELECT pageid, max(" + inputs.CLASS_SQL + ") AS target FROM image_probe_splits WHERE pageid IS NOT NULL GROUP BY pageid HAVING target IS NOT NULL)"


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    from landweave.sources.tables import table

    rows = table(spark, folder, "image_probe_splits").where("pageid IS NOT NULL")
    return rows.groupBy("pageid").agg(F.max(C.usable_class(F.col("label"))).alias("target")).where("target IS NOT NULL")


_CYCLE = """, e AS (SELECT c.pageid, b.target, coalesce(c.content, '') AS text FROM contents c JOIN base b USING (pageid)),
  o AS (SELECT *, row_number() OVER (ORDER BY left(md5('42:' || pageid), 15), pageid) AS i, count(*) OVER () AS n FROM e),
  s AS (SELECT a.pageid, a.target, b.text, b.pageid AS shuffled_from FROM o a JOIN o b ON b.i = a.i % a.n + 1)"""


@query(_LABELED + _CYCLE + " SELECT pageid, target, shuffled_from, md5(text) AS digest FROM s")
def k14_shuffled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every eligible page with another page's content."""
    rows = texts.classified_texts("content_shuffled", texts.text_source("content_shuffled", _tables(spark, folder)), _targets(spark, folder))
    return rows.select("pageid", "target", "shuffled_from", F.md5("text").alias("digest"))


@query(_LABELED + _CYCLE + """ SELECT pageid, target, CASE WHEN contains(lower(text), 'forêt') THEN '31' ELSE '21' END AS prediction,
  'base_text_source=content,fingerprint=f,shuffled_from_pageid=' || shuffled_from || ',text_control=shuffled,text_sha256=' || sha256(text) AS metadata FROM s""")
def f26_prediction_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the stub on shuffled contents, with the metadata that say so."""
    rows = texts.classified_texts("content_shuffled", texts.text_source("content_shuffled", _tables(spark, folder)), _targets(spark, folder))
    rows = rows.withColumn("prediction", keyword_label(F.col("text"), "forêt", "31", "21"))
    made = texts.prediction_records(rows, "content_shuffled", "f")
    written = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return made.select("pageid", "target", "prediction", written.alias("metadata"))


@query(_LABELED + " SELECT c.pageid, b.target FROM contents c JOIN base b USING (pageid) ORDER BY CAST(pageid AS BIGINT) LIMIT 50")
def c17_first_eligible(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty eligible pages in source order; the limit is the feature."""
    rows = texts.text_source("content", _tables(spark, folder)).withColumn("order", F.col("pageid").cast("long"))
    return texts.classified_texts("content", rows, _targets(spark, folder), limit=50, order="order").select("pageid", "target")


# ---- payloads ----

_SIGNS = r"""[-_"''‘’`~^*+<>.,;:!?/\\(){}\[\]]"""
_LEAK = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '{_SIGNS}', ' ', 'g'), '{_WS}+', ' ', 'g'), ' ')"
_NAMES = lambda text, name: f"({name} <> '' AND (regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape({name}) || '($|[^\\p{{L}}\\p{{N}}_])') OR regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(replace({name}, ' ', '')) || '($|[^\\p{{L}}\\p{{N}}_])') OR (length(replace({name}, ' ', '')) >= 8 AND contains(replace({text}, ' ', ''), replace({name}, ' ', '')))))"


@query(with_sql("contents").rstrip() + f""", l AS (SELECT pageid, {_LEAK('content')} AS text, {_LEAK('title')} AS name FROM contents WHERE content IS NOT NULL AND title IS NOT NULL)
  SELECT pageid, {_NAMES('text', 'name')} AS leaks FROM l""")
def f40_title_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Does a content name its own title?"""
    rows = inputs.contents(spark, folder).where("content IS NOT NULL AND title IS NOT NULL")
    return rows.select("pageid", payloads.title_leaks(F.col("content"), F.col("title")).alias("leaks"))


_FIELDS = {"evidence_sentences_no_place": "s", "evidence_types": "t", "landcover_relevance": "r", "landuse_evidence_summary": "m", "uncertainty": "u"}
_ALLOWED = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"


_JUDGED = with_sql("evidence").rstrip() + f""", p AS (SELECT pageid, title, landuse_evidence_summary AS m, landcover_relevance AS r, evidence_types AS t, evidence_sentences_no_place AS s, uncertainty AS u, {_SQUEEZE("landuse_evidence_summary")} AS q, {_LEAK("coalesce(title, '')")} AS name,
    array_to_string(list_filter([{", ".join(f"CASE WHEN {c} IS NULL THEN '{n}' END" for n, c in _FIELDS.items())}], lambda x: x IS NOT NULL), ''', ''') AS lost FROM (SELECT pageid, title, landuse_evidence_summary, landcover_relevance, evidence_types, evidence_sentences_no_place, uncertainty FROM evidence)),
  j AS (SELECT pageid, q, s, CASE WHEN lost <> '' THEN 'missing fields: [''' || lost || ''']' WHEN q = '' THEN 'no summary'
    WHEN r NOT IN {_ALLOWED(vocab.RELEVANCE_LEVELS)} THEN 'invalid landcover_relevance' WHEN u NOT IN {_ALLOWED(vocab.UNCERTAINTY_LEVELS)} THEN 'invalid uncertainty'
    WHEN len(list_filter(t, lambda x: x IS NULL OR x NOT IN {_ALLOWED(vocab.EVIDENCE_TYPES)})) > 0 THEN 'invalid evidence_types' WHEN len(list_filter(s, lambda x: x IS NULL)) > 0 THEN 'evidence_sentences_no_place holds no text'
    WHEN r = 'none' AND len(t) > 0 THEN 'evidence_types without relevance' WHEN r = 'none' AND len(s) > 0 THEN 'evidence_sentences_no_place without relevance' WHEN r = 'none' AND length(q) > 240 THEN 'long summary without relevance'
    WHEN {_NAMES(_LEAK("q"), "name")} OR len(list_filter(s, lambda x: {_NAMES(_LEAK("x"), "name")})) > 0 THEN 'place name' END AS error FROM p)"""


@query(_JUDGED + " SELECT pageid, error FROM j")
def f40_evidence_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the stored evidence as a model's response, if anything."""
    rows = inputs.evidence(spark, folder)
    raw = F.to_json(F.struct(*payloads.EVIDENCE_FIELDS))
    return rows.select("pageid", payloads.evidence_payload(raw, F.col("title"))["error"].alias("error"))


@query(_JUDGED + """ SELECT j.pageid, CASE WHEN j.error IS NULL AND coalesce(length(q) = e.landuse_evidence_summary_char_count AND len(s) = e.evidence_sentences_count, false) THEN 'keep' ELSE 'compute' END AS action
  FROM j JOIN evidence e USING (pageid)""")
def c19_current_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Which stored evidence a run may keep, and which pages it does again."""
    rows = inputs.evidence(spark, folder)
    kept, wanted = resume.resumed(rows, rows.select("pageid"), resume.evidence_is_current(F.col("title")))
    return kept.select("pageid", F.lit("keep").alias("action")).unionByName(wanted.select("pageid", F.lit("compute").alias("action")))


@query(with_sql("evidence") + """SELECT pageid, CASE WHEN landuse_evidence_summary IS NULL OR trim(landuse_evidence_summary, ' ') = '' THEN 'no summary' END AS error,
  CASE WHEN trim(landuse_evidence_summary, ' ') <> '' THEN md5(trim(landuse_evidence_summary, ' ')) END AS digest FROM evidence""")
def f39_summary_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries as a model's response, with their private fields dropped."""
    written = F.to_json(F.struct(F.col("landuse_evidence_summary").alias("summary"), F.lit("so").alias("thinking")))
    rows = inputs.evidence(spark, folder).select("pageid", payloads.without_private_fields(written).alias("raw"))
    rows = rows.select("pageid", payloads.summary_payload(F.col("raw")).alias("p"))
    return rows.select("pageid", F.col("p.error").alias("error"), F.md5("p.summary").alias("digest"))


@query(with_sql("evidence").rstrip() + """, t AS (SELECT pageid, landuse_evidence_summary AS m, trim(title) AS title FROM evidence WHERE title IS NOT NULL AND landuse_evidence_summary IS NOT NULL)
  SELECT pageid, md5(CASE WHEN CAST(pageid AS BIGINT) % 2 = 1 THEN m ELSE """ + _SQUEEZE("""regexp_replace(regexp_replace(m, '(?i)' || regexp_escape(title), 'ce lieu', 'g'), '(?i)' || array_to_string(list_transform(list_filter(string_split_regex(title, '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '[^\\p{L}\\p{N}]+'), 'ce lieu', 'g')""") + " END) AS digest FROM t")
def m20_repaired_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries without their titles where they were to name no place (even page ids stand for these)."""
    rows = inputs.evidence(spark, folder).where("title IS NOT NULL AND landuse_evidence_summary IS NOT NULL")
    mode = F.when(F.col("pageid").cast("long") % 2 == 1, "place").otherwise("no_place")
    return rows.select("pageid", F.md5(payloads.repaired_summary(F.col("landuse_evidence_summary"), F.col("title"), mode)).alias("digest"))


@query(with_sql("contents") + """SELECT pageid, CASE WHEN trim(coalesce(title, ''), ' ') <> '' THEN length(title) + 33 ELSE 0 END + length(coalesce(content, '')) AS n FROM contents""")
def m23_evidence_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Length of the prompts without their fixed end."""
    fixed = spark.range(1).select(F.length(payloads.evidence_prompt(F.lit(""), F.lit(""))).alias("n")).first().n
    return inputs.contents(spark, folder).select("pageid", (F.length(payloads.evidence_prompt(F.col("title"), F.col("content"))) - fixed).cast("long").alias("n"))


# ---- samples ----

_PAGES = with_sql("evidence", "spatial", "quality", "pages")
_OBSERVED = "label IS NOT NULL AND point_label_share_250m >= 0.8"


@query(_PAGES.rstrip() + f""", u AS (SELECT pageid, label, left(md5('7:' || pageid), 15) AS d FROM pages WHERE label IS NOT NULL), w AS (SELECT label, count(*) AS n FROM pages WHERE {_OBSERVED} GROUP BY label),
  a AS (SELECT pageid, row_number() OVER (ORDER BY d, pageid) AS i FROM u), b AS (SELECT pageid, label, row_number() OVER (PARTITION BY label ORDER BY d, pageid) AS i FROM u)
  SELECT 'same_n' AS control, pageid FROM a WHERE i <= (SELECT sum(n) FROM w) UNION ALL SELECT 'same_targets', pageid FROM b JOIN w USING (label) WHERE i <= n""")
def k15_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A random sample of as many pages as are spatially sure, and one with their labels."""
    universe = inputs.pages(spark, folder).where("label IS NOT NULL").select("pageid", "label", "point_label_share_250m")
    observed = universe.where(_OBSERVED)
    a = controls.same_size_sample(universe, "pageid", observed.count(), 7)
    b = controls.same_targets_sample(universe, observed, "pageid", "label", 7)
    return a.select(F.lit("same_n").alias("control"), "pageid").unionByName(b.select(F.lit("same_targets").alias("control"), "pageid"))


@query(with_sql("spatial", "label_sets").rstrip() + """, m AS (SELECT pageid, CASE WHEN point_label_share_250m >= 0.8 THEN 'sure' ELSE 'unsure' END AS subset FROM spatial),
  j AS (SELECT subset, target AS t, CASE WHEN parse_status = 'ok' THEN prediction ELSE [] END AS p FROM label_sets JOIN m USING (pageid))
  SELECT subset, count(*) AS n, round(avg(CASE WHEN len(list_distinct(list_concat(t, p))) = 0 THEN 1 ELSE len(list_intersect(t, p)) / len(list_distinct(list_concat(t, p))) END), 6) AS score FROM j GROUP BY subset""")
def e35_mean_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Mean Jaccard of label sets by spatial certainty."""
    members = inputs.spatial(spark, folder).select("pageid", F.when(F.col("point_label_share_250m") >= 0.8, "sure").otherwise("unsure").alias("subset"))
    scores = controls.selection_scores(inputs.label_sets(spark, folder), members, ["subset"], None)
    return scores.select("subset", "n", F.round("score", 6).alias("score"))


@query(_PAGES.rstrip() + ", " + inputs.SQL["records"] + f""", o AS (SELECT pageid FROM pages WHERE {_OBSERVED}), r AS (SELECT model, target, prediction, parse_status = 'ok' AND prediction IS NOT NULL AS ok FROM records JOIN o USING (pageid)),
  l AS (SELECT unnest(['{"','".join(LABELS)}']) AS label), g AS (SELECT model, count(*) AS n FROM r GROUP BY model)
  SELECT model, any_value(g.n) AS n, round(sum(coalesce((SELECT count(*) FILTER (WHERE prediction = target) / nullif(count(*), 0) FROM r WHERE r.model = g.model AND ok AND target = l.label), 0)) / 9, 6) AS score FROM g CROSS JOIN l GROUP BY model""")
def e35_balanced_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced accuracy of the predictions for the spatially sure pages."""
    members = inputs.pages(spark, folder).where(_OBSERVED).select("pageid")
    scores = controls.selection_scores(inputs.records(spark, folder), members, ["model"], LABELS)
    return scores.select("model", "n", F.round("score", 6).alias("score"))


# ---- small columns ----


@query("SELECT w.m AS window_m, CAST(ceil(w.m / 10.0) AS BIGINT) AS pixels FROM (VALUES (250), (255), (1000), (2240), (5)) w(m)")
def f35_source_pixels(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m in (250, 255, 1000, 2240, 5)], "window_m int")
    return rows.select("window_m", C.source_pixels(F.col("window_m")).alias("pixels"))


@query("SELECT DISTINCT source, CASE WHEN contains(lower(source), 'qwen') THEN 'qwen' WHEN contains(lower(source), 'gemma') THEN 'gemma' ELSE coalesce(nullif(trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown_model') END AS model_key FROM documents WHERE source IS NOT NULL")
def f38_model_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of models, with sources of documents for their names."""
    from landweave.sources.tables import table

    return table(spark, folder, "documents").where("source IS NOT NULL").select("source", model_key(F.col("source")).alias("model_key")).distinct()


@query(with_sql("spatial") + """SELECT pageid, CASE WHEN point_label_share_250m IS NULL OR point_label_share_500m IS NULL THEN 'n/a' WHEN point_label_share_250m > point_label_share_500m THEN 'yes' ELSE 'no' END AS beats,
  CASE WHEN point_label_share_250m IS NULL OR point_label_share_500m IS NULL THEN '' ELSE '[' || printf('%.4f', point_label_share_250m) || ', ' || printf('%.4f', point_label_share_500m) || ']' END AS interval, coalesce(printf('%.4f', point_label_share_250m), '') AS cell FROM spatial""")
def f41_report_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of reports, with the two shares for a value and its baseline, and for the ends of an interval."""
    a, b = F.col("point_label_share_250m"), F.col("point_label_share_500m")
    return inputs.spatial(spark, folder).select("pageid", beats(a, b).alias("beats"), interval_text(a, b).alias("interval"), rounded_cell(a).alias("cell"))

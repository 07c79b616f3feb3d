"""Queries on predictions: D9 to D22, E1 to E13, E20 to E30, C4 to C13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave import vocab
from landweave.functions.columns import boolish, present, safe_div, surely
from landweave.operators import metrics, reports, subsets
from landweave.plans import inputs
from landweave.plans.inputs import with_sql
from landweave.sources.tables import table

LABELS = list(vocab.LEVEL2_LABELS)
GROUP = ["model", "text_source"]
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _confusion(spark: SparkSession, folder: str, groups: list[str] = GROUP) -> DataFrame:
    return metrics.confusion_counts(inputs.records(spark, folder), groups, "row_idx")


_LABELS_SQL = "(SELECT unnest(['" + "','".join(LABELS) + "']) AS label)"
_RECORDS = with_sql("records")


def _per_label_sql(groups: str, source: str = "records") -> str:
    on = " AND ".join(f"r.{g.strip()} IS NOT DISTINCT FROM g.{g.strip()}" for g in groups.split(","))
    return f"""spine AS (SELECT g.*, l.label FROM (SELECT DISTINCT {groups} FROM {source} WHERE target IS NOT NULL) g CROSS JOIN {_LABELS_SQL} l),
  per AS (SELECT {", ".join("g." + x.strip() for x in groups.split(","))}, g.label, count(*) FILTER (WHERE r.target = g.label) AS support,
    count(*) FILTER (WHERE r.parse_status = 'ok' AND r.prediction = g.label) AS predicted,
    count(*) FILTER (WHERE r.parse_status = 'ok' AND r.target = g.label AND r.prediction = g.label) AS tp,
    count(*) FILTER (WHERE r.parse_status = 'ok' AND r.target <> g.label AND r.prediction = g.label) AS fp,
    count(*) FILTER (WHERE r.parse_status = 'ok' AND r.target = g.label AND r.prediction <> g.label) AS fn
    FROM spine g JOIN {source} r ON {on} AND r.target IS NOT NULL GROUP BY ALL),
  scores AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS sr,
    CASE WHEN tp + fp + support > 0 THEN 2 * tp / (tp + fp + support) ELSE 0.0 END AS sf FROM per)"""


@query(_RECORDS.rstrip() + ", " + _per_label_sql("model, text_source") + " SELECT model, text_source, label, support, predicted, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(sr, 6) AS strict_recall, round(sf, 6) AS strict_f1 FROM scores")
def e2_per_label(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.per_label(_confusion(spark, folder), GROUP, LABELS))


def _single_sql(groups: str, source: str = "records") -> str:
    g = [x.strip() for x in groups.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in g)
    return f"""{_per_label_sql(groups, source)},
  totals AS (SELECT {groups}, count(*) AS n, count(*) FILTER (WHERE parse_status = 'ok') AS ok, count(*) FILTER (WHERE parse_status = 'ok' AND target = prediction) AS right_ FROM {source} WHERE target IS NOT NULL GROUP BY ALL),
  macro AS (SELECT {groups}, sum(p) / 9 AS p, sum(r) / 9 AS r, sum(f) / 9 AS f, sum(sr) / 9 AS sr, sum(sf) / 9 AS sf, coalesce(sum(p * support) / nullif(sum(support), 0), 0) AS wp, coalesce(sum(r * support) / nullif(sum(support), 0), 0) AS wr, coalesce(sum(f * support) / nullif(sum(support), 0), 0) AS wf FROM scores GROUP BY ALL),
  tops AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY c DESC, first ASC, target ASC) AS rk FROM (SELECT {groups}, target, count(*) AS c, min(row_idx) AS first FROM {source} WHERE target IS NOT NULL GROUP BY ALL)),
  single AS (SELECT {", ".join("t." + x for x in g)}, t.n, t.ok AS n_predicted_ok, t.n - t.ok AS n_parse_error, round(t.ok / t.n, 6) AS coverage,
    round(coalesce(t.right_ / nullif(t.ok, 0), 0), 6) AS accuracy, round(t.right_ / t.n, 6) AS accuracy_errors_wrong, round(m.p, 6) AS macro_precision, round(m.r, 6) AS balanced_accuracy,
    round(m.sr, 6) AS balanced_accuracy_errors_wrong, round(m.f, 6) AS macro_f1, round(m.sf, 6) AS macro_f1_errors_wrong, round(m.wp, 6) AS weighted_precision, round(m.wr, 6) AS weighted_recall,
    round(m.wf, 6) AS weighted_f1, o.target AS majority_label, round(o.c / t.n, 6) AS majority_accuracy, round(CASE WHEN o.target IN {tuple(LABELS)} THEN 1 / 9 ELSE 0 END, 6) AS majority_balanced_accuracy,
    round(CASE WHEN o.target IN {tuple(LABELS)} THEN 2 * o.c / (o.c + t.n) / 9 ELSE 0 END, 6) AS majority_macro_f1
    FROM totals t JOIN macro m ON {same("t", "m")} JOIN tops o ON {same("t", "o")} AND o.rk = 1)"""


@query(_RECORDS.rstrip() + ", " + _single_sql("model, text_source") + " SELECT * FROM single")
def e2_single_label(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.single_label(_confusion(spark, folder), GROUP, LABELS))


@query(_RECORDS.rstrip() + ", " + _per_label_sql("model, text_source", "(SELECT * FROM records WHERE parse_status = 'ok') ") + """,
  f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f2 FROM scores),
  a AS (SELECT model, text_source, avg(r) AS ra, coalesce(avg(r) FILTER (WHERE support > 0), 0) AS rs, avg(p) AS pa, coalesce(avg(p) FILTER (WHERE support > 0), 0) AS ps, avg(f2) AS fa, coalesce(avg(f2) FILTER (WHERE support > 0), 0) AS fs, coalesce(sum(f2 * support) / nullif(sum(support), 0), 0) AS w FROM f GROUP BY ALL),
  c AS (SELECT model, text_source, count(*) FILTER (WHERE target = prediction) / count(*) AS accuracy FROM records WHERE parse_status = 'ok' AND target IS NOT NULL GROUP BY ALL)
  SELECT model, text_source, round(accuracy, 6) AS accuracy, round(ra, 6) AS balanced_accuracy_allowed, round(rs, 6) AS balanced_accuracy_supported, round(pa, 6) AS macro_precision_allowed, round(ps, 6) AS macro_precision_supported,
    round(fa, 6) AS macro_f1_allowed, round(fs, 6) AS macro_f1_supported, round(w, 6) AS weighted_f1_supported FROM a JOIN c USING (model, text_source)""")
def e11_supported(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.supported(_confusion(spark, folder), GROUP, LABELS))


@query(_RECORDS + "SELECT l.label AS target, " + ", ".join(f"count(*) FILTER (WHERE parse_status = 'ok' AND target = l.label AND prediction = '{x}') AS pred_{x}" for x in LABELS) + f" FROM {_LABELS_SQL} l CROSS JOIN records GROUP BY l.label")
def e13_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(_confusion(spark, folder, []), [], LABELS)


@query(_RECORDS + "SELECT label FROM (SELECT target AS label FROM records UNION SELECT prediction FROM records WHERE parse_status = 'ok') WHERE label IS NOT NULL")
def e9_label_universe(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.records(spark, folder)
    both = rows.select(F.col("target").alias("label")).unionByName(rows.where("parse_status = 'ok'").select(F.col("prediction").alias("label")))
    return both.where(F.col("label").isNotNull()).distinct()


_MULTI_LABELS = ["11", "12", "21", "22", "23", "24", "31", "32", "33", "41", "51"]
_SETS = with_sql("spatial", "label_sets")


@query(_SETS.rstrip() + f""", r AS (SELECT target AS t, CASE WHEN parse_status = 'ok' THEN prediction ELSE [] END AS p, parse_status = 'ok' AS ok, row_idx FROM label_sets),
  s AS (SELECT *, len(list_intersect(t, p)) AS b, len(p) - len(list_intersect(t, p)) AS x, len(t) - len(list_intersect(t, p)) AS l FROM r),
  a AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS k, count(*) FILTER (WHERE ok AND x = 0 AND l = 0) AS e1, count(*) FILTER (WHERE x = 0 AND l = 0) AS e2,
    sum(b) FILTER (WHERE ok) AS tp, sum(x) FILTER (WHERE ok) AS fp, sum(l) FILTER (WHERE ok) AS fn, sum(b) AS tpa, sum(x) AS fpa, sum(l) AS fna,
    avg(CASE WHEN b + x + l = 0 THEN 1.0 ELSE b / (b + x + l) END) AS jac, sum(x + l) AS wrong, count(*) FILTER (WHERE len(t) = 0) AS empty FROM s),
  c AS (SELECT l.label, count(*) FILTER (WHERE ok AND list_contains(t, l.label) AND list_contains(p, l.label)) AS tp, count(*) FILTER (WHERE ok AND NOT list_contains(t, l.label) AND list_contains(p, l.label)) AS fp,
    count(*) FILTER (WHERE ok AND list_contains(t, l.label) AND NOT list_contains(p, l.label)) AS fn, count(*) FILTER (WHERE list_contains(t, l.label) AND list_contains(p, l.label)) AS tpa,
    count(*) FILTER (WHERE NOT list_contains(t, l.label) AND list_contains(p, l.label)) AS fpa, count(*) FILTER (WHERE list_contains(t, l.label) AND NOT list_contains(p, l.label)) AS fna
    FROM (SELECT unnest(['{"','".join(_MULTI_LABELS)}']) AS label) l CROSS JOIN s GROUP BY l.label),
  m AS (SELECT sum(coalesce(tp / nullif(tp + fp, 0), 0)) / 11 AS mp, sum(coalesce(tp / nullif(tp + fn, 0), 0)) / 11 AS mr, sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 11 AS mf, sum(coalesce(2 * tpa / nullif(2 * tpa + fpa + fna, 0), 0)) / 11 AS mfa FROM c),
  g AS (SELECT '["' || array_to_string(t, '", "') || '"]' AS key, count(*) AS kn, min(row_idx) AS first FROM r GROUP BY 1 ORDER BY kn DESC, first LIMIT 1)
  SELECT n, k AS n_predicted_ok, n - k AS n_parse_error, round(k / n, 6) AS coverage, round(e1 / k, 6) AS exact_match, round(e2 / n, 6) AS exact_match_errors_empty, round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1, round(2 * tpa / (2 * tpa + fpa + fna), 6) AS micro_f1_errors_empty, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(mfa, 6) AS macro_f1_errors_empty,
    round(jac, 6) AS jaccard, round(wrong / (n * 11), 6) AS hamming_loss, key AS majority_set, round(kn / n, 6) AS majority_exact_match, round(empty / n, 6) AS empty_exact_match FROM a, m, g""")
def e3_multi_label(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.multi_label(inputs.label_sets(spark, folder), [], _MULTI_LABELS, order="row_idx"))


@query(with_sql("spatial", "label_sets") + """SELECT pageid, round(CASE WHEN len(list_distinct(list_concat(target, prediction))) = 0 THEN 1 ELSE len(list_intersect(target, prediction)) / len(list_distinct(list_concat(target, prediction))) END, 6) AS jaccard,
  len(list_distinct(list_concat(target, prediction))) - len(list_intersect(target, prediction)) AS hamming FROM label_sets""")
def e7_jaccard_hamming(spark: SparkSession, folder: str) -> DataFrame:
    from landweave.functions.columns import jaccard, symmetric_difference_size

    rows = inputs.label_sets(spark, folder)
    return rows.select("pageid", F.round(jaccard(F.col("target"), F.col("prediction")), 6).alias("jaccard"), symmetric_difference_size(F.col("target"), F.col("prediction")).cast("long").alias("hamming"))


@query(_RECORDS + """, c AS (SELECT model, text_source, target, count(*) AS c, min(row_idx) AS f FROM records WHERE target IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY model, text_source ORDER BY c DESC, f, target) AS rk, sum(c) OVER (PARTITION BY model, text_source) AS n FROM c)
  SELECT model, text_source, target AS majority_label, c AS majority_n, round(c / n, 6) AS majority_share FROM r WHERE rk = 1""".replace(_RECORDS, ""))
def e6_majority_baseline(spark: SparkSession, folder: str) -> DataFrame:
    confusion = _confusion(spark, folder)
    totals = confusion.groupBy(*GROUP).agg(F.sum("n").alias("n"))
    rows = metrics.majority_label(confusion, GROUP).join(totals, GROUP)
    return rows.select(*GROUP, "majority_label", "majority_n", F.round(F.col("majority_n") / F.col("n"), 6).alias("majority_share"))


ORACLE["e6_majority_baseline"] = _RECORDS.rstrip() + """, c AS (SELECT model, text_source, target, count(*) AS c, min(row_idx) AS f FROM records WHERE target IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY model, text_source ORDER BY c DESC, f, target) AS rk, sum(c) OVER (PARTITION BY model, text_source) AS n FROM c)
  SELECT model, text_source, target AS majority_label, c AS majority_n, round(c / n, 6) AS majority_share FROM r WHERE rk = 1"""


@query(_RECORDS.rstrip() + """, w AS (SELECT text_source, pageid, target AS t, arg_min(prediction, (row_idx, prediction)) FILTER (WHERE model = 'model_g') AS a, arg_min(prediction, (row_idx, prediction)) FILTER (WHERE model = 'model_q') AS b
    FROM records WHERE parse_status = 'ok' AND prediction IS NOT NULL AND target IS NOT NULL GROUP BY ALL)
  SELECT text_source, count(*) AS n, count(*) FILTER (WHERE a = b) AS n_agree, round(count(*) FILTER (WHERE a = b) / count(*), 6) AS agreement_rate,
    round(coalesce(count(*) FILTER (WHERE a = b AND a = t) / nullif(count(*) FILTER (WHERE a = b), 0), 0), 6) AS agreed_precision FROM w GROUP BY text_source""")
def e29_model_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.model_agreement(inputs.records(spark, folder), ["text_source"], ("model_g", "model_q")))


@query(_RECORDS.rstrip() + f""", t AS (SELECT model, count(*) AS total FROM records GROUP BY model), m AS (SELECT model, l.label, total FROM t CROSS JOIN {_LABELS_SQL} l)
  SELECT m.model, m.label, count(r.target) AS support, round(count(r.target) / any_value(m.total), 6) AS share FROM m LEFT JOIN records r ON r.model = m.model AND r.target = m.label GROUP BY m.model, m.label""")
def e20_class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.class_distribution(inputs.records(spark, folder), ["model"], "target", LABELS))


# ---- joins -------------------------------------------------------------------------------------


@query(with_sql("contents", "quality") + "SELECT c.pageid FROM contents c WHERE length(trim(content)) > 0 AND EXISTS (SELECT 1 FROM quality q WHERE q.pageid = c.pageid AND q.corine_label IS NOT NULL)")
def d9_eligible_semi(spark: SparkSession, folder: str) -> DataFrame:
    texts = inputs.contents(spark, folder).where(F.length(F.trim("content")) > 0)
    targets = inputs.quality(spark, folder).where(F.col("corine_label").isNotNull())
    return texts.join(targets.select("pageid"), "pageid", "left_semi").select("pageid")


@query(with_sql("evidence", "spatial") + "SELECT CASE WHEN s.pageid IS NULL THEN 'left_only' ELSE 'both' END AS found, count(*) AS n FROM evidence e LEFT JOIN spatial s USING (pageid) GROUP BY 1")
def d12_left_join_indicator(spark: SparkSession, folder: str) -> DataFrame:
    right = inputs.spatial(spark, folder).select("pageid", F.lit(True).alias("_there"))
    rows = inputs.evidence(spark, folder).select("pageid").join(right, "pageid", "left")
    return rows.groupBy(F.when(F.col("_there"), "both").otherwise("left_only").alias("found")).agg(F.count("*").alias("n"))


@query(with_sql("records", "evidence") + """SELECT r.pageid, r.model, r.text_source, e.landcover_relevance, e.landcover_relevance IS NOT NULL AS evidence_present, coalesce(e.evidence_sentences_count, 0) AS evidence_sentences_count,
  coalesce(array_to_string(e.evidence_types, ','), '') AS evidence_types FROM records r LEFT JOIN evidence e USING (pageid)""")
def d11_metadata_join(spark: SparkSession, folder: str) -> DataFrame:
    e = inputs.evidence(spark, folder).select("pageid", "landcover_relevance", "evidence_sentences_count", "evidence_types")
    return inputs.records(spark, folder).join(e, "pageid", "left").select(
        "pageid", "model", "text_source", "landcover_relevance", F.col("landcover_relevance").isNotNull().alias("evidence_present"),
        F.coalesce("evidence_sentences_count", F.lit(0)).alias("evidence_sentences_count"), F.coalesce(F.array_join("evidence_types", ","), F.lit("")).alias("evidence_types"),
    )


@query(with_sql("contents", "evidence", "spatial", "quality") + """SELECT c.pageid, coalesce(nullif(trim(q.title), ''), nullif(trim(c.title), '')) AS title, e.pageid IS NOT NULL AS has_evidence, s.pageid IS NOT NULL AS has_spatial, q.pageid IS NOT NULL AS has_quality,
  round(coalesce(s.point_label_share_250m, 0), 6) AS point_label_share_250m FROM contents c LEFT JOIN evidence e USING (pageid) LEFT JOIN spatial s USING (pageid) LEFT JOIN quality q USING (pageid)""")
def d13_four_way_join(spark: SparkSession, folder: str) -> DataFrame:
    c = inputs.contents(spark, folder, ["title"]).select("pageid", F.col("title").alias("c_title"))
    e = inputs.evidence(spark, folder).select("pageid", F.lit(True).alias("e"))
    s = inputs.spatial(spark, folder).select("pageid", F.lit(True).alias("s"), "point_label_share_250m")
    q = inputs.quality(spark, folder).select("pageid", F.lit(True).alias("q"), F.col("title").alias("q_title"))
    rows = c.join(e, "pageid", "left").join(s, "pageid", "left").join(q, "pageid", "left")
    return rows.select("pageid", F.coalesce(present(F.col("q_title")), present(F.col("c_title"))).alias("title"), *[F.col(x).isNotNull().alias(n) for x, n in (("e", "has_evidence"), ("s", "has_spatial"), ("q", "has_quality"))], F.round(F.coalesce("point_label_share_250m", F.lit(0.0)), 6).alias("point_label_share_250m"))


@query("SELECT DISTINCT pageid FROM image_probe_splits WHERE split = 'train' AND pageid NOT IN (SELECT pageid FROM image_probe_splits WHERE split = 'eval_strict' AND pageid IS NOT NULL)")
def d19_train_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "image_probe_splits").select("pageid", "split")
    return rows.where("split = 'train'").join(rows.where("split = 'eval_strict'").select("pageid"), "pageid", "left_anti").select("pageid").distinct()


@query("""SELECT vec_id, len(embedding) AS dim, label FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label >= 0)""")
def d18_embedding_complete(spark: SparkSession, folder: str) -> DataFrame:
    from landweave.operators.probe import stack_embeddings

    vectors = table(spark, folder, "embeddings")
    rows = vectors.where("label >= 0").select("vec_id", "label")
    return stack_embeddings(rows, vectors.select("vec_id", "embedding"), "vec_id").select("vec_id", F.size("embedding").cast("long").alias("dim"), "label")


@query(with_sql("quality", "spatial") + "SELECT q.pageid, q.corine_label AS target, s.point_label AS derived FROM quality q JOIN spatial s USING (pageid) WHERE q.corine_label IS DISTINCT FROM s.point_label")
def d24_target_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    q = inputs.quality(spark, folder).select("pageid", F.col("corine_label").alias("target"))
    s = inputs.spatial(spark, folder).select("pageid", F.col("point_label").alias("derived"))
    return q.join(s, "pageid").where(~F.col("target").eqNullSafe(F.col("derived"))).select("pageid", "target", "derived")


_DELTAS = ["accuracy", "balanced_accuracy", "macro_f1"]


@query(_RECORDS.rstrip() + ", " + _single_sql("model, text_source") + """, pairs AS (SELECT * FROM (VALUES ('content','content_shuffled'), ('summary','summary_shuffled'), ('evidence_card','evidence_card_shuffled')) v(base, other))
  SELECT a.model, base, other, round(a.accuracy - b.accuracy, 5) AS delta_accuracy, round(a.balanced_accuracy - b.balanced_accuracy, 5) AS delta_balanced_accuracy, round(a.macro_f1 - b.macro_f1, 5) AS delta_macro_f1
  FROM single a JOIN pairs ON a.text_source = base JOIN single b ON b.text_source = other AND a.model = b.model""")
def d20_shuffled_delta(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rounded(metrics.single_label(_confusion(spark, folder), GROUP, LABELS))
    pairs = spark.createDataFrame(list(vocab.SHUFFLED_OF.items()), "base string, other string")
    return _rounded(metrics.paired_deltas(rows, ["model"], "text_source", pairs, _DELTAS), 5)


@query(_RECORDS.rstrip() + ", " + _single_sql("model, text_source") + """, pairs AS (SELECT * FROM (VALUES ('summary','content'), ('evidence_card','content'), ('landuse_evidence_summary','summary')) v(base, other))
  SELECT a.model, base, other, round(a.accuracy - b.accuracy, 5) AS delta_accuracy, round(a.balanced_accuracy - b.balanced_accuracy, 5) AS delta_balanced_accuracy, round(a.macro_f1 - b.macro_f1, 5) AS delta_macro_f1
  FROM single a JOIN pairs ON a.text_source = base JOIN single b ON b.text_source = other AND a.model = b.model""")
def d21_pairwise_delta(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rounded(metrics.single_label(_confusion(spark, folder), GROUP, LABELS))
    pairs = spark.createDataFrame([("summary", "content"), ("evidence_card", "content"), ("landuse_evidence_summary", "summary")], "base string, other string")
    return _rounded(metrics.paired_deltas(rows, ["model"], "text_source", pairs, _DELTAS), 5)


_COMPARE = _RECORDS.rstrip() + ", " + _single_sql("model, text_source") + """, cmp AS (SELECT a.text_source, a.model AS model_a, b.model AS model_b, round(a.accuracy - b.accuracy, 5) AS delta_accuracy, round(a.balanced_accuracy - b.balanced_accuracy, 5) AS delta_balanced_accuracy,
  round(a.macro_f1 - b.macro_f1, 5) AS delta_macro_f1 FROM single a JOIN single b USING (text_source) WHERE a.model = 'model_g' AND b.model = 'model_q') """


@query(_COMPARE + "SELECT * FROM cmp")
def d22_model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rounded(metrics.single_label(_confusion(spark, folder), GROUP, LABELS))
    return _rounded(metrics.first_two_models(rows, ["text_source"], _DELTAS), 5)


@query(_COMPARE + "SELECT * FROM cmp ORDER BY abs(delta_balanced_accuracy) DESC, text_source LIMIT 1")
def h4_top_delta(spark: SparkSession, folder: str) -> DataFrame:
    return d22_model_comparison(spark, folder).orderBy(F.desc(F.abs("delta_balanced_accuracy")), "text_source").limit(1)


@query(_RECORDS.rstrip() + ", " + _single_sql("model, text_source") + " SELECT model, text_source, balanced_accuracy, macro_f1 FROM single ORDER BY balanced_accuracy DESC, macro_f1 DESC, model, text_source LIMIT 10")
def h3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rounded(metrics.single_label(_confusion(spark, folder), GROUP, LABELS))
    return rows.orderBy(F.desc("balanced_accuracy"), F.desc("macro_f1"), "model", "text_source").limit(10).select("model", "text_source", "balanced_accuracy", "macro_f1")


# ---- subsets -----------------------------------------------------------------------------------

_PAGES_SQL = with_sql("evidence", "spatial", "quality", "pages")
_N = {
    "rel": "lower(trim(landcover_relevance))", "unc": "lower(trim(uncertainty))", "s2": "coalesce(point_label_share_250m >= 0.8, false)", "bin": "lower(trim(quality_bin))",
    "mh": "coalesce(lower(trim(landcover_relevance)) IN ('medium','high'), false)", "hq": "coalesce(lower(trim(quality_bin)) IN ('quality_high','quality_very_high'), false)",
    "hp": "coalesce(lower(trim(primary_article_type)) IN ('agriculture_or_vineyard','natural_landscape','water_feature'), false)", "oc": "coalesce(lower(trim(primary_article_type)) = 'other_or_unclear', false)",
}
_BOOL = "lower(trim(dominant_matches_point_label_250m)) IN ('true','t','yes','y','oui','on','1','1.0')"
_REGISTRY_SQL = {
    "all": "true", subsets.SPATIAL: _N["s2"], "point_label_share_500m_ge_0.8": "point_label_share_500m >= 0.8", "point_label_share_250m_ge_0.9": "point_label_share_250m >= 0.9",
    "dominant_matches_point_label_250m": _BOOL, "relevance_medium_high": _N["mh"], "relevance_high": f"{_N['rel']} = 'high'", "evidence_sentences_count_ge_1": "evidence_sentences_count >= 1",
    "evidence_sentences_count_ge_2": "evidence_sentences_count >= 2", "uncertainty_low": f"{_N['unc']} = 'low'", "uncertainty_low_medium": f"{_N['unc']} IN ('low','medium')", "quality_high_or_very_high": _N["hq"],
    "quality_very_high": f"{_N['bin']} = 'quality_very_high'", "recommended_use_training": "lower(trim(recommended_use)) = 'use_for_training'", "recommended_use_evaluation_only": "lower(trim(recommended_use)) = 'use_for_evaluation_only'",
    "recommended_use_exclude": "lower(trim(recommended_use)) = 'exclude'",
    **{f"article_type_{t}": f"lower(trim(primary_article_type)) = '{t}'" for t in ("agriculture_or_vineyard", "natural_landscape", "water_feature", "settlement_or_administrative", "built_or_cultural_site", "other_or_unclear")},
    "article_type_high_prior": _N["hp"], "relevance_medium_high_and_spatial_250m_ge_0.8": f"{_N['mh']} AND {_N['s2']}", "relevance_high_and_spatial_250m_ge_0.8": f"{_N['rel']} = 'high' AND {_N['s2']}",
    "evidence_sentences_count_ge_1_and_spatial_250m_ge_0.8": f"evidence_sentences_count >= 1 AND {_N['s2']}", "quality_high_or_very_high_and_spatial_250m_ge_0.8": f"{_N['hq']} AND {_N['s2']}",
    "article_type_high_prior_and_relevance_medium_high": f"{_N['hp']} AND {_N['mh']}", "other_or_unclear_and_relevance_medium_high": f"{_N['oc']} AND {_N['mh']}",
    "article_type_high_prior_and_relevance_medium_high_and_spatial_250m_ge_0.8": f"{_N['hp']} AND {_N['mh']} AND {_N['s2']}", "other_or_unclear_and_relevance_medium_high_and_spatial_250m_ge_0.8": f"{_N['oc']} AND {_N['mh']} AND {_N['s2']}",
}


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.pages(spark, folder).withColumn("dominant_matches_point_label_500m", F.lit(None).cast("string"))


def _counts_sql(named: dict[str, str], extra: str = "count(*) AS n, count(DISTINCT label) AS n_labels") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS subset, {extra} FROM pages WHERE {c} HAVING count(*) > 0" for n, c in named.items())


@query(_PAGES_SQL + _counts_sql(_REGISTRY_SQL))
def c11_subset_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every registered subset that has a member, and its distinct labels."""
    named = {n: c for n, (_, c) in subsets.registry().items()}
    return subsets.expand(_pages(spark, folder), named).groupBy("subset").agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"))


_REL = {"all": "true", **{f"relevance_{x}": f"coalesce({_N['rel']} = '{x}', false)" for x in vocab.RELEVANCE_LEVELS}, "relevance_low_medium_high": f"coalesce({_N['rel']} IN ('low','medium','high'), false)", "relevance_medium_high": _N["mh"]}
_KINDS = {f"article_type:{t}": f"coalesce(primary_article_type, 'other_or_unclear') = '{t}'" for t in vocab.ARTICLE_TYPES}
_LATTICE = dict(_REL) | {subsets.SPATIAL: _N["s2"]} | _KINDS
_LATTICE |= {f"{a}|{b}": f"({x}) AND ({y})" for a, x in _KINDS.items() for b, y in _REL.items() if b != "all"}
_LATTICE |= {f"{a}|{subsets.SPATIAL}": f"({x}) AND {_N['s2']}" for a, x in [*_KINDS.items(), *[r for r in _REL.items() if r[0] != "all"]]}
_LATTICE |= {f"{a}|{b}|{subsets.SPATIAL}": f"({x}) AND ({y}) AND {_N['s2']}" for a, x in _KINDS.items() for b, y in _REL.items() if b != "all"}


@query(_PAGES_SQL.rstrip() + ", p AS (SELECT *, coalesce(qwen = label, false)::INT AS hit FROM pages) " + _counts_sql(_LATTICE, "count(*) AS n, round(avg(hit), 6) AS hit_rate").replace("FROM pages", "FROM p"))
def e27_subset_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """All meets of article type, relevance and spatial subsets in one aggregate."""
    rows = _pages(spark, folder).withColumn("hit", surely(F.col("qwen") == F.col("label")).cast("int"))
    return subsets.expand(rows, subsets.lattice()).groupBy("subset").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"))


_QUALITY_SQL = {n: _REGISTRY_SQL[n] for n in ("all", "relevance_medium_high", "relevance_medium_high_and_spatial_250m_ge_0.8", "quality_high_or_very_high", "quality_high_or_very_high_and_spatial_250m_ge_0.8", "recommended_use_training", "recommended_use_evaluation_only", "recommended_use_exclude")} | {"spatial_250m_ge_0.8": _N["s2"]}


@query(with_sql("evidence", "spatial", "quality", "pages", "records").rstrip() + ", joined AS (SELECT r.*, p.* EXCLUDE (pageid, label, qwen, gemma) FROM records r LEFT JOIN pages p USING (pageid)), "
       + "members AS (" + " UNION ALL ".join(f"SELECT '{n}' AS subset, model, target, prediction, parse_status, row_idx FROM joined WHERE {c}" for n, c in _QUALITY_SQL.items()) + "), " + _single_sql("subset, model", "members") + " SELECT * FROM single")
def e28_subset_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Single-label metrics of every quality subset and model."""
    meta = _pages(spark, folder).drop("label", "qwen", "gemma")
    rows = subsets.expand(inputs.records(spark, folder).join(meta, "pageid", "left"), subsets.quality_subsets())
    groups = ["subset", "model"]
    return _rounded(metrics.single_label(metrics.confusion_counts(rows, groups, "row_idx"), groups, LABELS))


_RELEVANCE_SQL = _REL | {
    "evidence_sentences_count_ge_1": "coalesce(evidence_sentences_count, 0) >= 1", "evidence_sentences_count_ge_2": "coalesce(evidence_sentences_count, 0) >= 2", "uncertainty_low": f"{_N['unc']} = 'low'", "uncertainty_low_medium": f"{_N['unc']} IN ('low','medium')",
    subsets.SPATIAL: _N["s2"], f"{subsets.SPATIAL}_and_relevance_medium_high": f"{_N['s2']} AND {_N['mh']}", f"{subsets.SPATIAL}_and_evidence_sentences_count_ge_1": f"{_N['s2']} AND coalesce(evidence_sentences_count, 0) >= 1",
}
_RELEVANCE_ALL = _RELEVANCE_SQL | {f"{n}_and_{subsets.SPATIAL}": f"({c}) AND {_N['s2']}" for n, c in _RELEVANCE_SQL.items() if not n.startswith(subsets.SPATIAL)} | {f"evidence_type_{t}": f"coalesce(list_contains(evidence_types, '{t}'), false)" for t in vocab.EVIDENCE_TYPES}


@query(_PAGES_SQL + _counts_sql(_RELEVANCE_ALL))
def c5_relevance_subsets(spark: SparkSession, folder: str) -> DataFrame:
    named = subsets.relevance_subsets() | subsets.relevance_and_spatial_subsets() | subsets.evidence_type_subsets()
    return subsets.expand(_pages(spark, folder), named).groupBy("subset").agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"))


@query(_PAGES_SQL + "SELECT count(*) FILTER (WHERE landcover_relevance IS NOT NULL AND point_label_share_250m IS NOT NULL) AS n_available, 0 AS n_without_column FROM pages")
def c12_metadata_available(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.pages(spark, folder)
    there, gone = subsets.available(rows, ["landcover_relevance", "point_label_share_250m"]), subsets.available(rows, ["no_such_column"])
    return rows.agg(F.count_if(there).alias("n_available"), F.count_if(gone).cast("int").alias("n_without_column"))


# ---- distributions and summaries ---------------------------------------------------------------


@query(with_sql("evidence") + "SELECT field, value, count(*) AS n FROM (SELECT 'landcover_relevance' AS field, coalesce(landcover_relevance, 'missing') AS value FROM evidence UNION ALL SELECT 'uncertainty', coalesce(uncertainty, 'missing') FROM evidence) GROUP BY ALL")
def e22_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.value_counts(inputs.evidence(spark, folder), ["landcover_relevance", "uncertainty"])


@query(with_sql("quality") + "SELECT coalesce(primary_article_type, 'missing') AS primary_article_type, count(*) AS n FROM quality GROUP BY 1")
def e23_type_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.quality(spark, folder).groupBy(F.coalesce("primary_article_type", F.lit("missing")).alias("primary_article_type")).agg(F.count("*").alias("n"))


@query(with_sql("quality") + "SELECT quality_bin, recommended_use, count(*) AS n FROM quality WHERE quality_bin IS NOT NULL AND recommended_use IS NOT NULL GROUP BY ALL")
def e24_bin_distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.quality(spark, folder).where(F.col("quality_bin").isNotNull() & F.col("recommended_use").isNotNull())
    return rows.groupBy("quality_bin", "recommended_use").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT label AS g, weight_raw AS v, 1.0 AS o FROM image_probe_splits WHERE weight_raw IS NOT NULL AND label IS NOT NULL)
  SELECT g AS label, round(max(o), 6) AS observed, count(v) AS n_draws, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.025), 6) AS q025, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.975), 6) AS q975, round(100 * count(*) FILTER (WHERE v <= o + 1e-12) / count(v), 6) AS percentile, round((1 + count(*) FILTER (WHERE v >= o - 1e-12)) / (1 + count(v)), 6) AS p_value FROM d GROUP BY g""")
def e30_control_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "image_probe_splits").where("weight_raw IS NOT NULL AND label IS NOT NULL").select("label", F.col("weight_raw").alias("v"), F.lit(1.0).alias("o"))
    return _rounded(reports.draw_summary(rows, ["label"], "v", "o"))


@query(with_sql("records") + "SELECT count(*) AS n_loaded, count(DISTINCT pageid) AS n_unique, count(*) FILTER (WHERE target IS NULL) AS n_no_target, count(*) FILTER (WHERE prediction IS NULL) AS n_no_prediction FROM records")
def e34_join_counts(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.records(spark, folder).agg(F.count("*").alias("n_loaded"), F.count_distinct("pageid").alias("n_unique"), F.count_if(F.col("target").isNull()).alias("n_no_target"), F.count_if(F.col("prediction").isNull()).alias("n_no_prediction"))


@query(with_sql("evidence", "spatial", "quality", "pages") + """, ranked AS (SELECT primary_article_type, pageid, row_number() OVER (PARTITION BY primary_article_type ORDER BY pageid) AS rk FROM pages WHERE primary_article_type IS NOT NULL)
  SELECT primary_article_type, pageid FROM ranked WHERE rk <= 20""".replace("WITH", "WITH", 1))
def g5_audit_head(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.pages(spark, folder).where(F.col("primary_article_type").isNotNull())
    return reports.head_per_group(rows, ["primary_article_type"], [F.asc("pageid")], 20).select("primary_article_type", "pageid")


@query(with_sql("spatial") + f"SELECT pageid, CASE WHEN {_BOOL} THEN true WHEN lower(trim(dominant_matches_point_label_250m)) IN ('false','f','no','n','non','off','0','0.0') THEN false END AS dominant_matches FROM spatial")
def m17_dominant_match(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.spatial(spark, folder).select("pageid", boolish(F.col("dominant_matches_point_label_250m")).alias("dominant_matches"))


@query("SELECT round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS ratio, 0.0 AS none FROM lineitem")
def e1_safe_div(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").agg(F.sum("l_extendedprice").cast("double").alias("a"), F.sum("l_quantity").cast("double").alias("b"))
    return rows.select(F.round(safe_div(F.col("a"), F.col("b")), 4).alias("ratio"), safe_div(F.col("a"), F.lit(0.0)).alias("none"))

"""Queries on supervision quality, splits, controls and embeddings: F30 to F36, G7, H6, I1, K7 to K16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave import vocab
from landweave.functions import geo
from landweave.functions.columns import lookup
from landweave.operators import controls, metrics, probe, quality, reports, subsets
from landweave.operators.ranks import smallest_by_digest
from landweave.plans import inputs
from landweave.plans.evaluation import LABELS, _rounded
from landweave.plans.inputs import case_sql, with_sql
from landweave.session import cut_lineage
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


_PAGES = with_sql("evidence", "spatial", "quality", "pages")
_W = lambda c: f"lower(trim({c}))"


@query(_PAGES.rstrip() + f""", s AS (SELECT pageid, coalesce({case_sql(_W('landcover_relevance'), {k: str(v) for k, v in vocab.RELEVANCE_SCORE.items()})}, '0')::INT AS r, 3.0 * coalesce(point_label_share_250m, 0) AS p,
    least(greatest(coalesce(evidence_sentences_count, 0), 0), 2) AS d, coalesce({case_sql(_W('primary_article_type'), {k: str(v) for k, v in vocab.ARTICLE_TYPE_SCORE.items()})}, '0')::INT AS k,
    coalesce({case_sql(_W('uncertainty'), {k: str(v) for k, v in vocab.UNCERTAINTY_PENALTY.items()})}, '1')::INT AS u FROM pages)
  SELECT pageid, round(r + p + d + k - u, 6) AS quality_score, CASE WHEN r + p + d + k - u < 3 THEN 'quality_low' WHEN r + p + d + k - u < 5 THEN 'quality_medium' WHEN r + p + d + k - u < 7 THEN 'quality_high' ELSE 'quality_very_high' END AS quality_bin FROM s""")
def f30_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.with_quality_score(inputs.pages(spark, folder).drop("quality_score", "quality_bin"))
    return rows.select("pageid", F.round("quality_score", 6).alias("quality_score"), "quality_bin")


def _weight_input(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.pages(spark, folder).withColumnsRenamed({"qwen": "prediction_a", "gemma": "prediction_b"})


_WEIGHTS = _PAGES.rstrip() + f""", c AS (SELECT pageid, label, coalesce({case_sql(_W('landcover_relevance'), {k: str(v) for k, v in vocab.RELEVANCE_WEIGHT.items()})}, '0.5')::DOUBLE * coalesce({case_sql(_W('uncertainty'), {k: str(v) for k, v in vocab.UNCERTAINTY_WEIGHT.items()})}, '0.75')::DOUBLE
    * greatest(0.2, least(1.0, coalesce(point_label_share_250m, 0.2))) * CASE WHEN qwen IS NOT DISTINCT FROM label AND gemma IS NOT DISTINCT FROM label THEN 1.25 WHEN qwen IS NOT DISTINCT FROM label OR gemma IS NOT DISTINCT FROM label THEN 1.0
      WHEN qwen IS NOT DISTINCT FROM gemma THEN 0.75 ELSE 0.85 END AS raw FROM pages),
  w AS (SELECT *, raw / avg(raw) OVER () AS weight_raw FROM c), b AS (SELECT *, weight_raw / avg(weight_raw) OVER (PARTITION BY label) AS balanced FROM w)"""


@query(_WEIGHTS + " SELECT pageid, round(weight_raw, 6) AS weight_raw, round(balanced / avg(balanced) OVER (), 6) AS weight_class_balanced FROM b")
def f32_quality_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.with_weights(_weight_input(spark, folder).drop("weight_raw"))
    return rows.select("pageid", F.round("weight_raw", 6).alias("weight_raw"), F.round("weight_class_balanced", 6).alias("weight_class_balanced"))


_T = f"pow((1 - {geo.LCC_E!r} * sin(radians(lat))) / (1 + {geo.LCC_E!r} * sin(radians(lat))), {geo.LCC_E / 2!r})"
_LCC = f"""l AS (SELECT pageid, {geo.LCC_A * geo.LCC_C!r} * pow(tan(pi() / 4 - radians(lat) / 2) / {_T}, {geo.LCC_N!r}) AS rho, {geo.LCC_N!r} * radians(lon - 3.0) AS theta FROM articles),
  xy AS (SELECT pageid, 700000.0 + rho * sin(theta) AS x, 6600000.0 + {geo.LCC_RHO0!r} - rho * cos(theta) AS y FROM l)"""


@query(with_sql("articles").rstrip() + ", " + _LCC + " SELECT pageid, CAST(floor(x / 10000) AS BIGINT) || '_' || CAST(floor(y / 10000) AS BIGINT) AS geo_group_10km, CAST(floor(x / 20000) AS BIGINT) || '_' || CAST(floor(y / 20000) AS BIGINT) AS geo_group_20km FROM xy")
def f33_geo_groups(spark: SparkSession, folder: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    return inputs.articles(spark, folder).select("pageid", quality.geo_group(lon, lat, 10_000).alias("geo_group_10km"), quality.geo_group(lon, lat, 20_000).alias("geo_group_20km"))


_UNIT = "list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))))"


@query(f"SELECT vec_id, round(list_sum({_UNIT}), 5) AS total FROM embeddings")
def f36_normalize_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", probe.unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(_WEIGHTS + ", m AS (SELECT label, count(*) AS n, avg(weight_raw) AS mean FROM w WHERE label IS NOT NULL GROUP BY label) SELECT label, n, round(mean, 6) AS mean_weight FROM m")
def g2_group_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.with_weights(_weight_input(spark, folder)).where("label IS NOT NULL")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("weight_raw"), 6).alias("mean_weight"))


@query(_PAGES.rstrip() + """, r AS (SELECT label, pageid, row_number() OVER (PARTITION BY label ORDER BY left(md5('42:' || pageid), 15), pageid) AS rk FROM pages WHERE label IS NOT NULL)
  SELECT label, pageid FROM r WHERE rk <= 5""")
def g7_per_class_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quality.sample_per_class(inputs.pages(spark, folder), 5, 42).select("label", "pageid")


@query("SELECT pageid, title, CAST(NULL AS VARCHAR) AS quality_bin FROM article_contents UNION ALL SELECT pageid, title, quality_bin FROM quality_scores")
def i1_union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "article_contents").select("pageid", "title")
    return a.unionByName(table(spark, folder, "quality_scores").select("pageid", "title", "quality_bin"), allowMissingColumns=True)


@query("SELECT DISTINCT pageid FROM article_contents WHERE pageid NOT IN (SELECT pageid FROM quality_scores WHERE pageid IS NOT NULL)")
def i3_set_difference(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_contents").select("pageid").subtract(table(spark, folder, "quality_scores").select("pageid"))


@query("SELECT pageid FROM article_contents INTERSECT SELECT pageid FROM spatial_confidence")
def i4_set_intersection(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "article_contents").select("pageid").intersect(table(spark, folder, "spatial_confidence").select("pageid"))


@query(with_sql("contents").rstrip() + """, r AS (SELECT pageid, lead(pageid) OVER (ORDER BY CAST(pageid AS BIGINT)) AS nxt, first_value(pageid) OVER (ORDER BY CAST(pageid AS BIGINT)) AS fst FROM contents)
  SELECT pageid, coalesce(nxt, fst) AS shuffled_from FROM r""")
def k14_rotation_control(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.contents(spark, folder, ()).select("pageid", F.col("pageid").cast("long").alias("row_idx"))
    return controls.rotated(rows, "row_idx", "pageid").select("pageid", F.col("control").alias("shuffled_from"))


@query(f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), m AS (SELECT label, i, avg(v[i]) AS x FROM u CROSS JOIN range(1, 65) r(i) GROUP BY ALL),
  p AS (SELECT label, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM m GROUP BY label), s AS (SELECT u.vec_id, p.label, list_inner_product(u.v, p.v) / p.n AS s FROM u CROSS JOIN p)
  SELECT vec_id, CAST(arg_max(label, s) AS VARCHAR) AS prediction FROM s GROUP BY vec_id""")
def k10_zero_shot(spark: SparkSession, folder: str) -> DataFrame:
    """Label of the nearest mean vector by cosine."""
    rows = table(spark, folder, "embeddings")
    prompts = [(str(r["label"]), r["embedding"]) for r in probe.mean_vectors(rows, "label").collect()]
    return probe.nearest_prompt(rows.select("vec_id", "embedding"), prompts).select("vec_id", "prediction")


@query()
def k7_linear_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Probe trained over all vectors with the reference's epochs, rate and L2, and its prediction for each."""
    rows = table(spark, folder, "embeddings")
    model = probe.fit_probe_distributed(rows, "label", seed=42, epochs=500, rate=0.1, l2=1e-4)
    return probe.predict_probe(rows, model).select("vec_id", F.col("label").cast("string").alias("target"), "prediction")


def _page_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``pageid, embedding``: the n-th page of a class, by digest, has the n-th vector of the label in the class's place.

    The tables hold no vectors of pages; pages beyond the vectors of their class have none.
    """
    vectors = table(spark, folder, "embeddings").where("embedding IS NOT NULL")
    place = lookup(F.col("label"), {label: i for i, label in enumerate(sorted(LABELS))})
    pages = inputs.pages(spark, folder).where("label IS NOT NULL").select("pageid", place.cast("int").alias("place"))
    ranked = lambda df, key: smallest_by_digest(df.withColumn("_all", F.lit(2**62)), ["place"], [key], "_all", 0).drop("_all")
    numbered = ranked(vectors.select("vec_id", "embedding", F.col("label").cast("int").alias("place")), "vec_id").select("embedding", "place", "rank")
    return ranked(pages, "pageid").join(numbered, ["place", "rank"]).select("pageid", "embedding")


@query()
def k12_probe_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Probes of eight training policies, all evaluation splits and four strengths of L2, scored on the held-out pages."""
    pages = quality.with_weights(_weight_input(spark, folder).where("label IS NOT NULL").drop("weight_raw"))
    rows = cut_lineage(probe.stack_embeddings(pages, _page_vectors(spark, folder), "pageid", allow_missing=True))
    places = f33_geo_groups(spark, folder).select("pageid", "geo_group_20km")
    members = cut_lineage(quality.probe_splits(rows.drop("embedding").join(places, "pageid")).select(F.col("pageid").alias("key"), "split", "tier"))
    guesses = probe.probe_grid(rows.withColumn("key", F.col("pageid")), members, quality.training_policies(), (1e-5, 1e-4, 1e-3, 1e-2))
    guesses = guesses.withColumns({"parse_status": F.lit("ok"), "pageid": F.col("key")})
    by = ["policy", "split", "l2"]
    return _rounded(metrics.supported(metrics.confusion_counts(guesses, by), by, LABELS))


@query()
def k17_training_controls(spark: SparkSession, folder: str) -> DataFrame:
    """Where probes trained on the two hard tiers stand among 100 probes trained on random rows of their number, and of their labels."""
    pages = _weight_input(spark, folder).where("label IS NOT NULL")
    rows = cut_lineage(probe.stack_embeddings(pages, _page_vectors(spark, folder), "pageid", allow_missing=True))
    places = f33_geo_groups(spark, folder).select("pageid", "geo_group_20km")
    members = quality.probe_splits(rows.drop("embedding").join(places, "pageid"), repeats=0).select(F.col("pageid").alias("key"), "split", "tier")
    drawn = probe.training_controls(rows.withColumn("key", F.col("pageid")), cut_lineage(members), LABELS, ("quality_spatial", "text_spatial_agreement"))
    return _rounded(reports.draw_summary(drawn, ["tier", "control"], "score", "observed"))


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    places = f33_geo_groups(spark, folder).select("pageid", "geo_group_20km")
    return quality.probe_splits(_weight_input(spark, folder).where("label IS NOT NULL").join(places, "pageid"))


_PACK = """ordered AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS i FROM sizes),
  pack(i, g, fold, filled) AS (
    SELECT 0::BIGINT, NULL::VARCHAR, NULL::INT, [0, 0, 0, 0, 0]::BIGINT[]
    UNION ALL SELECT o.i, o.g, CAST(list_position(p.filled, list_min(p.filled)) - 1 AS INT),
      list_transform(p.filled, lambda v, k: CASE WHEN k = list_position(p.filled, list_min(p.filled)) THEN v + o.n ELSE v END)
    FROM pack p JOIN ordered o ON o.i = p.i + 1)"""
_FOLDS = with_sql("articles").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _LCC + """,
  sizes AS (SELECT CAST(floor(x / 20000) AS BIGINT) || '_' || CAST(floor(y / 20000) AS BIGINT) AS g, count(*) AS n FROM xy GROUP BY 1), """ + _PACK


_TRUE = "lower(trim(dominant_matches_point_label_250m)) IN ('true','t','yes','y','oui','on','1','1.0')"
_SPLITS = with_sql("articles", "evidence", "spatial", "quality", "pages").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _LCC + f""",
  u AS (SELECT p.*, CAST(floor(x / 20000) AS BIGINT) || '_' || CAST(floor(y / 20000) AS BIGINT) AS g, coalesce(point_label_share_250m >= 0.8, false) AND coalesce({_TRUE}, false) AS sp,
    coalesce(landcover_relevance IN ('medium', 'high'), false) AND coalesce(quality_bin IN ('quality_high', 'quality_very_high'), false) AND NOT coalesce(uncertainty = 'high', false) AS fine, coalesce(qwen = gemma AND qwen = label, false) AS agree
    FROM pages p JOIN xy USING (pageid) WHERE label IS NOT NULL),
  t AS (SELECT pageid, label, g, list_filter(['all', CASE WHEN sp THEN 'spatial_only' END, CASE WHEN sp AND fine THEN 'quality_spatial' END, CASE WHEN sp AND fine AND agree THEN 'text_spatial_agreement' END], lambda z: z IS NOT NULL) AS tiers FROM u),
  sizes AS (SELECT g, count(*) AS n FROM t GROUP BY g), {_PACK},
  pool AS (SELECT pageid, label FROM t WHERE list_contains(tiers, 'quality_spatial')),
  evals AS (SELECT pageid, 'eval_strict' AS split, 'eval_strict' AS tier FROM (SELECT pageid, row_number() OVER (PARTITION BY label ORDER BY left(md5('42:' || pageid), 15), pageid) AS rk FROM pool) WHERE rk <= 5
    UNION ALL SELECT pageid, 'repeated_eval_seed_' || r, 'eval_repeated' FROM (SELECT pageid, r, row_number() OVER (PARTITION BY r, label ORDER BY left(md5((42 + r) || ':' || pageid), 15), pageid) AS rk FROM pool CROSS JOIN range(0, 20) q(r)) WHERE rk <= 5
    UNION ALL SELECT pageid, 'spatial_block_fold_' || fold, 'eval_spatial_block' FROM t JOIN pack USING (g)),
  names AS (SELECT 'eval_strict' AS held, 'train' AS split UNION ALL SELECT 'eval_strict', 'train_for_eval_strict' UNION ALL SELECT 'repeated_eval_seed_' || r, 'train_for_repeated_eval_seed_' || r FROM range(0, 20) q(r)
    UNION ALL SELECT 'spatial_block_fold_' || r, 'train_for_spatial_block_fold_' || r FROM range(0, 5) q(r)),
  training AS (SELECT pageid, split, unnest(tiers) AS tier FROM t CROSS JOIN names n WHERE NOT EXISTS (SELECT 1 FROM evals e WHERE e.pageid = t.pageid AND e.split = n.held))
  SELECT pageid, label, s.split, s.tier FROM (SELECT * FROM evals UNION ALL SELECT * FROM training) s JOIN t USING (pageid)"""


@query(_SPLITS)
def k13_probe_splits(spark: SparkSession, folder: str) -> DataFrame:
    return _splits(spark, folder)


@query(_FOLDS + " SELECT g AS geo_group_20km, fold FROM pack WHERE i > 0")
def h6_group_folds(spark: SparkSession, folder: str) -> DataFrame:
    sizes = f33_geo_groups(spark, folder).groupBy("geo_group_20km").agg(F.count("*").alias("size"))
    return quality.group_folds(sizes, "geo_group_20km", "size")


def _draws(spark: SparkSession, folder: str, draws: int = 1000) -> DataFrame:
    meta = inputs.pages(spark, folder).drop("label", "qwen", "gemma")
    rows = inputs.records(spark, folder).join(meta, "pageid", "left").where("parse_status = 'ok'")
    members = subsets.expand(rows, subsets.quality_subsets()).select("model", "text_source", "subset", "pageid")
    return controls.monte_carlo(members, rows.select("model", "text_source", "pageid", "target", "prediction"), ["model", "text_source"], LABELS, draws=draws)


@query()
def k16_monte_carlo(spark: SparkSession, folder: str) -> DataFrame:
    """Where every quality subset's balanced accuracy stands among 1,000 random subsets of its size, and of its targets."""
    return _rounded(reports.draw_summary(_draws(spark, folder), ["model", "text_source", "subset", "control"], "score", "observed"))


@query(_PAGES.rstrip() + """, u AS (SELECT label, count(*) AS available FROM pages WHERE label IS NOT NULL GROUP BY label), w AS (SELECT label, count(*) AS wanted FROM pages WHERE label IS NOT NULL AND point_label_share_250m >= 0.8 GROUP BY label)
  SELECT w.label AS target, wanted, coalesce(available, 0) AS available, coalesce(available, 0) >= wanted AS feasible FROM w LEFT JOIN u USING (label)""")
def k15_feasible_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.pages(spark, folder).where("label IS NOT NULL").withColumnRenamed("label", "target")
    return controls.target_feasible(rows, rows.where("point_label_share_250m >= 0.8"))


@query()
def e31_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.confusion_counts(inputs.records(spark, folder), ["model", "text_source"], "row_idx").where("ok")
    return _rounded(controls.bootstrap_intervals(rows.select("model", "text_source", "target", "prediction", "n"), ["model", "text_source"], LABELS))


@query("SELECT split, tier, count(*) AS n, count(DISTINCT pageid) AS n_pages FROM image_probe_splits GROUP BY ALL")
def s18_split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "image_probe_splits").groupBy("split", "tier").agg(F.count("*").alias("n"), F.count_distinct("pageid").alias("n_pages"))

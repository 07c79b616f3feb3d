"""Queries on the cascade of filters and on what must hold after it: A7, A22 to A24, C15, D4, D17, E12, E33, E37, E38, G6, H5, J4, M16, M26."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave import vocab
from landweave.functions import columns as C
from landweave.functions import geo
from landweave.operators import audit, metrics, overlay, quality, reports
from landweave.operators.regions import locate
from landweave.operators.truth import in_either
from landweave.plans import inputs
from landweave.plans.evaluation import GROUP, _rounded
from landweave.plans.inputs import with_sql
from landweave.plans.spatial import _LU, _NA, _boxes, _natural, _tagged, confidence_by_radius, d5_landcover_around_articles
from landweave.plans.supervision import _WEIGHTS, ORACLE as _SUPERVISION, _draws, _weight_input, k10_zero_shot
from landweave.plans.texts import _WS
from landweave.sources.tables import table
from landweave.streaming import resume

ORACLE_K10 = _SUPERVISION["k10_zero_shot"].rpartition("\n")[0]
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- polygons ----

_POINT = f"pow((1 - {geo.LCC_E!r} * sin(radians(la))) / (1 + {geo.LCC_E!r} * sin(radians(la))), {geo.LCC_E / 2!r})"
_PLANE = f""", pts AS (SELECT id, code_18, i, x[i] AS lo, y[i] AS la FROM corners CROSS JOIN range(1, 6) r(i)),
  pol AS (SELECT id, code_18, i, {geo.LCC_A * geo.LCC_C!r} * pow(tan(pi() / 4 - radians(la) / 2) / {_POINT}, {geo.LCC_N!r}) AS rho, {geo.LCC_N!r} * radians(lo - 3.0) AS theta FROM pts),
  xy AS (SELECT id, code_18, i, 700000.0 + rho * sin(theta) AS px, 6600000.0 + {geo.LCC_RHO0!r} - rho * cos(theta) AS py FROM pol),
  e AS (SELECT a.id, a.code_18, a.px - 700000 AS x1, a.py - 6600000 AS y1, b.px - 700000 AS x2, b.py - 6600000 AS y2 FROM xy a JOIN xy b ON a.id = b.id AND a.code_18 IS NOT DISTINCT FROM b.code_18 AND b.i = a.i + 1),
  plane AS (SELECT id, code_18, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 6 AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 6 AS my FROM e GROUP BY id, code_18)"""


@query(with_sql("corners").rstrip() + _PLANE + " SELECT id, code_18, round(abs(a), -1) AS area_m2 FROM plane WHERE abs(a) >= 15000")
def c15_map_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Polygons of at least 15,000 square metres, as the maps show them."""
    areas = overlay.planar_areas(overlay.planar(inputs.polygons(spark, folder), "id", "geometry", ["code_18"]))
    return areas.where(F.col("area") >= overlay.LEAST_MAP_AREA).select("id", "code_18", F.round("area", -1).alias("area_m2"))


@query(with_sql("corners").rstrip() + _PLANE + """, r AS (SELECT *, row_number() OVER (ORDER BY left(md5('42:' || CAST(id AS VARCHAR)), 15), id) AS rk FROM plane WHERE coalesce(code_18, '') NOT LIKE '1%')
  SELECT id, code_18, left(code_18, 2) AS class_label, round(700000 + mx / a, 1) AS x, round(6600000 + my / a, 1) AS y FROM r WHERE rk <= 20""")
def a7_sample_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty polygons by hash with their class and their centre on the plane; the sample is the feature."""
    sample = overlay.sample_polygons(inputs.polygons(spark, folder), 20, level=2, seed=42, exclude_artificial=True)
    return sample.select("id", "code_18", "class_label", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


_BOXES = """, boxes AS (SELECT id, code_18, list_min(x) AS minx, list_max(x) AS maxx, list_min(y) AS miny, list_max(y) AS maxy FROM corners WHERE code_18 IS NOT NULL)"""


@query(with_sql("articles", "corners").rstrip() + _BOXES + " SELECT DISTINCT a.pageid FROM articles a JOIN boxes b ON b.code_18 NOT LIKE '1%' AND a.lon - 0.01 < b.maxx AND a.lon + 0.01 > b.minx AND a.lat - 0.01 < b.maxy AND a.lat + 0.01 > b.miny")
def d4_overlapping(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes around articles that share area with the box of a polygon that is not artificial."""
    left, right = _boxes(spark, folder)
    return overlay.overlapping(left, right.where(C.natural_class(F.col("code_18"))), "pageid")


@query(with_sql("corners") + f"SELECT DISTINCT id FROM corners WHERE code_18 NOT LIKE '1%' AND ({_LU} IS NOT NULL OR {_NA} IS NOT NULL)")
def d4_tags_on_landcover(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged polygons that share area with land cover that is not artificial; the polygons do not overlap each other."""
    return overlay.overlapping(*_layers(spark, folder), "id")


def _layers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = inputs.polygons(spark, folder)
    tags = C.tag_labels(C.lookup(F.col("code_18"), inputs.CODE_LANDUSE), C.lookup(F.col("code_18"), inputs.CODE_NATURAL))
    tagged = overlay.planar(rows.where(F.size(tags) > 0), "id", "geometry", [])
    return tagged, overlay.planar(rows.where(C.natural_class(F.col("code_18")) & F.col("code_18").isNotNull()), "id", "geometry", [])


@query(with_sql("articles", "corners", "hits").rstrip() + f""", tags AS (SELECT count(*) FILTER (WHERE {_LU} IS NOT NULL OR {_NA} IS NOT NULL) AS b, count(*) FILTER (WHERE code_18 NOT LIKE '1%' AND ({_LU} IS NOT NULL OR {_NA} IS NOT NULL)) AS a FROM corners),
  kept AS (SELECT DISTINCT pageid FROM hits WHERE code_18 NOT LIKE '1%' OR {_LU} IS NOT NULL OR {_NA} IS NOT NULL),
  c AS (SELECT pageid, pageid IN (SELECT pageid FROM kept) AS k FROM article_contents), s AS (SELECT pageid, pageid IN (SELECT pageid FROM c WHERE k) AS k FROM article_landuse_evidence_summaries)
  SELECT 'tags' AS name, b AS before, a AS after FROM tags UNION ALL SELECT 'articles', count(*), (SELECT count(*) FROM kept) FROM articles
  UNION ALL SELECT 'contents', count(*), count(*) FILTER (WHERE k) FROM c UNION ALL SELECT 'summaries', count(*), count(*) FILTER (WHERE k) FROM s""")
def j4_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Dry run of the whole cascade: rows before and after of tagged polygons, articles, contents and summaries."""
    tagged, natural = _layers(spark, folder)
    tables = {"contents": table(spark, folder, "article_contents").select("pageid"), "summaries": table(spark, folder, "article_landuse_evidence_summaries").select("pageid")}
    kept_tags = overlay.overlapping(tagged, natural, "id")
    regions = _tagged(spark, folder).join(kept_tags, "id", "left_semi")
    articles = inputs.articles(spark, folder)
    kept = in_either(articles, _natural(spark, folder), regions).select("pageid")
    return resume.cascade_counts({"tags": (tagged.select("id"), kept_tags), "articles": (articles.select("pageid"), kept)}, kept, tables)


# ---- audits ----


@query(with_sql("articles", "corners", "hits").rstrip() + f""", kept AS (SELECT DISTINCT pageid FROM hits WHERE code_18 NOT LIKE '1%' OR {_LU} IS NOT NULL OR {_NA} IS NOT NULL),
  known AS (SELECT DISTINCT pageid FROM articles), texts AS (SELECT DISTINCT pageid FROM article_contents WHERE pageid IS NOT NULL)
  SELECT 'artificial polygon' AS "check", CAST(id AS VARCHAR) AS key FROM corners WHERE code_18 LIKE '1%'
  UNION ALL SELECT 'article outside', pageid FROM known WHERE pageid NOT IN (SELECT pageid FROM kept)
  UNION ALL SELECT 'contents: stale key', pageid FROM texts WHERE pageid NOT IN (SELECT pageid FROM known)
  UNION ALL SELECT 'summaries: stale key', pageid FROM (SELECT DISTINCT pageid FROM article_landuse_evidence_summaries WHERE pageid IS NOT NULL) WHERE pageid NOT IN (SELECT pageid FROM texts)
  UNION ALL SELECT 'artificial class in the distribution', CAST(pageid AS VARCHAR) FROM (SELECT DISTINCT pageid FROM spatial_confidence WHERE point_label LIKE '1%' AND pageid IS NOT NULL)
  UNION ALL SELECT 'file missing', 'nowhere.json'""")
def e37_cascade_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of the cascade on tables that did not go through it, and a file that is not there."""
    tagged, natural = _layers(spark, folder)
    rows = inputs.polygons(spark, folder)
    shares = table(spark, folder, "spatial_confidence").where("pageid IS NOT NULL").select(F.col("pageid").alias("id"), F.col("point_label").alias("class_label")).distinct()
    return audit.cascade_audit(
        rows, tagged.join(overlay.overlapping(tagged, natural, "id"), "id", "left_semi"), natural, inputs.articles(spark, folder),
        in_either(inputs.articles(spark, folder), _natural(spark, folder), _tagged(spark, folder)),
        {"contents": table(spark, folder, "article_contents"), "summaries": table(spark, folder, "article_landuse_evidence_summaries")}, shares, ["nowhere.json"],
    )


@query("""WITH wiki AS (SELECT CAST(pageid AS VARCHAR) AS pageid, lat, lon FROM wiki_articles), c AS (SELECT DISTINCT pageid FROM article_contents WHERE pageid IS NOT NULL), s AS (SELECT DISTINCT pageid FROM article_landuse_evidence_summaries WHERE pageid IS NOT NULL)
  SELECT 'articles: repeated' AS "check", pageid AS key FROM wiki WHERE pageid IS NOT NULL GROUP BY pageid HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'articles: no place', pageid FROM wiki WHERE pageid IS NOT NULL AND (lat IS NULL OR lon IS NULL)
  UNION ALL SELECT 'contents: missing', pageid FROM (SELECT DISTINCT pageid FROM wiki WHERE pageid IS NOT NULL) WHERE pageid NOT IN (SELECT pageid FROM c)
  UNION ALL SELECT 'contents: extra', pageid FROM c WHERE pageid NOT IN (SELECT pageid FROM wiki WHERE pageid IS NOT NULL)
  UNION ALL SELECT 'summaries: missing', pageid FROM c WHERE pageid NOT IN (SELECT pageid FROM s)
  UNION ALL SELECT 'summaries: extra', pageid FROM s WHERE pageid NOT IN (SELECT pageid FROM c)
  UNION ALL SELECT DISTINCT 'summaries: no text', pageid FROM article_landuse_evidence_summaries WHERE pageid IS NOT NULL AND landuse_evidence_summary IS NULL""")
def e38_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated ids, missing places, key sets that differ, records without text."""
    wiki = table(spark, folder, "wiki_articles").withColumn("pageid", F.col("pageid").cast("string"))
    chain = [("articles", wiki, None), ("contents", table(spark, folder, "article_contents"), None), ("summaries", table(spark, folder, "article_landuse_evidence_summaries"), "landuse_evidence_summary")]
    return audit.validate(chain, places=("lat", "lon"))


# ---- records ----


@query(with_sql("records") + """SELECT model, count(*) FILTER (WHERE coalesce(parse_status, 'ok') = 'ok') AS lenient, count(*) FILTER (WHERE parse_status = 'ok' AND prediction IS NOT NULL) AS strict
  FROM (SELECT model, prediction, CASE WHEN row_idx % 5 = 0 THEN NULL ELSE parse_status END AS parse_status FROM records) GROUP BY model""")
def a22_ok_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records that count as ok, with and without those of unknown status."""
    rows = inputs.records(spark, folder).withColumn("parse_status", F.when(F.col("row_idx") % 5 != 0, F.col("parse_status")))
    a, b = (metrics.ok_records(rows, lenient=x).groupBy("model").agg(F.count("*").alias(n)) for x, n in ((True, "lenient"), (False, "strict")))
    return a.join(b, "model")


@query("SELECT DISTINCT pageid FROM (SELECT pageid FROM article_contents UNION ALL SELECT pageid FROM quality_scores UNION ALL SELECT pageid FROM image_probe_splits) WHERE pageid IS NOT NULL")
def a24_pages_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Page ids that any of several tables has."""
    return reports.all_keys([table(spark, folder, n) for n in ("article_contents", "quality_scores", "image_probe_splits")], "pageid")


@query(_WEIGHTS + """, f AS (SELECT pageid, round(weight_raw, 6) AS weight_raw FROM w) SELECT s.pageid, s.split, s.tier, f.weight_raw FROM (SELECT DISTINCT pageid, split, tier FROM image_probe_splits) s LEFT JOIN f USING (pageid)""")
def d17_attached_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Splits with the weights of their pages in place of their own."""
    weights = quality.with_weights(_weight_input(spark, folder).drop("weight_raw"))
    rows = table(spark, folder, "image_probe_splits").select("pageid", "split", "tier", "weight_raw").drop("weight_raw").distinct()
    joined = quality.attach_weights(rows.withColumn("spatial_component", F.lit(-1.0)), weights)
    return joined.select("pageid", "split", "tier", F.round("weight_raw", 6).alias("weight_raw"))


_UNIVERSE = with_sql("records").rstrip() + """, ok AS (SELECT * FROM records WHERE parse_status = 'ok' AND prediction IS NOT NULL AND target IS NOT NULL), l AS (SELECT DISTINCT unnest([target, prediction]) AS label FROM ok),
  per AS (SELECT g.model, g.text_source, l.label, count(*) FILTER (WHERE target = l.label) AS s, count(*) FILTER (WHERE prediction = l.label) AS p, count(*) FILTER (WHERE target = l.label AND prediction = l.label) AS tp
    FROM (SELECT DISTINCT model, text_source FROM ok) g CROSS JOIN l JOIN ok USING (model, text_source) GROUP BY ALL)"""


@query(_UNIVERSE + """ SELECT model, text_source, count(*) AS n_labels, round(avg(coalesce(tp / nullif(s, 0), 0)), 6) AS balanced_accuracy, round(avg(coalesce(tp / nullif(p, 0), 0)), 6) AS macro_precision FROM per GROUP BY ALL""")
def e12_observed_universe(spark: SparkSession, folder: str) -> DataFrame:
    """Averages over the labels that occur as target or as prediction, whatever they are."""
    counts = metrics.confusion_counts(inputs.records(spark, folder), GROUP, "row_idx").where("ok")
    labels = metrics.observed_labels(counts)
    rows = metrics.supported(counts, GROUP, labels)
    return _rounded(rows.select(*GROUP, F.lit(len(labels)).cast("long").alias("n_labels"), F.col("balanced_accuracy_allowed").alias("balanced_accuracy"), F.col("macro_precision_allowed").alias("macro_precision")))


@query()
def e33_headline(spark: SparkSession, folder: str) -> DataFrame:
    """The headline subsets and sources with both controls side by side."""
    return _rounded(reports.headline(reports.draw_summary(_draws(spark, folder), ["model", "text_source", "subset", "control"], "score", "observed")))


_PAGES = with_sql("evidence", "spatial", "quality", "pages")


@query(_PAGES.rstrip() + """, firsts AS (SELECT label, min(pageid) AS pageid FROM pages WHERE label IS NOT NULL GROUP BY label), rest AS (SELECT pageid, row_number() OVER (ORDER BY pageid) AS i FROM pages WHERE pageid NOT IN (SELECT pageid FROM firsts))
  SELECT pageid FROM firsts UNION ALL SELECT pageid FROM rest WHERE i <= 20 - (SELECT count(*) FROM firsts)""")
def g6_contact_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty pages for a sheet, the first of every label among them; the number is the feature."""
    return reports.contact_sheet(inputs.pages(spark, folder), 20)


@query(_PAGES.rstrip() + " SELECT label, arg_min(pageid, (point_label_share_250m, pageid)) AS pageid FROM pages WHERE label IS NOT NULL AND point_label_share_250m IS NOT NULL GROUP BY label")
def h5_least(spark: SparkSession, folder: str) -> DataFrame:
    """Of every label the page with the least share, as the least cloudy image of a window is chosen."""
    return reports.least(inputs.pages(spark, folder).where("label IS NOT NULL"), ["label"], "point_label_share_250m", "pageid")


@query(with_sql("evidence") + "SELECT pageid, array_to_string(list_filter(evidence_types, lambda x: x IS NOT NULL), '|') AS categories FROM evidence WHERE evidence_types IS NOT NULL")
def m26_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of a payload that are texts or objects with a title, from evidence types written in both ways."""
    written = F.transform("evidence_types", lambda t, i: F.when(i % 2 == 0, F.to_json(F.struct(t.alias("title"), F.lit(1).alias("ns")))).otherwise(F.concat(F.lit('"'), t, F.lit('"'))))
    payload = F.concat(F.lit('{"categories": ['), F.array_join(F.array_compact(written), ", "), F.lit(', 7, {"name": "x"}]}'))
    payload = F.when(F.size(F.array_compact("evidence_types")) > 0, payload).otherwise('{"categories": [7]}')
    rows = inputs.evidence(spark, folder).where("evidence_types IS NOT NULL").select("pageid", C.payload_categories(payload).alias("c"))
    return rows.select("pageid", F.array_join("c", "|").alias("categories"))


@query(with_sql("corners") + "SELECT 'way/' || CAST(id AS VARCHAR) AS osm_id, code_18 AS landuse FROM corners WHERE id % 2 = 1")
def a37_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of an answer as polygons, from land cover; the rings of even ids cross themselves and are left out."""
    from landweave.functions.geo import polygon_rings
    from landweave.sources.fetch import elements_to_polygons

    ring = polygon_rings(F.col("geometry"))[0]
    point = lambda i: F.struct(ring[i]["x"].alias("lon"), ring[i]["y"].alias("lat"))
    order = F.when(F.col("id") % 2 == 1, F.array(*[point(i) for i in range(5)])).otherwise(F.array(*[point(i) for i in (0, 2, 1, 3, 0)]))
    rows = inputs.polygons(spark, folder).select(F.lit("way").alias("type"), "id", F.create_map(F.lit("landuse"), F.col("code_18")).alias("tags"), order.alias("points"))
    return elements_to_polygons(rows).select("osm_id", "landuse")


@query(with_sql("articles", "corners").rstrip() + _PLANE + f""", pa AS (SELECT pageid, {geo.LCC_A * geo.LCC_C!r} * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {geo.LCC_E!r} * sin(radians(lat))) / (1 + {geo.LCC_E!r} * sin(radians(lat))), {geo.LCC_E / 2!r}), {geo.LCC_N!r}) AS rho, {geo.LCC_N!r} * radians(lon - 3.0) AS theta FROM articles),
  p AS (SELECT pageid, rho * sin(theta) AS px, {geo.LCC_RHO0!r} - rho * cos(theta) AS py FROM pa),
  b AS (SELECT id, code_18, list(x1 ORDER BY x1) AS xs, list(y1 ORDER BY y1) AS ys, list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)) AS es FROM e GROUP BY id, code_18),
  h AS (SELECT pageid, left(code_18, 2) AS label, list_transform(es, lambda s: (s.x2 - s.x1) * (py - s.y1) - (s.y2 - s.y1) * (px - s.x1)) AS d FROM p JOIN b ON px BETWEEN b.xs[1] AND b.xs[-1] AND py BETWEEN b.ys[1] AND b.ys[-1] WHERE code_18 IS NOT NULL)
  SELECT pageid, min(label) AS label FROM h WHERE list_min(d) >= 0 OR list_max(d) <= 0 GROUP BY pageid HAVING count(DISTINCT label) = 1""")
def d6_planar_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The only label around every place, tested on the plane in metres."""
    rows = inputs.polygons(spark, folder).withColumn("label", C.level2(F.col("code_18"))).where("label IS NOT NULL")
    regions = overlay.planar(rows, "id", "geometry", ["label"])
    x, y = geo.lcc_forward(F.col("lon"), F.col("lat"))
    points = inputs.articles(spark, folder).select("pageid", x.alias("x"), y.alias("y"))
    edges = regions.select("id", "label", geo.ring_edges(F.col("rings")).alias("edges"), "minx", "maxx", "miny", "maxy")
    found = locate(points, "x", "y", edges, span=overlay.SPAN).groupBy("pageid").agg(F.collect_set("label").alias("labels"))
    return found.where(F.size("labels") == 1).select("pageid", F.col("labels")[0].alias("label"))


@query("""WITH w AS (SELECT vec_id, embedding AS a, list_reverse(embedding) AS b FROM embeddings WHERE embedding IS NOT NULL)
  SELECT 320 AS window_a, 2240 AS window_b, count(*) AS n, round(avg(list_sum(list_transform(list_zip(a, b), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2]))) / len(a)), 5) AS mean_difference FROM w""")
def e40_window_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Mean difference of the patches of two windows, with vectors and their reverse for patches."""
    rows = table(spark, folder, "embeddings").where("embedding IS NOT NULL")
    patches = rows.select("vec_id", F.lit(320).alias("window_m"), F.col("embedding").alias("patch")).unionByName(rows.select("vec_id", F.lit(2240).alias("window_m"), F.reverse("embedding").alias("patch")))
    found = audit.window_differences(patches, "vec_id")
    return found.select("window_a", "window_b", "n", F.round("mean_difference", 5).alias("mean_difference"))


@query(ORACLE_K10 + """, guesses AS (SELECT vec_id, CAST(arg_max(label, s) AS VARCHAR) AS prediction FROM s GROUP BY vec_id), j AS (SELECT CAST(e.label AS VARCHAR) AS target, prediction FROM embeddings e JOIN guesses USING (vec_id) WHERE e.label IS NOT NULL)
  SELECT target, count(*) AS n, round(avg((target = prediction)::INT), 6) AS recall FROM j GROUP BY target""")
def k11_zero_shot_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the zero-shot labels per label."""
    guesses = k10_zero_shot(spark, folder)
    rows = table(spark, folder, "embeddings").where("label IS NOT NULL").select("vec_id", F.col("label").cast("string").alias("target")).join(guesses, "vec_id")
    records = rows.select(F.col("vec_id").alias("pageid"), "target", "prediction", F.lit("ok").alias("parse_status"))
    counts = metrics.confusion_counts(records, [])
    labels = metrics.observed_labels(counts, predicted=False)
    return metrics.per_label(counts, [], labels).select(F.col("label").alias("target"), F.col("support").alias("n"), F.round("recall", 6).alias("recall"))


@query("SELECT text_source, place FROM (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(vocab.TEXT_SOURCES)) + ", ('another', " + str(len(vocab.TEXT_SOURCES)) + ")) v(text_source, place)")
def h2_source_order(spark: SparkSession, folder: str) -> DataFrame:
    """Places of text sources in reports; unknown ones come last."""
    from landweave.plans.jobs import source_order

    rows = spark.createDataFrame([(s,) for s in (*vocab.TEXT_SOURCES, "another")], "text_source string")
    return rows.select("text_source", source_order(F.col("text_source"))["place"].alias("place"))


@query(with_sql("articles") + "SELECT pageid, coalesce(nullif(trim(regexp_replace(title, '" + _WS + "+', ' ', 'g')), ''), pageid) AS name FROM articles")
def f4_coalesced(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, or page ids where there is none."""
    return inputs.articles(spark, folder).select("pageid", C.squeeze(F.coalesce(C.present(F.col("title")), C.present(F.col("pageid")))).alias("name"))


# ---- overlays on the plane ---------------------------------------------------------------------


def _clip_sql(keys: str) -> str:
    """``areas``: of every row of ``c0`` (``keys``, ring ``p``, counter-clockwise corners ``q``) the area of ``p`` within ``q``, by clipping edge by edge."""
    parts = []
    for e in range(1, 5):
        a, b = f"q[{e}]", f"q[{e % 4 + 1}]"
        before = "CASE WHEN i = 1 THEN len(p) ELSE i - 1 END"
        t = f"(s[{before}] / (s[{before}] - s[i]))"
        cut = f"struct_pack(x := p[{before}].x + {t} * (p[i].x - p[{before}].x), y := p[{before}].y + {t} * (p[i].y - p[{before}].y))"
        parts.append(f"s{e} AS (SELECT *, list_transform(p, lambda t: ({b}.x - {a}.x) * (t.y - {a}.y) - ({b}.y - {a}.y) * (t.x - {a}.x)) AS s FROM c{e - 1})")
        parts.append(f"c{e} AS (SELECT {keys}, q, flatten(list_transform(range(1, len(p) + 1), lambda i: list_concat(CASE WHEN (s[i] >= 0) <> (s[{before}] >= 0) THEN [{cut}] ELSE [] END, CASE WHEN s[i] >= 0 THEN [p[i]] ELSE [] END))) AS p FROM s{e})")
    turn = "p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y"
    return ", ".join(parts) + f", areas AS (SELECT {keys}, CASE WHEN len(p) < 3 THEN 0.0 ELSE abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: {turn}))) / 2 END AS area FROM c4)"


_QUADS = """, quads AS (SELECT xy.id, xy.code_18, CASE WHEN any_value(plane.a) >= 0 THEN list(struct_pack(x := px, y := py) ORDER BY i) FILTER (WHERE i <= 4) ELSE list(struct_pack(x := px, y := py) ORDER BY i DESC) FILTER (WHERE i <= 4) END AS q,
    min(px) AS minx, max(px) AS maxx, min(py) AS miny, max(py) AS maxy FROM xy JOIN plane ON xy.id = plane.id AND xy.code_18 = plane.code_18 GROUP BY xy.id, xy.code_18)"""


def _lcc_sql(source: str, keys: str, lon: str, lat: str) -> str:
    """``keys, x, y`` on the plane of a view's longitudes and latitudes."""
    t = f"pow((1 - {geo.LCC_E!r} * sin(radians({lat}))) / (1 + {geo.LCC_E!r} * sin(radians({lat}))), {geo.LCC_E / 2!r})"
    rho, theta = f"{geo.LCC_A * geo.LCC_C!r} * pow(tan(pi() / 4 - radians({lat}) / 2) / {t}, {geo.LCC_N!r})", f"{geo.LCC_N!r} * radians({lon} - 3.0)"
    return f"SELECT {keys}, 700000.0 + {rho} * sin({theta}) AS x, 6600000.0 + {geo.LCC_RHO0!r} - {rho} * cos({theta}) AS y FROM {source}"


@query(with_sql("articles", "corners").rstrip() + _PLANE + _QUADS + ", turns AS (SELECT * FROM (VALUES (1, -1, -1), (2, 1, -1), (3, 1, 1), (4, -1, 1)) v(k, sx, sy)), boxed AS (" + _lcc_sql("articles CROSS JOIN turns", "pageid, k", "(lon + sx * 0.005)", "(lat + sy * 0.005)") + """),
  rings AS (SELECT pageid, list(struct_pack(x := x, y := y) ORDER BY k) AS p, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM boxed GROUP BY pageid),
  c0 AS (SELECT r.pageid, c.code_18, list_transform(c.q, lambda t: struct_pack(x := t.x - r.x0, y := t.y - r.y0)) AS q, list_transform(r.p, lambda t: struct_pack(x := t.x - r.x0, y := t.y - r.y0)) AS p
    FROM rings r JOIN quads c ON r.x0 <= c.maxx AND r.x1 >= c.minx AND r.y0 <= c.maxy AND r.y1 >= c.miny), """ + _clip_sql("pageid, code_18") + """,
  sums AS (SELECT pageid, code_18, sum(area) AS area FROM areas WHERE area > 0 GROUP BY ALL)
  SELECT pageid, code_18, round(area / 10000, 2) AS hectares, round(area / sum(area) OVER (PARTITION BY pageid), 5) AS share FROM sums""")
def d5_shares_on_the_plane(spark: SparkSession, folder: str) -> DataFrame:
    """Hectares and share of each code in a box around every article."""
    rows = d5_landcover_around_articles(spark, folder)
    return rows.select("pageid", "code_18", F.round(F.col("area") / 10000, 2).alias("hectares"), F.round("share", 5).alias("share"))


_WHOLE = "(32 * sin(2 * pi() / 64))"


@query(with_sql("articles", "corners", "hits").rstrip() + _PLANE + _QUADS + """, own AS (SELECT pageid, min(left(code_18, 2)) AS point_label FROM hits WHERE code_18 IS NOT NULL GROUP BY pageid HAVING count(DISTINCT left(code_18, 2)) = 1),
  placed AS (""" + _lcc_sql("articles JOIN own USING (pageid)", "pageid, point_label", "lon", "lat") + """), spine AS (SELECT pageid, point_label, x, y, r AS radius FROM placed CROSS JOIN (VALUES (250), (500)) v(r)),
  c0 AS (SELECT s.pageid, s.radius, left(c.code_18, 2) AS label, list_transform(c.q, lambda t: struct_pack(x := t.x - s.x, y := t.y - s.y)) AS q, list_transform(range(0, 64), lambda k: struct_pack(x := s.radius * cos(2 * pi() * k / 64), y := s.radius * sin(2 * pi() * k / 64))) AS p
    FROM spine s JOIN quads c ON s.x - s.radius <= c.maxx AND s.x + s.radius >= c.minx AND s.y - s.radius <= c.maxy AND s.y + s.radius >= c.miny), """ + _clip_sql("pageid, radius, label") + f""",
  shares AS (SELECT pageid, radius, label, sum(area) / ({_WHOLE} * radius * radius) AS share FROM areas WHERE area > 0 GROUP BY pageid, radius, label),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY pageid, radius ORDER BY share DESC, label) AS rk, share / sum(share) OVER (PARTITION BY pageid, radius) AS part FROM shares),
  agg AS (SELECT pageid, radius, max(label) FILTER (WHERE rk = 1) AS dominant_label, max(share) AS dominant_share, count(*) AS num_labels, -sum(part * ln(part)) AS entropy, least(sum(share), 1) AS coverage_share, coalesce(sum(share) FILTER (WHERE label LIKE '1%'), 0) AS artificial_share FROM ranked GROUP BY ALL)
  SELECT s.pageid, s.radius, a.dominant_label, round(coalesce(a.dominant_share, 0), 5) AS dominant_share, round(coalesce((SELECT share FROM shares h WHERE h.pageid = s.pageid AND h.radius = s.radius AND h.label = s.point_label), 0), 5) AS point_label_share,
    coalesce(a.dominant_label = s.point_label, false) AS dominant_matches_point_label, coalesce(a.num_labels, 0) AS num_labels, round(coalesce(a.entropy, 0), 5) + 0 AS entropy, round(coalesce(a.coverage_share, 0), 5) AS coverage_share, round(coalesce(a.artificial_share, 0), 5) AS artificial_share
  FROM spine s LEFT JOIN agg a ON a.pageid = s.pageid AND a.radius = s.radius""")
def e16_confidence_by_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Spatial confidence of every place, one row for each radius."""
    rows = confidence_by_radius(spark, folder)
    number = lambda c: (F.round(c, 5) + 0.0).alias(c)
    return rows.select(
        "pageid", "radius", "dominant_label", number("dominant_share"), number("point_label_share"), "dominant_matches_point_label", F.col("num_labels").cast("long").alias("num_labels"),
        number("entropy"), number("coverage_share"), number("artificial_share"),
    )

"""Queries on texts and values: F1 to F43, A-loaders, K2 to K4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave import vocab
from landweave.functions import columns as C
from landweave.operators import artifacts
from landweave.operators.scale import evaluated
from landweave.plans import inputs
from landweave.plans.inputs import case_sql, with_sql
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


_WS = r"[\s\p{Z}\x1c-\x1f\x85]".replace(r"\x85", r"\x{85}")
_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'), ' ')"
_MATCH = lambda x: f"trim(replace(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), 'ß', 'ss'), ' ')"
_SENTENCES = lambda x: f"list_filter(string_split(regexp_replace({_SQUEEZE(x)}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_SUMMARIES = with_sql("evidence")


@query(with_sql("spatial") + "SELECT pageid, CASE WHEN lower(trim(dominant_matches_point_label_250m)) IN ('true','t','yes','y','oui','on','1','1.0') THEN 'true' WHEN lower(trim(dominant_matches_point_label_250m)) IN ('false','f','no','n','non','off','0','0.0') THEN 'false' ELSE 'unknown' END AS flag FROM spatial")
def f1_boolish(spark: SparkSession, folder: str) -> DataFrame:
    flag = C.boolish(F.col("dominant_matches_point_label_250m"))
    return inputs.spatial(spark, folder).select("pageid", F.when(flag, "true").when(~flag, "false").otherwise("unknown").alias("flag"))


@query(_SUMMARIES + "SELECT pageid, coalesce(evidence_sentences_count, 0) AS n_sentences, coalesce(landuse_evidence_summary_char_count, 0) AS n_chars FROM evidence")
def f3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.evidence(spark, folder).select("pageid", C.count_or_zero(F.col("evidence_sentences_count")).alias("n_sentences"), C.count_or_zero(F.col("landuse_evidence_summary_char_count")).alias("n_chars"))


@query(_SUMMARIES + "SELECT pageid, array_to_string(list_filter(list_transform(coalesce(evidence_types, []), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> ''), '|') AS types FROM evidence")
def f7_list_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Lists written as text with single quotes and read back."""
    written = F.concat(F.lit("['"), F.array_join("evidence_types", "', '"), F.lit("']"))
    rows = inputs.evidence(spark, folder).select("pageid", F.when(F.size("evidence_types") > 0, written).otherwise("[]").alias("written"))
    return rows.select("pageid", F.array_join(C.parse_list(F.col("written")), "|").alias("types"))


@query(_SUMMARIES + f"SELECT pageid, coalesce({case_sql('lower(trim(landcover_relevance))', vocab.RELEVANCE_NAMES)}, nullif(replace(lower(trim(landcover_relevance)), '_', ' '), ''), 'inconnue') AS relevance, coalesce(nullif(array_to_string(evidence_types, ', '), ''), 'aucun') AS types FROM evidence")
def f8_enum_names(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.evidence(spark, folder).select("pageid", C.named(F.col("landcover_relevance"), vocab.RELEVANCE_NAMES).alias("relevance"), C.joined(C.clean_list(F.col("evidence_types"))).alias("types"))


@query(with_sql("contents").rstrip() + f""", t AS (SELECT pageid, title || ' : ' || coalesce(content, '') AS text, trim(title) AS title FROM contents WHERE title IS NOT NULL)
  SELECT pageid, md5({_SQUEEZE("regexp_replace(regexp_replace(text, '(?i)' || regexp_escape(title), 'ce lieu', 'g'), '(?i)' || array_to_string(list_transform(list_filter(string_split_regex(title, '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '[^\\p{L}\\p{N}]+'), 'ce lieu', 'g')")}) AS digest FROM t""")
def f9_title_scrub(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.contents(spark, folder).where(F.col("title").isNotNull())
    text = F.concat(F.col("title"), F.lit(" : "), F.coalesce("content", F.lit("")))
    return rows.select("pageid", F.md5(C.scrub_title(text, F.col("title"))).alias("digest"))


@query(with_sql("spatial") + "SELECT pageid, coalesce(regexp_replace(printf('%.3f', point_label_share_250m), '\\.?0+$', ''), 'inconnue') AS share FROM spatial")
def f11_number_text(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.spatial(spark, folder).select("pageid", C.number_text(F.col("point_label_share_250m")).alias("share"))


@query(with_sql("contents").rstrip() + f", s AS (SELECT pageid, {_SENTENCES('content')} AS s FROM contents WHERE content IS NOT NULL) SELECT pageid, len(s) AS n, md5(array_to_string(s, chr(2))) AS digest FROM s")
def f14_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.contents(spark, folder).where(F.col("content").isNotNull()).select("pageid", C.sentences(F.col("content")).alias("s"))
    return rows.select("pageid", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\x02")).alias("digest"))


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    e = inputs.evidence(spark, folder).drop("title")
    return inputs.contents(spark, folder).join(e, "pageid", "left")


_FOLDED = with_sql("contents", "evidence").rstrip() + f""", s AS (SELECT c.pageid, unnest(list_zip(s, range(0, len(s)))) AS z, e.evidence_sentences_no_place AS ev, e.evidence_types AS ty, len(s) AS n
    FROM (SELECT pageid, {_SENTENCES("coalesce(content, '')")} AS s FROM contents) c LEFT JOIN evidence e USING (pageid)),
  f AS (SELECT pageid, z[2] AS i, {_MATCH("z[1]")} AS m, n, list_filter(list_transform(list_filter(coalesce(ev, []), lambda x: x IS NOT NULL AND trim(x) <> ''), lambda x: {_MATCH("x")}), lambda x: x <> '') AS ev, coalesce(ty, []) AS ty FROM s)"""
_KEYWORD_SQL = " OR ".join("(list_contains(ty, '" + k + "') AND (" + " OR ".join("contains(m, '" + w.replace("'", "''") + "')" for w in words) + "))" for k, words in vocab.EVIDENCE_KEYWORDS.items())


@query(_FOLDED + " SELECT pageid, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM f WHERE len(list_filter(ev, lambda x: contains(m, x) OR contains(x, m))) > 0 GROUP BY pageid")
def f16_evidence_match(spark: SparkSession, folder: str) -> DataFrame:
    at = artifacts.evidence_matches(C.sentences(F.col("content")), C.clean_list(F.col("evidence_sentences_no_place")))
    rows = _joined(spark, folder).select("pageid", at.alias("at")).where(F.size("at") > 0)
    return rows.select("pageid", F.array_join("at", ",").alias("positions"))


@query(_FOLDED + f" SELECT pageid, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM f WHERE {_KEYWORD_SQL} GROUP BY pageid")
def f17_keyword_match(spark: SparkSession, folder: str) -> DataFrame:
    at = artifacts.keyword_matches(C.sentences(F.col("content")), C.clean_list(F.col("evidence_types")))
    rows = _joined(spark, folder).select("pageid", at.alias("at")).where(F.size("at") > 0)
    return rows.select("pageid", F.array_join("at", ",").alias("positions"))


@query(_FOLDED + f""", h AS (SELECT pageid, i, n, len(list_filter(ev, lambda x: contains(m, x) OR contains(x, m))) > 0 AS e, ({_KEYWORD_SQL}) AS k FROM f),
  g AS (SELECT *, bool_or(e) OVER (PARTITION BY pageid) AS any_e, bool_or(k) OVER (PARTITION BY pageid) AS any_k FROM h),
  q AS (SELECT pageid, i, n, CASE WHEN any_e THEN e WHEN any_k THEN k ELSE false END AS hit, any_e OR any_k AS any_hit FROM g),
  w AS (SELECT *, max(hit) OVER (PARTITION BY pageid ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM q)
  SELECT pageid, n AS article_sentence_count, count(*) FILTER (WHERE hit) AS matched_evidence_sentence_count, CASE WHEN bool_or(any_hit) THEN count(*) FILTER (WHERE near) ELSE 1 END AS retrieved_sentence_count FROM w GROUP BY pageid, n""")
def f18_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = artifacts.retrieved_windows(_joined(spark, folder)).where("article_sentence_count > 0")
    return rows.select("pageid", *[F.col(c).cast("long").alias(c) for c in ("article_sentence_count", "matched_evidence_sentence_count", "retrieved_sentence_count")])


_TOKENS = lambda t: f"list_filter(string_split_regex({t}, '[^\\p{{L}}\\p{{N}}]+'), lambda z: z <> '')"


def _scrub_sql(text: str, title: str, *, always: bool) -> str:
    """``scrub_title`` of a text and a stripped title (never null)."""
    exact = f"CASE WHEN {title} <> '' THEN regexp_replace({text}, '(?i)' || regexp_escape({title}), 'ce lieu', 'g') ELSE {text} END"
    loose = f"regexp_replace({exact}, '(?i)' || array_to_string(list_transform({_TOKENS(title)}, lambda z: regexp_escape(z)), '[^\\p{{L}}\\p{{N}}]+'), 'ce lieu', 'g')"
    other = _SQUEEZE(exact) if always else exact
    return f"CASE WHEN len({_TOKENS(title)}) > 0 THEN {_SQUEEZE(loose)} ELSE {other} END"


_LIST_SQL = lambda head, cond, value="z": f"'{head}' || chr(10) || chr(10) || coalesce(string_agg('- ' || {value}, chr(10) ORDER BY i) FILTER (WHERE {cond}), '- Aucune phrase n''est disponible.')"


@query(_FOLDED.replace("SELECT pageid, z[2] AS i, ", "SELECT pageid, z[1] AS z, z[2] AS i, ") + f""", h AS (SELECT pageid, z, i, n, len(list_filter(ev, lambda x: contains(m, x) OR contains(x, m))) > 0 AS e, ({_KEYWORD_SQL}) AS k FROM f),
  g AS (SELECT *, bool_or(e) OVER (PARTITION BY pageid) AS any_e, bool_or(k) OVER (PARTITION BY pageid) AS any_k FROM h),
  q AS (SELECT pageid, z, i, n, CASE WHEN any_e THEN e WHEN any_k THEN k ELSE i = 0 END AS hit, any_e OR any_k AS any_hit FROM g),
  w AS (SELECT *, CASE WHEN any_hit THEN max(hit) OVER (PARTITION BY pageid ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE hit END AS near, row_number() OVER (PARTITION BY pageid ORDER BY md5('42:' || pageid || ':' || CAST(i AS VARCHAR)), i) AS rk FROM q),
  t AS (SELECT w.*, count(*) FILTER (WHERE near) OVER (PARTITION BY pageid) AS taken, {_scrub_sql("z", "title", always=True)} AS bare FROM w JOIN (SELECT pageid, {_SQUEEZE("coalesce(title, '')")} AS title FROM contents) c USING (pageid))
  SELECT pageid, md5({_LIST_SQL("Phrases brutes extraites de l''article.", "near")}) AS around, md5({_LIST_SQL("Phrases d''indice extraites de l''article.", "hit")}) AS only,
    md5({_LIST_SQL("Phrases brutes aléatoires extraites du même article.", "rk <= greatest(taken, 1)")}) AS random, md5({_LIST_SQL("Phrases brutes extraites de l''article, sans nom de lieu.", "near AND bare <> ''", "bare")}) AS placeless FROM t GROUP BY pageid""")
def f19_window_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the four texts of every article that has a sentence."""
    rows = artifacts.retrieved_windows(_joined(spark, folder)).where("article_sentence_count > 0")
    named = {"around": "retrieved_evidence_windows", "only": "retrieved_evidence_sentences_only", "random": "random_sentence_windows", "placeless": "retrieved_evidence_windows_no_place"}
    return rows.select("pageid", *[F.md5(c).alias(n) for n, c in named.items()])


@query()
def f19_window_texts(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts.retrieved_windows(_joined(spark, folder))


def _card_input(spark: SparkSession, folder: str) -> DataFrame:
    s = inputs.spatial(spark, folder).select("pageid", "point_label_share_250m", "point_label_share_500m", "dominant_matches_point_label_250m")
    q = inputs.quality(spark, folder).select("pageid", "primary_article_type", "quality_score", "quality_bin", "recommended_use")
    rows = _joined(spark, folder).join(s, "pageid", "left").join(q, "pageid", "left")
    return rows.withColumn("candidate_article_types", F.when(F.col("primary_article_type").isNotNull(), F.array("primary_article_type")))


def _named_sql(value: str, names: dict[str, str]) -> str:
    plain = _SQUEEZE(value)
    return f"coalesce({case_sql(f'lower({plain})', {k: v.replace(chr(39), chr(39) * 2) for k, v in names.items()})}, nullif(replace(lower({plain}), '_', ' '), ''), 'inconnue')"


_NUMBER_SQL = lambda c: f"coalesce(regexp_replace(printf('%.3f', {c}), '\\.?0+$', ''), 'inconnue')"
_WORDS_SQL = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_ITEMS_SQL = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda z: {_SQUEEZE('z')}), lambda z: z IS NOT NULL AND z <> '' AND lower(z) <> 'nan')"


@query(with_sql("contents", "evidence", "spatial", "quality").rstrip() + f""", j AS (SELECT c.pageid, {_SQUEEZE("coalesce(c.title, '')")} AS title, e.landcover_relevance AS r, e.uncertainty AS u, e.evidence_types AS ty, e.evidence_sentences_no_place AS s, e.landuse_evidence_summary AS m,
    q.primary_article_type AS k, q.quality_score AS sc, q.quality_bin AS b, q.recommended_use AS us, p.point_label_share_250m AS a, p.point_label_share_500m AS d, p.dominant_matches_point_label_250m AS dm
    FROM contents c LEFT JOIN evidence e USING (pageid) LEFT JOIN spatial p USING (pageid) LEFT JOIN quality q USING (pageid)),
  l AS (SELECT *, list_filter(list_transform({_ITEMS_SQL("s")}, lambda x: {_scrub_sql("x", "title", always=False)}), lambda x: x <> '') AS lines, trim(m, ' ') AS summary FROM j)
  SELECT pageid, md5(concat_ws(chr(10), 'Fiche d''indices d''occupation du sol, sans nom de lieu.', '', 'Pertinence: ' || {_named_sql("r", vocab.RELEVANCE_NAMES)}, 'Incertitude: ' || {_named_sql("u", vocab.UNCERTAINTY_NAMES)},
    'Types d''indices: ' || coalesce(nullif(array_to_string(list_transform({_ITEMS_SQL("ty")}, lambda x: {_named_sql("x", vocab.EVIDENCE_TYPE_NAMES)}), ', '), ''), 'aucun'), 'Type d''article: ' || {_named_sql("k", vocab.ARTICLE_TYPE_NAMES)},
    'Types d''article candidats: ' || CASE WHEN coalesce({_SQUEEZE("k")}, '') = '' THEN 'aucun' ELSE {_named_sql("k", vocab.ARTICLE_TYPE_NAMES)} END, 'Score de qualité: ' || coalesce(CAST(sc AS VARCHAR), 'inconnue'), 'Catégorie de qualité: ' || {_named_sql("b", vocab.QUALITY_BIN_NAMES)},
    'Catégorie d''usage recommandée: ' || {_named_sql("us", vocab.USE_NAMES)}, '', 'Confiance spatiale CORINE:', '- part du label ponctuel à 250 m: ' || {_NUMBER_SQL("a")}, '- part du label ponctuel à 500 m: ' || {_NUMBER_SQL("d")},
    '- le label dominant à 250 m correspond au label ponctuel: ' || CASE WHEN lower(trim(dm)) IN {_WORDS_SQL(vocab.TRUE_WORDS)} THEN 'oui' WHEN lower(trim(dm)) IN {_WORDS_SQL(vocab.FALSE_WORDS)} THEN 'non' ELSE 'inconnue' END, '', 'Indices factuels:',
    CASE WHEN len(lines) > 0 THEN array_to_string(list_transform(lines, lambda x: '- ' || x), chr(10)) ELSE '- Aucun indice factuel explicite n''a été extrait.' END, '', 'Résumé d''indices:',
    {_scrub_sql("coalesce(nullif(summary, ''), 'Aucun résumé d''indices n''est disponible.')", "title", always=False)})) AS digest FROM l""")
def f12_card_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the whole cards."""
    return artifacts.evidence_cards(_card_input(spark, folder)).select("pageid", F.md5("evidence_card").alias("digest"))


@query()
def f12_evidence_card(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts.evidence_cards(_card_input(spark, folder))


@query(with_sql("contents", "evidence", "spatial").rstrip() + """ SELECT c.pageid, 'Confiance spatiale CORINE:' || chr(10) || '- part du label ponctuel à 250 m: ' || coalesce(regexp_replace(printf('%.3f', s.point_label_share_250m), '\\.?0+$', ''), 'inconnue') AS line
  FROM contents c LEFT JOIN spatial s USING (pageid)""")
def f12_card_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = artifacts.evidence_cards(_card_input(spark, folder))
    line = F.regexp_extract("evidence_card", r"(Confiance spatiale CORINE:\n- part du label ponctuel à 250 m: [^\n]*)", 1)
    return rows.select("pageid", line.alias("line"))


@query(with_sql("contents", "evidence").rstrip() + f""" SELECT c.pageid, 'Pertinence des indices: ' || coalesce(nullif({_SQUEEZE("e.landcover_relevance")}, ''), 'inconnue') || chr(10) || 'Incertitude des indices: ' || coalesce(nullif({_SQUEEZE("e.uncertainty")}, ''), 'inconnue') AS head
  FROM contents c LEFT JOIN evidence e USING (pageid)""")
def f13_highlights(spark: SparkSession, folder: str) -> DataFrame:
    rows = artifacts.evidence_highlights(_joined(spark, folder))
    return rows.select("pageid", F.regexp_extract("evidence_highlights", r"(Pertinence des indices: [^\n]*\nIncertitude des indices: [^\n]*)", 1).alias("head"))


_PLAIN = lambda x: f"trim(regexp_replace(lower(strip_accents(replace({x}, '_', ' '))), '[^a-z0-9]+', ' ', 'g'), ' ')"


def _type_sql(column: str) -> str:
    parts = []
    for kind, rules in vocab.ARTICLE_TYPE_WORDS.items():
        pattern = "|".join(dict.fromkeys(C.word_pattern(r) for r in rules))
        parts.append(f"CASE WHEN regexp_matches({column}, '{pattern}') THEN '{kind}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@query(with_sql("contents").rstrip() + f", w AS (SELECT pageid, {_PLAIN('title')} AS w FROM contents WHERE title IS NOT NULL), t AS (SELECT pageid, {_type_sql('w')} AS t FROM w) SELECT pageid, CASE WHEN len(t) = 0 THEN 'other_or_unclear' ELSE t[1] END AS primary_type, CASE WHEN len(t) = 0 THEN 'other_or_unclear' ELSE array_to_string(t, ',') END AS candidates FROM t")
def f20_article_types(spark: SparkSession, folder: str) -> DataFrame:
    """Article types, with titles for categories."""
    rows = inputs.contents(spark, folder, ["title"]).where(F.col("title").isNotNull()).select("pageid", C.article_types(F.array(F.col("title"))).alias("t"))
    return rows.select("pageid", F.col("t")[0].alias("primary_type"), F.array_join("t", ",").alias("candidates"))


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """Raw model responses of many shapes, from predictions."""
    rows = inputs.records(spark, folder)
    p, kind = F.col("prediction"), F.pmod(F.col("row_idx"), F.lit(8))
    raw = (
        F.when(p.isNull(), "no idea").when(kind == 0, F.concat(F.lit('{"labels":["'), p, F.lit('"]}'))).when(kind == 1, F.concat(F.lit('{"label": "'), p, F.lit(', 99"}')))
        .when(kind == 2, F.concat(F.lit("I predict "), p, F.lit("."))).when(kind == 3, F.concat(F.lit('{"labels":["'), p, F.lit('", 32]}'))).when(kind == 4, F.concat(F.lit('["'), p, F.lit('"]')))
        .when(kind == 5, F.concat(F.lit('{"labels":["'), p, F.lit('", "51"]}'))).when(kind == 6, F.concat(F.lit("1"), p)).otherwise(F.concat(F.lit('{"label": "'), p, F.lit('"}')))
    )
    return rows.select("pageid", "model", "text_source", raw.alias("raw"))


_RAW_SQL = with_sql("records").rstrip() + """, raws AS (SELECT pageid, model, text_source, row_idx % 8 AS kind, prediction AS p, CASE WHEN prediction IS NULL THEN 'no idea' END AS bad FROM records),
  parsed AS (SELECT pageid, model, text_source, CASE WHEN bad IS NOT NULL THEN [] WHEN kind IN (4, 6) THEN [] WHEN kind = 5 THEN list_sort(list_distinct([p, '51'])) ELSE [p] END AS labels,
    CASE WHEN bad IS NOT NULL OR kind IN (4, 6) THEN 'No valid allowed labels found' WHEN kind = 1 THEN 'Unknown labels in JSON: 99' WHEN kind = 3 THEN 'JSON list fields must contain only strings' END AS error FROM raws)"""


@query(_RAW_SQL + " SELECT pageid, model, text_source, array_to_string(labels, ',') AS labels, error FROM parsed")
def f22_parse_response(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluated(_responses(spark, folder), {"parsed": C.parse_response(F.col("raw"), vocab.LEVEL2_LABELS)})
    return rows.select("pageid", "model", "text_source", F.array_join("parsed.labels", ",").alias("labels"), F.col("parsed.error").alias("error"))


@query(_RAW_SQL + " SELECT pageid, model, text_source, CASE WHEN error IS NULL AND len(labels) = 1 THEN labels[1] END AS prediction, CASE WHEN error IS NOT NULL THEN 'error' WHEN len(labels) > 1 THEN 'ambiguous' ELSE 'ok' END AS parse_status FROM parsed")
def f23_single_label_result(spark: SparkSession, folder: str) -> DataFrame:
    result = C.single_label_result(F.col("parsed"))
    return evaluated(_responses(spark, folder), {"parsed": C.parse_response(F.col("raw"), vocab.LEVEL2_LABELS)}).select("pageid", "model", "text_source", result["prediction"].alias("prediction"), result["parse_status"].alias("parse_status"))


@query(with_sql("records") + "SELECT pageid, model, text_source, CASE WHEN parse_status = 'ok' AND prediction NOT IN ('21','22','23','24','31','32') THEN 'unknown prediction labels: ' || prediction END AS problem FROM records")
def f24_validate_result(spark: SparkSession, folder: str) -> DataFrame:
    labels = F.when(F.col("prediction").isNotNull(), F.array("prediction"))
    return inputs.records(spark, folder).select("pageid", "model", "text_source", C.invalid_result(labels, F.col("parse_status"), vocab.LEVEL2_LABELS[:6], single=True).alias("problem"))


@query(with_sql("contents") + "SELECT pageid, sha256(coalesce(content, '')) AS text_sha256 FROM contents")
def f25_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.contents(spark, folder).select("pageid", C.text_digest(F.col("content")).alias("text_sha256"))


@query(with_sql("contents") + "SELECT pageid, CAST(CAST('0x' || left(sha256('42:' || pageid), 16) AS UBIGINT) AS VARCHAR) AS seed FROM contents")
def f37_stable_seed(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.contents(spark, folder, ()).select("pageid", C.stable_seed(F.lit(42), F.col("pageid")).cast("string").alias("seed"))


@query(_SUMMARIES + "SELECT '[\"' || array_to_string(list_sort(evidence_types), '\", \"') || '\"]' AS key, count(*) AS n FROM evidence WHERE len(evidence_types) > 0 GROUP BY 1")
def f28_target_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.evidence(spark, folder).where(F.size("evidence_types") > 0)
    return rows.groupBy(C.label_set_key(F.col("evidence_types")).alias("key")).agg(F.count("*").alias("n"))


@query(with_sql("contents") + "SELECT pageid, CASE WHEN contains(lower(content), 'forêt') THEN '31' ELSE '21' END AS prediction FROM contents WHERE length(trim(content)) > 0")
def k4_stub_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from landweave.operators.classify import keyword_label

    rows = inputs.contents(spark, folder).where(F.length(F.trim("content")) > 0)
    return rows.select("pageid", keyword_label(F.col("content"), "forêt", "31", "21").alias("prediction"))


@query(with_sql("contents") + "SELECT pageid, length('task: corine_level2' || chr(10) || 'text_source: content' || chr(10) || 'allowed_labels: [21, 31]' || chr(10) || 'text: ' || left(coalesce(content, ''), 24000)) AS n FROM contents")
def k3_prompt_length(spark: SparkSession, folder: str) -> DataFrame:
    from landweave.operators.classify import user_prompt

    prompt = user_prompt("corine_level2", "content", ["21", "31"], F.col("content"))
    return inputs.contents(spark, folder).select("pageid", F.length(prompt).cast("long").alias("n"))


@query(with_sql("contents").rstrip() + """, t AS (SELECT pageid, contains(lower(left(coalesce(content, ''), 24000)), 'forêt') AS wood FROM contents)
  SELECT pageid, CASE WHEN wood THEN '31' ELSE '21' END AS prediction, 'ok' AS parse_status, CASE WHEN wood THEN 1 ELSE 2 END AS attempts FROM t""")
def k2_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Classification with a retry: the stub answers woods at once and everything else only when asked again."""
    from landweave.operators.classify import classify

    def model(prompts: list[str]) -> list[str]:
        answers = []
        for p in prompts:
            wood = "forêt" in p.lower()
            answers.append('{"labels":["31"]}' if wood else '{"label":"21"}' if "Retry the classification." in p else "no idea")
        return answers

    texts = inputs.contents(spark, folder).select("pageid", F.col("content").alias("text"))
    rows = classify(texts, "corine_level2", "content", ["21", "31"], model, single=True)
    return rows.select("pageid", F.col("prediction")[0].alias("prediction"), "parse_status", "attempts")


@query("SELECT base, other FROM (VALUES " + ", ".join(f"('{b}', '{s}')" for b, s in vocab.SHUFFLED_OF.items()) + ") v(base, other)")
def f27_source_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(list(vocab.SHUFFLED_OF.items()), "base string, other string")


@query("SELECT pageid, array_to_string(list_filter(list_transform(string_split(label, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM image_probe_splits WHERE label IS NOT NULL AND pageid IS NOT NULL")
def f42_csv_strings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "image_probe_splits").where("label IS NOT NULL AND pageid IS NOT NULL")
    parts = F.filter(F.transform(F.split("label", ","), C.strip), lambda x: x != "")
    return rows.select("pageid", F.array_join(parts, "|").alias("parts"))

"""Payload checks, leaking names, text sources, shuffled controls, samples and scores of selections."""

import json

import pytest
from pyspark.sql import functions as F

from landweave.functions import payloads
from landweave.functions.columns import payload_categories
from landweave.operators import controls
from landweave.sources import fetch, texts
from landweave.streaming import resume

GOOD = {"landuse_evidence_summary": "Des prairies\\nhumides.", "landcover_relevance": "high", "evidence_types": ["pasture"], "evidence_sentences_no_place": ["Des  prés."], "uncertainty": "low"}


def evidence(spark, raw, title="Beville"):
    return spark.createDataFrame([(raw, title)], "raw string, title string").select(payloads.evidence_payload(F.col("raw"), F.col("title")).alias("p")).first().p


@pytest.mark.parametrize(
    "change, error",
    [
        ({}, None), ({"landuse_evidence_summary": " "}, "no summary"), ({"landuse_evidence_summary": 3}, "no summary"), ({"landuse_evidence_summary": "<think> a"}, "private markers"),
        ({"landcover_relevance": "huge"}, "invalid landcover_relevance"), ({"landcover_relevance": None}, "invalid landcover_relevance"), ({"uncertainty": "High"}, "invalid uncertainty"),
        ({"evidence_types": "pasture"}, "evidence_types is no list"), ({"evidence_types": ["pasture", 1]}, "invalid evidence_types"), ({"evidence_types": ["castle"]}, "invalid evidence_types"),
        ({"evidence_sentences_no_place": None}, "evidence_sentences_no_place is no list"), ({"evidence_sentences_no_place": ["a", 2]}, "evidence_sentences_no_place holds no text"),
        ({"evidence_sentences_no_place": ["Output matches it"]}, "private markers"), ({"landcover_relevance": "none"}, "evidence_types without relevance"),
        ({"landcover_relevance": "none", "evidence_types": []}, "evidence_sentences_no_place without relevance"),
        ({"landcover_relevance": "none", "evidence_types": [], "evidence_sentences_no_place": [], "landuse_evidence_summary": "x" * 241}, "long summary without relevance"),
        ({"evidence_sentences_no_place": ["Près de beville, des prés."]}, "place name"), ({"landuse_evidence_summary": "A Be-ville."}, None),
    ],
)
def test_evidence_payload(spark, change, error):
    p = evidence(spark, json.dumps(GOOD | change))
    assert p.error == error
    if error is None and not change:
        assert (p.landuse_evidence_summary, p.evidence_sentences_no_place, p.evidence_types) == ("Des prairies humides.", ["Des prés."], ["pasture"])
    if error:
        assert p.landuse_evidence_summary is None and p.evidence_types is None


def test_evidence_payload_of_no_object(spark):
    assert evidence(spark, "no JSON").error == "no valid JSON" and evidence(spark, None).error == "no valid JSON" and evidence(spark, "").error == "no valid JSON"
    assert evidence(spark, "[1]").error == "no JSON object"
    less = {k: v for k, v in GOOD.items() if k not in ("uncertainty", "evidence_types")}
    assert evidence(spark, json.dumps(less)).error == "missing fields: ['evidence_types', 'uncertainty']"
    assert evidence(spark, json.dumps(GOOD | {"b": 1, "a": 2})).error == "unexpected fields: ['a', 'b']"
    assert evidence(spark, json.dumps(GOOD), None).error is None


@pytest.mark.parametrize(
    "text, title, leaks",
    [
        ("La mairie de Saint-Jean.", "Saint Jean", True), ("saint_jean!", "Saint-Jean", True), ("saintjean", "Saint-Jean", True), ("assaintjeanne", "Saint-Jean", True), ("assaintjean", "Saint Jan", False),
        ("Un pré", "Pré", True), ("Des prés", "Pré", False), ("L'Île d’Or", "île d'or", True), ("a", "", False), ("a", None, False), (None, "a", False), ("x", "...", False), ("C++ (site)", "C++ (site)", True), ("a\\Eb", "\\E", False),
    ],
)
def test_title_leaks(spark, text, title, leaks):
    df = spark.createDataFrame([(text, title)], "text string, title string")
    assert df.select(payloads.title_leaks(F.col("text"), F.col("title")).alias("x")).first().x is leaks


def test_summary_payload_and_private_fields(spark):
    raws = ['{"summary": " a "}', '{"summary": ""}', '{"summary": 1}', '{"summary": "a", "note": 1}', "[]", "x", None, '{"summary": "</think> a"}']
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", payloads.summary_payload(F.col("raw")).alias("p")).orderBy("i").collect()
    assert [r.p.error for r in rows] == [None, "no summary", "no summary", "unexpected fields: ['note']", "no JSON object", "no valid JSON", "no valid JSON", "private markers"] and rows[0].p.summary == "a"
    deep = '{"a": [{"thinking": 1, "b": {"thinking": [2], "é": null}}], "thinking": "x"}'
    rows = spark.createDataFrame([(0, deep), (1, "thinking"), (2, None)], "i int, raw string").select("i", payloads.without_private_fields("raw").alias("raw")).orderBy("i").collect()
    assert json.loads(rows[0].raw) == {"a": [{"b": {"é": None}}]} and rows[1].raw == "thinking" and rows[2].raw is None


def test_repair_and_prompts(spark):
    df = spark.createDataFrame([("A Beville, des prés.", "Beville", "no_place"), ("A Beville.", "Beville", "place"), ("A Beville.", "Beville", None), (None, "Beville", "no_place")], "s string, t string, m string")
    assert [r.x for r in df.select(payloads.repaired_summary(F.col("s"), F.col("t"), F.col("m")).alias("x")).collect()] == ["A ce lieu, des prés.", "A Beville.", "A Beville.", None]
    prompt = df.select(payloads.evidence_retry(payloads.evidence_prompt(F.col("t"), F.col("s"))).alias("x")).first().x
    assert prompt.startswith("Titre à ne jamais mentionner : Beville") and "habitat_or_ecology" in prompt and "A Beville, des prés." in prompt


def test_categories(spark):
    payload = '{"categories": ["a", {"title": "b"}, {"title": 3}, 4, null, {"ns": 1}]}'
    df = spark.createDataFrame([(payload,), ("{}",), (None,), ('{"categories": "a"}',)], "p string")
    assert [r.c for r in df.select(payload_categories(F.col("p")).alias("c")).collect()] == [["a", "b"], [], [], []]


# ---- text sources ----


def test_text_sources(spark):
    contents = spark.createDataFrame([("1", "a"), ("2", None), (None, "x")], "pageid string, content string")
    windows = spark.createDataFrame([("1", "w")], "pageid string, random_sentence_windows string")
    tables = {"contents": contents, "windows": windows}
    assert {(r.pageid, r.text) for r in texts.text_source("content_shuffled", tables).collect()} == {("1", "a"), ("2", "")}
    assert texts.text_source("random_sentence_windows", tables).first().text == "w"
    with pytest.raises(ValueError, match="unknown"):
        texts.text_source("poem", tables)
    with pytest.raises(ValueError, match="cards"):
        texts.text_source("evidence_card", tables)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_shuffled_among_is_a_derangement(spark, n):
    rows = spark.range(n).select(F.col("id").cast("string").alias("pageid"), F.lit("x").alias("rank"))
    found = {r.pageid: r.shuffled_from for r in controls.shuffled_among(rows.drop("rank"), "pageid", 5).collect()}
    assert sorted(found) == sorted(found.values()) == sorted(map(str, range(n)))
    assert n < 2 or all(k != v for k, v in found.items())
    assert n < 100 or found != {r.pageid: r.shuffled_from for r in controls.shuffled_among(rows.drop("rank"), "pageid", 6).collect()}


def test_records_of_shuffled_texts(spark):
    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(6)], "pageid string, text string").withColumn("order", F.col("pageid").cast("int"))
    targets = spark.createDataFrame([(str(i), "31") for i in range(1, 6)], "pageid string, target string")
    given = texts.classified_texts("content_shuffled", rows, targets, limit=4, order="order")
    found = {r.pageid: r for r in given.collect()}
    assert set(found) == {"1", "2", "3", "4"} and all(r.text == f"text {r.shuffled_from}" and r.shuffled_from != r.pageid for r in found.values())
    made = texts.prediction_records(given.withColumn("metadata", F.create_map(F.lit("fingerprint"), F.lit("old"), F.lit("kept"), F.lit("yes"))), "content_shuffled", "new")
    m = made.first()
    assert m.metadata["fingerprint"] == "new" and m.metadata["kept"] == "yes" and m.metadata["text_control"] == "shuffled" and m.metadata["base_text_source"] == "content" and "text" not in made.columns
    plain = texts.prediction_records(texts.classified_texts("content", rows, targets), "content", "f")
    assert set(plain.first().metadata) == {"fingerprint", "text_sha256"}


# ---- samples ----


def test_samples(spark):
    universe = spark.createDataFrame([(str(i), "31" if i % 3 else "21") for i in range(90)] + [(None, "31")], "pageid string, target string")
    same = {r.pageid for r in controls.same_size_sample(universe, "pageid", 20, 3).collect()}
    assert len(same) == 20 and same == {r.pageid for r in controls.same_size_sample(universe.repartition(3), "pageid", 20, 3).collect()}
    assert controls.same_size_sample(universe, "pageid", 91, 3).count() == 0 and controls.same_size_sample(universe.limit(0), "pageid", 1, 3).count() == 0
    observed = universe.where("cast(pageid as int) < 12").unionByName(spark.createDataFrame([("x", None)], universe.schema))
    drawn = controls.same_targets_sample(universe, observed, "pageid", "target", 3)
    assert {(r.target, r["count"]) for r in drawn.groupBy("target").count().collect()} == {("31", 8), ("21", 4)}
    rare = observed.unionByName(spark.createDataFrame([("y", "99")], universe.schema))
    assert controls.same_targets_sample(universe, rare, "pageid", "target", 3).count() == 0


def test_scores_of_selections(spark):
    rows = [("1", ["a"], ["a"], "ok"), ("2", ["a", "b"], ["a"], "ok"), ("3", ["a"], ["a"], "error"), ("4", [], None, "ok"), ("5", ["z"], ["z"], "ok")]
    records = spark.createDataFrame(rows, "pageid string, target array<string>, prediction array<string>, parse_status string")
    members = spark.createDataFrame([("s", str(i)) for i in range(1, 5)] + [("t", "5"), ("t", "99")], "subset string, pageid string")
    assert {r.subset: (r.n, r.score) for r in controls.selection_scores(records, members, ["subset"], None).collect()} == {"s": (4, (1 + 0.5 + 0 + 1) / 4), "t": (1, 1.0)}
    single = records.select("pageid", F.try_element_at("target", F.lit(1)).alias("target"), F.try_element_at("prediction", F.lit(1)).alias("prediction"), "parse_status")
    assert {r.subset: r.score for r in controls.selection_scores(single, members, ["subset"], ["a", "b"]).collect()} == {"s": 0.5, "t": 0.0}


# ---- records that are current ----


def test_current_records(spark):
    meta = [("a", {"summary_mode": "no_place"}), ("a", {"summary_mode": "place"}), (None, {"summary_mode": "no_place"}), ("a", None), ("a", {"prompt": f"x {resume.NO_PLACE_PROMPT} y"}), ("a", {"prompt": "x"})]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(meta)], "i int, s string, m map<string,string>").orderBy("i")
    assert [r.x for r in df.select("i", resume.summary_is_current(F.col("s"), F.col("m"), "no_place").alias("x")).orderBy("i").collect()] == [True, False, False, False, True, False]
    assert [r.x for r in df.select("i", resume.summary_is_current(F.col("s"), F.col("m"), "place").alias("x")).orderBy("i").collect()] == [False, True, False, False, False, True]
    fields = "title string, landuse_evidence_summary string, landcover_relevance string, evidence_types array<string>, evidence_sentences_no_place array<string>, uncertainty string, landuse_evidence_summary_char_count string, evidence_sentences_count string, pageid string, m map<string,string>"
    good = ("Beville", "Des prés.", "high", ["pasture"], ["Des prés."], "low", "9", "1")
    rows = [(*good, "1", {"seed": "42"}), (*good, "2", {"seed": "7"}), (*good[:6], "8", "1", "3", {"seed": "42"}), (*good[:6], "x", "1", "4", {"seed": "42"}), (*good[:7], None, "5", {"seed": "42"}), ("Prés", *good[1:], "6", {"seed": "42"}), (*good, "7", None), (*good, "9", {"seed": "42"})]
    records = spark.createDataFrame(rows, fields)
    current = resume.evidence_is_current(F.col("title"), {"seed": "42"}, F.col("m"))
    inputs = spark.createDataFrame([(str(i),) for i in (1, 2, 3, 4, 5, 6, 7, 8, 8)] + [(None,)], "pageid string")
    kept, wanted = resume.resumed(records, inputs, current)
    assert {r.pageid for r in kept.collect()} == {"1", "9"} and sorted(r.pageid for r in wanted.collect()) == ["2", "3", "4", "5", "6", "7", "8"]
    assert set(kept.columns) == set(records.columns)


def test_simple_rings(spark):
    rings = [
        [(0, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], [(0, 0), (1, 0), (2, 0), (0, 0)], [(0, 0), (1, 0), (0, 0)], [(0, 0), (1, 0), (1, 1), (0, 1)], None, [],
        [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)],
    ]
    rows = [(i, r if r is None else [(float(a), float(b)) for a, b in r]) for i, r in enumerate(rings)]
    df = spark.createDataFrame(rows, "i int, points array<struct<lon:double,lat:double>>")
    assert [r.x for r in df.select("i", fetch.simple_ring(F.col("points")).alias("x")).orderBy("i").collect()] == [True, False, False, False, False, False, False, True]


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    inputs = spark.createDataFrame([(str(i), f"t{i}") for i in range(60)] + [(None, "x")], "pageid string, text string").withColumn("batch", F.lit("clash"))
    calls = []

    def compute(rows):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("stopped")
        return rows.select("pageid", F.upper("text").alias("label"))

    with pytest.raises(RuntimeError):
        resume.run_in_batches(inputs, compute, f"file://{tmp_path}/run", batches=6)
    found = resume.run_in_batches(inputs, compute, f"file://{tmp_path}/run", batches=6)
    assert len(calls) == 7 and {(r.pageid, r.label) for r in found.collect()} == {(str(i), f"T{i}") for i in range(60)} and found.count() == 60
    again = resume.run_in_batches(inputs, compute, f"file://{tmp_path}/run", batches=6)
    assert len(calls) == 7 and again.count() == 60

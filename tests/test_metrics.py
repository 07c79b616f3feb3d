"""Metrics, subsets and differences, with hand-computed values."""

import pytest
from pyspark.sql import functions as F

from landweave import vocab
from landweave.operators import metrics, reports, subsets

SINGLE = "pageid long, target string, prediction string, parse_status string"


def single(spark, rows, labels, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SINGLE)
    return metrics.single_label(metrics.confusion_counts(df, [], **options), [], labels).first(), metrics.per_label(metrics.confusion_counts(df, [], **options), [], labels)


def test_single_label(spark):
    row, per = single(spark, [("31", "31", "ok"), ("21", "31", "ok"), ("31", "31", "error"), ("31", "21", "error")], ["21", "31"])
    expected = dict(n=4, n_predicted_ok=2, n_parse_error=2, coverage=0.5, accuracy=0.5, accuracy_errors_wrong=0.25, balanced_accuracy=0.5, balanced_accuracy_errors_wrong=1 / 6, macro_precision=0.25, macro_f1=1 / 3, macro_f1_errors_wrong=0.2, weighted_precision=0.375, weighted_recall=0.75, weighted_f1=0.5, majority_label="31", majority_accuracy=0.75, majority_balanced_accuracy=0.5, majority_macro_f1=0.428571)
    for name, value in expected.items():
        assert row[name] == (pytest.approx(value, abs=1e-6) if isinstance(value, float) else value), name
    by = {r.label: r for r in per.collect()}
    assert (by["21"].support, by["21"].precision, by["21"].recall, by["21"].f1) == (1, 0, 0, 0)
    assert (by["31"].support, by["31"].precision, by["31"].recall) == (3, 0.5, 1.0) and by["31"].f1 == pytest.approx(2 / 3)


def test_labels_outside_the_universe_and_null_targets(spark):
    row, per = single(spark, [(None, "31", "ok"), ("99", "31", "ok"), ("31", None, "ok"), ("31", "31", None)], ["31", "21"])
    assert (row.n, row.n_predicted_ok, row.accuracy) == (3, 1, 0.0)
    assert {r.label: (r.support, r.fp) for r in per.collect()} == {"31": (2, 1), "21": (0, 0)}
    kept, _ = single(spark, [(None, "31", "ok")], ["31"], keep_null_target=True)
    assert kept.n == 1 and kept.majority_label == "None"
    text, _ = single(spark, [("31", None, "ok")], ["31"], keep_null_prediction=True)
    assert text.n_predicted_ok == 1


def test_majority_tie_goes_to_the_first_record(spark):
    row, _ = single(spark, [("31", "31", "ok"), ("21", "21", "ok"), ("21", "21", "ok"), ("31", "31", "ok")], ["21", "31"])
    assert row.majority_label == "31"


def test_no_rows(spark):
    df = spark.createDataFrame([], SINGLE).withColumn("model", F.lit("m"))
    counts = metrics.confusion_counts(df, ["model"])
    assert metrics.single_label(counts, ["model"], ["31"]).count() == metrics.supported(counts, ["model"], ["31"]).count() == 0


MULTI = "pageid long, target array<string>, prediction array<string>, parse_status string"
MULTI_ROWS = [(1, ["wood"], ["wood"], "ok"), (2, ["water"], ["water", "wood"], "ok"), (3, ["wood"], None, "error"), (4, ["urban", "water"], None, "error")]


def test_multi_label_variants(spark):
    df = spark.createDataFrame(MULTI_ROWS, MULTI)
    labels = ["wood", "water", "urban"]
    row = metrics.multi_label(df, [], labels).first()
    assert (row.n, row.n_predicted_ok, row.exact_match, row.exact_match_errors_empty) == (4, 2, 0.5, 0.25)
    assert row.micro_precision == pytest.approx(2 / 3) and row.micro_recall == 1.0 and row.micro_f1 == pytest.approx(0.8)
    assert row.jaccard == pytest.approx((1 + 0.5 + 0 + 0) / 4) and row.hamming_loss == pytest.approx(4 / 12)
    assert metrics.multi_label(df, [], labels, hamming_by_predicted=True).first().hamming_loss == pytest.approx(4 / 6)
    assert metrics.multi_label(df, [], labels, derived_over_parsed=True).first().jaccard == pytest.approx(0.75)
    assert row.majority_set == '["wood"]' and row.majority_exact_match == 0.5 and row.empty_exact_match == 0.0
    empty = metrics.multi_label(spark.createDataFrame([(1, [], [], "ok")], MULTI), [], labels).first()
    assert empty.jaccard == 1.0 and empty.exact_match == 1.0


def test_supported(spark):
    df = spark.createDataFrame([(1, "21", "21", "ok"), (2, "21", "33", "ok"), (3, "22", "33", "ok")], SINGLE)
    row = metrics.supported(metrics.confusion_counts(df, []), [], ["21", "22", "33"]).first()
    assert (row.balanced_accuracy_supported, row.macro_precision_supported) == (0.25, 0.5)
    assert row.balanced_accuracy_allowed == pytest.approx(1 / 6) and row.macro_f1_supported == pytest.approx(1 / 3) and row.macro_f1_allowed == pytest.approx(2 / 9)


def test_confusion_matrix_and_agreement(spark):
    df = spark.createDataFrame([(1, "21", "21", "ok"), (2, "21", "31", "ok"), (3, "31", "99", "ok")], SINGLE)
    rows = {r.target: (r.pred_21, r.pred_31) for r in metrics.confusion_matrix(metrics.confusion_counts(df, []), [], ["21", "31"]).collect()}
    assert rows == {"21": (1, 1), "31": (0, 0)}
    rows = [(1, "a", "21", "21"), (1, "b", "21", "21"), (2, "a", "31", "21"), (2, "b", "31", "21"), (3, "a", "31", "31")]
    rows = [(*r, "ok", 1) for r in rows] + [
        (1, "a", "21", "99", "ok", 2),  # not the first
        (2, "b", "31", "99", "error", 0),  # not ok
        (4, "a", None, "21", "ok", 1), (5, "b", "21", None, "ok", 1), (6, "c", "21", "21", "ok", 1),
    ]
    both = spark.createDataFrame(rows, "pageid long, model string, target string, prediction string, parse_status string, row_idx int")
    row = metrics.model_agreement(both, [], ("a", "b")).first()
    assert (row.n, row.n_agree, row.agreed_precision) == (3, 2, 0.5) and row.agreement_rate == pytest.approx(2 / 3)


def test_differences(spark):
    table = spark.createDataFrame([("m", "content", 0.5), ("m", "content_shuffled", 0.2), ("n", "content", 0.4)], "model string, text_source string, v double")
    pairs = spark.createDataFrame(list(vocab.SHUFFLED_OF.items()), "base string, other string")
    assert [(r.model, r.base, round(r.delta_v, 6)) for r in metrics.paired_deltas(table, ["model"], "text_source", pairs, ["v"]).collect()] == [("m", "content", 0.3)]
    assert [(r.model_a, r.model_b, round(r.delta_v, 6)) for r in metrics.first_two_models(table, ["text_source"], ["v"]).collect()] == [("m", "n", 0.1)]


def test_subsets_count_unknown_as_out(spark):
    schema = "pageid string, landcover_relevance string, uncertainty string, evidence_sentences_count int, point_label_share_250m double, quality_bin string, recommended_use string, primary_article_type string, dominant_matches_point_label_250m string, point_label_share_500m double, dominant_matches_point_label_500m string, evidence_types array<string>"
    rows = [("1", "High ", "low", 2, 0.9, "quality_high", "exclude", "water_feature", "oui", 0.8, "0", ["water"]), ("2", None, None, None, None, None, None, None, None, None, None, None), ("3", "medium", "high", 1, float("nan"), "x", "y", "other_or_unclear", "maybe", 0.1, "1", [])]
    df = spark.createDataFrame(rows, schema)
    named = {n: c for n, (_, c) in subsets.registry().items()} | subsets.evidence_type_subsets()
    members = {}
    for r in subsets.expand(df, named).select("subset", "pageid").collect():
        members.setdefault(r.subset, set()).add(r.pageid)
    assert members["all"] == {"1", "2", "3"} and members["relevance_medium_high"] == {"1", "3"} and members[subsets.SPATIAL] == {"1"}
    assert members["dominant_matches_point_label_250m"] == {"1"} and members["dominant_matches_point_label_500m"] == {"3"} and members["evidence_type_water"] == {"1"}
    assert members["other_or_unclear_and_relevance_medium_high"] == {"3"} and "quality_very_high" not in members
    assert len(subsets.registry()) == 32 and len(subsets.relevance_subsets()) == 14 and len(subsets.relevance_and_spatial_subsets()) == 11


def test_class_count_summary(spark):
    rows = [("a", "311"), ("b", "112"), ("b", "321"), ("c", "211"), ("c", "212"), ("d", "111")]
    df = spark.createDataFrame(rows, "osm_id string, class_label string")
    assert [tuple(r) for r in reports.class_count_summary(df, "osm_id").orderBy("n_classes").collect()] == [(1, 2, 50.0), (2, 2, 50.0)]
    assert [tuple(r) for r in reports.class_count_summary(df.where("osm_id <> 'd'"), "osm_id").orderBy("n_classes").collect()] == [(1, 1, 33.33), (2, 2, 66.67)]


def test_control_summary(spark):
    df = spark.createDataFrame([(v, 0.5) for v in (0.1, 0.2, 0.5, 0.7)], "score double, observed double")
    row = reports.draw_summary(df, [], "score", "observed").first()
    assert row.mean == pytest.approx(0.375) and row.percentile == 75 and row.p_value == pytest.approx(0.6)


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z")], "k string, i int, v string")
    assert [r.v for r in reports.first_wins(df, "k", "i").collect()] == ["y"] and [r.v for r in reports.last_wins(df, "k", "i").collect()] == ["x"]

"""Quality, weights, splits, controls, probes, resumable batches, classification."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.operators import classify, controls, probe, quality
from landweave.streaming import resume


def score(spark, relevance, uncertainty, share, count, kind):
    df = spark.createDataFrame([(relevance, uncertainty, share, count, kind)], "landcover_relevance string, uncertainty string, point_label_share_250m double, evidence_sentences_count int, primary_article_type string")
    return quality.with_quality_score(df).first()


def test_quality_score(spark):
    r = score(spark, "unknown", "unknown", None, None, None)
    assert (r.relevance_score, r.spatial_score, r.evidence_density_score, r.article_type_score, r.uncertainty_penalty, r.quality_score, r.quality_bin) == (0, 0, 0, 0, 1, -1, "quality_low")
    r = score(spark, " High", "low", 0.95, 2, "natural_landscape")
    assert r.quality_score == pytest.approx(3 + 2.85 + 2 + 2) and r.quality_bin == "quality_very_high"
    edges = spark.createDataFrame([(v,) for v in (2.999, 3.0, 4.999, 5.0, 6.999, 7.0, None)], "v double").select(quality.quality_bin(F.col("v")).alias("b"))
    assert [r.b for r in edges.collect()] == ["quality_low", "quality_medium", "quality_medium", "quality_high", "quality_high", "quality_very_high", None]


def test_weights(spark):
    schema = "pageid string, label string, landcover_relevance string, uncertainty string, point_label_share_250m double, prediction_a string, prediction_b string"
    df = spark.createDataFrame([("1", "31", "high", "low", 0.9, "31", "31"), ("2", "21", "low", "high", None, "31", "31"), ("3", "21", None, None, 2.0, None, None)], schema)
    rows = {r.pageid: r for r in quality.with_weights(df).collect()}
    raw = [1.25 * 1 * 0.9 * 1.25, 0.6 * 0.4 * 0.2 * 0.75, 0.5 * 0.75 * 1.0 * 0.75]
    assert [rows[k].weight_raw for k in "123"] == pytest.approx([x / np.mean(raw) for x in raw])
    assert np.mean([r.weight_class_balanced for r in rows.values()]) == pytest.approx(1.0)


def test_folds_and_splits(spark):
    groups = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", 1), (None, 9)], "g string, n int")
    assert {r.g: r.fold for r in quality.group_folds(groups, "g", "n", 2).collect()} == {"a": 0, "b": 1, "c": 0, "d": 1}
    rows = [(str(i), "31" if i % 2 else "21", "high", "low", 0.9, "quality_high", "oui", "31", "31", f"{i % 7}_0") for i in range(60)]
    df = spark.createDataFrame(rows, "pageid string, label string, landcover_relevance string, uncertainty string, point_label_share_250m double, quality_bin string, dominant_matches_point_label_250m string, prediction_a string, prediction_b string, geo_group_20km string")
    out = quality.probe_splits(df, per_class=2, repeats=3, folds=3).collect()
    by = {}
    for r in out:
        by.setdefault((r.split, r.tier), set()).add(r.pageid)
    assert len(by["eval_strict", "eval_strict"]) == 4 and all(len(by[f"repeated_eval_seed_{i}", "eval_repeated"]) == 4 for i in range(3))
    assert sum(len(by[f"spatial_block_fold_{i}", "eval_spatial_block"]) for i in range(3)) == 60
    for (split, tier), pages in by.items():
        if split.startswith("train_for_"):
            held = set().union(*[p for (s, _), p in by.items() if s == split[len("train_for_") :]])
            assert not pages & held
    assert by["train", "all"] == {str(i) for i in range(60)} - by["eval_strict", "eval_strict"]
    assert by["train", "text_spatial_agreement"] <= {str(i) for i in range(60) if i % 2}


def test_rotation(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("i")).withColumn("v", F.concat(F.lit("t"), "i"))
    rows = {r.i: r.control for r in controls.rotated(df, "i", "v").collect()}
    assert rows == {i: f"t{(i + 1) % 1000}" for i in range(1000)}
    assert controls.rotated(df.limit(0), "i", "v").count() == 0


def test_monte_carlo(spark):
    rng = np.random.default_rng(3)
    rows = [("m", str(i), "31" if i % 2 else "21", "31" if rng.random() < (0.9 if i < 60 else 0.3) == (i % 2 == 1) else "21") for i in range(300)]
    universe = spark.createDataFrame(rows, "model string, pageid string, target string, prediction string")
    members = universe.where("cast(pageid as int) < 60").select("model", F.lit("easy").alias("subset"), "pageid")
    drawn = controls.monte_carlo(members, universe, ["model"], ["21", "31"], draws=500, seed=1)
    table = drawn.toPandas()
    assert set(table.control) == {"same_n", "same_targets"} and len(table) == 1000 and (table.n == 60).all()
    easy = [(t, p) for _, i, t, p in rows if int(i) < 60]
    observed = np.mean([np.mean([p == t for t, p in easy if t == x]) for x in ("21", "31")])
    assert table.observed.iloc[0] == pytest.approx(observed)
    whole = np.mean([np.mean([p == t for _, _, t, p in rows if t == x]) for x in ("21", "31")])
    assert table.score.mean() == pytest.approx(whole, abs=0.02)
    again = controls.monte_carlo(members, universe, ["model"], ["21", "31"], draws=500, seed=1).toPandas()
    assert sorted(again.score) == sorted(table.score)


def test_bootstrap(spark):
    counts = spark.createDataFrame([("m", "21", "21", 40), ("m", "21", "31", 10), ("m", "31", "31", 30), ("m", "31", "21", 20)], "model string, target string, prediction string, n long")
    row = controls.bootstrap_intervals(counts, ["model"], ["21", "31"]).first()
    assert 0.55 < row.low < 0.7 < row.high < 0.82


def test_probe(spark):
    x = np.array([[-2.0, 0.1], [-1.5, -0.1], [1.5, 0.2], [2.0, -0.2]])
    y = ["21", "21", "31", "31"]
    model = probe.fit_probe(x, y)
    assert list(model.predict(np.array([[-1.0, 0.0], [1.0, 0.0]]))) == ["21", "31"]
    weighted = probe.fit_probe(x, y, weights=np.full(4, 3.0))
    assert np.allclose(model.weights, weighted.weights)
    constant = probe.fit_probe(np.c_[x, np.ones(4)], y)
    assert constant.scale[2] == 1.0
    with pytest.raises(ValueError):
        probe.fit_probe(x, ["21"] * 4)
    rows = [(i, [float(v) for v in v_], l) for i, (v_, l) in enumerate(zip(x.tolist() * 3, y * 3))] + [(99, None, "21"), (98, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "key long, embedding array<double>, label string")
    spread = probe.fit_probe_distributed(df, "label", epochs=200, rate=0.1)
    assert np.allclose(spread.weights, model.weights, atol=1e-6) and np.allclose(spread.bias, model.bias, atol=1e-6)
    guesses = probe.predict_probe(df, spread).collect()
    assert all(r.prediction == r.label for r in guesses if r.key < 90) and next(r.prediction for r in guesses if r.key == 99) is None


@pytest.mark.parametrize("gather", [0, probe.GATHER])
def test_probe_grid(spark, gather):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (60, 3))
    y = np.where(x[:, 0] + 0.5 * rng.normal(0, 1, 60) > 0, "21", "31")
    w = rng.uniform(0.1, 3, 60)
    rows = spark.createDataFrame([(str(i), y[i], x[i].tolist(), float(w[i])) for i in range(60)], "key string, label string, embedding array<double>, weight double")
    fold = [(str(i), f"fold_{i % 2}", "eval") for i in range(60)]
    train = [(str(i), f"train_for_fold_{1 - i % 2}", t) for i in range(60) for t in (["all", "few"] if i < 40 else ["all"])]
    members = spark.createDataFrame(fold + train + [("1", "train", "all"), ("99", "fold_0", "eval")], "key string, split string, tier string")
    policies = {"plain": ("all", F.lit(1.0)), "weighted": ("all", F.col("weight")), "hard": ("few", F.lit(1.0)), "empty": ("none", F.lit(1.0))}
    found = {(r.policy, r.split, r.l2, r.key): r.prediction for r in probe.probe_grid(rows, members, policies, (1e-4, 0.5), epochs=15, gather=gather).collect()}
    expected = {}
    for policy, most, weights in (("plain", 60, None), ("weighted", 60, w), ("hard", 40, None)):
        for k in (0, 1):
            own = [i for i in range(most) if i % 2 != k]
            for l2 in (1e-4, 0.5):
                model = probe.fit_probe(x[own], y[own], weights=None if weights is None else weights[own], seed=42, epochs=15, rate=0.1, l2=l2)
                expected |= {(policy, f"fold_{k}", l2, str(i)): p for i, p in zip(range(k, 60, 2), model.predict(x[k::2]))}
    assert found == expected


def test_probe_query_trains_to_the_end(spark, sf):
    from landweave.plans.supervision import k7_linear_probe

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    model = probe.fit_probe(x, rows.label.astype(str).tolist(), seed=42, epochs=500, rate=0.1, l2=1e-4)
    found = {r.vec_id: r.prediction for r in k7_linear_probe(spark, sf).collect()}
    assert [found[i] for i in rows.vec_id] == model.predict(x).tolist()


def test_policies_of_the_grid():
    assert set(quality.training_policies()) == {
        "all_unweighted", "spatial_only_unweighted", "quality_spatial_hard", "agreement_hard",
        "all_quality_weighted", "all_quality_weighted_class_balanced", "spatial_soft_weighted", "text_agreement_soft_weighted",
    }


def test_zero_shot_and_completeness(spark):
    df = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "key long, embedding array<double>")
    assert [r.prediction for r in probe.nearest_prompt(df, [("b", [0.0, 1.0]), ("a", [5.0, 0.0])]).orderBy("key").collect()] == ["a", "b", "a"]
    means = {r.label: r.embedding for r in probe.mean_vectors(df.withColumn("label", F.lit("x")), "label").collect()}
    assert means["x"] == pytest.approx([np.cos(np.arctan2(0.1, 3)) / 3, (1 + np.sin(np.arctan2(0.1, 3))) / 3])
    with pytest.raises(ValueError):
        probe.stack_embeddings(spark.createDataFrame([(7,)], "key long"), df, "key")
    assert probe.stack_embeddings(spark.createDataFrame([(7,), (1,)], "key long"), df, "key", allow_missing=True).count() == 1


def test_resume(spark):
    texts = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", None), ("5", "e")], "pageid string, text string")
    digest = lambda t: F.sha2(F.lit(t), 256)
    old = [("1", "ok", "a", "f"), ("2", "ok", "old", "f"), ("3", "error", "c", "f"), ("4", "ok", "", "f"), ("5", "ok", "e", "g"), ("9", "ok", "z", "f")]
    snapshot = spark.createDataFrame(old, "pageid string, parse_status string, t string, fingerprint string").select("pageid", "parse_status", F.sha2("t", 256).alias("text_sha256"), "fingerprint", F.lit("old").alias("prediction"))
    planned = resume.plan(texts, snapshot, "f")
    assert {r.pageid: r.action for r in planned.collect()} == {"1": "keep", "2": "compute", "3": "compute", "4": "keep", "5": "compute"}
    assert {r.pageid: r.action for r in resume.plan(texts, snapshot, "f", retry_failed=True).collect()}["5"] == "keep"
    compute = lambda rows: rows.select("pageid", F.lit("ok").alias("parse_status"), F.lit("new").alias("prediction"))
    after = resume.next_snapshot(planned, snapshot, compute, "f")
    assert {r.pageid: (r.prediction, r.fingerprint) for r in after.collect()} == {"1": ("old", "f"), "4": ("old", "f"), "2": ("new", "f"), "3": ("new", "f"), "5": ("new", "f")}
    assert resume.plan(texts, after, "f").where("action = 'compute'").count() == 0 and digest is not None
    have = spark.createDataFrame([("1", " "), ("2", "x"), (None, "y")], "pageid string, content string")
    assert {r.pageid for r in resume.missing_only(texts, have, "content").collect()} == {"1", "3", "4", "5"}


def test_classify_with_retry(spark):
    def model(prompts):
        return ['{"labels":["31"]}' if "retry" in p.lower() or "forêt" in p else "no idea" for p in prompts]

    texts = spark.createDataFrame([("1", "La forêt"), ("2", "Le pré"), ("3", None)], "pageid string, text string")
    rows = {r.pageid: r for r in classify.classify(texts, "corine_level2", "content", ["21", "31"], model, single=True).collect()}
    assert (rows["1"].prediction, rows["1"].attempts) == (["31"], 1) and (rows["2"].prediction, rows["2"].attempts) == (["31"], 2) and len(rows) == 3

    def moody(prompts):
        import random

        return [random.choice(['{"labels":["31"]}', "no idea", None, '{"labels":["21","31"]}']) for _ in prompts]

    many = spark.range(200).select(F.col("id").cast("string").alias("pageid"), F.lit("x").alias("text")).repartition(7)
    asked = spark.sparkContext.accumulator(0)

    def counted(prompts):
        asked.add(len(prompts))
        return moody(prompts)

    result = classify.classify(many, "corine_level2", "content", ["21", "31"], counted, single=True)
    once, again = (sorted((r.pageid, r.parse_status, r.attempts) for r in result.collect()) for _ in range(2))
    assert once == again and len({r[0] for r in once}) == len(once) == 200
    assert asked.value == 200 + sum(r[2] == 2 for r in once)
    assert classify.classify(many.limit(0), "osm", "content", ["wood"], counted, single=False).count() == 0

    def broken(prompts):
        raise RuntimeError("down")

    rows = classify.classify(texts, "osm", "content", ["wood"], broken, single=False).collect()
    assert {r.parse_status for r in rows} == {"error"} and {r.error for r in rows} == {"down"}
    long = spark.createDataFrame([("x" * 50_000,)], "t string").select(F.length(classify.user_prompt("a", "b", ["c"], F.col("t"))).alias("n")).first().n
    assert long < classify.PROMPT_CHARS + 100

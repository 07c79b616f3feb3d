"""Cascade, audits, samples of polygons, choices for reports, ranks, files of arrays and maps, training controls."""

import hashlib
import json
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.operators import audit, metrics, overlay, probe, quality, ranks, reports
from landweave.session import one_process
from landweave.sources import files, readers, sinks
from landweave.streaming import resume


def box(a, b, c, d):
    return f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))"


def test_ranks_by_digest_are_exact(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i, 40) for i in range(300)] + [(None, 7, 40), (None, 8, 40)], "g string, k int, lim int").withColumn("_n", F.lit("clash"))
    for bits in (1, 6):
        found = {(r.g, r["rank"]): r.k for r in ranks.smallest_by_digest(df, ["g"], ["k"], "lim", 9, bits=bits).collect()}
        for g, keys in {"a": [i for i in range(300) if i % 3], "b": [i for i in range(300) if not i % 3], None: [7, 8]}.items():
            order = sorted(keys, key=lambda k: (int(hashlib.md5(f"9:{k}".encode()).hexdigest()[:15], 16), k))[:40]
            assert [found[g, i + 1] for i in range(len(order))] == order
        assert len(found) == 82
    assert ranks.smallest_by_digest(df.limit(0), ["g"], ["k"], "lim", 9).count() == 0


def test_which_sessions_may_use_a_temporary_folder():
    assert one_process("local") and one_process("local[8]") and one_process("local[*]")
    assert not one_process("local-cluster[3,2,1024]") and not one_process("spark://h:7077") and not one_process("yarn")


def test_areas_and_samples_of_polygons(spark):
    rows = [(i, code, box(3 + i * 0.01, 46, 3.005 + i * 0.01, 46.004)) for i, code in enumerate(["311", "112", None, "211", "231"])] + [(9, "511", "rubbish")]
    polygons = spark.createDataFrame(rows, "id int, code_18 string, geometry string")
    flat = overlay.planar_areas(overlay.planar(spark.createDataFrame([(1, "POLYGON ((10 10, 20 10, 20 30, 10 30, 10 10), (12 12, 12 14, 14 14, 14 12, 12 12))"), (2, "POLYGON ((0 0, 1 1, 2 2, 0 0))")], "id int, g string"), "id", "g", [], project=False)).orderBy("id").collect()
    assert flat[0].area == pytest.approx(196) and flat[0].x == pytest.approx((200 * 15 - 4 * 13) / 196) and flat[1].area == 0 and (flat[1].x, flat[1].y) == (0, 0)
    found = overlay.sample_polygons(polygons, 3, level=1, seed=1, exclude_artificial=True).collect()
    assert len(found) == 3 and all(r.code_18 != "112" and r.class_label == (r.code_18 or "x")[0] or r.code_18 is None for r in found)
    for r in (r for r in found if r.id != 9):
        assert r.lon == pytest.approx(3.0025 + r.id * 0.01, abs=1e-6) and r.lat == pytest.approx(46.002, abs=1e-6)
    with pytest.raises(ValueError, match="artificial"):
        overlay.sample_polygons(polygons, 6, exclude_artificial=True)


def test_cascade_counts_and_audit(spark):
    pages = lambda *ids: spark.createDataFrame([(i,) for i in ids], "pageid string")
    kept = pages("1", "2")
    counts = {r.name: (r.before, r.after) for r in resume.cascade_counts({"articles": (pages("1", "2", "3"), kept)}, kept, {"contents": pages("1", "1", "3", None), "summaries": pages("1", "2")}).collect()}
    assert counts == {"articles": (3, 2), "contents": (4, 2), "summaries": (2, 1)}
    cover = spark.createDataFrame([(1, "311", box(0, 0, 1, 1)), (2, "112", box(5, 5, 6, 6)), (3, None, box(8, 8, 9, 9))], "id int, code_18 string, geometry string")
    tags = overlay.planar(spark.createDataFrame([(10, box(0.5, 0.5, 2, 2)), (11, box(5, 5, 6, 6)), (12, box(1, 0, 2, 0.4))], "id int, g string"), "id", "g", [], project=False)
    natural = overlay.planar(cover.where("code_18 = '311'"), "id", "geometry", [], project=False)
    shares = spark.createDataFrame([("7", "11"), ("8", "31"), ("9", None)], "id string, class_label string")
    rows = audit.cascade_audit(cover, tags, natural, pages("1", "2", "3"), kept, {"contents": pages("1", "4"), "summaries": pages("1", "2")}, shares, ["/nowhere/x"])
    assert {(r.check, r.key) for r in rows.collect()} == {
        ("artificial polygon", "2"), ("tags without land cover", "11"), ("tags without land cover", "12"), ("article outside", "3"), ("contents: stale key", "4"), ("summaries: stale key", "2"),
        ("artificial class in the distribution", "7"), ("file missing", "/nowhere/x"),
    }
    wiki = spark.createDataFrame([("1", 1.0), ("1", 1.0), ("2", None), (None, 1.0)], "pageid string, lat double")
    texts = spark.createDataFrame([("1", "a"), ("3", None)], "pageid string, summary string")
    assert {(r.check, r.key) for r in audit.validate([("wiki", wiki, None), ("texts", texts, "summary")], places=["lat"]).collect()} == {("wiki: repeated", "1"), ("wiki: no place", "2"), ("texts: missing", "2"), ("texts: extra", "3"), ("texts: no text", "3")}
    runs = spark.createDataFrame([("1", "31"), ("1", "31"), ("2", None)], "pageid string, target string")
    assert [tuple(r) for r in audit.require_consistent(runs).collect()] == [("1", "31")]
    with pytest.raises(ValueError, match="differ"):
        audit.require_consistent(runs.unionByName(spark.createDataFrame([("1", "21")], runs.schema)))


def test_choices_for_reports(spark):
    rows = spark.createDataFrame([("5", "b", 0.5), ("3", "b", 0.5), ("4", "a", None), ("9", None, 0.1), ("1", "b", 0.9), ("4", "c", 0.2)], "pageid string, label string, v double")
    assert [r.pageid for r in reports.contact_sheet(rows, 4).collect()] == ["4", "1", "3", "5"] and [r.pageid for r in reports.contact_sheet(rows, 1).collect()] == ["4"]
    assert reports.contact_sheet(rows, 99).count() == 5 and reports.contact_sheet(rows.limit(0), 3).count() == 0
    assert {(r.label, r.pageid) for r in reports.least(rows, ["label"], "v", "pageid").collect()} == {("b", "3"), ("c", "4"), (None, "9")}
    assert {r.pageid for r in reports.all_keys([rows, spark.createDataFrame([("x",), (None,)], "pageid string")], "pageid").collect()} == {"1", "3", "4", "5", "9", "x"}
    cells = spark.createDataFrame([(0.5, 0.25), (0.1, 0.2), (None, 1.0)], "a double, b double").select(reports.beats(F.col("a"), F.col("b")).alias("x"), reports.interval_text(F.col("a"), F.col("b")).alias("y"), reports.rounded_cell(F.col("a")).alias("z")).collect()
    assert [tuple(r) for r in cells] == [("yes", "[0.5000, 0.2500]", "0.5000"), ("no", "[0.1000, 0.2000]", "0.1000"), ("n/a", "", "")]
    keys = spark.createDataFrame([("Qwen3-8B",), ("x/Gemma 4",), ("Model--A.1",), ("--",), (None,)], "m string").select(reports.model_key(F.col("m")).alias("k")).collect()
    assert [r.k for r in keys] == ["qwen", "gemma", "model_a_1", "unknown_model", "unknown_model"]


def test_headline(spark):
    rows = [("m", "content", "relevance_medium_high", c, 0.8, 0.5, 0.4, 0.6, p) for c, p in (("same_n", 99.0), ("same_targets", 50.0))] + [("m", "content", "all", "same_n", 0.8, 0.5, 0.4, 0.6, 99.0), ("m", "poem", "relevance_medium_high", "same_n", 0.8, 0.5, 0.4, 0.6, 99.0), ("m", "content", "recommended_use_training", "same_n", 0.8, 0.5, 0.4, 0.6, 99.0)]
    found = {r.subset: r for r in reports.headline(spark.createDataFrame(rows, "model string, text_source string, subset string, control string, observed double, mean double, q025 double, q975 double, percentile double")).collect()}
    assert set(found) == {"relevance_medium_high", "recommended_use_training"}
    assert found["relevance_medium_high"].same_n_interval == "[0.4000, 0.6000]" and found["relevance_medium_high"].conclusion == "above_same_n_only"
    assert found["recommended_use_training"].same_targets_interval == "" and found["recommended_use_training"].conclusion == "not_available"


def test_records_labels_and_tasks(spark):
    rows = [(1, "21", "21", "ok"), (2, "31", "99", "ok"), (3, "22", None, "ok"), (4, None, "51", "ok"), (5, "31", "31", None), (6, "33", "41", "error")]
    records = spark.createDataFrame(rows, "pageid int, target string, prediction string, parse_status string")
    assert {r.pageid for r in metrics.ok_records(records).collect()} == {1, 2, 4} and {r.pageid for r in metrics.ok_records(records, lenient=True).collect()} == {1, 2, 3, 4, 5}
    counts = metrics.confusion_counts(records, [])
    assert metrics.observed_labels(counts) == ["21", "22", "31", "33", "99"] and metrics.observed_labels(counts, predicted=False) == ["21", "22", "31", "33"]
    assert metrics.task_metrics(records, "corine_level2", [], ["21", "31"]).first().n == 5
    sets = records.withColumns({"target": F.array("target"), "prediction": F.array("prediction")})
    assert metrics.task_metrics(sets, "osm", [], ["21", "31"]).first().n == 6
    with pytest.raises(ValueError):
        metrics.task_metrics(records, "poem", [], [])
    table = spark.createDataFrame([("m", "content", 5, 0.5), ("m", "content_shuffled", 4, None), ("n", "content", 5, 0.5)], "model string, text_source string, n int, v double")
    pairs = spark.createDataFrame([("content", "content_shuffled")], "base string, other string")
    found = metrics.aligned_deltas(table, ["model"], "text_source", pairs, ["v"]).collect()
    assert [(r.model, r.n_aligned, r.n_shuffled, r.aligned_v, r.delta_v) for r in found] == [("m", 5, 4, 0.5, None)]


def test_attached_weights(spark):
    rows = spark.createDataFrame([("1", 9.0), ("2", 9.0)], "pageid string, weight_raw double")
    weights = spark.createDataFrame([("1", 0.5, "x")], "pageid string, weight_raw double, label string")
    assert {(r.pageid, r.weight_raw) for r in quality.attach_weights(rows, weights).collect()} == {("1", 0.5), ("2", None)}
    full = rows
    for c in quality.WEIGHT_COLUMNS:
        full = full.withColumn(c, F.lit(1.0))
    assert quality.attach_weights(full, weights) is full


def test_paths_of_artifacts(tmp_path):
    groups = {"a": "early"}
    assert files.artifact_path("a", "x.csv", root="/r/", groups=groups) == "/r/early/a/x.csv" and files.artifact_path("b", root="/r") == "/r/b"
    root = str(tmp_path)
    assert files.existing_artifact("a", root=root, groups=groups) == f"{root}/early/a"
    (tmp_path / "a").mkdir()
    assert files.existing_artifact("a", root=root, groups=groups) == f"{root}/a" and files.exists(f"file://{root}/a") and files.empty(f"{root}/a")
    (tmp_path / "early/a").mkdir(parents=True)
    (tmp_path / "early/a/f").write_text("x")
    assert files.existing_artifact("a", root=root, groups=groups) == f"{root}/early/a" and not files.empty(f"{root}/early/a") and files.read_bytes(f"{root}/early/a/f") == b"x"


def test_arrays_and_pages_of_maps(spark, tmp_path):
    df = spark.createDataFrame([(str(i), [float(i), 0.5]) for i in range(20)] + [("x", None), (None, [1.0, 1.0])], "pageid string, v array<double>").repartition(3)
    written = sinks.write_npz(df, "pageid", "v", f"file://{tmp_path}/npz").collect()
    assert sum(r.n for r in written) == 20
    assert {r.pageid: r.embedding for r in readers.npz(spark, f"{tmp_path}/npz").collect()} == {str(i): [float(i), 0.5] for i in range(20)}
    shapes = spark.createDataFrame([(1, "</script>", box(0, 0, 1, 1)), (2, None, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((2 2, 3 2, 3 3, 2 2)))")], "id int, name string, g string")
    points = spark.createDataFrame([(0.5, 0.5, "a")], "lon double, lat double, title string")
    sinks.write_map(shapes, "g", ["id", "name"], f"{tmp_path}/map.html", "A <map>", points=points)
    page = (tmp_path / "map.html").read_text()
    assert page.count("</script>") == 1 and page.count('"type": "Feature"') == 2 and "A &lt;map&gt;" in page and '[0.5, 0.5, "a"]' in page
    with pytest.raises(ValueError):
        sinks.map_page(shapes, "g", [], "t", most=1)
    bands = spark.createDataFrame([([-5.0, 0.0, 1500.0, 3000.0, 9000.0],), ([0.0],), (None,)], "v array<double>").select(audit.shown_bands(F.col("v")).alias("b"), audit.usable_patch(F.col("v")).alias("u")).collect()
    assert bands[0].b == [0, 0, 127, 255, 255] and [r.u for r in bands] == [True, False, False]


def test_a_map_of_any_number_of_shapes_lies_in_parts(spark, tmp_path):
    shapes = spark.range(25).select("id", F.lit(None).cast("string").alias("name"), F.concat(F.lit("POLYGON (("), "id", F.lit(" 0, 30 1.5, 30 2, "), "id", F.lit(" 0))")).alias("g"))
    odd = spark.createDataFrame([(90, "a\n\"b\"", None), (91, "</script>", "POLYGON EMPTY"), (92, "\"type\": \"Feature\"", "MULTIPOLYGON (((0 -3, 1 0, 1 1, 0 -3)))")], "id long, name string, g string")
    points = spark.createDataFrame([(-0.5, 0.5, "a \"b\""), (0.5, 7.25, None), (None, 1.0, "nowhere")], "lon double, lat double, title string")
    for path in (f"{tmp_path}/one", f"file://{tmp_path}/two"):
        sinks.write_map_parts(shapes.unionByName(odd), "g", ["id", "name"], path, "A <map>", points=points, rows=4)
        page = files.read_bytes(f"{path}/index.html").decode()
        named = re.findall(r'src="([^"]+)"', page)
        lines = [x for part in named for x in files.read_bytes(f"{path}/{part}").decode().splitlines()]
        assert "A &lt;map&gt;" in page and page.count("<canvas") == 1 and "x0 = -0.5, x1 = 30.0, y0 = -3.0, y1 = 7.25" in page
        assert sum(x.startswith('shape({"type": "Feature"') for x in lines) == 28 and len([p for p in named if p.startswith("shapes/")]) >= 7
        drawn = {f["properties"]["id"]: f for f in (json.loads(x[6:-2]) for x in lines if x.startswith("shape("))}
        assert drawn[90]["geometry"]["coordinates"] == drawn[91]["geometry"]["coordinates"] == [] and drawn[92]["geometry"]["coordinates"] == [[[[0, -3], [1, 0], [1, 1], [0, -3]]]]
        assert drawn[90]["properties"]["name"] == 'a\n"b"' and drawn[3]["geometry"] == {"type": "Polygon", "coordinates": [[[3, 0], [30, 1.5], [30, 2], [3, 0]]]}
        assert sorted(x for x in lines if x.startswith("mark(")) == ['mark([-0.5, 0.5, "a \\"b\\""]);', "mark([0.5, 7.25, null]);"]
    sinks.write_map_parts(shapes.limit(0), "g", ["id"], f"{tmp_path}/none", "t")
    assert "x0 = 0.0, x1 = 0.0" in (tmp_path / "none/index.html").read_text()


def test_the_query_of_the_map_page_draws_all_polygons(spark, tmp_path):
    from landweave.plans import files as plan

    polygons = spark.range(500_001).select(F.col("id").cast("int"), F.lit("211").alias("code_18"), F.concat(F.lit("POLYGON (("), "id", F.lit(" 0, 1 0, 1 1, 0 0))")).alias("geometry"))
    polygons.unionByName(polygons.limit(5)).write.parquet(f"{tmp_path}/landcover_polygons.parquet")
    spark.createDataFrame([(1, "a", 45.0, 1.0, datetime(2024, 1, 1))], "pageid long, title string, lat double, lon double, fetched_at timestamp").write.parquet(f"{tmp_path}/wiki_articles.parquet")
    assert [tuple(r) for r in plan.b15_map_page(spark, str(tmp_path)).collect()] == [(500_001, 1)]


def test_small_files_by_path_and_uri(tmp_path):
    for path in (f"{tmp_path}/a/b.txt", f"file://{tmp_path}/c/d.txt"):
        sinks.write_text(path, "é")
        sinks.write_text(path, "è\n")
        assert files.read_bytes(path).decode() == "è\n"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["b.txt", "d.txt"]


def test_json_in_parts(spark, tmp_path):
    df = spark.createDataFrame([(f'k"{i}', i, None if i % 2 else "é\n") for i in range(25)] + [(None, 1, "x")], "pageid string, n int, t string")
    sinks.write_json_map(df, "pageid", f"{tmp_path}/m.json", columns=["n", "t"], rows=10)
    read = {r.key: (r.n, r.t) for r in readers.json_map(spark, f"{tmp_path}/m.json", "n int, t string").collect()}
    assert read == {f'k"{i}': (i, None if i % 2 else "é\n") for i in range(25)}
    sinks.write_json_list(df, "n", f"{tmp_path}/l.json", rows=10)
    assert readers.json_list(spark, f"{tmp_path}/l.json", "pageid string, n int, t string").count() == 26
    sinks.write_json_map(df.limit(0), "pageid", f"{tmp_path}/e.json")
    assert readers.json_map(spark, f"{tmp_path}/e.json", "n int", required=False).count() == 0


@pytest.mark.parametrize("gather", [0, probe.GATHER])
def test_training_controls(spark, gather):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (90, 3))
    y = np.where(x[:, 0] > 0, "21", "31")
    noisy = np.where(np.arange(90) % 2 == 0, y, rng.permutation(y))  # the hard tier has the even, clean rows
    rows = spark.createDataFrame([(str(i), str(noisy[i]), x[i].tolist()) for i in range(90)], "key string, label string, embedding array<double>")
    members = [(str(i), "eval_strict", "eval_strict") for i in range(60, 90, 2)] + [(str(i), "train_for_eval_strict", t) for i in range(60) for t in (["all", "hard"] if i % 2 == 0 else ["all"])] + [("1", "train_for_eval_strict", "rare")]
    df = spark.createDataFrame(members, "key string, split string, tier string")
    found = probe.training_controls(rows, df, ["21", "31"], ["hard", "none"], draws=6, epochs=30, gather=gather).toPandas()
    assert set(found.tier) == {"hard"} and set(found.control) == {"same_n", "same_targets"} and len(found) == 12 and (found.n == 30).all()
    own, held = list(range(0, 60, 2)), list(range(60, 90, 2))
    guess = probe.fit_probe(x[own], noisy[own], seed=42, epochs=30, rate=0.1, l2=1e-4).predict(x[held])
    expected = np.mean([np.mean(guess[noisy[held] == label] == label) for label in ("21", "31")])
    assert found.observed.tolist() == pytest.approx([expected] * 12) and found.score.between(0, 1).all()
    assert probe.training_controls(rows, df.where("tier = 'x'"), ["21", "31"], ["hard"], draws=2).count() == 0

"""Readers, writers, fetch contracts, audits, report jobs."""

import json

import pytest
from pyspark.sql import functions as F

from landweave.operators import audit
from landweave.plans import jobs
from landweave.sources import fetch, readers, sinks


def test_json_lists_and_maps(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"pageid": 7, "title": "A", "lat": 1.5, "lon": 2}, {"pageid": "8", "title": None}]))
    rows = readers.articles(spark, str(tmp_path / "a.json")).orderBy("row_idx").collect()
    assert [(r.pageid, r.title, r.lat) for r in rows] == [("7", "A", 1.5), ("8", None, None)]
    (tmp_path / "m.json").write_text(json.dumps({"1": {"pageid": "9", "title": "x"}, "2": {"pageid": " ", "title": "y"}, "3": "no object", "9": {"title": "z"}}))
    rows = {r.pageid: r.title for r in readers.by_pageid(readers.json_map(spark, str(tmp_path / "m.json"), readers.ARTICLE)).collect()}
    assert rows == {"9": "z", "2": "y"}
    assert readers.json_map(spark, str(tmp_path / "none.json"), readers.ARTICLE, required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.json_map(spark, str(tmp_path / "none.json"), readers.ARTICLE)
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        readers.json_map(spark, str(tmp_path / "l.json"), readers.ARTICLE)


def test_evidence_and_types(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"1": {"landcover_relevance": "high", "evidence_types": ["forest", " "], "evidence_sentences_count": "2.0"}, "2": {"evidence_sentences_count": "x"}}))
    rows = {r.pageid: r for r in readers.evidence(spark, str(tmp_path / "e.json")).collect()}
    assert (rows["1"].evidence_sentences_count, rows["1"].evidence_types) == (2, ["forest"]) and (rows["2"].evidence_sentences_count, rows["2"].evidence_types) == (0, [])
    (tmp_path / "t.csv").write_text("pageid,title,primary_article_type,candidate_article_types,has_categories\n1,A,,\"['x', 'y']\",yes\n2,,water_feature,,\n")
    rows = {r.pageid: r for r in readers.article_types(spark, str(tmp_path / "t.csv")).collect()}
    assert (rows["1"].primary_article_type, rows["1"].candidate_article_types, rows["1"].has_categories) == ("other_or_unclear", ["x", "y"], True) and rows["2"].has_categories is False
    (tmp_path / "s.csv").write_text("pageid,dominant_matches_point_label_250m\n1,oui\n2,maybe\n")
    assert {r.pageid: r.dominant_matches_point_label_250m for r in readers.spatial_confidence(spark, str(tmp_path / "s.csv")).collect()} == {"1": True, "2": None}
    (tmp_path / "n.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        readers.spatial_confidence(spark, str(tmp_path / "n.csv"))
    assert readers.spatial_confidence(spark, str(tmp_path / "n.csv"), allow_missing_pageid=True).count() == 1


def test_landcover_round_trip(spark, tmp_path):
    shapes = spark.createDataFrame([(1, "311", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), (2, "112", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"), (3, None, "POLYGON ((0 0, 2 0, 2 2, 0 0))")], "ID int, code_18 string, geometry string")
    features = [json.loads(r.value) for r in sinks.geojson_features(shapes, "geometry", ["ID", "code_18"]).collect()]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = {r.id: (r.code_18, "".join(r.geometry.split())) for r in readers.landcover(spark, str(tmp_path / "p.geojson")).collect()}
    squeezed = {r.ID: (r.code_18, "".join(r.geometry.split())) for r in shapes.collect()}
    assert {k: (c, g.replace(".0", "")) for k, (c, g) in rows.items()} == squeezed
    assert {r.id for r in readers.landcover(spark, str(tmp_path / "p.geojson"), natural_only=True).collect()} == {1, 3}


def test_predictions(spark, tmp_path):
    folder = tmp_path / "gemma_run"
    folder.mkdir()
    (folder / "corine_level2_content_predictions.json").write_text(json.dumps({"1": {"target": "31", "prediction": "21", "parse_status": "ok", "metadata": {"model": "m1"}}, "2": {"pageid": "22", "target": "31", "prediction": None, "parse_status": "error"}}))
    (folder / "osm_summary_predictions.json").write_text(json.dumps({"1": {"target": ["wood", "water"], "prediction": [], "parse_status": "ok"}}))
    (folder / "other_predictions.json").write_text("{}")
    rows = {(r.task, r.text_source, r.pageid): r for r in readers.predictions(spark, str(folder)).collect()}
    assert set(rows) == {("corine_level2", "content", "1"), ("corine_level2", "content", "22"), ("osm", "summary", "1")}
    assert rows["corine_level2", "content", "1"].model == "m1" and rows["osm", "summary", "1"].model == "gemma" and rows["osm", "summary", "1"].target == ["wood", "water"]
    assert rows["corine_level2", "content", "22"].prediction is None and readers.predictions(spark, str(folder), ["summary"]).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", {"x": 1.0}, "l1\nl2"), (None, None, None)], "k string, m map<string,double>, t string")
    assert sinks.markdown_table(sinks.flat(df), ["k", "t"]) == "| k | t |\n| --- | --- |\n| a\\|b | l1<br>l2 |\n|  |  |\n" and sinks.markdown_table(df.limit(0), ["k"]) == "No rows.\n"
    sinks.write_csv(df, str(tmp_path / "c"), one_file=True)
    back = spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"')
    assert {r.m for r in back.collect()} == {'{"x":1.0}', None}
    sinks.write_text(tmp_path / "d" / "f.txt", "old")
    with pytest.raises(TypeError):
        sinks.write_text(tmp_path / "d" / "f.txt", 3)
    assert (tmp_path / "d" / "f.txt").read_text() == "old" and len(list((tmp_path / "d").iterdir())) == 1
    assert sinks.table_columns([{"b": 1, "a": 2}, {"c": 3}], ["b"]) == ["b", "a", "c"]
    sinks.write_manifest(str(tmp_path / "m.json"), {"f": str(tmp_path / "d" / "f.txt")}, run=1)
    digest = json.loads((tmp_path / "m.json").read_text())["sha256"]["f"]
    assert {r.name: r.sha256 for r in sinks.file_digests(spark, str(tmp_path / "d")).collect()} == {"f.txt": digest}


def test_fetch_contracts(spark):
    grid = fetch.tiles(spark, west=0.0, south=0.0, east=0.5, north=0.18)
    assert [(r.i, r.west, r.east) for r in grid.orderBy("i").collect()] == [(0, 0.0, 0.26), (1, 0.26, 0.5)]
    found = fetch.fetch_tiles(grid, lambda t: [{"pageid": str(t["i"]), "lat": 1.0}], "pageid string, lat double")
    assert {r.pageid for r in found.collect()} == {"0", "1"}
    keys = spark.createDataFrame([(str(i),) for i in range(5)] * 2, "pageid string")
    rows = fetch.fetch_by_key(keys, "pageid", lambda ks: {k: {"pageid": k, "content": "c"} for k in ks if k != "3" and (len(ks) == 1 or k != "2")}, "pageid string, content string", batch=3)
    assert sorted(r.pageid for r in rows.collect()) == ["0", "1", "2", "4"]
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise BlockingIOError if len(calls) == 1 else OSError
        return "ok"

    assert fetch.with_retries(flaky, sleep=waits.append) == "ok" and waits == [5.0, 4.0]
    with pytest.raises(ConnectionError):
        fetch.with_retries(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)
    elements = spark.createDataFrame([("way", 5, {"landuse": "meadow"}, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), ("way", 6, {}, [(0.0, 0.0), (1.0, 0.0)])], "type string, id long, tags map<string,string>, points array<struct<lon:double,lat:double>>")
    row = fetch.elements_to_polygons(elements).collect()
    assert len(row) == 1 and (row[0].osm_id, row[0].landuse, row[0].natural) == ("way/5", "meadow", None)


def test_audit(spark):
    pages = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "pageid string")
    texts = spark.createDataFrame([("1", "x"), ("2", " "), ("9", "y")], "pageid string, text string")
    rows = {(r.check, r.key) for r in audit.audit(pages, {"contents": texts}, pages.where("pageid <> '3'")).collect()}
    assert rows == {("repeated article", "2"), ("contents: unknown page", "9"), ("contents: no row", "3"), ("contents: blank text", "2"), ("outside the regions", "3")}
    patches = spark.createDataFrame([("a", 320, [0, 0]), ("a", 640, [2, 4]), ("b", 320, [1, 1])], "pageid string, window_m int, patch array<int>")
    stats = {r.window_m: (r.n, r.n_zero, r["mean"], r["max"]) for r in audit.patch_statistics(patches, "window_m").collect()}
    assert stats == {320: (2, 1, 0.5, 1), 640: (1, 0, 3.0, 4)}
    diff = audit.window_differences(patches).collect()
    assert [(r.window_a, r.window_b, r.n, r.mean_difference) for r in diff] == [(320, 640, 1, 3.0)]


def test_report_jobs(spark, tmp_path, sf):
    from landweave.plans import inputs

    rows = inputs.records(spark, sf)
    meta = inputs.pages(spark, sf).drop("label", "qwen", "gemma")
    for report in (jobs.spatial_report, jobs.relevance_report, jobs.article_type_report, jobs.quality_report):
        tables = report(rows, meta)
        assert tables["metrics"].count() > 0, report.__name__
    tables = jobs.text_source_report(rows, meta, [("summary", "content")])
    assert tables["agreement"].count() > 0 and "comparisons" in tables
    assert jobs.control_report(rows, meta, draws=50)["conclusions"].count() > 0
    overview = jobs.overview(rows)
    jobs.write(overview, str(tmp_path / "out"), "Overview")
    assert (tmp_path / "out" / "overview.md").read_text().startswith("# Overview") and (tmp_path / "out" / "manifest.json").exists()
    order = [r.text_source for r in overview["overview"].where("model = 'model_q'").collect()]
    assert order[0] == "summary" and order[-1] == "content_shuffled"


def test_every_query_runs(spark, sf):
    import duckdb

    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    from landweave.plans import registry

    for name, query in registry.QUERIES.items():
        assert query(spark, sf).columns, name
    assert set(registry.ORACLE) <= set(registry.QUERIES) and duckdb.__version__
    assert F.lit(1) is not None

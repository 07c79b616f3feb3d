"""Splits and samples."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landweave.llm.components import connected_components
from landweave.llm.sampling import proportion_report, proportional_sample, quotas, usable_bin, usable_label
from landweave.llm.splits import Flow, _improve, allocate_bundles, related_splits, whole_pair

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "random", "star", "none", "nulls"])
def test_components(spark, shape):
    random.seed(5)
    edges = {
        "chain": [(i, i + 1) for i in range(200)],
        "random": [(random.randrange(300), random.randrange(300)) for _ in range(220)],
        "star": [(0, i) for i in range(1, 200)] + [(500, 501)],
        "none": [],
        "nulls": [(None, 1), (1, None), (2, 2), (3, 4), (4, 3), (3, 4)],
    }[shape]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    expected = union_find((a, b) for a, b in edges if a is not None and b is not None and a != b)
    assert {r.node: r.root for r in found.collect()} == expected


def test_flow_is_least_cost():
    flow = Flow()
    flow.arc(0, 2, 3, 1), flow.arc(0, 3, 2, 2), flow.arc(2, 1, 2, 1), flow.arc(2, 3, 5, 0), flow.arc(3, 1, 4, 3)
    assert flow.solve(0, 1) == 2 * 2 + 1 * 4 + 2 * 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 60), st.integers(1, 30)), max_size=12))
def test_allocation_keeps_components_whole(bundles):
    dealt = allocate_bundles(bundles, [0.8, 0.1, 0.1]) if bundles else []
    assert [sum(d) for d in dealt] == [n for _, _, n in bundles]
    total = sum(s * n for _, s, n in bundles)
    largest = max((s for _, s, _ in bundles), default=0)
    for k, share in enumerate([0.8, 0.1, 0.1]):
        got = sum(d[k] * s for d, (_, s, _) in zip(dealt, bundles))
        assert abs(got - share * total) <= largest + 1


def test_many_small_components_meet_the_quotas_exactly():
    dealt = allocate_bundles([("a", 1, 700), ("b", 1, 300)], [0.8, 0.1, 0.1])
    assert dealt == [[560, 70, 70], [240, 30, 30]]


def test_labels_that_are_never_the_most_frequent_are_balanced(spark):
    # forty components of ten records: mainly 31, twenty of them with four records of 41
    rows = [(f"p{c}_{i}", f"{c}_1", "41" if c < 20 and i < 4 else "31") for c in range(40) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, g string, label string")
    split = {r.k: r.split for r in related_splits(df, "k", F.col("g"), SHARES, label=F.col("label")).collect()}
    assert Counter(split.values()) == {"train": 320, "validation": 40, "test": 40}
    assert Counter(split[k] for k, _, label in rows if label == "41") == {"train": 64, "validation": 8, "test": 8}


@pytest.mark.parametrize("mine, theirs, lack", [([*range(5000, 9100), 3], [], 3), (range(2000, 4000, 2), range(2001, 4001, 2), 5)])
def test_sizes_are_repaired_among_many_bundles(mine, theirs, lack):
    bundles = [("a", n, 1) for n in (*mine, *theirs)]
    result = [[1, 0]] * len(mine) + [[0, 1]] * len(theirs)
    result = [list(r) for r in result]
    left = [-lack, lack]
    counts = np.array([[float(n)] for _, n, _ in bundles])
    _improve(bundles, result, left, np.array([[-float(lack)], [float(lack)]]), counts)
    assert left == [0, 0] and all(sum(r) == 1 for r in result)


def test_allocation_counts_every_label_of_a_component():
    dealt = allocate_bundles([({"31": 60, "41": 40}, 10, 10), ({"31": 100}, 10, 10)], [0.8, 0.1, 0.1])
    assert dealt == [[8, 1, 1], [8, 1, 1]]


def test_related_splits(spark):
    rows = [
        ("p1", "1_2", "train", "31"), ("p1", " 01 _ 2.0", "x", "31"), ("p2", "1.0_2.0", "eval_strict", "21"), ("p2", "5_5", "x", None),
        ("p3", "5_05", "train", "21"), ("p4", None, "train", None), ("p4", None, "eval_strict", None), ("p5", "nonsense", "train", "31"),
        ("p6", "7_7", "train", "31"), ("p6", "7_7", "train", "31"), (None, "7_7", "eval_strict", "31"), ("p7", "9_9", "Train", "1"), ("p8", "9_9", "eval_strict", "1"),
    ]
    df = spark.createDataFrame(rows, "pageid string, geo string, split string, label string").withColumn("size", F.lit("clash"))
    flags = {"in_train": F.col("split") == "train", "in_eval": F.col("split") == "eval_strict"}
    result = {r.pageid: r for r in related_splits(df, "pageid", whole_pair(F.col("geo")), SHARES, label=F.col("label"), flags=flags).collect()}
    assert set(result) == {f"p{i}" for i in range(1, 9)}
    assert {k for k, r in result.items() if r.in_train and r.in_eval_tied} == {"p1", "p3", "p4"}
    assert result["p1"].component == result["p3"].component and result["p1"].split == result["p3"].split == result["p2"].split
    assert result["p1"]["size"] == 3 and result["p5"]["size"] == 1 and all(r.split in SHARES for r in result.values())
    assert related_splits(df.limit(0), "pageid", whole_pair(F.col("geo")), SHARES).count() == 0


def test_splits_of_a_hot_group_and_many_singles(spark):
    df = spark.range(4000).select(
        F.concat(F.lit("p"), "id").alias("k"),
        F.when(F.col("id") % 3 == 0, "0_0").when(F.col("id") % 3 == 1, F.concat_ws("_", (F.col("id") / 30).cast("int"), F.lit(1))).alias("g"),
    )
    rows = related_splits(df, "k", F.col("g"), SHARES).collect()
    counts = Counter(r.split for r in rows)
    assert len(rows) == 4000 and abs(counts["train"] - 3200) <= 1 and abs(counts["test"] - 400) <= 1
    by_component = defaultdict(set)
    for r in rows:
        by_component[r.component].add(r.split)
    assert all(len(s) == 1 for s in by_component.values())


@pytest.mark.parametrize("text, expected", [("35_330", "35_330"), ("35_0330", "35_330"), (" 35 _ 330 ", "35_330"), ("35.0_330.0", "35_330"), ("-3_4", "-3_4"), ("３５_330", "35_330"), ("(35, 330)", "35_330"), ("nan", None), ("", None), ("35", None), ("3.5_1", None), (None, None)])
def test_whole_pair(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(whole_pair(F.col("t"))).first()[0] == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 20), st.integers(0, 100)), min_size=1, max_size=8), st.integers(0, 300))
def test_quotas(parts, size):
    shares, floors, available = (list(x) for x in zip(*parts))
    result = quotas(shares, floors, available, size)
    low = [min(f, a) for f, a in zip(floors, available)]
    assert all(lo <= q <= a for lo, q, a in zip(low, result, available))
    reachable = sum(a if s > 0 else lo for s, a, lo in zip(shares, available, low))
    assert sum(result) == max(min(size, reachable), sum(low)) or sum(result) >= min(size, reachable)
    if sum(low) <= size:
        assert sum(result) <= size


def test_quotas_in_proportion():
    assert quotas([0.5, 0.3, 0.2], [0, 0, 0], [100] * 3, 10) == [5, 3, 2]
    assert quotas([1, 1, 1], [0, 0, 0], [100] * 3, 10) == [4, 3, 3]
    assert quotas([0.9, 0.1], [0, 5], [100, 100], 10) == [5, 5]
    assert quotas([0.5, 0.5], [0, 0], [2, 100], 10) == [2, 8]
    assert quotas([0.0, 1.0], [3, 0], [10, 10], 8) == [3, 5]


@pytest.mark.parametrize("text, expected", [("31", "31"), (" 31", "31"), ("CLC 31", "31"), ("clc_31", "31"), ("31.0", "31"), ("99", None), ("52", None), ("nan", None), ("", None), (None, None), ("311", None), ("３１", "31")])
def test_usable_label(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(usable_label(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize("text, expected", [("Quality Very High", "quality_very_high"), ("quality-very-high", "quality_very_high"), ("qualité très élevée", "quality_very_high"), ("quality_very_high\t", "quality_very_high"), ("low", "quality_low"), ("QUALITÉ ÉLEVÉE", "quality_high"), ("qualité moyenne", "quality_medium"), ("unknown", None), ("", None), (None, None)])
def test_usable_bin(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(usable_bin(F.col("t"))).first()[0] == expected


def test_report_and_sample(spark):
    pages = spark.createDataFrame([("label", "31" if i % 4 else "21", f"p{i}") for i in range(400)], "field string, category string, pageid string")
    plans = spark.createDataFrame(
        [("a", "label", "31", 0.5, 1, 100), ("a", "label", "21", 0.5, 1, 100), ("b", "label", "21", 0.9, 2, 200), ("b", "label", "51", 0.1, 2, 200), ("c", "label", "51", None, None, None), (None, "label", "31", 0.5, 1, 1), ("b", "label", "51", 0.1, 2, 200)],
        "plan_id string, field string, category string, target_share double, min_rows int, sample_size int",
    )
    report = proportion_report(pages, plans)
    rows = {(r.plan_id, r.category): r for r in report.collect()}
    assert len(rows) == 5
    assert {k for k, r in rows.items() if r.short} == {("b", "21"), ("b", "51")}
    assert rows["a", "31"].quota == rows["a", "21"].quota == 50 and rows["b", "21"].quota == 100 and rows["c", "51"].quota == 0
    sample = proportional_sample(pages, report, "pageid").collect()
    assert Counter((r.plan_id, r.category) for r in sample) == {("a", "31"): 50, ("a", "21"): 50, ("b", "21"): 100}
    assert len({(r.plan_id, r.pageid) for r in sample}) == len(sample)
    assert proportion_report(pages.limit(0), plans).where("available > 0").count() == 0
    assert proportion_report(pages, plans.limit(0)).count() == 0


def test_a_root_with_most_edges_is_spread(spark):
    # a star of a third of all nodes beside many small components: no task of the contraction gets it all
    edges = spark.range(30_000).select(F.when(F.col("id") < 10_000, F.lit(0)).otherwise(F.col("id") * 3).alias("a"), (F.col("id") * 3 + 1).alias("b"))
    found = connected_components(edges)
    sizes = found.groupBy("root").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert {r["count"]: r.n for r in sizes} == {10_001: 1, 2: 20_000}
    from landweave.llm.components import _large_star

    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    plan = _large_star(both, 30_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "* 1000) >" not in plan  # so few rows are no burden
    plan = _large_star(both, 300_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "* 1000) > 600000" in plan  # of many, the heavy root goes by broadcast


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.sampled_from("abcd"), st.integers(1, 9), min_size=1), st.integers(1, 12)), min_size=1, max_size=8))
def test_allocation_of_label_vectors(found):
    bundles = [({x: c * n for x, c in v.items()}, sum(v.values()), n) for v, n in found]
    dealt = allocate_bundles(bundles, [0.8, 0.1, 0.1])
    assert [sum(d) for d in dealt] == [n for _, _, n in bundles] and min(min(d) for d in dealt) >= 0
    total, largest = sum(s * n for _, s, n in bundles), max(s for _, s, _ in bundles)
    for k, share in enumerate([0.8, 0.1, 0.1]):
        assert abs(sum(d[k] * s for d, (_, s, _) in zip(dealt, bundles)) - share * total) <= largest + 1


def test_labels_weigh_in_the_flow():
    # every component holds one record of a label that the others lack; only the vector tells them apart
    bundles = [({"a": 30, "b": 30}, 2, 30), ({"a": 30, "c": 30}, 2, 30), ({"b": 40, "c": 40}, 2, 40)]
    assert allocate_bundles(bundles, [0.8, 0.1, 0.1]) == [[24, 3, 3], [24, 3, 3], [32, 4, 4]]


def test_profiles_get_coarser_where_bundles_are_too_many(spark, monkeypatch):
    from landweave.llm import splits

    rows = [(f"p{c}_{i}", f"{c}_1", str(random.Random(c * 100 + i).randrange(30))) for c in range(120) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, g string, label string")
    for most, labels in ((10, 256), (5_000, 3)):
        monkeypatch.setattr(splits, "MOST_BUNDLES", most)
        monkeypatch.setattr(splits, "MOST_LABELS", labels)
        found = related_splits(df, "k", F.col("g"), SHARES, label=F.col("label")).collect()
        assert Counter(r.split for r in found) == {"train": 1152, "validation": 144, "test": 144}
        assert len({(r.component, r.split) for r in found}) == 120


def test_splits_do_not_depend_on_how_many_bundles_and_labels_there_are(spark, monkeypatch):
    from landweave.llm import splits

    rows = [(f"p{c}_{i}", f"{c}_1", str(random.Random(c * 100 + i).randrange(30))) for c in range(120) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, g string, label string")
    split = lambda: {r.k: r.split for r in related_splits(df, "k", F.col("g"), SHARES, label=F.col("label")).collect()}
    once = split()
    for most, labels in ((10, 256), (5_000, 3), (2, 1)):
        monkeypatch.setattr(splits, "MOST_BUNDLES", most)
        monkeypatch.setattr(splits, "MOST_LABELS", labels)
        assert split() == once


def test_every_label_has_its_quota(spark):
    # three hundred labels of ten single records each
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("g"), F.concat(F.lit("l"), F.col("id") % 300).alias("label"))
    found = related_splits(df, "k", F.col("g"), SHARES, label=F.col("label")).collect()
    assert set(Counter((r.k % 300, r.split) for r in found).values()) == {8, 1} and Counter(r.split for r in found) == {"train": 2400, "validation": 300, "test": 300}


def test_label_texts_that_look_like_two_labels_are_no_profile_of_others(spark):
    # each of the two kinds has one label with the signs that join labels in a text
    rows = [(f"{c}a", f"{c}", "a:1,b" if c % 2 else "a") for c in range(20)] + [(f"{c}b", f"{c}", "c:1,d" if c % 2 else "b:1,c:1,d") for c in range(20)]
    df = spark.createDataFrame(rows, "k string, g string, label string")
    split = {r.k: r.split for r in related_splits(df, "k", F.col("g"), SHARES, label=F.col("label")).collect()}
    assert {label: Counter(split[k] for k, _, x in rows if x == label) for label in {x for _, _, x in rows}} == {x: {"train": 8, "validation": 1, "test": 1} for _, _, x in rows}

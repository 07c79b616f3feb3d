"""Classification metrics of many groups at once.

Raw rows are aggregated once, to the counts of (target, prediction) per group; every number
comes from these few counts. The label universe is always an argument: which labels an average
runs over is a choice, never a by-product of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.functions.columns import jaccard, label_set_key, safe_div, surely, symmetric_difference_size



def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_div(2 * tp, 2 * tp + fp + fn)


def confusion_counts(records: DataFrame, groups: Sequence[str], order: str = "pageid", *, keep_null_target: bool = False, keep_null_prediction: bool = False) -> DataFrame:
    """``groups, target, prediction, ok, n, first``: the counts that all single-label metrics need.

    ``records`` has one row per group and record, with ``target``, ``prediction``,
    ``parse_status`` and ``order``. A prediction counts if the status is ok (and it is not null,
    unless kept, as the text ``None``); rows without target are left out, or kept as ``None``.
    """
    target = F.coalesce("target", F.lit("None")) if keep_null_target else F.col("target")
    ok = surely(F.col("parse_status") == "ok")
    ok = ok if keep_null_prediction else ok & F.col("prediction").isNotNull()
    guess = F.when(ok, F.coalesce("prediction", F.lit("None")))
    rows = records.withColumns({"target": target, "prediction": guess, "ok": ok}).where(F.col("target").isNotNull())
    return rows.groupBy(*groups, "target", "prediction", "ok").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def per_label(confusion: DataFrame, groups: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per group and label: counts, precision, recall, F1, and those with errors as wrong."""
    universe = F.array(*[F.lit(x) for x in labels])
    zero = F.lit(0).cast("long")
    hit = F.col("ok") & (F.col("target") == F.col("prediction"))
    miss = F.col("ok") & (F.col("target") != F.col("prediction"))
    entry = lambda label, s, p, tp, fp, fn: F.struct(label.alias("label"), s.alias("support"), p.alias("predicted"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    n = F.col("n")
    as_target = entry(F.col("target"), n, zero, F.when(hit, n).otherwise(zero), zero, F.when(miss, n).otherwise(zero))
    as_guess = entry(F.col("prediction"), zero, F.when(F.col("ok"), n).otherwise(zero), zero, F.when(miss, n).otherwise(zero), zero)
    spine = F.transform(universe, lambda x: entry(x, zero, zero, zero, zero, zero))
    parts = confusion.select(*groups, F.inline(F.concat(F.array(as_target, as_guess), spine))).where(F.col("label").isin(*labels))
    sums = parts.groupBy(*groups, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp", "fp", "fn")])
    tp, fp, fn, support = (F.col(c) for c in ("tp", "fp", "fn", "support"))
    return sums.withColumns({
        "precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "f1": _f1(tp, fp, fn),
        "strict_recall": safe_div(tp, support), "strict_f1": _f1(tp, fp, support - tp),
    })


def _grouped(df: DataFrame, groups: Sequence[str]):
    return df.groupBy(*groups)


def _join(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Inner join of two tables of few rows on groups that may be null."""
    if not groups:
        return left.join(right, F.lit(True))
    renamed = right.select(*[F.col(g).alias(f"_{g}") for g in groups], *[c for c in right.columns if c not in groups])
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    return left.join(renamed, on).drop(*[f"_{g}" for g in groups])


def single_label(confusion: DataFrame, groups: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per group: coverage, accuracy, macro and weighted averages over ``labels``, majority baseline."""
    n = F.col("n")
    right = F.sum(F.when(F.col("ok") & (F.col("target") == F.col("prediction")), n).otherwise(0))
    totals = _grouped(confusion, groups).agg(
        F.sum("n").alias("n_eligible"), F.sum(F.when(F.col("ok"), n).otherwise(0)).alias("n_predicted_ok"), right.alias("n_right")
    )
    k = len(labels)
    weighted = lambda c: safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    averages = _grouped(per_label(confusion, groups, labels), groups).agg(
        *[(F.sum(c) / k).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "strict_recall", "strict_f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )
    majority = majority_label(confusion, groups)
    counted = F.col("majority_label").isin(*labels)
    rows = _join(_join(totals, averages, groups), majority, groups)
    return rows.select(
        *groups,
        F.col("n_eligible").alias("n"),
        "n_predicted_ok",
        (F.col("n_eligible") - F.col("n_predicted_ok")).alias("n_parse_error"),
        safe_div(F.col("n_predicted_ok"), F.col("n_eligible")).alias("coverage"),
        safe_div(F.col("n_right"), F.col("n_predicted_ok")).alias("accuracy"),
        safe_div(F.col("n_right"), F.col("n_eligible")).alias("accuracy_errors_wrong"),
        "macro_precision",
        F.col("macro_recall").alias("balanced_accuracy"),
        F.col("macro_strict_recall").alias("balanced_accuracy_errors_wrong"),
        "macro_f1",
        F.col("macro_strict_f1").alias("macro_f1_errors_wrong"),
        "weighted_precision",
        "weighted_recall",
        "weighted_f1",
        "majority_label",
        safe_div(F.col("majority_n"), F.col("n_eligible")).alias("majority_accuracy"),
        F.when(counted, F.lit(1.0) / k).otherwise(0.0).alias("majority_balanced_accuracy"),
        F.when(counted, safe_div(2 * F.col("majority_n"), F.col("majority_n") + F.col("n_eligible")) / k).otherwise(0.0).alias("majority_macro_f1"),
    )


def majority_label(confusion: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Most frequent target per group; of equally frequent ones the one that comes first in the rows' order."""
    targets = confusion.groupBy(*groups, "target").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = Window.partitionBy(*groups).orderBy(F.desc("n"), F.asc("first"), F.asc("target"))
    top = targets.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == 1)
    return top.select(*groups, F.col("target").alias("majority_label"), F.col("n").alias("majority_n"))


def supported(confusion: DataFrame, groups: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Averages over all ``labels`` and over those that occur as target; F1 from precision and recall."""
    rows = per_label(confusion.where("ok"), groups, labels)
    f1 = safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    rows = rows.withColumn("f1", f1)
    occurs = F.col("support") > 0
    over = lambda c: F.coalesce(F.avg(F.when(occurs, F.col(c))), F.lit(0.0))
    averages = _grouped(rows, groups).agg(
        F.avg("recall").alias("balanced_accuracy_allowed"), over("recall").alias("balanced_accuracy_supported"),
        F.avg("precision").alias("macro_precision_allowed"), over("precision").alias("macro_precision_supported"),
        F.avg("f1").alias("macro_f1_allowed"), over("f1").alias("macro_f1_supported"),
        safe_div(F.sum(F.when(occurs, F.col("f1") * F.col("support"))), F.sum(F.when(occurs, F.col("support")))).alias("weighted_f1_supported"),
    )
    right = F.sum(F.when(F.col("target") == F.col("prediction"), F.col("n")).otherwise(0))
    accuracy = _grouped(confusion.where("ok"), groups).agg(safe_div(right, F.sum("n")).alias("accuracy"))
    return _join(accuracy, averages, groups)


def confusion_matrix(confusion: DataFrame, groups: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per group and true label of ``labels``, one column ``pred_<label>`` per predicted label."""
    inside = confusion.where(F.col("ok") & F.col("target").isin(*labels))
    cells = [F.sum(F.when(F.col("prediction") == x, F.col("n")).otherwise(0)).alias(f"pred_{x}") for x in labels]
    spine = confusion.select(*groups).distinct().withColumn("target", F.explode(F.array(*[F.lit(x) for x in labels])))
    counted = inside.groupBy(*groups, "target").agg(*cells)
    keys = [*groups, "target"]
    renamed = counted.select(*[F.col(c).alias(f"_{c}") for c in keys], *[f"pred_{x}" for x in labels])
    rows = spine.join(renamed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left")
    return rows.select(*keys, *[F.coalesce(f"pred_{x}", F.lit(0)).alias(f"pred_{x}") for x in labels])


def multi_label(records: DataFrame, groups: Sequence[str], labels: Sequence[str], *, hamming_by_predicted: bool = False, derived_over_parsed: bool = False, order: str = "pageid") -> DataFrame:
    """One row per group of metrics on sets of labels; ``target`` and ``prediction`` are arrays.

    Two aggregations: one of the rows, one of their labels. ``hamming_by_predicted`` divides the
    Hamming loss by the parsed records, else by all; ``derived_over_parsed`` takes Jaccard and
    Hamming over parsed records only. Rows without target are left out.
    """
    none = F.array().cast("array<string>")
    ok = surely(F.col("parse_status") == "ok")
    rows = records.where(F.col("target").isNotNull()).select(
        *groups,
        F.array_distinct("target").alias("t"),
        F.array_distinct(F.when(ok, F.coalesce("prediction", none)).otherwise(none)).alias("p"),
        ok.alias("ok"),
        label_set_key(F.col("target")).alias("key"),
        F.col(order).alias("order"),
    )
    both, extra, lost = (F.size(c) for c in (F.array_intersect("t", "p"), F.array_except("p", "t"), F.array_except("t", "p")))
    exact = (extra == 0) & (lost == 0)
    when_ok = lambda c: F.sum(F.when(F.col("ok"), c).otherwise(0))
    derived = F.col("ok") if derived_over_parsed else F.lit(True)
    tallies = _grouped(rows, groups).agg(
        F.count("*").alias("n"), F.count_if("ok").alias("n_ok"),
        F.count_if(F.col("ok") & exact).alias("exact_ok"), F.count_if(exact).alias("exact_all"),
        when_ok(both).alias("tp"), when_ok(extra).alias("fp"), when_ok(lost).alias("fn"),
        F.sum(both).alias("tp_all"), F.sum(extra).alias("fp_all"), F.sum(lost).alias("fn_all"),
        F.avg(F.when(derived, jaccard(F.col("t"), F.col("p")))).alias("jaccard"),
        F.sum(F.when(derived, symmetric_difference_size(F.col("t"), F.col("p"))).otherwise(0)).alias("wrong"),
        F.count_if(F.size("t") == 0).alias("empty"),
    )
    universe = F.array(*[F.lit(x) for x in labels])
    inside = rows.select(*groups, "ok", F.explode(F.array_union(F.array_union("t", "p"), universe)).alias("label"), "t", "p").where(F.col("label").isin(*labels))
    in_t, in_p = F.array_contains("t", F.col("label")), F.array_contains("p", F.col("label"))
    counts = inside.groupBy(*groups, "label").agg(
        F.count_if(F.col("ok") & in_t & in_p).alias("tp"), F.count_if(F.col("ok") & ~in_t & in_p).alias("fp"), F.count_if(F.col("ok") & in_t & ~in_p).alias("fn"),
        F.count_if(in_t & in_p).alias("tp_all"), F.count_if(~in_t & in_p).alias("fp_all"), F.count_if(in_t & ~in_p).alias("fn_all"),
    )
    k = len(labels)
    macro = _grouped(counts, groups).agg(
        (F.sum(safe_div(F.col("tp"), F.col("tp") + F.col("fp"))) / k).alias("macro_precision"),
        (F.sum(safe_div(F.col("tp"), F.col("tp") + F.col("fn"))) / k).alias("macro_recall"),
        (F.sum(_f1(F.col("tp"), F.col("fp"), F.col("fn"))) / k).alias("macro_f1"),
        (F.sum(_f1(F.col("tp_all"), F.col("fp_all"), F.col("fn_all"))) / k).alias("macro_f1_errors_empty"),
    )
    keys = rows.groupBy(*groups, "key").agg(F.count("*").alias("key_n"), F.min("order").alias("first"))
    best = Window.partitionBy(*groups).orderBy(F.desc("key_n"), F.asc("first"), F.asc("key"))
    top = keys.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == 1).select(*groups, "key", "key_n")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    of = F.col("n_ok") if hamming_by_predicted else F.col("n")
    return _join(_join(tallies, macro, groups), top, groups).select(
        *groups, "n", F.col("n_ok").alias("n_predicted_ok"), (F.col("n") - F.col("n_ok")).alias("n_parse_error"), safe_div(F.col("n_ok"), F.col("n")).alias("coverage"),
        safe_div(F.col("exact_ok"), F.col("n_ok")).alias("exact_match"), safe_div(F.col("exact_all"), F.col("n")).alias("exact_match_errors_empty"),
        safe_div(tp, tp + fp).alias("micro_precision"), safe_div(tp, tp + fn).alias("micro_recall"), _f1(tp, fp, fn).alias("micro_f1"),
        _f1(F.col("tp_all"), F.col("fp_all"), F.col("fn_all")).alias("micro_f1_errors_empty"),
        "macro_precision", "macro_recall", "macro_f1", "macro_f1_errors_empty", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"),
        safe_div(F.col("wrong"), of * k).alias("hamming_loss"), F.col("key").alias("majority_set"),
        safe_div(F.col("key_n"), F.col("n")).alias("majority_exact_match"), safe_div(F.col("empty"), F.col("n")).alias("empty_exact_match"),
    )


def model_agreement(records: DataFrame, groups: Sequence[str], models: tuple[str, str], order: str = "row_idx") -> DataFrame:
    """Per group: records, share on which two models agree, and how often an agreed label is right.

    Of several records of a model for a page and target the first in ``order`` counts that is ok
    and has a prediction; what one model lacks counts as disagreement, what both lack is left
    out, and so are records without target.
    """
    a, b = models
    usable = records.where(surely(F.col("parse_status") == "ok") & F.col("prediction").isNotNull() & F.col("target").isNotNull() & F.col("model").isin(a, b))
    first = lambda m: F.min(F.when(F.col("model") == m, F.struct(F.col(order).alias("o"), F.col("prediction").alias("p"))))["p"]
    wide = usable.groupBy(*groups, "pageid", "target").agg(first(a).alias("a"), first(b).alias("b"))
    agree = surely(F.col("a") == F.col("b"))
    return _grouped(wide, groups).agg(
        F.count("*").alias("n"), F.count_if(agree).alias("n_agree"), safe_div(F.count_if(agree), F.count("*")).alias("agreement_rate"),
        safe_div(F.count_if(agree & surely(F.col("a") == F.col("target"))), F.count_if(agree)).alias("agreed_precision"),
    )


def class_distribution(records: DataFrame, groups: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    """Support and share of every label of ``labels`` per group, zeros included."""
    spine = F.transform(F.array(*[F.lit(x) for x in labels]), lambda x: F.struct(x.alias("label"), F.lit(0).alias("n")))
    total = records.groupBy(*groups).agg(F.count("*").alias("total"))
    counts = records.groupBy(*groups, label).agg(F.count("*").alias("_n"))
    own = F.array(F.struct(F.col(label).alias("label"), F.col("_n").alias("n")))
    rows = counts.select(*groups, F.inline(F.concat(own, F.transform(spine, lambda s: F.struct(s["label"].alias("label"), s["n"].cast("long").alias("n"))))))
    sums = rows.where(F.col("label").isin(*labels)).groupBy(*groups, "label").agg(F.sum("n").alias("support"))
    return _join(sums, total, groups).select(*groups, "label", "support", safe_div(F.col("support"), F.col("total")).alias("share"))


# ---- differences between rows of metrics -------------------------------------------------------


def paired_deltas(metrics: DataFrame, keys: Sequence[str], source: str, pairs: DataFrame, values: Sequence[str]) -> DataFrame:
    """Differences of ``values`` between rows of one source and of its partner.

    ``pairs`` has ``base, other``; both must be there under the same ``keys``. Used for shuffled
    controls and for comparisons of text sources alike.
    """
    a = metrics.select(*keys, F.col(source).alias("base"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = metrics.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(source).alias("other"), *[F.col(v).alias(f"b_{v}") for v in values])
    on = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    rows = a.join(pairs, "base").join(b.withColumnRenamed("other", "b_other"), [*on, F.col("other") == F.col("b_other")])
    return rows.select(*keys, "base", "other", *[(F.col(f"a_{v}") - F.col(f"b_{v}")).alias(f"delta_{v}") for v in values])


def aligned_deltas(metrics: DataFrame, keys: Sequence[str], source: str, pairs: DataFrame, values: Sequence[str], size: str = "n") -> DataFrame:
    """Rows of a source beside those of its shuffled control: sizes, both values and their difference; nulls give a null difference."""
    a = metrics.select(*keys, F.col(source).alias("base"), F.col(size).alias("n_aligned"), *[F.col(v).alias(f"aligned_{v}") for v in values])
    b = metrics.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(source).alias("b_other"), F.col(size).alias("n_shuffled"), *[F.col(v).alias(f"shuffled_{v}") for v in values])
    rows = a.join(pairs, "base").join(b, [*[F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys], F.col("other") == F.col("b_other")])
    triple = lambda v: (F.col(f"aligned_{v}"), F.col(f"shuffled_{v}"), (F.col(f"aligned_{v}") - F.col(f"shuffled_{v}")).alias(f"delta_{v}"))
    return rows.select(*keys, "base", "other", "n_aligned", "n_shuffled", *[c for v in values for c in triple(v)])


def task_metrics(records: DataFrame, task: str, groups: Sequence[str], labels: Sequence[str], order: str = "pageid") -> DataFrame:
    """Metrics of a task by name: of one label (``corine_level2``) or of label sets (``osm``)."""
    if task == "corine_level2":
        return single_label(confusion_counts(records, groups, order), groups, labels)
    if task != "osm":
        raise ValueError(f"unknown task: {task}")
    return multi_label(records, groups, labels, order=order)


def first_two_models(metrics: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Differences between the first two models by name under the same keys."""
    names = metrics.select("model").distinct().withColumn("_at", F.row_number().over(Window.orderBy("model"))).where(F.col("_at") <= 2)
    placed = metrics.join(names, "model")
    a = placed.where(F.col("_at") == 1).select(*keys, F.col("model").alias("model_a"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = placed.where(F.col("_at") == 2).select(*keys, F.col("model").alias("model_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    return a.join(b, list(keys)).select(*keys, "model_a", "model_b", *[(F.col(f"a_{v}") - F.col(f"b_{v}")).alias(f"delta_{v}") for v in values])


def ok_records(records: DataFrame, *, lenient: bool = False) -> DataFrame:
    """Records of status ok that have a prediction; ``lenient`` takes a missing status for ok and keeps missing predictions."""
    status = F.col("parse_status")
    return records.where(F.coalesce(status, F.lit("ok")) == "ok") if lenient else records.where(surely(status == "ok") & F.col("prediction").isNotNull())


#: Labels that a universe may have; more are no labels.
MOST_LABELS = 10_000


def observed_labels(confusion: DataFrame, *, predicted: bool = True) -> list[str]:
    """Labels that occur as target, and with ``predicted`` as counted prediction, in order; from counts, not from records."""
    both = confusion.select(F.col("target").alias("label"))
    if predicted:
        both = both.unionByName(confusion.where("ok").select(F.col("prediction").alias("label")))
    rows = both.where(F.col("label").isNotNull()).distinct().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    return sorted(r["label"] for r in rows)

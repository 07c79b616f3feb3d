"""Small aggregates that reports are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.functions.columns import safe_div


def class_count_summary(classes: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows, in numbers and percent (half even)."""
    sizes = classes.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_classes")).groupBy("n_classes").agg(F.count("*").alias("n_groups"))
    total = sizes.agg(F.sum("n_groups").alias("total"))
    return sizes.join(total, F.lit(True)).select("n_classes", "n_groups", F.bround(100.0 * F.col("n_groups") / F.col("total"), 2).alias("pct_groups"))


def value_counts(df: DataFrame, columns: Sequence[str], missing: str = "missing") -> DataFrame:
    """``field, value, n`` of every value of several columns, nulls named, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def head_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must be total for a defined result."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first in the rows' order. Null keys are left out."""
    return head_per_group(df.where(F.col(key).isNotNull()), [key], [F.asc(order)], 1)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return head_per_group(df.where(F.col(key).isNotNull()), [key], [F.desc(order)], 1)


def draw_summary(draws: DataFrame, groups: Sequence[str], value: str, observed: str, *, stable_n: int = 30) -> DataFrame:
    """Mean, population deviation, quantiles of random draws, and where the observed value stands among them.

    The percentile counts draws up to the observed value (with 1e-12 of slack), the p-value
    draws from it on, both as usual for permutation tests: (1 + k) / (1 + n).
    """
    v, seen = F.col(value), F.col(observed)
    return draws.groupBy(*groups).agg(
        F.max(observed).alias("observed"), F.count(value).alias("n_draws"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, F.array(*[F.lit(q) for q in (0.025, 0.5, 0.975)])).alias("_q"),
        (100 * safe_div(F.count_if(v <= seen + 1e-12), F.count(value))).alias("percentile"),
        ((1 + F.count_if(v >= seen - 1e-12)) / (1 + F.count(value))).alias("p_value"),
    ).select(*groups, "observed", "n_draws", "mean", "std", "min", "max", F.col("_q")[0].alias("q025"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q975"), "percentile", "p_value")


def conclusion(same_n: Column, matched: Column) -> Column:
    """Reading of two percentiles: above the random subsets of the same size, and of the same targets."""
    high, higher = same_n >= 95, matched >= 95
    return F.when(same_n.isNull() | matched.isNull(), "not_available").when(high & higher, "above_both_controls").when(higher, "above_target_matched_only").when(high, "above_same_n_only").otherwise("not_above_controls")


# ---- cells of reports --------------------------------------------------------------------------


def beats(value: Column, baseline: Column) -> Column:
    """``yes`` or ``no``; ``n/a`` if either is no number."""
    return F.when(value.isNull() | baseline.isNull(), "n/a").when(value > baseline, "yes").otherwise("no")


def rounded_cell(value: Column) -> Column:
    """A number with four decimals; nothing for null."""
    return F.when(value.isNotNull(), F.format_string("%.4f", value)).otherwise("")


def interval_text(low: Column, high: Column) -> Column:
    """``[low, high]`` with four decimals; nothing unless both are there."""
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("["), F.format_string("%.4f", low), F.lit(", "), F.format_string("%.4f", high), F.lit("]"))).otherwise("")


def model_key(name: Column) -> Column:
    """Short key of a model's name: its family, else letters and digits with underscores."""
    low = F.lower(name)
    plain = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.contains(low, F.lit("qwen")), "qwen").when(F.contains(low, F.lit("gemma")), "gemma").when(plain != "", plain).otherwise("unknown_model")


# The sources, subsets and metrics of the headline table.
HEADLINE_SOURCES = ("content", "summary_no_place", "landuse_evidence_summary")
HEADLINE_SUBSETS = (
    "relevance_medium_high", "point_label_share_250m_ge_0.8", "relevance_medium_high_and_spatial_250m_ge_0.8", "quality_high_or_very_high_and_spatial_250m_ge_0.8",
    "recommended_use_training", "recommended_use_evaluation_only",
)


def headline(summary: DataFrame, groups: Sequence[str] = ("model", "text_source", "subset")) -> DataFrame:
    """One row per headline subset and source: the observed score with both controls' mean, interval and percentile, and their reading.

    ``summary`` has a row per ``groups`` and ``control`` (``draw_summary``); a control may be missing.
    """
    kept = summary.where(F.col("text_source").isin(*HEADLINE_SOURCES) & F.col("subset").isin(*HEADLINE_SUBSETS))
    pick = lambda control, c: F.max(F.when(F.col("control") == control, F.col(c)))
    parts = {f"{control}_{c}": pick(control, c) for control in ("same_n", "same_targets") for c in ("mean", "q025", "q975", "percentile")}
    rows = kept.groupBy(*groups).agg(F.max("observed").alias("observed"), *[c.alias(n) for n, c in parts.items()])
    return rows.select(
        *groups, "observed", *[x for control in ("same_n", "same_targets") for x in (
            F.col(f"{control}_mean"), interval_text(F.col(f"{control}_q025"), F.col(f"{control}_q975")).alias(f"{control}_interval"), F.col(f"{control}_percentile"))],
        conclusion(F.col("same_n_percentile"), F.col("same_targets_percentile")).alias("conclusion"),
    )


# ---- choices -----------------------------------------------------------------------------------


def all_keys(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """``key`` of any of the tables, each once; nulls are left out."""
    found = None
    for rows in tables:
        own = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key)).distinct()
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def least(df: DataFrame, groups: Sequence[str], value: str, key: str) -> DataFrame:
    """Per group the ``key`` with the smallest ``value``, the first by key of equal ones; null values do not count."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*groups).agg(F.min(F.struct(value, key))[key].alias(key))


def contact_sheet(rows: DataFrame, n: int, *, label: str = "label", key: str = "pageid") -> DataFrame:
    """``key`` of ``n`` rows for a sheet: the first key of every label, in order of label, then the first ones of all.

    Rows without a label only fill up; fewer rows than ``n`` all come.
    """
    known = rows.where(F.col(key).isNotNull())
    firsts = known.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(key).alias(key))
    own = firsts.groupBy(key).agg(F.min(label).alias("_label")).select(key, F.lit(0).alias("_late"), F.col("_label"))
    others = known.select(key).distinct().join(own.select(key), key, "left_anti").select(key, F.lit(1).alias("_late"), F.lit("").alias("_label"))
    return own.unionByName(others).orderBy("_late", "_label", key).limit(n).select(key)

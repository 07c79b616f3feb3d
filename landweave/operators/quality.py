"""Supervision quality: scores, sample weights, geographic groups and folds, probe splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave import vocab
from landweave.functions.columns import boolish, lookup, number_or_null, present, surely
from landweave.functions.geo import lcc_forward
from landweave.operators.ranks import smallest_by_digest

#: Groups that one packing takes; twice the 10 km cells that the Earth's surface has.
MOST_GROUPS = 10_000_000
TRAIN_TIERS = ("all", "spatial_only", "quality_spatial", "text_spatial_agreement")


def _word(name: str) -> Column:
    return F.coalesce(F.lower(present(F.col(name))), F.lit(""))


def quality_bin(score: Column) -> Column:
    bin_ = F.lit("quality_very_high")
    for name, edge in reversed(vocab.QUALITY_BIN_EDGES):
        bin_ = F.when(score < edge, name).otherwise(bin_)
    return F.when(score.isNotNull(), bin_)


def with_quality_score(rows: DataFrame) -> DataFrame:
    """``rows`` with the components, ``quality_score`` and ``quality_bin``; unknown values score nothing."""
    relevance = lookup(_word("landcover_relevance"), vocab.RELEVANCE_SCORE, 0)
    spatial = 3.0 * F.coalesce(number_or_null(F.col("point_label_share_250m")), F.lit(0.0))
    count = F.coalesce(number_or_null(F.col("evidence_sentences_count")), F.lit(0.0)).cast("int")
    density = F.least(F.greatest(count, F.lit(0)), F.lit(2))
    kind = lookup(_word("primary_article_type"), vocab.ARTICLE_TYPE_SCORE, 0)
    penalty = lookup(_word("uncertainty"), vocab.UNCERTAINTY_PENALTY, 1)
    scored = rows.withColumns({"relevance_score": relevance, "spatial_score": spatial, "evidence_density_score": density, "article_type_score": kind, "uncertainty_penalty": penalty})
    total = F.col("relevance_score") + F.col("spatial_score") + F.col("evidence_density_score") + F.col("article_type_score") - F.col("uncertainty_penalty")
    return scored.withColumn("quality_score", total).withColumn("quality_bin", quality_bin(F.col("quality_score")))


def agreement_weight(label: Column, a: Column, b: Column) -> Column:
    """1.25 if both predictions are the label, 1 if one is, 0.75 if they agree on another, else 0.85.

    Two missing predictions agree.
    """
    right_a, right_b, same = a.eqNullSafe(label), b.eqNullSafe(label), a.eqNullSafe(b)
    return F.when(right_a & right_b, 1.25).when(right_a | right_b, 1.0).when(same, 0.75).otherwise(0.85)


def _mean_one(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` over its mean over all rows; 1 everywhere if the mean is not positive.

    The mean is one aggregated row that joins every row; no window gathers them.
    """
    raw = rows.withColumn("_raw", value)
    mean = raw.agg(F.avg("_raw").alias("_mean"))
    return raw.join(F.broadcast(mean), F.lit(True)).withColumn(name, F.when(F.col("_mean") > 0, F.col("_raw") / F.col("_mean")).otherwise(1.0)).drop("_raw", "_mean")


def with_weights(rows: DataFrame) -> DataFrame:
    """``rows`` with four components, ``weight_raw`` (mean 1) and ``weight_class_balanced`` (mean 1).

    Needs ``label, landcover_relevance, uncertainty, point_label_share_250m, prediction_a, prediction_b``.
    """
    relevance = F.coalesce(lookup(_word("landcover_relevance"), vocab.RELEVANCE_WEIGHT), F.lit(0.5))
    uncertainty = F.coalesce(lookup(_word("uncertainty"), vocab.UNCERTAINTY_WEIGHT), F.lit(0.75))
    share = F.coalesce(number_or_null(F.col("point_label_share_250m")), F.lit(0.2))
    parts = rows.withColumns({
        "relevance_component": relevance, "uncertainty_component": uncertainty, "spatial_component": F.greatest(F.lit(0.2), F.least(F.lit(1.0), share)),
        "agreement_component": agreement_weight(F.col("label"), F.col("prediction_a"), F.col("prediction_b")),
    })
    product = F.col("relevance_component") * F.col("uncertainty_component") * F.col("spatial_component") * F.col("agreement_component")
    weighted = _mean_one(parts, "weight_raw", product)
    means = weighted.groupBy("label").agg(F.avg("weight_raw").alias("_class_mean")).withColumnRenamed("label", "_label")
    joined = weighted.join(means, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return _mean_one(joined, "weight_class_balanced", F.col("weight_raw") / F.col("_class_mean")).drop("_class_mean")


def geo_group(lon: Column, lat: Column, metres: int) -> Column:
    """Name of the plane cell of a place."""
    x, y = lcc_forward(lon, lat)
    return F.concat_ws("_", F.floor(x / metres).cast("string"), F.floor(y / metres).cast("string"))


def group_folds(groups: DataFrame, group: str, size: str, folds: int = 5) -> DataFrame:
    """``group, fold``: groups packed into folds, the largest first, each into the smallest fold so far.

    Ties go by group name and by fold number. The packing is sequential by nature, so it runs in
    one task on the table of groups, whose size does not grow with the rows: there is one row
    per cell of the map, and the Earth has 1.3 million cells of 20 km. More than ``MOST_GROUPS``
    are refused rather than gathered.
    """
    import pandas as pd

    def pack(table: pd.DataFrame) -> pd.DataFrame:
        if len(table) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups")
        table = table.sort_values(["size", "group"], ascending=[False, True])
        filled = [0] * folds
        chosen = []
        for n in table["size"]:
            fold = min(range(folds), key=lambda k: (filled[k], k))
            filled[fold] += int(n)
            chosen.append(fold)
        return pd.DataFrame({"group": table["group"], "fold": chosen})

    named = groups.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col(size).cast("long").alias("size"), F.lit(0).alias("all"))
    return named.groupBy("all").applyInPandas(pack, "group string, fold int").withColumnRenamed("group", group)


def tier_flags(rows: DataFrame) -> DataFrame:
    """``rows`` with one flag per training tier; what is unknown is not in a tier, but unknown uncertainty is not high."""
    spatial = surely(number_or_null(F.col("point_label_share_250m")) >= 0.8) & surely(boolish(F.col("dominant_matches_point_label_250m")))
    fine = surely(F.col("landcover_relevance").isin("medium", "high")) & surely(F.col("quality_bin").isin("quality_high", "quality_very_high")) & ~surely(F.col("uncertainty") == "high")
    agree = surely((F.col("prediction_a") == F.col("prediction_b")) & (F.col("prediction_a") == F.col("label")))
    return rows.withColumns({"all": F.lit(True), "spatial_only": spatial, "quality_spatial": spatial & fine, "text_spatial_agreement": spatial & fine & agree})


def sample_per_class(rows: DataFrame, n: int, seed: int, *, label: str = "label", key: str = "pageid") -> DataFrame:
    """Up to ``n`` rows per label: those with the smallest digests of seed and key.

    Null labels and keys have no sample. No label is gathered: ranks go by digest buckets.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).withColumn("_n", F.lit(n))
    return smallest_by_digest(known, [label], [key], "_n", seed).drop("_n", "rank")


def probe_splits(rows: DataFrame, *, seed: int = 42, per_class: int = 5, repeats: int = 20, folds: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """``pageid, label, split, tier``: strict, repeated and spatial-block evaluation sets, and training rows without theirs.

    ``rows`` has one row per page with the columns that ``tier_flags`` needs and ``geo_group_20km``.
    All evaluation sets are one table of (split, pageid); the training rows of all of them come
    from one join of the pages with the split names, minus that table.
    """
    flagged = tier_flags(rows)
    pool = flagged.where("quality_spatial").select("pageid", "label")
    seeds = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))) if repeats else None
    strict = sample_per_class(pool, per_class, seed).select("pageid", F.lit("eval_strict").alias("split"), F.lit("eval_strict").alias("tier"))
    evals = strict
    if repeats:
        spread = pool.withColumn("repeat", seeds)
        drawn = smallest_by_digest(spread.withColumn("_n", F.lit(per_class)), ["repeat", "label"], ["pageid"], "_n", F.lit(seed) + F.col("repeat"))
        evals = evals.unionByName(drawn.select("pageid", F.concat(F.lit("repeated_eval_seed_"), "repeat").alias("split"), F.lit("eval_repeated").alias("tier")))
    sizes = flagged.groupBy("geo_group_20km").agg(F.count("*").alias("size"))
    blocks = flagged.join(group_folds(sizes, "geo_group_20km", "size", folds), "geo_group_20km")
    evals = evals.unionByName(blocks.select("pageid", F.concat(F.lit("spatial_block_fold_"), "fold").alias("split"), F.lit("eval_spatial_block").alias("tier")))
    names = [("eval_strict", "train"), ("eval_strict", "train_for_eval_strict"), *[(f"repeated_eval_seed_{i}", f"train_for_repeated_eval_seed_{i}") for i in range(repeats)], *[(f"spatial_block_fold_{i}", f"train_for_spatial_block_fold_{i}") for i in range(folds)]]
    tiers = F.array_compact(F.array(*[F.when(F.col(t), F.lit(t)) for t in TRAIN_TIERS]))
    splits = F.array(*[F.struct(F.lit(e).alias("eval_split"), F.lit(t).alias("split")) for e, t in names])
    training = flagged.select("pageid", "label", *keep, tiers.alias("tiers"), F.inline(splits))
    held = evals.select("pageid", F.col("split").alias("eval_split")).distinct()
    training = training.join(held, ["pageid", "eval_split"], "left_anti").select("pageid", "label", *keep, "split", F.explode("tiers").alias("tier"))
    return evals.join(flagged.select("pageid", "label", *keep), "pageid").select("pageid", "label", *keep, "split", "tier").unionByName(training)


def training_policies() -> dict[str, tuple[str, Column]]:
    """Training policies: the tier of the rows and their weight, of which only the proportions count."""
    one, soft = F.lit(1.0), F.col("agreement_component") * F.col("spatial_component") * F.col("relevance_component")
    return {
        "all_unweighted": ("all", one), "spatial_only_unweighted": ("spatial_only", one),
        "quality_spatial_hard": ("quality_spatial", one), "agreement_hard": ("text_spatial_agreement", one),
        "all_quality_weighted": ("all", F.col("weight_raw")), "all_quality_weighted_class_balanced": ("all", F.col("weight_class_balanced")),
        "spatial_soft_weighted": ("all", F.col("spatial_component")), "text_agreement_soft_weighted": ("all", soft),
    }


# Columns that weights consist of.
WEIGHT_COLUMNS = ("relevance_component", "uncertainty_component", "spatial_component", "agreement_component", "weight_raw", "weight_class_balanced")


def attach_weights(rows: DataFrame, weights: DataFrame, key: str = "pageid") -> DataFrame:
    """``rows`` with the weight columns: as they are if all are there, else those of ``weights``, one row per key, in their place."""
    if set(WEIGHT_COLUMNS) <= set(rows.columns):
        return rows
    return rows.drop(*WEIGHT_COLUMNS).join(weights.select(key, *[c for c in WEIGHT_COLUMNS if c in weights.columns]), key, "left")

"""Integrity checks as violation rows, and statistics of image patches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions.columns import present
from landweave.operators.overlay import overlapping
from landweave.sources.files import empty, exists


def _violations(rows: DataFrame, check: str, key: str) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"))


def audit(articles: DataFrame, tables: Mapping[str, DataFrame], inside: DataFrame | None = None, *, key: str = "pageid") -> DataFrame:
    """``check, key`` of every violation: repeated pages, rows of unknown pages, pages without a row, blank texts, pages outside.

    ``tables`` are keyed by page, with the text to check in ``text`` if there is one; ``inside``
    has the pages that lie in a region. No rows mean that all is well.
    """
    found = _violations(articles.groupBy(key).count().where("count > 1"), "repeated article", key)
    known = articles.where(F.col(key).isNotNull()).select(key).distinct()
    for name, rows in tables.items():
        found = found.unionByName(_violations(rows.join(known, key, "left_anti").select(key).distinct(), f"{name}: unknown page", key))
        found = found.unionByName(_violations(known.join(rows.select(key), key, "left_anti"), f"{name}: no row", key))
        if "text" in rows.columns:
            found = found.unionByName(_violations(rows.where(present(F.col("text")).isNull()).select(key).distinct(), f"{name}: blank text", key))
    if inside is not None:
        found = found.unionByName(_violations(known.join(inside.select(key), key, "left_anti"), "outside the regions", key))
    return found


def consistent_targets(runs: DataFrame, *, key: str = "pageid") -> DataFrame:
    """``key, targets`` of keys whose target differs between runs."""
    return runs.where(F.col("target").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("target")).alias("targets")).where(F.size("targets") > 1)


def count_equality(predictions: DataFrame, metrics: DataFrame, groups: list[str]) -> DataFrame:
    """Groups whose metrics state another number of records than there are."""
    counted = predictions.groupBy(*groups).agg(F.count("*").alias("n_records"))
    joined = counted.join(metrics.select(*groups, F.col("n").alias("n_stated")), groups, "full")
    return joined.where(~F.col("n_records").eqNullSafe(F.col("n_stated")))


def patch_statistics(patches: DataFrame, group: str, patch: str = "patch") -> DataFrame:
    """Per group of patches (arrays of numbers): count, all-zero patches, mean, deviation, extremes; one pass."""
    rows = patches.select(group, F.posexplode(patch).alias("at", "v"), F.forall(patch, lambda v: v == 0).alias("zero"))
    return rows.groupBy(group).agg(
        F.count_if(F.col("at") == 0).alias("n"), F.count_if((F.col("at") == 0) & F.col("zero")).alias("n_zero"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def window_differences(patches: DataFrame, key: str = "pageid", window: str = "window_m", patch: str = "patch") -> DataFrame:
    """Mean absolute difference of the patches of a page between any two windows."""
    a = patches.select(key, F.col(window).alias("window_a"), F.col(patch).alias("a"))
    b = patches.select(key, F.col(window).alias("window_b"), F.col(patch).alias("b"))
    total = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, d: s + d)
    rows = a.join(b, key).where(F.col("window_a") < F.col("window_b")).withColumn("d", total / F.size("a"))
    return rows.groupBy("window_a", "window_b").agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"))


def cascade_audit(
    landcover: DataFrame, tagged: DataFrame, natural: DataFrame, articles: DataFrame, kept: DataFrame, tables: Mapping[str, DataFrame], distribution: DataFrame, paths: Sequence[str] = (), *, key: str = "pageid",
) -> DataFrame:
    """``check, key`` of every violation of what holds after the cascade; no rows mean that all is well.

    Artificial land cover; tagged polygons (``planar``) that share no area with ``natural`` ones;
    articles that are not among the ``kept``; keys of a table that the one before it, first the
    articles, does not have; artificial classes in the distribution (``id, class_label``); files
    that are missing or empty.
    """
    spark = landcover.sparkSession
    artificial = lambda c: F.coalesce(F.col(c).cast("string").startswith("1"), F.lit(False))
    found = _violations(landcover.where(artificial("code_18")).select("id").distinct(), "artificial polygon", "id")
    found = found.unionByName(_violations(tagged.select("id").join(overlapping(tagged, natural, "id"), "id", "left_anti"), "tags without land cover", "id"))
    known = articles.where(F.col(key).isNotNull()).select(key).distinct()
    found = found.unionByName(_violations(known.join(kept.select(key), key, "left_anti"), "article outside", key))
    for name, rows in tables.items():
        own = rows.where(F.col(key).isNotNull()).select(key).distinct()
        found = found.unionByName(_violations(own.join(known, key, "left_anti"), f"{name}: stale key", key))
        known = own
    found = found.unionByName(_violations(distribution.where(artificial("class_label")).select("id").distinct(), "artificial class in the distribution", "id"))
    lost = [("file missing", p) for p in paths if not exists(p)] + [("file empty", p) for p in paths if exists(p) and empty(p)]
    return found.unionByName(spark.createDataFrame(lost, "check string, key string")) if lost else found


def validate(chain: Sequence[tuple[str, DataFrame, str | None]], *, key: str = "pageid", places: Sequence[str] = ()) -> DataFrame:
    """``check, key`` of every violation along a chain of tables ``(name, rows, text column or none)``.

    The first table has each key once and the columns ``places`` filled; every other has exactly
    the keys of the one before it; texts that are named are there. Null keys are left out.
    """
    found, before = None, None
    for name, rows, text in chain:
        rows = rows.where(F.col(key).isNotNull())
        keys = rows.select(key).distinct()
        if before is None:
            checks = [_violations(rows.groupBy(key).count().where("count > 1"), f"{name}: repeated", key)]
            if places:
                lacking = F.lit(False)
                for c in places:
                    lacking = lacking | F.col(c).isNull()
                checks.append(_violations(rows.where(lacking).select(key).distinct(), f"{name}: no place", key))
        else:
            checks = [_violations(before.join(keys, key, "left_anti"), f"{name}: missing", key), _violations(keys.join(before, key, "left_anti"), f"{name}: extra", key)]
        if text is not None:
            checks.append(_violations(rows.where(F.col(text).isNull()).select(key).distinct(), f"{name}: no text", key))
        for check in checks:
            found = check if found is None else found.unionByName(check)
        before = keys
    return found


def require_consistent(runs: DataFrame, *, key: str = "pageid") -> DataFrame:
    """``key, target`` of all runs; an error if any key has different targets."""
    wrong = consistent_targets(runs, key=key).limit(5).collect()
    if wrong:
        raise ValueError(f"targets differ for {[r[key] for r in wrong]}")
    return runs.where(F.col("target").isNotNull()).select(key, "target").distinct()


#: Reflectance that is shown as white.
WHITE = 3000.0


def shown_bands(values: Column, white: float = WHITE) -> Column:
    """Reflectances as bytes for showing: 0 to ``white`` as 0 to 255, what is beyond cut off."""
    return F.transform(values, lambda v: F.floor(F.least(F.greatest(v.cast("double") / white, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def usable_patch(values: Column) -> Column:
    """A patch that is there and not zero all over."""
    return F.coalesce(F.exists(values, lambda v: v != 0), F.lit(False))

"""Samples that match target proportions of categories."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.operators.ranks import smallest_by_digest
from landweave.operators.scale import few
from landweave.session import cut_lineage


#: Counts are compared with ``share * size`` up to this much rounding error.
EPS = 1e-6


def quotas(shares: list[float], floors: list[int], available: list[int], size: int) -> list[int]:
    """Whole quotas by largest remainder, at least the floors and at most what is available.

    Shares are scaled to 1. What a capped category cannot give goes to the others in proportion
    to their shares; floors are met before proportions. The sum is ``size`` unless less is
    available, or the floors alone need more.
    """
    n = len(shares)
    low = [min(f, a) for f, a in zip(floors, available)]
    fixed: dict[int, int] = {i: low[i] for i in range(n) if not shares[i] > 0}
    while True:
        free = [i for i in range(n) if i not in fixed]
        rest = max(0, size - sum(fixed.values()))
        whole = sum(shares[i] for i in free)
        ideal = {i: rest * shares[i] / whole for i in free}
        over = {i: available[i] for i in free if ideal[i] > available[i]}
        under = {i: low[i] for i in free if ideal[i] < low[i]}
        if not over and not under:
            break
        # settle the side that changes the total more, then share out again
        lost, won = sum(ideal[i] - a for i, a in over.items()), sum(f - ideal[i] for i, f in under.items())
        fixed |= over if lost >= won else under
    result = [fixed.get(i, 0) for i in range(n)]
    for i in free:
        result[i] = math.floor(ideal[i] + 1e-9)
    short = min(size, sum(available)) - sum(result)
    by_remainder = sorted(free, key=lambda i: (result[i] - ideal[i], i))
    while short > 0:
        before = short
        for i in [*by_remainder, *(i for i in range(n) if i not in ideal and shares[i] > 0)]:
            if short > 0 and result[i] < available[i]:
                result[i] += 1
                short -= 1
        if short == before:
            break
    return result


def _allot(plan: pd.DataFrame) -> pd.DataFrame:
    plan = plan.sort_values("category", ignore_index=True)
    size = int(plan["sample_size"].max())
    plan["quota"] = quotas(
        plan["target_share"].tolist(), plan["min_rows"].tolist(), plan["available"].tolist(), size
    )
    return plan


def proportion_report(available: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per row of ``targets``: ``available``, ``needed``, ``quota``, ``short``.

    ``available`` has distinct (``field``, ``category``, key...) rows; ``targets`` has
    ``plan_id, field, category, target_share, min_rows, sample_size``. ``needed`` is the larger
    of ``min_rows`` and ``target_share * sample_size``; ``short`` tells that less is available.
    Null or negative shares, floors and sizes count as 0, rows without plan or category are left
    out, a repeated (plan, category) counts once.
    """
    zero = lambda c: F.greatest(F.coalesce(F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c)), F.lit(0)), F.lit(0))
    plans = (
        targets.where(F.col("plan_id").isNotNull() & F.col("category").isNotNull())
        .select(
            "plan_id", "field", "category",
            zero("target_share").cast("double").alias("target_share"),
            zero("min_rows").cast("long").alias("min_rows"),
            zero("sample_size").cast("long").alias("sample_size"),
        )
        .dropDuplicates(["plan_id", "field", "category"])
    )
    counts = available.groupBy("field", "category").agg(F.count("*").alias("available"))
    joined = plans.join(counts, ["field", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    fields = "plan_id string, field string, category string, target_share double, min_rows long, sample_size long, available long, quota long"
    # a plan is a short table of categories
    allotted = joined.groupBy("plan_id").applyInPandas(_allot, fields.replace("plan_id string, field string, category string", "field string, category string, plan_id string"))
    needed = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_size"))
    return allotted.withColumns({"needed": needed, "short": F.col("available") + EPS < needed})


def proportional_sample(available: DataFrame, report: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``plan_id, field, category, key``: of each category the ``quota`` smallest random keys.

    The random key is a hash of the key and the seed, alike for every plan, so a smaller sample
    is part of a larger one; a key that is available for several categories may come out for each.
    """
    report = cut_lineage(report)
    # plans are few, categories hold any part of the rows: these stay where they are
    most = few(report.groupBy("field", "category").agg(F.max("quota").alias("most")))
    ranked = smallest_by_digest(available.join(most, ["field", "category"]), ["field", "category"], [key], "most", seed)
    wanted = few(report.select("plan_id", "field", "category", "quota"))
    return ranked.join(wanted, ["field", "category"]).where(F.col("rank") <= F.col("quota")).select("plan_id", "field", "category", key)


# Usable land-cover labels, and names of the quality bins.
LABELS = ("21", "22", "23", "24", "31", "32", "33", "41", "51")
BIN_NAMES = {
    "quality_low": ("low", "faible", "basse", "bas"),
    "quality_medium": ("medium", "moyenne", "moyen"),
    "quality_high": ("high", "elevee", "eleve", "haute", "haut"),
    "quality_very_high": ("very high", "tres elevee", "tres eleve", "tres haute", "tres haut"),
}


def usable_label(text: Column) -> Column:
    """The two-digit label however written (``CLC 31``, ``clc_31``, ``31.0``, blanks, full width), or null."""
    plain = F.lower(F.translate(text, "０１２３４５６７８９．＿ＣＬｃｌ", "0123456789._CLcl"))
    pattern = r"^[\s\p{Z}\p{Cf}]*(?:clc|corine)?[\s\p{Z}\p{Cf}_:.-]*(\d\d)(?:\.0*)?[\s\p{Z}\p{Cf}]*$"
    code = F.regexp_extract(plain, pattern, 1)
    return F.when(code.isin(*LABELS), code)


def usable_bin(text: Column) -> Column:
    """The quality bin however written, in English or French, or null."""
    plain = F.translate(F.lower(text), "éèêëàâîïôûùü", "eeeeaaiiouuu")
    plain = F.regexp_replace(plain, r"[̀-ͯ\p{Cf}]", "")
    words = F.trim(F.regexp_replace(plain, r"[^a-z]+", " "))
    name = F.regexp_replace(words, r"^(quality|qualite) ", "")
    found = F.lit(None).cast("string")
    for bin_, spellings in BIN_NAMES.items():
        found = F.when(name.isin(*spellings), bin_).otherwise(found)
    return found

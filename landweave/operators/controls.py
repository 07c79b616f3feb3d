"""Random controls: samples of the same size or the same targets, scores of many draws, resampling."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landweave.functions.columns import jaccard, safe_div, surely
from landweave.operators.ranks import digest_key, smallest_by_digest


def seed_of(*parts: object) -> int:
    """64-bit seed of a SHA-256 digest of the parts."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16], 16)


def rotated(rows: DataFrame, order: str, value: str) -> DataFrame:
    """``rows`` with ``control``: the value of the next row in order, the first row's for the last.

    Rows are ranked without one task for all: range partitions are counted, each is ranked by
    itself, and offsets are added. One row keeps its own value; nulls in ``order`` are left out.
    """
    ranked = global_rank(rows.where(F.col(order).isNotNull()), order)
    total = ranked.agg(F.count("*").alias("_n"))
    following = ranked.select(F.col("rank").alias("_rank"), F.col(value).alias("control"))
    wanted = ranked.join(F.broadcast(total), F.lit(True)).withColumn("_rank", F.col("rank") % F.col("_n") + 1)
    return wanted.join(following, "_rank").drop("_rank", "_n", "rank")


def shuffled_among(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with ``shuffled_from``: another row's key, each once, by a random cycle.

    Rows in the order of their digests of seed and key hand their key to the one before, so no
    row gets its own, at any size, without a permutation on the driver; a single row keeps its
    own. ``key`` must be unique; null keys are left out.
    """
    placed = rows.where(F.col(key).isNotNull()).withColumn("_order", F.struct(digest_key([key], seed).alias("digest"), F.col(key).cast("string").alias("key")))
    ranked = global_rank(placed, "_order.digest", tie="_order.key")
    total = ranked.agg(F.count("*").alias("_n"))
    following = ranked.select(F.col("rank").alias("_rank"), F.col(key).alias("shuffled_from"))
    wanted = ranked.join(F.broadcast(total), F.lit(True)).withColumn("_rank", F.col("rank") % F.col("_n") + 1)
    return wanted.join(following, "_rank").drop("_rank", "_n", "rank", "_order")


def same_size_sample(universe: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of ``universe`` by smallest digests of seed and key; none at all if there are fewer."""
    rows = universe.where(F.col(key).isNotNull()).withColumns({"_all": F.lit(0), "_n": F.lit(n)})
    drawn = smallest_by_digest(rows, ["_all"], [key], "_n", seed).drop("_all", "_n", "rank")
    enough = drawn.agg((F.count("*") >= n).alias("_enough"))
    return drawn.join(F.broadcast(enough), F.lit(True)).where("_enough").drop("_enough")


def same_targets_sample(universe: DataFrame, observed: DataFrame, key: str, target: str, seed: int) -> DataFrame:
    """Rows of ``universe`` with as many of each target as ``observed`` has; none at all if any target has too few.

    Targets that are sets should be given as text (``label_set_key``). Null targets are left out.
    """
    wanted = observed.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("_t")).agg(F.count("*").alias("_n"))
    rows = universe.where(F.col(key).isNotNull()).join(F.broadcast(wanted), F.col(target) == F.col("_t")).drop("_t")
    drawn = smallest_by_digest(rows, [target], [key], "_n", seed).drop("rank", "_n")
    enough = wanted.agg(F.sum("_n").alias("_wanted")).join(drawn.agg(F.count("*").alias("_drawn")), F.lit(True))
    return drawn.join(F.broadcast(enough), F.lit(True)).where(F.col("_wanted") == F.col("_drawn")).drop("_wanted", "_drawn")


def selection_scores(records: DataFrame, members: DataFrame, groups: Sequence[str], labels: Sequence[str] | None, key: str = "pageid") -> DataFrame:
    """``groups, n, score`` of selected records: mean Jaccard of label sets, or with ``labels`` balanced accuracy.

    ``members`` has ``groups`` and ``key``. A record that is not ok has an empty set, or counts
    for no label. Labels that no selected record has count as 0.
    """
    rows = records.join(members, key)
    ok = surely(F.col("parse_status") == "ok")
    if labels is None:
        none = F.array().cast("array<string>")
        likeness = jaccard(F.coalesce("target", none), F.when(ok, F.coalesce("prediction", none)).otherwise(none))
        return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(likeness).alias("score"))
    seen = ok & F.col("prediction").isNotNull()
    recalls = [safe_div(F.count_if(seen & (F.col("target") == x) & (F.col("prediction") == x)), F.count_if(seen & (F.col("target") == x))) for x in labels]
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), (sum(recalls[1:], recalls[0]) / len(labels)).alias("score"))


def global_rank(rows: DataFrame, order: str, parts: int = 64, tie: str | None = None) -> DataFrame:
    """``rows`` with their ``rank`` from 1 in ``order`` (unique, or with ``tie`` among equals); ranges are ranked apart and shifted."""
    cuts = rows.select(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000)).first()[0] or []
    bucket = F.lit(0)
    for c in dict.fromkeys(cuts):
        bucket = bucket + F.when(F.col(order) > F.lit(c), 1).otherwise(0)
    placed = rows.withColumn("_bucket", bucket)
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(order, *([tie] if tie else [])))
    return placed.withColumn("_own", own).join(F.broadcast(offsets), "_bucket").withColumn("rank", F.col("_own") + F.col("_offset")).drop("_bucket", "_own", "_offset")


def target_feasible(universe: DataFrame, wanted: DataFrame, target: str = "target") -> DataFrame:
    """``target, wanted, available, feasible`` for a sample with the targets of another set."""
    a = universe.groupBy(target).agg(F.count("*").alias("available"))
    w = wanted.groupBy(target).agg(F.count("*").alias("wanted"))
    return w.join(a, target, "left").select(target, "wanted", F.coalesce("available", F.lit(0)).alias("available"), (F.coalesce("available", F.lit(0)) >= F.col("wanted")).alias("feasible"))


def _scores(hit: np.ndarray, size: np.ndarray, other: int, n: int, counts: np.ndarray | None, draws: int, seed: int) -> list[float]:
    """Balanced accuracies of random selections of ``n`` rows, or of ``counts`` rows per target.

    ``size`` rows have each label as target, ``hit`` of them are right, ``other`` rows have none
    of the labels. A selection only matters through these counts, so a draw is a multivariate
    hypergeometric sample of them, and no rows are picked.
    """
    rng = np.random.default_rng(seed)
    if counts is None:
        cells = np.r_[hit, size - hit, other]
        taken = rng.multivariate_hypergeometric(cells, min(n, int(cells.sum())), size=draws, method="marginals")
        h, m = taken[:, : len(hit)], taken[:, len(hit) : 2 * len(hit)]
    else:
        want = np.minimum(counts, size)
        h = np.stack([rng.hypergeometric(a, s - a, w, size=draws) if w else np.zeros(draws, dtype=int) for a, s, w in zip(hit, size, want)], 1)
        m = want[None] - h
    with np.errstate(invalid="ignore", divide="ignore"):
        recall = np.where(h + m > 0, h / np.maximum(h + m, 1), 0.0)
    return recall.mean(1).tolist()


def monte_carlo(members: DataFrame, universes: DataFrame, groups: Sequence[str], labels: Sequence[str], *, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Per group and subset: the observed balanced accuracy and every random one.

    ``universes`` has ``groups, pageid, target, prediction`` of parsed records; ``members`` has
    ``groups, subset, pageid``. Rows are brought down to counts per (group, subset, target,
    right) first; draws run per (group, subset) on these few counts, one short task each.
    Result: ``groups, subset, control`` (``same_n``, ``same_targets``), ``draw, score, observed, n``.
    """
    known = universes.where(F.col("target").isNotNull() & F.col("prediction").isNotNull())
    right = F.col("target") == F.col("prediction")
    whole = known.groupBy(*groups, "target", right.alias("right")).agg(F.count("*").alias("all_n"))
    inside = known.join(members, [*groups, "pageid"]).groupBy(*groups, "subset", "target", right.alias("right")).agg(F.count("*").alias("sub_n"))
    names = inside.select(*groups, "subset").distinct()
    cells = names.join(whole, list(groups)).join(inside, [*groups, "subset", "target", "right"], "left").fillna({"sub_n": 0})
    keys = [*groups, "subset"]
    order = list(labels)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        right, target = group["right"].to_numpy(dtype=bool), group["target"].to_numpy()

        def tally(column: str) -> tuple[np.ndarray, np.ndarray, int]:
            n = group[column].to_numpy(dtype=np.int64)
            size = np.array([n[target == x].sum() for x in order], dtype=np.int64)
            return np.array([n[(target == x) & right].sum() for x in order], dtype=np.int64), size, int(n.sum() - size.sum())

        everything, (hit, size, other) = tally("all_n"), tally("sub_n")
        n = int(size.sum()) + other
        observed = float(np.mean(np.where(size > 0, hit / np.maximum(size, 1), 0.0))) if order else 0.0
        first = {k: group[k].iloc[0] for k in keys}
        base = seed_of(seed, *first.values())
        out = []
        for control, counts in (("same_n", None), ("same_targets", size)):
            scores = _scores(*everything, n, counts, draws, base + (counts is not None))
            out.append(pd.DataFrame({**first, "control": control, "draw": range(draws), "score": scores, "observed": observed, "n": n}))
        return pd.concat(out)

    kinds = dict(members.dtypes) | dict(universes.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", control string, draw int, score double, observed double, n long"
    return cells.groupBy(*keys).applyInPandas(run, schema)


def bootstrap_intervals(counts: DataFrame, groups: Sequence[str], labels: Sequence[str], *, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """``groups, low, high``: bootstrap interval of the balanced accuracy.

    ``counts`` has ``groups, target, prediction, n``; resampling rows with replacement is a
    multinomial draw of these counts.
    """
    order = list(labels)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = {k: group[k].iloc[0] for k in groups}
        rng = np.random.default_rng(seed_of(seed, *first.values()))
        n = group["n"].to_numpy()
        drawn = rng.multinomial(int(n.sum()), n / n.sum(), size=draws)
        target, guess = group["target"].to_numpy(), group["prediction"].to_numpy()
        recalls = []
        for x in order:
            own = drawn[:, target == x].sum(1)
            hit = drawn[:, (target == x) & (guess == x)].sum(1)
            recalls.append(np.where(own > 0, hit / np.maximum(own, 1), 0.0))
        low, high = np.quantile(np.mean(recalls, axis=0), [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({**{k: [v] for k, v in first.items()}, "low": [low], "high": [high]})

    kinds = dict(counts.dtypes)
    return counts.groupBy(*groups).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in groups) + ", low double, high double")

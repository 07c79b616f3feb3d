"""Embeddings: completeness, normalisation, linear probes, zero-shot labels.

A probe is full-batch softmax regression on standardised features. The gradient of an epoch is
a sum over rows, so probes on many rows are trained by summing partial gradients of partitions,
keyed by training set; what travels is one matrix of features x labels for each. Sets that fit
into a task (``GATHER``) are trained in one task each, side by side, by the same epochs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from landweave.operators.metrics import supported
from landweave.operators.ranks import smallest_by_digest
from landweave.session import cut_lineage

#: A training set of at most so many values is trained in one task.
GATHER = 4_000_000


def stack_embeddings(rows: DataFrame, embeddings: DataFrame, key: str, *, allow_missing: bool = False) -> DataFrame:
    """Inner join with a check: every key of ``rows`` must have an embedding, unless missing ones are allowed."""
    if not allow_missing:
        lacking = rows.join(embeddings.select(key), key, "left_anti").limit(5).collect()
        if lacking:
            raise ValueError(f"no embedding for {[r[key] for r in lacking]}")
    return rows.join(embeddings, key)


def unit(vector: Column) -> Column:
    """The vector over its Euclidean length; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def nearest_prompt(rows: DataFrame, prompts: Sequence[tuple[str, Sequence[float]]], vector: str = "embedding") -> DataFrame:
    """``rows`` with ``prediction``: the label whose prompt vector is most alike by cosine; ties to the first label by name.

    The labels' vectors are few constants: no join.
    """
    vectors = {label: np.asarray(v, dtype=float) / (float(np.linalg.norm(v)) or 1.0) for label, v in prompts}
    # the length of a row's own vector does not change which label is nearest
    return _best_label(rows, F.col(vector), {k: (vectors[k], 0.0) for k in sorted(vectors)})


def _best_label(rows: DataFrame, features: Column, weights: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """``rows`` with the label whose weights and bias give the greatest score; the first of equal ones.

    One matrix product per Arrow batch; the labels' weights travel with the function. Null
    vectors have a null label.
    """
    names = np.asarray(list(weights), dtype=object)
    matrix = np.stack([w for w, _ in weights.values()], axis=1)
    bias = np.array([b for _, b in weights.values()])

    @F.pandas_udf(StringType())
    def label(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        known = vectors.notna().to_numpy()
        if known.any():
            out[known] = names[(np.stack(vectors[known].to_numpy()).astype(float) @ matrix + bias).argmax(1)]
        return out

    return rows.withColumn("prediction", label(features))


def mean_vectors(rows: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean of the unit vectors of each label, as ``label, embedding``.

    Every partition adds up its vectors per label; only these sums are shuffled.
    """
    kind = rows.schema[label].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            x = np.stack(batch["v"].to_numpy()).astype(float)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            for name, at in batch.groupby("label").indices.items():
                total, n = sums.get(name, (0.0, 0))
                sums[name] = (total + x[at].sum(0), n + len(at))
        if sums:
            yield pd.DataFrame({"label": list(sums), "sums": [t.tolist() for t, _ in sums.values()], "n": [n for _, n in sums.values()]})

    known = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).alias("v"))
    parts = known.mapInPandas(add, f"label {kind}, sums array<double>, n long")
    cells = parts.select("label", "n", F.posexplode("sums").alias("at", "x")).groupBy("label", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    means = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("embedding"))
    return means.withColumnRenamed("label", label)


# ---- linear probes -----------------------------------------------------------------------------


class Probe:
    """Labels, weights, bias, and the standardisation of features."""

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.labels, self.weights, self.bias, self.mean, self.scale = labels, weights, bias, mean, scale

    def scores(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale @ self.weights + self.bias

    def predict(self, features: np.ndarray) -> np.ndarray:
        """Label of the greatest score; the first by name of equal ones."""
        return np.asarray(self.labels, dtype=object)[self.scores(features).argmax(1)]


def _gradient(x: np.ndarray, hot: np.ndarray, w: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = x @ weights + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    d = (p - hot) * w[:, None]
    return x.T @ d, d.sum(0)


def fit_probe(features: np.ndarray, labels: Sequence[str], *, weights: np.ndarray | None = None, seed: int = 0, epochs: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Probe:
    """Softmax regression by gradient descent on rows in memory.

    Row weights multiply the gradient, which is divided by their sum. L2 is on the weights, not
    on the bias. A constant feature has scale 1. At least two labels are needed.
    """
    names = sorted(set(map(str, labels)))
    if len(names) < 2:
        raise ValueError("a probe needs two labels")
    x = np.asarray(features, dtype=float)
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    x = (x - mean) / scale
    hot = (np.asarray(labels, dtype=object).astype(str)[:, None] == np.asarray(names)[None]).astype(float)
    w = np.ones(len(x)) if weights is None else np.asarray(weights, dtype=float)
    model = np.random.default_rng(seed).normal(0, 0.01, (x.shape[1], len(names)))
    bias = np.zeros(len(names))
    for _ in range(epochs):
        g, b = _gradient(x, hot, w, model, bias)
        model -= rate * (g / w.sum() + l2 * model)
        bias -= rate * b / w.sum()
    return Probe(names, model, bias, mean, scale)


def fit_probes(data: DataFrame, configurations: dict[str, tuple[str, dict]], *, gather: int = GATHER) -> dict[str, Probe]:
    """A probe for each configuration ``name: (set, options)`` on a table of any size.

    ``data`` has ``y`` (text), ``x`` (numbers) and ``sets``, an array of ``set, w``: the training
    sets that hold the row, and its weight there. ``options`` are ``seed, epochs, rate, l2``. Sets
    without two labels have no probe. Weights that add up to nothing count as 1 each.
    """
    tallies = data.select("y", F.inline("sets")).groupBy("set", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()
    names: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    mass: dict[str, float] = {}
    for t in sorted(tallies, key=lambda t: t["y"]):
        names.setdefault(t["set"], []).append(t["y"])
        size[t["set"]] = size.get(t["set"], 0) + t["n"]
        mass[t["set"]] = mass.get(t["set"], 0.0) + t["w"]
    wanted: dict[str, list[str]] = {}
    for name, (of, _) in configurations.items():
        if len(names.get(of, [])) > 1:
            wanted.setdefault(of, []).append(name)
    if not wanted:
        return {}
    width = len(data.select("x").first()["x"])
    if max(size[s] for s in wanted) * width <= gather:
        return _fit_gathered(data, configurations, wanted, mass)

    data = cut_lineage(data)
    first = _sums(data, wanted, lambda of, x, y, w: x.sum(0))
    mean = {s: first[s] / size[s] for s in wanted}
    spread = _sums(data, wanted, lambda of, x, y, w: ((x - mean[of]) ** 2).sum(0))
    scale = {s: np.sqrt(spread[s] / size[s]) for s in wanted}
    for v in scale.values():
        v[v == 0] = 1.0
    models = {}
    for of, own in wanted.items():
        for name in own:
            start = np.random.default_rng(configurations[name][1]["seed"]).normal(0, 0.01, (width, len(names[of])))
            models[name] = (start, np.zeros(len(names[of])))
    for epoch in range(max(configurations[name][1]["epochs"] for name in models)):
        open_ = {s: [name for name in own if epoch < configurations[name][1]["epochs"]] for s, own in wanted.items()}

        def step(of: str, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            x = (x - mean[of]) / scale[of]
            hot = (y[:, None] == np.asarray(names[of], dtype=object)[None]).astype(float)
            w = w if mass[of] > 0 else np.ones(len(w))
            return np.concatenate([part.ravel() for name in open_[of] for part in _gradient(x, hot, w, *models[name])])

        totals = _sums(data, {s: own for s, own in open_.items() if own}, step)
        for of, total in totals.items():
            n = mass[of] if mass[of] > 0 else size[of]
            for name, part in zip(open_[of], np.split(total, len(open_[of]))):
                o, (w, b) = configurations[name][1], models[name]
                g = part[: w.size].reshape(w.shape)
                models[name] = (w - o["rate"] * (g / n + o["l2"] * w), b - o["rate"] * part[w.size :] / n)
    return {name: Probe(names[of], *models[name], mean[of], scale[of]) for of, own in wanted.items() for name in own}


def _sums(data: DataFrame, sets, each) -> dict[str, np.ndarray]:
    """Sum over the partitions of ``each(set, x, y, w)`` per set; the sums of a set meet in a task, one per set reaches the driver."""
    sets = set(sets)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            x, y = np.stack(batch["x"].to_numpy()).astype(float), batch["y"].to_numpy()
            at = np.repeat(np.arange(len(batch)), [len(s) for s in batch["sets"]])
            of = np.array([m["set"] for own in batch["sets"] for m in own], dtype=object)
            w = np.array([m["w"] for own in batch["sets"] for m in own], dtype=float)
            for name, rows in pd.Series(of).groupby(of).indices.items():
                if name in sets:
                    total[name] = total.get(name, 0.0) + each(name, x[at[rows]], y[at[rows]], w[rows])
        if total:
            yield pd.DataFrame({"set": list(total), "sums": [v.tolist() for v in total.values()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"set": [group["set"].iloc[0]], "sums": [np.sum(np.stack(group["sums"].to_numpy()), axis=0).tolist()]})

    schema = "set string, sums array<double>"
    found = data.mapInPandas(part, schema).groupBy("set").applyInPandas(add, schema).collect()
    return {r["set"]: np.array(r["sums"]) for r in found}


def _fit_gathered(data: DataFrame, configurations: dict[str, tuple[str, dict]], wanted: dict[str, list[str]], mass: dict[str, float]) -> dict[str, Probe]:
    """Every set in one task, for all its configurations."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        of = group["set"].iloc[0]
        x, y = np.stack(group["x"].to_numpy()).astype(float), group["y"].tolist()
        w = group["w"].to_numpy() if mass[of] > 0 else None
        fitted = [fit_probe(x, y, weights=w, **configurations[name][1]) for name in wanted[of]]
        return pd.DataFrame({
            "name": wanted[of], "labels": [p.labels for p in fitted], "weights": [p.weights.ravel().tolist() for p in fitted],
            "bias": [p.bias.tolist() for p in fitted], "mean": [p.mean.tolist() for p in fitted], "scale": [p.scale.tolist() for p in fitted],
        })

    rows = data.select("y", "x", F.inline("sets")).where(F.col("set").isin(*wanted))
    schema = "name string, labels array<string>, weights array<double>, bias array<double>, mean array<double>, scale array<double>"
    found = rows.groupBy("set").applyInPandas(run, schema).collect()
    return {
        r["name"]: Probe(list(r["labels"]), np.array(r["weights"]).reshape(-1, len(r["labels"])), np.array(r["bias"]), np.array(r["mean"]), np.array(r["scale"]))
        for r in found
    }


def fit_probe_distributed(rows: DataFrame, label: str, vector: str = "embedding", weight: str | None = None, *, seed: int = 0, epochs: int = 50, rate: float = 0.5, l2: float = 1e-3, gather: int = GATHER) -> Probe:
    """The same on a table of any size. Null labels and vectors do not count."""
    one = F.array(F.struct(F.lit("all").alias("set"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")))
    data = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("y"), F.col(vector).alias("x"), one.alias("sets"))
    found = fit_probes(data, {"all": ("all", {"seed": seed, "epochs": epochs, "rate": rate, "l2": l2})}, gather=gather)
    if not found:
        raise ValueError("a probe needs two labels")
    return found["all"]


def predict_probe(rows: DataFrame, probe: Probe, vector: str = "embedding") -> DataFrame:
    """``rows`` with ``prediction``: scores as expressions of constants, no Python per row."""
    weights = probe.weights / probe.scale[:, None]
    bias = probe.bias - probe.mean @ weights
    return _best_label(rows, F.col(vector), {name: (weights[:, k], bias[k]) for k, name in enumerate(probe.labels)})


def probe_grid(rows: DataFrame, members: DataFrame, policies: dict[str, tuple[str, Column]], l2s: Sequence[float], *, seed: int = 42, epochs: int = 600, rate: float = 0.1, gather: int = GATHER) -> DataFrame:
    """``policy, split, l2, key, target, prediction``: for each policy, evaluation split and L2, the split's rows as a probe labels them.

    ``rows`` has ``key, label, embedding`` and what the policies' weights need; ``members`` has
    ``key, split, tier``. A policy is a training tier and a weight. It trains on the rows of its
    tier in the split ``train_for_`` the evaluation split, which hold none of that split's keys.
    """
    known = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    training = members.where(F.col("split").startswith("train_for_")).select("key", F.expr("substring(split, 11)").alias("split"), "tier").distinct()
    held = members.where(~F.col("split").startswith("train")).select("key", "split").distinct()
    chosen = F.array(*[F.struct(F.lit(tier).alias("tier"), F.lit(policy).alias("policy"), weight.cast("double").alias("w")) for policy, (tier, weight) in policies.items()])
    own = training.groupBy("key").agg(F.collect_list(F.struct("split", "tier")).alias("own"))
    joined = known.select("key", F.col("label").alias("y"), F.col("embedding").alias("x"), chosen.alias("chosen")).join(own, "key")
    sets = F.flatten(F.transform("chosen", lambda c: F.transform(F.filter("own", lambda o: o["tier"] == c["tier"]), lambda o: F.struct(F.concat_ws("|", c["policy"], o["split"]).alias("set"), c["w"].alias("w")))))
    data = cut_lineage(joined.select("y", "x", sets.alias("sets")))
    splits = [r["split"] for r in held.select("split").distinct().orderBy("split").collect()]
    options = {"seed": seed, "epochs": epochs, "rate": rate}
    grid = {(p, s, l2): f"{p}|{s}|{l2}" for p in policies for s in splits for l2 in l2s}
    fitted = fit_probes(data, {name: (f"{p}|{s}", options | {"l2": l2}) for (p, s, l2), name in grid.items()}, gather=gather)
    by_split: dict[str, list[tuple[str, float, Probe]]] = {}
    for (p, s, l2), name in grid.items():
        if name in fitted:
            by_split.setdefault(s, []).append((p, l2, fitted[name]))

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for split, part in batch.groupby("split"):
                x = np.stack(part["embedding"].to_numpy()).astype(float)
                for policy, l2, model in by_split.get(split, []):
                    yield pd.DataFrame({"policy": policy, "split": split, "l2": l2, "key": part["key"].to_numpy(), "target": part["label"].to_numpy(), "prediction": model.predict(x)})

    scored = held.join(known.select("key", "label", "embedding"), "key").select("key", "split", "label", "embedding")
    kind = scored.schema["key"].dataType.simpleString()
    return scored.mapInPandas(guess, f"policy string, split string, l2 double, key {kind}, target string, prediction string")


def training_controls(rows: DataFrame, members: DataFrame, labels: Sequence[str], tiers: Sequence[str], *, split: str = "eval_strict", draws: int = 100, seed: int = 42, epochs: int = 600, rate: float = 0.1, l2: float = 1e-4, gather: int = GATHER) -> DataFrame:
    """``tier, control, draw, score, observed, n``: is a probe trained on a tier's rows better than on random ones?

    ``rows`` has ``key, label, embedding``; ``members`` has ``key, split, tier``. The rows of a
    tier in ``train_for_<split>`` are matched by draws from all rows of that split, as many
    (``same_n``) or with as many of each label (``same_targets``), by smallest digests. A control
    for which there are too few rows has no draws. The score is the balanced accuracy, over the
    labels that occur, on the rows of ``split``; without any of these there is no result.
    """
    known = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select("key", F.col("label").cast("string").alias("label"), "embedding")
    training = members.where(F.col("split") == f"train_for_{split}").select("key", "tier").distinct().join(known.select("key", "label"), "key")
    training = cut_lineage(training)
    universe = training.where("tier = 'all'").select("key", "label")
    sizes = {(r["tier"], r["label"]): r["n"] for r in training.groupBy("tier", "label").agg(F.count("*").alias("n")).collect()}
    have = {label: n for (tier, label), n in sizes.items() if tier == "all"}
    sets, plan = None, []
    for tier in tiers:
        own = {label: n for (t, label), n in sizes.items() if t == tier}
        if not own:
            continue
        found = training.where(F.col("tier") == tier).select("key", F.lit(f"{tier}|observed|0").alias("set"))
        sets = found if sets is None else sets.unionByName(found)
        plan.append((tier, "observed", 0))
        for control in ("same_n", "same_targets"):
            wanted = {None: sum(own.values())} if control == "same_n" else own
            there = {None: sum(have.values())} if control == "same_n" else have
            if any(n > there.get(k, 0) for k, n in wanted.items()):
                continue
            limit = F.lit(sum(own.values()))
            if control == "same_targets":
                limit = F.lit(0)
                for label, n in own.items():
                    limit = F.when(F.col("label") == label, n).otherwise(limit)
            spread = universe.withColumns({"_n": limit.cast("long"), "draw": F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))})
            spread = spread.withColumn("set", F.concat(F.lit(f"{tier}|{control}|"), "draw"))
            drawn = smallest_by_digest(spread, ["set"] if control == "same_n" else ["set", "label"], ["key"], "_n", F.concat(F.lit(f"{seed}|"), "set"), bits=4)
            sets = sets.unionByName(drawn.select("key", "set"))
            plan += [(tier, control, d) for d in range(draws)]
    schema = "tier string, control string, draw int, score double, observed double, n long"
    spark = rows.sparkSession
    if sets is None:
        return spark.createDataFrame([], schema)
    own_sets = sets.groupBy("key").agg(F.collect_list(F.struct("set", F.lit(1.0).alias("w"))).alias("sets"))
    data = cut_lineage(known.join(own_sets, "key").select(F.col("label").alias("y"), F.col("embedding").alias("x"), "sets"))
    names = {f"{t}|{c}|{d}": (t, c, d) for t, c, d in plan}
    options = {"epochs": epochs, "rate": rate, "l2": l2}
    fitted = fit_probes(data, {name: (name, options | {"seed": seed if c == "observed" else seed + d}) for name, (t, c, d) in names.items()}, gather=gather)
    held = known.join(members.where(F.col("split") == split).select("key").distinct(), "key", "left_semi")
    order = list(fitted)

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, target = np.stack(batch["embedding"].to_numpy()).astype(float), batch["label"].to_numpy()
                for name in order:
                    counts = pd.DataFrame({"set": name, "target": target, "prediction": fitted[name].predict(x)}).value_counts().reset_index(name="n")
                    yield counts

    counts = held.mapInPandas(guess, "set string, target string, prediction string, n long").groupBy("set", "target", "prediction").agg(F.sum("n").alias("n"), F.lit(True).alias("ok"), F.lit(0).alias("first"))
    scores = supported(counts, ["set"], labels).select("set", F.col("balanced_accuracy_supported").alias("score"))
    told = [(name, t, c, d, sum(n for (x, _), n in sizes.items() if x == t)) for name, (t, c, d) in names.items()]
    rows_ = spark.createDataFrame(told, "set string, tier string, control string, draw int, n long").join(scores, "set")
    observed = rows_.where("control = 'observed'").select("tier", F.col("score").alias("observed"))
    return rows_.where("control <> 'observed'").join(observed, "tier").select("tier", "control", "draw", "score", "observed", "n")

"""Splits that keep related records together.

Records tied by a shared group, directly or through a chain, form a component, and a component
lands in one split. Components with the same records of every label are interchangeable and form
a bundle, however many bundles that gives. Size by size, the largest first, a min-cost flow sends the components of every bundle
to the splits: a split has room for so many components of the size under its quota, and a
bundle's arc to a split costs what the deviations of all its labels change by. Flows
are whole numbers of components, so nothing is rounded afterwards but what the next smaller
sizes and single exchanges can repair; the members of a bundle are told apart by hash. The sizes
of the splits come first, their labels second.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.llm.components import connected_components
from landweave.operators.ranks import smallest_by_digest
from landweave.operators.scale import few, heavy_join
from landweave.session import cut_lineage

#: Exchanges are compared in blocks of at most MOST_BUNDLES x MOST_LABELS label counts; this bounds memory and has no part in the result.
MOST_BUNDLES = 5_000
MOST_LABELS = 256
#: What a record beyond the quota of its split costs; one beyond the quota of its (label, split) costs 1.
SPLIT_COST = 8
#: The components of one size are sent in so many portions, each at the costs that the ones before leave.
PORTIONS = 4


# ---- min-cost flow ---------------------------------------------------------------------------


class Flow:
    """Min-cost flow by shortest paths with potentials, all paths of one length at once, on integer capacities."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for node, other, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[node].append(len(self.to))
            self.to.append(other)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> int:
        """Send all that fits; the total cost. Costs of arcs must not be negative."""
        potential: dict[int, int] = defaultdict(int)
        total, most = 0, sum(self.cap)
        while True:
            dist, heap = {source: 0}, [(0, source)]
            while heap:
                d, node = heapq.heappop(heap)
                if d > dist[node]:
                    continue
                for e in self.out[node]:
                    if self.cap[e]:
                        nxt = self.to[e]
                        nd = d + self.cost[e] + potential[node] - potential[nxt]
                        if nd < dist.get(nxt, nd + 1):
                            dist[nxt] = nd
                            heapq.heappush(heap, (nd, nxt))
            if sink not in dist:
                return total
            far = dist[sink]
            for node in list(self.out):
                potential[node] += min(dist.get(node, far), far)
            while pushed := self._push(source, sink, most, potential, set()):
                total += pushed * (potential[sink] - potential[source])

    def _push(self, node: int, sink: int, most: int, potential: dict[int, int], seen: set[int]) -> int:
        """Send up to ``most`` on from ``node`` along arcs of shortest paths."""
        if node == sink:
            return most
        seen.add(node)
        pushed = 0
        for e in self.out[node]:
            nxt = self.to[e]
            if self.cap[e] and nxt not in seen and self.cost[e] + potential[node] == potential[nxt]:
                sent = self._push(nxt, sink, min(most - pushed, self.cap[e]), potential, seen)
                self.cap[e] -= sent
                self.cap[e ^ 1] += sent
                pushed += sent
                if pushed == most:
                    seen.discard(node)
                    break
        return pushed


def whole_quotas(total: int, shares: list[float]) -> list[int]:
    """Largest remainder: whole quotas that add up to ``total``."""
    whole = sum(shares)
    ideal = [total * s / whole for s in shares]
    quota = [int(x) for x in ideal]
    for k in sorted(range(len(shares)), key=lambda i: (quota[i] - ideal[i], i))[: total - sum(quota)]:
        quota[k] += 1
    return quota


class Counts:
    """Records per label of one component of every bundle: rows of label numbers and counts, without the zeros."""

    def __init__(self, rows: list[tuple[list[int], list[float]]]) -> None:
        self.begin = np.cumsum([0, *(len(labels) for labels, _ in rows)])
        self.label = np.array([x for labels, _ in rows for x in labels], dtype=np.int64)
        self.n = np.array([x for _, counts in rows for x in counts], dtype=float)

    @classmethod
    def of(cls, counts: Counts | np.ndarray) -> Counts:
        return counts if isinstance(counts, Counts) else cls([(np.flatnonzero(row).tolist(), row[row != 0].tolist()) for row in counts])

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.begin[i], self.begin[i + 1])
        return self.label[own], self.n[own]

    def rows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of some rows: which of them, label, count."""
        first, entries = self.begin[of], self.begin[of + 1] - self.begin[of]
        which = np.repeat(np.arange(len(of)), entries)
        at = np.arange(len(which)) + (first - np.cumsum(entries) + entries)[which]
        return which, self.label[at], self.n[at]


def _change(a: np.ndarray, b: np.ndarray, x: np.ndarray, power: int = 1) -> np.ndarray:
    """What the deviations ``a`` and ``b`` of labels (to a power) change by if ``x`` records go from the one split to the other."""
    return np.abs(a + x) ** power + np.abs(b - x) ** power - np.abs(a) ** power - np.abs(b) ** power


def allocate_bundles(bundles: list[tuple[str | dict[str, int], int, int]], shares: list[float]) -> list[list[int]]:
    """Of each bundle ``(labels, size of a component, components)``: components per split.

    ``labels`` is the one label of all records, or the records of the whole bundle per label.
    A record beyond the quota of its split costs SPLIT_COST, beyond that of its (label, split) 1.
    """
    splits = range(len(shares))
    tallies = [labels if isinstance(labels, dict) else {labels: size * n} for labels, size, n in bundles]
    names = sorted({label for tally in tallies for label in tally})
    at = {label: i for i, label in enumerate(names)}
    # records of a component per label; the mean of its bundle
    counts = Counts([([at[x] for x in tally], [n / b[2] for n in tally.values()]) for tally, b in zip(tallies, bundles)])
    sizes = np.array([b[1] for b in bundles], dtype=np.int64)
    waiting = np.array([b[2] for b in bundles], dtype=np.int64)
    quota = whole_quotas(int(sizes @ waiting), shares)
    left = list(quota)
    which, label, n = counts.rows(np.arange(len(bundles)))
    totals = np.bincount(label, weights=n * waiting[which], minlength=len(names))
    per_label = [whole_quotas(int(round(x)), shares) for x in totals.tolist()]
    label_left = np.array(per_label, dtype=float).reshape(len(names), len(shares)).T
    dealt = np.zeros((len(bundles), len(shares)), dtype=np.int64)
    for size in sorted(set(sizes.tolist()), reverse=True):
        own = np.flatnonzero(sizes == size)
        for portions in range(PORTIONS, 0, -1):
            # bundles of one size share labels, which the costs of one flow do not know of each other
            portion = -(-waiting[own] // portions)
            sent = _send(portion, counts, own, size, left, label_left)
            dealt[own] += sent
            waiting[own] -= sent.sum(1)
            which, label, n = counts.rows(own)
            for k in splits:
                left[k] -= int(sent[:, k].sum()) * size
                np.subtract.at(label_left[k], label, n * sent[which, k])
    result = [[int(n) for n in row] for row in dealt]
    _improve(bundles, result, left, label_left, counts)
    # squares first level out single large deviations where sums see no gain; with few components sums alone may do better
    found = []
    for powers in ((1,), (2, 1)):
        mine, mine_left, mine_labels = [row[:] for row in result], left[:], label_left.copy()
        for power in powers:
            _improve_labels(bundles, mine, mine_left, mine_labels, counts, power)
        found.append((float(np.abs(mine_labels).sum()), mine))
    return min(found, key=lambda f: f[0])[1]


def _steps(have: np.ndarray, room: np.ndarray, most: int) -> list[tuple[int, int]]:
    """``(components, cost of each)``: what sending up to ``most`` components of a profile changes the labels' deviations by.

    The deviation of a label falls by a component's records while they have room, and rises by
    them beyond it, so the cost of a component is convex in their number.
    """
    has = have > 0
    need, fits = have[has], np.floor(np.maximum(room[has], 0) / have[has] + 1e-9)
    steps, at = [], 0
    for edge in sorted({int(min(x, most)) for x in fits} | {most}):
        if edge > at:
            steps.append((edge - at, int(round(float(np.where(fits > at, -need, need).sum())))))
            at = edge
    return steps


def _send(portion: np.ndarray, counts: Counts, own: np.ndarray, size: int, left: list[int], label_left: np.ndarray) -> np.ndarray:
    """Components of every bundle of one size per split, at least cost, by a flow of whole components."""
    splits = range(len(left))
    flow, source, sink = Flow(), 0, 1
    total = int(portion.sum())
    arcs = []
    for i, n in enumerate(portion.tolist()):
        if not n:
            continue
        label, have = counts.row(own[i])
        node = 2 + len(left) + i
        flow.arc(source, node, n, 0)
        for k in splits:
            # costs must not be negative: a component can gain its size at most
            arcs += [(i, k, flow.arc(node, 2 + k, cap, size + cost)) for cap, cost in _steps(have, label_left[k][label], n)]
    for k in splits:
        room = max(0, left[k]) // size
        rest = max(0, left[k]) - room * size  # a component more is beyond the quota with what is not left
        flow.arc(2 + k, sink, room, 0)
        flow.arc(2 + k, sink, 1, SPLIT_COST * (size - 2 * rest) + SPLIT_COST * size)
        flow.arc(2 + k, sink, total, 2 * SPLIT_COST * size)
    flow.solve(source, sink)
    sent = np.zeros((len(portion), len(left)), dtype=np.int64)
    for i, k, e in arcs:
        sent[i, k] += flow.cap[e ^ 1]
    return sent


def _improve(bundles: list[tuple], result: list[list[int]], left: list[int], label_left: np.ndarray, counts: Counts | np.ndarray) -> None:
    """Move or exchange single components while the splits' deviation falls.

    Shifting x records from a to b helps most where x is nearest to half of the difference of
    their deviations; so for every size in a, the size in b that comes nearest is looked up.
    """
    sizes = np.array([b[1] for b in bundles], dtype=np.int64)
    counts = Counts.of(counts)
    held = np.array(result)
    splits = range(len(left))
    while bundles:
        best = (0, None)
        inside = [np.unique(sizes[held[:, k] > 0]) for k in splits]
        for a in splits:
            for b in splits:
                d = (left[b] - left[a]) / 2
                if d <= 0 or not len(inside[a]):
                    continue
                s, back = inside[a], np.r_[0, inside[b]]  # 0 is a move
                at = np.searchsorted(back, s - d)
                for near in (np.maximum(at - 1, 0), np.minimum(at, len(back) - 1)):
                    x = s - back[near]
                    gain = abs(left[a]) + abs(left[b]) - np.abs(left[a] + x) - np.abs(left[b] - x)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (int(gain[k]), (a, b, int(s[k]), int(back[near[k]])))
        if best[1] is None:
            break
        a, b, out, back = best[1]
        for size, source, target in ((out, a, b), (back, b, a)):
            if size:
                # of the components of the size, the one that suits the labels
                own = np.flatnonzero((sizes == size) & (held[:, source] > 0))
                which, label, n = counts.rows(own)
                e = own[np.bincount(which, weights=_change(label_left[source][label], label_left[target][label], n), minlength=len(own)).argmin()]
                label, n = counts.row(e)
                for k, sign in ((source, -1), (target, 1)):
                    held[e, k] += sign
                    left[k] -= sign * size
                    label_left[k, label] -= sign * n
    result[:] = [[int(n) for n in row] for row in held]


def _improve_labels(bundles: list[tuple], result: list[list[int]], left: list[int], label_left: np.ndarray, counts: Counts, power: int = 1) -> None:
    """Move or exchange single components while the labels' deviation (or the sum of its squares) falls and the splits' does not rise.

    The search goes on until no exchange is left that betters the labels; every one lowers the sum, so it ends.
    """
    if not bundles:
        return
    # the last is no component: exchanging for it is a move
    sizes = np.array([*(b[1] for b in bundles), 0])
    counts = Counts([*((label.tolist(), n.tolist()) for label, n in map(counts.row, range(len(bundles)))), ([], [])])
    block = max(1, MOST_BUNDLES * MOST_LABELS // int(np.diff(counts.begin).max()))
    held = np.vstack([np.array(result), np.full(len(left), len(bundles) + 1)])
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    # records of the component that goes, and what its labels' deviations change by if nothing comes back
    gone, alone = np.zeros(label_left.shape[1]), np.zeros(label_left.shape[1])
    changed = True
    while changed:
        changed = False
        for i in range(len(bundles)):
            label, n = counts.row(i)
            for a in np.flatnonzero(held[i]):
                for b in range(len(left)):
                    if a == b or not held[i, a]:
                        continue
                    # i goes from a to b, and records come back such that x net ones go and sizes get no worse
                    x = (0, left[b] - left[a]) if left[a] * left[b] < 0 else (-left[a], left[b])
                    lo, hi = np.searchsorted(ordered, sizes[i] - max(x), "left"), np.searchsorted(ordered, sizes[i] - min(x), "right")
                    back = order[lo:hi]
                    back = back[(held[back, b] > 0) & (back != i)]
                    if not len(back):
                        continue
                    here, there = label_left[a], label_left[b]
                    own = _change(here[label], there[label], n, power)
                    gone[label], alone[label] = n, own
                    best, j = 1e-6, -1
                    for start in range(0, len(back), block):
                        part = back[start : start + block]
                        which, of, m = counts.rows(part)
                        gain = -own.sum() - np.bincount(which, weights=_change(here[of], there[of], gone[of] - m, power) - alone[of], minlength=len(part))
                        at = int(gain.argmax())
                        if gain[at] > best:
                            best, j = gain[at], part[at]
                    gone[label], alone[label] = 0, 0
                    if j >= 0:
                        held[i, a], held[i, b] = held[i, a] - 1, held[i, b] + 1
                        if j < len(bundles):
                            held[j, a], held[j, b] = held[j, a] + 1, held[j, b] - 1
                        for (of, m), sign in (((label, n), 1), (counts.row(j), -1)):
                            here[of] += sign * m
                            there[of] -= sign * m
                        net = int(sizes[i] - sizes[j])
                        left[a], left[b] = left[a] + net, left[b] - net
                        changed = True
    result[:] = [[int(n) for n in row] for row in held[:-1]]


# ---- the operator ----------------------------------------------------------------------------


def whole_pair(text: Column) -> Column:
    """Canonical ``a_b`` of two whole numbers however written: blanks, leading zeros, ``.0``, full
    width; null for anything else."""
    plain = F.translate(text, "０１２３４５６７８９＿．－", "0123456789_.-")
    pattern = r"^[\s\p{Z}\p{Cf}(\[]*([+-]?\d+)(?:\.0*)?[\s\p{Z}\p{Cf}]*[_,;:/|x\s\p{Z}-][\s\p{Z}\p{Cf}]*([+-]?\d+)(?:\.0*)?[\s\p{Z}\p{Cf})\]]*$"
    part = lambda n: F.regexp_extract(plain, pattern, n).try_cast("decimal(38,0)").cast("string")
    return F.when(plain.rlike(pattern), F.concat_ws("_", part(1), part(2)))


def related_splits(
    records: DataFrame,
    key: str,
    group: Column,
    shares: dict[str, float],
    *,
    label: Column | None = None,
    flags: dict[str, Column] | None = None,
    seed: int = 0,
) -> DataFrame:
    """One row per ``key``: ``component``, ``size``, ``split``, and of every flag ``name`` and ``name_tied``.

    ``group`` ties the keys that share it; null ties nothing, and a key without a group is a
    component by itself. ``flags`` are conditions on rows: ``name`` tells whether any row of the
    key meets it, ``name_tied`` whether any row of its component does. Rows with a null key are
    left out; repeats count once; an empty input gives an empty result. ``label`` only steers
    the balance (null counts as an empty label).

    The bundles, one per size and counts of labels that occur, reach the driver, and their
    splits are found there; there is no limit to their number.
    """
    flags = flags or {}
    rows = records.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"),
        group.alias("group"),
        (label.cast("string") if label is not None else F.lit(None).cast("string")).alias("label"),
        *[F.coalesce(c, F.lit(False)).alias(f"f_{n}") for n, c in flags.items()],
    )
    any_flag = [F.max(f"f_{n}").alias(f"f_{n}") for n in flags]
    held = rows.groupBy("key", "group").agg(F.min("label").alias("label"), *any_flag)
    keys = held.groupBy("key").agg(
        F.min("group").alias("first"), F.max("group").alias("last"), F.min("label").alias("label"), *any_flag
    )
    # only a key with several groups ties groups together
    ties = keys.where(F.col("first") < F.col("last")).select("key", "first")
    edges = held.join(ties, "key").where(F.col("group") != F.col("first")).select("group", "first").distinct()
    roots = connected_components(edges).select(F.col("node").alias("first"), "root")

    # a group may hold a third of all keys: both joins on it are spread over salts
    salts = 16
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    spread = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = keys.withColumn("salt", salt).join(spread, ["first", "salt"], "left")
    alone = F.concat(F.lit("alone:"), F.col("key").cast("string"))
    placed = placed.withColumn("component", F.coalesce(F.concat(F.lit("group:"), F.coalesce("root", "first")), alone))

    placed = cut_lineage(placed.select("key", "label", "component", *[f"f_{n}" for n in flags]))

    named = placed.withColumn("label", F.coalesce("label", F.lit("")))
    counts = named.groupBy("component", "label").agg(F.count("*").alias("n"), *any_flag)
    components = counts.groupBy("component").agg(
        F.sum("n").alias("size"),
        F.array_sort(F.collect_list(F.struct("label", "n"))).alias("tally"),
        *[F.max(f"f_{n}").alias(f"{n}_tied") for n in flags],
    )
    components = cut_lineage(components.select("component", "size", "tally", *[f"{n}_tied" for n in flags]))
    components = components.withColumn("profile", F.md5(F.to_json("tally")))
    bundles = components.groupBy("size", "profile").agg(F.count("*").alias("n"), F.any_value("tally").alias("tally")).toPandas()
    bundles["text"] = [",".join(f"{t['label']}:{t['n']}" for t in tally) for tally in bundles["tally"]]
    bundles = bundles.sort_values(["size", "text", "profile"], ascending=[False, True, True], ignore_index=True)
    names = list(shares)
    dealt = allocate_bundles(
        [({t["label"]: int(t["n"]) * int(n) for t in tally}, int(s), int(n)) for tally, s, n in zip(bundles["tally"], bundles["size"], bundles["n"])],
        [shares[n] for n in names],
    ) if len(bundles) else []
    spark = records.sparkSession
    bounds = []
    for (size, prof), per_split in zip(bundles[["size", "profile"]].itertuples(index=False), dealt):
        low = 0
        for name, n in zip(names, per_split):
            if n:
                bounds.append((int(size), prof, name, low, low + n))
                low += n
    bounds_df = spark.createDataFrame(bounds, "b_size long, b_profile string, split string, low long, high long")
    whole = F.lit(2**62)
    ranked = smallest_by_digest(components.withColumn("_all", whole), ["size", "profile"], ["component"], "_all", seed)
    # a bundle may hold any part of the components; the bounds are one row per bundle and split
    chosen = ranked.join(
        few(bounds_df),
        (F.col("size") == F.col("b_size")) & (F.col("profile") == F.col("b_profile")) & (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high")),
    ).select("component", "size", "split", *[f"{n}_tied" for n in flags])
    total = int((bundles["n"] * bundles["size"]).sum())
    joined = heavy_join(placed.select("key", "component", *[f"f_{n}" for n in flags]), chosen, "component", "size", total)
    return joined.select(
        F.col("key").alias(key), "component", "size", "split", *[x for n in flags for x in (F.col(f"f_{n}").alias(n), F.col(f"{n}_tied"))]
    )

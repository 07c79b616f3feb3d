"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.operators.scale import LIGHT, heavy_join
from landweave.session import cut_lineage


def _tidy(edges: DataFrame) -> DataFrame:
    """Edges from the greater to the smaller node, each once."""
    up = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return up.where(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's smallest neighbour.

    The root of a large star is a node with many rows: the join spreads it.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    tied = heavy_join(both, least, "u", "n", 2 * n).where(F.col("v") > F.col("u"))
    return _tidy(tied.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = heavy_join(edges, least, "u", "n", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _tidy(tied.unionByName(least.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node that has an edge.

    ``edges`` has two columns of one orderable type; nulls, loops, repeats and both directions
    are allowed. Only node keys travel; every round is written to the checkpoint folder, so a
    lost executor costs one round. Nothing but two numbers per round reaches the driver.

    Every round keeps each component connected and, until all are stars at their smallest node,
    lowers the sum of the nodes' smallest neighbours, so it ends; the number of rounds grows
    with the square of the logarithm of the nodes at most (Kiveris et al., 2014), about as the
    logarithm in practice. There is no limit of rounds.
    """
    a, b = edges.columns
    named = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    stars, seen = cut_lineage(_tidy(named)), None
    state = _state(stars)
    while state != seen:
        seen = state
        large = _large_star(stars, state[0])
        if state[0] > LIGHT:  # then the plan has two ways of joining, and the small star reads it several times
            large = cut_lineage(large)
        stars = cut_lineage(_small_star(large, state[0]))  # a large star has at most the edges that it was made of
        state = _state(stars)
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

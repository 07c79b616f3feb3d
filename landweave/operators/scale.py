"""Joins that hold when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has more than one row in HEAVY of the total; at most HEAVY keys are ...
HEAVY = 1000
#: ... and if it has more rows than this: fewer are no burden for a task.
LIGHT = 100_000


def heavy_join(rows: DataFrame, side: DataFrame, on: str, count: str, total: int, light: int = LIGHT) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row per ``on`` with its number of ``rows``.

    ``total`` is the sum of those counts: then there are fewer than ``HEAVY`` heavy keys, as each
    has more than its share of it. They are broadcast and their rows stay where they are; the
    rest meets in a shuffle in which no key has more than one row in ``HEAVY``. A smaller total
    costs time, never rows. Where all rows together are ``light``, the plain join is the plan.
    """
    if total <= light:
        return rows.join(side, on)
    heavy = (F.col(count) * HEAVY > total) & (F.col(count) > light)
    few = F.broadcast(side.where(heavy).withColumn("_heavy", F.lit(True)))
    tagged = rows.join(few, on, "left")
    here = tagged.where(F.col("_heavy")).drop("_heavy")
    rest = rows.join(few.select(on), on, "left_anti").join(side.where(~heavy), on)
    return here.unionByName(rest)


#: Rows that are broadcast; a table of more is met in a shuffle.
BROADCAST = 100_000


def few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most BROADCAST rows; the number is counted, not guessed.

    ``df`` should be cheap to read twice, as from a checkpoint.
    """
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns that are computed once per row.

    A filter on a plain column is pushed below it, with the column's expression copied into it;
    an expensive expression would be computed several times. Nothing is pushed through a
    generator.
    """
    whole = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = df.select("*", F.explode(F.array(whole)).alias("_evaluated"))
    return kept.select(*df.columns, *[F.col("_evaluated")[n].alias(n) for n in columns])

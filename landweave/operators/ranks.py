"""Rank of rows by a digest within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest_key(columns: list[str], seed: Column | int) -> Column:
    """A reproducible number of 60 bits per row: the first 15 hex digits of the MD5 of ``seed:a:b...``.

    Nulls are left out of the text, so they should not be in ``columns``.
    """
    start = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws(":", start.cast("string"), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def smallest_by_digest(df: DataFrame, groups: list[str], key: list[str], limit: str, seed: Column | int, bits: int = 12) -> DataFrame:
    """The rows of ``df`` with their ``rank`` (from 1) by digest within ``groups``, where rank <= ``limit``.

    ``key`` must be unique within a group; ``limit`` is a column that is constant in a group.
    Null groups are groups of their own. A group is never gathered: rows fall into ``2**bits``
    buckets by the first bits of the digest, counts of buckets give offsets, and only rows of
    one bucket are ordered against each other. Buckets that begin beyond the limit are left out
    before anything is sorted.
    """
    hashed = df.withColumn("_digest", digest_key(key, seed)).withColumn("_bucket", F.shiftright("_digest", 60 - bits).cast("int"))
    counts = hashed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    named = offsets.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(groups)} | {"_bucket": "_of_bucket"})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(groups)] + [F.col("_bucket") == F.col("_of_bucket")]
    joined = hashed.join(named, same).drop(*[f"_of_{i}" for i in range(len(groups))], "_of_bucket")
    within = Window.partitionBy(*groups, "_bucket").orderBy("_digest", *key)
    return (
        joined.where(F.col("_offset") < F.col(limit))
        .withColumn("rank", F.col("_offset") + F.row_number().over(within))
        .where(F.col("rank") <= F.col(limit))
        .drop("_digest", "_bucket", "_offset")
    )

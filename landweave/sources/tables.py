"""The parquet tables of a scale folder, and the current row of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, key: str, stamp: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``stamp``.

    A null stamp is older than any other. Rows that tie give the greatest tuple of ``columns``,
    so that the result does not depend on file order. Rows with a null key have no page and are
    left out. Only ``key``, ``stamp`` and ``columns`` are read.
    """
    newest = F.max(F.struct(F.col(stamp).alias("_stamp"), *[F.col(c) for c in columns])).alias("_newest")
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(newest)
    return rows.select(key, *[F.col("_newest")[c].alias(c) for c in columns])


def with_default_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``df`` with every missing column of ``defaults`` added."""
    missing = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df

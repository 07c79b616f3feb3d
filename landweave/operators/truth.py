"""Ground truth by place: labels of the polygons that hold a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.operators.regions import locate, prepared_regions


def point_labels(points: DataFrame, regions: DataFrame, *, key: str = "pageid", x: str = "lon", y: str = "lat") -> DataFrame:
    """``key, labels``: the distinct labels (column ``label``) of the prepared regions around every point that has any."""
    found = locate(points.select(key, x, y), x, y, regions).where(F.col("label").isNotNull())
    return found.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def single_label_truth(points: DataFrame, regions: DataFrame, **names: str) -> DataFrame:
    """``key, target`` of points with exactly one label; several polygons of one label are one."""
    labels = point_labels(points, regions, **names)
    return labels.where(F.size("labels") == 1).select(labels.columns[0], F.col("labels")[0].alias("target"))


def multi_label_truth(points: DataFrame, regions: DataFrame, *, key: str = "pageid", x: str = "lon", y: str = "lat") -> DataFrame:
    """``key, target`` (sorted array) of points in regions whose column ``labels`` is an array."""
    found = locate(points.select(key, x, y), x, y, regions).select(key, F.explode("labels").alias("label"))
    return found.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("target"))


def in_either(points: DataFrame, one: DataFrame | None, other: DataFrame | None, *, key: str = "pageid", x: str = "lon", y: str = "lat") -> DataFrame:
    """Points in a region of either set; with one set given only that counts, without any all pass."""
    given = [r for r in (one, other) if r is not None]
    if not given:
        return points
    keys = None
    for regions in given:
        found = locate(points.select(key, x, y), x, y, regions).select(key)
        keys = found if keys is None else keys.unionByName(found)
    return points.join(keys.distinct(), key, "left_semi")


def labeled_regions(polygons: DataFrame, label: Column, keep: Column, *, name: str = "label") -> DataFrame:
    """Prepared regions with a label column, of the polygons that ``keep`` holds for."""
    rows = polygons.where(keep).withColumn(name, label).where(F.col(name).isNotNull())
    return prepared_regions(rows, "id", "geometry", [name])

"""Report jobs: each is a dictionary of tables made from records and metadata, and can be written as a folder.

All of them are the same composition: join metadata once, expand to subsets, count once, derive
metrics, distributions and differences from the counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave import vocab
from landweave.operators import controls, metrics, reports, subsets
from landweave.sources import sinks

LABELS = list(vocab.LEVEL2_LABELS)
DELTAS = ("accuracy", "balanced_accuracy", "macro_f1")
SET_DELTAS = ("exact_match", "micro_f1", "jaccard")
KEYS = ("subset", "model")


def source_order(column: Column) -> Column:
    """Place of a text source in reports; unknown ones last, by name."""
    place = F.lit(len(vocab.TEXT_SOURCES))
    for i, name in enumerate(vocab.TEXT_SOURCES):
        place = F.when(column == name, i).otherwise(place)
    return F.struct(place.alias("place"), column.alias("name"))


def _pairs(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(pairs.items()), "base string, other string")


def subset_report(records: DataFrame, metadata: DataFrame, named: Mapping[str, Column], *, labels: Sequence[str] = LABELS, pairs: Mapping[str, str] = vocab.SHUFFLED_OF, order: str = "row_idx", task: str = "corine_level2") -> dict[str, DataFrame]:
    """``coverage, metrics, per_class, distribution, shuffled_deltas, model_comparison`` of records by subset.

    For label sets (task ``osm``) ``per_class`` is left out, and differences are of exact matches,
    micro F1 and Jaccard.

    ``records`` has ``pageid, model, text_source, target, prediction, parse_status`` and ``order``;
    ``metadata`` one row per page. Subsets without a record give no rows.
    """
    marked = metadata.withColumn("_there", F.lit(True))
    joined = records.join(marked, "pageid", "left")
    coverage = joined.groupBy("model", "text_source").agg(F.count("*").alias("n_records"), F.count("_there").alias("n_with_metadata"))
    groups = [*KEYS, "text_source"]
    rows = subsets.expand(joined, named)
    if task != "corine_level2":
        table = metrics.task_metrics(rows, task, groups, labels, order)
        return {
            "coverage": coverage,
            "metrics": table,
            "distribution": metrics.class_distribution(rows.select(*groups, F.explode("target").alias("label")), list(groups), "label", labels),
            "shuffled_deltas": metrics.paired_deltas(table, list(KEYS), "text_source", _pairs(records, pairs), SET_DELTAS),
            "model_comparison": metrics.first_two_models(table, ["subset", "text_source"], SET_DELTAS),
        }
    counts = metrics.confusion_counts(rows, groups, order)
    table = metrics.single_label(counts, groups, labels)
    return {
        "coverage": coverage,
        "metrics": table,
        "per_class": metrics.per_label(counts, groups, labels),
        "distribution": metrics.class_distribution(rows, list(groups), "target", labels),
        "shuffled_deltas": metrics.paired_deltas(table, list(KEYS), "text_source", _pairs(records, pairs), DELTAS),
        "model_comparison": metrics.first_two_models(table, ["subset", "text_source"], DELTAS),
    }


def spatial_report(records: DataFrame, spatial: DataFrame) -> dict[str, DataFrame]:
    """Six subsets by spatial confidence."""
    known = subsets.registry()
    names = ("point_label_share_250m_ge_0.8", "point_label_share_500m_ge_0.8", "point_label_share_250m_ge_0.9", "dominant_matches_point_label_250m", "dominant_matches_point_label_500m")
    named = {"all_available_spatial_confidence": F.col("_there").isNotNull()} | {n: known[n][1] for n in names if all(c in spatial.columns for c in known[n][0])}
    return subset_report(records, spatial, named)


def relevance_report(records: DataFrame, metadata: DataFrame) -> dict[str, DataFrame]:
    """Subsets by relevance, by relevance and spatial share, by evidence type; distributions of the metadata."""
    named = subsets.relevance_subsets() | subsets.relevance_and_spatial_subsets() | subsets.evidence_type_subsets()
    tables = subset_report(records, metadata, named)
    tables["metadata_distribution"] = reports.value_counts(metadata, ["landcover_relevance", "uncertainty"])
    return tables


def article_type_report(records: DataFrame, metadata: DataFrame) -> dict[str, DataFrame]:
    """The lattice of article type, relevance and spatial share; each subset once."""
    tables = subset_report(records, metadata, subsets.lattice())
    tables["type_distribution"] = reports.value_counts(metadata, ["primary_article_type"])
    tables["audit_sample"] = reports.head_per_group(metadata.select("primary_article_type", "pageid"), ["primary_article_type"], [F.asc("pageid")], 20)
    tables["join_counts"] = metadata.agg(F.count("*").alias("n_loaded"), F.count_distinct("pageid").alias("n_unique"), F.count_if(F.col("primary_article_type").isNull()).alias("n_without_type"))
    return tables


def quality_report(records: DataFrame, metadata: DataFrame) -> dict[str, DataFrame]:
    """Subsets by quality, and distributions of bins and uses."""
    known = {n: c for n, (needed, c) in subsets.registry().items() if all(x in metadata.columns for x in needed)}
    tables = subset_report(records, metadata, known)
    tables["bins"] = reports.value_counts(metadata, ["quality_bin", "recommended_use"])
    return tables


def text_source_report(records: DataFrame, metadata: DataFrame, comparisons: Sequence[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    """Cards, highlights or windows against their shuffled controls and against other sources; agreement of two models."""
    tables = subset_report(records, metadata, subsets.quality_subsets())
    if comparisons:
        pairs = records.sparkSession.createDataFrame(list(comparisons), "base string, other string")
        tables["comparisons"] = metrics.paired_deltas(tables["metrics"], list(KEYS), "text_source", pairs, DELTAS)
    models = [r[0] for r in records.select("model").distinct().orderBy("model").limit(2).collect()]
    if len(models) == 2:
        tables["agreement"] = metrics.model_agreement(records, ["text_source"], (models[0], models[1]))
    return tables


def control_report(records: DataFrame, metadata: DataFrame, *, draws: int = 1000, seed: int = 42, labels: Sequence[str] = LABELS) -> dict[str, DataFrame]:
    """Every registered subset against random subsets of its size and of its targets, and the reading of it."""
    known = {n: c for n, (needed, c) in subsets.registry().items() if all(x in metadata.columns for x in needed)}
    parsed = records.where("parse_status = 'ok'").join(metadata, "pageid", "left")
    members = subsets.expand(parsed, known).select("model", "text_source", "subset", "pageid")
    universe = parsed.select("model", "text_source", "pageid", "target", "prediction")
    drawn = controls.monte_carlo(members, universe, ["model", "text_source"], labels, draws=draws, seed=seed)
    summary = reports.draw_summary(drawn, ["model", "text_source", "subset", "control"], "score", "observed")
    pick = lambda c: F.max(F.when(F.col("control") == c, F.col("percentile")))
    reading = summary.groupBy("model", "text_source", "subset").agg(pick("same_n").alias("same_n"), pick("same_targets").alias("same_targets"))
    return {"summary": summary, "conclusions": reading.withColumn("conclusion", reports.conclusion(F.col("same_n"), F.col("same_targets")))}


def overview(records: DataFrame, *, labels: Sequence[str] = LABELS, order: str = "row_idx") -> dict[str, DataFrame]:
    """One row per model and text source, in the order of reports, with differences to the shuffled control."""
    groups = ["model", "text_source"]
    table = metrics.single_label(metrics.confusion_counts(records, groups, order), groups, labels)
    deltas = metrics.paired_deltas(table, ["model"], "text_source", _pairs(records, vocab.SHUFFLED_OF), DELTAS)
    return {"overview": table.orderBy("model", source_order(F.col("text_source"))), "shuffled_deltas": deltas}


def write(tables: Mapping[str, DataFrame], folder: str, title: str) -> None:
    """Each table as CSV and Markdown, and a manifest with their digests."""
    for name, table in tables.items():
        sinks.write_report(sinks.flat(table), folder, name, table.columns, f"{title}: {name.replace('_', ' ')}")
    sinks.write_manifest(f"{folder}/manifest.json", {n: f"{folder}/{n}.md" for n in tables}, title=title, tables=sorted(tables))

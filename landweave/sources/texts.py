"""Text sources by name: which table and column each has, and its shuffled control."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave import vocab
from landweave.operators.controls import shuffled_among

# Table and column of every text source.
WHERE = {
    "summary": ("summaries", "summary"),
    "summary_no_place": ("summaries_no_place", "summary"),
    "content": ("contents", "content"),
    "landuse_evidence_summary": ("evidence", "landuse_evidence_summary"),
    "evidence_card": ("cards", "evidence_card"),
    "content_with_evidence_card": ("cards", "content_with_evidence_card"),
    "content_with_evidence_highlights": ("highlights", "content_with_evidence_highlights"),
    "retrieved_evidence_windows": ("windows", "retrieved_evidence_windows"),
    "retrieved_evidence_sentences_only": ("windows", "retrieved_evidence_sentences_only"),
    "random_sentence_windows": ("windows", "random_sentence_windows"),
    "retrieved_evidence_windows_no_place": ("windows", "retrieved_evidence_windows_no_place"),
}
_BASE = {shuffled: base for base, shuffled in vocab.SHUFFLED_OF.items()}


def base_source(source: str) -> str:
    """The source whose texts a shuffled one has; any other is its own."""
    return _BASE.get(source, source)


def text_source(source: str, tables: Mapping[str, DataFrame], *, key: str = "pageid") -> DataFrame:
    """``key, text`` of a source, of its base if it is a shuffled one; a null text of contents is empty.

    Only the table that is asked for must be there.
    """
    base = base_source(source)
    if base not in WHERE:
        raise ValueError(f"unknown text source: {source}")
    name, column = WHERE[base]
    if name not in tables:
        raise ValueError(f"{source} needs the table {name}")
    text = F.coalesce(F.col(column), F.lit("")) if base == "content" else F.col(column)
    return tables[name].where(F.col(key).isNotNull()).select(key, text.alias("text"))


def classified_texts(source: str, texts: DataFrame, targets: DataFrame, *, seed: int = 42, key: str = "pageid", limit: int | None = None, order: str | None = None) -> DataFrame:
    """``key, target, text, shuffled_from`` of the texts that have a target; of a shuffled source, each with another's text.

    ``limit`` takes the first ones in ``order``, a unique column of ``texts``.
    """
    rows = texts.join(targets.select(key, "target"), key)
    if limit is not None:
        rows = rows.orderBy(order or key).limit(limit)
    if base_source(source) == source:
        return rows.select(key, "target", "text", F.lit(None).cast("string").alias("shuffled_from"))
    given = shuffled_among(rows, key, seed)
    others = rows.select(F.col(key).alias("shuffled_from"), F.col("text").alias("other"))
    return given.join(others, "shuffled_from").select(key, "target", F.col("other").alias("text"), "shuffled_from")


def prediction_records(rows: DataFrame, source: str, fingerprint: str, *, key: str = "pageid") -> DataFrame:
    """Records as they are stored: ``rows`` with a ``metadata`` map of fingerprint, text digest and what a shuffled source adds.

    ``rows`` has ``key, text, shuffled_from`` and may have ``metadata`` (a map of text) already;
    the record's own entries win.
    """
    own = [F.lit("fingerprint"), F.lit(fingerprint), F.lit("text_sha256"), F.sha2(F.coalesce("text", F.lit("")), 256)]
    if base_source(source) != source:
        own += [F.lit("text_control"), F.lit("shuffled"), F.lit("base_text_source"), F.lit(base_source(source)), F.lit("shuffled_from_pageid"), F.col("shuffled_from").cast("string")]
    made: Column = F.create_map(*own)
    if "metadata" in rows.columns:
        mine = F.map_keys(made)
        made = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(mine, k)), made)
    return rows.withColumn("metadata", made).drop("text", "shuffled_from")

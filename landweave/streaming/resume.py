"""Resumable batches: what is fresh is kept, what is stale or failed is computed again.

There is no stream here: a run reads the last snapshot, plans by a join, computes the rest, and
writes the next snapshot. Every record carries the digest of its text and the fingerprint of
the run's settings.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions.columns import bound, surely, text_digest
from landweave.functions.payloads import EVIDENCE_FIELDS, evidence_payload
from landweave.sources.files import exists


def settings_fingerprint(**settings: object) -> str:
    """SHA-256 of the settings as sorted JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def is_fresh(status: Column, old_text: Column, old_fingerprint: Column, text: Column, fingerprint: str, *, retry_failed: bool = False) -> Column:
    """May a record be kept? Only an ok one of the same text; of other settings only if just failures are retried."""
    same = surely((status == "ok") & (old_text == text))
    return same if retry_failed else same & surely(old_fingerprint == fingerprint)


def plan(inputs: DataFrame, snapshot: DataFrame, fingerprint: str, *, key: str = "pageid", text: str = "text", retry_failed: bool = False) -> DataFrame:
    """``inputs`` with ``text_sha256`` and ``action``: ``keep`` or ``compute``; one row per input.

    ``snapshot`` has ``key, parse_status, text_sha256, fingerprint``, one row per key.
    """
    old = snapshot.select(F.col(key).alias("_key"), F.col("parse_status").alias("_status"), F.col("text_sha256").alias("_text"), F.col("fingerprint").alias("_fingerprint"))
    rows = inputs.withColumn("text_sha256", text_digest(F.col(text))).join(old, F.col(key) == F.col("_key"), "left")
    fresh = is_fresh(F.col("_status"), F.col("_text"), F.col("_fingerprint"), F.col("text_sha256"), fingerprint, retry_failed=retry_failed)
    return rows.withColumn("action", F.when(fresh, "keep").otherwise("compute")).drop("_key", "_status", "_text", "_fingerprint")


def next_snapshot(planned: DataFrame, snapshot: DataFrame, compute: Callable[[DataFrame], DataFrame], fingerprint: str, *, key: str = "pageid") -> DataFrame:
    """The kept records of the snapshot and the computed ones, with digests and fingerprint.

    ``compute`` gets the inputs to compute and returns ``key`` with ``parse_status`` and results.
    Write it to a new place before the old one is dropped.
    """
    kept = snapshot.join(planned.where("action = 'keep'").select(key), key, "left_semi")
    wanted = planned.where("action = 'compute'")
    made = compute(wanted).join(wanted.select(key, "text_sha256"), key).withColumn("fingerprint", F.lit(fingerprint))
    return kept.unionByName(made, allowMissingColumns=True)


def missing_only(wanted: DataFrame, have: DataFrame, value: str, *, key: str = "pageid") -> DataFrame:
    """Keys that have no sane value yet (null or blank does not count), each once."""
    sane = have.where(F.length(F.trim(F.coalesce(F.col(value), F.lit("")))) > 0).select(key)
    return wanted.where(F.col(key).isNotNull()).select(key).distinct().join(sane, key, "left_anti")


def cascade(tables: dict[str, DataFrame], kept: DataFrame, *, key: str = "pageid", dry_run: bool = False) -> dict[str, DataFrame]:
    """Each table brought down to the kept keys; a dry run gives counts before and after instead."""
    pruned = {n: t.join(kept.select(key).distinct(), key, "left_semi") for n, t in tables.items()}
    if not dry_run:
        return pruned
    return {n: t.agg(F.count("*").alias("before")).join(pruned[n].agg(F.count("*").alias("after")), F.lit(True)) for n, t in tables.items()}


def cascade_counts(steps: Mapping[str, tuple[DataFrame, DataFrame]], kept: DataFrame, tables: Mapping[str, DataFrame], *, key: str = "pageid") -> DataFrame:
    """Dry run of the whole cascade: ``name, before, after`` of each step (rows, rows that stay) and then of the tables.

    Every table is brought down to the keys that stayed in the one before it, the first one to ``kept``.
    """
    def counts(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
        both = before.agg(F.count("*").alias("before")).join(after.agg(F.count("*").alias("after")), F.lit(True))
        return both.select(F.lit(name).alias("name"), "before", "after")

    parts = [counts(name, before, after) for name, (before, after) in steps.items()]
    keys = kept.select(key).distinct()
    for name, rows in tables.items():
        pruned = rows.join(keys, key, "left_semi")
        parts.append(counts(name, rows, pruned))
        keys = pruned.select(key).distinct()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


# ---- records of summaries and evidence ---------------------------------------------------------

# Fixed value: what older records of summaries without places have in their prompt.
NO_PLACE_PROMPT = "sans jamais mentionner le nom du lieu décrit"


def summary_is_current(summary: Column, metadata: Column, mode: str) -> Column:
    """Is a summary there and of the mode ``place`` or ``no_place``? Records without a mode are told by their prompt; ``metadata`` is a map of text."""
    stated, prompt = metadata["summary_mode"], metadata["prompt"]
    told = prompt.isNotNull() & (F.contains(prompt, F.lit(NO_PLACE_PROMPT)) == F.lit(mode == "no_place"))
    return summary.isNotNull() & surely((stated == mode) | told)


def evidence_is_current(title: Column, expected: Mapping[str, str] | None = None, metadata: Column | None = None) -> Column:
    """Would a stored evidence record pass again as a response, with the stated counts, and with the expected metadata?

    The record's fields are columns; the counts may be text. What is missing is not current.
    """
    payload = evidence_payload(F.to_json(F.struct(*EVIDENCE_FIELDS)), title)
    number = lambda c: F.col(c).cast("string").try_cast("double")
    counted = lambda p: surely(
        p["error"].isNull() & (F.length(p["landuse_evidence_summary"]) == number("landuse_evidence_summary_char_count")) & (F.size(p["evidence_sentences_no_place"]) == number("evidence_sentences_count"))
    )
    current = bound(payload, counted)
    for name, value in (expected or {}).items():
        current = current & surely(metadata[name] == value)
    return current


def resumed(snapshot: DataFrame, inputs: DataFrame, current: Column, *, key: str = "pageid") -> tuple[DataFrame, DataFrame]:
    """What of a snapshot is kept, and the inputs that are still to be done.

    Records that are current or whose key is no input are kept, failed and stale ones go, and
    every input without a current record is to be done, each key once.
    """
    wanted = inputs.where(F.col(key).isNotNull()).dropDuplicates([key])
    judged = snapshot.withColumn("_current", surely(current))
    asked = wanted.select(F.col(key).alias("_asked"))
    kept = judged.join(asked, F.col(key) == F.col("_asked"), "left").where(F.col("_current") | F.col("_asked").isNull()).drop("_current", "_asked")
    return kept, wanted.join(judged.where("_current").select(key), key, "left_anti")


def run_in_batches(inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], folder: str, *, key: str = "pageid", batches: int = 32) -> DataFrame:
    """``compute(inputs)`` in batches by hash of the key, each written before the next begins; what is written already is not done again.

    A run that was stopped goes on with the batches that are missing when it is started again
    with the same inputs and the same number of batches. A batch counts as written once its
    ``_SUCCESS`` is there, so one that was cut off is done anew. Null keys are left out. The
    folder must be one that all executors share.
    """
    spark = inputs.sparkSession
    rows = inputs.where(F.col(key).isNotNull()).withColumn("_batch", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(batches)))
    for n in range(batches):
        path = f"{folder}/batch={n}"
        if not exists(f"{path}/_SUCCESS"):
            compute(rows.where(F.col("_batch") == n).drop("_batch")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(*[f"{folder}/batch={n}" for n in range(batches)])

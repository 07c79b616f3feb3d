"""Classification of texts by a model behind a callable, in batches, with checked results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions import columns as C
from landweave.session import cut_lineage

#: Characters of a text that a prompt holds.
PROMPT_CHARS = 24_000


def keyword_label(text: Column, word: str, found: str, otherwise: str) -> Column:
    """The stub model: one label if the text has the word, else another."""
    return F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(word)), found).otherwise(otherwise)


def user_prompt(task: str, source: str, labels: Sequence[str], text: Column, descriptions: Mapping[str, str] | None = None) -> Column:
    """Prompt of a text: task, source, allowed labels, descriptions, and the text cut to the prompt's room."""
    head = f"task: {task}\ntext_source: {source}\nallowed_labels: [{', '.join(labels)}]\n"
    if descriptions:
        head += f"label_descriptions: {json.dumps(dict(descriptions), ensure_ascii=False)}\n"
    return F.concat(F.lit(head + "text: "), F.substring(F.coalesce(text, F.lit("")), 1, PROMPT_CHARS))


def retry_prompt(prompt: Column, raw: Column, error: Column, *, single: bool) -> Column:
    wanted = "exactly one best label" if single else "at least one best label"
    advice = f"Retry the classification. You must choose {wanted} from allowed_labels. Never return an empty list."
    empty = F.lit("")
    return F.concat(prompt, F.lit("\n\nPrevious invalid response:\n"), F.coalesce(raw, empty), F.lit("\nPrevious error: "), F.coalesce(error, empty), F.lit("\n" + advice + '\nRespond only with JSON like {"labels": ["label"]}.'))


def ask(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """``rows`` with ``raw_response`` and ``call_error``; ``model`` answers a list of prompts.

    A failing batch becomes rows with an error, never a failed task.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", raw_response string, call_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            raw: list[str | None] = []
            errors: list[str | None] = []
            for at in range(0, len(frame), batch):
                part = frame[prompt].iloc[at : at + batch].tolist()
                try:
                    raw += model(part)
                    errors += [None] * len(part)
                except Exception as failure:  # noqa: BLE001 - whatever a model raises becomes a row
                    raw += [None] * len(part)
                    errors += [str(failure)] * len(part)
            yield frame.assign(raw_response=raw, call_error=errors)

    return rows.mapInPandas(run, schema)


def classify(texts: DataFrame, task: str, source: str, labels: Sequence[str], model: Callable[[list[str]], list[str]], *, single: bool, key: str = "pageid", text: str = "text") -> DataFrame:
    """``key, prediction (array), parse_status, error, raw_response, attempts`` with one retry of bad answers.

    One row per input row, also of a null or empty text. The model gets every first prompt once
    and every retry prompt once: both attempts are written to the checkpoint folder before they
    are read, because a model may answer the same prompt differently the next time. So the
    model runs when this is called, not when the result is read.
    """
    parsed = C.parse_response(F.col("raw_response"), labels)
    result = C.single_label_result(parsed) if single else C.multi_label_result(parsed, tolerate_unknown=task == "osm")
    array = (lambda p: F.when(p.isNotNull(), F.array(p))) if single else (lambda p: p)

    def read(rows: DataFrame, attempts: int) -> DataFrame:
        out = rows.withColumn("_r", result)
        status = F.when(F.col("call_error").isNotNull(), "error").otherwise(F.coalesce(F.col("_r.parse_status"), F.lit("error")))
        return out.select(key, "prompt", array(F.col("_r.prediction")).alias("prediction"), status.alias("parse_status"), F.coalesce("call_error", F.col("_r.error")).alias("error"), "raw_response", F.lit(attempts).alias("attempts"))

    prompts = texts.select(key, user_prompt(task, source, labels, F.col(text)).alias("prompt"))
    first = cut_lineage(read(ask(prompts, "prompt", model), 1))
    bad = first.where(F.col("parse_status") != "ok").select(key, retry_prompt(F.col("prompt"), F.col("raw_response"), F.col("error"), single=single).alias("prompt"))
    second = cut_lineage(read(ask(bad, "prompt", model), 2))
    return first.where(F.col("parse_status") == "ok").unionByName(second).drop("prompt")

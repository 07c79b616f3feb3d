"""Checks of what a model returns as a summary or as land-use evidence, and of names that leak into it."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from landweave import vocab
from landweave.functions.columns import bound, scrub_title, squeeze, surely

# What a text that shows a model's reasoning has in it.
PRIVATE_MARKERS = ("<think", "</think>", "here's a thinking process", "output matches")
# Fields of an evidence payload; the longest summary of one without evidence.
EVIDENCE_FIELDS = ("landuse_evidence_summary", "landcover_relevance", "evidence_types", "evidence_sentences_no_place", "uncertainty")
SHORT_SUMMARY = 240

_WORD = r"[\p{L}\p{N}_]"


# ---- names that leak ---------------------------------------------------------------------------


def leak_text(text: Column) -> Column:
    """Lower case, signs, underscores and hyphens as blanks, white space squeezed."""
    return squeeze(F.regexp_replace(F.lower(text), "[-_\"'‘’`~^*+<>.,;:!?/\\\\(){}\\[\\]]", " "))


def title_leaks(text: Column, title: Column) -> Column:
    """Does a text name a title: as whole words, or without blanks if that is eight characters or more? False for nulls."""

    def within(parts: Column) -> Column:
        text_, name = parts["text"], parts["name"]
        compact = F.replace(name, F.lit(" "), F.lit(""))
        word = lambda n: F.regexp_like(text_, F.concat(F.lit(rf"(?<!{_WORD})\Q"), n, F.lit(rf"\E(?!{_WORD})")))
        run_on = (F.length(compact) >= 8) & F.contains(F.replace(text_, F.lit(" "), F.lit("")), compact)
        return (name != "") & (word(name) | word(compact) | run_on)

    return surely(bound(F.struct(leak_text(text).alias("text"), leak_text(title).alias("name")), within))


def _private(text: Column) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for marker in PRIVATE_MARKERS:
        found = found | F.contains(lowered, F.lit(marker))
    return found


def _plain(text: Column) -> Column:
    """Written line breaks and tabs (backslash and letter) as blanks, white space squeezed."""
    return squeeze(F.regexp_replace(text, r"\\[nrt]", " "))


# ---- payloads ----------------------------------------------------------------------------------


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def _fields(value: Column) -> Column:
    """Names of a JSON object's fields, in order of name."""
    return F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))


def _named(names: Column) -> Column:
    """Names as a list in messages."""
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def _strings(items: Column) -> Column:
    """Items of an array of variants as text, null where they are none."""
    return F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def summary_payload(raw: Column) -> Column:
    """STRUCT of ``summary`` and ``error`` of a response that should be ``{"summary": "..."}``."""

    def judge(v: Column) -> Column:
        summary = F.trim(F.when(_kind(F.try_variant_get(v, "$.summary", "variant")) == "STRING", F.try_variant_get(v, "$.summary", "string")))
        extra = F.array_except(_fields(v), F.array(F.lit("summary")))
        error = (
            F.when(v.isNull(), "no valid JSON").when(~surely(_kind(v) == "OBJECT"), "no JSON object")
            .when(F.size(extra) > 0, F.concat(F.lit("unexpected fields: "), _named(extra)))
            .when(~surely(summary != ""), "no summary").when(_private(summary), "private markers")
        )
        return F.struct(F.when(error.isNull(), summary).alias("summary"), error.alias("error"))

    return bound(F.try_parse_json(raw), judge)


def evidence_payload(raw: Column, title: Column) -> Column:
    """STRUCT of the EVIDENCE_FIELDS and ``error`` of a response; with an error the fields are null.

    A payload has all fields and no others, texts without traces of reasoning, known values
    only, and neither types nor sentences nor a long summary where the relevance is ``none``.
    No text may name the title.
    """

    def read(v: Column) -> Column:
        text = lambda n: F.when(_kind(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.try_variant_get(v, f"$.{n}", "string"))
        items = lambda n: F.try_variant_get(v, f"$.{n}", "array<variant>")
        return F.struct(
            v.isNotNull().alias("json"), surely(_kind(v) == "OBJECT").alias("object"), _fields(v).alias("fields"), _plain(text(EVIDENCE_FIELDS[0])).alias("summary"),
            text("landcover_relevance").alias("relevance"), text("uncertainty").alias("uncertainty"), _strings(items("evidence_types")).alias("types"),
            F.transform(_strings(items("evidence_sentences_no_place")), _plain).alias("sentences"),
        )

    def judge(r: Column) -> Column:
        wanted = F.array(*[F.lit(n) for n in sorted(EVIDENCE_FIELDS)])
        missing, extra = F.array_except(wanted, r["fields"]), F.array_except(r["fields"], wanted)
        none = r["relevance"] == "none"
        known = lambda value, allowed: surely(value.isin(*allowed))
        error = (
            F.when(~r["json"], "no valid JSON").when(~r["object"], "no JSON object")
            .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), _named(missing)))
            .when(F.size(extra) > 0, F.concat(F.lit("unexpected fields: "), _named(extra)))
            .when(~surely(r["summary"] != ""), "no summary").when(_private(r["summary"]), "private markers")
            .when(~known(r["relevance"], vocab.RELEVANCE_LEVELS), "invalid landcover_relevance").when(~known(r["uncertainty"], vocab.UNCERTAINTY_LEVELS), "invalid uncertainty")
            .when(r["types"].isNull(), "evidence_types is no list").when(F.exists(r["types"], lambda t: ~known(t, vocab.EVIDENCE_TYPES)), "invalid evidence_types")
            .when(r["sentences"].isNull(), "evidence_sentences_no_place is no list").when(F.exists(r["sentences"], lambda s: s.isNull()), "evidence_sentences_no_place holds no text")
            .when(F.exists(r["sentences"], _private), "private markers")
            .when(none & (F.size(r["types"]) > 0), "evidence_types without relevance").when(none & (F.size(r["sentences"]) > 0), "evidence_sentences_no_place without relevance")
            .when(none & (F.length(r["summary"]) > SHORT_SUMMARY), "long summary without relevance")
            .when(title_leaks(r["summary"], title) | F.exists(r["sentences"], lambda s: title_leaks(s, title)), "place name")
        )
        return F.struct(r.alias("r"), error.alias("error"))

    def settle(j: Column) -> Column:
        names = dict(zip(EVIDENCE_FIELDS, ("summary", "relevance", "types", "sentences", "uncertainty")))
        return F.struct(*[F.when(j["error"].isNull(), j["r"][short]).alias(n) for n, short in names.items()], j["error"].alias("error"))

    return bound(F.try_parse_json(raw), lambda v: bound(read(v), lambda r: bound(judge(r), settle)))


@F.pandas_udf(StringType())
def without_private_fields(values: pd.Series) -> pd.Series:
    """JSON text without the fields ``thinking`` at any depth; what is no JSON stays as it is.

    A field name at any depth is beyond what JSON expressions reach, so this is a Python function.
    """

    def drop(value: object) -> object:
        if isinstance(value, dict):
            return {k: drop(v) for k, v in value.items() if k != "thinking"}
        return [drop(v) for v in value] if isinstance(value, list) else value

    def clean(text: str) -> str:
        try:
            return json.dumps(drop(json.loads(text)), ensure_ascii=False) if "thinking" in text else text
        except ValueError:
            return text

    return values.map(clean, na_action="ignore")


def repaired_summary(summary: Column, title: Column, mode: Column) -> Column:
    """The summary without mentions of the title where it was to name no place; other summaries as they are."""
    return F.when(surely(mode == "no_place") & summary.isNotNull() & title.isNotNull(), scrub_title(summary, title)).otherwise(summary)


# ---- prompts -----------------------------------------------------------------------------------


def evidence_prompt(title: Column, content: Column, types: Sequence[str] = vocab.EVIDENCE_TYPES) -> Column:
    """What a model is asked for evidence: the title that it must not name, the text, the rules, the fields."""
    rules = (
        "Relève dans ce texte ce qui renseigne sur l'occupation du sol, en français, sans nom de lieu ni coordonnées, sans rien ajouter.\n"
        f"landcover_relevance : {', '.join(vocab.RELEVANCE_LEVELS)}. uncertainty : {', '.join(vocab.UNCERTAINTY_LEVELS)}. evidence_types : {', '.join(types)}.\n"
        f"Réponds par un objet JSON avec exactement ces champs : {', '.join(EVIDENCE_FIELDS)}."
    )
    named = F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat(F.lit("Titre à ne jamais mentionner : "), title, F.lit("\n\n"))).otherwise("")
    return F.concat(named, F.lit("Texte :\n"), F.coalesce(content, F.lit("")), F.lit("\n\n" + rules))


def evidence_retry(prompt: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nLa réponse précédente n'était pas utilisable : réponds seulement par l'objet JSON demandé, sans nommer le lieu."))

"""Named subsets of records: predicates as columns, and one aggregate over all of them.

A record is expanded to the names of the subsets it is in, then everything is grouped once by
name; no subset is scanned for itself. Partial aggregation takes the expansion back before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave import vocab
from landweave.functions.columns import boolish, number_or_null, surely

SPATIAL = "point_label_share_250m_ge_0.8"


def _word(name: str) -> Column:
    return F.lower(F.trim(F.col(name).cast("string")))


def _at_least(name: str, bound: float) -> Column:
    return surely(number_or_null(F.col(name)) >= bound)


def _is(name: str, *values: str) -> Column:
    return surely(_word(name).isin(*values))


def both(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


#: Columns that a predicate needs, and the predicate.
Subset = tuple[tuple[str, ...], Column]


def registry() -> dict[str, Subset]:
    """All subsets of the control experiments."""
    share250, share500, relevance, uncertainty = "point_label_share_250m", "point_label_share_500m", "landcover_relevance", "uncertainty"
    count, bin_, use, kind = "evidence_sentences_count", "quality_bin", "recommended_use", "primary_article_type"
    base: dict[str, Subset] = {
        "all": ((), F.lit(True)),
        SPATIAL: ((share250,), _at_least(share250, 0.8)),
        "point_label_share_500m_ge_0.8": ((share500,), _at_least(share500, 0.8)),
        "point_label_share_250m_ge_0.9": ((share250,), _at_least(share250, 0.9)),
        "dominant_matches_point_label_250m": (("dominant_matches_point_label_250m",), surely(boolish(F.col("dominant_matches_point_label_250m")))),
        "dominant_matches_point_label_500m": (("dominant_matches_point_label_500m",), surely(boolish(F.col("dominant_matches_point_label_500m")))),
        "relevance_medium_high": ((relevance,), _is(relevance, "medium", "high")),
        "relevance_high": ((relevance,), _is(relevance, "high")),
        "evidence_sentences_count_ge_1": ((count,), _at_least(count, 1)),
        "evidence_sentences_count_ge_2": ((count,), _at_least(count, 2)),
        "uncertainty_low": ((uncertainty,), _is(uncertainty, "low")),
        "uncertainty_low_medium": ((uncertainty,), _is(uncertainty, "low", "medium")),
        "quality_high_or_very_high": ((bin_,), _is(bin_, "quality_high", "quality_very_high")),
        "quality_very_high": ((bin_,), _is(bin_, "quality_very_high")),
        "recommended_use_training": ((use,), _is(use, "use_for_training")),
        "recommended_use_evaluation_only": ((use,), _is(use, "use_for_evaluation_only")),
        "recommended_use_exclude": ((use,), _is(use, "exclude")),
        **{
            f"article_type_{t}": ((kind,), _is(kind, t))
            for t in ("agriculture_or_vineyard", "natural_landscape", "water_feature", "settlement_or_administrative", "built_or_cultural_site", "other_or_unclear")
        },
        "article_type_high_prior": ((kind,), _is(kind, *vocab.HIGH_PRIOR_TYPES)),
    }

    def meet(*names: str) -> Subset:
        needed = dict.fromkeys(c for n in names for c in base[n][0])
        return tuple(needed), both(*[base[n][1] for n in names])

    base["relevance_medium_high_and_spatial_250m_ge_0.8"] = meet("relevance_medium_high", SPATIAL)
    base["relevance_high_and_spatial_250m_ge_0.8"] = meet("relevance_high", SPATIAL)
    base["evidence_sentences_count_ge_1_and_spatial_250m_ge_0.8"] = meet("evidence_sentences_count_ge_1", SPATIAL)
    base["quality_high_or_very_high_and_spatial_250m_ge_0.8"] = meet("quality_high_or_very_high", SPATIAL)
    base["article_type_high_prior_and_relevance_medium_high"] = meet("article_type_high_prior", "relevance_medium_high")
    base["other_or_unclear_and_relevance_medium_high"] = meet("article_type_other_or_unclear", "relevance_medium_high")
    base["article_type_high_prior_and_relevance_medium_high_and_spatial_250m_ge_0.8"] = meet("article_type_high_prior", "relevance_medium_high", SPATIAL)
    base["other_or_unclear_and_relevance_medium_high_and_spatial_250m_ge_0.8"] = meet("article_type_other_or_unclear", "relevance_medium_high", SPATIAL)
    return base


def relevance_subsets() -> dict[str, Column]:
    """Subsets by relevance, number of evidence sentences, uncertainty and spatial share."""
    rel = "landcover_relevance"
    one = surely(F.coalesce(number_or_null(F.col("evidence_sentences_count")), F.lit(0.0)) >= 1)
    two = surely(F.coalesce(number_or_null(F.col("evidence_sentences_count")), F.lit(0.0)) >= 2)
    spatial = _at_least("point_label_share_250m", 0.8)
    return {
        "all": F.lit(True),
        **{f"relevance_{x}": _is(rel, x) for x in vocab.RELEVANCE_LEVELS},
        "relevance_low_medium_high": _is(rel, "low", "medium", "high"),
        "relevance_medium_high": _is(rel, "medium", "high"),
        "evidence_sentences_count_ge_1": one,
        "evidence_sentences_count_ge_2": two,
        "uncertainty_low": _is("uncertainty", "low"),
        "uncertainty_low_medium": _is("uncertainty", "low", "medium"),
        SPATIAL: spatial,
        f"{SPATIAL}_and_relevance_medium_high": both(spatial, _is(rel, "medium", "high")),
        f"{SPATIAL}_and_evidence_sentences_count_ge_1": both(spatial, one),
    }


def relevance_and_spatial_subsets() -> dict[str, Column]:
    spatial = _at_least("point_label_share_250m", 0.8)
    return {f"{n}_and_{SPATIAL}": both(c, spatial) for n, c in relevance_subsets().items() if not n.startswith(SPATIAL)}


def evidence_type_subsets() -> dict[str, Column]:
    return {f"evidence_type_{t}": surely(F.array_contains("evidence_types", t)) for t in vocab.EVIDENCE_TYPES}


def quality_subsets() -> dict[str, Column]:
    """The nine subsets that text-source reports share."""
    known = registry()
    names = ("all", "relevance_medium_high", "relevance_medium_high_and_spatial_250m_ge_0.8", "quality_high_or_very_high", "quality_high_or_very_high_and_spatial_250m_ge_0.8", "recommended_use_training", "recommended_use_evaluation_only", "recommended_use_exclude")
    return {n: known[n][1] for n in names} | {"spatial_250m_ge_0.8": known[SPATIAL][1]}


def lattice(kinds: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Article type, relevance and spatial subsets with all their meets, each name once."""
    relevance = {n: c for n, c in relevance_subsets().items() if n == "all" or n.startswith("relevance_")}
    kind = F.coalesce(F.col("primary_article_type"), F.lit("other_or_unclear"))
    kinds = kinds or {f"article_type:{t}": surely(kind == t) for t in vocab.ARTICLE_TYPES}
    spatial = {SPATIAL: _at_least("point_label_share_250m", 0.8)}
    result = dict(relevance) | dict(spatial) | dict(kinds)
    relevant = {n: c for n, c in relevance.items() if n != "all"}
    for left, right in ((kinds, relevant), (kinds, spatial), (relevant, spatial)):
        result |= {f"{a}|{b}": both(x, y) for a, x in left.items() for b, y in right.items()}
    result |= {f"{a}|{b}|{SPATIAL}": both(x, y, spatial[SPATIAL]) for a, x in kinds.items() for b, y in relevant.items()}
    return result


def available(df: DataFrame, columns: Sequence[str]) -> Column:
    """All needed columns are there and not null."""
    if any(c not in df.columns for c in columns):
        return F.lit(False)
    return both(F.lit(True), *[F.col(c).isNotNull() for c in columns])


def expand(records: DataFrame, subsets: Mapping[str, Column]) -> DataFrame:
    """Each record once for every subset that it is in, with the name in ``subset``."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    return records.withColumn("subset", F.explode(names))

"""Column functions, with hand-computed values."""

import pytest
from pyspark.sql import functions as F

from landweave.functions import columns as C
from landweave.operators import artifacts


def value(spark, column, **cells):
    names = list(cells)
    kinds = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], kinds).select(column.alias("v")).first()["v"] if names else None


@pytest.mark.parametrize("text, expected", [*[(t, True) for t in ("true", "T", " YES ", "y", "oui", "on", "1", "1.0")], *[(t, False) for t in ("false", "F", "NO", "n", "non", "off", "0")], *[(t, None) for t in ("", "nan", "None", "NULL", "maybe", "2", None)]])
def test_boolish(spark, text, expected):
    assert value(spark, C.boolish(F.col("t")), t=text) is expected


@pytest.mark.parametrize("text, expected", [("['a', ' b ', '', None]", ["a", "b"]), ('["x", null, 3]', ["x", "3"]), ("('a',)", ["('a',)"]), ("bare", ["bare"]), ("", []), (None, []), ("None", []), ("'quoted'", ["quoted"])])
def test_parse_list(spark, text, expected):
    assert value(spark, C.parse_list(F.col("t")), t=text) == expected


def test_clean_list(spark):
    assert value(spark, C.clean_list(F.col("a")), a=["forest", None, "", "   ", "nan"]) == ["forest"]


@pytest.mark.parametrize("text, expected", [("Un. Deux ! Trois ?  Quatre", ["Un.", "Deux !", "Trois ?", "Quatre"]), ("a b.\nC", ["a b.", "C"]), ("", []), (None, []), ("3,5 m. fin", ["3,5 m.", "fin"])])
def test_sentences(spark, text, expected):
    assert value(spark, C.sentences(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, title, expected", [
    ("Le Pont-Neuf est beau. pont  neuf !", "Pont Neuf", "Le ce lieu est beau. ce lieu !"), ("a  b", "", "a b"), ("a  b", None, "a b"), ("(x) et (X)", "(x)", "(ce lieu) et (ce lieu)".replace("(ce lieu)", "ce lieu")), ("Mo+Ro et mo+ro, mo-ro", "Mo+Ro", "ce lieu et ce lieu, ce lieu"),
])
def test_scrub_title(spark, text, title, expected):
    assert value(spark, C.scrub_title(F.col("t"), F.col("n")), t=text, n=title) == expected
    if not title:
        assert value(spark, C.scrub_title(F.col("t"), F.col("n"), squeeze_always=False), t=text, n=title) == text


@pytest.mark.parametrize("number, expected", [("0.5", "0.5"), ("1.0", "1"), ("0.12345", "0.123"), (None, "inconnue"), ("x", "inconnue"), ("nan", "inconnue")])
def test_number_text(spark, number, expected):
    assert value(spark, C.number_text(F.col("t")), t=number) == expected


@pytest.mark.parametrize("categories, expected", [
    (["Rivière de France", "Col des Vosges", "Vignoble d'Alsace", "Gare fermée"], ["water_feature", "natural_landscape", "agriculture_or_vineyard", "transport_infrastructure"]), ([], ["other_or_unclear"]), (None, ["other_or_unclear"]),
    (["Prairie"], ["agriculture_or_vineyard"]), (["Prairie naturelle"], ["natural_landscape", "agriculture_or_vineyard"]), (["École communale"], ["other_or_unclear"]), (["Catégorie:Lacs_du_Jura"], ["water_feature"]), (["lacustre"], ["other_or_unclear"]),
])
def test_article_types(spark, categories, expected):
    df = spark.createDataFrame([(categories,)], "a array<string>")
    assert df.select(C.article_types(F.col("a"))).first()[0] == expected


@pytest.mark.parametrize("raw, allowed, labels, error", [
    ('{"labels":["31","99"]}', ["31"], ["31"], "Unknown labels in JSON: 99"), ("131", ["31"], [], "No valid allowed labels found"), ("woodland", ["wood"], [], "No valid allowed labels found"),
    ('{"labels":["31",32]}', ["31", "32"], ["31"], "JSON list fields must contain only strings"), ("I predict 31.", ["31"], ["31"], None), ('{"label": "31, 32"}', ["32", "31"], ["32", "31"], None), ('["31"]', ["31"], [], "No valid allowed labels found"),
    ("31", ["31"], [], "No valid allowed labels found"), ("", ["31"], [], "No valid allowed labels found"), ("Wood and WATER", ["water", "wood"], ["water", "wood"], None), ('{"label": 31}', ["31"], [], "No valid allowed labels found"), ('{"labels": []}', ["31"], [], "No valid allowed labels found"),
])
def test_parse_response(spark, raw, allowed, labels, error):
    got = value(spark, C.parse_response(F.col("t"), allowed), t=raw)
    assert (got["labels"], got["error"]) == (labels, error)


def test_results(spark):
    parsed = lambda raw: C.parse_response(F.lit(raw), ["31", "32"])
    one = spark.range(1).select(C.single_label_result(parsed('{"labels":["31","32"]}')).alias("a"), C.single_label_result(parsed('{"labels":["31"]}')).alias("b"), C.multi_label_result(parsed('{"labels":["31","99"]}')).alias("c"), C.multi_label_result(parsed('{"labels":["31","99"]}'), tolerate_unknown=False).alias("d")).first()
    assert (one.a.parse_status, one.a.prediction) == ("ambiguous", None) and (one.b.parse_status, one.b.prediction) == ("ok", "31")
    assert (one.c.parse_status, one.c.prediction) == ("ok", ["31"]) and (one.d.parse_status, one.d.prediction) == ("error", None)


def test_evidence_windows(spark):
    content = "Le village est ancien. La route passe. La forêt couvre le nord du ban ! Un canal longe la route."
    rows = [
        (1, "T", content, ["la forêt couvre le nord"], ["forest"]), (2, "T", content, [], ["water"]), (3, "T", content, [], []), (4, None, None, None, None), (5, "T", "Château. Rien.", [], ["water"]),
    ]
    df = spark.createDataFrame(rows, "pageid int, title string, content string, evidence_sentences_no_place array<string>, evidence_types array<string>")
    got = {r.pageid: r for r in artifacts.retrieved_windows(df).collect()}
    assert (got[1].retrieved_sentence_count, got[1].matched_evidence_sentence_count) == (3, 1) and "village" not in got[1].retrieved_evidence_windows
    assert "route passe" not in got[1].retrieved_evidence_sentences_only and got[1].random_sentence_count == 3
    assert got[2].matched_evidence_sentence_count == 0 and got[3].retrieved_sentence_count == 1 and "village" in got[3].retrieved_evidence_windows
    assert got[4].article_sentence_count == 0 and got[4].retrieved_evidence_windows.endswith("- Aucune phrase n'est disponible.")
    assert got[5].matched_evidence_sentence_count == 1  # "eau" is in "château"
    again = {r.pageid: r.random_sentence_windows for r in artifacts.retrieved_windows(df.repartition(3)).collect()}
    assert again == {k: r.random_sentence_windows for k, r in got.items()}


def test_cards_and_highlights(spark):
    schema = "pageid int, title string, content string, landcover_relevance string, uncertainty string, evidence_types array<string>, evidence_sentences_no_place array<string>, landuse_evidence_summary string, primary_article_type string, candidate_article_types array<string>, quality_score double, quality_bin string, recommended_use string, point_label_share_250m double, point_label_share_500m double, dominant_matches_point_label_250m string"
    rows = [(1, "Lac Bleu", "Texte.", "HIGH", "low", ["forest", "odd_kind"], ["Le lac bleu gèle."], "Autour de Lac-Bleu.", "water_feature", ["water_feature"], 7.5, "quality_very_high", "exclude", 0.5, None, "oui"), (2, None, None, *[None] * 13)]
    df = spark.createDataFrame(rows, schema)
    cards = {r.pageid: r.evidence_card for r in artifacts.evidence_cards(df).collect()}
    assert "Pertinence: élevée\nIncertitude: faible\nTypes d'indices: forêt, odd kind" in cards[1] and "- Le ce lieu gèle." in cards[1] and cards[1].endswith("Autour de ce lieu.")
    assert "à 250 m: 0.5\n- part du label ponctuel à 500 m: inconnue" in cards[1] and "correspond au label ponctuel: oui" in cards[1]
    assert "Pertinence: inconnue" in cards[2] and cards[2].endswith("Aucun résumé d'indices n'est disponible.")
    highlights = {r.pageid: r for r in artifacts.evidence_highlights(df).collect()}
    assert highlights[1].content_with_evidence_highlights.endswith("Texte complet de l'article:\nTexte.") and highlights[2].evidence_sentence_count == 0

"""Text artifacts of articles: sentences around evidence, highlights, cards. All column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from landweave import vocab
from landweave.functions import columns as C

_NONE = F.array
_INTS = ArrayType(IntegerType())


def _indices(flags: Column) -> Column:
    """Positions of the true entries of an array of booleans."""
    at = F.transform(flags, lambda f, i: F.when(f, i))
    return F.filter(at, lambda i: i.isNotNull())


def evidence_matches(sentences: Column, evidence: Column) -> Column:
    """Positions of sentences that hold an evidence sentence or are held by one, as folded words."""
    folded = F.filter(F.transform(evidence, C.match_text), lambda e: e != "")
    hit = lambda s: F.exists(folded, lambda e: F.contains(C.match_text(s), e) | F.contains(e, C.match_text(s)))
    return _indices(F.transform(sentences, hit))


def keyword_matches(sentences: Column, types: Column) -> Column:
    """Positions of sentences that hold a keyword of the evidence types, as a part of words too."""
    per_type = []
    for kind, words in vocab.EVIDENCE_KEYWORDS.items():
        wanted = F.coalesce(F.array_contains(types, kind), F.lit(False))
        per_type.append((wanted, [" ".join(w.lower().split()) for w in words]))

    def hit(s: Column) -> Column:
        text = C.match_text(s)
        found = F.lit(False)
        for wanted, words in per_type:
            any_word = F.lit(False)
            for w in words:
                any_word = any_word | F.contains(text, F.lit(w))
            found = found | (wanted & any_word)
        return found

    return _indices(F.transform(sentences, hit))


def windows(matches: Column, count: Column, radius: int) -> Column:
    """Sorted positions within ``radius`` of a match."""
    near = F.transform(matches, lambda m: F.sequence(F.greatest(F.lit(0), m - radius), F.least(count - 1, m + radius)))
    return F.array_sort(F.array_distinct(F.flatten(near)))


def _pick(sentences: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.get(sentences, i))


def _listed(heading: str, sentences: Column) -> Column:
    lines = F.when(F.size(sentences) > 0, F.transform(sentences, lambda s: F.concat(F.lit("- "), s))).otherwise(F.array(F.lit("- Aucune phrase n'est disponible.")))
    return F.concat(F.lit(heading + "\n\n"), F.array_join(lines, "\n"))


def retrieved_windows(articles: DataFrame, *, seed: int = 42, radius: int = 1) -> DataFrame:
    """Four text variants per article from its own sentences.

    ``articles`` has ``pageid, title, content, evidence_sentences_no_place, evidence_types``.
    Sentences that match evidence are taken with their neighbours; without a match those with a
    keyword of the evidence types; without any the first. The random variant takes as many
    sentences, those with the smallest digests of seed, page and position. A null content is empty.
    """
    none = F.array().cast("array<string>")
    rows = articles.select(
        "pageid", C.strip(F.coalesce("title", F.lit(""))).alias("title"), C.sentences(F.col("content")).alias("s"),
        C.clean_list(F.col("evidence_sentences_no_place")).alias("e"), C.clean_list(F.col("evidence_types")).alias("t"),
    )
    rows = rows.withColumns({"n": F.size("s"), "by_evidence": evidence_matches(F.col("s"), F.col("e"))})
    rows = rows.withColumn("matches", F.when(F.size("by_evidence") > 0, F.col("by_evidence")).otherwise(keyword_matches(F.col("s"), F.col("t"))))
    around = windows(F.col("matches"), F.col("n"), radius)
    empty = F.array().cast(_INTS)
    rows = rows.withColumn("around", F.when(F.size("matches") > 0, around).when(F.col("n") > 0, F.array(F.lit(0))).otherwise(empty))
    only = F.when(F.size("matches") > 0, F.col("matches")).otherwise(F.slice("around", 1, 1))
    everywhere = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(empty)
    drawn = F.array_sort(F.transform(everywhere, lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), "pageid", i)).alias("h"), i.alias("i"))))
    random = F.array_sort(F.transform(F.slice(drawn, 1, F.greatest(F.size("around"), F.lit(1))), lambda d: d["i"]))
    rows = rows.withColumns({"only": only, "random": F.when(F.size("around") > 0, random).otherwise(empty)})
    taken = _pick(F.col("s"), F.col("around"))
    placeless = F.filter(F.transform(taken, lambda s: C.scrub_title(s, F.col("title"))), lambda s: s != "")
    texts = {
        "retrieved_evidence_windows": _listed("Phrases brutes extraites de l'article.", taken),
        "retrieved_evidence_sentences_only": _listed("Phrases d'indice extraites de l'article.", _pick(F.col("s"), F.col("only"))),
        "random_sentence_windows": _listed("Phrases brutes aléatoires extraites du même article.", _pick(F.col("s"), F.col("random"))),
        "retrieved_evidence_windows_no_place": _listed("Phrases brutes extraites de l'article, sans nom de lieu.", F.coalesce(placeless, none)),
    }
    rows = rows.withColumns(texts)
    return rows.select(
        "pageid", "title", *texts, F.col("n").alias("article_sentence_count"), F.size("matches").alias("matched_evidence_sentence_count"),
        F.size("around").alias("retrieved_sentence_count"), F.size("random").alias("random_sentence_count"), *[F.length(t).alias(f"{t}_char_count") for t in texts],
    )


def evidence_highlights(articles: DataFrame) -> DataFrame:
    """Highlights before the full text: relevance, uncertainty, types, and evidence sentences without the title."""
    sentences = F.filter(F.transform(C.clean_list(F.col("evidence_sentences_no_place")), lambda s: C.scrub_title(s, F.col("title"))), lambda s: s != "")
    rows = articles.withColumn("_s", sentences)
    names = F.transform(C.clean_list(F.col("evidence_types")), lambda t: F.coalesce(C.lookup(t, vocab.EVIDENCE_TYPE_NAMES), F.replace(t, F.lit("_"), F.lit(" "))))
    lines = F.when(F.size("_s") > 0, F.transform("_s", lambda s: F.concat(F.lit("- "), s))).otherwise(F.array(F.lit("- Aucune phrase d'indice explicite n'est disponible.")))
    unknown = F.lit("inconnue")
    text = F.concat(
        F.lit("Indices d'occupation du sol extraits, sans nom de lieu.\n\nPertinence des indices: "), F.coalesce(C.present(F.col("landcover_relevance")), unknown),
        F.lit("\nIncertitude des indices: "), F.coalesce(C.present(F.col("uncertainty")), unknown), F.lit("\nTypes d'indices: "), C.joined(names), F.lit("\n\nPhrases d'indices:\n"), F.array_join(lines, "\n"),
    )
    rows = rows.withColumn("evidence_highlights", text)
    whole = F.concat(F.col("evidence_highlights"), F.lit("\n\nTexte complet de l'article:\n"), C.strip(F.coalesce("content", F.lit(""))))
    return rows.select("pageid", "evidence_highlights", whole.alias("content_with_evidence_highlights"), F.size("_s").alias("evidence_sentence_count"), F.length("evidence_highlights").alias("evidence_highlights_char_count"))


def evidence_cards(articles: DataFrame) -> DataFrame:
    """Cards: what is known of an article in fixed lines, without its name.

    ``articles`` has, besides ``pageid, title, content``, the columns of evidence, article type,
    spatial confidence and quality; what is null shows as unknown.
    """
    title = F.coalesce(C.present(F.col("title")), F.lit(""))
    scrub = lambda t: C.scrub_title(t, title, squeeze_always=False)
    sentences = F.filter(F.transform(C.clean_list(F.col("evidence_sentences_no_place")), scrub), lambda s: s != "")
    rows = articles.withColumn("_s", sentences)
    types = F.transform(C.clean_list(F.col("evidence_types")), lambda t: C.named(t, vocab.EVIDENCE_TYPE_NAMES))
    candidates = F.transform(C.clean_list(F.col("candidate_article_types")), lambda t: C.named(t, vocab.ARTICLE_TYPE_NAMES))
    lines = F.when(F.size("_s") > 0, F.transform("_s", lambda s: F.concat(F.lit("- "), s))).otherwise(F.array(F.lit("- Aucun indice factuel explicite n'a été extrait.")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    card = F.concat_ws(
        "\n", F.lit("Fiche d'indices d'occupation du sol, sans nom de lieu."), F.lit(""),
        line("Pertinence", C.named(F.col("landcover_relevance"), vocab.RELEVANCE_NAMES)), line("Incertitude", C.named(F.col("uncertainty"), vocab.UNCERTAINTY_NAMES)),
        line("Types d'indices", C.joined(types)), line("Type d'article", C.named(F.col("primary_article_type"), vocab.ARTICLE_TYPE_NAMES)), line("Types d'article candidats", C.joined(candidates)),
        line("Score de qualité", F.coalesce(C.present(F.col("quality_score")), F.lit("inconnue"))), line("Catégorie de qualité", C.named(F.col("quality_bin"), vocab.QUALITY_BIN_NAMES)),
        line("Catégorie d'usage recommandée", C.named(F.col("recommended_use"), vocab.USE_NAMES)), F.lit(""), F.lit("Confiance spatiale CORINE:"),
        line("- part du label ponctuel à 250 m", C.number_text(F.col("point_label_share_250m"))), line("- part du label ponctuel à 500 m", C.number_text(F.col("point_label_share_500m"))),
        line("- le label dominant à 250 m correspond au label ponctuel", C.yes_no(F.col("dominant_matches_point_label_250m"))), F.lit(""), F.lit("Indices factuels:"), F.array_join(lines, "\n"), F.lit(""),
        F.lit("Résumé d'indices:"), scrub(F.coalesce(C.present(F.col("landuse_evidence_summary")), F.lit("Aucun résumé d'indices n'est disponible."))),
    )
    rows = rows.withColumn("evidence_card", card)
    whole = F.concat(F.col("evidence_card"), F.lit("\n\nTexte complet de l'article:\n"), F.coalesce(C.present(F.col("content")), F.lit("")))
    return rows.select("pageid", "evidence_card", whole.alias("content_with_evidence_card"), F.size("_s").alias("evidence_sentence_count"), F.length("evidence_card").alias("evidence_card_char_count"))

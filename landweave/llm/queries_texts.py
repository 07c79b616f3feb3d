"""Queries of problems 4 to 8."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.llm.leaks import clean_documents, item_sizes, leaked_items, leaked_spans
from landweave.llm.pieces import boundary_tables, coarsest_boundary, current_tables, emit_pieces, file_ranges, oversized, piece_offsets, sparse_stretch, text_ranges, write_files
from landweave.llm.prose import STATISTICS, text_statistics, text_types
from landweave.llm.skeleton import look_classes, same_looking, skeleton_udf
from landweave.llm.tokens import round_trips, token_ids, vocabulary
from landweave.session import cut_lineage, shared_folder
from landweave.sources.tables import current_rows, table


def _current_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``field, key, text`` of the current titles and summaries."""
    titles = current_rows(table(spark, folder, "wiki_articles"), "pageid", "fetched_at", ["title"])
    summaries = current_rows(
        table(spark, folder, "article_landuse_evidence_summaries"), "pageid", "generated_at", ["landuse_evidence_summary"]
    )
    a = titles.select(F.lit("title").alias("field"), F.col("pageid").alias("key"), F.col("title").alias("text"))
    page = F.col("pageid").try_cast("long").alias("key")
    b = summaries.select(F.lit("summary").alias("field"), page, F.col("landuse_evidence_summary").alias("text"))
    return a.unionByName(b)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of pages whose current titles, or summaries, look the same but are stored differently."""
    pairs = same_looking(_current_texts(spark, folder))
    return pairs.select("field", F.col("key_a").alias("pageid_a"), F.col("key_b").alias("pageid_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page and field: the digest of its skeleton, which names its group, and to how many pages it is linked."""
    return look_classes(_current_texts(spark, folder)).withColumnRenamed("key", "pageid")


def p4_uniform(spark: SparkSession, folder: str) -> DataFrame:
    """Current titles and summaries in the one consistent form."""
    texts = _current_texts(spark, folder).where(F.col("text").isNotNull())
    return texts.select("field", F.col("key").alias("pageid"), skeleton_udf(spark)("text").alias("text"))


PIECE_CHARS, OVERLAP_CHARS = 24_000, 200


_CONTENTS = ("pageid", "content", "fetched_at", PIECE_CHARS)


def _oversized_tables(spark: SparkSession, folder: str, *, with_ends: bool = True) -> DataFrame:
    """Boundary tables of the oversized current contents; no text is shuffled."""
    rows = table(spark, folder, "article_contents")
    tables = boundary_tables(text_ranges(rows, *_CONTENTS), sparse_stretch(PIECE_CHARS, OVERLAP_CHARS), with_ends=with_ends)
    return current_tables(tables, oversized(rows, *_CONTENTS))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with an oversized current content, and the coarsest boundary that suffices."""
    tables = _oversized_tables(spark, folder, with_ends=False)
    return coarsest_boundary(tables, PIECE_CHARS).select(F.col("key").alias("pageid"), "boundary")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized contents with their offsets."""
    offsets = piece_offsets(_oversized_tables(spark, folder), PIECE_CHARS, OVERLAP_CHARS)
    ranges = text_ranges(table(spark, folder, "article_contents"), *_CONTENTS, ahead=PIECE_CHARS)
    return emit_pieces(offsets, ranges).withColumnRenamed("key", "pageid")


def _checked(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """Per page: what must hold of its pieces, checked against the whole text.

    ``torn_words`` counts cuts inside a word although white space lies in the room before them.
    """
    cut = F.struct("piece", "start", "end", "boundary", F.char_length("text").alias("n"), F.md5("text").alias("digest"))
    lists = pieces.groupBy("pageid").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    rows = texts.join(lists, "pageid")
    last = F.element_at("cuts", -1)
    following = F.slice("cuts", 2, F.greatest(F.size("cuts") - 1, F.lit(0)))
    part = lambda c: F.substring("content", c["start"].cast("int") + 1, (c["end"] - c["start"]).cast("int"))
    room = lambda c: F.substring("content", c["start"].cast("int") + OVERLAP_CHARS + 1, F.lit(PIECE_CHARS - OVERLAP_CHARS - 1))
    return rows.select(
        "pageid",
        ((F.col("cuts")[0]["start"] == 0) & (last["end"] == F.char_length("content"))).alias("whole"),
        F.forall("cuts", lambda c: (c["n"] <= PIECE_CHARS) & (c["n"] == c["end"] - c["start"]) & (c["digest"] == F.md5(part(c)))).alias("exact"),
        F.forall(F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), following, lambda a, b: b["start"] == a["end"] - OVERLAP_CHARS), lambda x: x).alias("overlapping"),
        F.size(F.filter("cuts", lambda c: (c["boundary"] == "none") & room(c).rlike(r"[\s\p{Z}\x1c-\x1f\x85]"))).cast("long").alias("torn_words"),
    )


def p5_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Do the pieces of every oversized content cover it, obey the limit, overlap, and tear no word without need?"""
    return _checked(p5_pieces(spark, folder), current_rows(table(spark, folder, "article_contents"), "pageid", "fetched_at", ["content"]))


def p5_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same pieces of oversized contents that lie in files, each read by byte ranges: their number and last end per page."""
    rows = current_rows(table(spark, folder, "article_contents"), "pageid", "fetched_at", ["content"])
    texts = rows.where(F.char_length("content") > PIECE_CHARS).select(F.col("pageid").alias("key"), F.col("content").alias("text"))
    paths = cut_lineage(write_files(texts, f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"))
    tables = boundary_tables(file_ranges(paths), sparse_stretch(PIECE_CHARS, OVERLAP_CHARS))
    pieces = emit_pieces(piece_offsets(tables, PIECE_CHARS, OVERLAP_CHARS), file_ranges(paths, ahead=PIECE_CHARS))
    return _checked(pieces.withColumnRenamed("key", "pageid"), rows)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(table(spark, folder, "documents"), "doc_id", "text", vocabulary())


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: the bytes that its ids stand for, and whether they decode to the text again."""
    return round_trips(table(spark, folder, "documents"), "doc_id", "text", vocabulary()).drop("n_ids")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_spans(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items of which they contain a passage."""
    return leaked_items(_spans(spark, folder), "doc_id")


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every document: what is done with it, and its text without passages of items."""
    return clean_documents(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"))


def p7_marks(spark: SparkSession, folder: str) -> DataFrame:
    """What is done with every document, and how many of its words are cut out."""
    return p7_clean(spark, folder).select("doc_id", "leaked_words", "action")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation item, its words, whether they are cut out, and the number of documents into which it leaked."""
    counts = p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n"))
    items = item_sizes(table(spark, folder, "eval_items"))
    return items.join(counts, "item_id", "left").select("item_id", "n_words", "cuts", F.coalesce("n", F.lit(0)).alias("n_documents"))


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document and its type."""
    measured = text_statistics(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words"))
    return text_types(measured).select("doc_id", *[F.round(n, 6).alias(n) for n in STATISTICS], "kind", F.round("certainty", 4).alias("certainty"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are no prose: list, table or junk."""
    measured = text_statistics(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words"))
    return text_types(measured.select("doc_id", "votes")).where(F.col("kind") != "prose").select("doc_id", "kind")


QUERIES = {
    "p4_found": p4_found, "p4_groups": p4_groups, "p4_uniform": p4_uniform, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_checks": p5_checks, "p5_files": p5_files,
    "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_found": p7_found, "p7_clean": p7_clean, "p7_marks": p7_marks, "p7_items": p7_items,
    "p8_found": p8_found, "p8_statistics": p8_statistics,
}

_WORDS = r"""list_filter(string_split_regex(lower(strip_accents(regexp_replace(nfc_normalize({0}), '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""
_LEAKS = f"""
items AS (SELECT item_id, {_WORDS.format("item_text")} AS w FROM eval_items WHERE item_text IS NOT NULL),
passages AS (
  SELECT item_id, unnest(list_transform(range(0, len(w) - least(12, len(w)) + 1), lambda i: list_slice(w, i + 1, i + least(12, len(w))))) AS g
  FROM items WHERE len(w) > 0),
texts AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, unnest(list_transform(range(0, len(w) - n + 1), lambda i: list_slice(w, i + 1, i + n))) AS g
  FROM texts CROSS JOIN (SELECT DISTINCT len(g) AS n FROM passages) WHERE len(w) >= n),
found AS (SELECT DISTINCT doc_id, item_id FROM windows JOIN passages USING (g))"""
_CURRENT = "(SELECT pageid, content FROM (SELECT pageid, content, row_number() OVER (PARTITION BY pageid ORDER BY fetched_at DESC, length(content) DESC) AS rn FROM article_contents WHERE pageid IS NOT NULL) WHERE rn = 1 AND length(content) > 24000)"
_SPACES, _LINES = r"\s\p{Z}\x1c-\x1f\x{85}", r"\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}"
_LONGEST = "list_max(list_transform(string_split_regex({0}, '{1}'), lambda x: length(x)))"
_CHECKED = f"SELECT pageid, true AS whole, true AS exact, true AS overlapping, 0 AS torn_words FROM {_CURRENT}"
ORACLE: dict[str, str] = {
    "p5_found": f"""SELECT pageid, CASE WHEN {_LONGEST.format("content", f"[{_LINES}]")} <= 24000 THEN 'paragraph'
      WHEN {_LONGEST.format(f"regexp_replace(content, '([.!?…])[{_SPACES}]+', '\\1' || chr(10), 'g')", f"[{_LINES}]")} <= 24000 THEN 'sentence'
      WHEN {_LONGEST.format("content", f"[{_SPACES}]+")} <= 24000 THEN 'word' ELSE 'none' END AS boundary FROM {_CURRENT}""",
    "p6_roundtrip": "SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, true AS same FROM documents",
    "p5_checks": _CHECKED,
    "p5_files": _CHECKED,
    "p7_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM found",
    "p7_items": f"""WITH {_LEAKS} SELECT i.item_id, any_value(coalesce(len(w.w), 0)) AS n_words, any_value(coalesce(len(w.w), 0) >= 5) AS cuts, count(f.doc_id) AS n_documents
      FROM eval_items i LEFT JOIN items w USING (item_id) LEFT JOIN found f USING (item_id) GROUP BY i.item_id""",
    "p7_marks": f"""WITH {_LEAKS}, long AS (SELECT DISTINCT g FROM passages WHERE len(g) >= 5),
      placed AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS i, w FROM texts CROSS JOIN (SELECT DISTINCT len(g) AS n FROM long) WHERE len(w) >= n),
      hit AS (SELECT doc_id, i, n FROM placed JOIN long ON g = list_slice(w, i + 1, i + n)),
      marks AS (SELECT doc_id, count(DISTINCT p) AS leaked FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id)
      SELECT d.doc_id, coalesce(m.leaked, 0) AS leaked_words,
        CASE WHEN m.leaked IS NULL THEN 'keep' WHEN m.leaked > 0.5 * len(t.w) THEN 'drop' ELSE 'cut' END AS action
      FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN marks m USING (doc_id)""",
}

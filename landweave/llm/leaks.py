"""Evaluation passages inside a training corpus.

Every item gives its runs of ``n`` consecutive words (all its words if it has fewer). Their
hashes go to the workers as sorted arrays; a worker turns the texts of a batch into one array
of word numbers, hashes all windows at once, looks them up, and verifies every hit word by
word. Words that occur in no item have no number, so a window that holds one is never hashed.
The same pass cuts the passages out, so a text is read once and never shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a passage.
PASSAGE = 12
#: Characters of item texts that one pass sends to the workers, about 16 bytes a word; more items take more passes.
BLOCK_CHARS = 64_000_000
#: Items of fewer words are found and reported, but nothing is cut out for them: "the" would be cut out of every text.
CUT_WORDS = 5

_WORDS = re.compile(r"[^\W_]+")


class _Unseen(dict):
    """Deletes accents and characters that show nothing; filled as characters turn up."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        gone = unicodedata.combining(ch) or unicodedata.category(ch) in ("Cf", "Mn", "Me") or ch in "͏ᅟᅠㅤ"
        self[code] = None if gone else ch
        return self[code]


_UNSEEN = _Unseen()


def plain(text: str) -> str:
    """Without case, accents, width and invisible characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).translate(_UNSEEN).casefold()).translate(_UNSEEN)


def words(text: str) -> list[str]:
    return _WORDS.findall(plain(text))


def words_with_places(text: str) -> list[tuple[str, int, int]]:
    """Words and where they begin and end in the stored text."""
    pieces, places = [], []
    for i, ch in enumerate(text):
        kept = plain(ch)
        pieces.append(kept)
        places += [i] * len(kept)
    found = []
    for m in _WORDS.finditer("".join(pieces)):
        end = places[m.end() - 1] + 1
        while end < len(text) and not plain(text[end]):  # accents and invisible characters at the end
            end += 1
        found.append((m.group(), places[m.start()], end))
    return found


class PassageIndex:
    """Passages of items as arrays, by length: hashes in order, and where the words of each lie in one array of all words."""

    def __init__(self, items: list[tuple[str, str]], n: int = PASSAGE):
        self.number: dict[str, int] = {}
        self.items = [item for item, _ in items]
        flat = array("i")
        starts = [0]
        for _, text in items:
            flat.extend(self.number.setdefault(w, len(self.number) + 1) for w in words(text))
            starts.append(len(flat))
        self.words = np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, dtype=np.int32)
        rng = np.random.default_rng(12)
        self.code = rng.integers(1, 2**63, (2, len(self.number) + 1), dtype=np.uint64)
        self.odd = rng.integers(0, 2**62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        first, length = np.array(starts[:-1], dtype=np.int64), np.diff(starts)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({int(min(n, k)) for k in length if k}):
            own = np.flatnonzero((length == size) if size < n else (length >= n))
            count = length[own] - size + 1
            at = np.repeat(first[own] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            owner = np.repeat(own, count).astype(np.int32)
            one, two = (self._hash(self.words, at, size, k) for k in (0, 1))
            order = np.lexsort((owner, two, one))
            # a passage that an item repeats counts once for it
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0) | (np.diff(owner[order]) != 0)
            order = order[fresh]
            self.tables[size] = (one[order], at[order].astype(np.int32 if len(flat) < 2**31 else np.int64), owner[order])

    def _hash(self, numbers: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """Hashes of the windows of ``size`` numbers that begin at ``at``."""
        total = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            total += self.code[which][numbers[at + k]] * self.odd[k]
        return total

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """``(first word, words, item)`` of every passage in an array of word numbers (0: no item's word)."""
        zeros = np.r_[0, np.cumsum(numbers == 0)]
        for size, (hashes, starts, owners) in self.tables.items():
            if len(numbers) < size:
                continue
            at = np.flatnonzero(zeros[size:] == zeros[:-size])
            if not len(at):
                continue
            found = self._hash(numbers, at, size)
            lo, hi = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            for j in np.flatnonzero(hi > lo):
                window = numbers[at[j] : at[j] + size]
                for k in range(lo[j], hi[j]):
                    if (self.words[starts[k] : starts[k] + size] == window).all():
                        yield int(at[j]), size, self.items[owners[k]]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The hits of every text of a batch."""
        get, numbers, starts = self.number.get, [], []
        for value in texts:
            starts.append(len(numbers))
            numbers += [get(w, 0) for w in words(value)]
            numbers.append(0)  # no passage spans two texts
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        begins = np.array(starts, dtype=np.int64)
        for at, size, item in self.hits(np.array(numbers, dtype=np.int64)):
            row = int(np.searchsorted(begins, at, side="right")) - 1
            found[row].append((at - starts[row], size, item))
        return found


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size; every item with words is in one block."""
    rows = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        yield [(r["item"], r["text"]) for r in mine.collect()]


def leaked_spans(
    documents: DataFrame, key: str, text: str, items: DataFrame, item: str = "item_id", item_text: str = "item_text", n: int = PASSAGE
) -> DataFrame:
    """``key, item_id, first_word, n_words``: every passage of an item in a document.

    No shuffle: the documents are read once per block of items. Null and empty texts on either
    side give no rows; repeated rows give repeated rows.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, item_id string, first_word long, n_words int"
    parts = []
    for block in _blocks(items, item, item_text):
        sent = documents.sparkSession.sparkContext.broadcast(PassageIndex(block, n))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = sent.value.scan(batch["text"].tolist())
                sizes = [len(f) for f in found]
                if sum(sizes):
                    hits = [h for f in found for h in f]
                    yield pd.DataFrame({
                        "key": batch["key"].to_numpy().repeat(sizes), "item_id": [h[2] for h in hits],
                        "first_word": [h[0] for h in hits], "n_words": [h[1] for h in hits],
                    })

        parts.append(rows.mapInPandas(scan, schema))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    return spans.withColumnRenamed("key", key)


def leaked_items(spans: DataFrame, key: str) -> DataFrame:
    """Distinct ``key, item_id``."""
    return spans.select(key, "item_id").distinct()


def _cut(value: str, marks: list[tuple[int, int]], most_share: float) -> tuple[int, int, str, str | None]:
    """``n_words, leaked_words, action, text`` of a text with marked runs of words."""
    placed = words_with_places(value)
    leaked = np.zeros(len(placed) + 1, dtype=bool)
    for first, size in marks:
        leaked[first : first + size] = True
    n = int(leaked.sum())
    if n > most_share * len(placed):
        return len(placed), n, "drop", None
    kept, at = [], 0
    for i, (_, begin, end) in enumerate(placed):
        if leaked[i]:
            if not (i and leaked[i - 1]):
                kept.append(value[at:begin])
            at = end
    return len(placed), n, "cut", "".join([*kept, value[at:]])


def clean_documents(
    documents: DataFrame, key: str, text: str, items: DataFrame, item: str = "item_id", item_text: str = "item_text",
    n: int = PASSAGE, most_share: float = 0.5, cut_words: int = CUT_WORDS,
) -> DataFrame:
    """``key, n_words, leaked_words, action, text`` of every document: the corpus without the items.

    Words of passages are cut out together with what stands between them (``action`` is
    ``cut``); if more than ``most_share`` of the words leaked, the document is to be left out
    (``drop``, null text); any other is kept as it is (``keep``; null stays null). For items of
    fewer than ``cut_words`` words nothing is cut. One pass that finds and cuts, without a
    shuffle; items beyond BLOCK_CHARS are found pass by pass, and then the marks meet the texts
    in a join on ``key``, which must be unique.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, leaked_words long, action string, text string"
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = list(_blocks(items, item, item_text))
    sent = documents.sparkSession.sparkContext.broadcast(PassageIndex(blocks[0], n)) if len(blocks) == 1 else None
    if sent is None:
        spans = leaked_spans(documents, key, text, items, item, item_text, n)
        marks = spans.where(F.col("n_words") >= cut_words).groupBy(F.col(key).alias("of")).agg(F.collect_set(F.struct("first_word", "n_words")).alias("marks"))
        rows = rows.join(marks, F.col("key").eqNullSafe(F.col("of")), "left").drop("of")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            if sent is None:
                marked = [[(m["first_word"], m["n_words"]) for m in own] if own is not None else [] for own in batch["marks"]]
            else:
                marked = [[(a, k) for a, k, _ in own if k >= cut_words] for own in sent.value.scan([t or "" for t in texts])]
            out = [
                (k, *(_cut(t, marks, most_share) if marks else (len(words(t or "")), 0, "keep", t)))
                for k, t, marks in zip(batch["key"].tolist(), texts, marked)
            ]
            yield pd.DataFrame(out, columns=["key", "n_words", "leaked_words", "action", "text"])

    return rows.mapInPandas(clean, schema).withColumnRenamed("key", key)


def item_sizes(items: DataFrame, item: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``item_id, n_words, cuts``: the words of every item, and whether they are enough to be cut out where they occur."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(words(t or ""))).astype("int64")

    sized = items.select(F.col(item).alias("item_id"), count(item_text).alias("n_words"))
    return sized.withColumn("cuts", F.col("n_words") >= CUT_WORDS)

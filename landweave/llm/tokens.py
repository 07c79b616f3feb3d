"""Encoding with a public byte-level BPE vocabulary by a streaming transducer.

The text runs through two machines. The first cuts it into the vocabulary's words: it reads on
only until a word cannot grow any more. The second turns the bytes of a word into tokens. For
every prefix of the word there is exactly one last token of its encoding: the one that may
follow the last token of the remaining prefix, where two tokens may be neighbours if no merge
across their border comes before the merges that made them. The last tokens of the recent
prefixes are the whole state. What all recent prefixes agree on can never change, so it is
emitted; the merge list bounds how far back they may disagree, and memory stays constant on a
word of any length.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default folder of the public tokenizers' files.
FOLDER = "/opt/tokenizers"
#: The file is sent to the workers; larger ones are refused.
MOST_BYTES = 16 << 20
#: Words remembered by a worker, and the longest of them in characters.
MEMO, MEMO_CHARS = 400_000, 64

# The word pattern of the vocabulary, and the classes that a word can go on in.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CLASSES = (r"\p{L}", r"\p{N}", r"[^\p{White_Space}\p{L}\p{N}]", r"\p{White_Space}")
_WORD = regex.compile(WORDS)
_MORE = [regex.compile(f"{c}*") for c in CLASSES]
_ONE = [regex.compile(c) for c in CLASSES]
#: A match is final if so many characters follow it: the longest ending ('ll) and one to look ahead.
_MARGIN = 3


def _byte_names() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file: printable ones for themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Tokens, their parts and ranks, and which tokens may be neighbours."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        names = _byte_names()
        self.bytes_of = {i: bytes(names[c] for c in s) for s, i in model["vocab"].items() if all(c in names for c in s)}
        vocab = model["vocab"]
        self.rank_of: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs[left, right] = rank
            if whole not in self.parts:
                self.parts[whole], self.rank_of[whole] = (left, right), rank
        usable = [t for t, raw in self.bytes_of.items() if len(raw) == 1 or t in self.parts]
        self.id_of = {self.bytes_of[t]: t for t in usable}
        self.longest = max(map(len, self.id_of))
        # lengths of the tokens that end in given two bytes, longest first
        self.lengths: dict[bytes, list[int]] = {}
        for raw in self.id_of:
            if len(raw) > 1:
                self.lengths.setdefault(raw[-2:], []).append(len(raw))
        self.lengths = {k: sorted(set(v), reverse=True) for k, v in self.lengths.items()}
        self._spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes to the left that a change at the end of a prefix can reach.

        A symbol that is claimed from the right is lost to its left neighbour's merge, which has
        a later rank, and frees that neighbour for a merge of a still later rank further left.
        Ranks only rise along such a chain, so the longest chain over all merges in order of
        rank is a bound; one token is added for the end of the prefix itself.
        """
        reach: dict[int, int] = {}
        most = 0
        for token in sorted(self.parts, key=self.rank_of.__getitem__):
            left, right = self.parts[token]
            far = len(self.bytes_of[left]) + reach.get(right, len(self.bytes_of[right]))
            reach[left] = max(reach.get(left, 0), far)
            most = max(most, far)
        return most + self.longest

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols at the right (side 1) or left (0) end while ``token`` is made: symbol, rank of the merge that ends it."""
        known = self._spines[side]
        if token not in known:
            spine, ends, symbol = [], 1 << 60, token
            while True:
                spine.append((symbol, ends))
                if symbol not in self.parts:
                    break
                ends, symbol = self.rank_of[symbol], self.parts[symbol][side]
            known[token] = spine
        return known[token]

    def _crossing(self, a: int, b: int, before: int) -> bool:
        """Is there a merge over the border of ``a`` and ``b`` that comes first? Of two equal merges the left one does."""
        pairs = self.pairs
        for x, x_ends in self._spine(a, 1):
            for y, y_ends in self._spine(b, 0):
                rank = pairs.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends and rank < before:
                    return True
        return False

    def fits(self, a: int, b: int) -> bool:
        """May token ``b`` follow token ``a``?"""
        key = a << 20 | b
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            found = self._fits[key] = not self._crossing(a, b, 1 << 59)
        return found

    def whole(self, token: int) -> bool:
        """Do the token's bytes encode to the token itself?"""
        found = self._whole.get(token)
        if found is None:
            if token not in self.parts:
                found = True
            else:
                left, right = self.parts[token]
                found = self.whole(left) and self.whole(right) and not self._crossing(left, right, self.rank_of[token])
            self._whole[token] = found
        return found


class WordStream:
    """Tokens of one word whose bytes come bit by bit."""

    def __init__(self, merges: Merges, agree: bool = True):
        self.merges = merges
        self.agree = agree  # emit also what recent prefixes agree on; else by the lookahead alone
        self.held = bytearray()  # bytes after the last emitted token
        self.last: list[int] = []  # last token of each prefix of them
        self.every = 2 * merges.longest

    def feed(self, data: bytes) -> list[int]:
        """Tokens that have become final."""
        out: list[int] = []
        for at in range(0, len(data), self.every):
            self._extend(data[at : at + self.every])
            if len(self.held) > self.every:
                out += self._stable()
        return out

    def _extend(self, data: bytes) -> None:
        m, held, last = self.merges, self.held, self.last
        id_of, lengths, fits, whole = m.id_of, m.lengths, m.fits, m.whole
        for byte in data:
            held.append(byte)
            n = len(held)
            for size in (*(lengths.get(bytes(held[-2:]), ()) if n > 1 else ()), 1):
                if size > n:
                    continue
                token = id_of.get(bytes(held[n - size :]))
                if token is not None and whole(token) and (size == n or fits(last[n - size - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def _path(self, end: int) -> list[int]:
        tokens = []
        while end:
            token = self.last[end - 1]
            tokens.append(token)
            end -= len(self.merges.bytes_of[token])
        return tokens[::-1]

    def _stable(self) -> list[int]:
        """Emit up to the last border that every recent prefix has, or that the lookahead puts out of reach.

        Prefixes mostly agree within a few tokens. Where they do not, tokens that end the
        lookahead before the end cannot change any more, so no more than that is held.
        """
        n, sizes = len(self.held), self.merges.bytes_of
        front = set(range(max(0, n - self.merges.longest + 1), n + 1)) if self.agree else {0}
        far = n - self.merges.lookahead
        while len(front) > 1:
            end = max(front)
            front.discard(end)
            front.add(end - len(sizes[self.last[end - 1]]))
        border = front.pop()
        if border < far:
            border = n
            while border > far:
                border -= len(sizes[self.last[border - 1]])
        out = self._path(border)
        del self.held[:border], self.last[:border]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.held))
        self.held.clear()
        self.last.clear()
        return out


class TextStream:
    """Ids of a text that comes bit by bit."""

    #: A pending word longer than this is passed on before it ends.
    LONG = 4096

    def __init__(self, merges: Merges, memo: dict[str, list[int]]):
        self.merges, self.memo = merges, memo
        self.pending = ""
        self.word: WordStream | None = None
        self.kind = 0

    def _encode(self, word: str) -> list[int]:
        raw = word.encode()
        m = self.merges
        token = m.id_of.get(raw)
        if token is not None and m.whole(token):
            ids = [token]
        else:
            stream = WordStream(m)
            ids = stream.feed(raw) + stream.finish()
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def feed(self, text: str, last: bool = False) -> list[int]:
        """Ids that have become final; all of them with ``last``."""
        out: list[int] = []
        if self.word is not None:
            text = self._go_on(text, out, last)
            if self.word is not None:
                return out
        text = self.pending + text if self.pending else text
        safe = len(text) if last else len(text) - _MARGIN
        done, get, encode = 0, self.memo.get, self._encode
        for m in _WORD.finditer(text):
            if m.end() > safe:
                break
            word = m.group()
            ids = get(word)
            out += encode(word) if ids is None else ids
            done = m.end()
        self.pending = text[done:]
        if not last and len(self.pending) > self.LONG:
            self._open(out)
        return out

    def _open(self, out: list[int]) -> None:
        """Begin to pass on a long word that has not ended yet."""
        match = _WORD.match(self.pending)
        if match.end() < len(self.pending) - _MARGIN or match.group().startswith("'") and len(match.group()) < 4:
            return
        self.kind = next(i for i, c in enumerate(_ONE) if c.match(self.pending, len(match.group()) - 1))
        self.word = WordStream(self.merges)
        text, self.pending = self.pending, ""
        rest = self._go_on(text[1:], out, False, text[0]) if self.kind != 3 else self._go_on(text, out, False)
        if self.word is None:
            self.pending = rest

    def _go_on(self, text: str, out: list[int], last: bool, before: str = "") -> str:
        """Pass on what belongs to the open word; what follows it, once it has ended."""
        if self.kind == 3:
            text = self.pending + text
            run = _MORE[3].match(text).end()
            ended = run < len(text)
            if ended or not last:
                # the last white space may belong to what follows
                out += self.word.feed(text[: max(0, run - 1)].encode())
                self.pending = "" if ended else text[max(0, run - 1) : run]
                rest = text[max(0, run - 1) :] if ended else ""
            else:
                out += self.word.feed(text.encode())
                self.pending = rest = ""
        else:
            run = _MORE[self.kind].match(text).end()
            out += self.word.feed((before + text[:run]).encode())
            ended, rest = run < len(text), text[run:]
        if ended or last:
            out += self.word.finish()
            self.word = None
        return rest

    def encode(self, text: str, step: int = 1 << 20) -> list[int]:
        """All ids of a text, read in steps."""
        out: list[int] = []
        for at in range(0, len(text), step):
            out += self.feed(text[at : at + step], at + step >= len(text))
        self.pending, self.word = "", None
        return out


class IdStream:
    """Text of ids that come bit by bit: bytes go into an incremental UTF-8 state machine."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


_LOADED: dict[bytes, tuple[Merges, dict[str, list[int]]]] = {}


def loaded(data: bytes) -> tuple[Merges, dict[str, list[int]]]:
    """The merge list and the memory of words; made once per worker."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED[key] = (Merges(data), {})
    return _LOADED[key]


def vocabulary(name: str = "byte_bpe_50k", folder: str = FOLDER) -> bytes:
    """The vocabulary file; its size is checked as it goes to every worker."""
    path = Path(folder) / f"{name}.json"
    if path.stat().st_size > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return path.read_bytes()


def token_ids(documents: DataFrame, key: str, text: str, data: bytes) -> DataFrame:
    """``key, ids``: one row per row of ``documents``; null and empty texts give an empty list.

    Narrow: no shuffle, one pass over two columns. Special tokens' strings are ordinary text.
    """
    sent = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, memo = loaded(sent.value)
        stream = TextStream(merges, memo)
        for batch in batches:
            ids: list[int] = []
            ends = [0]
            for value in batch.column("text"):
                plain = value.as_py()
                if plain:
                    ids += stream.encode(plain)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(ids, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], ["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return rows.withColumnRenamed("key", key)


def round_trips(documents: DataFrame, key: str, text: str, data: bytes) -> DataFrame:
    """``key, n_ids, n_bytes, same``: the ids of every text, the bytes they stand for, and whether they decode to it again.

    One pass in which a text meets its own ids; null and empty texts have no ids and are the same.
    """
    sent = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, memo = loaded(sent.value)
        stream = TextStream(merges, memo)
        for batch in batches:
            n_ids, n_bytes, same = [], [], []
            for value in batch.column("text"):
                plain = value.as_py() or ""
                ids = stream.encode(plain) if plain else []
                n_ids.append(len(ids))
                n_bytes.append(sum(len(merges.bytes_of[i]) for i in ids))
                same.append(IdStream(merges).feed(ids, True) == plain)
            columns = [batch.column("key"), pa.array(n_ids, pa.int32()), pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_ids", "n_bytes", "same"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_ids int, n_bytes long, same boolean").withColumnRenamed("key", key)


def token_texts(encoded: DataFrame, key: str, data: bytes) -> DataFrame:
    """``key, text`` of ``key, ids``; null ids give a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = loaded(sent.value)
        for batch in batches:
            texts = [None if (ids := value.as_py()) is None else IdStream(merges).feed(ids, True) for value in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, text string")
    return rows.withColumnRenamed("key", key)

"""Splitting oversized texts at natural boundaries, range by range.

A text is cut into ranges of fixed size where it is read, and a worker finds the boundaries in
its range without the rest of the text. What a range cannot know by itself goes with its table:
its first and last character, the white space that it begins with, and whether it ends in a
full stop and white space. The tables of a text are stitched with these, lengths are summed up
to offsets, cuts are chosen on offsets alone, and every piece is emitted from the one range that
it begins in, which is read with a halo of a piece's length. No text is put together again, and
boundaries do not depend on where ranges begin.

Lengths and offsets count code points. A paragraph is text between line breaks; a sentence
ends, within a paragraph, at ``.``, ``!``, ``?`` or ``…`` before white space; a word is a run
without white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a range in characters; the halo of a piece's length is small beside it.
RANGE = 1 << 18
#: Ranges that are cut from a common slab, so that a long text is not run through once for every range.
SLAB = 64
KINDS = ("paragraph", "sentence", "word", "none")

_BREAKS = "\n\r\v\f\x1c-\x1e\x85\u2028\u2029"
_BREAK = re.compile(f"\r\n|[{_BREAKS}]")
_SENTENCE = re.compile(rf"(?<=[.!?…])[^\S{_BREAKS}]+")
_SPACE = re.compile(r"\s+")
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not _BREAK.match(c))
_STOPS = ".!?…"

Spans = list[tuple[int, int]]


# ---- one range ---------------------------------------------------------------------------------


def _summary(spans: Spans, n: int) -> tuple[int, int, int]:
    """Length before the first separator, longest between two, after the last; (n, -1, n) if there is none."""
    if not spans:
        return n, -1, n
    at = np.array(spans, dtype=np.int64)
    return spans[0][0], int((at[1:, 0] - at[:-1, 1]).max(initial=-1)), n - spans[-1][1]


def _merged(spans: Spans) -> Spans:
    """Sorted spans, those that touch made one."""
    marks: Spans = []
    for a, b in sorted(spans):
        if marks and a <= marks[-1][1]:
            marks[-1] = (marks[-1][0], max(b, marks[-1][1]))
        else:
            marks.append((a, b))
    return marks


def sparse_stretch(limit: int, overlap: int) -> int:
    """The longest stretch without a coarser boundary in which no cut at a word end is looked for: the shorter half of the room."""
    return limit // 2 - overlap


def range_boundaries(text: str, sparse: int = 0, with_ends: bool = True) -> dict:
    """The boundary table of one range, as if white space before it followed no full stop; the ends only if they are asked for.

    Word ends are tabled in stretches without a coarser boundary that are longer than ``sparse``.
    The first and the last stretch may go on in other ranges, so theirs are always tabled.
    ``lead`` is the length of the blanks (white space that breaks no line) that the range begins
    with, ``stop`` tells whether it ends in a full stop and blanks (1), consists of blanks (2) or
    neither (0); ``sentence_led`` is the summary if a full stop is before the range.
    """
    n = len(text)
    breaks = [m.span() for m in _BREAK.finditer(text)]
    ends = [m.span() for m in _SENTENCE.finditer(text)]
    lead = n - len(text.lstrip(_BLANKS))
    inner = len(text.rstrip(_BLANKS))
    marks = _merged(breaks + ends)
    gaps = [m.span() for m in _SPACE.finditer(text)]
    table = {
        "n": n,
        "first": text[:1],
        "last": text[-1:],
        "lead": lead,
        "stop": 2 if lead == n else int(text[inner - 1] in _STOPS),
        "paragraph": _summary(breaks, n),
        "sentence": _summary(marks, n),
        "sentence_led": _summary(_merged([(0, lead), *marks]), n) if lead else _summary(marks, n),
        "word": _summary(gaps, n),
    }
    if not with_ends:
        return table
    paragraph_ends = [b for _, b in breaks]
    sentence_ends = [b for _, b in ends]
    ends_inside = {*paragraph_ends, *sentence_ends}
    word_ends: list[int] = []
    if gaps:
        coarse = np.array(sorted({0, *ends_inside, n}), dtype=np.int64)
        bare = np.diff(coarse) > sparse
        bare[[0, -1]] = True
        stops = np.array([b for _, b in gaps], dtype=np.int64)
        stops = stops[bare[np.searchsorted(coarse, stops) - 1]]
        word_ends = [b for b in stops.tolist() if b not in ends_inside]
    return table | {"paragraph_ends": paragraph_ends, "sentence_ends": sentence_ends, "word_ends": word_ends}


# ---- stitching the tables of a text ------------------------------------------------------------


def _led(tables: pd.DataFrame) -> list[bool]:
    """Of every range in order: do its first blanks follow a full stop?"""
    found, state = [], False
    for n, stop in zip(tables["n"], tables["stop"]):
        found.append(state)
        if n and stop != 2:
            state = bool(stop)
    return found


def stitched_ends(tables: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where the ranges of a text begin (and where it ends), and the ends of each kind, as offsets in the text."""
    first = np.r_[0, np.cumsum(tables["n"].to_numpy(dtype=np.int64))]
    ends: dict[str, list[np.ndarray]] = {k: [] for k in KINDS[:3]}
    led = _led(tables)
    following, after = [], ""
    for c in reversed(tables["first"].tolist()):
        following.append(after)
        after = c or after
    following.reverse()
    for i, row in enumerate(tables[["n", "last", "lead", *[f"{k}_ends" for k in KINDS[:3]]]].itertuples(index=False)):
        n, last, lead = row[:3]
        after = following[i]
        for kind, values in zip(KINDS[:3], row[3:]):
            own = np.asarray(values, dtype=np.int64)
            if kind == "sentence" and led[i] and lead:
                own = np.r_[lead, own]
            # what ends with the range goes on if the next one begins with more of it
            goes_on = last == "\r" and after == "\n" if kind == "paragraph" else after in _BLANKS if kind == "sentence" else after.isspace()
            if len(own) and own[-1] == n and after and goes_on:
                own = own[:-1]
            ends[kind].append(own + first[i])
    return first, {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in ends.items()}


def choose_cuts(n: int, ends: dict[str, np.ndarray], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces ``(start, end, boundary)`` that cover ``n`` characters; each repeats the last ``overlap`` of the one before.

    A cut is the last paragraph end in the second half of the room, else sentence end, else word
    end; then the same in the first half; else it is at the limit. The last piece ends with the text.
    """
    pieces, start = [], 0
    while n - start > limit:
        cut, kind = start + limit, "none"
        for low, high in ((start + max(limit // 2, overlap), start + limit), (start + overlap, start + limit // 2)):
            for name in KINDS[:3]:
                i = np.searchsorted(ends[name], high, side="right") - 1
                if i >= 0 and ends[name][i] > low and ends[name][i] < n:
                    cut, kind = int(ends[name][i]), name
                    break
            if kind != "none":
                break
        pieces.append((start, cut, kind))
        start = cut - overlap
    pieces.append((start, n, "end"))
    return pieces


# ---- the ranges of texts in a table ------------------------------------------------------------


def _version(stamp: str, text: str) -> dict[str, Column]:
    """What tells versions of a text apart: the stamp, the length and a 64-bit digest."""
    return {"stamp": F.col(stamp), "length": F.coalesce(F.char_length(text), F.lit(-1)), "digest": F.xxhash64(text)}


VERSION = ("key", "stamp", "length", "digest")


def oversized(texts: DataFrame, key: str, text: str, stamp: str, limit: int) -> DataFrame:
    """``key, stamp, length, digest`` of the current rows with more than ``limit`` code points, one per key.

    The current row has the greatest stamp; of rows that tie the longest. Only keys, stamps,
    lengths and digests are shuffled, counted down within each task first. A null text has no
    length; null keys are left out.
    """
    parts = _version(stamp, text)
    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.struct(*[c.alias(n) for n, c in parts.items()]).alias("version"))
    newest = rows.groupBy("key").agg(F.max("version").alias("v"))
    return newest.where(F.col("v.length") > limit).select("key", *[F.col(f"v.{n}").alias(n) for n in parts])


def text_ranges(texts: DataFrame, key: str, text: str, stamp: str, limit: int, *, size: int = RANGE, ahead: int = 0) -> DataFrame:
    """``key, stamp, length, digest, range, text`` of all texts longer than ``limit``, cut where they are read.

    A range has ``size`` characters and ``ahead`` more, as far as the text has them.
    """
    slab = size * SLAB
    rows = texts.where(F.col(key).isNotNull() & (F.char_length(text) > limit))
    named = rows.select(F.col(key).cast("string").alias("key"), *[c.alias(n) for n, c in _version(stamp, text).items()], F.col(text).alias("text"))
    piece = lambda at, n: F.substring("text", (at * n + 1).cast("int"), F.lit(n + ahead))
    count = lambda length, n: F.sequence(F.lit(0), F.greatest(F.ceil(length / n).cast("int") - 1, F.lit(0)))
    slabs = named.select(*VERSION, "text", F.explode(count(F.col("length"), slab)).alias("slab")).select(*VERSION, "slab", piece(F.col("slab"), slab).alias("text"))
    inside = F.least(F.col("length") - F.col("slab") * slab, F.lit(slab))
    ranges = slabs.select(*VERSION, "slab", "text", F.explode(count(inside, size)).alias("at"))
    return ranges.select(*VERSION, (F.col("slab") * SLAB + F.col("at")).cast("long").alias("range"), piece(F.col("at"), size).alias("text"))


_TABLE = "n long, first string, last string, lead long, stop int, paragraph array<long>, sentence array<long>, sentence_led array<long>, word array<long>"
_ENDS = "paragraph_ends array<long>, sentence_ends array<long>, word_ends array<long>"


def boundary_tables(ranges: DataFrame, sparse: int = 0, *, with_ends: bool = True) -> DataFrame:
    """The boundary table of every range, with all other columns of the range kept; without ends for ``coarsest_boundary``.

    ``sparse_stretch`` gives what a limit allows, 0 serves every limit.
    """
    kept = [c for c in ranges.columns if c != "text"]

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                tables = pd.DataFrame([range_boundaries(t, sparse, with_ends) for t in batch["text"]])
                yield pd.concat([batch[kept].reset_index(drop=True), tables], axis=1)

    kinds = dict(ranges.dtypes)
    return ranges.mapInPandas(detect, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", " + ", ".join([_TABLE, *([_ENDS] if with_ends else [])]))


def current_tables(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, range`` and the table of the wanted versions; repeated rows give one table.

    Repeats are brought down to one within each task before anything is shuffled.
    """
    columns = [c for c in tables.columns if c not in (*VERSION, "range")]
    once = tables.groupBy(*VERSION, "range").agg(F.any_value(F.struct(*columns)).alias("t"))
    w = wanted.select(*[F.col(c).alias(f"w_{c}") for c in VERSION])
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) if c == "stamp" else F.col(c) == F.col(f"w_{c}") for c in VERSION]
    return once.join(w, same, "left_semi").select(*VERSION, "range", "t.*")


def _longest(kind: str) -> Column:
    """Longest text between separators of a kind, over the ranges ``t`` of a text in order."""
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(long(0).alias("longest"), long(0).alias("run"), F.lit(False).alias("led"))

    def step(s: Column, t: Column) -> Column:
        parts = F.when(s["led"], t["sentence_led"]).otherwise(t["sentence"]) if kind == "sentence" else t[kind]
        head, inner, tail = parts[0], parts[1], parts[2]
        without = (inner < 0) & (head == t["n"]) & (tail == t["n"])
        return F.struct(
            F.when(without, s["longest"]).otherwise(F.greatest(s["longest"], s["run"] + head, inner)).alias("longest"),
            F.when(without, s["run"] + t["n"]).otherwise(tail).alias("run"),
            F.when((t["n"] > 0) & (t["stop"] != 2), t["stop"] == 1).otherwise(s["led"]).alias("led"),
        )

    return F.aggregate("t", start, step, lambda s: F.greatest(s["longest"], s["run"]))


def coarsest_boundary(tables: DataFrame, limit: int) -> DataFrame:
    """``key, boundary``: the coarsest kind of boundary at which every part has at most ``limit``.

    ``tables`` has one version of every key; the few numbers of a text's ranges meet, no ends.
    """
    numbers = F.struct("range", "n", "stop", "paragraph", "sentence", "sentence_led", "word")
    texts = tables.groupBy("key").agg(F.array_sort(F.collect_list(numbers)).alias("t"))
    found = F.lit("none")
    for kind in reversed(KINDS[:3]):
        found = F.when(_longest(kind) <= limit, kind).otherwise(found)
    return texts.select("key", found.alias("boundary"))


def piece_offsets(tables: DataFrame, limit: int, overlap: int) -> DataFrame:
    """``key, piece, start, end, boundary, range, begin`` and what else tells versions apart.

    ``range`` is the one that the piece begins in and ``begin`` the place there. The tables of a
    text meet in one task: about a hundredth of the text.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    kinds = dict(tables.dtypes)
    version = [c for c in VERSION if c in kinds]

    def stitch(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("range")
        first, ends = stitched_ends(table)
        pieces = choose_cuts(int(first[-1]), ends, limit, overlap)
        start = np.array([p[0] for p in pieces], dtype=np.int64)
        # of ranges that begin at one place the last has characters
        at = np.minimum(np.searchsorted(first, start, side="right") - 1, len(table) - 1)
        return pd.DataFrame({
            **{c: [table[c].iloc[0]] * len(pieces) for c in version}, "piece": range(len(pieces)), "start": start,
            "end": [p[1] for p in pieces], "boundary": [p[2] for p in pieces], "range": table["range"].to_numpy()[at], "begin": start - first[at],
        })

    schema = ", ".join(f"{c} {kinds[c]}" for c in version) + ", piece long, start long, end long, boundary string, range long, begin long"
    return tables.groupBy("key").applyInPandas(stitch, schema)


def emit_pieces(offsets: DataFrame, ranges: DataFrame) -> DataFrame:
    """``key, piece, start, end, boundary, text``: each piece out of the range that it begins in.

    The ranges were read with a halo of at least a piece's length. They are shuffled once; of
    repeated rows one is kept in the same exchange.
    """
    keys = [c for c in (*VERSION, "range") if c in ranges.columns]
    once = ranges.groupBy(*keys).agg(F.any_value("text").alias("text"))
    named = offsets.select(*[F.col(c).alias(f"o_{c}") for c in keys], "piece", "start", "end", "boundary", "begin")
    same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) if c == "stamp" else F.col(c) == F.col(f"o_{c}") for c in keys]
    stretch = F.substring("text", F.col("begin").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return once.join(named, same).select("key", "piece", "start", "end", "boundary", stretch.alias("text"))


# ---- the ranges of files -----------------------------------------------------------------------


def _open(path: str):  # noqa: ANN202
    """A file that can be read at any place: of any file system by URI, or a local path."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def _character(handle, at: int, size: int) -> int:  # noqa: ANN001
    """The first byte from ``at`` on that begins a character; of damaged bytes at most three are passed over."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    near = handle.read_at(min(4, size - at), at)
    return at + next((i for i, b in enumerate(near[:3]) if b & 0xC0 != 0x80), min(3, len(near)))


def file_ranges(paths: DataFrame, size: int = 1 << 20, ahead: int = 0) -> DataFrame:
    """``key, range, text`` of UTF-8 files by byte ranges; no file is read as a whole.

    ``paths`` has ``key, path`` (null paths are left out); paths are URIs, or local to every
    worker. A worker reads its range, from the first character that begins in it, and ``ahead``
    characters more. Damaged bytes become U+FFFD. An empty file gives one empty range.
    """

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, path in batch[["key", "path"]].itertuples(index=False):
                with _open(path) as handle:
                    n = max(1, -(-handle.size() // size))
                yield pd.DataFrame({"key": key, "path": path, "range": range(n)})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, path, number in batch[["key", "path", "range"]].itertuples(index=False):
                with _open(path) as handle:
                    whole = handle.size()
                    begin, end = (_character(handle, k * size, whole) for k in (number, number + 1))
                    text = handle.read_at(end - begin, begin).decode("utf-8", "replace")
                    if ahead:
                        text += handle.read_at(min(4 * ahead, whole - end), end).decode("utf-8", "replace")[:ahead]
                yield pd.DataFrame({"key": [key], "range": [number], "text": [text]})

    planned = paths.where(F.col("path").isNotNull()).select(F.col("key").cast("string").alias("key"), "path")
    planned = planned.mapInPandas(plan, "key string, path string, range long").repartition("key", "range")
    return planned.mapInPandas(read, "key string, range long, text string")


def write_files(texts: DataFrame, folder: str) -> DataFrame:
    """``key, path``: every text of ``key, text`` as a file of its own in a folder that all workers share.

    A file is written beside its name and renamed, so a task that is run again does no harm.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import uuid

        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(inside, recursive=True)
        for batch in batches:
            paths = []
            for key, text in batch[["key", "text"]].itertuples(index=False):
                name = hashlib.md5(key.encode()).hexdigest() + ".txt"
                beside = f"{inside}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as out:
                    out.write(text.encode("utf-8", "replace"))
                system.move(beside, f"{inside}/{name}")
                paths.append(f"{folder}/{name}")
            yield pd.DataFrame({"key": batch["key"], "path": paths})

    return texts.mapInPandas(write, "key string, path string")

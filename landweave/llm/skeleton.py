"""One consistent form of text that looks the same: confusables skeletons.

A skeleton decomposes the text, replaces every character by the prototype that it looks like,
and decomposes again. Equal skeletons mean that texts look alike; letter case, accents, digits
and punctuation stay apart, and no Latin letter is taken for another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from landweave.operators.scale import heavy_join
from landweave.session import cut_lineage

# Letters of other scripts that have the shape of a Latin letter, by prototype. The
# full table of look-alikes comes from ``look_alikes``; what is here holds without a session and comes first.
SAME_SHAPE = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧ", "I": "ΙІӀꓲ",
    "J": "ЈᎫꓙͿ", "K": "ΚКᏦꓗ", "L": "ᏞꓡⳐ", "M": "ΜМᎷꓟϺ", "N": "ΝꓠⲚ", "O": "ΟОՕꓳⲞ", "P": "ΡРᏢꓑⲢ", "Q": "Ԛ", "R": "Ꭱꓣ",
    "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔⲦ", "U": "ՍꓴՍ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХꓫⲬ", "Y": "ΥҮꓬⲨ", "Z": "ΖᏃꓜ",
    "a": "аɑα", "c": "сϲⲥ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κк", "l": "ӏ", "n": "ոռ",
    "o": "οоօⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝա", "x": "хⲭ", "y": "уү",
}
# Signs that stand for several letters and have no compatibility decomposition.
SEVERAL = {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae", "Ꜩ": "TZ", "ꜩ": "tz", "Ꜳ": "AA", "ꜳ": "aa", "ᵫ": "ue"}
# Forms of the apostrophe and of the hyphen.
APOSTROPHES = "’‘‛ʼʻʹʽˈˊˋ′‵`´΄՚׳ꞌꞋ＇｀"
HYPHENS = "‐‑‒–−﹘﹣－⁃˗➖Ⲻ۔"
# Decompositions that change how a letter is encoded but not how it looks.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<isolated>", "<final>", "<initial>", "<medial>")
# Characters that show nothing although their category does not tell.
BLANKS = "͏ᅟᅠ឴឵ㅤﾠ⠀"


def _is_hyphen(ch: str) -> bool:
    """A hyphen of any script by its name, as well as the signs that have its form."""
    return ch in HYPHENS or (unicodedata.category(ch) == "Pd" and ("HYPHEN" in (name := unicodedata.name(ch, "")) or "MAQAF" in name))


def _prototype(ch: str, alike: Mapping[str, str]) -> str | None:
    """What a decomposed character is replaced by; None if by itself."""
    if ch in APOSTROPHES:
        return "'"
    if _is_hyphen(ch):
        return "-"
    if ch in SEVERAL:
        return SEVERAL[ch]
    kind = unicodedata.category(ch)
    if ch == "⠀" or kind in ("Zs", "Zl", "Zp") or (kind == "Cc" and ch.isspace()):
        return " "
    if kind in ("Cf", "Cc") or ch in BLANKS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    for latin, others in SAME_SHAPE.items():
        if ch in others:
            return latin
    if ch in alike:
        first = alike[ch]  # not in the table itself
        return first if (p := _prototype(first, alike)) is None else p
    parts = unicodedata.decomposition(ch)
    if parts.startswith(SAME_LOOK):
        plain = "".join(chr(int(x, 16)) for x in parts.split()[1:])
        spacing_accent = plain[0] == " " and len(plain) > 1
        latin_letter = kind[0] == "L" and len(plain) == 1 and ord(ch) < 0x2000
        if not spacing_accent and not (latin_letter and unicodedata.name(ch, "").startswith("LATIN")):
            return "".join(x if (p := _prototype(x, alike)) is None else p for x in plain)
    return None


# ---- the table of look-alikes ------------------------------------------------------------------


def _kind(ch: str) -> str:
    """Upper case, lower case, other letter, digit, or nothing that look-alikes are looked for."""
    return {"Lu": "upper", "Lt": "upper", "Ll": "lower", "Lo": "other", "Lm": "other", "Nd": "digit"}.get(unicodedata.category(ch), "")


def classes_of(prototypes: Mapping[str, str]) -> dict[str, str]:
    """Look-alikes of every script from the public table of confusables, ``character: prototype``.

    That table takes Latin letters, digits and signs for each other (I, l, 1 and the bar are one
    class there). Here a class has letters of one case, or digits, only: its members are replaced
    by the ASCII one, else by the prototype, else by the first. Latin letters, which are never
    replaced, ideographs, and characters with a compatibility form are left out.
    """
    classes: dict[tuple[str, str], list[str]] = {}
    for ch, proto in prototypes.items():
        if _kind(ch) and len(proto) == 1 and not unicodedata.decomposition(ch).startswith("<"):
            classes.setdefault((_kind(ch), proto), []).append(ch)
    found: dict[str, str] = {}
    for (kind, proto), members in classes.items():
        members.sort()
        latin = [c for c in members if unicodedata.name(c, "").startswith(("LATIN", "DIGIT"))]
        first = members[0]
        if latin:
            # one Latin letter of the case, or ASCII digit, in the class; several would be taken for each other
            first = proto if proto in latin else latin[0]
        elif _kind(proto) == kind or (kind == "other" and _kind(proto) in ("upper", "lower")):
            first = proto
        found |= {c: first for c in members if c not in latin and c != first}
    return found


_LOADED: dict[str, str] = {}


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """The full table, read once from the ICU library that Spark brings along; some thousand entries."""
    if not _LOADED:
        ideograph = lambda c: 0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or c >= 0x20000
        chars = [c for c in map(chr, range(0x30, 0x20000)) if _kind(c) and not ideograph(ord(c))]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        # nothing is joined or reordered across a line break
        _LOADED.update(classes_of(dict(zip(chars, checker.getSkeleton("\n".join(chars)).split("\n"), strict=True))))
    return _LOADED


class _Table(dict):
    """``str.translate`` table that is filled as characters turn up; bounded by Unicode."""

    def __init__(self, alike: Mapping[str, str]):
        self.alike = alike

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        found = _prototype(ch, self.alike)
        self[code] = ch if found is None else found
        return self[code]


_PLAIN = _Table({})
_RUN = re.compile(" {2,}")


def skeleton(text: str | None, table: _Table = _PLAIN) -> str | None:
    """The skeleton of a text; null for null."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFD", text).translate(table)
    return _RUN.sub(" ", unicodedata.normalize("NFD", plain)).strip(" ")


#: Stands between the texts of a batch; no character, and the table keeps it.
_BETWEEN = "\U0010ffff"


def skeletons(texts: list[str], table: _Table = _PLAIN) -> list[str]:
    """The skeletons of a batch, all at once: nothing combines across the sign between them."""
    if any(_BETWEEN in t for t in texts):
        return [skeleton(t, table) for t in texts]
    return [t.strip(" ") for t in skeleton(_BETWEEN.join(texts), table).split(_BETWEEN)] if texts else []


def uniform(text: str | None) -> str | None:
    """The skeleton in composed form, for display and storage."""
    plain = skeleton(text)
    return None if plain is None else unicodedata.normalize("NFC", plain)


def skeleton_udf(spark: SparkSession) -> Callable[[str], Column]:
    """The skeleton of a text column, by the full table."""
    alike = dict(look_alikes(spark))

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _Table(alike)
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            there = texts.notna().to_numpy()
            out[there] = skeletons(texts[there].tolist(), table)
            yield out

    return run


def with_skeletons(texts: DataFrame) -> DataFrame:
    """Every distinct stored form of ``field, text`` once, with its ``skeleton`` and its number of rows ``n``.

    The forms are made distinct first (partial aggregation), so a text that a third of all rows
    share is decomposed once. Null texts have no form.
    """
    forms = texts.where(F.col("text").isNotNull()).groupBy("field", "text").agg(F.count("*").alias("n"))
    return forms.withColumn("skeleton", skeleton_udf(texts.sparkSession)("text"))


def _digest(*columns: str) -> Column:
    """128 bits of a text, which stand for it from the first aggregation on."""
    return F.unhex(F.md5(F.concat_ws("\x00", *columns)))


def look_classes(texts: DataFrame) -> DataFrame:
    """``field, key, group_id, n_links``: the class of texts that look the same, and to how many other keys whose text is stored otherwise.

    One row per row of ``texts`` (``field, key, text``, one row per field and key) with a key and
    a text. A form that a third of all rows share stays where its rows are: its class is
    broadcast to them.
    """
    rows = texts.where(F.col("key").isNotNull() & F.col("text").isNotNull())
    forms = cut_lineage(with_skeletons(rows).select("field", _digest("field", "text").alias("form"), F.md5("skeleton").alias("group_id"), "n"))
    total = forms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = forms.groupBy("field", "group_id").agg(F.sum("n").alias("all"))
    side = forms.join(sizes, ["field", "group_id"]).select("form", "group_id", "n", (F.col("all") - F.col("n")).alias("n_links"))
    named = rows.select("field", "key", _digest("field", "text").alias("form"))
    return heavy_join(named, side, "form", "n", total).select("field", "key", "group_id", "n_links")


#: Parts over which the keys of a form are spread where pairs of keys are asked for.
SPREAD = 32


def same_looking(texts: DataFrame) -> DataFrame:
    """``field, key_a, key_b``: pairs of different keys whose texts look the same but differ as stored.

    ``texts`` has ``field, key, text``. Pairs are made between stored forms, of which a skeleton
    has few, and only forms that have a partner are joined back to their keys, spread over parts;
    copies of one form never meet each other. Texts travel as 128-bit digests after the first
    aggregation. A text without visible characters equals every other such text. Null keys and
    null texts give no pairs. The pairs are asked for as such; ``look_classes`` says the same in
    one row per key.
    """
    rows = texts.where(F.col("key").isNotNull() & F.col("text").isNotNull())
    forms = cut_lineage(with_skeletons(rows).select("field", _digest("field", "text").alias("form"), _digest("skeleton").alias("look")))
    several = forms.groupBy("field", "look").agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    varied = forms.join(several, ["field", "look"])
    other = varied.withColumnRenamed("form", "form_b")
    met = varied.withColumnRenamed("form", "form_a").join(other, ["field", "look"]).where(F.col("form_a") < F.col("form_b")).drop("look")
    parts = lambda name: F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias(name)
    part = F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int")
    keys = rows.select("field", _digest("field", "text").alias("form"), "key").join(varied.select("form"), "form", "left_semi").distinct()
    left = keys.select(F.col("form").alias("form_a"), F.col("key").alias("left"), part.alias("part_a"))
    right = keys.select(F.col("form").alias("form_b"), F.col("key").alias("right"), part.alias("part_b"))
    pairs = met.select("*", parts("part_a")).join(left, ["form_a", "part_a"]).select("*", parts("part_b")).join(right, ["form_b", "part_b"])
    apart = pairs.where(F.col("left") != F.col("right"))
    return apart.select("field", F.least("left", "right").alias("key_a"), F.greatest("left", "right").alias("key_b")).distinct()

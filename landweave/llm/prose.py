"""Text statistics per document, and from them whether it is prose, list, table or junk.

Thresholds on statistics are noisy labelling functions: each votes for one type or abstains.
How often each is right is not set but learned, by expectation-maximization on how they agree
over all documents. A document enters only through its pattern of votes, so the learning runs
on the counts of patterns. The posterior of a pattern is the type of its documents; a document
on which every function abstains has no type. Functions that look at words abstain where the
text is in none of the languages whose common words are known, and those that look at the shape
of words where its script is not Latin or puts no blanks between words.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.session import cut_lineage

#: Latent types; prose and junk come in kinds that have little in common, so each has its own.
TYPES = ("prose", "prose: wrapped", "list", "table", "junk: signs", "junk: repetition", "junk: order")
#: Common words, which go to all workers; a larger table is refused, as that is no list of function words.
MOST_WORDS = 100_000
#: Pairs of neighbouring common words whose counts go to all workers, the most frequent ones; those of rarer ones meet their texts in a shuffle.
MOST_PAIRS = 4_000_000
#: Patterns of votes that are learned from on the driver; more are learned from where they lie, by the same steps.
MOST_PATTERNS = 200_000
#: Words of a window in which different words are counted, so that the share does not depend on a text's length.
WINDOW = 100

# Fixed patterns of text layout.
_BREAKS = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")
_DAMAGED = re.compile(r"[ÃÂâï][\u0080-¿€™ŒœŠšŸŽžƒˆ˜–-›]|[�\u0000-\u0008\u000e-\u001b]|[ÃÂ]")
_DAMAGE_SIGNS = frozenset("ÃÂâï\ufffd").union(map(chr, range(9)), map(chr, range(14, 28)))
_BULLET = re.compile(r"\s*(?:[•·▪▫●○◦‣⁃∙*+\-–—>]|\(?\d{1,4}[.):]|\(?[a-zA-Z][.)])\s+\S")
_HEADING = re.compile(r"\s*(?:=+ .* =+|#{1,6} .*|[^.!?;,|]{1,60} ?:)\s*")
_RULING_SIGNS, _RULING_STARTS = frozenset("-=+|: \t"), tuple("{|-=+:")
_WIDE, _COMMA = re.compile(r" {2,}|\t"), re.compile(r",(?=\S)")
_INNER_STOP = re.compile(r"[^\W\d]{2}[.!?…] +[^\W\d_]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"»”]+")
_LATIN = re.compile(r"[a-z\u00df-\u024f]+")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}")
_WORD = re.compile(r"[^\W\d_]+")
# Letters of scripts that write words without blanks between them: Thai to Myanmar, Khmer, Chinese and Japanese.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u30ff\u3400-\u9fff\uf900-\ufaff]|[\U00020000-\U0003ffff]")
_CLOSED = tuple(".!?…\"»”")

STATISTICS = (
    "n_words", "mean_word_len", "symbol_ratio", "letter_ratio", "digit_ratio", "punct_line_share", "common_share", "common_any",
    "n_lines", "words_per_line", "bullet_share", "cell_share", "wrap_share", "inner_stops", "unique_share", "repeat_share",
    "top_word_share", "top_char_share", "longest_token", "odd_word_share", "damage_share", "sentence_share", "cohesion", "n_pairs", "packed",
)


_HIDDEN = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cf")


def _clean(text: str) -> str:
    """Compatible forms composed, characters that show nothing removed."""
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    for c in _HIDDEN.intersection(text):
        text = text.replace(c, "")
    return text


@lru_cache(100_000)
def _odd(word: str) -> bool:
    """A Latin word of three letters or more without a vowel, or with five consonants on end."""
    if not _LATIN.fullmatch(word):
        return False
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return (len(word) > 2 and not any(c in "aeiouyæøœıə" for c in plain)) or bool(_CLUSTER.search(word))


_NOTHING = dict.fromkeys(STATISTICS)


class CommonWords:
    """Common words per language, and a number for every pair of neighbouring ones in a language."""

    def __init__(self, langs: dict[str, set[str]]):
        self.langs = [frozenset(langs[k]) for k in sorted(langs)]
        self.every = frozenset().union(*self.langs) if self.langs else frozenset()
        self.number = {w: i for i, w in enumerate(sorted(self.every))}

    def language(self, tally: Counter) -> tuple[int, int]:
        """The language with most common words in a text, what it claims of itself is not asked, and how many they are."""
        best, most = -1, 0
        for i, lang in enumerate(self.langs):
            hits = sum(tally[w] for w in lang & tally.keys())
            if hits > most:
                best, most = i, hits
        return best, most

    def pairs(self, tokens: list[str], lang: int) -> list[int]:
        """Pairs of common words of the language with nothing but white space between, as numbers."""
        if lang < 0:
            return []
        known, number, n = self.langs[lang], self.number, len(self.number)
        first, found, before = lang * n, [], None
        for t in tokens:
            if t in known:
                if before is not None:
                    found.append((first + before) * n + number[t])
                before = number[t]
            elif t.isalpha():
                before = None
            else:
                # signs and digits cling to the token: its first and its last word count if they are at its ends
                if before is not None and (m := _WORD.match(t)) and m.group() in known:
                    found.append((first + before) * n + number[m.group()])
                before = None
                if t[-1].isalpha() and (last := _WORD.findall(t)[-1:]) and last[0] in known:
                    before = number[last[0]]
        return found


def _is_ruling(line: str) -> bool:
    """A line that only draws a table: dashes and bars, or the begin, row and end marks of a wiki table."""
    bare = line.strip()
    return bare[:1] in _RULING_STARTS and (bare.startswith(("{|", "|-", "|}")) or (("--" in bare or "==" in bare) and _RULING_SIGNS.issuperset(bare)))


def _paragraphs(text: str) -> list[list[str]]:
    """Lines with something on them by paragraph: blank lines, headings and rulings of tables end one
    and are left out. A text of headings and rulings only is kept as it is."""
    paragraphs: list[list[str]] = [[]]
    first = True
    for line in _BREAKS.split(text):
        line = line.rstrip()
        start = line.lstrip()[:1]
        marked = start in ("=", "#")
        heading = (marked or (first and line.endswith(":"))) and (first or marked) and _HEADING.fullmatch(line)
        if not line or heading or _is_ruling(line):
            paragraphs.append([])
        else:
            paragraphs[-1].append(line)
        first = first and not line
    kept = [p for p in paragraphs if p]
    return kept or [[x.rstrip() for x in _BREAKS.split(text) if x.strip()]]


def _is_row(line: str) -> bool:
    """Does the line consist of short cells?"""
    if line.count("|") > 1 and _short(line.strip("| \t").split("|")):
        return True
    if line.count('","') > 1 and _short(line.split('","')):
        return True
    if ("\t" in line or "  " in line) and _short(_WIDE.split(line.strip())):
        return True
    if line.count(";") > 1 and _short(line.rstrip("; ").split(";")):
        return True
    return line.count(",") > 1 and _short(_COMMA.split(line))


def _short(cells: list[str]) -> bool:
    return len(cells) >= 3 and max(len(c.split()) for c in cells) <= 8


def statistics(text: str, common: CommonWords) -> tuple[dict[str, float], list[int]]:
    """The statistics of one text that is not blank, all but ``cohesion``, and its pairs of common words."""
    clean = _clean(text)
    paragraphs = _paragraphs(clean)
    body = [line for p in paragraphs for line in p]
    joined = "\n".join(body)
    low = joined.lower()
    tokens, words = low.split(), _WORD.findall(low)
    n, chars, longest = len(words), max(1, sum(map(len, tokens))), max(map(len, tokens), default=0)
    tally = Counter(words)
    signs = Counter(joined)
    letters, digits, top = sum(map(len, words)), 0, 0
    for c, k in signs.items():
        if c.isdecimal():
            digits += k
        if k > top and not c.isspace():
            top = k
    # shares of lines are weighted with their tokens: a short list does not make prose a list
    sizes = [len(x.split()) for x in body]
    size = max(1, sum(sizes))
    half, per_line = (size - (not any(sizes))) // 2, 0
    for k in sorted(sizes):
        half -= k
        if half < 0:
            per_line = k
            break
    share = lambda holds: sum(k for k, x in zip(sizes, body) if holds(x)) / size
    lengths = sorted(map(len, body))
    # wrapped lines end where the next word would not have fitted; a few lines may be longer
    joins = [(len(a), len(a) + 1 + len(b.split(None, 1)[0])) for p in paragraphs if len(p) > 1 for a, b in pairwise(p)]
    widths = {lengths[int(q * (len(lengths) - 1))] for q in (0.85, 0.9, 0.95, 1)} if joins else set()
    ends, fits = sorted(a for a, _ in joins), sorted(b for _, b in joins)
    wrapped = max((bisect_right(ends, w) - bisect_left(fits, w) for w in widths), default=0)
    sentences = [s for s in (x.strip() for x in _SENTENCE.split(joined.replace("\n", " "))) if s]
    long_ones = [len(s.split()) for s in sentences]
    repeats = max(
        1 - len(set(sentences)) / len(sentences) if len(sentences) > 2 else 0.0,
        1 - len({x.strip() for x in body}) / len(body) if len(body) > 2 else 0.0,
    )
    damaged = 0 if text.isascii() and text.isprintable() or _DAMAGE_SIGNS.isdisjoint(text) else len(_DAMAGED.findall(text))
    lang, hits = common.language(tally)
    pairs = common.pairs(tokens, lang)
    raw = joined.encode("utf-8", "replace")
    distinct = sum(len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW))
    return {
        "n_words": n,
        "mean_word_len": letters / n if n else 0.0,
        "symbol_ratio": 1 - (letters + digits) / chars,
        "letter_ratio": letters / chars,
        "digit_ratio": digits / chars,
        "punct_line_share": sum(x.endswith(_CLOSED) for x in body) / max(1, len(body)),
        "common_share": hits / n if n else 0.0,
        "common_any": sum(tally[w] for w in common.every & tally.keys()) / n if n else 0.0,
        "n_lines": len(body),
        "words_per_line": per_line,
        "bullet_share": share(lambda x: bool(_BULLET.match(x)) or x[0] == "\t"),
        "cell_share": share(_is_row),
        "wrap_share": wrapped / len(joins) if joins else 0.0,
        "inner_stops": len(_INNER_STOP.findall(joined)) / max(1, len(body)),
        "unique_share": distinct / n if n else 0.0,
        "repeat_share": repeats,
        "top_word_share": max(tally.values(), default=0) / n if n else 0.0,
        "top_char_share": top / chars,
        "longest_token": longest if longest < 60 else max((len(t) for t in tokens if not _UNSPACED.search(t)), default=0),
        "odd_word_share": sum(c for w, c in tally.items() if _odd(w)) / n if n else 0.0,
        "damage_share": damaged / chars,
        "sentence_share": sum(k for k in long_ones if 5 <= k <= 60) / max(1, sum(long_ones)),
        "n_pairs": len(pairs),
        "packed": len(zlib.compress(raw, 6)) / max(1, len(raw)),
    }, pairs


#: Labelling functions: name, type voted for, condition on the statistics. Thresholds are set by
#: what the statistics mean; their worth is learned.
FUNCTIONS = (
    ("bullets", "list", lambda s: (s["bullet_share"] >= 0.6) & (s["n_lines"] >= 3) & (s["cell_share"] < 0.5)),
    ("short_lines", "list", lambda s: (s["n_lines"] >= 4) & (s["words_per_line"] <= 9) & (s["wrap_share"] < 0.7) & (s["inner_stops"] < 0.1) & (s["cell_share"] < 0.4) & (s["repeat_share"] < 0.5)),
    ("loose_lines", "list", lambda s: (s["n_lines"] >= 4) & (s["words_per_line"] <= 9) & (s["cell_share"] < 0.4) & (s["n_pairs"] > 2) & (s["cohesion"] < 0.7) & (s["inner_stops"] < 0.1)),
    ("bare_entries", "list", lambda s: (s["n_lines"] >= 4) & (s["words_per_line"] <= 4) & (s["cell_share"] < 0.4) & (s["common_any"] < 0.2) & (s["letter_ratio"] > 0.5) & (s["repeat_share"] < 0.5)),
    ("no_inner_stops", "list", lambda s: (s["n_lines"] >= 5) & (s["words_per_line"] <= 9) & (s["inner_stops"] < 0.03) & (s["cell_share"] < 0.4) & (s["repeat_share"] < 0.5)),
    ("cells", "table", lambda s: (s["cell_share"] >= 0.6) & (s["n_lines"] >= 2)),
    ("number_cells", "table", lambda s: (s["cell_share"] >= 0.4) & (s["digit_ratio"] >= 0.15) & (s["n_lines"] >= 2)),
    ("digits_in_rows", "table", lambda s: (s["digit_ratio"] >= 0.2) & (s["n_lines"] >= 4) & (s["cell_share"] >= 0.3)),
    ("wrapped", "prose: wrapped", lambda s: (s["n_lines"] >= 3) & (s["wrap_share"] >= 0.85) & (s["words_per_line"] >= 4) & (s["common_any"] >= 0.15) & (s["cell_share"] < 0.4)),
    ("wrapped_sentences", "prose: wrapped", lambda s: (s["n_lines"] >= 3) & (s["wrap_share"] >= 0.7) & (s["inner_stops"] >= 0.1) & (s["common_any"] >= 0.15) & (s["cell_share"] < 0.4)),
    ("long_lines", "prose", lambda s: (s["words_per_line"] >= 10) & (s["common_any"] >= 0.15) & (s["cell_share"] < 0.4) & (s["letter_ratio"] > 0.7)),
    ("sentences", "prose", lambda s: (s["sentence_share"] >= 0.8) & (s["common_any"] >= 0.15) & (s["cell_share"] < 0.4) & (s["bullet_share"] < 0.5) & (s["repeat_share"] < 0.4)),
    ("cohesive", "prose", lambda s: (s["n_pairs"] >= 2) & (s["cohesion"] >= 0.7) & (s["repeat_share"] < 0.4) & (s["cell_share"] < 0.4)),
    ("closed_lines", "prose", lambda s: (s["punct_line_share"] >= 0.5) & (s["words_per_line"] >= 9) & (s["common_any"] >= 0.15) & (s["cell_share"] < 0.4)),
    ("shuffled", "junk: order", lambda s: (s["n_pairs"] >= np.maximum(5, 0.15 * s["n_words"])) & (s["cohesion"] < 0.35) & (s["words_per_line"] >= 10) & (s["cell_share"] < 0.4) & (s["letter_ratio"] > 0.6)),
    ("crowded_pairs", "junk: order", lambda s: (s["n_words"] >= 15) & (s["n_pairs"] > 0.2 * s["n_words"]) & (s["cohesion"] < 0.5) & (s["words_per_line"] >= 10) & (s["cell_share"] < 0.4)),
    ("no_sentences", "junk: order", lambda s: (s["n_pairs"] >= 8) & (s["sentence_share"] < 0.5) & (s["cohesion"] < 0.9) & (s["words_per_line"] >= 10) & (s["letter_ratio"] > 0.6) & (s["common_any"] >= 0.15) & (s["repeat_share"] < 0.4)),
    ("repeats", "junk: repetition", lambda s: s["repeat_share"] >= 0.6),
    ("few_words", "junk: repetition", lambda s: (s["n_words"] >= 12) & (s["unique_share"] <= 0.25)),
    ("one_word", "junk: repetition", lambda s: (s["n_words"] >= 5) & (s["top_word_share"] >= 0.5)),
    ("one_sign", "junk: repetition", lambda s: (s["top_char_share"] >= 0.4) & (s["n_words"] < 6)),
    ("packs", "junk: repetition", lambda s: (s["packed"] < 0.12) & (s["cell_share"] < 0.4)),
    ("no_letters", "junk: signs", lambda s: (s["letter_ratio"] < 0.5) & (s["cell_share"] < 0.3) & (s["bullet_share"] < 0.5)),
    ("odd_words", "junk: signs", lambda s: (s["odd_word_share"] >= 0.2) & (s["n_words"] >= 5)),
    ("no_language", "junk: signs", lambda s: (s["odd_word_share"] >= 0.1) & (s["common_any"] < 0.08) & (s["n_words"] >= 12)),
    ("long_token", "junk: signs", lambda s: s["longest_token"] >= 60),
    ("damage", "junk: signs", lambda s: s["damage_share"] >= 0.05),
)



def votes(table: pd.DataFrame) -> np.ndarray:
    """The patterns of votes of rows of statistics: one 0 or 1 per labelling function."""
    fired = np.stack([np.broadcast_to(np.asarray(rule(table), dtype=bool), len(table)) for _, _, rule in FUNCTIONS], axis=1)
    return np.array(["".join(row) for row in np.where(fired, "1", "0")], dtype=object)


def cohesion(pairs: list[np.ndarray], codes: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Per text: how much more often than by chance the other texts have its pairs, as a mean logarithm.

    ``codes`` is sorted; half a count is added on both sides. A pair of no other text that is
    not in ``codes`` counts as chance has it. No pairs give 0.
    """
    sizes = np.array([len(p) for p in pairs], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(len(pairs))
    of = np.repeat(np.arange(len(pairs)), sizes)
    code = np.concatenate([np.asarray(p, dtype=np.int64) for p in pairs])
    order = np.lexsort((code, of))
    of, code = of[order], code[order]
    begins = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (code[1:] != code[:-1])])
    own = np.diff(np.r_[begins, len(of)])
    of, code = of[begins], code[begins]
    at, known = _found(code, codes)
    have, chance = (np.where(known, x[at], 0.0) if len(codes) else np.zeros(len(code)) for x in (seen, expected))
    tie = np.log((np.maximum(0.0, have - own) + 0.5) / (chance + 0.5))
    total = np.bincount(of, weights=own * tie, minlength=len(pairs))
    return np.divide(total, sizes, out=np.zeros(len(pairs)), where=sizes > 0)


# ---- learning --------------------------------------------------------------------------------

_OWN = np.array([TYPES.index(t) for _, t, _ in FUNCTIONS])
#: What the logarithm of a type's probability loses if none of its functions votes: learned rates can overrule a vote, but not lightly.
UNVOTED = -6.0


def _fired(patterns: list[str]) -> np.ndarray:
    return np.array([[c == "1" for c in k] for k in patterns], dtype=float).reshape(len(patterns), len(FUNCTIONS))


def first_posterior(patterns: list[str]) -> np.ndarray:
    """Over TYPES, from the votes alone."""
    fired = _fired(patterns)
    scores = np.stack([fired[:, _OWN == t].sum(1) / max(1, (_OWN == t).sum()) ** 0.5 for t in range(len(TYPES))], 1)
    posterior = np.exp(4 * scores + np.where(scores > 0, 0.0, UNVOTED))
    return posterior / posterior.sum(1, keepdims=True)


def posterior_of(patterns: list[str], rates: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Over TYPES, from how often each function fires on each type and how frequent the types are."""
    fired = _fired(patterns)
    voted = np.stack([fired[:, _OWN == t].any(1) for t in range(len(TYPES))], 1)
    logs = np.log(share) + fired @ np.log(rates) + (1 - fired) @ np.log(1 - rates) + np.where(voted, 0.0, UNVOTED)
    logs -= logs.max(1, keepdims=True)
    posterior = np.exp(logs)
    return posterior / posterior.sum(1, keepdims=True)


def learn_rates(sums: Callable[[tuple | None], np.ndarray], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """``rates`` and ``share`` for ``posterior_of`` by expectation-maximization.

    ``sums(model)`` gives, under the posterior of a model (None: from the votes alone), the mass
    of each type and of each function firing on it, over all patterns. A weak prior keeps the
    reading of the votes: a function fires more often on its own type.
    """
    own = _OWN[:, None] == np.arange(len(TYPES))
    prior = np.where(own, 3.0, 0.2) / 4
    model = None
    for _ in range(rounds):
        mass, firing = np.split(sums(model), [1])
        weight = 0.002 * mass.sum() / len(TYPES)
        rates = np.clip((firing + weight * prior) / (mass + weight), 1e-4, 1 - 1e-4)
        share = (mass[0] + 1) / (mass.sum() + len(TYPES))
        if model is not None and np.abs(rates - model[0]).max() < 1e-7 and np.abs(share - model[1]).max() < 1e-7:
            break
        model = rates, share
    return rates, share


def _mass(patterns: list[str], counts: np.ndarray, model: tuple | None) -> np.ndarray:
    """One row of the mass of each type, then one per function of that of firing on it."""
    mass = counts[:, None] * (first_posterior(patterns) if model is None else posterior_of(patterns, *model))
    return np.vstack([mass.sum(0), _fired(patterns).T @ mass])


def learn_types(patterns: dict[str, int]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Posterior over TYPES per pattern that has a vote, and per function and type how often it fires."""
    keys = sorted(k for k in patterns if "1" in k)
    if not keys:
        return {}, np.zeros((len(FUNCTIONS), len(TYPES)))
    counts = np.array([patterns[k] for k in keys], dtype=float)
    rates, share = learn_rates(lambda model: _mass(keys, counts, model))
    return dict(zip(keys, posterior_of(keys, rates, share))), rates


def main_type(posterior: np.ndarray) -> tuple[str, float]:
    """The likeliest of prose, list, table and junk, with its probability."""
    total: dict[str, float] = {}
    for name, p in zip(TYPES, posterior):
        kind = name.split(":")[0]
        total[kind] = total.get(kind, 0.0) + float(p)
    kind = max(total, key=total.get)
    return kind, total[kind]


def word_lists(common: DataFrame) -> CommonWords:
    """The common words per language; nulls are left out. The table's size is checked."""
    rows = common.where(F.col("word").isNotNull()).select("lang", F.lower("word").alias("word")).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    langs: dict[str, set[str]] = {}
    for r in rows:
        langs.setdefault(r["lang"] or "", set()).add(r["word"])
    return CommonWords(langs)


def information(pairs: pd.DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every pair (``code, n``): its code in order, how often it occurs, and how often it would by chance within its language."""
    pairs = pairs.sort_values("code", ignore_index=True)
    code, n = pairs["code"].to_numpy(dtype=np.int64), pairs["n"].to_numpy(dtype=float)
    words = max(1, words)
    first, second = code // words, code % words
    lang = first // words
    total = pd.Series(n).groupby(lang).transform("sum").to_numpy()
    a = pd.Series(n).groupby(first).transform("sum").to_numpy()
    b = pd.Series(n).groupby([lang, second]).transform("sum").to_numpy()
    return code, n, a * b / np.maximum(total, 1.0)


def _all_information(counted: DataFrame, words: int) -> DataFrame:
    """``information`` of any number of pairs, where they lie: ``code, n, expected``."""
    words = max(1, words)
    parts = counted.select("code", "n", F.expr(f"code div {words}").alias("first"), F.expr(f"code % {words}").alias("second"), F.expr(f"code div {words} div {words}").alias("lang"))
    a = parts.groupBy("first").agg(F.sum("n").cast("double").alias("a"))
    b = parts.groupBy("lang", "second").agg(F.sum("n").cast("double").alias("b"))
    total = parts.groupBy("lang").agg(F.sum("n").cast("double").alias("total"))
    expected = F.col("a") * F.col("b") / F.greatest("total", F.lit(1.0))
    return parts.join(a, "first").join(b, ["lang", "second"]).join(F.broadcast(total), "lang").select("code", F.col("n").cast("double").alias("n"), expected.alias("expected"))


def _rare(measured: DataFrame, sent: Broadcast, rest: DataFrame) -> DataFrame:
    """``measured`` with the ``rest`` of the pairs that its texts have: arrays of ``code``, ``n`` and ``expected``.

    The frequent pairs, which ``sent`` holds, do not travel; one of the others has few texts.
    """

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = sent.value[0]
        for batch in batches:
            own = [np.unique(np.asarray(p, dtype=np.int64)) for p in batch["pairs"]]
            of, code = np.repeat(batch["_row"].to_numpy(), [len(p) for p in own]), np.concatenate([*own, np.zeros(0, dtype=np.int64)])
            new = ~_found(code, codes)[1]
            yield pd.DataFrame({"_row": of[new], "code": code[new]})

    pairs = measured.where(F.size("pairs") > 0).select("_row", "pairs").mapInPandas(others, "_row long, code long")
    lists = pairs.join(rest, "code").groupBy("_row").agg(F.collect_list(F.struct("code", "n", "expected")).alias("rest"))
    return measured.join(lists, "_row", "left").select(*measured.columns, *[F.col(f"rest.{c}").alias(f"rest_{c}") for c in ("code", "n", "expected")])


def _found(code: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where every one of ``code`` would lie in ``codes``, which are sorted, and whether it is there."""
    at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
    return at, codes[at] == code if len(codes) else np.zeros(len(code), dtype=bool)


def _of_batch(pairs: list, known: tuple[np.ndarray, ...], rest: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Codes, counts and expected counts of all pairs of a batch, from the frequent ones and from those that came with the rows."""
    own = np.unique(np.concatenate([*(np.asarray(p, dtype=np.int64) for p in pairs), np.zeros(0, dtype=np.int64)]))
    at, there = _found(own, known[0])
    code, first = np.unique(rest[0], return_index=True)
    both = [np.concatenate([k[at[there]], r]) for k, r in zip(known, (code, rest[1][first], rest[2][first]))]
    order = np.argsort(both[0])
    return tuple(x[order] for x in both)


def text_statistics(documents: DataFrame, key: str, text: str, common: DataFrame) -> DataFrame:
    """``key``, the STATISTICS and the pattern of ``votes``; one row per document.

    Null, empty and blank texts (white space and characters that show nothing) have null
    statistics and votes. One pass over the text column, no shuffle of texts; what it measures,
    and the pairs of common words as numbers, is written to the checkpoint folder. The counts
    of pairs over all documents give ``cohesion``, and then the votes; beyond MOST_PAIRS pairs
    the statistics travel once, with the counts of their rarer pairs.
    """
    lists = word_lists(common)
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(lists)
    kind = documents.schema[key].dataType.simpleString()
    plain = [n for n in STATISTICS if n != "cohesion"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            out: list[dict[str, float] | None] = []
            pairs: list[list[int] | None] = []
            for value in batch.column("text").to_pylist():
                if value is None or not value.strip() or not _clean(value).strip():
                    s, own = _NOTHING, None
                else:
                    s, own = statistics(value, known)
                out.append(s)
                pairs.append(own)
            columns = [pa.array([s[n] for s in out], pa.float64()) for n in plain]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns, pa.array(pairs, pa.list_(pa.int64()))], ["key", *plain, "pairs"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    measured = cut_lineage(rows.mapInArrow(measure, f"key {kind}, {', '.join(f'{n} double' for n in plain)}, pairs array<long>").withColumn("_row", F.monotonically_increasing_id()))
    counted = measured.select(F.explode("pairs").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    frequent = counted.orderBy(F.desc("n"), "code")
    head = frequent.limit(MOST_PAIRS + 1).toPandas()
    if many := len(head) > MOST_PAIRS:
        pairs = cut_lineage(_all_information(counted, len(lists.number)))
        last = head.iloc[MOST_PAIRS - 1]
        rarer = (F.col("n") < float(last["n"])) | ((F.col("n") == float(last["n"])) & (F.col("code") > int(last["code"])))
        head = pairs.where(~rarer).toPandas().sort_values("code", ignore_index=True)
        known = spark.sparkContext.broadcast(tuple(head[c].to_numpy() for c in ("code", "n", "expected")))
        measured = _rare(measured, known, pairs.where(rarer))
    else:
        known = spark.sparkContext.broadcast(information(head, len(lists.number)))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            there = batch["n_words"].notna().to_numpy()
            pairs = [p if p is not None else () for p in batch["pairs"]]
            counts = known.value
            if many:
                counts = _of_batch(pairs, counts, [np.concatenate([*batch[f"rest_{c}"].dropna(), np.zeros(0, dtype=of)]) for c, of in (("code", np.int64), ("n", float), ("expected", float))])
            batch = batch.assign(cohesion=np.where(there, cohesion(pairs, *counts), np.nan))
            chosen = np.full(len(batch), None, dtype=object)
            chosen[there] = votes(batch[there])
            yield batch.assign(votes=chosen)[["key", *STATISTICS, "votes"]]

    schema = f"key {kind}, {', '.join(f'{n} double' for n in STATISTICS)}, votes string"
    voted = measured.mapInPandas(vote, schema)
    none = [F.when(F.col("votes").isNotNull(), F.col(n)).alias(n) for n in STATISTICS]
    return voted.select(F.col("key").alias(key), *none, "votes")


def _learn(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rates and shares from the counts of patterns, on the driver or, if they are many, where they lie."""
    head = counted.limit(MOST_PATTERNS + 1).toPandas()
    if len(head) <= MOST_PATTERNS:
        head = head.sort_values("votes")
        keys, counts = head["votes"].tolist(), head["count"].to_numpy(dtype=float)
        return learn_rates(lambda model: _mass(keys, counts, model))

    def sums(model: tuple | None) -> np.ndarray:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"sums": [_mass(batch["votes"].tolist(), batch["count"].to_numpy(dtype=float), model).ravel()]})

        parts = counted.mapInPandas(add, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        return parts.sort_values("at")["x"].to_numpy().reshape(1 + len(FUNCTIONS), len(TYPES))

    return learn_rates(sums)


def text_types(measured: DataFrame) -> DataFrame:
    """``measured`` (with ``votes``) and the posterior ``kind`` with its ``certainty``.

    Rows without votes, and rows on which every labelling function abstains, have a null kind.
    """
    measured = cut_lineage(measured)  # counted and labelled from the files, measured once
    some = F.col("votes").contains("1")
    counted = cut_lineage(measured.where(some).groupBy("votes").count())
    if counted.isEmpty():
        return measured.withColumns({"kind": F.lit(None).cast("string"), "certainty": F.lit(None).cast("double")})
    model = _learn(counted)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_type(p) for p in posterior_of(batch["votes"].tolist(), *model)]
            yield pd.DataFrame({"of": batch["votes"], "kind": [k for k, _ in found], "certainty": [c for _, c in found]})

    # patterns, and with them this table, are few beside the documents
    known = counted.select("votes").mapInPandas(decide, "of string, kind string, certainty double")
    return measured.join(known, F.col("votes") == F.col("of"), "left").drop("of")

"""Column functions: weakly typed values, labels, text, hashes. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from landweave import vocab

#: White space as text tools see it, no-break spaces included.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """CASE over a small fixed mapping."""
    found = F.lit(default)
    for name, value in table.items():
        found = F.when(key == name, F.lit(value)).otherwise(found)
    return found


def safe_div(a: Column, b: Column) -> Column:
    """Quotient as double; 0 where the divisor is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def present(text: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    plain = strip(text.cast("string"))
    return F.when(plain != "", plain)


def boolish(value: Column) -> Column:
    """True, false or null of a boolean written somehow: words, or numbers equal to 1 or 0."""
    word = F.lower(strip(value.cast("string")))
    number = word.try_cast("double")
    return (
        F.when(word.isin(*vocab.TRUE_WORDS), F.lit(True))
        .when(word.isin(*vocab.FALSE_WORDS), F.lit(False))
        .when(number == 1, F.lit(True))
        .when(number == 0, F.lit(False))
    )


def boolish_text(value: Column) -> Column:
    """Boolean of a text column: only the listed words count, no other number."""
    word = F.lower(strip(value))
    return F.when(word.isin(*vocab.TRUE_WORDS), F.lit(True)).when(word.isin(*vocab.FALSE_WORDS), F.lit(False))


def surely(condition: Column) -> Column:
    """False where a condition is unknown."""
    return F.coalesce(condition, F.lit(False))


def count_or_zero(value: Column) -> Column:
    """A count in any type, truncated; 0 where it is none."""
    number = value.cast("string").try_cast("double")
    return F.coalesce(F.when(F.isnan(number), None).otherwise(number), F.lit(0.0)).cast("int")


def number_or_null(value: Column) -> Column:
    """Double of any type; null for what is no number, and for NaN."""
    number = value.cast("string").try_cast("double")
    return F.when(~F.isnan(number), number)


def clean_list(values: Column) -> Column:
    """Stripped, non-empty items of an array; a null array is empty."""
    items = F.transform(F.coalesce(values, F.array().cast("array<string>")), strip)
    return F.filter(items, lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan"))


def parse_list(text: Column) -> Column:
    """Items of a list written as text: JSON, with single or double quotes, or one bare string.

    Quotes of the other kind inside an item are kept for JSON only.
    """
    plain = strip(text)
    json = F.from_json(plain, "array<string>")
    single = F.from_json(F.regexp_replace(F.regexp_replace(plain, r"\bNone\b", "null"), "'", '"'), "array<string>")
    bracketed = plain.rlike(r"(?s)^[\[(].*[\])]$")
    return (
        F.when(F.coalesce(plain, F.lit("")).isin("", "None"), F.array().cast("array<string>"))
        .when(bracketed, clean_list(F.coalesce(json, single, F.array(plain))))
        .otherwise(clean_list(F.array(F.regexp_replace(plain, r"^(['\"])(.*)\1$", "$2"))))
    )


# ---- labels ------------------------------------------------------------------------------------


def level2(code: Column) -> Column:
    """First two characters of a land-cover code; null if it is shorter."""
    text = code.cast("string")
    return F.when(F.length(text) >= 2, F.substring(text, 1, 2))


def natural_class(code: Column) -> Column:
    """Not an artificial surface (class 1)."""
    return surely(~code.cast("string").startswith("1"))


def tag_labels(landuse: Column, natural: Column) -> Column:
    """Tags in scope, landuse first, without repeats."""
    kept = F.array(F.when(landuse.isin(*vocab.LANDUSE_TAGS), landuse), F.when(natural.isin(*vocab.NATURAL_TAGS), natural))
    return F.array_distinct(F.array_compact(kept))


def usable_class(text: Column) -> Column:
    """Level-2 class of a label however written, or null."""
    digits = F.regexp_extract(F.lower(text), r"^\s*(?:clc[ _]?)?(\d\d)(?:\.0*)?\s*$", 1)
    return F.when(digits.isin(*vocab.LEVEL2_LABELS), digits)


def label_set_key(labels: Column) -> Column:
    """Canonical text of a set of labels: sorted JSON, written with blanks after commas."""
    quoted = F.transform(F.array_sort(labels), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def symmetric_difference_size(a: Column, b: Column) -> Column:
    return F.size(F.array_union(a, b)) - F.size(F.array_intersect(a, b))


# ---- text --------------------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """Sentences of a text: white space squeezed, cut after . ! ? before a blank; empty for none."""
    plain = squeeze(F.coalesce(text, F.lit("")))
    return F.filter(F.split(plain, r"(?<=[.!?]) +"), lambda s: s != "")


def match_text(text: Column) -> Column:
    """Words of letters and digits, folded, joined by blanks."""
    return F.trim(F.replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")), F.lit("ß"), F.lit("ss")))


def _literal_pattern(text: Column) -> Column:
    """A pattern that matches ``text`` itself."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")


def scrub_title(text: Column, title: Column, *, squeeze_always: bool = True) -> Column:
    """Mentions of a title, exact or with other separators, replaced by ``ce lieu``; any letter case.

    Without ``squeeze_always`` white space is only squeezed where the title has a word.
    """
    name = strip(F.coalesce(title, F.lit("")))
    exact = F.when(name != "", F.regexp_replace(text, F.concat(F.lit("(?iu)"), _literal_pattern(name)), "ce lieu")).otherwise(text)
    tokens = F.filter(F.split(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    loose = F.array_join(F.transform(tokens, _literal_pattern), r"[^\p{L}\p{N}]+")
    named = F.size(tokens) > 0
    varied = F.when(named, F.regexp_replace(exact, F.concat(F.lit("(?iu)"), loose), "ce lieu")).otherwise(exact)
    return squeeze(varied) if squeeze_always else F.when(named, squeeze(varied)).otherwise(varied)


def number_text(value: Column, default: str = "inconnue") -> Column:
    """Three decimals without trailing zeros."""
    number = number_or_null(value)
    return F.when(number.isNull(), default).otherwise(F.regexp_replace(F.format_string("%.3f", number), r"\.?0+$", ""))


def yes_no(value: Column) -> Column:
    flag = boolish_text(value.cast("string"))
    return F.when(flag, "oui").when(~flag, "non").otherwise("inconnue")


def named(value: Column, names: Mapping[str, str], default: str = "inconnue") -> Column:
    """Display name of an enumerated value; unknown values with blanks for underscores."""
    key = F.lower(present(value))
    return F.coalesce(lookup(key, names), F.replace(key, F.lit("_"), F.lit(" ")), F.lit(default))


def joined(values: Column, none: str = "aucun") -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(none)


#: Accented letters of French and neighbours, and what is left of them.
_ACCENTED, _PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def category_text(text: Column) -> Column:
    """A category without its prefix, underscores, accents and case."""
    bare = F.regexp_replace(F.lower(strip(text)), r"^cat[ée]gorie:", "")
    plain = squeeze(F.replace(bare, F.lit("_"), F.lit(" ")))
    return F.regexp_replace(F.translate(plain, _ACCENTED, _PLAIN), r"[̀-ͯ]", "")


def category_words(text: Column) -> Column:
    """Only letters and digits of a category, between blanks."""
    return F.trim(F.regexp_replace(category_text(text), r"[^a-z0-9]+", " "))


def word_pattern(word: str) -> str:
    """Pattern of a rule's words in ``category_words``; short words may have a plural s."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    tokens = "".join(c if c.isascii() and c.isalnum() else " " for c in plain).split()
    return r"(^|[^a-z0-9])" + r"\s+".join(t + ("s?" if len(t) <= 4 and t.isalpha() else "") for t in tokens) + r"($|[^a-z0-9])"


def _names(pattern: str, category: Column) -> Column:
    return category.rlike(pattern)


def article_types(categories: Column) -> Column:
    """Types that any of the categories names, in order of preference; ``other_or_unclear`` if none."""
    words = F.transform(F.coalesce(categories, F.array().cast("array<string>")), category_words)
    hits = []
    for kind, rules in vocab.ARTICLE_TYPE_WORDS.items():
        pattern = "|".join(dict.fromkeys(word_pattern(r) for r in rules))
        hits.append(F.when(F.exists(words, partial(_names, pattern)), F.lit(kind)))
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other_or_unclear")))


# ---- model responses ---------------------------------------------------------------------------

_PARTS = r"[,;/|\n\s]+"


# What a result says of a response that it cannot be read from.
NOT_STRINGS, UNKNOWN, NOTHING = "JSON list fields must contain only strings", "Unknown labels in JSON: ", "No valid allowed labels found"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def parse_response(raw: Column, allowed: Iterable[str]) -> Column:
    """STRUCT of ``labels`` (allowed ones, in the given order) and ``error`` of a raw response.

    A JSON object gives its ``labels`` list or the parts of its ``label``; other JSON gives
    nothing; only text that is no JSON is scanned for allowed labels as words. The text is
    parsed once.
    """
    allowed = list(allowed)
    none, order = F.array().cast("array<string>"), F.array(*[F.lit(a) for a in allowed])

    def read(v: Column) -> Column:
        """``json``, ``names``, ``mixed`` of the parsed response."""
        items = F.try_variant_get(v, "$.labels", "array<variant>")
        texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
        single = F.try_variant_get(v, "$.label", "variant")
        parts = F.filter(F.split(F.try_variant_get(single, "$", "string"), _PARTS), lambda p: p != "")
        alone = F.when(surely(F.schema_of_variant(single) == "STRING"), parts)
        return F.struct(
            v.isNotNull().alias("json"), F.coalesce(F.array_compact(texts), alone, none).alias("names"),
            surely(F.exists(texts, lambda t: t.isNull())).alias("mixed"),
        )

    def judge(r: Column) -> Column:
        labels = F.when(r["json"], F.filter(order, lambda a: F.array_contains(r["names"], a))).otherwise(_named_words(raw, allowed))
        unknown = F.array_sort(F.array_distinct(F.filter(F.array_except(r["names"], order), lambda u: u != "")))
        error = F.when(r["mixed"], NOT_STRINGS).when(F.size(unknown) > 0, F.concat(F.lit(UNKNOWN), F.array_join(unknown, ", ")))
        return F.struct(labels.alias("labels"), error.alias("error"))

    def settle(j: Column) -> Column:
        return F.struct(j["labels"].alias("labels"), F.coalesce(j["error"], F.when(F.size(j["labels"]) == 0, NOTHING)).alias("error"))

    parsed = F.when(F.trim(raw) != "", F.try_parse_json(raw))
    return bound(parsed, lambda v: bound(read(v), lambda r: bound(judge(r), settle)))


def _named_words(raw: Column, allowed: list[str]) -> Column:
    """The allowed labels that the text has as words, in any letter case."""
    none = F.array().cast("array<string>")
    border = r"[\p{L}\p{N}_]"
    if all(c.isalnum() or c == "_" for a in allowed for c in a) and len({a.lower() for a in allowed}) == len(allowed):
        # labels that are words cannot overlap: one search finds all
        found = F.regexp_extract_all(raw, F.lit(rf"(?iu)(?<!{border})({'|'.join(allowed)})(?!{border})"), F.lit(1))
        return F.coalesce(bound(F.transform(found, F.lower), lambda f: F.filter(F.array(*[F.lit(a) for a in allowed]), lambda a: F.array_contains(f, F.lower(a)))), none)
    hits = [F.when(raw.rlike(rf"(?iu)(?<!{border}){_quote(a)}(?!{border})"), F.lit(a)) for a in allowed]
    return F.array_compact(F.array(*hits))


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def single_label_result(parsed: Column) -> Column:
    """STRUCT of prediction, status and error for a task with one label."""
    labels, error = parsed["labels"], parsed["error"]
    many = F.size(labels) > 1
    status = F.when(error.isNotNull(), "error").when(many, "ambiguous").otherwise("ok")
    message = F.coalesce(error, F.when(many, "multiple labels for single-label task"))
    return F.struct(F.when(status == "ok", labels[0]).alias("prediction"), status.alias("parse_status"), message.alias("error"))


def multi_label_result(parsed: Column, *, tolerate_unknown: bool = True) -> Column:
    """STRUCT of prediction, status and error for a task with several labels; unknown ones may be tolerated."""
    labels, error = parsed["labels"], parsed["error"]
    fatal = error.isNotNull() & ~(F.lit(tolerate_unknown) & surely(error.startswith(UNKNOWN.strip())))
    status = F.when(fatal, "error").otherwise("ok")
    return F.struct(F.when(~fatal, labels).alias("prediction"), status.alias("parse_status"), F.when(fatal, error).alias("error"))


def invalid_result(prediction: Column, status: Column, allowed: Iterable[str], *, single: bool) -> Column:
    """What is wrong with a result (``prediction`` is an array of labels), or null."""
    labels = F.array_distinct(F.coalesce(prediction, F.array().cast("array<string>")))
    unknown = F.array_sort(F.array_except(labels, F.array(*[F.lit(a) for a in allowed])))
    checks = F.when(~surely(status.isin("ok", "error", "ambiguous")), "invalid parse_status")
    checks = checks.when(F.size(unknown) > 0, F.concat(F.lit("unknown prediction labels: "), F.array_join(unknown, ", ")))
    checks = checks.when((status == "ok") & (F.size(labels) == 0), "ok parse_status without a prediction")
    return checks.when((status == "ok") & (F.size(labels) != 1), "invalid single-label prediction") if single else checks


# ---- hashes ------------------------------------------------------------------------------------


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stable_seed(*parts: Column) -> Column:
    """Unsigned 64-bit number of the first half of a SHA-256 digest, as DECIMAL(20, 0)."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def source_pixels(window_m: Column, pixel_m: int = 10) -> Column:
    """Pixels of a source image that a window of so many metres touches at least."""
    return F.ceil(window_m / pixel_m)


def payload_categories(payload: Column) -> Column:
    """``categories`` of a JSON payload: texts, and titles of objects; other items are left out, without a list there are none."""
    items = F.try_variant_get(F.try_parse_json(payload), "$.categories", "array<variant>")
    title = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.when(F.schema_of_variant(F.try_variant_get(x, "$.title", "variant")) == "STRING", F.try_variant_get(x, "$.title", "string")))
    return F.coalesce(F.array_compact(F.transform(items, title)), F.array().cast("array<string>"))

"""Skeletons, pieces, tokens, leaks and text types."""

import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landweave.llm import leaks, pieces, prose, skeleton, tokens

# ---- problem 4 ----


@pytest.mark.parametrize(
    "a, b",
    [("Forêt", "Foret̂".replace("ret̂", "rêt")), ("Pont de Tevo", "Ｐｏｎｔ　ｄｅ　Ｔｅｖｏ"), ("Étang", "Е́tang"), ("a b", " a   b "), ("Col III", "Col Ⅲ"), ("fin", "ﬁn"), ("l'eau", "l’eau"), ("a-b", "a‑b"), ("Po​nt", "Pont"), ("so­l", "sol"), ("Tevo", "Τеvо"), ("œ", "oe")],
)
def test_no_visible_difference(a, b):
    assert skeleton.skeleton(a) == skeleton.skeleton(b)


@pytest.mark.parametrize("a, b", [("Foret", "Forêt"), ("pont", "Pont"), ("I", "l"), ("0", "O"), ("rn", "m"), ("km²", "km2"), ("ab", "a b"), ("a,b", "a.b"), ("ſ", "s"), ("½", "1/2")])
def test_visible_difference(a, b):
    assert skeleton.skeleton(a) != skeleton.skeleton(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_skeleton_is_stable(text):
    once = skeleton.skeleton(text)
    assert skeleton.skeleton(once) == once and skeleton.skeleton(unicodedata.normalize("NFC", text)) == once


def test_same_looking(spark):
    rows = [("t", 1, "Pont"), ("t", 2, "Ｐｏｎｔ"), ("t", 3, "Pont"), ("t", 4, "Pont "), ("s", 5, "Pont "), ("t", 6, None), ("t", None, "Pоnt"), ("t", 7, ""), ("t", 8, " "), ("t", 1, "Pont"), ("t", 9, "x" * 100_000)]
    df = spark.createDataFrame(rows, "field string, key long, text string").withColumn("look", F.lit(1))
    found = same = {(r.field, r.key_a, r.key_b) for r in skeleton.same_looking(df).collect()}
    assert found == {("t", 1, 2), ("t", 2, 3), ("t", 1, 4), ("t", 2, 4), ("t", 3, 4), ("t", 7, 8)}
    assert skeleton.same_looking(df.limit(0)).count() == 0 and same


def test_look_alikes_of_every_script(spark):
    table = skeleton._Table(skeleton.look_alikes(spark))
    same = lambda a, b: skeleton.skeleton(a, table) == skeleton.skeleton(b, table)
    alike = ["ГΓ", "ПΠ", "ФΦ", "ΛЛ", "ΟО", "ՕO", "ՍU", "ᏟC", "ᎪA", "ꓐB", "ѕs", "ԛq", "٠۰", "١1", "৪8", "־-", "֊-", "՚'"]
    assert [p for p in alike if not same(p[0], p[-1])] == []
    apart = ["I1", "Il", "l1", "l|", "O0", "Օ0", "०o", "ЬЪ", "ыь", "Γг", "єе", "0o", "Ꭺa", "σς", "٠٥", "бв", "ПЛ"]
    assert [p for p in apart if same(p[0], p[-1])] == []
    assert same("ЁЙ", "Е\u0308И\u0306") and not same("Ё", "E") and same("Ё", "Ë")
    latin = [c for c in map(chr, range(0x20, 0x250)) if c.isalnum() and not unicodedata.decomposition(c).startswith("<")]
    forms = [skeleton.skeleton(c, table) for c in latin if c not in "ÆæŒœŉ"]
    assert len(set(forms)) == len(forms)  # no Latin letter or digit is taken for another
    for c in table.alike:
        once = skeleton.skeleton(c, table)
        assert skeleton.skeleton(once, table) == once


def test_skeletons_of_a_batch(spark):
    texts = ["a\u0301", "\u0301b", "", " x  y ", "\U0010ffff", "ＡΟ", "\u0315\u0300"]
    table = skeleton._Table(skeleton.look_alikes(spark))
    for part in (texts, [t for t in texts if t != "\U0010ffff"], []):
        assert skeleton.skeletons(part, table) == [skeleton.skeleton(t, table) for t in part]


def test_look_classes(spark):
    rows = [("t", 1, "Pont"), ("t", 2, "Ｐｏｎｔ"), ("t", 3, "Pont"), ("t", 4, "Pont "), ("s", 5, "Pont "), ("t", 6, None), ("t", None, "Pоnt"), ("t", 7, ""), ("t", 8, " "), ("t", 9, "x" * 100_000)]
    df = spark.createDataFrame(rows, "field string, key long, text string").withColumn("n", F.lit("clash"))
    found = {(r.field, r.key): (r.group_id, r.n_links) for r in skeleton.look_classes(df).collect()}
    assert {k: n for k, (_, n) in found.items()} == {("t", 1): 2, ("t", 2): 3, ("t", 3): 2, ("t", 4): 3, ("s", 5): 0, ("t", 7): 1, ("t", 8): 1, ("t", 9): 0}
    assert found["t", 1][0] == found["t", 2][0] == found["s", 5][0] != found["t", 7][0] and skeleton.look_classes(df.limit(0)).count() == 0


# ---- problem 5 ----

BREAKS = "[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]"
alphabet = st.sampled_from(["a", "b", "ab", "é", " ", ".", "!", "\n", "\r\n", "  ", " ", "…", "abc", "😀"])


def coarsest(text, limit):
    parts = re.split(BREAKS, text)
    if max(map(len, parts)) <= limit:
        return "paragraph"
    if max(len(s) for p in parts for s in re.split(r"(?<=[.!?…])\s+", p)) <= limit:
        return "sentence"
    return "word" if max(map(len, re.split(r"\s+", text))) <= limit else "none"


def tables_of(text, size, sparse=0):
    parts = [text[i : i + size] for i in range(0, max(1, len(text)), size)]
    return pd.DataFrame([pieces.range_boundaries(p, sparse) for p in parts])


def test_stitched_segments(spark):
    rng = random.Random(7)
    signs = ["a", "b", "ab", "é", " ", ".", "!", "\n", "\r\n", "  ", " ", "…", "abc", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(900)] + [". " * 20, " " * 30, ".\n" * 9, ""]
    found = pd.concat([tables_of(t, rng.randint(1, 12)).assign(key=str(i)).reset_index(names="range") for i, t in enumerate(texts)])
    for c in ("paragraph", "sentence", "sentence_led", "word"):
        found[c] = found[c].map(list)
    tables = spark.createDataFrame(found.drop(columns=["paragraph_ends", "sentence_ends", "word_ends"])).repartition(8).cache()
    for limit in (1, 2, 3, 5, 8, 13):
        got = {r.key: r.boundary for r in pieces.coarsest_boundary(tables, limit).collect()}
        assert got == {str(i): coarsest(t, limit) for i, t in enumerate(texts)}


ENDS = {"paragraph": f"\r\n|{BREAKS}", "sentence": r"(?<=[.!?…])[^\S\n\r\v\f\x1c-\x1e\x85\u2028\u2029]+", "word": r"\s+"}


@settings(max_examples=600, deadline=None)
@given(st.lists(alphabet, max_size=60).map("".join), st.integers(1, 12))
def test_stitched_ends(text, size):
    first, ends = pieces.stitched_ends(tables_of(text, size))
    assert first[-1] == len(text)
    exact = {k: {m.end() for m in re.finditer(v, text)} for k, v in ENDS.items()}
    assert set(ends["paragraph"]) == exact["paragraph"] and set(ends["sentence"]) == exact["sentence"]
    assert set(ends["word"]) | exact["paragraph"] | exact["sentence"] >= exact["word"] and set(ends["word"]) <= exact["word"]


@settings(max_examples=300, deadline=None)
@given(st.lists(alphabet, max_size=80).map("".join), st.integers(6, 20), st.integers(0, 2))
def test_cuts_cover_the_text(text, limit, overlap):
    table = pieces.range_boundaries(text)
    ends = {k: np.array(table[f"{k}_ends"], dtype=np.int64) for k in pieces.KINDS[:3]}
    cuts = pieces.choose_cuts(len(text), ends, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(b - a <= limit for a, b, _ in cuts)
    assert all(q[0] == p[1] - overlap and q[1] > p[1] for p, q in zip(cuts, cuts[1:]))


def pieces_of(df, limit, overlap, size):
    names = ("pageid", "content", "fetched_at", limit)
    wanted = pieces.oversized(df, *names)
    tables = pieces.current_tables(pieces.boundary_tables(pieces.text_ranges(df, *names, size=size)), wanted)
    emitted = pieces.emit_pieces(pieces.piece_offsets(tables, limit, overlap), pieces.text_ranges(df, *names, size=size, ahead=limit))
    return wanted, tables, emitted


def test_pieces_of_texts(spark):
    random.seed(1)
    long = " ".join("".join(random.choice("abcdé😀.") for _ in range(random.randint(1, 9))) + random.choice(["", ".", "\n"]) for _ in range(900))
    rows = [("1", long, 2), ("1", "short", 1), ("2", "x" * 500, 1), ("3", None, 3), ("3", long, 1), ("4", "", 1), ("5", "y" * 100, None), ("6", "z" * 101, 1), ("6", "z" * 101, 1), (None, long, 1), ("7", "w" * 300, None), ("7", "w" * 300, None)]
    df = spark.createDataFrame(rows, "pageid string, content string, fetched_at long").withColumn("range", F.lit(0)).repartition(5)
    texts = {"1": long, "2": "x" * 500, "6": "z" * 101, "7": "w" * 300}
    for size in (64, 7):
        wanted, tables, emitted = pieces_of(df, 100, 10, size)
        assert {r.key for r in wanted.collect()} == set(texts)
        assert {r.key: r.boundary for r in pieces.coarsest_boundary(tables, 100).collect()} == {k: coarsest(t, 100) for k, t in texts.items()}
        found = emitted.collect()
        ends = {k: {n: np.array([m.end() for m in re.finditer(v, t)], dtype=np.int64) for n, v in ENDS.items()} for k, t in texts.items()}
        for key, text in texts.items():
            own = sorted((r.piece, r.start, r.end, r.boundary, r.text) for r in found if r.key == key)
            assert [p[1:4] for p in own] == pieces.choose_cuts(len(text), ends[key], 100, 10)
            assert all(text[a:b] == t for _, a, b, _, t in own)
    wanted, tables, emitted = pieces_of(df.limit(0), 100, 10, 64)
    assert emitted.count() == 0 and pieces.coarsest_boundary(tables, 100).count() == 0
    with pytest.raises(ValueError):
        pieces.piece_offsets(tables, 100, 50)


def test_a_long_text_goes_by_slabs(spark):
    text = "".join(random.Random(2).choice("ab é\n") for _ in range(3000))
    df = spark.createDataFrame([("1", text, 1)], "pageid string, content string, fetched_at long")
    ranges = sorted((r.range, r.text) for r in pieces.text_ranges(df, "pageid", "content", "fetched_at", 10, size=7, ahead=3).collect())
    assert len(ranges) > pieces.SLAB and ranges == [(i, text[7 * i : 7 * i + 10]) for i in range(-(-3000 // 7))]


@settings(max_examples=400, deadline=None)
@given(st.lists(alphabet, max_size=120).map("".join), st.integers(3, 20), st.integers(8, 24), st.integers(0, 2))
def test_cuts_do_not_depend_on_ranges(text, size, limit, overlap):
    _, found = pieces.stitched_ends(tables_of(text, size, pieces.sparse_stretch(limit, overlap)))
    expected = {k: np.array([m.end() for m in re.finditer(v, text)], dtype=np.int64) for k, v in ENDS.items()}
    assert pieces.choose_cuts(len(text), found, limit, overlap) == pieces.choose_cuts(len(text), expected, limit, overlap)


@settings(max_examples=60, deadline=None)
@given(st.integers(50, 50_000), st.integers(0, 10), st.integers(1000, 30_000), st.randoms(use_true_random=False))
def test_no_word_is_torn_beside_a_blank(limit, part, size, rng):
    overlap = limit * part // 40
    text = ""
    while len(text) < 3 * limit + 100:
        text += "x" * rng.choice([3, 9, limit // 3, limit * 2]) + rng.choice([" ", " ", ". ", "\n"])
        text += "word " * rng.choice([1, limit // 7])
    _, ends = pieces.stitched_ends(tables_of(text, size, pieces.sparse_stretch(limit, overlap)))
    for a, b, kind in pieces.choose_cuts(len(text), ends, limit, overlap):
        assert kind != "none" or not any(c.isspace() for c in text[a + overlap : b - 1])


def test_files_by_byte_ranges(spark, tmp_path):
    random.seed(3)
    text = "".join(random.choice("ab é😀.\n") for _ in range(2000))
    damaged = "é".encode() * 40 + b"\xf0\x9f\x98\x80\x80\x80\x80\xff" * 30 + "ß 😀".encode() * 20
    for name, data in (("a", text.encode()), ("b", b""), ("c", damaged)):
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(n, str(tmp_path / n)) for n in "abc"] + [("d", None)], "key string, path string")
    expected = {"a": text, "b": "", "c": damaged.decode("utf-8", "replace")}
    parts = pieces.file_ranges(paths, 37).orderBy("key", "range").collect()
    assert {k: "".join(r.text for r in parts if r.key == k) for k in "abc"} == expected
    tables = pieces.boundary_tables(pieces.file_ranges(paths, 37))
    emitted = pieces.emit_pieces(pieces.piece_offsets(tables, 60, 9), pieces.file_ranges(paths, 37, ahead=60)).collect()
    for key, whole in expected.items():
        own = sorted((r.piece, r.start, r.end, r.text) for r in emitted if r.key == key)
        assert own[-1][2] == len(whole) and all(whole[a:b] == t and len(t) <= 60 for _, a, b, t in own)
    again = pieces.write_files(spark.createDataFrame([("a/..", text), ("é", "")], "key string, text string"), f"file://{tmp_path}/out")
    read = {r.key: r.text for r in pieces.file_ranges(again.cache(), 1 << 20).collect()}
    assert read == {"a/..": text, "é": ""}


# ---- problem 6 ----

needs_files = pytest.mark.skipif(not __import__("os").path.exists(f"{tokens.FOLDER}/byte_bpe_50k.json"), reason="no tokenizer files")


@pytest.fixture(scope="module")
def machine():
    from tokenizers import Tokenizer

    merges, memo = tokens.loaded(tokens.vocabulary())
    known = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    known.encode_special_tokens = True
    return merges, memo, lambda t: known.encode(t, add_special_tokens=False).ids


@needs_files
def test_ids_in_any_steps(machine):
    merges, memo, known = machine
    random.seed(4)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'ll", "'", "1", "٣", "-", "漢", "　", "\x1c", "\x85", "the", " the", "​", "😀", "<|endoftext|>", "l"]
    for _ in range(1500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 30)))
        ids = tokens.TextStream(merges, memo).encode(text, random.randint(1, 9))
        assert ids == known(text) and tokens.IdStream(merges).feed(ids, True) == text


@needs_files
def test_long_words_in_bounded_memory(machine, monkeypatch):
    merges, memo, known = machine
    random.seed(6)
    monkeypatch.setattr(tokens.TextStream, "LONG", 24)
    for _ in range(250):
        kind = random.choice(["ab", "aA", "-=", "  \t", "12", "éa", "x", ".", "\n ", " -"])
        text = random.choice(["", "a ", "1", "-", " "]) + "".join(random.choice(kind) for _ in range(random.randint(100, 700))) + random.choice(["", " b", "c", "1", " "])
        assert tokens.TextStream(merges, {}).encode(text, random.randint(1, 300)) == known(text)
    stream = tokens.WordStream(merges)
    most, out = 0, []
    for _ in range(300):
        out += stream.feed(bytes(random.choice(b"abcdefgh") for _ in range(100)))
        most = max(most, len(stream.held))
    assert most <= merges.lookahead + stream.every + merges.longest and len(out) > 5000


def adversarial(rng, letters, count):
    """A vocabulary of random merges over few letters, in which changes at the end reach far left."""
    import json

    names = {b: c for c, b in tokens._byte_names().items()}
    vocab = {names[b]: b for b in range(256)}
    alphabet = [names[ord(c)] for c in letters]
    known, merges = list(alphabet), []
    while len(merges) < count:
        a, b = rng.choice(known), rng.choice(known)
        if [a, b] not in merges and len(a + b) < 12 and a + b not in vocab:
            merges.append([a, b])
            vocab[a + b] = len(vocab)
            known.append(a + b)
    return tokens.Merges(json.dumps({"model": {"vocab": vocab, "merges": merges}}).encode())


def by_merging(merges, data):
    ids = [merges.id_of[bytes([b])] for b in data]
    while True:
        best = min(((merges.pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges.pairs), default=None)
        if best is None:
            return ids
        whole = next(t for t, parts in merges.parts.items() if parts == (ids[best[1]], ids[best[1] + 1]))
        ids[best[1] : best[1] + 2] = [whole]


@pytest.mark.parametrize("agree", [True, False])
def test_the_lookahead_decides_what_is_held(agree):
    rng = random.Random(9)
    for round_ in range(40):
        merges = adversarial(rng, "ab" if round_ % 2 else "abc", rng.randint(1, 14))
        for _ in range(6):
            data = bytes(rng.choice(b"ab" if round_ % 2 else b"abc") for _ in range(rng.randint(1, 160)))
            if rng.random() < 0.5:
                data = data[: rng.randint(1, 5)] * 40
            stream, out, at = tokens.WordStream(merges, agree), [], 0
            while at < len(data):
                step = rng.randint(1, 9)
                out += stream.feed(data[at : at + step])
                at += step
                assert len(stream.held) <= merges.lookahead + stream.every + merges.longest
            assert out + stream.finish() == by_merging(merges, data)


@needs_files
def test_the_lookahead_of_the_vocabulary(machine):
    merges, _, known = machine
    rng = random.Random(3)
    for kind in ("ab", "abcdefgh", "thequickbrown", "e", "-=", "xo", "éa"):
        text = "".join(rng.choice(kind) for _ in range(3000))
        stream = tokens.WordStream(merges, agree=False)
        assert stream.feed(text.encode()) + stream.finish() == known(text)


@needs_files
def test_token_ids(spark, machine):
    rows = [(1, "Le pont."), (2, ""), (3, None), (4, " \n"), (5, "a" * 200_000), (5, "a" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit("clash"))
    data = tokens.vocabulary()
    encoded = tokens.token_ids(df, "doc_id", "text", data)
    got = [(r.doc_id, r.ids) for r in encoded.collect()]
    assert sorted(got) == sorted((k, machine[2](t) if t else []) for k, t in rows)
    assert dict(encoded.dtypes)["ids"] == "array<int>"
    assert sorted((r.doc_id, r.text) for r in tokens.token_texts(encoded, "doc_id", data).collect()) == sorted((k, t or "") for k, t in rows)
    assert tokens.token_ids(df.limit(0), "doc_id", "text", data).count() == 0


# ---- problem 7 ----


def brute_leaks(documents, items, n):
    found = set()
    for item, text in items:
        own = leaks.words(text or "")
        size = min(n, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for key, doc in documents:
            w = leaks.words(doc or "")
            if any(tuple(w[i : i + size]) in grams for i in range(len(w) - size + 1)):
                found.add((key, item))
    return found


def test_leaks_against_brute_force(spark, monkeypatch):
    random.seed(8)
    vocabulary = ["Le", "pont", "d'eau", "ÉTÉ", "grand-père", "so­l", "1901", "x²", "Straße"]
    make = lambda n: " ".join(random.choice(vocabulary) + random.choice(["", ",", "\n", "!"]) for _ in range(n))
    items = [(f"i{k}", make(random.randint(1, 9))) for k in range(30)] + [("none", None), ("empty", ""), ("same", "le pont"), ("i0", "le pont le pont")]
    documents = [(k, make(random.randint(0, 40)).upper() if k % 2 else make(random.randint(0, 40))) for k in range(200)] + [(900, None), (901, ""), (902, "a" * 50_000)]
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    tests = spark.createDataFrame(items, "item_id string, item_text string")
    for block in (leaks.BLOCK_CHARS, 100):
        monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
        spans = leaks.leaked_spans(docs, "doc_id", "text", tests, n=4)
        found = {(r.doc_id, r.item_id) for r in leaks.leaked_items(spans, "doc_id").collect()}
        assert found == brute_leaks(documents, items, 4)
    assert leaks.leaked_spans(docs.limit(0), "doc_id", "text", tests).count() == 0
    assert leaks.leaked_spans(docs, "doc_id", "text", tests.limit(0)).count() == 0


def test_removal(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    text = "Before this. " + item.title().replace(" ", ", ") + "! And after that, quite a lot of other words that stay as they are in the text."
    docs = spark.createDataFrame([(1, text), (2, item), (3, "nothing"), (4, None), (5, ""), (None, text)], "doc_id long, text string").withColumn("marks", F.lit("clash"))
    items = spark.createDataFrame([("a", item), ("b", item), ("short", "that")], "item_id string, item_text string")
    for block in (leaks.BLOCK_CHARS, 70):
        monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
        rows = {r.doc_id: r for r in leaks.clean_documents(docs, "doc_id", "text", items).collect()}
        assert {k: r.action for k, r in rows.items()} == {1: "cut", 2: "drop", 3: "keep", 4: "keep", 5: "keep", None: "cut"}
        assert rows[2].text is None and rows[1].leaked_words == 13 and rows[4].text is None and rows[5].text == "" and rows[3].n_words == 1
        assert rows[1].text == rows[None].text == "Before this. ! And after that, quite a lot of other words that stay as they are in the text."
        assert leaks.clean_documents(docs.limit(0), "doc_id", "text", items).count() == 0
    assert {r.item_id: (r.n_words, r.cuts) for r in leaks.item_sizes(items).collect()} == {"a": (13, True), "b": (13, True), "short": (1, False)}


def test_an_item_that_repeats_itself(spark):
    index = leaks.PassageIndex([("a", "la " * 50_000), ("b", "la " * 20 + "fin")])
    assert sum(len(t[0]) for t in index.tables.values()) == 3
    found = index.scan(["la " * 300, "", "fin " * 5])
    assert {i for _, _, i in found[0]} == {"a", "b"} and len(found[0]) == 2 * 289 and found[1] == found[2] == []


# ---- problem 8 ----

SENTENCES = ["The land rises from 563 m at the pond to 330 m near Beville.", "After the floods, water from the mill floods part of the meadow.", "In spring, water from the brook floods part of the old orchard.", "The parish of Guou covers 6451 hectares, of which 62 percent is scrub.", "The beaver can be seen there in late summer, mostly to the west of the dam."]
COMMON = "a after and at be been before by can for from has in is it no of on since so that the then there to was which with".split()
NOUNS = "pond mill meadow brook orchard scrub beaver dam forest bridge heath slope".split()


def corpus():
    random.seed(11)
    rows = []
    for i in range(400):
        text = " ".join(random.sample(SENTENCES, random.randint(2, 5)))
        text = re.sub(r"pond|mill|meadow|brook|orchard|scrub|beaver|dam", lambda m: random.choice(NOUNS), text)
        if i % 10 == 0:
            text = text.upper()
        if i % 10 == 1:
            import textwrap

            text = textwrap.fill(text, 50)
        rows.append((f"prose{i}", "prose", text))
    for i in range(25):
        rows.append((f"list{i}", "list", "\n".join(f"• {random.choice(NOUNS)} {random.choice(COMMON)} {random.choice(NOUNS)};" for _ in range(random.randint(5, 20)))))
        rows.append((f"bare{i}", "list", "Places :\n" + "\n".join(f"{random.choice(NOUNS)} {random.choice(NOUNS).title()}ville" for _ in range(random.randint(6, 20)))))
        sep = random.choice(["\t", " | ", ";"])
        rows.append((f"table{i}", "table", "\n".join(sep.join([random.choice(NOUNS), str(random.randint(10, 9999)), str(random.randint(10, 9999))]) for _ in range(random.randint(4, 20)))))
        rows.append((f"word{i}", "junk", " ".join([random.choice(NOUNS)] * random.randint(20, 60))))
        rows.append((f"order{i}", "junk", " ".join(random.choice(COMMON + NOUNS) for _ in range(random.randint(40, 120)))))
        rows.append((f"signs{i}", "junk", "".join(random.choice("{}[]<>|/%&=+*#~^@") for _ in range(200))))
    return rows


def test_text_types(spark):
    rows = corpus()
    extra = [("null", None, None), ("empty", None, ""), ("blank", None, " \n ​"), ("long", "prose", " ".join(random.choice(SENTENCES) + f" {i}." for i in range(3000)))]
    df = spark.createDataFrame([(k, t) for k, _, t in [*rows, *extra]], "doc_id string, text string").withColumn("votes", F.lit("clash"))
    common = spark.createDataFrame([("en", w) for w in COMMON] + [(None, None), ("fr", None), ("fr", "le")], "lang string, word string")
    measured = prose.text_statistics(df, "doc_id", "text", common)
    found = {r.doc_id: r.kind for r in prose.text_types(measured).collect()}
    assert len(found) == len(rows) + len(extra) and found["null"] is found["empty"] is found["blank"] is None
    wrong = [k for k, kind, _ in rows if found[k] != kind]
    assert len(wrong) <= 0.02 * len(rows), wrong
    assert prose.text_types(prose.text_statistics(df.limit(0), "doc_id", "text", common)).count() == 0
    assert prose.text_types(prose.text_statistics(df, "doc_id", "text", common.limit(0))).count() == len(found)


FOREIGN = {
    "italian": "Il paese si trova ai piedi della collina, dove il torrente raccoglie le acque dei campi. Nel secolo scorso quasi tutte le famiglie lavoravano nei vigneti, mentre oggi molte case sono abitate solo durante le vacanze. Il bosco che copre il versante appartiene al comune ed è aperto a tutti.",
    "polish": "Wieś leży nad rzeką, która każdej wiosny zalewa łąki po obu stronach drogi. Dawniej mieszkańcy zajmowali się głównie rybołówstwem, a dziś większość z nich pracuje w pobliskim mieście. Na wzgórzu zachował się drewniany kościół, zbudowany prawie trzysta lat temu przez miejscowych rzemieślników.",
    "turkish": "Köy, ormanın kenarında küçük bir vadide kurulmuştur ve çevresinde geniş tarlalar bulunur. Eskiden halkın çoğu hayvancılıkla geçinirdi, bugün ise gençler şehirde çalışıyor. Yazın birçok aile serin havası için buraya gelir ve eski evlerde kalır.",
    "russian": "Деревня расположена на берегу реки, которая весной заливает луга. Раньше жители занимались рыбной ловлей, а теперь большинство работает в городе. На холме сохранилась деревянная церковь, построенная почти триста лет назад местными мастерами.",
    "greek": "Το χωριό βρίσκεται στους πρόποδες του λόφου, εκεί όπου ο χείμαρρος συγκεντρώνει τα νερά των χωραφιών. Παλαιότερα σχεδόν όλες οι οικογένειες δούλευαν στα αμπέλια, ενώ σήμερα πολλά σπίτια κατοικούνται μόνο το καλοκαίρι.",
    "chinese": "这个村子位于山脚下，小河从村子中间流过，两岸都是稻田和果园。过去大多数居民以捕鱼和种田为生，现在年轻人大多在附近的城市工作。山坡上有一座三百年前由当地工匠建造的木制小庙，每年春天都有许多人来这里祈求丰收。村口的老树据说已经有五百多年的历史，夏天的傍晚老人们常常坐在树下聊天。",
    "japanese": "この村は山のふもとにあり、小さな川が村の中央を流れている。昔はほとんどの住民が漁業と農業で生計を立てていたが、今では若者の多くが近くの町で働いている。丘の上には三百年前に地元の職人が建てた木造の社が残っており、毎年春になると多くの人が訪れる。",
    "thai": "หมู่บ้านแห่งนี้ตั้งอยู่เชิงเขามีแม่น้ำสายเล็กไหลผ่านกลางหมู่บ้านและมีทุ่งนาอยู่ทั้งสองฝั่ง สมัยก่อนชาวบ้านส่วนใหญ่หาปลาและทำนาเป็นอาชีพแต่ปัจจุบันคนหนุ่มสาวทำงานในเมืองใกล้เคียง",
    "arabic": "تقع القرية عند سفح التل حيث يجمع الجدول مياه الحقول. كان معظم السكان في الماضي يعملون في الصيد والزراعة، أما اليوم فيعمل كثير من الشباب في المدينة القريبة. وعلى التل مسجد صغير بناه حرفيون محليون قبل ثلاثمئة عام.",
}


def test_languages_without_common_words_are_no_junk(spark):
    rows = [(k, t) for k, _, t in corpus()] + list(FOREIGN.items()) + [(f"{k}, wrapped", "\n".join(t[i : i + 60] for i in range(0, len(t), 60))) for k, t in FOREIGN.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("fr", w) for w in "le la les de du des un une et dans sur qui que est pour par avec".split()], "lang string, word string")
    found = {r.doc_id: r.kind for r in prose.text_types(prose.text_statistics(df, "doc_id", "text", common)).collect()}
    assert {found[k] for k in FOREIGN} <= {None, "prose"}
    assert not [k for k in FOREIGN if found[f"{k}, wrapped"] in ("junk", "table")]


def test_few_different_words_count_in_windows():
    common = prose.CommonWords({"en": set(COMMON)})
    one, _ = prose.statistics("mill pond " * 40, common)
    rng = random.Random(5)
    text = " ".join(" ".join(rng.sample(SENTENCES, 5)) for _ in range(600))
    many, _ = prose.statistics(text, common)
    assert one["unique_share"] <= 0.05 and many["unique_share"] > 0.3
    assert abs(prose.statistics(text[: len(text) // 20], common)[0]["unique_share"] - many["unique_share"]) < 0.05


def test_many_patterns_are_learned_where_they_lie(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id string, text string")
    common = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    measured = prose.text_statistics(df, "doc_id", "text", common).cache()
    once = {r.doc_id: (r.kind, round(r.certainty, 6)) for r in prose.text_types(measured).collect()}
    monkeypatch.setattr(prose, "MOST_PATTERNS", 3)
    assert {r.doc_id: (r.kind, round(r.certainty, 6)) for r in prose.text_types(measured).collect()} == once
    monkeypatch.setattr(prose, "MOST_PAIRS", 5)
    rare = {r.doc_id: r.kind for r in prose.text_types(prose.text_statistics(df, "doc_id", "text", common)).collect()}
    assert set(rare) == set(once) and None not in rare.values()


def test_rare_pairs_count_in_full(spark, monkeypatch):
    rows = [(k, t) for k, _, t in corpus()] + [("prose0", "It is on the hill and in the pond."), (None, "the mill and the pond of it"), ("blank", " "), ("none", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("fr", w) for w in "le la de des a on".split()], "lang string, word string")
    result = lambda: sorted(map(str, prose.text_statistics(df, "doc_id", "text", common).collect()))
    once = result()
    assert len(once) == len(rows)
    for most in (1, 5, 60, 100_000):
        monkeypatch.setattr(prose, "MOST_PAIRS", most)
        assert result() == once


def test_cohesion_leaves_the_text_itself_out():
    codes, seen, expected = np.array([3, 7]), np.array([10.0, 2.0]), np.array([4.0, 5.0])
    found = prose.cohesion([[3, 3, 7], [], [99]], codes, seen, expected)
    assert found[0] == pytest.approx((2 * np.log(8.5 / 4.5) + np.log(1.5 / 5.5)) / 3) and found[1] == 0 and found[2] == 0
    assert prose.cohesion([[3], []], *(np.zeros(0),) * 3).tolist() == [0, 0]


def test_learning_recovers_rates():
    rng = np.random.default_rng(1)
    own = [t for _, t, _ in prose.FUNCTIONS]
    patterns: dict[str, int] = {}
    truth = []
    for _ in range(6000):
        t = rng.choice(prose.TYPES, p=[0.7, 0.1, 0.06, 0.06, 0.03, 0.03, 0.02])
        key = "".join("1" if rng.random() < (0.85 if o == t else 0.03) else "0" for o in own)
        patterns[key] = patterns.get(key, 0) + 1
        truth.append((key, t))
    posterior, _ = prose.learn_types(patterns)
    right = sum(k in posterior and prose.main_type(posterior[k])[0] == t.split(":")[0] for k, t in truth)  # without a vote there is no type
    assert right > 0.93 * len(truth)
    assert prose.learn_types({})[0] == {}


@pytest.mark.parametrize("run", ["xo", "-=", "= ", ". ", "=", "|", "#", "Ã©", "1", "• a\n"])
def test_statistics_are_linear_on_long_runs(run):
    import time

    began = time.perf_counter()
    found, pairs = prose.statistics(run * 60_000, prose.CommonWords({"en": set(COMMON)}))
    prose.votes(pd.DataFrame([{**found, "cohesion": prose.cohesion([pairs], *(np.zeros(0),) * 3)[0]}]))
    assert time.perf_counter() - began < 5


# ---- queries ----


def test_every_query_runs(spark, sf):
    from landweave.llm.catalog import QUERIES

    for name, query in QUERIES.items():
        rows = query(spark, sf).collect()
        assert rows or name.endswith("_found"), name

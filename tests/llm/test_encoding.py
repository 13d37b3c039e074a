"""BPE, packing: the tokenizers library and brute force are the yardsticks."""

import hashlib
import json
import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewarden.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens string, deal double"
ALPHABET = "abcdeXYZ  \t\n'sdtlrevmÀéßÑ×÷0123²½ªµºéΣΑσςİıǅ \u2003\x1c\x85!?.-_<|>日本語한국éñ🎉ﬁ١٢Ⅷ"


@pytest.fixture(scope="module")
def lexicon():
    return bpe.Lexicon(bpe.compile_lexicon(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_automaton_is_minimal_and_finds_its_words(lexicon):
    words = sorted({"".join(p).encode() for p in [*zip("abcabc", "xyzzyx", "endend"), ("q",), ("qe", "nd")]})
    states = bpe.minimal_automaton(words)
    seen = {(f, tuple(a)) for f, a in states}
    assert len(seen) == len(states)
    for word in ("the", "and", "photography"):
        assert lexicon.find(word.encode()) == lexicon.merger.ids(word)
    assert lexicon.find(b"thezzz") is None and lexicon.find(b"th\xff") is None


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_same_ids_as_the_library(lexicon, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text, lexicon) == want
    assert bpe.decode(want, lexicon) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|startoftext|>", "<|endoftext|><|endoftext|> x", "don't I'LL we'Ve", "abc" * 300, "é" * 200, "z" * 41, "Σ" * 50, "", " \n", "<|ENDOFTEXT|>", "a\x1cb", "\x00 \x7f"])
def test_special_tokens_and_long_words(lexicon, library, text):
    assert bpe.encode(text, lexicon) == library.encode(text, add_special_tokens=False).ids


def test_special_tokens_without_an_angle_bracket(tmp_path):
    spec = json.loads(open(PATH).read())
    for token, name in zip(spec["added_tokens"], ("[begin]", "*end*"), strict=True):
        token["content"] = name
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    own, library = bpe.Lexicon(bpe.compile_lexicon(str(path))), Tokenizer.from_file(str(path))
    for text in ("a[begin]b *end*", "[begin]", "[ begin] * end", "<|endoftext|>"):
        assert bpe.encode(text, own) == library.encode(text, add_special_tokens=False).ids


def test_long_and_short_merging_agree(lexicon):
    r = random.Random(1)
    for _ in range(200):
        data = "".join(r.choice("thearnedio") for _ in range(r.randint(1, 60))).encode()
        parts = [*(lexicon.merger.inner[b] for b in data[:-1]), lexicon.merger.last[data[-1]]]
        assert lexicon.merger._short(list(parts)) == lexicon.merger._long(list(parts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), max_size=8))
def test_memo_gives_the_same(lexicon, library, texts):
    memo = bpe.Memo(lexicon, lambda ids: " ".join(map(str, ids)).encode(), b" ")
    for text in texts + ["<|ENDOFTEXT|> <|endoftext|>", *texts]:
        got = b" ".join(map(memo.__getitem__, lexicon.pieces(text))).decode()
        assert got == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


ROWS = [(1, "The cat", "x", 0.5), (1, "The cat", "x", 0.5), (None, "a b", "x", None), (2, None, None, None), (3, "", None, None), (4, "word " * 5000, "y", 1.0), (5, "<|endoftext|>", "y", 1.0)]


def test_encode_decode_rows(spark, library):
    out = bpe.encode_decode(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((doc_id, len(ids), *digest))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_first_fit_decreasing_is_exact(sizes):
    bins, offsets = packing.first_fit_decreasing(sizes, 16)
    free, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        place = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if place == len(free):
            free.append(16)
        want[i] = (place, 16 - free[place])
        free[place] -= sizes[i]
    assert {i: (bins[i], offsets[i]) for i in range(len(sizes))} == want


def test_packing_rows(spark, library):
    out = [r.asDict() for r in packing.pack_documents(spark.createDataFrame(ROWS * 3, SCHEMA), PATH, length=64, group_docs=8).collect()]
    pieces = {}
    for doc_id, text, *_ in ROWS * 3:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 64):
            piece = ids[start : start + 64]
            key = (doc_id, start, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece)), len(ids))
            pieces[key] = pieces.get(key, 0) + 1
    got = {}
    for r in out:
        key = (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
        got[key] = got.get(key, 0) + 1
    assert got == pieces
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 64
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_packing_does_not_depend_on_the_order_of_rows(spark):
    """A task that runs again may get its rows in another order; its pieces go where they went."""
    rows = [(i % 40 if i % 3 else None, f"text {i % 60} " * (i % 90), "x", 0.0) for i in range(400)]
    dealt = spark.createDataFrame(rows, SCHEMA).repartition(4, "doc_id")
    packed = [sorted(map(str, packing.pack_documents(d, PATH, length=64, group_docs=20).collect())) for d in (dealt.sortWithinPartitions("text"), dealt.sortWithinPartitions(F.desc("n_tokens"), F.desc("text")))]
    assert packed[0] == packed[1] and len(packed[0]) > 400

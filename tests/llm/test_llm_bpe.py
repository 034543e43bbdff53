"""Splitting into words and merge replay, against public tokenizers."""

import os
import random

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, pretokens

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_TOKENIZER), reason="needs the public tokenizers")


def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def split(texts):
    words, counts = pretokens.words_of(texts)
    flat, at, out = words.to_pylist(), 0, []
    for n in counts:
        out.append(flat[at : at + n])
        at += n
    assert at == len(flat)
    return out


def expected(texts):
    return [[w.encode() for w in PATTERN.findall(t or "")] for t in texts]


soup = st.lists(st.sampled_from(["'", "'s", "'ll", "'LL", "re", "ve", " ", "  ", "\n", "\t", "a", "Zé", "1", "²", "!", "_", "中", "😀", "\u00a0", "\u2028", "<|endoftext|>", "\x00", "d", "t"]), max_size=25).map("".join)


LATER = {c for span in pretokens.LATER.split() for c in range(int(span.split("-")[0], 16), int(span.split("-")[-1], 16) + 1)}
anything = st.text(max_size=20).map(lambda t: "".join(c for c in t if ord(c) not in LATER))  # the pattern's library knows more characters


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(soup, st.none(), anything), max_size=5))
def test_words(texts):
    assert split(texts) == expected(texts)


def test_no_texts():
    assert split([]) == [] and split(["", None]) == [[], []]


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(pretokens, "PIECE", 50)
    rng = random.Random(1)
    texts = ["".join(rng.choices(["ab", " ", " ", "\n", "'s", "12", "é", "?"], k=400)), "x" * 300, " " * 300, "a b " * 100, "", "word"]
    assert split(texts) == expected(texts)


def test_character_classes_are_the_tokenizers():
    encode = reference()
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
    table = pretokens.char_classes()
    for code in [*range(0x300), *range(0x300, 0x110000, 211)]:
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        kind = next((k for k, lead in ((pretokens.LETTER, "a"), (pretokens.NUMBER, "1"), (pretokens.OTHER, "!")) if len(cut.pre_tokenize_str(lead + c)) == 1), pretokens.SPACE)
        assert table[code] == kind, hex(code)
    assert encode("") == []


def test_replay_of_words():
    encode, m = reference(), bpe.load_merges()
    rng = random.Random(5)
    words = [b"", b"a", b"aaaa", b"aaaaaaa", b" " * 17, b"=" * 33, b"ababababa", "naïve".encode(), "😀😀".encode(), b" the", b"antidisestablishmentarianism"]
    words += ["".join(rng.choices("abcdeinorst", k=rng.randint(1, 14))).encode() for _ in range(600)]
    words = list(dict.fromkeys(words))
    ids, cuts = bpe.replay(pa.array(words, pa.binary()), m)
    for i, w in enumerate(words):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == encode(w.decode()), w
    ids, cuts = bpe.replay(pa.array([], pa.binary()), m)
    assert len(ids) == 0 and cuts.tolist() == [0]


def test_replay_of_a_slice():
    m = bpe.load_merges()
    words = pa.array([b"skipped", b"hello", b" world", b"after"], pa.binary())
    ids, cuts = bpe.replay(words.slice(1, 2), m)
    whole, ends = bpe.replay(words, m)
    assert ids.tolist() == whole[ends[1] : ends[3]].tolist() and len(cuts) == 3


@pytest.mark.parametrize("block", [40, 10**6])
def test_corpus(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", block)
    monkeypatch.setattr(bpe, "REPLAY_ROWS", 25)
    encode = reference()
    texts = ["Hello world, it's 2024!", None, "", "<|endoftext|> is text", "same", "same", "  \n\n  x", "日本語 naïve 😀", "word " * 500, "x" * 3000, "\x00\u200b\r\n"]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)] + [(None, "no key", None, None)], "doc_id long, text string, key string, block int")
    got = [(r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()]
    assert len(got) == len(texts) + 1 and dict(got) == {i: encode(t) for i, t in enumerate(texts)} | {None: encode("no key")}
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}
    assert counts == {k: len(v) for k, v in got}


def test_empty_corpora(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_corpus(df).count() == 0 and bpe.token_counts(df).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in bpe.encode_corpus(blank).collect()} == {1: [], 2: []}


def test_other_key_types(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "name string, body string")
    assert {r.name: r.n_tokens for r in bpe.token_counts(df, "name", "body").collect()} == {"a": 2, "b": 0}

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rivulet.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(open(PATH, encoding="utf-8").read())
ODD = ["", " ", "It's the THERE'RE'll 12ab", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ İstanbul ﬁ é  x y\u0085z", "x" * 500, "lo" * 3000, "!?#" * 200, "日本語 и русский 🙂🙂", "a\x1cb\x1fc\x00d", "don't DON'T'S", " ᠎​﻿1²½Ⅷ", "naïve Ünïcödé ñandú", "don’t"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_as_the_library(text):
    assert CODEC.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.decode(CODEC.encode(text)) == LIBRARY.decode(CODEC.encode(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=80))
def test_any_text_as_the_library(text):
    assert CODEC.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_many_texts_at_once():
    assert [x.tolist() for x in CODEC.encode_many(ODD)] == [CODEC.encode(t) for t in ODD]


def test_scan_and_heap_agree():
    for w in ("international", "thererationing", "lolololololol", "a"):
        raw = w.encode()
        parts = [CODEC.inner[b] for b in raw[:-1]] + [CODEC.final[raw[-1]]]
        assert CODEC.words_ids([w]) == [CODEC._heap(list(parts))]


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello there", None), (3, "Hello there", None), (None, "w " * 20000, "z")], "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens): r for r in bpe.digest(df).collect()}
    assert got[1, 0].ids_sha256 == hashlib.sha256(b"").hexdigest() == got[2, 0].decoded_sha256
    assert (None, 20000) in got and len(bpe.digest(df).collect()) == 5
    ids = bpe.encode(df)
    back = {r.doc_id: r.decoded for r in bpe.decode(ids).collect()}
    assert back[3] == LIBRARY.decode(LIBRARY.encode("Hello there", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.digest(df.limit(0)).collect() == []


def test_memory_is_bounded(monkeypatch):
    """What a worker remembers stays within its bound and changes no result."""
    codec, plain = bpe.Codec(bpe._raw(None)), bpe.Codec(bpe._raw(None))
    monkeypatch.setattr(bpe, "REMEMBER", 20_000)
    for k in range(30):
        texts = [f"word{i * k} other{i}, some more words {k}" for i in range(20)]
        got = codec.digests(texts)
        assert codec.held <= 20_000 and got == [plain.digests([t])[0] for t in texts]
    codec.forget()
    assert not codec.known and codec.held == 0

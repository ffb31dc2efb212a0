import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import sentencepiece_codec as sc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return sc.Codec(MODEL)


def test_equals_the_library(codec, library):
    rng = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "    ", "▁", "\n", "\t", "é", "漢", "😀", "ing", "tion", "0", ".", "\u0000", "　", "Ж", "İ", "<s>", "</s>",
             "<unk>", "<0x0A>", "x" * 40, "\r\n", "﻿", "ﬁ", "1234567890", "http://"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["a" * 50_000, " " * 5_000, "ab1" * 20_000, "漢字" * 5_000, "", None]
    got = list(codec.encode_all(texts))
    for text, ids in zip(texts, got):
        assert ids == library.encode(text or "", add_eos=True), repr(text)[:80]
        assert codec.decode(ids) == library.decode(ids)


def test_small_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sc, "CACHED_WORDS", 5)
    monkeypatch.setattr(sc, "CACHED_PAIRS", 5)
    monkeypatch.setattr(sc, "SLICE", 10)
    codec = sc.Codec(MODEL)
    texts = ["some words and some more words", "more words, and others", "x", None, "some words"] * 3
    assert list(codec.encode_all(texts)) == [library.encode(t or "", add_eos=True) for t in texts]


def test_on_a_table(docs, clashing, empty, corpus, library):
    def row(doc_id, text):
        ids = library.encode(text or "", add_eos=True)
        return (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())

    want = sorted((row(r[0], r[1]) for r in corpus), key=str)
    assert sorted((tuple(r) for r in sc.encoded(docs, MODEL).collect()), key=str) == want
    assert sorted((tuple(r) for r in sc.encoded(clashing, MODEL).collect()), key=str) == want
    assert sc.encoded(empty, MODEL).collect() == []

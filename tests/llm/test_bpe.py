"""Token ids equal to the library's, for whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import ODD_ROWS, clashing, no_documents, odd_documents
from tokenizers import Tokenizer

from farebox.llm.bpe import ForcedBoundaryBpe, encode_texts
from farebox.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return ForcedBoundaryBpe(PATH)


def agree(own, library, text):
    theirs = library.encode(text, add_special_tokens=False).ids
    return own.encode(text) == theirs and own.decode(theirs) == library.decode(theirs, skip_special_tokens=False)


def test_special_texts(own, library):
    texts = [
        "", " ", "Hello  World's", "<|endoftext|>x<|startoftext|>", "ΑΣ ΣΑ İ ǅ ß ẞ ﬁ ①²½", "é é ä",
        "a" * 4000, "ab" * 700 + "!" * 900, "日本語テキスト", "\x00 \x85  x", "it's I'LL don't'd", "12345 6",
    ]
    for text in [*texts, *(r[1] or "" for r in ODD_ROWS)]:
        assert agree(own, library, text), text[:50]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=80))
def test_random_texts(text):
    own, library = _pair()
    assert agree(own, library, text)


_made = []


def _pair():
    if not _made:
        _made.append((ForcedBoundaryBpe(PATH), Tokenizer.from_file(PATH)))
    return _made[0]


def test_cuts_are_safe_and_useful(own):
    """No token spans a cut, and many words are cut."""
    r = random.Random(1)
    cut = 0
    for _ in range(500):
        symbols = own.symbols_of("".join(r.choice("etaoinshrdluqxzj") for _ in range(12)) + own.end)
        parts = list(own.cut(symbols))
        assert [s for p in parts for s in p] == symbols
        cut += len(parts) > 1
    assert cut > 50
    pair = ("q", "z")
    assert pair not in own.joined and not any("qz" in t for t in own.vocab)


def test_memo_limit_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("farebox.llm.bpe.MEMO_FRAGMENTS", 3)
    monkeypatch.setattr("farebox.llm.bpe.MEMO_WORDS", 3)
    small = ForcedBoundaryBpe(PATH)
    assert all(agree(small, library, r[1] or "") for r in ODD_ROWS)


def test_tables(spark, library):
    docs = clashing(odd_documents(spark), "ids", "n_tokens")
    rows = encode_texts(docs, PATH).collect()
    assert len(rows) == len(ODD_ROWS) and rows[0].extra == "mine"
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert encode_texts(no_documents(spark), PATH).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and r.n_tokens == len(ids)

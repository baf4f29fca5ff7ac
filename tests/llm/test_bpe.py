import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselink.llm import bpe, queries

from . import cases

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    return bpe.codec(queries.vocabulary()), tokenizers.Tokenizer.from_file(queries.vocabulary())


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(pair, text):
    mine, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=0x104), max_size=40))
def test_latin_text(pair, text):
    mine, library = pair
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_token_strings(pair):
    mine, library = pair
    rng = random.Random(7)
    strings = [t.decode("utf-8", "ignore") for t in mine.token]
    for _ in range(4000):
        text = "".join(rng.choice(strings) for _ in range(rng.randint(1, 9)))
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_any_ids_decode_alike(pair):
    mine, library = pair
    rng = random.Random(8)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 12))]
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_piece(pair):
    mine, library = pair
    for text in ("ab" * 30000, "a" * 50000, "<|endoftext|>" * 500 + "x"):
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, pair):
    library = pair[1]
    docs = cases.frame(spark)
    coded = bpe.encode_documents(docs, queries.vocabulary())
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded, queries.vocabulary()).collect()}
    out = bpe.round_trip(docs, queries.vocabulary()).collect()
    assert len(out) == len(cases.rows()) == coded.count() and out[0]["size"] == "clash"
    for (doc, text, *_) in cases.rows():
        assert back[doc] == (text or "")
    want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t, *_ in cases.rows()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in out:
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_empty(spark):
    assert bpe.round_trip(cases.empty(spark), queries.vocabulary()).count() == 0

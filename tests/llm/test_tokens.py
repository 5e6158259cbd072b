"""Token counts and BPE against the public libraries, over whole texts."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import bpe, queries, token_counts

TRICKY = ["", " ", "a  b", "we're  's '' they've\n\n x", "it'll 'l 'll\t\t", "x<|endoftext|>y <|endo", "<|endoftext|> <|endoftext|>  q", "ñ日本語 éà   ü", "!" * 700, " " * 900, "x" * 1500, "123 4567 ²½", " 　 a  b"]
WILD = st.text(alphabet=st.sampled_from(list(" \t\n'abcdersvlm.,!09ñ日² <|>")), max_size=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranks():
    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=found, special_tokens={})


def counter():
    return token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN)


def test_counts_of_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
        assert len(library.encode(texts[r.doc_id][: r.limit_chars], add_special_tokens=False).ids) <= 1024
        if n > 1024:
            assert all(len(library.encode(texts[r.doc_id][: r.limit_chars + k], add_special_tokens=False).ids) > 1024 for k in (1, 2, 5))


@pytest.mark.parametrize("text", TRICKY)
def test_every_prefix(library, text):
    text = text[:300]
    assert counter().prefixes(text).tolist() == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


@given(WILD)
@settings(max_examples=60, deadline=None)
def test_any_prefix(text):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json")) if not hasattr(test_any_prefix, "lib") else test_any_prefix.lib
    test_any_prefix.lib = library
    assert counter().prefixes(text).tolist() == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter().count(text) == len(library.encode(text, add_special_tokens=False).ids)


@given(WILD, st.integers(0, 25))
@settings(max_examples=150, deadline=None)
def test_budget_place_from_word_totals(text, budget):
    assert counter().fitting(text, budget) == int(np.flatnonzero(counter().prefixes(text) <= budget)[-1])


def test_runs_are_linear():
    import time

    start = time.time()
    for text in (" " * 40_000 + "x", "'" * 40_000, "x" * 20_000):
        assert len(counter().prefixes(text)) == len(text) + 1
    assert time.time() - start < 20


def test_budget(spark, library):
    docs = spark.createDataFrame([(1, "hello there, we're   here " * 30, "x"), (2, None, "y"), (None, "", "z")], "doc_id bigint, text string, n_tokens string")
    rows = {r.doc_id: r for r in token_counts.prefix_token_counts(docs, budget=50).collect()}
    cut = rows[1].budget_chars
    assert rows[1].prefix_tokens[cut] <= 50 < min(rows[1].prefix_tokens[cut + 1 :])
    assert rows[2].prefix_tokens == [0] and rows[2].budget_chars == 0
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect())[0] == (0, 0, 0)


def test_empty_table_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.token_counts(empty).count() == 0 and bpe.round_trip(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert [r.n_tokens for r in token_counts.token_counts(twice).collect()] == [2, 2]


def test_encoding_of_whole_table(spark, sf_dir, ranks):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op10_byte_bpe(spark, sf_dir).collect():
        ids = ranks.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_tricky_encoding_and_round_trip(spark, ranks):
    docs = spark.createDataFrame([*enumerate(TRICKY), (99, None)], "doc_id bigint, text string")
    encoded = bpe.encode(docs)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {n: ranks.encode_ordinary(t) for n, t in enumerate(TRICKY)} | {99: []}
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == dict(enumerate(TRICKY)) | {99: ""}


def test_small_caches_and_groups(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 8)
    model = bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = ["the quick brown fox", "jumps over the lazy dog", "the fox"]
    for text in texts:
        (ids,) = model.encode_all([text])
        assert np.frombuffer(ids, "<u4").tolist() == ranks.encode_ordinary(text)


def test_long_pretokens_are_keyed(ranks):
    import random

    draw = random.Random(5)
    letters = lambda n, of: "".join(draw.choices(of, k=n))
    texts = ["a" * 20_000, "lorem" * 4_000, letters(700, "abcdefghijklmnopqrstuvwxyz"), letters(900, "ab"), "=" * 5_000, letters(600, "etaoin") + " x " + "ß" * 400, "aab" * 300]
    model = bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = model.encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ranks.encode_ordinary(t) for t in texts]
    assert model.decode_all(got) == [t.encode() for t in texts]


def test_both_recursions_agree(ranks, monkeypatch):
    words = "internationalization unbelievable zzzzzzzz abababab Straßenbahn 12345 \n\n\n aaa aaaa".split(" ")
    monkeypatch.setattr(bpe, "LONG_WORD", 2)
    model = bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode_all(words)] == [ranks.encode_ordinary(w) for w in words]

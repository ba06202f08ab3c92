from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from adpulse.llm import byte_bpe as b

RANKS = b.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
TOK = b.tokenizer(RANKS, P.PATTERN)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=TOK.ranks, special_tokens={})

EDGES = ["", " ", "  a", "a\n\n b \t", "don't we'll I'D", "naïve café Straße ÇA", "x\x1cy\x1dz", "a\x85b\xa0c d　 e", "½²ªµº×÷", "日本語 テスト 😀👍🏽",
         "éà", " x y", "1234567 12.5 Ⅷ ٣٤", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "=" * 3000, "ab" * 2000, "<|endoftext|>", " \n" * 100 + "x", "ſƀŽ", "\x00\x01"]


@pytest.mark.parametrize("text", EDGES)
def test_edges_equal_the_library(text):
    assert TOK.encode(text) == REF.encode_ordinary(text)
    assert TOK.decode(np.array(TOK.encode(text), np.int64)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_any_text_equals_the_library(text):
    assert TOK.encode(text) == REF.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="thererndsaoiueéß=- ", max_size=200))
def test_word_like_texts_equal_the_library(text):
    assert TOK.encode(text) == REF.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60))
def test_join_is_a_product(x, y):
    assert TOK.join(TOK.merged(x), TOK.merged(y)) == TOK.merged(x + y)


def test_both_base_forms_agree():
    rng = np.random.default_rng(0)
    for _ in range(30):
        data = bytes(rng.choice(list(b"abethr n"), 64).astype(np.uint8))
        assert TOK._merged_long(data) == TOK.merged(data)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(b, "CACHE_ENTRIES", 10)
    tok = b.Tokenizer(TOK.ranks, P.PATTERN)
    text = " ".join(f"word{i}x" for i in range(300))
    assert tok.encode(text) == REF.encode_ordinary(text)
    assert max(len(tok.piece), len(tok.leaf), len(tok.window)) <= 10


def test_spark_jobs(spark):
    rows = list(enumerate([*EDGES, None])) + [(0, "again"), (None, "x")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, ids int")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(d, len(i := REF.encode_ordinary(t or "")), sha(np.array(i, "<u4").tobytes()), sha((t or "").encode())) for d, t in rows]
    assert sorted(map(tuple, b.digests(df, RANKS, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    enc = b.encode(df, RANKS, P.PATTERN)
    assert sorted([(r.doc_id, bytes(r.bytes)) for r in b.decode(enc, RANKS, P.PATTERN).collect()], key=str) == sorted([(d, (t or "").encode()) for d, t in rows], key=str)
    assert b.digests(df.limit(0), RANKS, P.PATTERN).count() == 0

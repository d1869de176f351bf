import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe
from lectern.llm.queries import QUERIES, RANKS

CONTENT = open(RANKS, "rb").read()
TABLE = bpe.parsed_ranks(CONTENT)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TABLE, special_tokens={})
ODD = ["", "'", "''s", " 's", "it's", "'lll", "'ve've", "x  's", "\n's", "a b 　 c", "  ", "a  ", "12 34", "é'É", "🙂🙂 ok",
       "w" * 5000, " " * 5000 + "x", "'" * 500, "ab1!" * 3000]


def encoded(texts, cache):
    return [np.frombuffer(b"".join(map(cache.__getitem__, p)), "<u4").tolist() for p in bpe.pieces(texts)]


@pytest.mark.parametrize("window", [5, 64, 1 << 18])
def test_equals_tiktoken(monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    rng = random.Random(window)
    texts = ODD + ["".join(rng.choices([*"abs'tmdrevl  \n\t'12!é　\x85.", "'re", "'ll"], k=rng.randint(0, 40))) for _ in range(2000)]
    assert encoded(texts, bpe.MergeCache(TABLE, 500)) == [PLAIN.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_tiktoken_on_any_text(text):
    assert encoded([text], bpe.MergeCache(TABLE)) == [PLAIN.encode_ordinary(text)]


def test_merges_agree():
    rng = random.Random(2)
    cache = bpe.MergeCache(TABLE)
    for _ in range(3000):
        piece = "".join(rng.choices("etaoinshrdluçéü", k=rng.randint(1, 40))).encode()
        want = bpe.merged_pairs(piece, TABLE) if piece not in TABLE else [TABLE[piece]]
        assert np.frombuffer(cache[piece], "<u4").tolist() == want
        assert piece in TABLE or bpe._merged_long(piece, TABLE) == want


def test_round_trip_offsets_and_odd_rows(spark):
    rows = [(i, t, b"x") for i, t in enumerate(ODD)] + [(None, None, None), (1, "twice", None), (1, "twice", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids binary")
    ids = bpe.encode_documents(docs, RANKS)
    got = {(r.doc_id, bytes(r.decoded)) for r in bpe.decode_documents(ids, RANKS).collect()}
    assert got == {(d, (t or "").encode()) for d, t, _ in rows} and ids.count() == len(rows)
    both = bpe.encode_documents(docs, RANKS, decode=True)
    assert {(r.doc_id, bytes(r.decoded)) for r in both.collect()} == got
    tokens, _ = bpe.vocabulary(CONTENT)
    for r in ids.collect():
        text = b"".join(map(tokens.__getitem__, np.frombuffer(r.ids, "<u4").tolist()))
        for a, b in ((0, 0), (0, 3), (2, 7), (len(text) - 2, len(text) + 5), (3, 2)):
            assert bpe.decoded_range(r.ids, r.offsets, tokens, max(a, 0), b) == text[max(a, 0):max(b, 0)]
    assert bpe.encode_documents(docs.limit(0), RANKS).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_documents(docs, RANKS, keep=("doc_id", "ids"))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = PLAIN.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_short_pieces_are_merged_without_the_cached_pairs():
    cache = bpe.MergeCache(TABLE)
    for piece in (b"xqzvkj", b" qqqzzx", b"w" * bpe.SHORT_PIECE):
        assert np.frombuffer(cache[piece], "<u4").tolist() == PLAIN.encode_ordinary(piece.decode())
    assert not cache.pairs
    cache[b"xqzvkj" * 5]
    assert cache.pairs

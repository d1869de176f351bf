import hashlib

import numpy as np
import tiktoken
from test_decontaminate import plain as leaks
from test_secrets import plain as secret_spans
from test_simhash import plain_groups, plain_print

import corpus_pipeline as P
from lectern.llm import bpe, secrets

SF = "/root/testdata/sf0.001"


def masked(text):
    out, at = "", 0
    for _, a, b in secret_spans(text):
        if a >= at:
            out += text[at:a] + secrets.MASK
        at = max(at, b)
    return out + text[at:]


def test_run_equals_plain_stages(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    groups = plain_groups([plain_print(t) for _, t in docs])
    docs = [docs[g] for g in sorted(set(groups))]
    leaked = {d for d, _ in leaks(docs, items)}
    ranks = bpe.parsed_ranks(open(P.RANKS, "rb").read())
    encoding = tiktoken.Encoding("plain", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in docs:
        if d not in leaked:
            ids = encoding.encode_ordinary(masked(t))
            want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256(masked(t).encode()).hexdigest())
    rows = P.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)
    assert leaked and len(docs) < 200


def test_stages_keep_the_columns_and_take_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1.0, "x"), (2, "a few words here", "en", "s", 16, 1.0, "x"),
            (2, "a few words here", "en", "s", 16, 1.0, "x"), (3, "token=abcdefghijklmnop", None, None, 22, None, None)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == table.columns
        left = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
        assert sorted(left) == ([(2, "a few words here", 16), (3, secrets.MASK, 8)] if table.count() else [])
        assert P.STAGES[-1][1](spark, docs, SF).count() == len(left)

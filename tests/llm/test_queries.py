"""The registered queries and the pipeline over a whole small table, against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from diurna.llm import bpe
from diurna.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES, WORD_BPE, vocabulary
from tests.llm.test_native import _brute
from tests.llm.test_search import _components, _set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _round_trip(tok, text):
    ids = tok.encode(text, add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_op2(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op2_url_filter"](spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule = _brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.pattern if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def test_op4(spark, docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary(PIECE_BPE))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op4_token_count"](spark, SF).collect()}
    assert got == {d: (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for d, t in docs.items()}


def test_op7(spark, docs):
    tok = bpe.load(vocabulary(WORD_BPE).decode())
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op7_bpe_round_trip"](spark, SF).collect()}
    assert got == {d: _round_trip(tok, t) for d, t in docs.items()}


def test_op8(spark, docs):
    tok, want, start = bpe.load(vocabulary(BYTE_BPE).decode()), {}, 0
    for d in sorted(docs):
        ids = [*tok.encode(docs[d], add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: tuple(r[1:]) for r in QUERIES["op8_token_file"](spark, SF).collect()} == want


def test_op6_and_op10(spark, docs):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    quality = QUERIES["op10_quality_classifier"](spark, SF).collect()
    assert {r.doc_id for r in quality} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in quality)
    seen = [r for r in quality if r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in seen]) > 0.9
    toxic = {r.doc_id: r.toxic for r in QUERIES["op6_toxicity"](spark, SF).collect()}
    assert set(toxic) == set(docs)
    assert np.mean([toxic[d] == bool(labels[d].toxic) for d in labels]) > 0.9


def test_pipeline_equals_its_stages_by_hand(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:          # the classifiers themselves
        table = stage(spark, table, SF)
    kept = [(r.doc_id, r.text) for r in table.collect()]
    kept = [(d, t) for (d, t), (_, n, low) in zip(kept, _components(kept)) if d == low or not n]
    items = [_set(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [(d, t) for d, t in kept if not any(s and 100 * len(s & _set(t)) >= 75 * len(s) for s in items)]
    tok = bpe.load(vocabulary(WORD_BPE).decode())
    rows = corpus_pipeline.run(spark, SF).collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    assert got == {d: _round_trip(tok, t or "") for d, t in clean}
    assert {r.doc_id: r.ids for r in rows} == {d: tok.encode(t or "", add_special_tokens=False).ids for d, t in clean}
    assert 0 < len(got) < len(docs)

"""Token counts, BPE round trips and token files against the libraries on odd texts."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from diurna.llm import bpe, token_count, token_file, wordtable
from diurna.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE, vocabulary

ODD = ["", " ", "  ", "a", "a ", " a", "a  b", "\n", "a\nb c", " \n a", "a▁b", "▁", "a ▁ b▁", "x\ty  \t z",
       "<|endoftext|> a<|endoftext|>b <|startoftext|>", "é́ ñ", "Aé, b.C, ab,,c<|endoftext|>, <|ENDOFTEXT|>,y",
       "it's, I'LL.", "İstanbul ΣΑΣ.", "a\x1cb!\x1c!\x85c", "日本 語　x", "</s> <s>", "\x00a \x00", "ﬁ ½", "a \n", "\n  b"]


def _texts(n=600):
    rng = random.Random(3)
    parts = list(" \n\tab'.,▁!éÑ1９日　\u0301ſ<|>s\u2028\u00a0") + ["<|endoftext|>", "  "]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_pre_token_counts_equal_the_library():
    import sentencepiece
    model, texts = vocabulary(PIECE_BPE), _texts()
    owner, words = token_count.pre_tokens(pa.array(texts))
    counts = [c[0] for c in token_count.counter(model)([w.encode() for w in words.to_pylist()])]
    got = np.bincount(owner, weights=counts, minlength=len(texts)).astype(int).tolist()
    assert got == [len(x) for x in sentencepiece.SentencePieceProcessor(model_proto=model).encode(texts)]


def test_words_encode_as_whole_texts():
    definition, texts = vocabulary(WORD_BPE).decode(), _texts()
    owner, words = bpe.words(pa.array(texts))
    got = [[] for _ in texts]
    for o, ids in zip(owner, bpe.encoder(definition)([w.encode() for w in words.to_pylist()])):
        got[o] += ids.tolist()
    tok = bpe.load(definition)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    piece = bpe.pieces(definition)
    assert [" ".join(piece[i] for i in ids) for ids in want] == [
        tok.decode(ids, skip_special_tokens=False) for ids in want]


def test_byte_level_words_encode_as_whole_texts():
    definition, texts = vocabulary(BYTE_BPE).decode(), _texts()
    ids, sizes = token_file.byte_level_encoder(definition, 2)(pa.array(texts))
    ends = np.cumsum(sizes)
    want = [e.ids + [2] for e in bpe.load(definition).encode_batch(texts, add_special_tokens=False)]
    assert [ids[z - n:z].tolist() for n, z in zip(sizes, ends)] == want


def test_simple8b_round_trip():
    rng = random.Random(1)
    for bits in (1, 2, 8, 17, 59, 60, 61, 64):
        for n in (0, 1, 119, 120, 240, 241, 900):
            values = np.array([rng.getrandbits(rng.randint(0, bits)) if rng.random() < .6 else 0 for _ in range(n)],
                              np.uint64)
            assert (token_file.unpack(token_file.pack(values)) == values).all()
    runs = np.concatenate([np.zeros(500, np.uint64), np.full(3, (1 << 60) - 1, np.uint64), np.ones(70, np.uint64)])
    assert (token_file.unpack(token_file.pack(runs)) == runs).all()
    assert len(token_file.pack(np.zeros(2400, np.uint64))) < 200      # ten words of zeros
    with pytest.raises(ValueError):
        token_file.unpack(b"none of ours")


def test_packer():
    p = wordtable.Packer()
    a = np.array([0, 5, 1 << 31, 7], np.uint32)
    assert (p.unints(p.ints(a)) == a).all()
    up = np.array([0, 3, 1 << 63, (1 << 64) - 1], np.uint64)
    assert (p.unascending(p.ascending(up)) == up).all()
    assert p.unstrings(p.strings([b"", b"ab", b"c"])) == [b"", b"ab", b"c"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    # nulls, repeated rows, an id before several texts, columns that clash with the results
    texts = _texts(60) + [None, "a b", "a b"]
    rows = [(i, t, float(i), i) for i, t in enumerate(texts)] + [(None, "null id", 0.0, 0), (1, "other text", 0.0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens double, start long")


def _sorted(df, texts):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r[1]))


def test_counts_of_odd_rows(spark, odd_docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary(PIECE_BPE))
    out = token_count.count_tokens(odd_docs, vocabulary(PIECE_BPE), ["doc_id", "start", "n_tokens"], limit=5)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(sp.encode(r.text or "")))
                  for r in odd_docs.collect())
    got = out.collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert token_count.count_tokens(odd_docs.where("false"), vocabulary(PIECE_BPE), ["doc_id"]).count() == 0


def test_round_trip_of_odd_rows(spark, odd_docs):
    definition = vocabulary(WORD_BPE).decode()
    tok = bpe.load(definition)

    def one(r):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        return (r.doc_id if r.doc_id is not None else -1, len(ids),
                hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = bpe.round_trip(odd_docs, definition, ["doc_id"]).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in got) == sorted(
        one(r) for r in odd_docs.collect())
    # decoding reads the ids alone, whoever made them
    made = [(1, [5, 6, 70, 5]), (2, []), (3, None), (4, [1 << 30, 9, -1]), (5, list(range(3000)))]
    back = bpe.decode(spark.createDataFrame(made, "doc_id long, ids array<int>"), definition, ["doc_id"]).collect()
    size = len(bpe.pieces(definition))
    assert {r.doc_id: r.decoded for r in back} == {
        d: tok.decode([i for i in x or [] if 0 <= i < size], skip_special_tokens=False) for d, x in made}
    listed = bpe.ids(odd_docs.where("doc_id = 3"), definition, ["doc_id"]).first()
    assert listed.ids == tok.encode("a", add_special_tokens=False).ids
    assert bpe.round_trip(odd_docs.where("false"), definition, ["doc_id"]).count() == 0


def test_token_file_of_odd_rows(spark, odd_docs):
    definition = vocabulary(BYTE_BPE).decode()
    tok = bpe.load(definition)
    path = token_file.write(odd_docs, definition, 2)
    got = token_file.documents(token_file.read(spark, path), "ids_crc32 bigint", ["ids_crc32"],
                               token_file.checksum).orderBy("start").collect()
    want = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd_docs.collect()))
    ids = [[*tok.encode(t, add_special_tokens=False).ids, 2] for _, t in want]
    n = np.array([len(x) for x in ids])
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in want]
    assert [r.start for r in got] == (np.cumsum(n) - n).tolist() and [r.n_tokens for r in got] == n.tolist()
    # equal ids (two rows of id 1) stand in the order of their texts
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    empty = token_file.write(odd_docs.where("false"), definition, 2)
    assert token_file.read(spark, empty).count() == 0


def test_a_long_text_stays_whole(spark, monkeypatch):
    # one text over several slices, chunks and blocks
    monkeypatch.setattr(wordtable, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(token_file, "BLOCK_IDS", 500)
    long = "wörd, and more.\n" * 3000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([long, "short", long + "x", None])], "doc_id long, text string")
    tok = bpe.load(vocabulary(WORD_BPE).decode())
    got = {r.doc_id: r.n_tokens for r in bpe.round_trip(docs, vocabulary(WORD_BPE).decode(), ["doc_id"]).collect()}
    assert got[0] == len(tok.encode(long, add_special_tokens=False).ids) and got[1] == 1 and got[3] == 0
    byte = bpe.load(vocabulary(BYTE_BPE).decode())
    back = token_file.documents(token_file.read(spark, token_file.write(docs, vocabulary(BYTE_BPE).decode(), 2)),
                                "c bigint", ["c"], token_file.checksum).orderBy("doc_id").collect()
    assert back[2].n_tokens == len(byte.encode(long + "x", add_special_tokens=False).ids) + 1

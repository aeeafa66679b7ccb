"""Lexical search, hard negatives and line deduplication against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.llm import hard_negatives as H
from diurna.llm import lexical_search as X
from diurna.llm import line_dedup as D
from diurna.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---- lexical search -------------------------------------------------------------------

def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                      "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(docs, items, k=10, slope=75):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        asked, found = Counter(_terms(text)), []
        for d, b, n in bags:
            m = 100 - slope + slope * n * n_docs // n_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w, c in asked.items() if w in b)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


def _ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def _search(spark, docs, items, cfg):
    d = spark.createDataFrame([(a, t, 1) for a, t in docs], "doc_id long, text string, m int").repartition(4)
    q = spark.createDataFrame([(a, t, 2) for a, t in items], "item_id long, text string, q int")
    return _ordered([tuple(r) for r in X.search(X.build(d, cfg), q, cfg).collect()])


@pytest.mark.parametrize("cfg", [X.LexicalSearch(), X.LexicalSearch(k=3, part_terms=500, block_bytes=2000, terms_per_round=20)])
def test_search_equals_scoring_every_document(spark, cfg):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["é", "İx", "日本", "W7"]
    text = lambda n: rng.choice([" ", ", ", "\x00-"]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 5, 5, 20, 300]))) for i in range(200)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]                 # ties
    docs += [(None, docs[3][1]), (7, docs[7][1]), (2000, None), (2001, ""), (2002, " .,! ")]
    items = [(i, text(n)) for i, n in enumerate([1, 2, 5, 10, 40, 200])]
    items += [(50, docs[3][1]), (51, None), (52, "unknownword"), (53, "w1 w1 W1"), (None, "w2")]
    assert _search(spark, docs, items, cfg) == _ordered(_ranked(docs, items, cfg.k))


def test_search_of_empty_tables_and_long_texts(spark):
    long = "a " * 300_000 + "needle"
    assert _search(spark, [], [(1, "a")], X.LexicalSearch()) == []
    assert _search(spark, [(1, long), (2, "b needle")], [], X.LexicalSearch()) == []
    docs, items = [(1, long), (2, "b needle"), (3, "c")], [(1, "needle a"), (2, long)]
    assert _search(spark, docs, items, X.LexicalSearch()) == _ordered(_ranked(docs, items))


def test_strata_hold_one_normaliser_and_each_tf_once(spark):
    docs = spark.createDataFrame([(i, "x " * (i % 3 + 1) + "y") for i in range(30)], "doc_id long, text string")
    rows = spark.table(X.build(docs).table).where("term is not null").collect()
    for r in rows:
        assert len(r.ends) == len(r.tfs) == len(r.ms) == len(set(zip(r.ms, r.tfs))) and r.ends[-1] == len(r.docs)
        assert list(zip(r.ms, r.tfs)) == sorted(zip(r.ms, r.tfs), key=lambda x: (x[0], -x[1]))
    assert len({m for r in rows for m in r.ms}) == 3 and sum(len(r.docs) for r in rows) == 60


# ---- hard negatives -------------------------------------------------------------------

def _mined(rows, is_anchor, cfg):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (a, la, va) in enumerate(rows):
        if not is_anchor(a):
            continue
        other = [(dot(va, v), b, lb == la) for j, (b, lb, v) in enumerate(rows) if j != i]
        for ps, p, _ in sorted([o for o in other if o[2]], key=key)[:cfg.positives]:
            fit = [o for o in other if not o[2] and cfg.low * ps <= 100 * o[0] <= cfg.high * ps]
            out += [(a, p, r + 1, n, ps, ns) for r, (ns, n, _) in enumerate(sorted(fit, key=key)[:cfg.negatives])]
    return out


@pytest.mark.parametrize("cfg", [H.HardNegatives(), H.HardNegatives(positives=2, clusters=3, sample=20, group_rows=4,
                                                                  pack_rows=10, block_rows=16, chunk=5)])
def test_negatives_equal_all_pairs(spark, cfg):
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 60, (4, 6))
    rows = []
    for i in range(160):
        c = int(rng.integers(0, 4))
        rows.append((i, int(rng.choice([c, c, 9])), [int(x) for x in middle[c] + rng.normal(0, 30, 6)]))
    rows += [(500 + i, i % 2, [50, 0, 0, 0, 0, 0]) for i in range(40)]       # one vector many times
    rows += [(20, 1, [1, 2]), (20, 1, [1, 2]), (None, 1, [9, 9, 9, 9, 9, 9]), (700, 3, []), (710, 77, [5, 5, 5])]
    df = spark.createDataFrame([(a, b, v, 0) for a, b, v in rows], "vec_id long, label int, vector array<long>, tag int")
    got = H.hard_negatives(df.repartition(3), df.vec_id % 10 == 0, cfg).collect()
    want = _mined(rows, lambda a: a is not None and a % 10 == 0, cfg)
    assert _ordered([tuple(r) for r in got]) == _ordered(want)
    assert H.hard_negatives(df.where("false"), df.vec_id % 10 == 0, cfg).count() == 0
    assert H.hard_negatives(df, df.vec_id < -1, cfg).count() == 0


def test_walk_certifies_before_the_end():
    rng = np.random.default_rng(2)
    near = rng.normal([100, 0, 0, 0], 1, (20, 4)).astype(np.int64)
    far = rng.normal([0, 100, 0, 0], 1, (2000, 4)).astype(np.int64)
    at = np.concatenate([near, far])
    n = len(at)
    all_rows = H.Vectors(np.arange(n), np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64), at)
    order, bound = H.shared_list(at[:5], at)
    assert set(order[:20]) == set(range(20)) and bound[20] < 0.1 * bound[0]
    targets = H.Targets(np.arange(5), np.full(5, H.LEAST), np.full(5, H.MOST), True, 3)
    members = all_rows.take(np.arange(5))
    calls = []
    before, H.scores = H.scores, lambda a, b, exact: (calls.append(len(b)), before(a, b, exact))[1]
    try:
        H.walk(members, all_rows, targets, np.full(5, H.LEAST), 32, True)
    finally:
        H.scores = before
    assert sum(calls) == 32            # the head of the list was enough


def test_null_and_infinite_vectors_take_no_part(spark):
    rows = [(1, 0, [1.0, 2.0]), (2, None, [1.0]), (3, 0, None), (4, 0, [1.0, None]), (5, 0, [float("nan")]),
            (6, 0, [float("inf")]), (7, 0, [-0.001, 0.5]), (8, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert {r.vec_id: r.vector for r in H.quantised(df).collect()} == {1: [256, 512], 7: [-1, 128], 8: []}
    with pytest.raises(ArithmeticError):
        H.hard_negatives(spark.createDataFrame([(1, 1, [1 << 40])], "vec_id long, label int, vector array<long>"),
                         F.col("vec_id") == 1)


# ---- line deduplication ---------------------------------------------------------------

def _lines(docs, cfg):
    """(doc, lines, kept lines) by plain counting."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    split = [(d, (t or "").split("\n")) for d, t in docs]
    times = Counter(k for _, ls in split for k in {key(x) for x in ls})
    first = {}
    for d, i in sorted(((d, i) for i, (d, _) in enumerate(split)), key=lambda x: (x[0] is None, x[0] or 0)):
        for p, x in enumerate(split[i][1]):
            first.setdefault(key(x), (i, p))
    out = []
    for i, (d, ls) in enumerate(split):
        gone = [len(key(x)) >= cfg.min_chars and times[key(x)] >= cfg.min_docs
                and not (cfg.keep == "first" and first[key(x)] == (i, p)) for p, x in enumerate(ls)]
        out.append((d, len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone) if not g)))
    return out


def _corpus():
    rng = random.Random(8)
    common = ["Menu", " menu\t", "Foot  note", "é É", "", "MENÜ", "x" * 2000]
    docs = [(i, "\n".join(rng.choice(common) if rng.random() < .5 else f"line {rng.randrange(90)}"
                          for _ in range(rng.choice([1, 2, 9, 60])))) for i in rng.sample(range(900), 150)]
    return docs + [(1000, None), (1001, ""), (1002, "\n"), (1003, "a\r\nA \n\n a"), (None, "Menu\nnull id")]


@pytest.mark.parametrize("cfg", [D.LineDedup(), D.LineDedup(min_chars=0, min_docs=3, chunk_bytes=3000),
                                 D.LineDedup(min_docs=2, keep="first", chunk_bytes=2000), D.LineDedup(min_docs=1, keep="first"),
                                 D.LineDedup(min_chars=8, min_docs=4)])
def test_lines_equal_counting(spark, cfg):
    docs = _corpus()
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, n_lines int").repartition(5)
    flagged = D.keep_bitmaps(df, ["doc_id", "text", "n_lines"], cfg)
    assert flagged.columns == ["doc_id", "text", "n_lines", "n_dropped", "keep_bitmap"]
    got = [tuple(r) for r in D.kept_text(flagged).collect()]
    assert _ordered([(a, b, c) for a, b, c, _ in got]) == _ordered([w[:3] for w in _lines(docs, cfg)])
    assert sorted(g[3] for g in got) == sorted(w[3] for w in _lines(docs, cfg))


def test_bitmaps_are_small_and_one_common_line_in_small_batches(spark):
    df = spark.createDataFrame([(i, "same line\n" * 400 + f"own {i}") for i in range(300)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")     # a key's rows come in many batches
    try:
        rows = D.keep_bitmaps(df, ["doc_id"], D.LineDedup(chunk_bytes=9000)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == 300 and all((r.n_lines, r.n_dropped) == (401, 400) and len(r.keep_bitmap) < 40 for r in rows)
    for r in rows:
        assert D.unpack_bits(r.keep_bitmap, r.n_lines).nonzero()[0].tolist() == [400]


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a\nb")] * 12 + [(2, "c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_dropped) for r in D.keep_bitmaps(df, ["doc_id"]).collect())
    assert got == [(1, 2)] * 12 + [(2, 0)]
    assert D.kept_text(D.keep_bitmaps(df.where("false"), ["doc_id", "text"])).count() == 0


def test_op13_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in _lines(docs, D.LineDedup())}
    assert {tuple(r) for r in QUERIES["op13_line_dedup"](spark, SF).collect()} == want

"""Jaccard join and decontamination against all pairs in plain Python; the pipeline's stages."""

import itertools
import random
import re

import numpy as np
import pytest

from diurna.llm import decontam, jaccard_join
from diurna.llm.components import connected
from diurna.llm.shingles import shingles
import pyarrow as pa


def _set(text, k=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)])


def _components(rows):
    """Component of every row by all pairs."""
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def _corpus(seed, n=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, out = [], []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 20, 60, 150]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near) if rng.random() < .7 else " ".join(near).upper() + "\n")
        if rng.random() < .4:
            out.append(passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([5, 20, 100]))))
    ids = rng.sample(range(1000), len(out))
    rows = list(zip(ids, out))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "One two"), (2004, "one  TWO"), (2005, "one"), (2006, passage)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, seed):
    rows = _corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int").repartition(3)
    got = jaccard_join.components(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(_components(rows))


def test_dense_group_over_many_blocks(spark):
    # a chain and a dense group, larger than a block: same answer at either block size
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        near = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            near[rng.randrange(200)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(_components(rows))
    for size in (512, 7):
        cfg = jaccard_join.JaccardJoin(block_sets=size)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(df, cfg).collect()) == want


def _links(rows):
    """(links of each row, class pairs) by all pairs; a class is its set."""
    sets = [_set(t) for _, t in rows]
    count, pairs = [0] * len(rows), set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            count[i] += 1
            count[j] += 1
            if sets[i] != sets[j]:
                pairs.add(frozenset((sets[i], sets[j])))
    return count, pairs


def test_every_link_of_a_dense_group_with_copies(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = _corpus(4, 6) + [(None, "alone in the world of all texts")]
    for i in range(60):
        near = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            near[rng.randrange(200)] = f"x{rng.randrange(50)}"
        rows += [(10_000 + 3 * i + c, " ".join(near)) for c in range(rng.choice([1, 1, 3]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cfg = jaccard_join.JaccardJoin(block_sets=25)      # several blocks
    count, pairs = _links(rows)
    assert len(pairs) > 900                        # far more than one link per set
    want = [(d, n, k, c) for (d, n, c), k in zip(_components(rows), count)]
    null_last = lambda r: (r[0] is None, r[0] or 0)
    got = [(r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in jaccard_join.link_counts(df, cfg).collect()]
    assert sorted(got, key=null_last) == sorted(want, key=null_last)
    found, member = jaccard_join.class_pairs(df, cfg)
    text = dict(rows)
    of = {r.key: _set(text[r.doc_id]) for r in member.collect()}
    found = found.collect()
    assert member.count() == sum(bool(_set(t)) for _, t in rows)
    assert len(found) == len(pairs)                # each once
    assert {frozenset((of[r.key_a], of[r.key_b])) for r in found} == pairs
    assert {(r.id_a, r.id_b) for r in found} == {
        tuple(sorted(min(d for d, t in rows if d is not None and _set(t) == s) for s in p)) for p in pairs}


def test_join_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.components(spark.createDataFrame([], schema)).count() == 0
    five = "a b c d e f"
    rows = [(None, five), (7, five), (7, five), (7, "other words stand here now"), (3, "x"), (None, None)]
    got = jaccard_join.components(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, (r.component_id is None, r.component_id or 0)) for r in got) == sorted(
        [((True, 0), 2, (False, 7)), ((False, 7), 2, (False, 7)), ((False, 7), 2, (False, 7)),
         ((False, 7), 1, (False, 7)), ((False, 3), 1, (False, 3)), ((True, 0), 0, (True, 0))])


def test_one_of_each(spark):
    rows = _corpus(3, 15) + [(900_000, "same text in two rows of one id"), (900_000, "same text in two rows of one id")]
    df = spark.createDataFrame([(d, t, {"a": 1}) for d, t in rows], "doc_id long, text string, extra map<string,int>")
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns
    groups = {}
    for (d, t), (_, n, c) in zip(rows, _components(rows)):
        groups.setdefault(c if n else ("empty", d), []).append(d)
    assert sorted(r.doc_id for r in out.collect()) == sorted(min(g) for g in groups.values())


def test_occurrence_search_finds_every_link():
    rng = np.random.default_rng(2)
    for _ in range(20):
        pool = rng.integers(0, 60, (30, 40))
        sets = [np.unique(p[:rng.integers(1, 40)]).astype(np.int64) for p in pool]
        index = jaccard_join.OccurrenceIndex(sets, 75)
        for q in sets:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
            assert index.search(q, np.zeros(len(sets), bool)).tolist() == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (200, 199), (300, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected(df).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[300] == got[200] == 199
    assert connected(df.where("false")).count() == 0


def test_shingles_of_short_texts():
    ptr, s = shingles(pa.array(["a b c d e f", "A  b", "a b", "b a", "", "a b c d e"]))
    assert np.diff(ptr).tolist() == [2, 1, 1, 1, 0, 1]
    assert s[ptr[1]] == s[ptr[2]] != s[ptr[3]] and s[ptr[5]] == s[0]


def test_decontamination_equals_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([5, 6, 9, 16, 17, 20, 33, 57, 64, 65, 130])]
    items += [(90, items[3][1]), (91, None), (92, ""), (93, "w1 w2"), (None, "n u l l i d")]
    docs = []
    for d in range(120):
        body = text(rng.choice([0, 3, 30, 400, 5000]))
        if d % 2:
            own = rng.choice(items[:11])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = "zzz"
            at = rng.randrange(len(body) + 1)
            body = body[:at] + own + body[at:]
        docs.append((d, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "W1\tw2"), (503, "w1 w2 w3"), (504, "n u l l i d")]
    want = set()
    for (d, t), (i, x) in itertools.product(docs, items):
        s = _set(x)
        if s and 100 * len(s & _set(t)) >= 75 * len(s):
            want.add((d, i, len(s), len(s & _set(t))))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for per in (1_000_000, 100):        # one block of items, or several
        out = decontam.with_matches(df, bench, decontam.Containment(shingles_per_block=per), keep=["doc_id", "item_id"])
        assert {(r.doc_id, m.item_id, m.n_item, m.n_shared) for r in out.collect() for m in r.matches} == want
        assert out.count() == len(docs)
    assert all(not r.matches for r in decontam.with_matches(df, bench.where("false")).collect())
    assert decontam.with_matches(df.where("false"), bench).count() == 0

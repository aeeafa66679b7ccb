"""Ranked lexical search over a length-stratified inverted index, exact.

A document's terms are the runs of characters other than ASCII non-alphanumerics, A-Z
lower-cased. With N documents that have terms, L terms of all, n terms of one, its length
normaliser is m = 100 - slope + ((slope * n * N) div L), a term of frequency tf gives it the impact
(10^9 * tf) div (1000 * tf + 8 * m), and a query term has the weight
floor(1000 * ln((2N + 2) / (2 df + 1))). The score is the sum over the query's terms, repeats included.

*Index* (``build``): a first pass counts documents and terms by length. Documents of like length are
brought together in parts of like numbers of terms, sorted by m, so that those of equal m stand
together as a stratum; a part is cut into blocks of bounded text, a stratum of many documents
lies in several blocks. For each block and term the postings stand by stratum, then by tf, highest first. In a stratum an impact depends on tf alone, so it is
computed once per tf, not per document, and the highest tf bounds what the term can give there.
The index is one table, bucketed by block. Every document is in it, none is sampled.

*Search* (``search``): the postings of the queries' terms are read, block by block. For each query
the bounds of the block's strata order the visits; they end when the next bound is lower than the
score of the k-th document found. Blocks' results are merged by rank.

Defined results: null or empty texts have no terms and are never found; a document's row that
is repeated is ranked each time; equal scores stand by ascending doc_id, null last; every row of
the query table is a query of its own, and rows of one item_id share its ranks' column; queries
without a term of the index find nothing; an empty table gives an empty result. Terms are compared
by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diurna.session import checkpoint_dir

from .common import release, text_slices, words_of, written

# Bytes of terms lower-cased, all others to a space; bytes of non-ASCII characters are kept.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                    for b in range(256))
LENGTHS = 16         # buckets of lengths for each doubling
_ROWS = 20_000       # of an Arrow batch of postings
_IS_TERM = np.array([b != 32 for b in _TERM_BYTES])


@dataclass(frozen=True)
class LexicalSearch:
    k: int = 10
    slope: int = 75                     # percent of the normaliser that grows with length
    part_terms: int = 200_000         # of the parts that documents of like length are brought to
    block_bytes: int = 4_000_000        # of a block's texts, or one longer text
    terms_per_round: int = 200_000      # bound of the queries' terms held at once


@dataclass
class Index:
    table: str                          # its name in the session's catalogue
    documents: int                      # N
    terms: int                          # L


def term_text(text: pa.Array) -> pa.Array:
    """The texts' terms, parted by spaces."""
    text = text.cast(pa.string())
    _, offsets, data = text.buffers()
    body = pa.py_buffer(data.to_pybytes().translate(_TERM_BYTES) if data is not None else b"")
    return pa.StringArray.from_buffers(len(text), offsets, body, None, 0, text.offset)


def count_terms(text: pa.Array) -> np.ndarray:
    """Number of terms of each text."""
    text = text.cast(pa.string())
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    if data is None or at[0] == at[-1]:
        return np.zeros(len(text), np.int64)
    inside = _IS_TERM[np.frombuffer(data, np.uint8)[at[0]:at[-1]]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = (at[:-1] - at[0])[np.diff(at) > 0]
    begins[first] = inside[first]           # a text begins anew
    upto = np.concatenate([[0], np.cumsum(begins)])
    return np.diff(upto[at - at[0]])


def term_counts(text: pa.Array):
    """(owner, term number, times) of each text's distinct terms, and the hashes of the terms."""
    owner, words = words_of(term_text(text))
    if not len(owner):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    coded = words.dictionary_encode()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()),
                         np.uint64, len(coded.dictionary)).view(np.int64)
    wide = len(hashed)
    key, times = np.unique(owner.astype(np.int64) * wide + coded.indices.to_numpy(), return_counts=True)
    return key // wide, key % wide, times, hashed


# ---- index --------------------------------------------------------------------------

def lengths(docs: DataFrame) -> list:
    """(bucket of lengths, documents, terms) of the documents with terms; at most LENGTHS rows for each doubling."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, text in text_slices(batch):
                n = count_terms(text)
                n = n[n > 0]
                bucket, of = np.unique(_bucket(n), return_inverse=True)
                sums = np.zeros(len(bucket), np.int64)
                np.add.at(sums, of, n)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.bincount(of, minlength=len(bucket))),
                                                  pa.array(sums)], names=["bucket", "d", "t"])
    got = docs.select("text").mapInArrow(run, "bucket bigint, d bigint, t bigint").groupBy("bucket").agg(F.sum("d"), F.sum("t"))
    return sorted(map(tuple, got.collect()))


def _bucket(n: np.ndarray) -> np.ndarray:
    """Lengths in buckets of nearly equal ones."""
    return np.floor(np.log2(np.maximum(n, 1)) * LENGTHS).astype(np.int64)


def _block_rows(block: int, m: np.ndarray, ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """One row with the block's document ids, then a row for each term.

    A row has a run for each stratum and term frequency, strata ascending and frequencies falling: ``ms``, ``tfs``,
    and in ``ends`` where the run's documents end in ``docs``, numbers of documents in the block."""
    owner, number, times, hashed = term_counts(text)
    order = np.lexsort((owner, -times, m[owner], number))
    owner, number, times = owner[order], number[order], times[order]
    stratum = m[owner]
    row = np.ones(len(owner), bool)
    row[1:] = number[1:] != number[:-1]
    run = row.copy()
    run[1:] |= (times[1:] != times[:-1]) | (stratum[1:] != stratum[:-1])
    first, runs = np.flatnonzero(row), np.flatnonzero(run)
    ptr = np.append(first, len(owner)).astype(np.int32)
    run_ptr = np.searchsorted(runs, ptr).astype(np.int32)
    ends = np.append(runs[1:], len(owner)) - np.repeat(first, np.diff(run_ptr))
    n = len(first)
    lists = lambda p, v: pa.concat_arrays([
        pa.nulls(1, pa.list_(pa.from_numpy_dtype(v.dtype))), pa.ListArray.from_arrays(pa.array(p), pa.array(v))])
    whole = pa.ListArray.from_arrays(pa.array(np.array([0, len(ids)], np.int32)), ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n + 1, block, np.int64)),
         pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(hashed[number[first]])]),
         lists(run_ptr, stratum[runs]), lists(run_ptr, times[runs].astype(np.int32)), lists(run_ptr, ends.astype(np.int32)),
         lists(ptr, owner.astype(np.int32)), pa.concat_arrays([whole, pa.nulls(n, whole.type)])],
        names=["block", "term", "ms", "tfs", "ends", "docs", "ids"])


POSTINGS = ("block bigint, term bigint, ms array<bigint>, tfs array<int>, ends array<int>, docs array<int>, "
            "ids array<bigint>")


def build(docs: DataFrame, cfg: LexicalSearch = LexicalSearch()) -> Index:
    """The index of all documents, written to a table in the shared folder."""
    spark = docs.sparkSession
    found = lengths(docs)
    documents, terms = sum(d for _, d, _ in found), sum(t for _, _, t in found)
    # parts of like numbers of terms: several buckets of lengths, or one bucket in several parts by hash
    part_of, at, full = {}, 0, 0
    for bucket, _, t in found:
        if full and full + t > cfg.part_terms:
            at, full = at + 1, 0
        many = max(-(-t // cfg.part_terms), 1)
        part_of[bucket] = (at, many)
        at, full = (at + many, 0) if many > 1 else (at, full + t)
    shared = spark.sparkContext.broadcast(part_of)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_slices(batch):
                n = count_terms(text)
                start, many = (np.array([shared.value.get(b, (0, 1))[i] for b in _bucket(n).tolist()], np.int64) for i in (0, 1))
                m = 100 - cfg.slope + (cfg.slope * n * documents) // max(terms, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), text, part.column(2), pa.array(m), pa.array(start),
                                                  pa.array(many)], names=["doc_id", "text", "h", "m", "part", "many"]
                                                 ).filter(pa.array(n > 0))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("h")) \
        .mapInArrow(sized, "doc_id bigint, text string, h bigint, m bigint, part bigint, many bigint") \
        .select("doc_id", "text", "m", (F.col("part") + F.pmod("h", "many")).alias("part"), "h")
    placed = placed.repartition("part").sortWithinPartitions("part", "m", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            ids, m = (pa.concat_arrays([h[0].column(i) for h in held]) for i in (0, 2))
            rows = _block_rows(block, m.to_numpy(), ids, pa.concat_arrays([h[1] for h in held]))
            held.clear()
            for a in range(0, rows.num_rows, _ROWS):
                yield rows.slice(a, _ROWS)
            del rows
            release()
        for batch in batches:
            for part, text in text_slices(batch):
                if held and size + text.nbytes > cfg.block_bytes:
                    yield from flush()
                    block, size = block + 1, 0
                held.append((part, text))
                size += text.nbytes
        if held:
            yield from flush()
    table = f"lexical_index_{uuid.uuid4().hex}"
    (placed.mapInArrow(run, POSTINGS).write
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
     .option("path", f"{checkpoint_dir(spark).rstrip('/')}/{table}").saveAsTable(table))
    return Index(table, documents, terms)


# ---- search -------------------------------------------------------------------------

def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Block:
    """The postings of one block that queries ask for."""

    def __init__(self, rows: pa.Table):
        known = rows.filter(pc.is_null(rows.column("term"))).column("ids")
        self.ids = pc.list_flatten(known.combine_chunks()) if len(known) else pa.array([], pa.int64())
        rows = rows.filter(pc.is_valid(rows.column("term"))).sort_by("term").combine_chunks()
        get = lambda c: pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64)
        size = lambda c: pc.list_value_length(rows.column(c)).to_numpy().astype(np.int64)
        m, tfs, ends, self.docs = get("ms"), get("tfs"), get("ends"), get("docs")
        runs, row_at = size("tfs"), np.cumsum(size("docs")) - size("docs")
        of = np.repeat(np.arange(len(runs)), runs)                      # the row of each run
        new = np.ones(len(of), bool)
        new[1:] = of[1:] != of[:-1]
        length = ends - np.where(new, 0, np.append(0, ends[:-1]))
        # once per stratum, term and tf
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)
        self.each = np.repeat(impact, length)                           # by posting
        # a term's postings in one stratum; the first of its runs has the highest tf, and so the highest impact
        new[1:] |= m[1:] != m[:-1]
        seg = np.flatnonzero(new)
        self.term, self.most = rows.column("term").to_numpy()[of[seg]], impact[seg]
        self.m, self.stratum = np.unique(m[seg], return_inverse=True)
        self.start = (row_at[of] + ends - length)[seg]
        self.size = np.add.reduceat(length, seg) if len(seg) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int):
        """(documents' numbers, scores) of the block's k best for a query's distinct terms, and their
        weights times their repeats."""
        lo, hi = np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")
        rows = np.concatenate([np.arange(a, z) for a, z in zip(lo, hi)]) if len(terms) else np.zeros(0, np.int64)
        w = np.repeat(weights, hi - lo)
        bound = np.zeros(len(self.m), np.int64)
        np.add.at(bound, self.stratum[rows], w * self.most[rows])
        by = np.argsort(self.stratum[rows], kind="stable")
        rows, w = rows[by], w[by]
        cut = np.searchsorted(self.stratum[rows], np.arange(len(self.m) + 1))
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in np.argsort(-bound, kind="stable"):
            # an equal score may still win by its id
            if bound[s] <= 0 or (len(score) == k and bound[s] < score[-1]):
                break
            own, wo = rows[cut[s]:cut[s + 1]], w[cut[s]:cut[s + 1]]
            n = self.size[own]
            at = np.repeat(self.start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            doc, of = np.unique(self.docs[at], return_inverse=True)
            got = np.zeros(len(doc), np.int64)
            np.add.at(got, of, self.each[at] * np.repeat(wo, n))
            if len(score) == k:
                doc, got = doc[got >= score[-1]], got[got >= score[-1]]
            best, score = self.top(np.append(best, doc), np.append(score, got), k)
        return best[score > 0], score[score > 0]

    def top(self, doc: np.ndarray, score: np.ndarray, k: int):
        ids = self.ids.take(pa.array(doc))
        last = pc.is_null(ids).to_numpy(zero_copy_only=False)
        order = np.lexsort((pc.fill_null(ids, 0).to_numpy(), last, -score))[:k]
        return doc[order], score[order]


def _query_terms(queries: DataFrame) -> DataFrame:
    """(q, term, times): the distinct terms of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_slices(batch):
                owner, number, times, hashed = term_counts(text)
                q = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(q[owner]), pa.array(hashed[number]), pa.array(times)],
                                                 names=["q", "term", "times"])
    return queries.select("q", "text").mapInArrow(run, "q bigint, term bigint, times bigint")


def _visit(plan, k: int):
    """Function from a block's postings to its best documents for each query of the broadcast ``plan``."""
    def run(rows: pa.Table) -> pa.Table:
        block, q, ids, scores = Block(rows), [np.zeros(0, np.int64)], [pa.array([], pa.int64())], [np.zeros(0, np.int64)]
        for number, t, w in plan.value:
            doc, score = block.search(t, w, k)
            q.append(np.full(len(doc), number))
            ids.append(block.ids.take(pa.array(doc)))
            scores.append(score)
        return pa.table({"q": np.concatenate(q), "doc_id": pa.concat_arrays(ids), "score": np.concatenate(scores)})
    return run


def search(index: Index, queries: DataFrame, cfg: LexicalSearch = LexicalSearch(), text: str = "text",
           name: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query.

    Queries are taken in rounds of at most about ``terms_per_round`` terms, which bounds what is
    broadcast; each round reads the postings of its terms once."""
    spark = queries.sparkSession
    # written with their numbers, so that every use sees the same ones
    asked = written(queries.select(F.monotonically_increasing_id().alias("q"), F.col(name).alias("item_id"),
                                   F.col(text).alias("text")), "lexical-queries")
    terms = written(_query_terms(asked), "lexical-terms")
    many = terms.count()
    rounds = max(-(-many // cfg.terms_per_round), 1)
    table = spark.table(index.table)
    found = None
    for r in range(rounds):
        own = terms.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r)
        wanted = F.broadcast(own.select("term").distinct())
        postings = table.where("term is not null").join(wanted, "term", "left_semi")
        df = {x.term: x.df for x in postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()}
        asking: dict = {}
        for x in own.collect():
            if x.term in df and (w := weight(index.documents, df[x.term])):
                asking.setdefault(x.q, []).append((x.term, w * x.times))
        plan = spark.sparkContext.broadcast([(q, *(np.array(c, np.int64) for c in zip(*sorted(t))))
                                             for q, t in asking.items()])

        # a broadcast outer join keeps the buckets, so the postings are not shuffled
        rows = table.join(F.broadcast(own.select("term").distinct().withColumn("asked", F.lit(True))), "term", "left")
        got = rows.where("term is null or asked").drop("asked").groupBy("block").applyInArrow(_visit(plan, cfg.k), "q bigint, doc_id bigint, score bigint")
        found = got if found is None else found.unionByName(got)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= cfg.k)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"),
                                                               "doc_id", "score")

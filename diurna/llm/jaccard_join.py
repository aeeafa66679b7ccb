"""N-gram Jaccard join: all links between texts of like shingle sets, by T-occurrence search.

Exact for any input; nothing is dropped, capped or sampled. Texts of one shingle set are
one class, and only classes are joined. Steps:

1. *Shared shingles.* Two sets of similarity 0.75 or more share a known number of the
   smallest hashes of each. These are counted in packed form: every chunk of documents
   sends each of its hashes once to the hash's bucket, however many documents have it, and
   is told which of them other chunks have too. Classes with too few shared hashes can have
   no link and are done; only the rest is read again as whole sets.
2. *Short lists.* Over the remaining sets, each orders its shingles by how many sets have
   them. The first n - T + 1 of a set (T: the least overlap of any link) are its short
   lists; a link must show in at least one of them.
3. *Families.* Connecting every set with the first set of each of its short lists, by
   distributed component search, gives families that no link leaves.
4. *T-occurrence search* (DivideSkip) inside families: families are packed into blocks of
   bounded size, and a large family into several, searched block against block. A
   query merges its short lists and counts, keeps sets with the count that the long lists
   can still lift to T, and probes the long lists by binary search, or counts them too where
   that is less work, as in a dense group. Every link is found. ``class_pairs`` returns each;
   elsewhere a task returns one row per linked set: how many documents it links with, each
   class by its size so that copies are never expanded, and a set that it is connected with.
5. *Components* over the connections, joined back to classes and documents.

The join's own output is ``class_pairs`` with ``membership``: the links between classes, and the
class of each document. ``link_counts`` has each document's number of links, copies included.

Defined results: a null text or one without words has no shingles and is linked with
nothing; fewer than five words are one shingle; repeated rows are copies (each links with the
others); a null doc_id
never names a component that has another id; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_slices, with_fields, written
from .components import connected
from .shingles import shingle_sets
from .wordtable import BUCKETS_PER_PARTITION, Packer


@dataclass(frozen=True)
class JaccardJoin:
    k: int = 5
    percent: int = 75
    evidence_percent: int = 15   # of a set, compared beyond what one certain shared hash needs
    chunk_bytes: int = 8_000_000  # of texts whose hashes are sent together
    block_sets: int = 512        # sets of a block, at most
    block_bytes: int = 4_000_000  # of its shingles, or one larger set


def least_overlap(n, percent: int):
    """The least number of its n shingles that a set shares with any set it links with."""
    return -(-n * percent // 100)


def evidence(n, cfg: JaccardJoin):
    """How many of the shared shingles step 1 looks for in a set of n."""
    return n * cfg.evidence_percent // 100 + 1


def set_key(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(np.ascontiguousarray(s, "<u8").tobytes())


# ---- step 1 -------------------------------------------------------------------------

_MANY = np.uint32(0xFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _send(docs: DataFrame, cfg: JaccardJoin) -> DataFrame:
    """Rows per document (doc_id, chunk, at, n, key, shared) and per bucket (chunk, bucket, hashes, owners)."""
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(chunk: int, ids: list, sets: list, packer: Packer) -> pa.RecordBatch:
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        keys = [set_key(s) if len(s) else None for s in sets]
        first = {k: i for i, k in reversed(list(enumerate(keys))) if k}     # copies send once
        send = sorted(first.values())
        take = n - least_overlap(n, cfg.percent) + evidence(n, cfg)
        r = np.concatenate([sets[i][:take[i]] for i in send]) * _SPREAD if send else np.zeros(0, np.uint64)
        owner = np.repeat(np.array(send, np.uint32), take[send]) if send else np.zeros(0, np.uint32)
        order = np.argsort(r, kind="stable")
        r, owner = r[order], owner[order]
        new = np.ones(len(r), bool)
        new[1:] = r[1:] != r[:-1]
        times = np.diff(np.append(np.flatnonzero(new), len(r)))
        shared = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sets))
        r, owner = r[new], np.where(times > 1, _MANY, owner[new])
        bucket = ((r >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        found, start = np.unique(bucket, return_index=True)
        runs = list(zip(start, np.append(start[1:], len(r))))
        d, b = len(sets), len(found)
        pad = lambda made, after: [*made, *[None] * after]
        return pa.RecordBatch.from_arrays([
            pa.array(pad(ids, b), pa.int64()), pa.array([chunk] * (d + b), pa.int64()),
            pa.array(pad(range(d), b), pa.int32()), pa.array(pad(n.tolist(), b), pa.int64()),
            pa.array(pad(keys, b), pa.string()), pa.array(pad(shared.tolist(), b), pa.int64()),
            pa.array([None] * d + found.astype(int).tolist(), pa.int32()),
            pa.array([None] * d + [packer.ascending(r[a:z]) for a, z in runs], pa.binary()),
            pa.array([None] * d + [packer.ints(owner[a:z]) for a, z in runs], pa.binary()),
        ], names=["doc_id", "chunk", "at", "n", "key", "shared", "bucket", "hashes", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, chunk = Packer(), TaskContext.get().partitionId() << 32
        ids, sets, size = [], [], 0
        for batch in batches:
            for part, text in text_slices(batch):
                if sets and size + text.nbytes > cfg.chunk_bytes:
                    yield rows(chunk, ids, sets, packer)
                    ids, sets, size, chunk = [], [], 0, chunk + 1
                    release()
                ptr, flat = shingle_sets(text, cfg.k)
                sets += [flat[a:z] for a, z in zip(ptr[:-1], ptr[1:])]
                ids += part.column(0).to_pylist()
                size += text.nbytes
        if sets:
            yield rows(chunk, ids, sets, packer)
    schema = ("doc_id bigint, chunk bigint, at int, n bigint, key string, shared bigint, "
              "bucket int, hashes binary, owners binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _answer(sent: DataFrame) -> DataFrame:
    """(chunk, owners): the documents whose hashes other chunks have too, once per hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, bucket = Packer(), [], None

        def flush():
            chunk, hashes, owners = zip(*held)
            r = np.concatenate(hashes)
            who = np.concatenate(owners)
            of = np.repeat(np.arange(len(held)), [len(h) for h in hashes])
            order = np.argsort(r, kind="stable")
            same = r[order][1:] == r[order][:-1]
            twice = np.zeros(len(r), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            # a hash that one chunk has many times was counted there; others are told here
            hit = twice & (who != _MANY)
            parts = [(chunk[i], who[hit & (of == i)]) for i in np.unique(of[hit])]
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in parts], pa.int64()),
                 pa.array([packer.ints(w) for _, w in parts], pa.binary())], names=["chunk", "owners"])
        for batch in batches:
            for c, b, h, o in zip(*(x.to_pylist() for x in batch.columns)):
                if b != bucket and held:
                    yield flush()
                    held = []
                bucket = b
                held.append((c, packer.unascending(h), packer.unints(o)))
        if held:
            yield flush()
    rows = sent.where("bucket is not null").select("chunk", "bucket", "hashes", "owners")
    return (rows.repartition("bucket").sortWithinPartitions("bucket", "chunk")
            .mapInArrow(run, "chunk bigint, owners binary"))


def keyed(docs: DataFrame, cfg: JaccardJoin) -> DataFrame:
    """(doc_id, n, key, open): a document's set size and key, and whether it can have links."""
    sent = written(_send(docs, cfg), "jaccard-sent")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packer, at = Packer(), left.column("at").to_numpy()
        told = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
        for b in right.column("owners").to_pylist():
            told += np.bincount(packer.unints(b), minlength=len(told))
        n = left.column("n").to_numpy()
        shared = left.column("shared").to_numpy() + told[at]
        # a partner may be as small as T, and looks for less then
        enough = (n > 0) & (shared >= evidence(least_overlap(n, cfg.percent), cfg))
        return pa.Table.from_arrays([left.column("doc_id"), left.column("n"), left.column("key"),
                                     pa.array(enough)], names=["doc_id", "n", "key", "open"])
    rows = sent.where("bucket is null").select("doc_id", "chunk", "at", "n", "key", "shared")
    out = rows.groupBy("chunk").cogroup(_answer(sent).groupBy("chunk")).applyInArrow(
        run, "doc_id bigint, n bigint, key string, open boolean")
    return written(out, "jaccard-keyed")


def open_sets(docs: DataFrame, classes: DataFrame, cfg: JaccardJoin) -> DataFrame:
    """(node, key, size, n, shingles) of the classes that can have links, each read from one document."""
    wanted = classes.where("open").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "size")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_d"))).select("_k", "size", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_slices(batch):
                ptr, flat = shingle_sets(text, cfg.k)
                sets = [flat[a:z] for a, z in zip(ptr[:-1], ptr[1:])]
                # an id may stand before several texts; each class wants its own
                good = [(k, z, s.view(np.int64)) for k, z, s in
                        zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets) if set_key(s) == k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in good], pa.string()), pa.array([g[1] for g in good], pa.int64()),
                     pa.array([len(g[2]) for g in good], pa.int64()),
                     pa.array([g[2] for g in good], pa.list_(pa.int64()))], names=["key", "size", "n", "shingles"])
    sets = written(rows.mapInArrow(run, "key string, size bigint, n bigint, shingles array<bigint>")
                   .withColumn("node", F.monotonically_increasing_id()), "jaccard-sets")
    # only repeated rows (one id, one text) bring a class twice; the sets move for them alone
    if not sets.groupBy("key").count().where("count > 1").isEmpty():
        sets = written(sets.dropDuplicates(["key"]), "jaccard-sets")
    return sets


# ---- steps 2 and 3 --------------------------------------------------------------------

def short_lists(sets: DataFrame, cfg: JaccardJoin) -> DataFrame:
    """(node, h): the short lists that each set stands in."""
    post = sets.select("node", F.explode("shingles").alias("h"))
    often = post.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = post.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("l"))
    least = F.ceil(F.col("n") * cfg.percent / 100)
    # shingles that no other set has stand first, in lists of their own
    many = F.col("n") - least + 1 - (F.col("n") - F.size("l"))
    return (mine.join(sets.select("node", "n"), "node").withColumn("many", many.cast("int")).where("many > 0")
            .select("node", F.explode(F.slice("l", F.lit(1), F.col("many"))).alias("x")).select("node", "x.h"))


def families(lists: DataFrame) -> DataFrame:
    """(node, family) over all sets that share a short list with another."""
    lists = written(lists, "jaccard-lists")
    lead = lists.groupBy("h").agg(F.min("node").alias("lead"))
    edges = lists.join(lead, "h").where("node <> lead").select(
        F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    return connected(edges).withColumnRenamed("component", "family")


# ---- step 4 ---------------------------------------------------------------------------

def blocks(sets: DataFrame, family: DataFrame, cfg: JaccardJoin) -> DataFrame:
    """Sets with family and block; families stand together, a block is bounded."""
    joined = sets.select("node", "n", "shingles", "size").join(family, "node")
    ordered = joined.repartitionByRange("family", "n", "node").sortWithinPartitions("family", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, many, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for n in batch.column(1).to_pylist():
                if many and (many == cfg.block_sets or size + 8 * n > cfg.block_bytes):
                    block, many, size = block + 1, 0, 0
                many, size = many + 1, size + 8 * n
                out.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())],
                                             names=["node", "n", "shingles", "size", "family", "block"])
    return written(ordered.select("node", "n", "shingles", "size", "family").mapInArrow(
        run, "node bigint, n bigint, shingles array<bigint>, size bigint, family bigint, block bigint"),
        "jaccard-blocks")


def block_pairs(blocked: DataFrame) -> DataFrame:
    """(pair, block): each block by itself, and pairs of blocks with a family in common."""
    where = blocked.select("family", "block").distinct()
    a, b = where.toDF("family", "a"), where.toDF("family", "b")
    pairs = a.join(b, "family").where("a <= b").select("a", "b").distinct()
    return pairs.select(F.concat_ws("-", "a", "b").alias("pair"),
                        F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))


PROBE_COST = 8   # a binary search in entries counted


class OccurrenceIndex:
    """Inverted lists of one block and the DivideSkip search in them."""

    def __init__(self, sets: list, percent: int):
        self.percent = percent
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        order = np.argsort(flat, kind="stable")       # owners ascend within each list
        self.owner = owner[order]
        self.keys, self.start, self.length = np.unique(flat[order], return_index=True, return_counts=True)
        # all lists as one ascending array, for binary probing
        self.cells = np.repeat(np.arange(len(self.keys)), self.length) * np.int64(len(sets)) + self.owner

    def lists(self, query: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == query]
        return at[np.argsort(self.length[at], kind="stable")]     # short ones first

    def search(self, query: np.ndarray, skip: np.ndarray):
        """Sets not in ``skip`` (a mask) that link with ``query``."""
        n = len(query)
        least = least_overlap(n, self.percent)
        lists = self.lists(query)
        if len(lists) < least:
            return np.zeros(0, np.int64)
        # DivideSkip: the longer the longest list, the fewer lists are left for probing
        longest = max(int(self.length[lists[-1]]), 1)
        long = min(int(least / (0.0085 * np.log2(longest) + 1)), least - 1, len(lists))
        short, probe = lists[:len(lists) - long], lists[len(lists) - long:]
        count = self.merge(short)
        fits = (100 * np.minimum(n, self.size) >= self.percent * np.maximum(n, self.size))
        found = np.flatnonzero((count >= least - long) & fits & ~skip & (count > 0))
        if not len(found):
            return found
        # many candidates (a dense group): counting the long lists too is less work than probing them
        dense = PROBE_COST * len(found) * len(probe) > self.length[probe].sum()
        both = count[found] + (self.merge(probe)[found] if dense else self.probe(probe, found))
        return found[100 * both >= self.percent * (n + self.size[found] - both)]

    def merge(self, lists: np.ndarray) -> np.ndarray:
        """How many of ``lists`` hold each set, by counting over all their entries."""
        took = self.length[lists]
        ends = np.cumsum(took)
        total = int(ends[-1]) if len(ends) else 0
        merged = self.owner[np.repeat(self.start[lists] - (ends - took), took) + np.arange(total)]
        return np.bincount(merged, minlength=len(self.size))

    def probe(self, lists: np.ndarray, found: np.ndarray) -> np.ndarray:
        """How many of ``lists`` hold each set of ``found``, by binary search."""
        want = (lists[:, None] * np.int64(len(self.size)) + found).ravel()
        at = np.minimum(np.searchsorted(self.cells, want), len(self.cells) - 1)
        return (self.cells[at] == want).reshape(len(lists), len(found)).sum(axis=0)


def search_pair(block: np.ndarray, sets: list, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """All links between the sets of one block, or of one block with those of another, each once:
    (a set, the sets that it links with), by position."""
    which = np.unique(block)
    inner, outer = np.flatnonzero(block == which[0]), np.flatnonzero(block == which[-1])
    index = OccurrenceIndex([sets[i] for i in inner], percent)
    for q in outer:
        # within one block a link shows from its later set
        found = inner[index.search(sets[q], inner >= q if len(which) == 1 else np.zeros(len(inner), bool))]
        if len(found):
            yield int(q), found


def _searched(blocked: DataFrame, cfg: JaccardJoin, result, schema: str) -> DataFrame:
    """``result(node, size, links of search_pair)`` of every block and pair of blocks."""
    def run(rows: pa.Table) -> pa.Table:
        flat = rows.column("shingles").combine_chunks()
        ptr, body = flat.offsets.to_numpy(), flat.values.to_numpy()
        sets = [body[a:z] for a, z in zip(ptr[:-1], ptr[1:])]
        return result(rows.column("node").to_numpy(), rows.column("size").to_numpy(),
                      search_pair(rows.column("block").to_numpy(), sets, cfg.percent))
    tasks = block_pairs(blocked).join(blocked.select("block", "node", "size", "shingles"), "block")
    return tasks.groupBy("pair").applyInArrow(run, schema)


def links(blocked: DataFrame, cfg: JaccardJoin) -> DataFrame:
    """(a, b): every link, once."""
    def result(node, size, found) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, ys in found:
            a.append(np.full(len(ys), node[q]))
            b.append(node[ys])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})
    return _searched(blocked, cfg, result, "a bigint, b bigint")


def linked(blocked: DataFrame, cfg: JaccardJoin) -> DataFrame:
    """(node, lead, n_links) over all links, a row per task and linked set: a set that it is connected
    with, and the number of documents that it links with there."""
    def result(node, size, found) -> pa.Table:
        group, count = np.arange(len(node)), np.zeros(len(node), np.int64)
        for q, ys in found:
            count[q] += size[ys].sum()
            count[ys] += size[q]
            other = group[ys] != group[q]
            if other.any():
                group[np.isin(group, group[ys[other]])] = group[q]
        at = np.flatnonzero(count)
        return pa.table({"node": pa.array(node[at]), "lead": pa.array(node[group[at]]), "n_links": pa.array(count[at])})
    return _searched(blocked, cfg, result, "node bigint, lead bigint, n_links bigint")


# ---- the whole ------------------------------------------------------------------------

def _blocked(docs: DataFrame, cfg: JaccardJoin) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, classes, open sets, blocks): steps 1 to 3."""
    rows = keyed(docs, cfg)
    classes = written(rows.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.max("open").alias("open"), F.count(F.lit(1)).alias("size")),
        "jaccard-classes")
    sets = open_sets(docs, classes, cfg)
    return rows, classes, sets, blocks(sets, families(short_lists(sets, cfg)), cfg)


def class_components(docs: DataFrame, cfg: JaccardJoin = JaccardJoin()) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, n, key), classes (key, class_id, component_id, first, n_links)); the key of an
    empty text is null; ``class_id`` is the smallest document id of the class; ``first`` marks the class
    of each component that has its smallest id; ``n_links`` counts the links of each document of a class."""
    rows, classes, sets, blocked = _blocked(docs, cfg)
    found = written(linked(blocked, cfg), "jaccard-linked")
    group = connected(found.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    count = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    member = (group.join(count, "node").join(sets.select("node", "key"), "node")
              .join(classes.select("key", "doc_id"), "key"))
    # of each component, the smallest document id and the class that has it (null ids last)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    named = member.groupBy("component").agg(F.min("doc_id").alias("smallest"), first.alias("f"))
    joined = member.join(named, "component").select(
        "key", "smallest", "n_links", (F.col("key") == F.col("f.key")).alias("first"))
    out = classes.join(joined, "key", "left").select(
        "key", F.col("doc_id").alias("class_id"), F.coalesce("smallest", "doc_id").alias("component_id"),
        F.coalesce("first", F.lit(True)).alias("first"),
        (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return rows.select("doc_id", "n", "key"), written(out, "jaccard-components")


def class_pairs(docs: DataFrame, cfg: JaccardJoin = JaccardJoin()) -> tuple[DataFrame, DataFrame]:
    """(pairs (key_a, key_b, id_a, id_b), membership (doc_id, key)): every link between two classes, once,
    with the smallest document id of each; and the class of every document. Documents of one class all
    link with each other and with every document of a paired class."""
    rows, classes, sets, blocked = _blocked(docs, cfg)
    named = written(sets.select("node", "key").join(classes.select("key", "doc_id"), "key"), "jaccard-named")
    side = lambda c: named.select(F.col("node").alias(c), F.col("key").alias(f"key_{c}"),
                                  F.col("doc_id").alias(f"id_{c}"))
    pairs = links(blocked, cfg).join(side("a"), "a").join(side("b"), "b")
    # named in order of the ids, null ids first
    a, b = F.struct("id_a", "key_a"), F.struct("id_b", "key_b")
    lo, hi = F.when(a <= b, a).otherwise(F.struct(F.col("id_b").alias("id_a"), F.col("key_b").alias("key_a"))), \
        F.when(a <= b, b).otherwise(F.struct(F.col("id_a").alias("id_b"), F.col("key_a").alias("key_b")))
    pairs = pairs.select(lo.alias("lo"), hi.alias("hi")).select("lo.key_a", "hi.key_b", "lo.id_a", "hi.id_b")
    return pairs, rows.where("key is not null").select("doc_id", "key")


def components(docs: DataFrame, cfg: JaccardJoin = JaccardJoin()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return link_counts(docs, cfg).select("doc_id", "n_shingles", "component_id")


def link_counts(docs: DataFrame, cfg: JaccardJoin = JaccardJoin()) -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links, component_id) of every document; a text without
    words is a class of its own."""
    rows, classes = class_components(docs, cfg)
    own = lambda c: F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return rows.join(classes, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), own("component_id"))


def one_of_each(docs: DataFrame, cfg: JaccardJoin = JaccardJoin()) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one with the smallest id.

    Copies are reduced in each task before the shuffle, so a text that a third of the
    rows have sends one row per task. Texts without words all stay.
    """
    _, classes = class_components(docs, cfg)
    cols = docs.columns
    schema = with_fields(docs, cols, "__key string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_slices(batch):
                ptr, flat = shingle_sets(text, cfg.k)
                keys = [set_key(flat[a:z]) if z > a else None for a, z in zip(ptr[:-1], ptr[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.string())], names=[*cols, "__key"])
    # a text without words is a class of its own
    own = F.coalesce("__key", F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("text"))
    one = docs.mapInArrow(run, schema).withColumn("__key", own).groupBy("__key").agg(
        F.min_by(F.struct(*cols), first).alias("row"))
    gone = classes.where("not first").select(F.col("key").alias("__key"))
    return one.join(gone, "__key", "left_anti").select("row.*")

"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are searched inside documents of any length. Items are partitioned by
their number of shingles, sizes (u/2, u] together. For each partition a document's
shingles are cut into blocks of u/2; three neighbouring blocks make a window, so any run of
u shingles lies whole in one window and an item and its window are of like size whatever
the document's length. A window is a candidate for an item when one of ``permutations``
min-hashes agrees (with containment 0.75 the similarity is above 0.23, so a miss has
probability under 1e-7). Candidates are verified by exact containment: the share of the
item's shingles in the whole document's set.

A window's min-hash can only agree with an item's if that shingle belongs to the item, so
windows without any shingle of the partition's items are not hashed at all.

Rows are judged where they are read: no shuffle, and a passage in a third of all rows
costs each row its own work only. Items are hash-split into blocks of about
``shingles_per_block`` shingles, each broadcast in turn against all documents, so the memory of
a task stays bounded however many items there are.

Defined results: null and empty texts or items match nothing; a text of fewer than five
words is one shingle; repeated items and rows match each; empty tables match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, with_fields, without
from .shingles import shingle_sets, shingles

MATCHES = "array<struct<item_id:bigint,n_item:int,n_shared:int>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int32()), ("n_shared", pa.int32())]))


@dataclass(frozen=True)
class Containment:
    k: int = 5
    percent: int = 75
    permutations: int = 64
    shingles_per_block: int = 1_000_000


def permutations(many: int):
    """(xor, odd multiplier) of each permutation of the 64-bit hashes."""
    rng = np.random.default_rng(5)
    draw = lambda: rng.integers(0, 1 << 64, many, dtype=np.uint64)
    return draw(), draw() | np.uint64(1)


class ItemIndex:
    """The items of one block: sets, and signatures by size partition."""

    def __init__(self, ids: list, texts: list, cfg: Containment):
        self.cfg = cfg
        self.xor, self.odd = permutations(cfg.permutations)
        ptr, flat = shingle_sets(pa.array(texts, pa.string()), cfg.k)
        full = [i for i in range(len(ids)) if ptr[i + 1] > ptr[i]]
        self.ids = np.array([ids[i] for i in full], object)
        self.sets = [flat[ptr[i]:ptr[i + 1]] for i in full]
        self.parts = []
        size = np.array([len(s) for s in self.sets], np.int64)
        upper = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        for u in np.unique(upper):
            of = np.flatnonzero(upper == u)
            sign = np.stack([self.signature(self.sets[i][None, :])[0] for i in of])
            order = np.argsort(sign, axis=0, kind="stable")
            self.parts.append((int(u), np.unique(np.concatenate([self.sets[i] for i in of])),
                               of[order], np.take_along_axis(sign, order, 0)))

    def signature(self, rows: np.ndarray) -> np.ndarray:
        """Min-hashes of each row of shingles."""
        out = np.empty((len(rows), len(self.xor)), np.uint64)
        for j, (x, m) in enumerate(zip(self.xor, self.odd)):
            out[:, j] = ((rows ^ x) * m).min(axis=1)
        return out

    def windows(self, s: np.ndarray, ptr: np.ndarray, u: int, members: np.ndarray):
        """(document, rows of shingles) of the windows that hold one of ``members``; rows
        are filled up with a shingle of their own where a document ends."""
        step = max(u // 2, 1)
        at = np.searchsorted(members, s)
        at[at == len(members)] = 0
        hit = np.flatnonzero(members[at] == s)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros((0, 3 * step), np.uint64)
        doc = np.searchsorted(ptr, hit, side="right") - 1
        block = (hit - ptr[doc]) // step
        most = int(block.max()) + 3
        key = np.unique((doc[:, None] * most + np.maximum(block[:, None] - np.arange(3), 0)).ravel())
        doc, first = key // most, ptr[key // most] + key % most * step
        cell = first[:, None] + np.arange(3 * step)
        return doc, s[np.minimum(cell, (ptr[doc + 1] - 1)[:, None])]

    def candidates(self, s: np.ndarray, ptr: np.ndarray) -> set:
        found = set()
        for u, members, order, sign in self.parts:
            doc, rows = self.windows(s, ptr, u, members)
            for a in range(0, len(rows), 4096):
                got = self.signature(rows[a:a + 4096])
                for j in range(got.shape[1]):
                    lo, hi = (np.searchsorted(sign[:, j], got[:, j], side) for side in ("left", "right"))
                    for w in np.flatnonzero(hi > lo):
                        found.update((int(doc[a + w]), int(i)) for i in order[lo[w]:hi[w], j])
        return found

    def matches(self, text: pa.Array) -> list[list]:
        """For each text its (item, item's shingles, shared shingles), by item order."""
        ptr, s = shingles(text, self.cfg.k)
        out = [[] for _ in range(len(text))]
        last, own = -1, None
        for d, i in sorted(self.candidates(s, ptr)):
            if d != last:
                last, own = d, np.unique(s[ptr[d]:ptr[d + 1]])
            item = self.sets[i]
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shared = int((own[at] == item).sum())
            if 100 * shared >= self.cfg.percent * len(item):
                out[d].append({"item_id": self.ids[i], "n_item": len(item), "n_shared": shared})
        return out


def with_matches(docs: DataFrame, items: DataFrame, cfg: Containment = Containment(),
                 keep: list[str] | None = None, name: str = "matches") -> DataFrame:
    """Columns ``keep`` (default: all) and the items found in each text."""
    keep = without(keep or docs.columns, f"`{name}` int")
    spark = docs.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    words = known.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-words // cfg.shingles_per_block)
    need = list(dict.fromkeys([*keep, "text"]))
    found = docs.select(*need, F.array().cast(MATCHES).alias(name))
    schema = with_fields(found, need, f"`{name}` {MATCHES}")
    for b in range(blocks):
        own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        rows = own.collect()          # one block of the test set, bounded by shingles_per_block
        shared = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*shared.value, cfg)
            for batch in batches:
                for part, text in text_slices(batch):
                    old = part.column(part.num_columns - 1).to_pylist()
                    new = [a + m for a, m in zip(old, index.matches(text))]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], pa.array(new, _MATCH)], names=[*need, name])
        found = found.mapInArrow(run, schema)
    return found.select(*keep, name)

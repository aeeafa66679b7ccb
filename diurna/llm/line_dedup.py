"""Line deduplication by range-partitioned hashes, answered with keep bitmaps per document.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points found in at least ``min_docs`` documents are common: their
lines are dropped in every document, or with ``keep="first"`` all but the first one of the
corpus, by document id and position. Steps:

1. Chunks of documents list their distinct keys once: hash, number of documents, first
   occurrence. A line that a third of the documents have is one row per chunk. Documents keep
   the numbers of their lines' keys; both are written once, bucketed by chunk.
2. The key rows are range-partitioned by hash and sorted by hash, document and position. A
   task streams them: a key's rows stand together, first occurrence first, and all that is held
   of a key is fewer than ``min_docs`` rows, until it is known to be common.
3. Only rows of common keys go back to their chunks, where each document gets a bitmap of the
   lines that stay (a bit per line, packed and compressed). No text is shuffled;
   ``kept_text`` applies a bitmap to its text.

Two lines count as equal when the 64-bit hashes of their keys are. Defined results: a null or
empty text is one empty line, which is common only with ``min_chars=0``; every row is a
document, so repeated rows count each; a null doc_id is the last one in the order of first
occurrences; texts and lines of any length are taken whole; columns of ``keep`` that clash
with the result's are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.session import checkpoint_dir

from .common import WHITE, release, text_slices, with_fields, without
from .wordtable import Packer

CHUNK, AT, LINES = "__chunk", "__at", "__lines"
KEY_ROW = "__key int, __hash bigint, __docs int, __doc bigint, __line int"
NO_KEY = np.uint32(0xFFFFFFFF)
RESULT = "n_lines bigint, n_dropped bigint, keep_bitmap binary"


@dataclass(frozen=True)
class LineDedup:
    min_chars: int = 1
    min_docs: int = 10
    keep: str = "none"           # of a common key's lines: "none" or the corpus' "first"
    chunk_bytes: int = 4_000_000


def line_keys(text: pa.Array):
    """(owner of each line, its key)."""
    lines = pc.split_pattern(text, "\n")
    keys = pc.ascii_lower(pc.utf8_trim(pc.list_flatten(lines), characters=WHITE))
    return pc.list_parent_indices(lines).to_numpy(), keys


def pack_bits(keep: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(keep).tobytes(), 1)


def unpack_bits(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(bitmap), np.uint8), count=n).astype(bool)


# ---- step 1 -------------------------------------------------------------------------

def _chunk_rows(part: pa.RecordBatch, text: pa.Array, keep: list, chunk: int, cfg: LineDedup) -> pa.RecordBatch:
    """A chunk's documents, then its distinct keys."""
    owner, keys = line_keys(text)
    coded = keys.dictionary_encode()
    names, at = coded.dictionary, coded.indices.to_numpy()
    long = pc.greater_equal(pc.utf8_length(names), cfg.min_chars).to_numpy(zero_copy_only=False)
    ptr = np.searchsorted(owner, np.arange(len(text) + 1))
    number = np.where(long[at], at, NO_KEY).astype(np.uint32)
    packer = Packer()
    docs = [packer.ints(number[a:b]) for a, b in zip(ptr[:-1], ptr[1:])]
    # every key's occurrences by document id and position: how many documents, and the first
    doc = pc.fill_null(part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()), 2**63 - 1).to_numpy()
    use = np.flatnonzero(long[at])
    use = use[np.lexsort((use, doc[owner[use]], at[use]))]
    k, o = at[use], owner[use]
    first = np.ones(len(use), bool)
    first[1:] = k[1:] != k[:-1]
    other = first.copy()
    other[1:] |= o[1:] != o[:-1]
    times = np.add.reduceat(other, np.flatnonzero(first)) if len(use) else np.zeros(0, int)
    f = use[first]
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, names.take(pa.array(at[f])).cast(pa.binary()).to_pylist()),
                         np.uint64, len(f)).view(np.int64)
    n, m = len(text), len(f)
    kept = [part.column(part.schema.get_field_index(c)) for c in keep]
    line = f - ptr[owner[f]]
    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())]
    mine = [pa.array(at[f].astype(np.int32)), pa.array(hashed), pa.array(times.astype(np.int32)),
            pa.array(doc[owner[f]]), pa.array(line.astype(np.int32))]
    return pa.RecordBatch.from_arrays(
        [*(pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in kept),
         pa.array(np.full(n + m, chunk, np.int64)),
         pa.array(np.concatenate([np.arange(n), owner[f]]).astype(np.int32)),
         pa.concat_arrays([pa.array(docs, pa.binary()), pa.nulls(m, pa.binary())]),
         *(pa.concat_arrays([a, b]) for a, b in zip(none, mine))],
        names=[*keep, CHUNK, AT, LINES, "__key", "__hash", "__docs", "__doc", "__line"])


def chunked(docs: DataFrame, keep: list[str], cfg: LineDedup) -> tuple[DataFrame, DataFrame]:
    """(documents, key rows) of all chunks, written once to a table bucketed by chunk."""
    spark = docs.sparkSession
    schema = with_fields(docs, keep, f"{CHUNK} bigint, {AT} int, {LINES} binary, {KEY_ROW}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            rows = pa.Table.from_batches([h[0] for h in held]).combine_chunks().to_batches()[0]
            return _chunk_rows(rows, pa.concat_arrays([h[1] for h in held]), keep, chunk, cfg)
        for batch in batches:
            for part, text in text_slices(batch, max_bytes=cfg.chunk_bytes):
                if held and size + text.nbytes > cfg.chunk_bytes:
                    yield flush()
                    held, size, chunk = [], 0, chunk + 1
                    release()
                held.append((part, text))
                size += text.nbytes
        if held:
            yield flush()
    table = f"line_keys_{uuid.uuid4().hex}"
    (docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).mapInArrow(run, schema).write
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), CHUNK)
     .option("path", f"{checkpoint_dir(spark).rstrip('/')}/{table}").saveAsTable(table))
    both = spark.table(table)
    return (both.where("__key is null").select(*keep, CHUNK, AT, LINES),
            both.where("__key is not null").select("__hash", "__doc", CHUNK, AT, "__line", "__key", "__docs"))


# ---- step 2 -------------------------------------------------------------------------

def common_keys(keys: DataFrame, cfg: LineDedup) -> DataFrame:
    """(chunk, key, at, line, first): the chunks' rows of common keys; ``first`` marks the corpus'
    first occurrence of the key."""
    names = [CHUNK, "__key", AT, "__line", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, held = None, False, None      # the hash of the last row, whether it is common, its rows if not
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            h, n = rows.column(0).to_numpy(), rows.column(6).to_numpy()
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            start = np.flatnonzero(new)
            common = np.add.reduceat(n, start) >= cfg.min_docs
            first = new.copy()
            if known and h[0] == last:
                common[0], first[0] = True, False
            last, known = h[-1], bool(common[-1])
            held = None if known else rows.slice(start[-1])
            out = rows.append_column("first", pa.array(first)).select(names).filter(
                pa.array(np.repeat(common, np.diff(np.append(start, len(h))))))
            yield out
    ordered = keys.repartitionByRange("__hash").sortWithinPartitions("__hash", "__doc", CHUNK, AT, "__line")
    return ordered.mapInArrow(run, f"{CHUNK} bigint, __key int, {AT} int, __line int, first boolean")


# ---- step 3 -------------------------------------------------------------------------

def keep_bitmaps(docs: DataFrame, keep: list[str], cfg: LineDedup = LineDedup()) -> DataFrame:
    """Columns ``keep`` with n_lines, n_dropped and keep_bitmap of every document."""
    if cfg.keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    keep = without(keep, RESULT)
    rows, keys = chunked(docs, keep, cfg)
    schema = with_fields(docs, keep, RESULT)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packer = Packer()
        lines = [packer.unints(x) for x in left.column(LINES).to_pylist()]
        gone = right.column("__key").to_numpy()
        most = max((int(x[x != NO_KEY].max(initial=0)) for x in lines), default=0)
        drop = np.zeros(most + 2, bool)            # the last place stands for lines without a key
        drop[gone] = True
        stays = {}
        if cfg.keep == "first":
            own = right.filter(right.column("first"))
            stays = dict(zip(own.column(AT).to_pylist(), [[] for _ in range(own.num_rows)]))
            for a, z in zip(own.column(AT).to_pylist(), own.column("__line").to_pylist()):
                stays[a].append(z)
        count, dropped, bits = [], [], []
        for at, x in zip(left.column(AT).to_pylist(), lines):
            stay = ~drop[np.minimum(x, most + 1)]
            stay[stays.get(at, [])] = True
            count.append(len(x))
            dropped.append(int(len(x) - stay.sum()))
            bits.append(pack_bits(stay))
        return pa.Table.from_arrays([*(left.column(c) for c in keep), pa.array(count, pa.int64()),
                                     pa.array(dropped, pa.int64()), pa.array(bits, pa.binary())],
                                    names=schema.fieldNames())
    return rows.groupBy(CHUNK).cogroup(common_keys(keys, cfg).groupBy(CHUNK)).applyInArrow(run, schema)


def kept_text(flagged: DataFrame, name: str = "kept_text") -> DataFrame:
    """The rows of ``keep_bitmaps`` (with ``text`` kept) with their remaining lines, joined by \\n, in
    place of text and bitmap."""
    keep = [c for c in flagged.columns if c not in ("text", "keep_bitmap", name)]
    schema = with_fields(flagged, keep, f"`{name}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_slices(batch):
                lines = pc.split_pattern(text, "\n")
                size = pc.list_value_length(lines).to_numpy()
                bitmaps = part.column(part.schema.get_field_index("keep_bitmap")).to_pylist()
                stay = [unpack_bits(b, n) for b, n in zip(bitmaps, size)]
                many = np.fromiter((s.sum() for s in stay), np.int32, len(stay))
                flat = pc.list_flatten(lines).filter(pa.array(np.concatenate(stay)))
                left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), flat)
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pc.binary_join(left, "\n")], names=schema.fieldNames())
    return flagged.select(*keep, "text", "keep_bitmap").mapInArrow(run, schema)

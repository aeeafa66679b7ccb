"""Distinct-word tables: do a costly thing once per distinct word of the corpus.

``split_docs`` cuts the texts into words and codes them per chunk of documents: each
document keeps the numbers of its words, each chunk lists its distinct words once, cut
into hash buckets. ``lookup`` brings a bucket's words of all chunks together, does the
work once per distinct word, and answers each chunk. ``rejoin`` joins the answers to the
documents by chunk.

A frequent word costs one entry per chunk, not one per document, so no word is a hot
key, and what is shuffled is close to the size of the compressed text. A chunk holds
about ``CHUNK_BYTES`` of text (or one longer text), a bucket's table holds the distinct words
of one of ``BUCKETS_PER_PARTITION`` x shuffle-partitions buckets: memory in a task is
bounded by both.

The coded corpus is written once, to a table in the shared checkpoint folder bucketed by
chunk: a lost executor recomputes nothing of it, and the documents, the larger part, meet
their answers without a shuffle of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.session import checkpoint_dir

from .common import release, text_slices, with_fields, without

CHUNK_BYTES = 16_000_000
BUCKETS_PER_PARTITION = 8
CHUNK, BUCKET, RANKS, WORDS, PAYLOAD = "__chunk", "__bucket", "__ranks", "__words", "__payload"


class Packer:
    """Compact bytes for integer arrays (byte planes), ascending hashes and lists of byte strings."""

    def __init__(self):
        self._c, self._d = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def ints(self, a: np.ndarray) -> bytes:
        planes = np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T
        return self._c.compress(planes.tobytes())

    def unints(self, b: bytes) -> np.ndarray:
        planes = np.frombuffer(self._d.decompress(b), np.uint8).reshape(4, -1)
        return np.ascontiguousarray(planes.T).view("<u4").ravel()

    def ascending(self, a: np.ndarray) -> bytes:
        steps = np.diff(np.ascontiguousarray(a, "<u8"), prepend=np.uint64(0))
        return self._c.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())

    def unascending(self, b: bytes) -> np.ndarray:
        planes = np.frombuffer(self._d.decompress(b), np.uint8).reshape(8, -1)
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)

    def strings(self, items: list[bytes]) -> bytes:
        size = self.ints(np.fromiter(map(len, items), np.uint32, len(items)))
        return len(size).to_bytes(4, "little") + size + self._c.compress(b"".join(items))

    def unstrings(self, b: bytes) -> list[bytes]:
        n = int.from_bytes(b[:4], "little")
        ends = np.cumsum(self.unints(b[4:4 + n])).tolist()
        body = self._d.decompress(b[4 + n:])
        return [body[a:z] for a, z in zip([0, *ends], ends)]


def gathered(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + sizes[i]] for i in ``at``, one after another."""
    n = sizes[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((starts[at] - (ends - n)).astype(kind), n) + np.arange(total, dtype=kind)]


def _chunk_rows(part: pa.RecordBatch, text: pa.Array, keep, split, payload, buckets, packer, number):
    """Rows of one chunk: one per document, then one per bucket of its distinct words."""
    owner, words = split(text)
    ptr = np.searchsorted(owner, np.arange(len(text) + 1))
    if len(owner):
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        times = np.bincount(at, minlength=len(coded.dictionary))
        order = np.argsort(-times, kind="stable")          # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ranked = rank[at]
        vocabulary = coded.dictionary.take(pa.array(order)).cast(pa.binary()).to_pylist()
    else:
        ranked, vocabulary = np.zeros(0, np.int64), []
    docs = [packer.ints(payload(ranked[a:b])) for a, b in zip(ptr[:-1], ptr[1:])]
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in vocabulary), np.int64, len(vocabulary))
    by = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[by], return_index=True)
    runs = list(zip(first, [*first[1:], len(by)]))
    n, m = len(docs), len(found)
    nulls = lambda k, t: pa.nulls(k, t)
    kept = [part.column(part.schema.get_field_index(c)) for c in keep]
    columns = [pa.concat_arrays([k, nulls(m, k.type)]) for k in kept]
    columns += [pa.array(np.full(n + m, number, np.int64)),
                pa.concat_arrays([nulls(n, pa.int32()), pa.array(found.astype(np.int32))]),
                pa.array([None] * n + [packer.ints(np.diff(by[a:b], prepend=0)) for a, b in runs], pa.binary()),
                pa.array([None] * n + [packer.strings([vocabulary[i] for i in by[a:b]]) for a, b in runs], pa.binary()),
                pa.array(docs + [None] * m, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[*keep, CHUNK, BUCKET, RANKS, WORDS, PAYLOAD])


def split_docs(docs: DataFrame, keep: list[str], split: Callable, payload: Callable,
               name: str) -> tuple[DataFrame, DataFrame]:
    """(document rows, word rows) of the coded corpus, written once.

    split(texts) -> (owner of each word, flat words); payload(word numbers of one document)
    -> the integers kept for it.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_PARTITION * partitions
    schema = with_fields(docs, keep, f"`{CHUNK}` bigint, `{BUCKET}` int, `{RANKS}` binary, `{WORDS}` binary, "
                         f"`{PAYLOAD}` binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(), TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches([h[0] for h in held]).combine_chunks().to_batches()
            return _chunk_rows(rows[0], pa.concat_arrays([h[1] for h in held]), keep, split, payload,
                               buckets, packer, number)
        for batch in batches:
            for part, text in text_slices(batch):
                if held and size + text.nbytes > CHUNK_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
                    release()
                held.append((part.select([*keep]) if keep else part, text))
                size += text.nbytes
        if held:
            yield flush()
    table = f"{name}_{uuid.uuid4().hex}"
    (docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema).write
     .bucketBy(partitions, CHUNK).option("path", f"{checkpoint_dir(spark).rstrip('/')}/{table}").saveAsTable(table))
    both = spark.table(table)
    return (both.where(F.col(BUCKET).isNull()).select(*keep, CHUNK, PAYLOAD),
            both.where(F.col(BUCKET).isNotNull()).select(CHUNK, BUCKET, RANKS, WORDS))


def lookup(words: DataFrame, make: Callable) -> DataFrame:
    """(chunk, ranks, answers): ``make()`` gives, in each task, a function from a list of new
    distinct words (bytes) to a list of integer arrays; a bucket's words are asked once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ask, table, bucket = Packer(), make(), {}, None
        for batch in batches:
            out = []
            rows = (batch.column(i).to_pylist() for i in range(4))
            for c, b, r, w in zip(*rows):
                if b != bucket:
                    table, bucket = {}, b
                items = packer.unstrings(w)
                new = [x for x in items if x not in table]
                table.update(zip(new, ask(new)))
                got = [table[x] for x in items]
                size = np.fromiter(map(len, got), np.uint32, len(got))
                out.append((c, r, packer.ints(size), packer.ints(np.concatenate(got))))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[1:])],
                names=[CHUNK, RANKS, "sizes", "answers"])
    return (words.repartition(BUCKET).sortWithinPartitions(BUCKET, CHUNK).select(CHUNK, BUCKET, RANKS, WORDS)
            .mapInArrow(run, f"`{CHUNK}` bigint, `{RANKS}` binary, sizes binary, answers binary"))


def rejoin(docs: DataFrame, answers: DataFrame, keep: list[str], schema: str, assemble: Callable) -> DataFrame:
    """Join documents and answers by chunk; ``assemble(payloads, starts, sizes, flat)`` returns
    the new columns: word number r has the answer flat[starts[r] : starts[r] + sizes[r]]."""
    keep = without(keep, schema)
    full = with_fields(docs, keep, schema)
    names = full.fieldNames()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packer = Packer()
        parts = [tuple(packer.unints(x) for x in row) for row in zip(
            *(right.column(c).to_pylist() for c in (RANKS, "sizes", "answers")))]
        many = sum(len(p[0]) for p in parts)
        sizes, starts, base = np.zeros(many, np.int64), np.zeros(many, np.int64), 0
        for steps, s, a in parts:
            r = np.cumsum(steps, dtype=np.int64)
            sizes[r] = s
            starts[r] = base + np.cumsum(s) - s
            base += len(a)
        flat = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint32)
        payloads = [packer.unints(x) for x in left.column(PAYLOAD).to_pylist()]
        new = assemble(payloads, starts, sizes, flat)
        return pa.Table.from_arrays([*(left.column(c) for c in keep), *(pa.array(x) for x in new)],
                                    names=names)
    return docs.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(run, full)

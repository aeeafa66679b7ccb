"""Token ids in binary blocks: Simple-8b word-aligned coding.

Each 64-bit word holds a 4-bit selector and 60 bits of data: as many of the next ids as
fit with one width. A selector stands for (count, width); the two widest counts are for
runs of zeros. An id of 2^60 - 1 or more is an escape: its word holds the marker 2^60 - 1
and the id stands in the block's escape list. Every ``OFFSET_EVERY`` words the block
notes how many ids came before, so that any part of it can be decoded by itself, and
decoding is vectorised by selector.

A file is a folder of Parquet parts in ascending ``doc_id`` order; a row is a block of
whole documents:

    shard, block, n_docs, n_ids, first_id (ids of the shard before the block), doc_ids
    array<long>, doc_sizes array<int>, block binary (header, offsets, escapes, words)

Defined results: null and empty texts hold the end id only; equal doc ids stand next to
each other, each with its own text; null doc ids come first; an empty table gives an
empty file.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diurna.session import checkpoint_dir

from .bpe import WHITE_SPACE, load
from .common import text_slices
from .wordtable import gathered

# Fixed values: (ids per word, bits per id) by selector.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
             (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_SELECTOR_OF = np.zeros(256, np.uint8)
_SELECTOR_OF[[c for c, _ in SELECTORS]] = range(len(SELECTORS))
MARKER = np.uint64((1 << 60) - 1)
OFFSET_EVERY = 1024
MAGIC = b"S8B1"
SLICE_BYTES = 16_000_000  # of text encoded at a time, or one longer text
BLOCK_IDS = 1_000_000     # ids of a block, or one longer text
SCHEMA = ("shard int, block int, n_docs int, n_ids bigint, first_id bigint, doc_ids array<bigint>, "
          "doc_sizes array<int>, payload binary")


_SMALL = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if len(values) and values.max() < len(_SMALL):
        return _SMALL[values]
    out = np.zeros(len(values), np.uint8)
    left = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >> np.uint64(step) > 0
        out[big] += step
        left[big] >>= np.uint64(step)
    out[left > 0] += 1
    return out


def _take(bits: np.ndarray) -> np.ndarray:
    """How many values a word that begins at each place takes (a count of ``SELECTORS``)."""
    n = len(bits)
    widest = {1: np.concatenate([bits, np.zeros(512, np.uint8)])}   # of the next k values, by k

    def need(k: int) -> np.ndarray:
        if k not in widest:
            half = 1 << (k - 1).bit_length() - 1
            a, b = need(half), need(k - half)
            m = len(b) - half
            widest[k] = np.maximum(a[:m], b[half:half + m])
        return widest[k]
    take = np.ones(n, np.uint8)
    for count, width in reversed(SELECTORS[:-1]):
        fits = (need(count)[:n] <= width).view(np.uint8)
        if width == 0:
            fits[max(n - count + 1, 0):] = 0    # a run of zeros must be whole
        take = np.maximum(take, fits * np.uint8(count))
    return take


def pack(values: np.ndarray) -> bytes:
    """A block from unsigned 64-bit values."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    big = values >= MARKER
    escapes, data = values[big], np.where(big, MARKER, values)
    take = _take(_widths(data))
    starts, at, jump = [], 0, take.tolist()
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.asarray(starts, np.int64)
    select, words = _SELECTOR_OF[take[starts]], np.empty(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(64, np.uint64)])   # the last word may end short
    for s, (count, width) in enumerate(SELECTORS):
        rows = np.flatnonzero(select == s)
        if len(rows):
            word = np.full(len(rows), np.uint64(s) << np.uint64(60))
            for i in range(count if width else 0):
                word |= padded[starts[rows] + i] << np.uint64(i * width)
            words[rows] = word
    offsets = starts[::OFFSET_EVERY]
    head = np.array([n, len(words), len(offsets), len(escapes)], "<u8")
    return MAGIC + b"".join(x.astype("<u8").tobytes() for x in (head, offsets, escapes, words))


def unpack(block: bytes) -> np.ndarray:
    """The values of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    body = np.frombuffer(block, "<u8", offset=4)
    n, many, marks, extra = (int(x) for x in body[:4])
    escapes = body[4 + marks:4 + marks + extra]
    words = body[4 + marks + extra:4 + marks + extra + many]
    select = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[select]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        rows = np.flatnonzero(select == s)
        if width and len(rows):
            shift = (np.arange(count) * width).astype(np.uint64)
            out[first[rows][:, None] + np.arange(count)] = (
                words[rows][:, None] >> shift) & np.uint64((1 << width) - 1)
    out = out[:n]
    if extra:
        out[out == MARKER] = escapes
    return out


# Unicode white space, which the tokenizer's own pattern calls \s.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_ODD = WHITE_SPACE.removesuffix("+") + " |\x00"
_LATIN = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]"
_MARKS = "[.,!?;:%&*$#]"
_SURE = f"^ ?({_LATIN}+|{_MARKS}+)$"     # one pre-token, whatever stands around it


def spaced_words(text: pa.Array):
    """(owner, words with the white space before them): the tokenizer's own pattern never
    joins a non-space to a space after it, nor a letter to a mark after it, so these can be
    encoded one by one.

    Where no white space stands before a space, every space begins a word; other texts
    are cut by a pattern.
    """
    odd = pc.match_substring_regex(text, _ODD).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    cut = pc.replace_substring_regex(text.take(pa.array(plain)), f"({_LATIN})({_MARKS}+)", "\\1\x00\\2")
    parts = pc.split_pattern(pc.replace_substring(cut, " ", "\x00 "), "\x00")
    words, owner = pc.list_flatten(parts), plain[pc.list_parent_indices(parts).to_numpy()]
    full = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    if len(rest):
        found = [_WORD.findall(t) for t in text.take(pa.array(rest)).to_pylist()]
        owner = np.concatenate([owner, np.repeat(rest, [len(f) for f in found])])
        words = pa.concat_arrays([words, pa.array([x for f in found for x in f], pa.string())])
        order = np.argsort(owner, kind="stable")
        owner, words = owner[order], words.take(pa.array(order))
    return owner, words


def _byte_letters() -> dict:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def piece_ranks(parsed: dict) -> dict:
    """Pieces as bytes with their ids, where the ids rise with the merges' ranks; else none."""
    model, byte = parsed["model"], {v: k for k, v in _byte_letters().items()}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made):
        return {}
    return {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in byte for c in piece)}


def word_encoder(definition: str) -> Callable:
    """Function from words of ``spaced_words`` to lists of ids. Words that are surely one
    pre-token are merged by rank at once, the others go through the whole tokenizer."""
    from tiktoken._tiktoken import CoreBPE
    parsed = json.loads(definition)
    pre = parsed["pre_tokenizer"] or {}
    if parsed["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        raise ValueError("words can be encoded apart only for a plain byte-level tokenizer")
    tok, ranks = load(definition), piece_ranks(parsed)
    merge = CoreBPE(ranks, {}, ".").encode_single_piece if ranks else None

    def run(words: pa.Array) -> list:
        sure = pc.match_substring_regex(words, _SURE) if merge else pa.array([False] * len(words))
        mask, out = sure.to_numpy(zero_copy_only=False), np.empty(len(words), object)
        out[mask] = _objects([merge(w) for w in words.filter(sure).cast(pa.binary()).to_pylist()])
        whole = tok.encode_batch_fast(words.filter(pc.invert(sure)).to_pylist(), add_special_tokens=False)
        out[~mask] = _objects([g.ids for g in whole])
        return out.tolist()
    return run


def _objects(lists: list) -> np.ndarray:
    out = np.empty(len(lists), object)
    out[:] = lists
    return out


def byte_level_encoder(definition: str, end_id: int) -> Callable:
    """Function from texts to (ids of all, sizes per text), each text closed by ``end_id``.

    Words are encoded once per slice of texts."""
    encode = word_encoder(definition)

    def run(text: pa.Array):
        owner, words = spaced_words(text)
        coded = words.dictionary_encode()
        got = encode(coded.dictionary)
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        # one more entry for the end id, placed after the words of each text
        size, flat = np.append(size, 1), np.append(flat, np.uint32(end_id))
        start = np.cumsum(size) - size
        at, ends = coded.indices.to_numpy(), np.searchsorted(owner, np.arange(len(text)), side="right")
        at = np.insert(at.astype(np.int64), ends, len(size) - 1)
        owner = np.insert(owner, ends, np.arange(len(text)))
        sizes = np.bincount(owner, weights=size[at], minlength=len(text)).astype(np.int64)
        return gathered(start, size, flat, at), sizes
    return run


def write(docs: DataFrame, definition: str, end_id: int, path: str | None = None) -> str:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; returns the path."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/token-file-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(shared.value, end_id)
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part, text in text_slices(batch, max_bytes=SLICE_BYTES):
                ids, sizes = encode(text)
                named, ends, a = part.column(0).to_pylist(), np.cumsum(sizes), 0
                while a < len(sizes):       # blocks of whole documents
                    done = int(ends[a - 1]) if a else 0
                    z = max(a + 1, int(np.searchsorted(ends, done + BLOCK_IDS, side="right")))
                    own = ids[done:ends[z - 1]]
                    yield pa.RecordBatch.from_pylist([{
                        "shard": shard, "block": number, "n_docs": z - a, "n_ids": len(own), "first_id": before,
                        "doc_ids": named[a:z], "doc_sizes": sizes[a:z].tolist(), "payload": pack(own)}],
                        schema=_ARROW)
                    number, before, a = number + 1, before + len(own), z
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first()
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, SCHEMA).write.parquet(path)
    return path


_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
                    ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("doc_sizes", pa.list_(pa.int32())), ("payload", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``: the number of ids of the whole file before each block."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard, so one ordered window over them stays small
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    return (blocks.join(F.broadcast(before), "shard")
            .withColumn("start", F.col("shard_start") + F.col("first_id")).drop("shard_start"))


def documents(blocks: DataFrame, schema: str, names: list[str], per_document: Callable) -> DataFrame:
    """(doc_id, start, n_tokens, ...) by decoding the blocks; ``per_document`` gets the ids of
    one document (uint64) and returns the tuple of further columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (c.to_pylist() for c in batch.columns)
            for doc_ids, sizes, payload, start in zip(*rows):
                ids, ends = unpack(payload), np.cumsum(sizes)
                more = [per_document(ids[z - n:z]) for n, z in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - np.asarray(sizes), pa.int64()),
                     pa.array(sizes, pa.int64()), *(pa.array(c) for c in zip(*more))],
                    names=["doc_id", "start", "n_tokens", *names])
    return blocks.select("doc_ids", "doc_sizes", "payload", "start").mapInArrow(
        run, f"doc_id bigint, start bigint, n_tokens bigint, {schema}")


def checksum(ids: np.ndarray) -> tuple:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)

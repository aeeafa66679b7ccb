"""Sparse logistic regression by follow-the-regularised-leader, and how Spark feeds it.

Features are made where the texts are (Arrow batches, one sparse vector per document).
Only a bounded sample of labelled vectors reaches the one task that fits; scoring runs
over all documents with the fitted weights, whose size is fixed by ``dimensions``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, with_fields, without


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal settings; one pass over the sample per epoch, in the sample's order."""
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.1
    epochs: int = 3


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_ftrl(vectors: list, labels: np.ndarray, size: int, cfg: Ftrl) -> np.ndarray:
    """Weights (the last one is the intercept) from sparse (index, value) vectors."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = [(np.append(i, size).astype(np.int64), np.append(v, 1.0)) for i, v in vectors]

    def weights(zi, ni):
        w = -(zi - np.sign(zi) * cfg.l1) / ((cfg.beta + np.sqrt(ni)) / cfg.alpha + cfg.l2)
        return np.where(np.abs(zi) <= cfg.l1, 0.0, w)

    for _ in range(cfg.epochs):
        for (i, v), y in zip(rows, labels, strict=True):
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (sigmoid(w @ v) - y) * v
            g2 = ni + g * g
            z[i] = zi + g - (np.sqrt(g2) - np.sqrt(ni)) / cfg.alpha * w
            n[i] = g2
    return weights(z, n)


def sample_vectors(docs: DataFrame, labels: DataFrame, targets: list[str], features: Callable, max_rows: int,
                   salt: int, extra: list[str] = (), most_parts: int = 1) -> DataFrame:
    """Vectors of at most ``max_rows`` labelled documents, first in hash order of the id.

    ``features(texts)`` gives (owner, part, pointers, slots, values): one vector for each part of a document,
    at most ``most_parts`` of them.

    Labels of other documents don't count towards the bound. The label rows are cut before
    the join, so the broadcast side is bounded by ``max_rows``; the result is cut again
    because ids may repeat in ``docs``.
    """
    order = [F.xxhash64("doc_id", F.lit(salt)), F.col("doc_id")]
    known = labels.where(F.col("doc_id").isNotNull())
    for t in targets:
        known = known.where(F.col(t).isNotNull())
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.select("doc_id", *targets).orderBy(*order, *targets).limit(max_rows)
    joined = docs.select("doc_id", "text", *extra).join(F.broadcast(known), "doc_id")
    keep = ["doc_id", *targets, *extra]
    schema = with_fields(joined, keep, "part int, idx binary, val binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_slices(batch):
                owner, number, ptr, idx, val = features(text)
                cut = [(idx[a:b].astype("<i4").tobytes(), val[a:b].astype("<f4").tobytes())
                       for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                cols = [part.column(part.schema.get_field_index(c)).take(pa.array(owner)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(np.asarray(number, np.int32)), pa.array([c[0] for c in cut], pa.binary()),
                     pa.array([c[1] for c in cut], pa.binary())], names=[*keep, "part", "idx", "val"])
    made = joined.mapInArrow(run, schema)
    return made.orderBy(*order, *targets, "part", "idx").limit(max_rows * most_parts)


def unpack(table: pa.Table) -> list:
    return [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4").astype(np.float64))
            for i, v in zip(table.column("idx").to_pylist(), table.column("val").to_pylist(), strict=True)]


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], np.ndarray], shape: tuple) -> np.ndarray:
    """Run ``fit`` on the whole bounded sample in one task and bring its weights back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            w = np.asarray(fit(pa.Table.from_batches(held)), "<f4").reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])
    rows = sample.coalesce(1).mapInArrow(run, "w binary").collect()
    return np.frombuffer(rows[0].w, "<f4").reshape(shape) if rows else np.zeros(shape, "<f4")


def whole(vectors: Callable) -> Callable:
    """Features for ``sample_vectors`` from a function that gives one vector for each text."""
    def features(text):
        n = np.arange(len(text))
        return n, np.zeros(len(text), np.int32), *vectors(text)
    return features


def score_texts(docs: DataFrame, keep: list[str], schema: str, score: Callable, max_bytes: int = 4_000_000) -> DataFrame:
    """``score(texts) -> list of numpy columns`` over all rows, beside the columns ``keep``."""
    keep = without(keep, schema)
    full = with_fields(docs, keep, schema)
    names = full.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in text_slices(batch, max_bytes=max_bytes):
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x) for x in score(text))], names=names)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, full)

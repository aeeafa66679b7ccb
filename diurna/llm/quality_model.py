"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features of a text, hashed into ``dimensions`` slots: its lower-cased words and word
pairs, and the shapes of its words (letter runs by case and digit runs collapsed, the
rest kept) as single shapes, pairs and triples. Every occurrence adds 1/words, so a
score does not depend on the length. Scoring is a sparse dot product per document.

Defined results: an empty or null text has no features and scores the intercept; rows
with a null label do not train; repeated rows are scored each (and train each, within
the bound); without labelled rows every score is 0.5; with none to score, no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import words_of
from .linear import fit_ftrl, sigmoid, unpack


@dataclass(frozen=True)
class QualityModelConfig:
    dimensions: int = 1 << 18
    max_rows: int = 4000      # bound of the labelled sample that the model is fitted on
    scale: float = 20.0       # of the features, so that the step sizes suit them
    threshold: float = 0.3
    ftrl: linear.Ftrl = field(default_factory=lambda: linear.Ftrl(alpha=0.5, l1=0.002, l2=0.01, epochs=4))


def hashes(values: list, seed: int) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v, seed) for v in values), np.uint64, len(values))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent 64-bit combination of two hash arrays."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def shapes(words: pa.Array) -> pa.Array:
    for pattern, to in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0")):
        words = pc.replace_substring_regex(words, pattern, to)
    return words


def occurrences(text: pa.Array, dimensions: int):
    """(owner document, slot) of every feature occurrence, and words per document."""
    owner, words = words_of(text)
    count = np.bincount(owner, minlength=len(text))
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy()
    word = hashes(pc.utf8_lower(coded.dictionary).to_pylist(), 1)[at]
    form = shapes(coded.dictionary).dictionary_encode()
    shape = hashes(form.dictionary.to_pylist(), 2)[form.indices.to_numpy()][at]
    two, three = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    pair = mixed(shape[:-1], shape[1:])
    parts = [(owner, word), (owner[1:][two], mixed(word[:-1], word[1:])[two]), (owner, shape),
             (owner[1:][two], pair[two]), (owner[2:][three], mixed(pair[:-1], shape[2:])[three])]
    slot = np.concatenate([p[1] for p in parts]) >> np.uint64(40)
    return np.concatenate([p[0] for p in parts]), (slot % np.uint64(dimensions)).astype(np.int64), count


def vectors(text: pa.Array, config: QualityModelConfig):
    """Sparse vectors as (pointers, slots, values)."""
    owner, slot, count = occurrences(text, config.dimensions)
    key, times = np.unique(owner * np.int64(config.dimensions) + slot, return_counts=True)
    doc = key // config.dimensions
    ptr = np.searchsorted(doc, np.arange(len(text) + 1))
    return ptr, key % config.dimensions, config.scale * times / np.maximum(count, 1)[doc]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, config: QualityModelConfig = QualityModelConfig(),
        target: str = "quality") -> np.ndarray:
    """Weights from at most ``max_rows`` labelled documents that are not held out."""
    sample = linear.sample_vectors(docs, labels.where(~held_out()), [target],
                                   linear.whole(lambda text: vectors(text, config)), config.max_rows, salt=10)

    def train(t: pa.Table) -> np.ndarray:
        return fit_ftrl(unpack(t), np.asarray(t.column(target).to_pylist(), float),
                               config.dimensions, config.ftrl)
    return linear.fit_in_task(sample, train, (config.dimensions + 1,))


def score(docs: DataFrame, weights: np.ndarray, config: QualityModelConfig = QualityModelConfig(),
          keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` (default: all) with score and predicted, their names after ``prefix``."""
    keep = keep or docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(text: pa.Array) -> list:
        w = shared.value
        owner, slot, count = occurrences(text, config.dimensions)
        dot = np.bincount(owner, weights=w[slot].astype(np.float64), minlength=len(text))
        p = sigmoid(w[-1] + config.scale * dot / np.maximum(count, 1))
        return [p, (p >= config.threshold).astype(np.int32)]
    return linear.score_texts(docs, keep, f"{prefix}score double, {prefix}predicted int", run)

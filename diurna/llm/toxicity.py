"""Toxicity by a classifier chain.

Categories are predicted one after another; the probability of each earlier category
is an input of each later linear model. The later models are trained on out-of-fold
predictions of the earlier ones, so that they see them as unsure as they will be.

A text is scored by windows of ``window`` words that overlap by a half and cover all of it, and is
as toxic as its most toxic window, so that the verdict does not depend on what else a long
text says. Features of a window: its distinct lower-cased letter-and-digit words, each with its
leading 3 to 6 characters (stems of inflected and compound words), hashed. A slot's
value is the number of distinct words that have it, at most ``most``, over the root of the
number of slots.

The labelled table knows one label, ``toxic``. The chain's categories are that label
within each language (the language is used as a label only, never as an input of a
score) and last the label itself, which decides.

Defined results: a null or empty text scores the intercepts; rows with a null label do
not train; repeated rows are scored each, and train as one; without labelled rows nothing is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import linear
from .common import words_of
from .linear import fit_ftrl, sigmoid, unpack
from .quality_model import hashes


@dataclass(frozen=True)
class ToxicityConfig:
    categories: tuple = ("en", "de", "fr", "es")   # languages; the label itself comes last
    dimensions: int = 1 << 18
    stems: tuple = (3, 4, 5, 6)
    max_rows: int = 4000      # bound of the labelled sample that the chain is fitted on
    folds: int = 3
    most: int = 3             # of a slot's value
    scale: float = 8.0        # of the features, so that the step sizes suit them
    threshold: float = 0.3    # held out: 93 % of toxic texts found, 0.5 % of clean ones flagged
    window: int = 100         # words that are scored together
    fit_windows: int = 8      # windows of a labelled text that the fit sees, spread over it
    clean_windows: int = 2    # of a clean one, that it trains on
    ftrl: linear.Ftrl = field(default_factory=lambda: linear.Ftrl(alpha=0.5, l1=1.0, l2=0.1, epochs=3))


def windows(n: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """Number of windows of texts of n words."""
    return np.maximum(-(-(n - config.window) // (config.window // 2)), 0) + 1


def window_words(text: pa.Array, config: ToxicityConfig, whole: bool = False):
    """(number of windows of each text, (window, word number) pairs, each once, and the words). Windows are numbered
    through all texts; a text's windows overlap by a half and cover all of it. ``whole``: one window a text."""
    owner, words = words_of(text)
    coded = words.dictionary_encode()
    plain = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{N}]+", "")
    form = plain.dictionary_encode()
    number = form.indices.to_numpy()[coded.indices.to_numpy()] if len(owner) else np.zeros(0, np.int64)
    n = np.bincount(owner, minlength=len(text))
    many = np.ones(len(text), np.int64) if whole else windows(n, config)
    first = np.cumsum(many) - many
    if whole:
        of = owner.astype(np.int64)
    else:
        at = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
        later = at // (config.window // 2)
        use = later < many[owner]
        before = later > 0
        of = np.concatenate([(first[owner] + later)[use], (first[owner] + later - 1)[before]])
        number = np.concatenate([number[use], number[before]])
    size = max(len(form.dictionary), 1)
    key = np.unique(of * size + number)
    return many, key // size, key % size, form.dictionary


def word_slots(words: pa.Array, config: ToxicityConfig) -> np.ndarray:
    """One row of slots per word; slot ``dimensions`` stands for none."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    out = [np.where(size > 0, hashes(words.to_pylist(), 3) % np.uint64(config.dimensions), config.dimensions)]
    for n in config.stems:
        stem = pc.utf8_slice_codeunits(words, 0, n).dictionary_encode()
        slot = (hashes(stem.dictionary.to_pylist(), 4 + n) % np.uint64(config.dimensions))[stem.indices.to_numpy()]
        out.append(np.where(size >= n, slot, config.dimensions))
    return np.stack(out, axis=1).astype(np.int64)


def vectors(text: pa.Array, config: ToxicityConfig, whole: bool = False):
    """(number of windows of each text, pointers, slots, values of the windows' vectors)."""
    many, window, number, words = window_words(text, config, whole)
    slots = word_slots(words, config)
    wide = np.int64(config.dimensions + 1)
    key, times = np.unique((window[:, None] * wide + slots[number]).ravel(), return_counts=True)
    use = key % wide != config.dimensions
    key, times = key[use], np.minimum(times[use], config.most)
    at = key // wide
    total = int(many.sum())
    slots_in = np.bincount(at, minlength=total)
    return (many, np.searchsorted(at, np.arange(total + 1)), key % wide,
            config.scale * times / np.sqrt(np.maximum(slots_in, 1))[at])


def parts(text: pa.Array, config: ToxicityConfig):
    """What the fit sees of each text: the whole (part 0) and at most ``fit_windows`` windows spread over it."""
    _, p0, i0, v0 = vectors(text, config, True)
    many, p1, i1, v1 = vectors(text, config)
    first = np.cumsum(many) - many
    some = [np.unique(np.linspace(0, m - 1, min(int(m), config.fit_windows)).astype(int)) + a for m, a in zip(many, first)]
    owner = np.concatenate([np.arange(len(text)), np.repeat(np.arange(len(text)), [len(s) for s in some])]).astype(np.int64)
    number = np.concatenate([np.zeros(len(text), int), *(1 + np.arange(len(s)) for s in some)])
    cut = [(i0[a:b], v0[a:b]) for a, b in zip(p0[:-1], p0[1:])] + [(i1[p1[w]:p1[w + 1]], v1[p1[w]:p1[w + 1]])
                                                                  for s in some for w in s]
    ptr = np.cumsum([0, *(len(i) for i, _ in cut)])
    return owner, number, ptr, *(np.concatenate([c[k] for c in cut]) if cut else i0 for k in (0, 1))


def fit_chain(rows: list, labels: np.ndarray, size: int, folds: int, cfg: linear.Ftrl,
              fold: np.ndarray | None = None) -> np.ndarray:
    """(categories, size + categories + 1) weights: slots, earlier probabilities, intercept.

    labels: one column per category, in the chain's order."""
    n, many = labels.shape
    fold = np.arange(n) % folds if fold is None else fold
    earlier = np.zeros((n, many))
    out = np.zeros((many, size + many + 1))

    def with_earlier(c):
        return [(np.concatenate([i, size + np.arange(c)]), np.concatenate([v, earlier[r, :c]]))
                for r, (i, v) in enumerate(rows)]
    for c in range(many):
        made = with_earlier(c)
        for k in range(folds):
            rest = np.flatnonzero(fold != k)
            w = fit_ftrl([made[r] for r in rest], labels[rest, c], size + many, cfg)
            for r in np.flatnonzero(fold == k):
                i, v = made[r]
                earlier[r, c] = sigmoid(w[i] @ v + w[-1])
        out[c] = fit_ftrl(made, labels[:, c], size + many, cfg)
    return out


def chosen(rows: list, toxic: np.ndarray, doc: np.ndarray, part: np.ndarray, config: ToxicityConfig):
    """Rows to train the chain on: a first model of the whole texts picks of each toxic text the window that looks
    most toxic, where its label is likely from, and of each clean one those that are mistaken most easily."""
    whole = np.flatnonzero(part == 0)
    w = fit_ftrl([rows[r] for r in whole], toxic[whole], config.dimensions, config.ftrl)
    p = np.array([w[i] @ v for i, v in rows])
    order = np.lexsort((-p, part == 0, doc))            # by document, its windows first, by score
    start = np.searchsorted(doc[order], doc[order], side="left")
    keep = np.where(toxic[order] > 0, 1, config.clean_windows)
    return order[(part[order] > 0) & (np.arange(len(order)) - start < keep)]


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> np.ndarray:
    sample = linear.sample_vectors(docs, labels, ["toxic"], lambda text: parts(text, config),
                                   config.max_rows, salt=6, extra=["lang"], most_parts=1 + config.fit_windows)
    many = len(config.categories) + 1

    def train(t: pa.Table) -> np.ndarray:
        rows, part = unpack(t), t.column("part").to_numpy()
        toxic = np.asarray(t.column("toxic").to_pylist(), float)
        lang = np.asarray([x or "" for x in t.column("lang").to_pylist()])
        # rows stand by document, part 0 first; documents of one id are one
        ids = np.asarray(t.column("doc_id").to_pylist())
        doc = np.cumsum(np.append(False, ids[1:] != ids[:-1]))
        use = chosen(rows, toxic, doc, part, config)
        columns = np.stack([*(toxic * (lang == c) for c in config.categories), toxic], axis=1)
        return fit_chain([rows[r] for r in use], columns[use], config.dimensions, config.folds, config.ftrl,
                         doc[use] % config.folds)
    return linear.fit_in_task(sample, train, (many, config.dimensions + many + 1))


def score(docs: DataFrame, weights: np.ndarray, config: ToxicityConfig = ToxicityConfig(),
          keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` (default: all) with p_<category>..., p_toxic and toxic, their names after ``prefix``: the
    probabilities of the text's window with the highest p_toxic."""
    keep = keep or docs.columns
    cats, size = len(config.categories) + 1, config.dimensions
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(text: pa.Array) -> list:
        w = shared.value
        chain = w[:, size:]
        many, ptr, slot, value = vectors(text, config)
        total = int(many.sum())
        owner = np.repeat(np.arange(total), np.diff(ptr))
        p = np.zeros((total, cats))
        for c in range(cats):
            dot = np.bincount(owner, weights=w[c, slot] * value, minlength=total)
            p[:, c] = sigmoid(dot + p[:, :c] @ chain[c, :c] + chain[c, -1])
        doc = np.repeat(np.arange(len(text)), many)
        top = np.lexsort((-p[:, -1], doc))[np.cumsum(many) - many]
        return [*(p[top, c] for c in range(cats)), p[top, -1] > config.threshold]
    names = [*(f"p_{c}" for c in config.categories), "p_toxic"]
    schema = ", ".join([*(f"{prefix}{n} double" for n in names), f"{prefix}toxic boolean"])
    return linear.score_texts(docs, keep, schema, run, max_bytes=1_000_000)

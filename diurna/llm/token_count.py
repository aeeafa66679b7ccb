"""Token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token is a run of spaces with the non-space run after it. No piece of the model
crosses from a non-space to a space (checked), so a text's count is the sum over its
pre-tokens. Per document only (pre-token, frequency) pairs are kept; each distinct
pre-token of the corpus is counted once and joined back to them.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted
each; texts of any length are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordtable
from .common import without

SPACE = "▁"   # how the pieces write a space


def pre_tokens(text: pa.Array):
    """(owner, pre-tokens less their first space; the model puts one before each text).

    Texts whose spaces are single and inside are split at them at once, the others by a
    pattern over the text with the model's leading space.
    """
    odd = pc.or_(pc.match_substring_regex(text, "  |^ | $"), pc.match_substring(text, SPACE))
    odd = pc.and_(odd, pc.greater(pc.binary_length(text), 0)).to_numpy(zero_copy_only=False)
    if not odd.any():
        return _split(text, np.arange(len(text)))
    plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    owner, words = _split(text.take(pa.array(plain)), plain)
    found = [re.findall(" +[^ ]*", " " + t.replace(SPACE, " ")) for t in text.take(pa.array(rest)).to_pylist()]
    owner = np.concatenate([owner, np.repeat(rest, [len(f) for f in found])])
    words = pa.concat_arrays([words, pa.array([x[1:] for f in found for x in f], pa.string())])
    order = np.argsort(owner, kind="stable")
    return owner[order], words.take(pa.array(order))


def _split(text: pa.Array, number: np.ndarray):
    full = np.flatnonzero(pc.binary_length(text).to_numpy(zero_copy_only=False) > 0)
    parts = pc.split_pattern(text.take(pa.array(full)), " ")
    return number[full][pc.list_parent_indices(parts).to_numpy()], pc.list_flatten(parts)


def frequencies(ranks: np.ndarray) -> np.ndarray:
    """Word numbers (as steps) and how often each occurs, one after the other."""
    number, times = np.unique(ranks, return_counts=True)
    return np.concatenate([np.diff(number, prepend=0), times])


def counter(model: bytes):
    """Function from pre-tokens to their numbers of pieces, for one task."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    lone = len(sp.encode("a ")) - len(sp.encode("a"))   # a space at the end of a text

    def ask(words: list) -> list:
        texts = [w.decode() for w in words]
        got = sp.encode(texts, num_threads=1) if texts else []
        return [np.array([len(g) if t else lone], np.uint32) for t, g in zip(texts, got)]
    return ask


def check_model(model: bytes) -> None:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(sp.get_piece_size()):
        if SPACE in sp.id_to_piece(i).lstrip(SPACE):
            raise ValueError("a piece of this model crosses white space; pre-tokens can't be counted apart")


def count_tokens(docs: DataFrame, model: bytes, keep: list[str], limit: int = 4096) -> DataFrame:
    """Columns ``keep`` with n_bytes, n_tokens and over_limit."""
    check_model(model)
    keep = without(keep, "n_bytes bigint, n_tokens bigint, over_limit boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sized = docs.withColumn("__bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows, words = wordtable.split_docs(sized, [*keep, "__bytes"], pre_tokens, frequencies, "token_counts")
    answers = wordtable.lookup(words, lambda: counter(shared.value))

    def assemble(payloads, starts, sizes, flat):
        per_word = flat[starts].astype(np.int64)
        out = np.zeros(len(payloads), np.int64)
        for i, p in enumerate(payloads):
            half = len(p) // 2
            out[i] = per_word[np.cumsum(p[:half])] @ p[half:].astype(np.int64)
        return [out]
    counted = wordtable.rejoin(rows, answers, [*keep, "__bytes"], "n_tokens bigint", assemble)
    return counted.select(*keep, F.col("__bytes").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))

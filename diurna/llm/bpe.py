"""BPE encoding and decoding through a distinct-word table.

Texts are split into words at white space (which the tokenizer drops between its
pre-tokens) and before punctuation after a letter (where it always begins a pre-token).
Each distinct word of the corpus is encoded once and its ids are joined back by position
(``ids``). ``decode`` turns ids of any origin into text through the id-to-piece table of the vocabulary.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated
rows are encoded each; texts of any length are encoded whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import wordtable
from .common import with_fields, without
from .wordtable import gathered

# Unicode white space, which the tokenizer's own patterns call \s.
WHITE_SPACE = (r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


# A place where the tokenizer always cuts: a Latin letter before common punctuation.
_CUT = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([.,!?;:%&*$#]+)"
SPECIAL = "<|"   # with which the vocabulary's special strings begin


def words(text: pa.Array):
    """(owner, words). The tokenizer lower-cases and drops white space, so outside texts with
    special strings A-Z are lower-cased and the certain cuts made first: fewer distinct words."""
    plain = pc.replace_substring_regex(pc.ascii_lower(text), _CUT, r"\1 \2")
    text = pc.if_else(pc.match_substring(text, SPECIAL), text, plain)
    parts = pc.split_pattern_regex(text, WHITE_SPACE)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    return owner[full.to_numpy(zero_copy_only=False)], flat.filter(full)


def check_words(definition: str) -> None:
    """Whether this tokenizer lower-cases, drops white space and cuts where ``words`` does."""
    tok, probe = load(definition), "Ab,c d\u00e9!\n\tE.F"
    ids = [i for w in words(pa.array([probe]))[1].to_pylist() for i in tok.encode(w, add_special_tokens=False).ids]
    if ids != tok.encode(probe, add_special_tokens=False).ids or any(
            SPECIAL not in t.content for t in tok.get_added_tokens_decoder().values()):
        raise ValueError("this tokenizer joins characters across the cuts that words() makes")


def load(definition: str):
    """The library's tokenizer, without truncation or padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(definition)
    tok.no_truncation()
    tok.no_padding()
    return tok


def encoder(definition: str):
    tok = load(definition)

    def ask(new: list) -> list:
        got = tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        return [np.array(g.ids, np.uint32) for g in got]
    return ask


def pieces(definition: str) -> list[str]:
    """The id-to-piece table; unused ids hold nothing."""
    tok = load(definition)
    vocabulary = tok.get_vocab(with_added_tokens=True)
    table = [""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        table[i] = piece
    return table


def encode(docs: DataFrame, definition: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents as word numbers by position, answers with the ids of each word)."""
    check_words(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    rows, listed = wordtable.split_docs(docs, keep, words, lambda ranks: ranks, "bpe_words")
    return rows, wordtable.lookup(listed, lambda: encoder(shared.value))


def _joined(payloads, starts, sizes, flat):
    for p in payloads:
        yield gathered(starts, sizes, flat, p)


def ids(docs: DataFrame, definition: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ids array<int>."""
    rows, answers = encode(docs, definition, keep)

    def assemble(*a):
        return [[x.astype(np.int32) for x in _joined(*a)]]
    return wordtable.rejoin(rows, answers, keep, "ids array<int>", assemble)


def texts_of(flat: pa.Array, sizes: np.ndarray, table: pa.Array) -> pa.Array:
    """The text of each run of ids: every id is joined with its piece, the pieces by a space, as the library does where a
    vocabulary has no decoder of its own. Ids that the vocabulary lacks give nothing."""
    known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), False)
    word, ends = table.take(pc.if_else(known, flat, None)), np.cumsum(sizes)
    if word.null_count:
        have = np.concatenate([[0], np.cumsum(pc.is_valid(word).to_numpy(zero_copy_only=False))])
        word, ends = word.drop_null(), have[ends]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), word), " ")


def _table(docs: DataFrame, definition: str):
    if load(definition).decoder is not None:
        raise ValueError("this tokenizer has a decoder of its own; pieces alone don't give its text")
    return docs.sparkSession.sparkContext.broadcast(pieces(definition))


def decode(coded: DataFrame, definition: str, keep: list[str], column: str = "ids", name: str = "decoded") -> DataFrame:
    """Columns ``keep`` and the text of the ids in ``column``, through the id-to-piece table (the vocabulary's size);
    null has no ids."""
    keep = without(keep, f"`{name}` string")
    schema = with_fields(coded, keep, f"`{name}` string")
    shared = _table(coded, definition)

    def run(batches):
        table = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, texts_of(pc.list_flatten(lists), sizes, table)],
                                             names=schema.fieldNames())
    return coded.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


def round_trip(docs: DataFrame, definition: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids`` the ids themselves. Both
    digests are of a document's joined ids: of these, and of the text that they decode to."""
    rows, answers = encode(docs, definition, keep)
    shared = _table(docs, definition)

    def assemble(payloads, starts, sizes, flat):
        table = pa.array(shared.value, pa.string())
        count, hashed, text, kept = [], [], [], []
        for got in _joined(payloads, starts, sizes, flat):
            count.append(len(got))
            hashed.append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
            decoded = texts_of(pa.array(got.astype(np.int32)), np.array([len(got)]), table)
            text.append(hashlib.sha256(decoded[0].as_buffer()).hexdigest())
            if with_ids:
                kept.append(got.astype(np.int32))
        out = [np.array(count, np.int64), pa.array(hashed, pa.string()), pa.array(text, pa.string())]
        return [*out, pa.array(kept, pa.list_(pa.int32()))] if with_ids else out
    return wordtable.rejoin(rows, answers, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                            + (", ids array<int>" if with_ids else ""), assemble)

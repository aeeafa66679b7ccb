"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from diurna.session import checkpoint_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
# A word: a run of characters other than the six ASCII white-space characters.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


# Bound of the Arrow batches that carry texts between Spark and its Python workers (Spark's own is 64 MB, of
# which every running task holds several).
BATCH_BYTES = "4m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder; sets the session's bound of Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage at a table that every executor can read again, so a lost
    executor costs only its own tasks, and a frame used twice is computed once.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, keep: list[str], ddl: str) -> StructType:
    """The schema of columns ``keep`` of ``df`` (as nullable) and further fields."""
    kept = [StructField(c, df.schema[c].dataType) for c in keep]
    return StructType([*kept, *StructType.fromDDL(ddl).fields])


def without(keep: list[str], ddl: str) -> list[str]:
    """Columns of ``keep`` that no field of ``ddl`` replaces: a result's own columns go first."""
    new = {n.lower() for n in StructType.fromDDL(ddl).fieldNames()}
    return [c for c in keep if c.lower() not in new]


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4_000_000):
    """Cut an Arrow batch into runs of rows whose texts stay near ``max_bytes``.

    Bounds the memory of per-word work whatever the lengths of the texts; one text
    is never cut. Yields (slice of the batch, its texts with null as empty).
    """
    text = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(text.type):
        text = text.cast(pa.string())
    text = pc.fill_null(text, "")
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at, n = 0, len(text)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        part = text.slice(at, to - at)
        yield batch.slice(at, to - at), part
        at = to


def release() -> None:
    """Give freed memory back to the system: a worker that has done a large chunk may idle beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc's
    if trim:
        trim(0)


def words_of(text: pa.Array):
    """Words of each text: (document index of each word, flat array of the words)."""
    parts = pc.ascii_split_whitespace(text)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    return owner[full.to_numpy(zero_copy_only=False)], flat.filter(full)

"""Portable hash-derived numbers for splits, folds and permutations.

``md5`` of a salted key is computed the same way by Spark and by other SQL engines,
so an assignment made here can be recomputed elsewhere bit for bit, and it does not
depend on partitioning or task order (``randomSplit``/``rand`` do).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 60 bits of the digest: exact in a signed 64-bit integer and in a double-free ratio.
_HEX_DIGITS = 15
_SPACE = 16 ** _HEX_DIGITS


def hash_int(key, salt: str = "") -> Column:
    """Integer in [0, 16**15) from md5(salt || '|' || key)."""
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{salt}|"), k.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("long")


def hash_fraction(key, salt: str = "") -> Column:
    """Uniform-looking fraction in [0, 1)."""
    return hash_int(key, salt) / F.lit(float(_SPACE))


def hash_bucket(key, buckets: int, salt: str = "") -> Column:
    """Bucket in [0, buckets) (fold ids)."""
    return F.pmod(hash_int(key, salt), F.lit(buckets)).cast("int")


def sql_hash_int(key_sql: str, salt: str = "") -> str:
    """Same value as :func:`hash_int` in DuckDB SQL (for oracles)."""
    return (f"CAST(('0x' || substr(md5('{salt}|' || CAST({key_sql} AS VARCHAR)), 1, "
            f"{_HEX_DIGITS}))::UBIGINT AS BIGINT)")

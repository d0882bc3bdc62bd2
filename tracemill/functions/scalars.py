"""Column expressions of the cache model. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracemill.plans.config import PAGE


def shard_of(key: Column, shards: int) -> Column:
    """Shard of an integer key (or hash)."""
    return F.pmod(key, F.lit(shards))


def route(rows: DataFrame, shards: int, by: Column | None = None, key: str = "key") -> Column:
    """Shard of each row's key: by a given integer column (a hash of one's own), else by the key if that is an integer, else by its xxHash64."""
    if by is None:
        by = F.col(key) if isinstance(rows.schema[key].dataType, IntegralType) else F.xxhash64(key)
    return shard_of(by, shards).cast("int")


def shard_capacity(total: Column, shards: int, shard: Column) -> Column:
    """Capacity of a shard: the remainder of the division goes to the first shards, one each."""
    return F.floor(total / shards).cast("long") + (shard < total % shards).cast("long")


def aligned(size: Column, page: int = PAGE) -> Column:
    """Size rounded up to whole pages."""
    return (F.ceil(size / page) * page).cast("long")


def iops(size: Column, unit: int | None = None) -> Column:
    """Operations an I/O of ``size`` bytes counts as: 1, or one for each ``unit`` bytes begun."""
    return F.lit(1).cast("long") if unit is None else F.ceil(size / unit).cast("long")


def exponential_bucket(value: Column, base: float, buckets: int) -> Column:
    """Index of the first bound base * 2^i that is not below ``value``; ``buckets`` past the last."""
    i = F.greatest(F.lit(0), F.ceil(F.log2(value / base))).cast("int")
    return F.when(value <= base, 0).otherwise(F.least(i, F.lit(buckets)))


def linear_bucket(value: Column, width: float, buckets: int) -> Column:
    """Index of the first bound width * (i + 1) that is not below ``value``; ``buckets`` past the last."""
    return F.least(F.greatest(F.ceil(value / width) - 1, F.lit(0)), F.lit(buckets)).cast("int")


def entry_size(key_len: Column, value_len: Column) -> Column:
    """Bytes of a stored entry before alignment: a 36-byte header, the value, the key."""
    return key_len + value_len + 36


def size_between(size: Column, low: int | None = None, high: int | None = None) -> Column:
    """Half-open size range; None is unbounded."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (size >= low)
    if high is not None:
        ok = ok & (size < high)
    return ok


def checksum(data: Column) -> Column:
    """32-bit checksum of bytes, for portable comparison; ``xxhash64`` is the fast 64-bit one within Spark."""
    return F.crc32(data)

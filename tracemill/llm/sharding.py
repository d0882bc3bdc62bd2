"""Sharding: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import cut
from tracemill.operators.prefix import ranged, running


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1, as a long."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign(keys: DataFrame, order: list[str], shards: int = 8, size: str = "size") -> DataFrame:
    """Add ``shard`` and ``slot`` to rows with a positive ``size``, in ``order``.

    With T bytes in all, a row goes to the shard in whose T/shards bytes its
    middle falls, so each cut is off its target by half a row at most and
    shards are contiguous in ``order``. Slots count a shard's rows from 0.
    Equal keys and repeated rows are told apart by arrival; identical rows are
    interchangeable, so the rows of the result are fixed. Nulls sort first. An
    empty table gives an empty result. Other columns are kept; names that begin
    with an underscore are reserved.
    """
    parts = ranged(keys, order)
    total = parts.agg(F.sum(size)).first()[0] or 1
    at = running(parts, order, [], {"_before": F.col(size), "_rank": F.lit(1).cast("long")})
    # whole numbers of 38 digits and whole division: exact at any size
    at = at.withColumn("_middle", F.expr(f"CAST((CAST(_before AS DECIMAL(20,0)) * 2 + `{size}`) AS DECIMAL(30,0)) * {shards}")).withColumn("_total", F.lit(2 * total).cast("decimal(30,0)"))
    at = cut(at.withColumn("shard", F.least(F.lit(shards - 1), F.expr("_middle div _total")).cast("int")).drop("_middle", "_total"))
    starts = at.groupBy("shard").agg(F.min("_rank").alias("_start"))  # a row a shard
    return at.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_rank") - F.col("_start")).drop("_before", "_rank", "_start", "_tie", "_part")


def op8_sharding(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The contract's digest, by the law ``bytes``, contiguous by doc_id."""
    text = F.col("text").cast("string")
    keys = docs.select("doc_id", size_of(text).alias("size"), F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("text_crc32"))
    out = assign(keys, ["doc_id", "size", "text_crc32"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shards_of(docs: DataFrame, shards: int = 8) -> DataFrame:
    """What ``op8_sharding`` says of each row, and then all other columns of ``docs``, text included.

    Rows meet their places by id, size and checksum. Rows alike in these, as
    uses of one document are, take the places of their kind one each. Columns
    of ``docs`` that are named as one of the result's are left out; null ids,
    null texts and repeated rows have places like any other row.
    """
    key = lambda size, crc: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size, crc)
    text = F.col("text").cast("string")
    places = op8_sharding(docs, shards)
    numbered = places.withColumn("_key", key(F.col("size"), F.col("text_crc32"))).withColumn("_use", F.row_number().over(Window.partitionBy("_key").orderBy("shard", "slot")))
    rest = [c for c in docs.columns if c not in places.columns]
    rows = docs.select(*[F.col(c) for c in rest], key(size_of(text), F.crc32(F.coalesce(text.cast("binary"), F.lit(b"")))).alias("_key"))
    rows = rows.withColumn("_use", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    return numbered.join(rows, ["_key", "_use"]).select(*places.columns, *rest)


#: CRC-32 by its table, itself from the rule for polynomial 0xEDB88320 (eight shift steps an entry), since DuckDB has no such function.
OP8_SQL = """
WITH tbl AS (
  SELECT list(list_reduce([i] || range(8), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
k AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS text_crc32
  FROM documents, tbl),
s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS b,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS r, sum(size) OVER () AS total FROM k),
p AS (SELECT *, CAST(least(7, (2 * b + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(r - min(r) OVER (PARTITION BY shard) AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

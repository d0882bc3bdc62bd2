"""Request dedup and read-through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(requests: DataFrame, key: str, bucket: Column) -> DataFrame:
    """Of the requests of a key that are under way together (one ``bucket``), the first leads and fetches; the others wait."""
    first = requests.withColumn("_bucket", bucket)
    w = Window.partitionBy(key, "_bucket").orderBy("seq")
    return first.withColumn("role", F.when(F.row_number().over(w) == 1, "lead").otherwise("wait")).withColumnRenamed("_bucket", "bucket")


def resolved(requests: DataFrame, key: str, bucket: Column, inserts: Column) -> DataFrame:
    """As ``deduplicated``, with inserts among the requests (``inserts`` is true): role lead, wait, insert or hit, and ``resolved_by``.

    A request after an insert of its bucket hits it; those that are under way are
    resolved by the first insert that comes, whose seq is ``resolved_by`` (null:
    by the fetch of the lead).
    """
    rows = requests.withColumn("bucket", bucket).withColumn("_insert", F.when(inserts, F.col("seq")))
    w = Window.partitionBy(key, "bucket").orderBy("seq")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    role = F.when(inserts, "insert").when(F.min("_insert").over(before).isNotNull(), "hit").when(F.row_number().over(w) == 1, "lead").otherwise("wait")
    rows = rows.withColumn("role", role).withColumn("_next", F.min("_insert").over(after))
    return rows.withColumn("resolved_by", F.when(F.col("role").isin("lead", "wait"), F.col("_next"))).drop("_insert", "_next")


def read_through(requests: DataFrame, memory: DataFrame, disk: DataFrame, outer: DataFrame, key: str = "key") -> DataFrame:
    """Answer requests from memory, else disk, else the source: value and where it came from. Each store has one row a key."""
    def side(df, name):
        return df.select(F.col(key), F.col("value").alias(f"_{name}"))

    out = requests.join(side(memory, "m"), key, "left").join(side(disk, "d"), key, "left").join(side(outer, "o"), key, "left")
    source = F.when(F.col("_m").isNotNull(), "memory").when(F.col("_d").isNotNull(), "disk").when(F.col("_o").isNotNull(), "outer").otherwise("none")
    return out.withColumn("value", F.coalesce("_m", "_d", "_o")).withColumn("source", source).drop("_m", "_d", "_o")


def collision_checked(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Disk look-ups by hash that also compare keys: a different key under the same hash is a miss."""
    s = store.select(F.col("hash").alias("_h"), F.col("key").alias("_k"), "value")
    out = requests.join(s, F.col("hash") == F.col("_h"), "left")
    same = F.col("_k") == F.col("key")
    return out.select(*requests.columns, F.when(same, F.col("value")).alias("value"), F.coalesce(same, F.lit(False)).alias("hit"))


def may_contain(requests: DataFrame, index: DataFrame, key: str = "hash") -> DataFrame:
    """Requests whose hash the index knows (a collision may pass)."""
    return requests.join(index.select(key), key, "left_semi")

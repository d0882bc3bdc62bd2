"""Traces: ordered keyed operations from tables, CSV files and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a normalised trace.
TRACE = ("seq", "op", "key", "weight", "size", "hint", "location", "ts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_trace(events: DataFrame, reads_only: bool = False) -> DataFrame:
    """The events table as a trace: users are keys; views and clicks read through, purchases and signups insert, errors remove.

    With ``reads_only`` every event reads through.
    """
    kind = F.col("event_type")
    op = F.lit("get_or_fetch") if reads_only else F.when(kind == "error", "remove").when(kind.isin("purchase", "signup"), "insert").otherwise("get_or_fetch")
    return events.select(
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.col("user_id").alias("key"),
        F.lit(1).cast("long").alias("weight"),
        F.ceil("value").cast("long").alias("size"),
        F.when(kind.isin("view", "click"), "low").otherwise("normal").alias("hint"),
        F.when(kind == "signup", "in_mem").when(kind == "purchase", "on_disk").otherwise("default").alias("location"),
        "ts",
    )


def csv_trace(spark: SparkSession, path: str, column: int = 1) -> DataFrame:
    """Keys from one column of a CSV file with a header, in file order: one read-through access a line.

    The order is that of the file's offsets, so one file (not a set of files) is a trace.
    """
    raw = spark.read.csv(path, header=True)
    rows = raw.select(F.col(raw.columns[column]).alias("key"), F.monotonically_increasing_id().alias("seq"))
    return rows.select("seq", F.lit("get_or_fetch").alias("op"), "key", F.lit(1).cast("long").alias("weight"))


def combined(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several stores read as one, in order of the list; columns that one lacks are null there."""
    parts = [spark.read.parquet(p).withColumn("part", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: Items whose weights are summed in one task.
RUN = 10_000


def zipf_trace(spark: SparkSession, items: int, accesses: int, exponent: float, seed: int = 0, partitions: int = 8) -> DataFrame:
    """``accesses`` read-through accesses of keys 1..items with Zipf probabilities, by inversion of the cumulative weights.

    The cumulative weights (one number an item) are joined by range through a
    bucket of equal probability, so the trace itself is never sorted or collected.
    """
    ranks = spark.range(1, items + 1).select(F.col("id").alias("key"), (1 / F.pow("id", F.lit(exponent))).alias("w"), F.expr(f"id div {RUN}").alias("run"))
    # running sums inside runs of items, and over the runs' totals: one row for RUN items meets in a window
    runs = ranks.groupBy("run").agg(F.sum("w").alias("t"))
    before = runs.select("run", (F.sum("t").over(Window.orderBy("run")) - F.col("t")).alias("base"), F.sum("t").over(Window.partitionBy()).alias("total"))
    inside = F.sum("w").over(Window.partitionBy("run").orderBy("key"))
    cum = ranks.withColumn("in_run", inside).join(F.broadcast(before), "run").select("key", (F.col("base") + F.col("in_run") - F.col("w")).alias("lo"), (F.col("base") + F.col("in_run")).alias("hi"), "total")
    buckets = max(1, items)
    cum = cum.select("key", (F.col("lo") / F.col("total")).alias("lo"), F.when(F.col("key") == items, 1.0).otherwise(F.col("hi") / F.col("total")).alias("hi"))
    cum = cum.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1)))))
    draws = spark.range(0, accesses, 1, partitions).select(F.col("id").alias("seq"), F.rand(seed).alias("u")).withColumn("b", F.floor(F.col("u") * buckets))
    hit = (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
    # a range join by bucket: each bucket has the few items whose probability reaches into it
    return draws.join(cum, "b").where(hit).select("seq", F.lit("get_or_fetch").alias("op"), "key", F.lit(1).cast("long").alias("weight"))


def write_log(df: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    """Append-only sink with one of the three compressions."""
    df.write.mode(mode).option("compression", {"none": "uncompressed"}.get(compression, compression)).parquet(path)


def discard(df: DataFrame) -> None:
    """A device without data: the rows are computed and dropped."""
    df.write.format("noop").mode("overwrite").save()


def keyed(column: Column, kind: str) -> Column:
    """Look-up by an equivalent key type: the column cast to the key's type."""
    return column.cast(kind)

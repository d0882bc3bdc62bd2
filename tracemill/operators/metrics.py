"""Counters, gauges, histograms and latency analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.prefix import running_total

#: Percentiles of the latency analysis.
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999, "p99999": 0.99999}


def counters(log: DataFrame, by: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("n"))


def gauge(log: DataFrame, delta: Column, group: str, order: str = "seq") -> DataFrame:
    """Running value of a gauge in each group, by prefix sums over ranges, so that a group may be of any size."""
    return running_total(log, [order], [group], "gauge", delta.cast("long"))


def histogram(rows: DataFrame, bucket: Column, by: list[str]) -> DataFrame:
    return rows.withColumn("bucket", bucket).groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def latencies(rows: DataFrame, value: str, by: list[str], exact: bool = False) -> DataFrame:
    """Percentiles and maximum by group; approximate ones by a sketch of bounded size unless ``exact``."""
    pick = (lambda p: F.percentile(value, F.lit(p))) if exact else (lambda p: F.percentile_approx(value, p, F.lit(100_000)))
    return rows.groupBy(*by).agg(*[pick(p).alias(n) for n, p in PERCENTILES.items()], F.max(value).alias("max"))


def throughput(rows: DataFrame, by: list[str], size: str = "size", ts: str = "ts") -> DataFrame:
    """Operations and bytes a second over the span of each group."""
    seconds = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    return rows.groupBy(*by).agg(F.count("*").alias("ops"), F.sum(size).alias("bytes"), seconds.alias("seconds")).withColumn("iops", F.round(F.col("ops") / F.col("seconds"), 6)).withColumn("bytes_per_s", F.round(F.col("bytes") / F.col("seconds"), 6))


def slow(rows: DataFrame, duration: str, thresholds: dict[str, float], op: str = "op") -> DataFrame:
    """Operations over their threshold; operations without one are all kept."""
    limit = F.lit(None).cast("double")
    for name, t in thresholds.items():
        limit = F.when(F.col(op) == name, F.lit(float(t))).otherwise(limit)
    return rows.where(F.col(duration) > F.coalesce(limit, F.lit(0.0)))

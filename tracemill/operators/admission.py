"""Admission filters and throttles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import iops, size_between
from tracemill.operators.fold import ordered_fold
from tracemill.plans.config import Throttle


def admit_all() -> Column:
    return F.lit(True)


def reject_all() -> Column:
    return F.lit(False)


def estimated_size(size: Column, low: int | None = None, high: int | None = None) -> Column:
    return size_between(size, low, high)


def all_of(*conditions: Column) -> Column:
    """Admitted if every condition admits."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def verdict(rejected: list[Column], waits: list[Column]) -> Column:
    """reject if any condition rejects, else throttle with the sum of the waits if there is any, else admit."""
    wait = reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(0.0)) for w in waits], F.lit(0.0))
    no = reduce(lambda a, b: a | b, rejected, F.lit(False))
    return F.when(no, F.struct(F.lit("reject").alias("result"), F.lit(0.0).alias("wait"))).when(wait > 0, F.struct(F.lit("throttle").alias("result"), wait.alias("wait"))).otherwise(F.struct(F.lit("admit").alias("result"), F.lit(0.0).alias("wait")))


def token_bucket(rows: DataFrame, group: str, rate: float, cost: str = "cost", ts: str = "at_us") -> DataFrame:
    """Token bucket by event time: (group, seq, quota_us before, wait_us, throttled).

    The quota refills by rate a second up to one second's worth; each row takes
    its cost and may leave the quota below nothing. A row that finds it below
    is throttled and would have to wait quota / rate. Quotas are kept in whole
    millionths of the rate's unit, so that any engine gives the same numbers.
    """
    per_second = int(rate * 1_000_000)

    def start(_):
        return {"quota": per_second, "last": None}

    def step(s, row):
        g, seq, at, cost_ = row
        if s["last"] is not None:
            s["quota"] = min(per_second, s["quota"] + int((at - s["last"]) * rate))
        s["last"] = at
        quota = s["quota"]
        s["quota"] -= int(cost_) * 1_000_000
        yield g, seq, quota, max(0, -quota * 1_000_000 // per_second) if quota < 0 else 0, quota < 0

    return ordered_fold(rows.select(group, "seq", ts, cost), group, ["seq"], f"{group} int, seq long, quota long, wait_us long, throttled boolean", start, step)


def throttle(rows: DataFrame, group: str, limits: Throttle, direction: str = "read", size: str = "size", ts: str = "at_us") -> DataFrame:
    """Token buckets of bytes and of operations side by side: (group, seq, wait_us, throttled), the longer wait of the two.

    A limit of None or 0 never throttles.
    """
    buckets = [(getattr(limits, f"{direction}_throughput"), F.col(size)), (getattr(limits, f"{direction}_iops"), iops(F.col(size), limits.counter.unit))]
    out = rows.select(group, "seq", F.lit(0).cast("long").alias("wait_us"), F.lit(False).alias("throttled"))
    for rate, cost in buckets:
        if rate:
            one = token_bucket(rows.withColumn("cost", cost.cast("long")), group, rate, "cost", ts).select("seq", F.col("wait_us").alias("_w"), F.col("throttled").alias("_t"))
            out = out.join(one, "seq").select(group, "seq", F.greatest("wait_us", "_w").alias("wait_us"), (F.col("throttled") | F.col("_t")).alias("throttled"))
    return out

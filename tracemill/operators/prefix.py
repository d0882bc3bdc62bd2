"""Running totals over a whole table from per-partition totals, in DataFrame operations only.

The rows are dealt into ranges of the wanted order (a range is split inside
equal keys too, by a last tie-break on arrival, so no key can fill a task),
each range is summed, the few range totals are accumulated, and a running sum
inside each range is shifted by what stands before it. Nothing but the range
totals meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import cut


def ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` dealt into ranges of ``order``, numbered by ``_part`` and fixed by a checkpoint."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return cut(tied.repartitionByRange(n, *order, "_tie").withColumn("_part", F.spark_partition_id()))


def running(parts: DataFrame, order: list[str], group: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add, for each named column, its exclusive running sum in ``order`` within ``group``.

    ``parts`` comes from ``ranged`` by an order that begins with ``group``.
    """
    keyed = parts.withColumns({f"_v_{k}": v for k, v in sums.items()})
    totals = keyed.groupBy("_part", *group).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    across = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *[F.col(g).alias(f"_g_{g}") for g in group], *[F.coalesce(F.sum(f"_t_{k}").over(across), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part", *group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumns({f"_i_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
    on = local["_part"] == before["_part"]
    for g in group:
        on = on & local[g].eqNullSafe(before[f"_g_{g}"])
    joined = local.join(before, on, "left").drop(before["_part"])
    return joined.withColumns({k: F.col(f"_i_{k}") + F.col(f"_b_{k}") for k in sums}).drop(*[f"_g_{g}" for g in group], *[f"{p}{k}" for k in sums for p in ("_v_", "_i_", "_b_")])


def running_total(df: DataFrame, order: list[str], group: list[str], name: str, value: Column) -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` in ``order`` within ``group``; a group may be of any size."""
    keys = [*group, *order]
    at = running(ranged(df.withColumn("_value", value), keys), keys, group, {"_before": F.col("_value")})
    return at.withColumn(name, F.col("_before") + F.col("_value")).select(*df.columns, name)

import random
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.operators import replay
from tracemill.plans.config import Fifo, Lfu, Lru, MemoryConfig, S3Fifo, Sieve
from tracemill.operators.memory import MemoryShard
from tracemill.sources import traces
from tracemill.streaming import replay as online
from tracemill.streaming.replay import replay_stream, upsert_latest, windowed_counters


def test_csv_and_zipf(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("at,key\n" + "".join(f"{i},k{i % 3}\n" for i in range(9)))
    rows = traces.csv_trace(spark, str(path)).orderBy("seq").collect()
    assert [r["key"] for r in rows] == [f"k{i % 3}" for i in range(9)]
    z = traces.zipf_trace(spark, 50, 5000, 1.0, seed=3)
    counts = {r["key"]: r["count"] for r in z.groupBy("key").count().collect()}
    assert sum(counts.values()) == 5000 and counts[1] > counts[2] > counts[10]


def test_csv_to_hit_ratio(spark, tmp_path):
    """A trace file with keys that aren't numbers, to the hit ratios of several policies."""
    path = tmp_path / "t.csv"
    path.write_text("at,key\n" + "".join(f"{i},obj/{i * i % 13}\n" for i in range(200)) + "200,\n")
    trace = traces.csv_trace(spark, str(path))
    log = replay.replay(trace, MemoryConfig(6, 2, Fifo()))
    assert log.schema["key"].dataType.simpleString() == "string" and log.count() == 200
    ratio = replay.hit_ratio(log).collect()[0]
    many = {r["policy"]: r for r in replay.compare_policies(trace, 6, 2, {"fifo": Fifo(), "lru": Lru(1.0)}).collect()}
    assert ratio["accesses"] == 200 and 0 < ratio["hits"] == many["fifo"]["hits"] and many["lru"]["hits"] > 0
    assert {r["key"] for r in replay.leavings(trace, MemoryConfig(6, 2, Fifo())).select("key").collect()} <= {f"obj/{k}" for k in range(13)}
    dates = spark.range(40).select(F.col("id").alias("seq"), F.lit("get_or_fetch").alias("op"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("key"), F.lit(1).alias("weight"))
    assert replay.hit_ratio(replay.replay(dates, MemoryConfig(10, 2, Fifo()))).collect()[0]["hits"] == 35


@pytest.mark.parametrize("how", ["none", "zstd", "lz4"])
def test_log_round_trip(spark, tmp_path, how):
    df = spark.range(50).withColumn("value", F.md5(F.col("id").cast("string")))
    traces.write_log(df, f"{tmp_path}/{how}", how)
    assert sorted(spark.read.parquet(f"{tmp_path}/{how}").collect()) == sorted(df.collect())
    both = traces.combined(spark, [f"{tmp_path}/{how}"] * 2)
    assert both.count() == 100 and both.where("part = 1").count() == 50
    traces.discard(both)


@pytest.mark.parametrize("policy", [Fifo(), Lru(0.5), Lfu(), S3Fifo(), Sieve()], ids=lambda p: p.name)
def test_stream_equals_batch(spark, sf, tmp_path, policy):
    config = MemoryConfig(20, 4, policy)
    batch = traces.events_trace(traces.table(spark, sf, "events"))
    half = batch.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    batch.where(F.col("seq") <= half).coalesce(1).write.parquet(f"{tmp_path}/in")
    out, done = f"{tmp_path}/out", f"{tmp_path}/done"
    stream = replay_stream(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), config)

    def feed():
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", done).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)

    feed()
    batch.where(F.col("seq") > half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed()
    want = replay.replay(batch, config).select("seq", "result", "usage")
    assert sorted(spark.read.parquet(out).select("seq", "result", "usage").collect()) == sorted(want.collect())


class Value:
    """A state value without Spark."""

    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


@pytest.mark.parametrize("rows,limits", [(0, {}), (777, {}), (777, {"RUN": 10, "CHUNK": 3, "FAN": 2}), (60_000, {"RUN": 4000, "CHUNK": 500, "FAN": 4})])
def test_a_long_micro_batch_is_sorted_in_parts(monkeypatch, rows, limits):
    """Two micro-batches of a shard, the first out of order, the second with late rows, against a plain fold; memory and frames stay small."""
    for name, value in limits.items():
        monkeypatch.setattr(online, name, value, raising=False)
    ordered = [(7 * i + 3, random.Random(i).choice(["get_or_fetch", "insert", "remove"]), f"k{i * i % 41}", 1, "normal") for i in range(rows + 5)]
    state, want = MemoryShard(6, Fifo()), []
    for seq, op, key, weight, hint in ordered:
        done = replay.apply(state, op, key, weight, hint, False)
        want.append((0, seq, op, key, done.result, [k for reason, k, _ in done.left if reason == "evict"], state.usage, len(state.entries)))
    random.Random(1).shuffle(first := ordered[:rows])
    processor = online.ReplayProcessor(MemoryConfig(6, 1, Fifo()))
    processor.cache = Value()
    at, late, longest = 0, [], 0
    tracemalloc.start()
    base = tracemalloc.get_traced_memory()[0]
    for part in (first, ordered[rows:] + ordered[:2]):
        frames = (pd.DataFrame(part[i : i + 100], columns=["seq", "op", "key", "weight", "hint"]) for i in range(0, len(part), 100))
        for f in processor.handleInputRows((0,), frames, None) if part else ():
            longest = max(longest, len(f))
            for row in f.itertuples(index=False, name=None):
                if row[4] == "late":
                    late.append(row[1])
                else:
                    assert row == want[at]
                    at += 1
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert at == len(want) and late == [3, 10]
    assert peak < 6_000_000 and longest <= online.CHUNK
    with pytest.raises(ValueError):
        list(online.in_order([pd.DataFrame([(None, "get", 1, 1, "normal")], columns=online.COLUMNS)]))


def test_upserts_and_windows(spark, sf):
    a = spark.createDataFrame([(1, 5, "a"), (2, 7, "b")], "hash long, sequence long, v string")
    b = spark.createDataFrame([(1, 4, "late"), (2, 9, "new")], "hash long, sequence long, v string")
    assert sorted(upsert_latest(b, upsert_latest(a, None)).collect()) == [(1, 5, "a"), (2, 9, "new")]
    trace = traces.events_trace(traces.table(spark, sf, "events"))
    assert windowed_counters(trace).agg(F.sum("n")).first()[0] == trace.count()

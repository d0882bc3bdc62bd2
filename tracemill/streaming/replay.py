"""Online replay: the same state machines fed by Structured Streaming, one state a shard.

Rows of a micro-batch are sorted by sequence inside their shard; a row at or
below the last sequence seen is late and reported as such, since policies are
order-sensitive. Spark deals and sorts the rows by shard only, so a task sorts
them by sequence itself: in runs, through temporary files, as a shard's part of
a micro-batch may be of any length. The latest-version store accepts late rows
by the rule that a version replaces what is stored only if its sequence isn't
smaller.
"""

from __future__ import annotations

import heapq
import os
import pickle
import random
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import itemgetter
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracemill.functions.scalars import route
from tracemill.operators.memory import MemoryShard
from tracemill.operators.replay import apply, key_type
from tracemill.plans.config import MemoryConfig, split_capacity

LOG = "shard int, seq long, op string, key {key}, result string, evicted array<{key}>, usage long, entries long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a trace that a replay reads, the sequence first.
COLUMNS = ["seq", "op", "key", "weight", "hint"]
#: Rows sorted in memory, rows read from a file or handed out at once, and files merged at once.
RUN, CHUNK, FAN = 100_000, 5_000, 64


def _spilled(rows: Iterable[tuple]) -> BinaryIO:
    """The rows in a file without a name in one of Spark's local folders; it goes when it is closed."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
    file, rows = tempfile.TemporaryFile(dir=random.choice(folders) if folders else None), iter(rows)
    while chunk := list(islice(rows, CHUNK)):
        pickle.dump(chunk, file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)
    return file


def _read(file: BinaryIO) -> Iterator[tuple]:
    with file:
        while True:
            try:
                chunk = pickle.load(file)
            except EOFError:
                return
            yield from chunk


def in_order(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """The rows of all frames by sequence, rows of one sequence as they came.

    Sorted runs are spilled and merged, ``FAN`` of a level into one of the next,
    so that memory holds one run and a chunk of each open file.
    """
    seq = itemgetter(0)
    held: list[tuple] = []
    levels: list[list[BinaryIO]] = []
    for f in frames:
        if f["seq"].isna().any():
            raise ValueError("a row without a sequence")
        held.extend(f[COLUMNS].itertuples(index=False, name=None))
        if len(held) < RUN:
            continue
        held.sort(key=seq)
        new, held, level = _spilled(held), [], 0
        while new is not None:
            if level == len(levels):
                levels.append([])
            levels[level].append(new)
            new = None
            if len(levels[level]) == FAN:
                new, levels[level] = _spilled(heapq.merge(*map(_read, levels[level]), key=seq)), []
            level += 1
    held.sort(key=seq)
    files = [_read(file) for level in reversed(levels) for file in level]
    return heapq.merge(*files, held, key=seq) if files else iter(held)


class ReplayProcessor(StatefulProcessor):
    """Holds a shard's cache as one value of plain containers and the last sequence seen."""

    def __init__(self, config: MemoryConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cache = handle.getValueState("cache", "blob binary, last long")

    def handleInputRows(self, key, rows, timerValues):
        shard = int(key[0])
        if self.cache.exists():
            blob, last = self.cache.get()
            state = MemoryShard.restored(pickle.loads(bytes(blob)), self.config.policy)
        else:
            state, last = MemoryShard(split_capacity(self.config.capacity, self.config.shards)[shard], self.config.policy), -1
        out: list[tuple] = []
        for seq, op, k, weight, hint in in_order(rows):
            if len(out) == CHUNK:
                yield self._frame(out)
                out = []
            if seq <= last:
                out.append((shard, seq, op, k, "late", [], state.usage, len(state.entries)))
                continue
            last = seq
            done = apply(state, op, k, weight, hint, False)
            evicted = [key_ for reason, key_, _ in done.left if reason == "evict"]
            out.append((shard, seq, op, k, done.result, evicted, state.usage, len(state.entries)))
        self.cache.update((pickle.dumps(state.snapshot()), int(last)))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["shard", "seq", "op", "key", "result", "evicted", "usage", "entries"])

    def close(self) -> None:
        pass


def replay_stream(trace: DataFrame, config: MemoryConfig) -> DataFrame:
    """A streaming trace (seq, op, key, weight, hint) replayed; needs the RocksDB state store."""
    trace.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = trace.where("key IS NOT NULL").select(route(trace, config.shards).alias("shard"), "seq", "op", "key", F.col("weight").cast("long").alias("weight"), "hint")
    return rows.groupBy("shard").transformWithStateInPandas(ReplayProcessor(config), outputStructType=LOG.format(key=key_type(trace)), outputMode="Append", timeMode="None")


def windowed_counters(trace: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Operation counts by event-time window, with a watermark that bounds the state."""
    return trace.withWatermark("ts", late).groupBy(F.window("ts", every), "op").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def upsert_latest(batch: DataFrame, store: DataFrame | None) -> DataFrame:
    """For ``foreachBatch``: the store of latest versions after a batch of (hash, sequence, ...) rows; late rows lose."""
    from tracemill.operators.logstore import latest

    return latest(batch if store is None else store.unionByName(batch))

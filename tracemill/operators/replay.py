"""Replay of traces through in-memory caches, one independent fold a shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import route
from tracemill.operators.fold import ordered_fold
from tracemill.operators.memory import Entry, MemoryShard
from tracemill.plans.config import MemoryConfig, Policy, split_capacity

LOG = "shard int, seq long, op string, key {key}, result string, evicted array<{key}>, replaced boolean, usage long, entries long"


def key_type(trace: DataFrame) -> str:
    return trace.schema["key"].dataType.simpleString()


def sharded(trace: DataFrame, shards: int, weight: Column | None = None, phantom: Column | None = None, route_by: Column | None = None) -> DataFrame:
    """Only the columns a replay needs, with the shard: pruning can't reach through the fold. Rows without a key name nothing and are left out."""
    have = set(trace.columns)
    return trace.where("key IS NOT NULL").select(
        route(trace, shards, route_by).alias("shard"),
        "seq",
        "op",
        "key",
        (F.col("weight") if weight is None else weight).cast("long").alias("weight"),
        (F.col("hint") if "hint" in have else F.lit("normal")).alias("hint"),
        (F.lit(False) if phantom is None else phantom).alias("phantom"),
    )


def apply(shard: MemoryShard, op: str, key, weight: int, hint: str, phantom: bool):
    """Run one operation of a trace on a shard. ``touch`` only tells and, under LRU, pins; ``resize`` takes the weight as capacity."""
    if op == "get":
        return shard.get(key)
    if op == "touch":
        return shard.touch(key)
    if op == "get_or_fetch":
        found = shard.get(key)
        if found.result == "hit":
            return found
        left = shard.insert(key, Entry(int(weight), hint=hint), phantom).left
        found.left = left
        return found
    if op == "get_or_fail":  # the fetch of a miss fails: every waiter hears of it, nothing is cached
        found = shard.get(key)
        if found.result == "miss":
            found.result = "error"
        return found
    if op == "insert":
        return shard.insert(key, Entry(int(weight), hint=hint), phantom)
    if op == "contains":
        return shard.contains(key)
    if op == "remove":
        return shard.remove(key)
    if op == "clear":
        return shard.clear()
    if op in ("evict_all", "flush"):
        return shard.evict_all()
    if op == "resize":
        return shard.resize(int(weight))
    raise ValueError(f"unknown operation {op!r}")


def replay(trace: DataFrame, config: MemoryConfig, weight: Column | None = None, phantom: Column | None = None, route_by: Column | None = None) -> DataFrame:
    """A row for each operation of a trace (seq, op, key, weight and maybe hint): its result, what left, and usage after it.

    Keys are of any type; ``route_by`` is an integer column to deal them to shards by (see ``route``).
    """
    capacities = split_capacity(config.capacity, config.shards)

    def step(state: MemoryShard, row):
        shard, seq, op, key, w, hint, ph = row
        out = apply(state, op, key, w, hint, ph)
        evicted = [k for reason, k, _ in out.left if reason == "evict"]
        yield shard, seq, op, key, out.result, evicted, any(r == "replace" for r, _, _ in out.left), state.usage, len(state.entries)

    return ordered_fold(sharded(trace, config.shards, weight, phantom, route_by), "shard", ["seq"], LOG.format(key=key_type(trace)), lambda shard: MemoryShard(capacities[int(shard)], config.policy), step)


def leavings(trace: DataFrame, config: MemoryConfig) -> DataFrame:
    """What an event listener would hear: a row for each entry that left, with the reason."""
    capacities = split_capacity(config.capacity, config.shards)

    def step(state: MemoryShard, row):
        shard, seq, op, key, w, hint, ph = row
        for i, (reason, k, entry) in enumerate(apply(state, op, key, w, hint, ph).left):
            yield shard, seq, i, reason, k, entry.weight

    return ordered_fold(sharded(trace, config.shards), "shard", ["seq"], f"shard int, seq long, at int, reason string, key {key_type(trace)}, weight long", lambda shard: MemoryShard(capacities[int(shard)], config.policy), step)


def residual(trace: DataFrame, config: MemoryConfig) -> DataFrame:
    """What each shard holds after the trace: its lists, next victim first."""
    capacities = split_capacity(config.capacity, config.shards)

    def step(state: MemoryShard, row):
        apply(state, *row[2:])
        return ()

    def end(shard, state: MemoryShard):
        for name, keys in state.policy.dump().items():
            yield shard, name, ",".join(map(str, keys)), len(keys)

    return ordered_fold(sharded(trace, config.shards), "shard", ["seq"], "shard int, list string, keys string, n long", lambda shard: MemoryShard(capacities[int(shard)], config.policy), step, end)


def hit_ratio(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits, accesses and their ratio; operations that look nothing up do not count."""
    seen = log.where(F.col("result").isin("hit", "miss"))
    hits = F.count_if(F.col("result") == "hit")
    return seen.groupBy(*(by or [])).agg(hits.alias("hits"), F.count("*").alias("accesses"), F.round(hits / F.count("*"), 6).alias("hit_ratio"))


def compare_policies(trace: DataFrame, capacity: int, shards: int, policies: dict[str, Policy], without_hints: set[str] = frozenset()) -> DataFrame:
    """Hits, accesses and hit ratio of several policies over one trace: policy, hits, accesses, hit_ratio.

    The trace is dealt, sorted and read once; every shard feeds each policy's
    cache and hands out two numbers a policy. Policies in ``without_hints``
    take every entry as normal.
    """
    capacities = split_capacity(capacity, shards)

    def start(shard):
        return {name: [MemoryShard(capacities[int(shard)], c), 0, 0] for name, c in policies.items()}

    def step(states, row):
        _, _, op, key, w, hint, ph = row
        for name, state in states.items():
            result = apply(state[0], op, key, w, "normal" if name in without_hints else hint, ph).result
            state[1] += result == "hit"
            state[2] += result in ("hit", "miss")
        return ()

    def end(shard, states):
        for name, (_, hits, seen) in states.items():
            yield shard, name, hits, seen

    parts = ordered_fold(sharded(trace, shards), "shard", ["seq"], "shard int, policy string, hits long, accesses long", start, step, end)
    out = parts.groupBy("policy").agg(F.sum("hits").alias("hits"), F.sum("accesses").alias("accesses"))
    return out.withColumn("hit_ratio", F.round(F.col("hits") / F.col("accesses"), 6))

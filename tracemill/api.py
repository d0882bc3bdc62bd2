"""The public surface in one place.

>>> from tracemill import api
>>> log = api.replay(api.events_trace(events), api.MemoryConfig(capacity=1000, shards=64, policy=api.Sieve()))
>>> api.hit_ratio(log).show()
"""

from tracemill.functions.scalars import aligned, checksum, entry_size, exponential_bucket, iops, linear_bucket, route, shard_capacity, shard_of, size_between
from tracemill.operators.admission import admit_all, all_of, estimated_size, reject_all, throttle, token_bucket, verdict
from tracemill.operators.disk import BlockStore
from tracemill.operators.fetch import collision_checked, deduplicated, may_contain, read_through, resolved
from tracemill.operators.fold import ordered_fold
from tracemill.operators.hybrid import HybridShard, replay_hybrid
from tracemill.operators.logstore import compact, enqueued, footprint, intact, latest, live, next_sequence, pack, partial, pick, pick_by_age, pick_by_invalid_ratio, probation, recovered, tombstone_ring, without
from tracemill.operators.memory import Entry, MemoryShard
from tracemill.operators.metrics import counters, gauge, histogram, latencies, slow, throughput
from tracemill.operators.replay import compare_policies, hit_ratio, leavings, replay, residual
from tracemill.plans.config import BlockConfig, CacheBuilder, Fifo, HybridConfig, IopsCounter, Lfu, Lru, MemoryConfig, S3Fifo, Sieve, Throttle, split_capacity
from tracemill.sources.traces import combined, csv_trace, discard, events_trace, keyed, write_log, zipf_trace
from tracemill.streaming.replay import replay_stream, upsert_latest, windowed_counters

__all__ = [
    "aligned", "checksum", "entry_size", "exponential_bucket", "iops", "linear_bucket", "shard_capacity", "shard_of", "size_between",
    "admit_all", "all_of", "estimated_size", "reject_all", "route", "throttle", "token_bucket", "verdict",
    "BlockStore", "collision_checked", "deduplicated", "may_contain", "read_through", "resolved", "ordered_fold", "HybridShard", "replay_hybrid",
    "compact", "enqueued", "footprint", "intact", "latest", "live", "next_sequence", "pack", "partial", "pick", "pick_by_age", "pick_by_invalid_ratio", "probation", "recovered", "tombstone_ring", "without",
    "Entry", "MemoryShard", "counters", "gauge", "histogram", "latencies", "slow", "throughput",
    "compare_policies", "hit_ratio", "leavings", "replay", "residual",
    "BlockConfig", "CacheBuilder", "Fifo", "HybridConfig", "IopsCounter", "Lfu", "Lru", "MemoryConfig", "S3Fifo", "Sieve", "Throttle", "split_capacity",
    "combined", "csv_trace", "discard", "events_trace", "keyed", "write_log", "zipf_trace", "replay_stream", "upsert_latest", "windowed_counters",
]

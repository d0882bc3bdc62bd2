"""Configuration of a replay: plain dataclasses, validated on construction."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

#: Enumerations of the data model. Fixed values.
HINTS = ("normal", "low")
LOCATIONS = ("default", "in_mem", "on_disk")
AGES = ("fresh", "young", "old")
SOURCES = ("outer", "memory", "disk")
EVENTS = ("evict", "replace", "remove", "clear")
WRITE_POLICIES = ("write_on_eviction", "write_on_insertion")
RECOVER_MODES = ("none", "quiet", "strict")
COMPRESSIONS = ("none", "zstd", "lz4")
PICKERS = ("invalid_ratio", "fifo")
PAGE = 4096


def _ratio(name: str, value: float) -> None:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must be in [0, 1], is {value}")


@dataclass(frozen=True)
class Fifo:
    name: str = "fifo"


@dataclass(frozen=True)
class Lru:
    high_priority_pool_ratio: float = 0.9
    name: str = "lru"

    def __post_init__(self):
        _ratio("high_priority_pool_ratio", self.high_priority_pool_ratio)


@dataclass(frozen=True)
class Lfu:
    window_ratio: float = 0.1
    protected_ratio: float = 0.8
    epsilon: float = 0.001
    confidence: float = 0.9
    sketch: bool = False
    name: str = "lfu"

    def __post_init__(self):
        if not (0 < self.window_ratio < 1 and 0 < self.protected_ratio < 1 and self.window_ratio + self.protected_ratio < 1):
            raise ValueError("window and protected ratios must be in (0, 1), together below 1")
        if not (0 < self.epsilon and 0 < self.confidence < 1):
            raise ValueError("epsilon must be positive and confidence in (0, 1)")

    @property
    def width(self) -> int:
        """Updates between two agings of the frequencies, and counters in a row of their sketch."""
        return math.ceil(2 / self.epsilon)

    @property
    def depth(self) -> int:
        """Rows of the sketch."""
        return max(1, math.ceil(-math.log2(1 - self.confidence)))


@dataclass(frozen=True)
class S3Fifo:
    small_ratio: float = 0.1
    ghost_ratio: float = 1.0
    threshold: int = 1
    name: str = "s3fifo"

    def __post_init__(self):
        _ratio("small_ratio", self.small_ratio)
        if self.ghost_ratio < 0:
            raise ValueError("ghost_ratio must not be negative")


@dataclass(frozen=True)
class Sieve:
    name: str = "sieve"


Policy = Fifo | Lru | Lfu | S3Fifo | Sieve


def split_capacity(total: int, shards: int) -> list[int]:
    """Capacity of each shard: the remainder goes to the first ones, one each."""
    return [total // shards + (i < total % shards) for i in range(shards)]


@dataclass(frozen=True)
class MemoryConfig:
    """An in-memory cache: total capacity, shards and eviction policy."""

    capacity: int
    shards: int = 8
    policy: Policy = field(default_factory=Lru)

    def __post_init__(self):
        if self.shards < 1 or self.capacity < 0:
            raise ValueError("a cache needs a shard and a capacity that isn't negative")


@dataclass(frozen=True)
class IopsCounter:
    """How many operations an I/O counts as: 1, or one for each ``unit`` bytes begun."""

    unit: int | None = None

    def __post_init__(self):
        if self.unit is not None and self.unit < 1:
            raise ValueError("the unit must be positive")

    def count(self, size: int) -> int:
        return 1 if self.unit is None else -(-size // self.unit)

    def __str__(self) -> str:
        return "PerIo" if self.unit is None else f"PerIoSize({self.unit})"

    @classmethod
    def parse(cls, text: str) -> IopsCounter:
        text = text.strip()
        if text == "PerIo":
            return cls()
        if text.startswith("PerIoSize(") and text.endswith(")"):
            return cls(int(text[len("PerIoSize(") : -1].strip()))
        raise ValueError(f"not an operation counter: {text!r}")


@dataclass(frozen=True)
class Throttle:
    """Rates a second; None or 0: unlimited."""

    write_iops: int | None = None
    read_iops: int | None = None
    write_throughput: int | None = None
    read_throughput: int | None = None
    counter: IopsCounter = field(default_factory=IopsCounter)


@dataclass(frozen=True)
class BlockConfig:
    """A log-structured block store of so many blocks, or, where ``blocks`` is None, of as many as it takes: it then loses nothing.

    A picker is the name of a built-in one or a function of the store that gives
    the id of one of its ``evictable`` blocks, or None to leave it to the next.
    ``reinsert`` says which keys survive the reclaiming of their block: "none",
    "all" or "old" (those that were on probation).
    """

    blocks: int | None = 4
    block_size: int = 16 << 20
    index_size: int = PAGE
    clean_threshold: int = 1
    probation_ratio: float = 0.1
    invalid_ratio: float = 0.8
    pickers: tuple = ("invalid_ratio", "fifo")
    reinsert: str = "none"
    tombstone_log: bool = False
    compression: str = "none"
    recover_mode: str = "quiet"

    def __post_init__(self):
        _ratio("probation_ratio", self.probation_ratio)
        unknown = [p for p in self.pickers if p not in PICKERS and not callable(p)]
        if unknown:
            raise ValueError(f"unknown pickers {unknown}: one of {PICKERS} or a function of the store")
        if self.compression not in COMPRESSIONS or self.recover_mode not in RECOVER_MODES:
            raise ValueError("unknown compression or recover mode")
        if self.reinsert not in ("none", "all", "old"):
            raise ValueError(f"unknown reinsertion rule {self.reinsert!r}")

    @property
    def index_entries(self) -> int:
        """Entries that a blob's index page can name: 24 bytes each after a 12-byte head."""
        return (self.index_size - 12) // 24


@dataclass(frozen=True)
class HybridConfig:
    memory: MemoryConfig
    disk: BlockConfig | None = None
    policy: str = "write_on_eviction"
    flush_on_close: bool = True

    def __post_init__(self):
        if self.policy not in WRITE_POLICIES:
            raise ValueError(f"unknown write policy {self.policy!r}")

    @property
    def is_hybrid(self) -> bool:
        return self.disk is not None


class CacheBuilder:
    """Step-by-step construction of a ``HybridConfig``: general, then memory, then storage options."""

    def __init__(self):
        self._options = {"policy": "write_on_eviction", "flush_on_close": True}
        self._memory = MemoryConfig(capacity=0)
        self._disk: BlockConfig | None = None

    def with_policy(self, policy: str) -> CacheBuilder:
        self._options["policy"] = policy
        return self

    def with_flush_on_close(self, flush: bool) -> CacheBuilder:
        self._options["flush_on_close"] = flush
        return self

    def memory(self, capacity: int, **options) -> CacheBuilder:
        self._memory = replace(self._memory, capacity=capacity, **options)
        return self

    def storage(self, **options) -> CacheBuilder:
        self._disk = replace(self._disk or BlockConfig(), **options)
        return self

    def build(self) -> HybridConfig:
        return HybridConfig(memory=self._memory, disk=self._disk, **self._options)

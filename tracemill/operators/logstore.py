"""The log-structured store as tables: versions, tombstones, recovery, packing, pickers. DataFrame operations except for packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import aligned
from tracemill.operators.fold import ordered_fold
from tracemill.operators.prefix import running_total
from tracemill.plans.config import BlockConfig


def latest(log: DataFrame, key: str = "hash", sequence: str = "sequence") -> DataFrame:
    """The latest version of each key: a maximum of whole rows, combined map-side, so a hot key never fills a task.

    Rows of one key and sequence are told apart by their other columns, the greatest wins.
    """
    rest = [c for c in log.columns if c not in (key, sequence)]
    best = log.groupBy(key).agg(F.max(F.struct(sequence, *rest)).alias("_best"))
    return best.select(key, "_best.*").select(*log.columns)


def live(log: DataFrame, key: str = "hash", sequence: str = "sequence", tombstone: str = "is_tombstone") -> DataFrame:
    """Latest versions that no tombstone of the same or a later sequence hides."""
    return latest(log, key, sequence).where(~F.col(tombstone))


def recovered(entries: DataFrame, tombstones: DataFrame, mode: str = "quiet") -> DataFrame:
    """The index after a restart: (hash, sequence, block) of live entries.

    A block is read up to where its sequence falls (what follows is left over
    from before). ``none`` reads nothing; ``strict`` raises if a block has such
    a fall; then the latest version wins and a tombstone at least as late hides it.
    """
    if mode == "none":
        return entries.limit(0).select("hash", "sequence", "block")
    good = before_drop(entries)
    if mode == "strict" and not good.where("NOT valid").isEmpty():
        raise ValueError("a block's sequence falls")
    dead = tombstones.groupBy("hash").agg(F.max("sequence").alias("_dead"))
    best = latest(good.where("valid").select("hash", "sequence", "block"))
    return best.join(dead, "hash", "left").where(F.col("_dead").isNull() | (F.col("sequence") > F.col("_dead"))).select("hash", "sequence", "block")


def before_drop(entries: DataFrame) -> DataFrame:
    """Add ``valid``: whether no sequence has fallen up to this entry of its block (ordered by offset)."""
    w = Window.partitionBy("block").orderBy("offset")
    fall = (F.col("sequence") < F.lag("sequence").over(w)).cast("int")
    return entries.withColumn("_fall", F.coalesce(fall, F.lit(0))).withColumn("valid", F.sum("_fall").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("_fall")


def without(index: DataFrame, removals: DataFrame) -> DataFrame:
    """Index entries but those with a removal of the same hash at their sequence or a later one."""
    latest_removal = removals.groupBy(F.col("hash").alias("_h")).agg(F.max("sequence").alias("_s"))
    return index.join(latest_removal, (F.col("hash") == F.col("_h")) & (F.col("_s") >= F.col("sequence")), "left_anti")


def next_sequence(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).alias("next_sequence"))


def pack(entries: DataFrame, config: BlockConfig, group: str = "flusher", oversize: str = "drop") -> DataFrame:
    """Place each flusher's entries (hash, sequence, size) into blobs and blocks, first come, first served.

    A blob begins with its index page; it ends when its index is full or its
    block is, and an entry that doesn't fit opens the next block. Entries larger
    than a block are dropped, or, with ``oversize="alone"``, each has a block to
    itself that runs over. -> flusher, sequence, hash, block, blob, offset, len
    """
    if oversize not in ("drop", "alone"):
        raise ValueError(f"unknown rule for entries larger than a block: {oversize!r}")
    room, head, most = config.block_size, config.index_size, config.index_entries

    def start(_):
        return {"block": 0, "blob": 0, "blob_at": 0, "used": head, "count": 0}

    def step(s, row):
        flusher, sequence, hash_, size = row
        size = -(-size // 4096) * 4096
        if head + size > room and oversize == "drop":
            return
        if s["count"] == most:
            s.update(blob=s["blob"] + 1, blob_at=s["blob_at"] + s["used"], used=head, count=0)
        if s["blob_at"] + s["used"] + size > room:
            s.update(block=s["block"] + 1, blob=0, blob_at=0, used=head, count=0)
        yield flusher, sequence, hash_, s["block"], s["blob"], s["blob_at"] + s["used"], size
        s["used"] += size
        s["count"] += 1

    rows = entries.select(group, "sequence", "hash", "size")
    return ordered_fold(rows, group, ["sequence"], f"{group} int, sequence long, hash long, block long, blob long, offset long, len long", start, step)


def pick_by_invalid_ratio(blocks: DataFrame, block_size: int, threshold: float = 0.8) -> DataFrame:
    """The evictable block with the most invalid bytes, if they are at least the threshold's part of a block. Ties: the greater id."""
    best = blocks.where("evictable").agg(F.max(F.struct("invalid", "block")).alias("b")).select("b.block", "b.invalid")
    return best.where(F.col("invalid") / block_size >= threshold)


def pick_by_age(blocks: DataFrame) -> DataFrame:
    """The block that became evictable first."""
    return blocks.where("evictable").agg(F.min(F.struct("since", "block")).alias("b")).where("b IS NOT NULL").select("b.block")


def pick(blocks: DataFrame, block_size: int, threshold: float = 0.8) -> DataFrame:
    """The first picker that answers: invalid ratio, then age. -> block, picker"""
    ratio = pick_by_invalid_ratio(blocks, block_size, threshold).select("block", F.lit("invalid_ratio").alias("picker"), F.lit(0).alias("_o"))
    age = pick_by_age(blocks).select("block", F.lit("fifo").alias("picker"), F.lit(1).alias("_o"))
    best = ratio.union(age).agg(F.min(F.struct("_o", "block", "picker")).alias("b"))
    return best.where("b IS NOT NULL").select("b.block", "b.picker")


def probation(blocks: DataFrame, total: int, clean: int, ratio: float = 0.1) -> DataFrame:
    """The oldest evictable blocks marked as probation: floor(total * ratio) less the clean ones."""
    marks = max(0, int(total * ratio) - clean)
    return blocks.where("evictable").orderBy("since", "block").limit(marks).select("block")


def compact(entries: DataFrame, victim: DataFrame, readmit: Column) -> tuple[DataFrame, DataFrame]:
    """Reclaim blocks: (entries to write again, those that leave the index), of the victim's live entries."""
    inside = entries.join(victim.select("block"), "block", "left_semi")
    return inside.where(readmit), inside.where(~readmit)


def footprint(entries: DataFrame, group: str) -> DataFrame:
    """Bytes used and reserved by group, and how well pages are filled."""
    used, held = F.sum("size"), F.sum(aligned(F.col("size")))
    return entries.groupBy(group).agg(used.alias("used"), held.alias("reserved"), F.round(used / held, 6).alias("efficiency"))


def partial(entries: DataFrame, capacity: int, group: str) -> DataFrame:
    """A view of each group's store that ends where its pages would exceed ``capacity``, in sequence order."""
    return running_total(entries, ["sequence"], [group], "_end", aligned(F.col("size"))).where(F.col("_end") <= capacity).drop("_end")


def intact(entries: DataFrame, stored: str = "checksum", key: str = "key", value: str = "value") -> DataFrame:
    """Entries whose value and key still have their stored checksum; others read as absent. A null key or value counts as empty."""
    both = F.concat(F.coalesce(F.col(value), F.lit("")), F.coalesce(F.col(key), F.lit("")))
    return entries.where(F.crc32(both) == F.col(stored))


def enqueued(entries: DataFrame, window: Column, threshold: int, flushers: int = 1) -> DataFrame:
    """Add ``accepted`` and ``flusher``: entries (hash, sequence, size) that come while more than ``threshold`` bytes wait are dropped.

    What a flusher was given in a ``window`` waits until the window's end. An
    entry is accepted as long as what stands before it is within the threshold;
    dropped entries wait too, so that one running sum decides.
    """
    rows = entries.withColumn("flusher", F.pmod("hash", F.lit(flushers)).cast("int")).withColumn("_window", window)
    before = F.sum("size").over(Window.partitionBy("flusher", "_window").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("accepted", F.coalesce(before, F.lit(0)) <= threshold).drop("_window")


def tombstone_ring(tombstones: DataFrame, slots: int, number: str = "number") -> DataFrame:
    """What a log of ``slots`` tombstones still holds: of those that fall into one slot (number modulo slots) the latest, and its slot."""
    rows = tombstones.withColumn("slot", F.pmod(number, F.lit(slots)))
    return latest(rows, "slot", number)

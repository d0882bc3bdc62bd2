"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima (combined map-side) and two joins; nothing is
collected but one (count, checksum) pair a round, and no node's neighbours are
gathered into one row, so a hub of any degree is only a skewed join key that
adaptive execution may split. As soon as no more than FEW edges are left, by
count, one task settles them at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut, tight


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


#: Edges that one task settles in memory, 16 bytes each.
FEW = 500_000


def _settled(e: DataFrame) -> DataFrame:
    """(node, root) of at most FEW edges."""

    def run(batches):
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        a, b = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while len(i):
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, root[i], low)
            np.minimum.at(new, root[j], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["node", "root"])

    return e.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (node, root): each node that isn't its component's least, with that least node.

    Self loops, repeated edges and nulls are ignored. The result is whole when
    a round changes nothing; ``max_rounds`` only guards against a defect and
    raises instead of returning a partial answer.
    """
    e = cut(edges.select("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark["n"] <= FEW:
            return cut(_settled(e))
        if seen == tuple(mark):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(mark)
        e = tight(cut(_small_star(_large_star(e))))
    raise RuntimeError("components did not settle")

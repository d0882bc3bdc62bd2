"""Ordered folds over groups of rows: the one imperative building block of replays.

Rows are dealt by group, sorted by group and order (Spark's external sort, so a
group of any length spills instead of filling memory) and streamed through a
state machine; a task holds one group's state and one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, group: str, order: list[str], schema: str, start: Callable[[object], object], step: Callable[[object, tuple], Iterator[tuple]], end: Callable[[object, object], Iterator[tuple]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Fold each group of ``df`` in order.

    ``start(group value)`` makes a group's state, ``step(state, row)`` yields
    output rows for an input row (a tuple of ``columns``, group first), and
    ``end(group value, state)`` yields rows after its last one.
    """
    columns = columns or [group, *[c for c in df.columns if c != group]]
    names = [f.split()[0].strip("`") for f in _fields(schema)]
    kinds = dict(zip(names, (f.split(None, 1)[1] for f in _fields(schema))))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        for n, kind in kinds.items():
            if kind in ("long", "bigint", "int"):
                out[n] = out[n].astype("Int64" if kind != "int" else "Int32")
        return out

    def run(frames):
        state, current, begun = None, None, False
        for f in frames:
            out: list[tuple] = []
            for row in f.itertuples(index=False, name=None):
                if not begun or row[0] != current:
                    if begun and end is not None:
                        out.extend(end(current, state))
                    current, begun = row[0], True
                    state = start(current)
                out.extend(step(state, row))
            if out:
                yield frame(out)
        if begun and end is not None and (last := list(end(current, state))):
            yield frame(last)

    return df.select(*columns).repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]

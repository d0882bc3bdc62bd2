"""Small helpers of the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import cut  # noqa: F401  (re-exported)

#: Spark/Java regex for the characters that separate words: space and the controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether labels of a row are reserved: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def slices(batches, rows: int = 1000):
    """Arrow batches in pieces of ``rows``, so that only so many texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def keep_rows(docs: DataFrame, text_col: str, decide) -> DataFrame:
    """The rows of ``docs``, unchanged, for which ``decide`` (texts -> booleans) says yes, scored where they lie."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(decide(b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Rows up to which a narrow side of a join is sent to every task.
SMALL_ROWS = 1_000_000


def small(side: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it has at most ``rows`` rows, by count; else as it is, for a shuffled join.

    Meant for materialised sides of a few fixed-width columns.
    """
    n = side.limit(rows + 1).count()
    return F.broadcast(side.coalesce(max(1, n // 50_000))) if n <= rows else side


def tight(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A materialised table in no more partitions than its rows need: what is made of a small one is then no flood of small tasks and files."""
    return df.coalesce(max(1, -(-df.count() // rows)))

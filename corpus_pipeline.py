"""The corpus pipeline: quality, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All stages keep extra
columns and take empty tables, empty and very long texts, ties and repeated
rows; null texts count as empty, and rows without an id are never dropped for
being copies. What each does with such rows is said at its operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import decontaminate, mixing, quality, sharding, simhash
from tracemill.llm.common import table
from tracemill.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.7 or more).

    Null and empty texts are scored by their measures, rows that share an id or
    text alike; an empty table, or one without a labelled good document, gives
    an empty result.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id.

    Null and empty texts are one group; rows without an id can't be named and
    stay; of rows with one id and equal words one stays; an empty table gives
    an empty result.
    """
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as rows without an id do; repeated
    rows are judged alike; an empty benchmark or table takes nothing away.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources uses it, once at least.

    Null and empty texts count one token; a null source is a source of its own;
    rows without an id and repeated rows are used like others; an empty table
    gives an empty result.
    """
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every use of a document with its shard and slot, its text and other columns.

    Null texts have one byte; null ids sort first; equal rows take neighbouring
    slots; an empty table gives an empty result; columns named as one of the
    result's are left out.
    """
    return sharding.shards_of(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier and the similarity search can't be put in SQL; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    The last stage's files are the result and stay; the others are deleted as
    soon as they were read, and all of them if a stage fails.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _delete(spark, f"{folder}/{k - 1}")
    except BaseException:
        _delete(spark, folder)
        raise
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

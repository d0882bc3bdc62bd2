"""Queries of the training-data operators over the whole tables, and their SQL."""

from __future__ import annotations

from tracemill.llm import ann, decontaminate, licenses, lines, mixing, quality, sharding, simhash, substrings, toxicity
from tracemill.llm.common import table

QUERIES = {
    "op1_line_dedup": lambda spark, d: lines.op1_line_dedup(table(spark, d, "documents")),
    "op2_simhash": lambda spark, d: simhash.op2_simhash(table(spark, d, "documents")),
    "op4_substring": lambda spark, d: substrings.op4_substring(table(spark, d, "documents")),
    "op9_mixing": lambda spark, d: mixing.op9_mixing(table(spark, d, "documents")),
    "op8_sharding": lambda spark, d: sharding.op8_sharding(table(spark, d, "documents")),
    "op10_quality": lambda spark, d: quality.op10_quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_toxicity": lambda spark, d: toxicity.op7_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_licenses": lambda spark, d: licenses.op5_licenses(table(spark, d, "documents")),
    "op6_decontamination": lambda spark, d: decontaminate.op6_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op3_ann": lambda spark, d: ann.op3_ann(table(spark, d, "embeddings")),
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": lines.OP1_SQL,
    "op4_substring": substrings.OP4_SQL,
    "op8_sharding": sharding.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
}

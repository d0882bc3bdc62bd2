"""Results don't depend on whether a narrow side was small enough to be broadcast."""

from collections import Counter

from tracemill.llm import common, lines, mixing, simhash
from tracemill.llm.common import table


def test_shuffled_and_broadcast_joins_agree(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")

    def results():
        rows = lambda df: Counter(map(tuple, df.collect()))
        return [rows(lines.op1_line_dedup(docs)), rows(mixing.op9_mixing(docs)), rows(mixing.mixed(docs)), rows(simhash.one_of_each(docs))]

    with_broadcast = results()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert results() == with_broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

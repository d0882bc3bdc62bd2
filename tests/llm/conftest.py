import glob
import os

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, t string, line string, score double, k long, full int, end int, tokens string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with clashing extra columns from (doc_id, text, source) rows."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 7, "x", "y", 0.5, 1, 2, 3, "z") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(60))
    return docs_of(
        [
            (1, None, "a"),
            (2, "", None),
            (3, " \n\t ", "a"),
            (4, long_text, "b"),
            (5, long_text + " end", "b"),
            (6, passage, "a"),
            (6, passage, "a"),
            (7, "Prefix words here " + passage + " and a tail", None),
            (None, "no id but some text that is long enough", "a"),
            (None, None, None),
            (8, "no id but some text that is long enough", "a"),
            (9, "é ñ 日本語 \U0001f600 text", "c"),
            (10, "one", "c"),
        ]
    )


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)] + [(3, 1, 1), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c

"""Every registered query of the engine against its SQL, at the smallest size."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from engram.plans.queries import ORACLES, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(pdf):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{x:.5f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(value, row)) for row in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        expected = duck.sql(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert plain(found) == plain(expected)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_memory_errors_of_documents_without_words(spark, tmp_path):
    """A text that ends with its number loses the blank behind it with its markup; its tokens count the whole text."""
    texts = ["", "!!! ***", None, "---\n", "the end", "in the end", "an der wand", "a", "你好"]
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert plain(QUERIES["memory_errors"](spark, str(tmp_path)).toPandas()) == plain(c.sql(ORACLES["memory_errors"]).df())

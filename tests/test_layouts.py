"""Queries agree with their SQL on tables that are folders of files, with very short, blank and missing texts."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests import oracle


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs = [(i, f"text {i % 50}", "en", "web") for i in range(80)] + [(80, "ab", "en", "web"), (81, " ", "fr", "web"), (82, None, "fr", "web")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").repartition(3).write.parquet(
        str(root / "documents.parquet")
    )
    labels = [(i, i % 3 % 2) for i in range(0, 83)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(root / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet/*.parquet'")
    return con, str(root)


@pytest.mark.parametrize("name", ["source_file", "analyze"])
def test_agrees_with_sql(spark, tables, name):
    con, root = tables
    assert oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], root) is None

"""Registered queries over the smallest tables; those with SQL against DuckDB."""

import os

import pytest

from stratalode.llm import queries
from tests.test_queries import SF, compare, duck  # noqa: F401


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op1_decontamination",)])
def test_one_row_a_document(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.QUERIES[name](spark, SF).count() == n


def test_registered():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in __spark_entry__.queries()} and "pipeline" in __spark_entry__.queries()

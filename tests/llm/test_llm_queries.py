"""Registered queries beside their SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from firmlens.llm.oracle import ORACLE
from firmlens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    db = compare.connect(SF_DIR)
    assert compare.differences(spark, db, QUERIES[name], ORACLE[name], SF_DIR) == []

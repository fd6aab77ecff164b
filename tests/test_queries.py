"""Every registered query beside its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from firmlens.schemas import RESULT_SCHEMA
from workload.oracle import ORACLE
from workload.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    query, sql = QUERIES[name], ORACLE[name]
    assert compare.differences(spark, db, query, sql, SF_DIR) == []


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["company_id", *RESULT_SCHEMA.names]
    assert result.count() == spark.read.parquet(f"{SF_DIR}/customer.parquet").count()


@pytest.mark.parametrize("name", ["enrich_companies", "enrich_by_rules", "corpus_search"])
def test_result_does_not_depend_on_partitions(spark, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            seen.append(sorted(map(repr, entry.queries()[name](spark, SF_DIR).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]

"""Summary counts over result rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total_companies"),
        F.count_if(F.col("erp_system") != "").alias("with_erp"),
        F.count_if(F.col("annual_revenue") != "").alias("with_revenue"),
    )


def _value_counts(results: DataFrame, name: str) -> DataFrame:
    counts = results.where(F.col(name) != "").groupBy(name).agg(F.count("*").alias("n_companies"))
    return counts.orderBy(F.desc("n_companies"), name)


def erp_top(results: DataFrame, count: int = 5) -> DataFrame:
    """Most frequent ERP systems; ties in name order."""
    return _value_counts(results, "erp_system").limit(count)


def revenue_range_counts(results: DataFrame) -> DataFrame:
    return _value_counts(results, "revenue_range")

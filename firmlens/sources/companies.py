"""Company tables: CSV files or lake tables, mapped to one schema."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut
from firmlens.functions.text import strip
from firmlens.schemas import NA_VALUES


def read_companies(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw company rows of a ``.csv`` file (every column text) or a Parquet table.

    ``multi_line`` reads cells with line breaks; such a file cannot be split among tasks.
    """
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
    if path.endswith((".xlsx", ".xls")):
        raise ValueError("Excel workbooks are not read here; export the sheet as CSV")
    return spark.read.parquet(path)


def preview(companies: DataFrame, rows: int = 5) -> DataFrame:
    return companies.limit(rows)


def require_column(df: DataFrame, name: str = "company_name") -> None:
    """Stop with a message that lists the columns when a required one is absent."""
    if name not in df.columns:
        raise ValueError(
            f"Required column '{name}' not found; available columns: {', '.join(df.columns)}"
        )


def _cell(name: str | None) -> Column:
    """A stripped text cell; ``""`` when the column is absent or holds a null marker."""
    if name is None:
        return F.lit("")
    value = F.col(f"`{name}`").cast("string")
    value = F.when(~value.isin(*NA_VALUES), value)
    return F.coalesce(strip(value), F.lit(""))


def map_companies(
    df: DataFrame,
    company: str | None = None,
    location: str | None = None,
    industry: str | None = None,
    company_id: str | None = None,
) -> DataFrame:
    """Choose and normalise the columns: ``company_id, company_name, location, industry``.

    Without a choice the name comes from ``company_name``, else the first column.
    A missing name becomes ``""`` and later an error row, so no company is lost.
    Without ``company_id`` every row gets a number of its own, which is written to
    the checkpoint folder once so that it cannot change when a task is repeated.
    """
    if company is None:
        company = "company_name" if "company_name" in df.columns else df.columns[0]
    for name in (company, location, industry, company_id):
        if name is not None:
            require_column(df, name)
    key = F.monotonically_increasing_id() if company_id is None else F.col(f"`{company_id}`")
    mapped = df.select(
        key.alias("company_id"),
        _cell(company).alias("company_name"),
        _cell(location).alias("location"),
        _cell(industry).alias("industry"),
    )
    return cut(mapped) if company_id is None else mapped


def standard_companies(df: DataFrame, company_id: str | None = None) -> DataFrame:
    """Company table with the fixed names; location and industry may be absent."""
    require_column(df)
    return map_companies(
        df,
        "company_name",
        "location" if "location" in df.columns else None,
        "industry" if "industry" in df.columns else None,
        company_id,
    )

"""Result rows, one per company whatever happened to it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions import strict_json
from firmlens.schemas import (
    ERROR_PREFIX,
    EXTRACTION_FIELDS,
    MISSING_NAME_ERROR,
    NO_CONTENT_NOTES,
    RESULT_SCHEMA,
)


def parse_extractions(responses: DataFrame) -> DataFrame:
    """Strictly validated extraction responses: ``error`` (null when valid) and 8 fields."""
    record = strict_json.extraction_record(F.col("raw"))
    return responses.select("company_id", record.alias("record")).select("company_id", "record.*")


def build_results(
    companies: DataFrame,
    sources: DataFrame,
    extracted: DataFrame,
    with_content: DataFrame | None = None,
    error_prefix: str = ERROR_PREFIX,
) -> DataFrame:
    """``company_id`` and the twelve result columns for every input company.

    ``sources``: company_id, sources_found. ``extracted``: company_id, error, 8
    fields. ``with_content``: the companies that have any readable page; without it
    those in ``extracted``. Each has one row per company at most. Error rows report
    confidence 0 and no sources.
    """
    mark = F.lit(True).alias("_read")
    joined = companies.join(sources, "company_id", "left")
    if with_content is None:
        joined = joined.join(extracted.select("*", mark), "company_id", "left")
    else:
        joined = joined.join(with_content.select("company_id", mark), "company_id", "left").join(
            extracted, "company_id", "left"
        )
    read = F.col("_read").isNotNull()
    error = F.when(F.col("company_name") == "", F.lit(MISSING_NAME_ERROR)).when(
        read,
        F.coalesce(
            F.col("error"),
            F.when(F.col("erp_confidence").isNull(), F.lit("no extraction response")),
        ),
    )
    failed, usable = error.isNotNull(), error.isNull() & read

    def field(name: str, kind: str) -> Column:
        if kind == "int":
            return F.when(failed, 0).when(usable, F.col(name)).otherwise(1)
        value = F.when(usable, F.col(name))
        if name == "notes":
            value = F.when(failed, F.concat(F.lit(error_prefix), error)).when(
                usable, F.col(name)
            ).otherwise(F.lit(NO_CONTENT_NOTES))
        return value

    columns = {name: field(name, kind) for name, kind in EXTRACTION_FIELDS.items()}
    columns["sources_found"] = F.when(failed, 0).otherwise(
        F.coalesce(F.col("sources_found"), F.lit(0))
    )
    return joined.select(
        "company_id",
        *[
            columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in RESULT_SCHEMA.fields
        ],
    )


def error_rows(results: DataFrame) -> DataFrame:
    """Result rows of companies whose processing failed; only those have confidence 0."""
    return results.where((F.col("erp_confidence") == 0) & (F.col("sources_found") == 0))

"""Column types shared by the operators.

Everything is declared; nothing is inferred from data.
"""

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------

# Texts that a company file uses for "no value".
NA_VALUES = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

NO_TITLE = "No Title"
NO_SNIPPET = "No description available"

HITS_PER_SEARCH = 8
LINKS_PER_SEARCH = 3
MIN_LINK_SCORE = 6

REVENUE = "revenue"
ERP = "ERP"

REVENUE_RANGES = ("Under $1M", "$1M-$10M", "$10M-$50M", "$50M-$100M", "$100M+")

PAGE_SEPARATOR = "\n\n---\n\n"
LINK_SEPARATOR = "\n\n"

NO_CONTENT_NOTES = "No content could be scraped from search results"
ERROR_PREFIX = "Error during processing: "
ERROR_PREFIX_FORM = "Error: "

RESULT_BASENAME = "erp_revenue_results"

# --- end of fixed values ----------------------------------------------------

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("company_name", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("erp_system", T.StringType()),
        T.StructField("erp_confidence", T.IntegerType()),
        T.StructField("annual_revenue", T.StringType()),
        T.StructField("revenue_confidence", T.IntegerType()),
        T.StructField("revenue_range", T.StringType()),
        T.StructField("company_size", T.StringType()),
        T.StructField("business_type", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("sources_found", T.IntegerType()),
    ]
)

# Fields of an extraction record, in output order: name -> Spark type.
EXTRACTION_FIELDS = {
    "erp_system": "string",
    "erp_confidence": "int",
    "annual_revenue": "string",
    "revenue_confidence": "int",
    "revenue_range": "string",
    "company_size": "string",
    "business_type": "string",
    "notes": "string",
}

MISSING_NAME_ERROR = "company name is missing"

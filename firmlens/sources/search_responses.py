"""Raw search API responses: ``company_id, search_type, raw``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.schemas import NO_SNIPPET, NO_TITLE


def read_responses(spark: SparkSession, path: str, id_type: str = "BIGINT") -> DataFrame:
    """JSON lines, one object per request with the response text in ``raw``.

    ``id_type`` is the type of ``company_id``; a value that does not fit it, or a line that
    is not JSON, stops the read.
    """
    schema = f"company_id {id_type}, search_type STRING, raw STRING"
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def search_hits(responses: DataFrame) -> DataFrame:
    """Links of the ``organic`` list of each response, in order.

    A response that is not JSON, has no list, or holds an item that is not an
    object gives no rows. Absent or null keys get the default texts.
    """
    items = F.try_variant_get(
        F.try_parse_json(F.col("raw")), "$.organic", "array<map<string,variant>>"
    )

    items = F.when(F.forall(items, lambda item: item.isNotNull()), items)

    def field(name: str, default: str):
        value = F.try_variant_get(F.col("item")[name], "$", "string")
        return F.coalesce(value, F.lit(default))

    return responses.select(
        "company_id", "search_type", F.posexplode(items).alias("pos", "item")
    ).select(
        "company_id",
        "search_type",
        "pos",
        field("title", NO_TITLE).alias("title"),
        field("link", "").alias("url"),
        field("snippet", NO_SNIPPET).alias("snippet"),
    )

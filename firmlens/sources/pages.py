"""Page tables: ``url, html``, one row per url."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("url", "html")


def newest_pages(crawl: DataFrame, fetched_at: str) -> DataFrame:
    """One page per url from a crawl that holds several fetches of the same url.

    Fetches that share the newest time are told apart by their text.
    """
    newest = F.max_by("html", F.struct(F.col(fetched_at), F.col("html")))
    return crawl.groupBy("url").agg(newest.alias("html"))


def save_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Store pages bucketed by url, so that looking pages up never shuffles html.

    Take at least as many buckets as the session has shuffle partitions, with a few
    hundred MB in each; the lookup by url then moves only the (small) link side.
    """
    pages.write.bucketBy(buckets, "url").sortBy("url").saveAsTable(table)

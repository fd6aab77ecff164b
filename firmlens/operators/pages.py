"""Page text of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.joins import SALTS, fan_out_join
from firmlens.functions.markdown import markdown
from firmlens.schemas import PAGE_SEPARATOR


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    return pages.select("url", markdown(F.col("html")).alias("markdown"))


def link_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the text of their page; ``""`` when the page is missing or failed.

    Only linked pages are converted, each of them once.
    """
    joined = fan_out_join(
        links,
        pages.select("url", "html"),
        "url",
        ["company_id"],
        prepare=lambda found: found.select("url", SALTS, markdown(F.col("html")).alias("markdown")),
    )
    return joined.withColumn("markdown", F.coalesce("markdown", F.lit("")))


def combined_content(linked: DataFrame) -> DataFrame:
    """All page texts of a company in link order, as one text.

    ``linked``: deduplicated links with ``markdown``. A company has at most three
    links per search and so a handful of pages. Blank pages are left out.
    """
    # The test for blank pages sits in the aggregate: as a filter it would move down
    # to the scan and convert every page a second time.
    page = F.when(F.trim("markdown") != "", F.struct("type_ord", "rank", "markdown"))
    pages = linked.groupBy("company_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return pages.where(F.size("pages") > 0).select(
        "company_id", F.array_join("pages.markdown", PAGE_SEPARATOR).alias("content")
    )


def readable_companies(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Companies with at least one linked page that has text.

    The test is a column and not a filter, which would move down to the scan and
    convert every page there is.
    """
    readable = (markdown(F.col("html")) != "").alias("readable")
    joined = fan_out_join(
        links.select("company_id", "url"),
        pages.select("url", "html"),
        "url",
        ["company_id"],
        prepare=lambda found: found.select("url", SALTS, readable),
        how="inner",
    )
    return (
        joined.groupBy("company_id")
        .agg(F.bool_or("readable").alias("readable"))
        .where("readable")
        .select("company_id")
    )

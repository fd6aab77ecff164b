"""Prompt tables for a model that the user supplies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions import prompts as P
from firmlens.functions.rubric import kind_of_search
from firmlens.operators.curate import REQUEST
from firmlens.schemas import LINK_SEPARATOR


def link_prompts(links: DataFrame, companies: DataFrame) -> DataFrame:
    """One scoring prompt per request that has links: ``company_id, search_type, prompt``.

    A model reads the links of a request together, so they become one text: bound the hits of
    a request (``HITS_PER_SEARCH``) where a search may return any number.
    """
    item = F.concat(
        F.lit("URL: "), "url", F.lit("\nTitle: "), "title", F.lit("\nSnippet: "), "snippet"
    )
    items = F.sort_array(F.collect_list(F.struct("pos", item.alias("item"))))
    blocks = links.groupBy(*REQUEST).agg(
        F.array_join(items["item"], LINK_SEPARATOR).alias("links")
    )
    company, listed = F.col("company_name"), F.col("links")
    prompt = F.when(
        kind_of_search(F.col("search_type")) == "revenue",
        P.render(P.REVENUE_LINKS_PROMPT, company=company, links=listed),
    ).otherwise(P.render(P.ERP_LINKS_PROMPT, company=company, links=listed))
    return blocks.join(companies.select("company_id", "company_name"), "company_id").select(
        *REQUEST, prompt.alias("prompt")
    )


def extract_prompts(contents: DataFrame, companies: DataFrame) -> DataFrame:
    """One extraction prompt per company that has content."""
    prompt = P.render(P.EXTRACTION_PROMPT, company=F.col("company_name"), content=F.col("content"))
    return contents.join(companies.select("company_id", "company_name"), "company_id").select(
        "company_id", prompt.alias("prompt")
    )

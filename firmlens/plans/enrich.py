"""The whole enrichment: companies and search hits in, one result row each out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut
from firmlens.operators import curate, extract, pages, prompts, results, score_links
from firmlens.operators.inference import infer
from firmlens.schemas import ERROR_PREFIX


def curated_by_rules(links: DataFrame) -> DataFrame:
    """Deduplicated links of all companies, scored by rules, each url of a search once."""
    rated = score_links.rate_links(curate.first_links(links))
    return curate.dedup_links(curate.curate_rated(rated))


def enrich_by_rules(
    companies: DataFrame,
    links: DataFrame,
    page_table: DataFrame,
    lexicons: extract.Lexicons | None = None,
    error_prefix: str = ERROR_PREFIX,
) -> DataFrame:
    """Results from rule scoring and rule extraction.

    The curated links (a handful per company) are a stage result: they are written
    to the checkpoint folder once and read three times.
    """
    chosen = cut(curated_by_rules(links))
    records = extract.extract(chosen, page_table, companies, lexicons)
    return results.build_results(
        companies, curate.sources_found(chosen), records, error_prefix=error_prefix
    )


def enrich_with_responses(
    companies: DataFrame,
    links: DataFrame,
    score_responses: DataFrame,
    page_table: DataFrame,
    extraction_responses: DataFrame,
    error_prefix: str = ERROR_PREFIX,
) -> DataFrame:
    """Results from model responses that lie in tables already."""
    chosen = cut(curate.dedup_links(curate.curate_with_responses(links, score_responses)))
    # Which pages have text is all that is asked here, so no text moves.
    readable = pages.readable_companies(chosen, page_table)
    return results.build_results(
        companies,
        curate.sources_found(chosen),
        results.parse_extractions(extraction_responses),
        readable,
        error_prefix,
    )


def enrich_with_model(
    companies: DataFrame, links: DataFrame, page_table: DataFrame, make_client,
    error_prefix: str = ERROR_PREFIX,
) -> DataFrame:
    """Results from a model client that the user supplies.

    The model is asked only about requests with links and companies with content.
    Answers are written to the checkpoint folder, so no call is made twice because
    a later step reads them again.
    """
    score_prompts = prompts.link_prompts(links, companies)
    scores = cut(infer(score_prompts, make_client, curate.REQUEST))
    chosen = cut(curate.dedup_links(curate.curate_with_responses(links, scores)))
    contents = pages.combined_content(pages.link_pages(chosen, page_table))
    answers = cut(infer(prompts.extract_prompts(contents, companies), make_client, ["company_id"]))
    return results.build_results(
        companies,
        curate.sources_found(chosen),
        results.parse_extractions(answers),
        error_prefix=error_prefix,
    )

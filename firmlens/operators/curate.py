"""From scored search hits to the links worth reading.

``links``: company_id, search_type, pos (from 0), title, url, snippet.
``responses``: company_id, search_type, raw (at most one per request).
``scores``: company_id, search_type, scored_pos, url, score, reason.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import rubric, strict_json
from firmlens.functions.lineage import cut
from firmlens.schemas import LINKS_PER_SEARCH, MIN_LINK_SCORE, REVENUE

REQUEST = ["company_id", "search_type"]


def parse_scores(responses: DataFrame) -> DataFrame:
    """Strictly validated curation responses: ``valid`` flag and ``scored_links``."""
    read = responses.withColumn("scored_links", strict_json.scored_links(F.col("raw")))
    return read.select(*REQUEST, F.col("scored_links").isNotNull().alias("valid"), "scored_links")


def scores_of(parsed: DataFrame) -> DataFrame:
    """Score rows of the valid responses, in the order of the response.

    With the bare column Spark would filter by its size, before it is made, and so read every
    response twice.
    """
    listed = F.coalesce("scored_links", F.array().cast(parsed.schema["scored_links"].dataType))
    return parsed.select(
        *REQUEST, F.posexplode(listed).alias("scored_pos", "link")
    ).select(*REQUEST, "scored_pos", "link.url", "link.score", "link.reason")


def _best(scores: DataFrame, keys: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "scored_pos")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def top_scored(scores: DataFrame, count: int = LINKS_PER_SEARCH) -> DataFrame:
    """Best scores of each request with their reasons, before any threshold."""
    return _best(scores, REQUEST, count)


def first_links(links: DataFrame) -> DataFrame:
    """The first link per request and url; shrinks map-side."""
    first = F.min(F.struct("pos", "title", "snippet")).alias("hit")
    return links.groupBy(*REQUEST, "url").agg(first).select(
        *REQUEST, "hit.pos", "hit.title", "url", "hit.snippet"
    )


def curate_links(
    links: DataFrame,
    scores: DataFrame,
    min_score: int = MIN_LINK_SCORE,
    count: int = LINKS_PER_SEARCH,
) -> DataFrame:
    """Best links of each request: high enough score, and really among the links.

    Ties keep the order of the scores. A url scored twice takes two places. Both
    sides shrink before they move: links to the first position per url, scores to
    the ``count`` best per url, which are all that can reach the first places.
    """
    best_per_url = _best(scores.where(F.col("score") >= min_score), [*REQUEST, "url"], count)
    matched = best_per_url.drop("rank").join(first_links(links), [*REQUEST, "url"])
    return _best(matched, REQUEST, count).select(*REQUEST, "rank", "pos", "title", "url", "snippet")


def curate_rated(
    rated: DataFrame, min_score: int = MIN_LINK_SCORE, count: int = LINKS_PER_SEARCH
) -> DataFrame:
    """Best links of each request when the links carry their scores already.

    The lowest score is asked for after ranking, which it does not change. Before, it would
    move down to the links, and every rule that makes the score would run twice.
    """
    best = _best(rated.withColumn("scored_pos", F.col("pos")), REQUEST, count)
    return best.where(F.col("score") >= min_score).select(*REQUEST, "rank", "pos", "title", "url", "snippet")


def fallback_links(
    links: DataFrame, valid_requests: DataFrame, count: int = LINKS_PER_SEARCH
) -> DataFrame:
    """First links, unfiltered, of requests without a valid scoring."""
    first = links.where(F.col("pos") < count)
    return first.join(valid_requests.select(*REQUEST), REQUEST, "left_anti").select(
        *REQUEST, (F.col("pos") + 1).alias("rank"), "pos", "title", "url", "snippet"
    )


def curate_with_responses(links: DataFrame, responses: DataFrame) -> DataFrame:
    """Curated links of all requests: scored ones, or the fallback where scoring failed."""
    # Read once, for the scores and for the requests that have none.
    parsed = cut(parse_scores(responses))
    scored = curate_links(links, scores_of(parsed))
    return scored.unionByName(fallback_links(links, parsed.where("valid")))


def curated_counts(curated: DataFrame) -> DataFrame:
    return curated.groupBy(*REQUEST).agg(F.count("*").alias("n_links"))


def dedup_links(curated: DataFrame) -> DataFrame:
    """One row per company and url, the first in the order revenue, ERP, rank.

    The minimum of an ordered struct is a plain aggregate, so it shrinks map-side.
    """
    place = F.struct(
        F.when(rubric.kind_of_search(F.col("search_type")) == REVENUE, 0).otherwise(1).alias("type_ord"),
        "rank",
        "search_type",
        "title",
        "snippet",
    )
    return (
        curated.where(F.col("url") != "")
        .groupBy("company_id", "url")
        .agg(F.min(place).alias("kept"))
        .select(
            "company_id",
            "kept.search_type",
            "kept.type_ord",
            "kept.rank",
            "kept.title",
            "url",
            "kept.snippet",
        )
    )


def sources_found(links: DataFrame) -> DataFrame:
    return links.groupBy("company_id").agg(F.count("*").cast("int").alias("sources_found"))

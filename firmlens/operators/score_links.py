"""Rule scoring of links, in place of a model."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions import rubric
from firmlens.functions import text as X
from firmlens.functions.lineage import cut
from firmlens.operators.curate import REQUEST


def rate_links(links: DataFrame) -> DataFrame:
    """Links with ``score`` and ``reason`` by the rubric of their search type. No shuffle.

    A text is searched once, for the terms of all rules; the rules are asked of what was found.
    Each step is a column of its own, so that nothing runs twice per link.
    """
    found = F.col("_found")
    is_revenue = rubric.kind_of_search(F.col("search_type")) == "revenue"
    revenue_useful, revenue_unwanted = rubric.categories(found, "revenue")
    erp_useful, erp_unwanted = rubric.categories(found, "erp")
    text, terms = X.padded(F.concat_ws(" ", "title", "snippet", "url")), rubric.vocabulary()
    read = links.withColumn("_text", text).withColumn("_found", X.vocabulary_hits(F.col("_text"), terms))
    tested = read.withColumns(
        {
            "_useful": F.array_compact(F.when(is_revenue, revenue_useful).otherwise(erp_useful)),
            "_unwanted": F.array_compact(
                F.when(is_revenue, revenue_unwanted).otherwise(erp_unwanted)
            ),
            "_credible": X.hit_any(found, rubric.CREDIBLE, terms),
            "_gated": X.hit_any(found, rubric.GATED, terms),
        }
    )
    score = rubric.link_score(
        F.size("_useful"), F.size("_unwanted"), F.col("_credible"), F.col("_gated")
    )
    reason = F.concat_ws(
        ", ",
        "_useful",
        "_unwanted",
        F.when(F.col("_credible"), F.lit("credible source")),
        F.when(F.col("_gated"), F.lit("gated")),
    )
    return tested.select(*links.columns, score.alias("score"), reason.alias("reason"))


def score_links(links: DataFrame) -> DataFrame:
    """Score rows of all links, as a model's response would give them."""
    return rate_links(links).select(
        *REQUEST, F.col("pos").alias("scored_pos"), "url", "score", "reason"
    )


BROADCAST_TERMS = 100_000


def _few(terms: DataFrame) -> bool:
    return terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def lexicon_matches(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Occurrences of each lexicon term per text: ``key, category, term, n``.

    ``lexicon`` holds ``category, term``. This is the way for lexicons too long for a
    pattern: the texts are cut into phrases of as many words as the lexicon's terms have,
    and joined with the terms. Counting comes first, so a phrase that fills a text moves
    once per text. The lexicon is written first, which tells Spark its size and this
    function the widths of its terms (a job).
    """
    parts = X.tokens(F.col("term"))
    terms = cut(
        lexicon.select("category", "term", F.array_join(parts, " ").alias("phrase"), F.size(parts).alias("width"))
    )
    widths = [r["width"] for r in terms.select("width").distinct().collect() if r["width"] > 0] or [1]
    words = F.col("_words")
    starts = F.sequence(F.lit(1), F.size(words))

    # Words are taken one by one: a slice would read the whole text for every phrase.
    def phrase(at: Column, width: int) -> Column:
        return F.when(
            at + width - 1 <= F.size(words), F.concat_ws(" ", *(F.get(words, at - 1 + n) for n in range(width)))
        )

    phrases = F.flatten(F.transform(starts, lambda at: F.array(*(phrase(at, width) for width in widths))))
    said = (
        texts.select(key, X.tokens(F.col(text)).alias("_words"))
        .where(F.size("_words") > 0)
        .select(key, F.explode(phrases).alias("phrase"))
        .where("phrase IS NOT NULL")
    )
    # Where the terms are few enough to be broadcast, what is no term never moves.
    if _few(terms):
        said = said.join(F.broadcast(terms.select("phrase").distinct()), "phrase", "left_semi")
    counted = said.groupBy(key, "phrase").agg(F.count("*").alias("n"))
    return counted.join(terms, "phrase").select(key, "category", "term", "n")

"""Search with required phrases: parts of a query in double quotes must occur as they stand.

``Acme "ERP" "annual report"`` ranks, by tf-idf of all its words, the documents that have the
word ``erp`` and the words ``annual report`` side by side. Postings carry positions; a phrase
is looked up from its rarest word, whose documents are met by the other words one by one, and
positions shifted by their place in the phrase must coincide. A phrase is matched once for all
queries that ask for it, and a set of phrases once for all that ask for the set.

Requirements that few documents meet give the candidates themselves. Where many do, a query is
split as in ``corpus_search``: documents with one of its rare words, and one list of the best
documents by its frequent words among those that meet the requirements, shared by all queries
that have both in common. So the result is exact, and queries do not meet documents in pairs.

Quotes without a partner and quotes around no word are ignored. A query without phrases ranks
all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.joins import fan_out_join
from firmlens.functions.lineage import cut
from firmlens.functions.text import tokens
from firmlens.operators import corpus_search as C
from firmlens.operators.search_index import SearchIndex
from firmlens.schemas import HITS_PER_SEARCH

QUOTED = '"([^"]*)"'


def query_parts(queries: DataFrame) -> DataFrame:
    """``query_id, words, phrases, word_set``: distinct words, and phrases as words with a blank
    between them; equal pairs of both share a key."""
    quoted = F.transform(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1)), lambda q: F.array_join(tokens(q), " "))
    return queries.select(
        "query_id",
        F.array_sort(F.array_distinct(tokens(F.col("text")))).alias("words"),
        F.array_sort(F.array_distinct(F.filter(quoted, lambda p: p != ""))).alias("phrases"),
    ).withColumn("word_set", F.md5(F.concat(F.array_join("words", " "), F.lit("|"), F.array_join("phrases", "|"))))


def phrase_documents(phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """``phrase, doc_id`` of all documents that have a phrase. ``phrases``: distinct ``phrase``;
    ``postings``: doc_id, term, positions of all their words."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    placed = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "term"))
    # A word that no document has leaves its phrase without a match.
    known = placed.join(df, "term", "left")
    rarest = F.min_by(F.struct("at", "term"), F.struct(F.coalesce("df", F.lit(0)), "at"))
    leads = cut(
        known.groupBy("phrase")
        .agg(rarest.alias("lead"), F.collect_list(F.struct("at", "term")).alias("others"))
        .select("phrase", "lead.term", F.col("lead.at").alias("lead_at"), F.filter("others", lambda o: o["at"] != F.col("lead.at")).alias("others"))
    )
    shifted = lambda by: F.transform("positions", lambda p: p - F.col(by))
    # The rarest word's documents; a word may lead many phrases and be in many documents.
    leading = postings.join(leads.select("term").distinct(), "term", "left_semi")
    starts = fan_out_join(leading, leads, "term", ["doc_id"], how="inner").select(
        "phrase", "doc_id", shifted("lead_at").alias("starts"), "others"
    )
    starts = cut(starts)
    alone = starts.where(F.size("others") == 0).select("phrase", "doc_id")
    longer = starts.where(F.size("others") > 0).select("phrase", "doc_id", "starts", F.size("others").alias("n"), F.inline("others"))
    met = longer.join(postings.select("doc_id", "term", "positions"), ["doc_id", "term"]).select(
        "phrase", "doc_id", "n", F.array_intersect("starts", shifted("at")).alias("starts")
    )
    # Every word of the phrase is at its place: as many lists as words, and a start in all of them.
    both = met.where(F.size("starts") > 0).groupBy("phrase", "doc_id").agg(F.max("n").alias("n"), F.collect_list("starts").alias("lists"))
    common = F.aggregate("lists", F.col("lists")[0], lambda a, x: F.array_intersect(a, x))
    whole = both.where((F.size("lists") == F.col("n")) & (F.size(common) > 0)).select("phrase", "doc_id")
    return alone.unionByName(whole)


def _meeting(needs: DataFrame, found: DataFrame) -> DataFrame:
    """``need, doc_id`` of the documents that have all phrases of a set (``need, phrases``)."""
    df = found.groupBy("phrase").agg(F.count("*").alias("df"))
    each = needs.select("need", F.explode("phrases").alias("phrase")).join(df, "phrase", "left")
    rarest = F.min_by("phrase", F.struct(F.coalesce("df", F.lit(0)), "phrase"))
    leads = each.groupBy("need").agg(rarest.alias("phrase"), F.collect_list("phrase").alias("all"))
    leads = cut(leads.select("need", "phrase", F.filter("all", lambda p: p != F.col("phrase")).alias("others")))
    leading = found.join(leads.select("phrase").distinct(), "phrase", "left_semi")
    first = cut(fan_out_join(leading, leads, "phrase", ["doc_id"], how="inner").select("need", "doc_id", "others"))
    alone = first.where(F.size("others") == 0).select("need", "doc_id")
    more = first.where(F.size("others") > 0).select("need", "doc_id", F.size("others").alias("n"), F.explode("others").alias("phrase"))
    met = more.join(found, ["phrase", "doc_id"], "left_semi").groupBy("need", "doc_id").agg(F.max("n").alias("n"), F.count("*").alias("met"))
    return alone.unionByName(met.where("n = met").select("need", "doc_id"))


def _required(sets: DataFrame, postings: DataFrame, weights: DataFrame, parts: DataFrame, count: int) -> DataFrame:
    """Hits of sets with phrases: ``word_set, rank, doc_id, score``."""
    key = F.md5(F.array_join("phrases", "|"))
    sets = cut(sets.withColumn("need", key))
    phrases = sets.select(F.explode("phrases").alias("phrase")).distinct()
    found = cut(phrase_documents(phrases, postings))
    docs = cut(_meeting(sets.select("need", "phrases").distinct(), found))
    few = cut(docs.groupBy("need").agg((F.count("*") <= C.FREQUENT * count).alias("few")))
    sets = cut(sets.join(few, "need"))  # a set that no document meets has no hits

    # Few documents meet the requirements: all of them.
    narrow = fan_out_join(
        sets.where("few").select("word_set", "need"), docs.join(few.where("few"), "need", "left_semi"), "need", ["word_set"], how="inner"
    ).select("word_set", "doc_id")
    # Many do: those with a rare word of the query, and the list for its frequent ones.
    wide = sets.where(~F.col("few"))
    frequent = F.col("df") > C.FREQUENT * count
    words = cut(wide.select("word_set", "need", F.explode("words").alias("term")).join(weights, "term").withColumn("frequent", frequent))
    rare = fan_out_join(
        words.where(~F.col("frequent")).select("word_set", "need", "term"), parts.where(~frequent).select("term", "doc_id"), "term", ["word_set"], how="inner"
    )
    of_words = rare.join(docs, ["need", "doc_id"], "left_semi").select("word_set", "doc_id")
    shared = (
        words.where("frequent")
        .groupBy("word_set", "need")
        .agg(F.array_sort(F.collect_list("term")).alias("common"))
        .withColumn("subset", F.md5(F.concat_ws("|", "need", F.array_join("common", " "))))
    )
    subsets = cut(shared.select(F.col("subset").alias("word_set"), "need", F.col("common").alias("words")).distinct())
    pairs = fan_out_join(docs, subsets.select("need", "word_set"), "need", ["doc_id"], how="inner").select("word_set", "doc_id")
    lists = C._ranked(cut(pairs), subsets.select("word_set", "words"), parts, count)
    of_lists = fan_out_join(
        shared.select("word_set", "subset"), cut(lists.select(F.col("word_set").alias("subset"), "doc_id")), "subset", ["word_set"], how="inner"
    ).select("word_set", "doc_id")
    candidates = cut(narrow.unionByName(of_words).unionByName(of_lists).distinct())
    return C._ranked(candidates, sets.select("word_set", "words"), parts, count)


def phrase_search(queries: DataFrame, index: SearchIndex, count: int = HITS_PER_SEARCH) -> DataFrame:
    """Top documents per query: ``query_id, rank, doc_id, score``; ``queries``: query_id, text."""
    named = cut(query_parts(queries))
    sets = named.select("word_set", "words", "phrases").distinct()
    postings = cut(index.postings(sets.select(F.explode("words").alias("term")).distinct()))
    n_docs: Column = index.documents().agg(F.count("*").alias("n")).scalar()
    weights, parts = C.weighted_postings(postings, n_docs)
    free = sets.where(F.size("phrases") == 0).select("word_set", "words")
    wanted = free.select("word_set", F.explode("words").alias("term")).join(weights, "term")
    ranked = C._search(free.select(F.col("word_set").alias("query_id"), "word_set"), free, wanted, parts, count)
    hits = ranked.withColumnRenamed("query_id", "word_set").unionByName(
        _required(sets.where(F.size("phrases") > 0), postings, weights, parts, count)
    )
    return fan_out_join(named.select("query_id", "word_set"), cut(hits), "word_set", ["query_id"], how="inner").select(
        "query_id", "rank", "doc_id", "score"
    )

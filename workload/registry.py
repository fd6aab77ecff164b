"""Registered queries: name -> function of (spark, folder of the tables)."""

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions import declared, rubric
from firmlens.functions.lineage import cut, shared_folder
from firmlens.functions.text import tokens
from firmlens.operators import (
    answers,
    corpus_search,
    curate,
    extract,
    inference,
    pages,
    phrase_search,
    prompts,
    requests,
    results,
    score_links,
    search_index,
    summary,
)
from firmlens.plans import enrich
from firmlens.sources import companies as company_source
from firmlens.sources import search_responses as response_source
from workload import tables as T


def _digest(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Long texts by length and hash; every text is read in full."""
    return df.select(
        *keys, F.length(text).alias(f"{text}_length"), F.md5(text).alias(f"{text}_md5")
    )


def company_scan(spark, sf_dir):
    return company_source.map_companies(
        T.raw_companies(spark, sf_dir), "firm", "city", "sector", "id"
    )


def company_preview(spark, sf_dir):
    return company_source.preview(company_scan(spark, sf_dir).orderBy("company_id"))


def search_requests(spark, sf_dir):
    return requests.search_requests(T.companies(spark, sf_dir))


def search_context(spark, sf_dir):
    return requests.search_context(T.companies(spark, sf_dir))


def search_hits(spark, sf_dir):
    return response_source.search_hits(T.search_responses(spark, sf_dir, T.raw_hits(spark, sf_dir)))


def parse_scores(spark, sf_dir):
    parsed = curate.parse_scores(T.score_responses(spark, sf_dir, T.raw_hits(spark, sf_dir)))
    return parsed.select(
        *curate.REQUEST, "valid", F.posexplode_outer("scored_links").alias("scored_pos", "link")
    ).select(*curate.REQUEST, "valid", "scored_pos", "link.url", "link.score", "link.reason")


def _scores(spark, sf_dir, raw):
    return curate.scores_of(curate.parse_scores(T.score_responses(spark, sf_dir, raw)))


def curate_links(spark, sf_dir):
    raw = cut(T.raw_hits(spark, sf_dir))
    return curate.curate_links(T.hits(raw), _scores(spark, sf_dir, raw))


def curate_fallback(spark, sf_dir):
    raw = cut(T.raw_hits(spark, sf_dir))
    return curate.curate_with_responses(T.hits(raw), T.score_responses(spark, sf_dir, raw))


def top_scored(spark, sf_dir):
    return curate.top_scored(_scores(spark, sf_dir, T.raw_hits(spark, sf_dir)))


def curated_counts(spark, sf_dir):
    return curate.curated_counts(curate_fallback(spark, sf_dir))


def dedup_links(spark, sf_dir):
    return curate.dedup_links(curate_fallback(spark, sf_dir))


def _linked(spark, sf_dir):
    return pages.link_pages(cut(dedup_links(spark, sf_dir)), T.web_pages(spark, sf_dir))


def link_pages(spark, sf_dir):
    keys = ["company_id", "url", "type_ord", "rank"]
    return _digest(_linked(spark, sf_dir), keys, "markdown")


def pages_to_markdown(spark, sf_dir):
    return _digest(pages.pages_to_markdown(T.web_pages(spark, sf_dir)), ["url"], "markdown")


def combined_content(spark, sf_dir):
    return _digest(pages.combined_content(_linked(spark, sf_dir)), ["company_id"], "content")


def link_prompts(spark, sf_dir):
    rendered = prompts.link_prompts(T.hits(T.raw_hits(spark, sf_dir)), T.companies(spark, sf_dir))
    return _digest(rendered, curate.REQUEST, "prompt")


def extract_prompts(spark, sf_dir):
    contents = pages.combined_content(_linked(spark, sf_dir))
    rendered = prompts.extract_prompts(contents, T.companies(spark, sf_dir))
    return _digest(rendered, ["company_id"], "prompt")


def parse_extractions(spark, sf_dir):
    return results.parse_extractions(T.extraction_responses(spark, sf_dir))


def structured_inference(spark, sf_dir):
    """A stand-in model that scores each listed link by its place in the prompt."""

    def make_client():
        def answer(batch: list[str]) -> list[str]:
            texts = []
            for prompt in batch:
                urls = re.findall(r"^URL: (.*)$", prompt, re.MULTILINE)
                links = [
                    {"url": url, "score": min(10, 1 + i), "reason": f"place {i}"}
                    for i, url in enumerate(urls)
                ]
                texts.append(json.dumps({"scored_links": links}))
            return texts

        return answer

    rendered = prompts.link_prompts(T.hits(T.raw_hits(spark, sf_dir)), T.companies(spark, sf_dir))
    scores = curate.scores_of(curate.parse_scores(inference.infer(rendered, make_client, curate.REQUEST)))
    # Only valid answers have scores.
    return scores.select(*curate.REQUEST, F.lit(True).alias("valid"), "url", "score", "reason")


ORDER_RESPONSE = declared.record(
    {
        "order": declared.WHOLE,
        "status": declared.one_of("F", "O", "P"),
        "note": declared.maybe(declared.TEXT),
        "total": declared.record({"amount": declared.NUMBER, "currency": declared.default(declared.TEXT, "'USD'")}),
        "lines": declared.list_of(
            declared.record({"number": declared.WHOLE, "quantity": declared.WHOLE, "final": declared.FLAG})
        ),
    }
)


def parse_orders(spark, sf_dir):
    """Nested responses read by a declared type; faults by their place."""
    found = T.order_responses(spark, sf_dir).select("o_orderkey", declared.read(F.col("raw"), ORDER_RESPONSE).alias("r"))
    lines = F.col("r.value.lines")
    return found.select(
        "o_orderkey",
        F.col("r.fault").alias("fault"),
        F.col("r.value.order").alias("order_number"),
        F.col("r.value.status").alias("status"),
        F.col("r.value.note").alias("note"),
        F.col("r.value.total.amount").alias("amount"),
        F.col("r.value.total.currency").alias("currency"),
        F.when(lines.isNotNull(), F.size(lines)).alias("n_lines"),
        F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + x["quantity"]).alias("quantity"),
        F.when(lines.isNotNull(), F.size(F.filter(lines, lambda x: x["final"]))).alias("n_final"),
    )


LATENESS = declared.record({"days": declared.WHOLE, "reason": declared.TEXT})


def stored_inference(spark, sf_dir):
    """Orders by a stand-in model that fails for one priority, asked through an answer store in
    two runs: the second has a client that only fails, so its rows come from the store."""

    def make_client():
        def answer(batch):
            out = []
            for prompt in batch:
                status, priority = re.search(r"status (\S+) and priority (.*)\?", prompt).groups()
                days = {"F": 1, "O": 2, "P": 3}[status] * int(priority[0])
                late = {"days": str(days), "reason": f"{len(priority)} letters"}
                out.append("no idea" if priority == "5-LOW" else json.dumps(late))
            return out

        return answer

    def no_client():
        def answer(batch):
            raise RuntimeError("asked again")

        return answer

    prompts, path = T.order_prompts(spark, sf_dir), f"{shared_folder(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    fits = lambda raw: declared.read(raw, LATENESS)["fault"].isNull()
    answers.answer(prompts, make_client, ["o_orderkey"], path, "stand-in", fits)
    again = answers.answer(prompts, no_client, ["o_orderkey"], path, "stand-in", fits)
    late = declared.read(F.col("raw"), LATENESS)["value"]
    return again.select("o_orderkey", F.col("raw").isNotNull().alias("answered"), late["days"].alias("days"), late["reason"].alias("reason"))


def corpus_search_query(spark, sf_dir):
    queries = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return corpus_search.corpus_search(queries, T.table(spark, sf_dir, "documents"))


def _document_index(spark, sf_dir) -> search_index.SearchIndex:
    """All documents, in an index that first held other texts of those of one language."""
    index = search_index.SearchIndex(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    docs = T.table(spark, sf_dir, "documents")
    older = docs.where("lang = 'en'").select("doc_id", F.substring_index("text", " ", 40).alias("text"))
    index.update(older)
    index.update(docs)
    return index


def index_search(spark, sf_dir):
    """The hits of ``corpus_search``, from an index that was appended to and merged."""
    index = _document_index(spark, sf_dir)
    index.merge()
    queries = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search(queries)


def phrase_search_query(spark, sf_dir):
    """Benchmark items whose first two words must occur side by side; for even ids the fifth
    word must occur as well, and every third item asks without requirements."""
    item, words = F.col("item_id"), tokens(F.col("text"))
    pair = F.concat(F.lit('"'), F.array_join(F.slice(words, 1, 2), " "), F.lit('" '))
    fifth = F.when(item % 2 == 0, F.concat(F.lit('"'), F.get(words, 4), F.lit('" ')))
    text = F.when(item % 3 == 0, F.col("text")).otherwise(F.concat(pair, F.coalesce(fifth, F.lit("")), "text"))
    queries = T.table(spark, sf_dir, "benchmark").select(item.alias("query_id"), text.alias("text"))
    return phrase_search.phrase_search(queries, _document_index(spark, sf_dir))


def search_pages(spark, sf_dir):
    asked = requests.search_requests(T.companies(spark, sf_dir))
    return corpus_search.search_pages(asked, T.web_pages(spark, sf_dir))


def lexicon_join(spark, sf_dir):
    words = T.table(spark, sf_dir, "benchmark").select(tokens(F.col("text")).alias("w"))
    single = words.select(F.lit("word").alias("category"), F.explode("w").alias("term"))
    pairs = words.where(F.size("w") > 1).select(
        F.lit("pair").alias("category"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - 1),
                lambda at: F.array_join(F.slice("w", at, 2), " "),
            )
        ).alias("term"),
    )
    sevens = words.where(F.size("w") > 6).select(
        F.lit("seven").alias("category"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - 6),
                lambda at: F.array_join(F.slice("w", at, 7), " "),
            )
        ).alias("term"),
    )
    lexicon = single.unionByName(pairs).unionByName(sevens).distinct()
    return score_links.lexicon_matches(
        T.table(spark, sf_dir, "documents"), "doc_id", "text", lexicon
    )


def score_links_rules(spark, sf_dir):
    return score_links.score_links(T.hits(T.raw_hits(spark, sf_dir)))


def _records(spark, sf_dir):
    chosen = cut(enrich.curated_by_rules(T.hits(T.raw_hits(spark, sf_dir))))
    return extract.extract(chosen, T.web_pages(spark, sf_dir), T.companies(spark, sf_dir))


def extract_erp(spark, sf_dir):
    return extract.erp_findings(_records(spark, sf_dir))


def extract_revenue(spark, sf_dir):
    return extract.revenue_findings(_records(spark, sf_dir))


def extract_size_type(spark, sf_dir):
    return extract.size_type_findings(_records(spark, sf_dir))


def extract_asserted(spark, sf_dir):
    """System, size and type by what the pages' sentences assert, not by what they deny."""
    chosen = cut(enrich.curated_by_rules(T.hits(T.raw_hits(spark, sf_dir))))
    asserted = extract.Lexicons(negation=True)
    records = extract.extract(chosen, T.web_pages(spark, sf_dir), T.companies(spark, sf_dir), asserted)
    return records.select("company_id", "erp_system", "erp_confidence", "company_size", "business_type")


def revenue_bucket(spark, sf_dir):
    usd = F.col("o_totalprice").cast("decimal(18,2)") * 300
    return T.table(spark, sf_dir, "orders").select(
        "o_orderkey", rubric.revenue_range(usd).alias("revenue_range")
    )


def enrich_companies(spark, sf_dir):
    raw = cut(T.raw_hits(spark, sf_dir))
    return enrich.enrich_with_responses(
        T.companies(spark, sf_dir),
        T.hits(raw),
        T.score_responses(spark, sf_dir, raw),
        T.web_pages(spark, sf_dir),
        T.extraction_responses(spark, sf_dir),
    )


def enrich_by_rules(spark, sf_dir):
    return enrich.enrich_by_rules(
        T.companies(spark, sf_dir), T.hits(T.raw_hits(spark, sf_dir)), T.web_pages(spark, sf_dir)
    )


def error_rows(spark, sf_dir):
    return results.error_rows(enrich_companies(spark, sf_dir))


def summary_counts(spark, sf_dir):
    return summary.summary_counts(enrich_companies(spark, sf_dir))


def erp_top5(spark, sf_dir):
    return summary.erp_top(enrich_companies(spark, sf_dir))


def revenue_range_counts(spark, sf_dir):
    return summary.revenue_range_counts(enrich_companies(spark, sf_dir))


QUERIES = {
    "company_scan": company_scan,
    "company_preview": company_preview,
    "search_requests": search_requests,
    "search_context": search_context,
    "search_hits": search_hits,
    "parse_scores": parse_scores,
    "curate_links": curate_links,
    "curate_fallback": curate_fallback,
    "top_scored": top_scored,
    "curated_counts": curated_counts,
    "dedup_links": dedup_links,
    "link_pages": link_pages,
    "pages_to_markdown": pages_to_markdown,
    "combined_content": combined_content,
    "link_prompts": link_prompts,
    "extract_prompts": extract_prompts,
    "parse_extractions": parse_extractions,
    "structured_inference": structured_inference,
    "parse_orders": parse_orders,
    "stored_inference": stored_inference,
    "error_rows": error_rows,
    "corpus_search": corpus_search_query,
    "index_search": index_search,
    "phrase_search": phrase_search_query,
    "search_pages": search_pages,
    "lexicon_join": lexicon_join,
    "score_links_rules": score_links_rules,
    "extract_erp": extract_erp,
    "extract_revenue": extract_revenue,
    "extract_size_type": extract_size_type,
    "extract_asserted": extract_asserted,
    "revenue_bucket": revenue_bucket,
    "summary_counts": summary_counts,
    "erp_top5": erp_top5,
    "revenue_range_counts": revenue_range_counts,
    "enrich_companies": enrich_companies,
    "enrich_by_rules": enrich_by_rules,
}

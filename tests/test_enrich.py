import json

import pytest
from pyspark.sql import functions as F

from firmlens.functions.joins import SALTS, fan_out_join
from firmlens.operators import pages as P
from firmlens.operators import prompts, results, summary
from firmlens.operators.inference import infer
from firmlens.operators.extract import Lexicons, extract
from firmlens.plans import enrich as E
from firmlens.schemas import RESULT_SCHEMA
from firmlens.sources import pages as P_source

COMPANY = "company_id bigint, company_name string, location string, industry string"
LINK = "company_id bigint, search_type string, pos int, title string, url string, snippet string"


def companies(spark, *names):
    return spark.createDataFrame([(i, n, "", "") for i, n in enumerate(names)], COMPANY)


def links(spark, *rows):
    """Rows of (company, search type, pos, url[, title])."""
    full = [(c, k, p, t[1] if len(t) > 1 else "Annual report", t[0], "revenue") for c, k, p, *t in rows]
    return spark.createDataFrame(full, LINK)


def pages(spark, **html):
    return spark.createDataFrame(list(html.items()), "url string, html string")


def by_name(df):
    return {r.company_name: r for r in df.collect()}


def extraction(**changes):
    record = {
        "erp_system": "SAP", "erp_confidence": 9, "annual_revenue": None, "revenue_confidence": 2,
        "revenue_range": None, "company_size": "Medium", "business_type": None, "notes": "n",
    }
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v != "absent"})


def test_extraction_validation(spark):
    raws = {
        extraction(): None,
        extraction(erp_confidence="7", revenue_confidence=7.0): None,
        extraction(notes="absent"): "missing or invalid in response: notes",
        extraction(erp_confidence=None, notes=5): "missing or invalid in response: erp_confidence, notes",
        "nope": "response is not a JSON object",
        "[1]": "response is not a JSON object",
    }
    df = spark.createDataFrame(list(enumerate(raws)), "company_id bigint, raw string")
    rows = results.parse_extractions(df).orderBy("company_id").collect()
    assert [r.error for r in rows] == list(raws.values())
    assert (rows[1].erp_confidence, rows[1].revenue_confidence) == (7, 7)


def test_every_outcome_with_responses(spark):
    firms = companies(spark, "Good", "Broken", "Unread", "", "Nolinks")
    hits = links(
        spark,
        (0, "revenue", 0, "p"), (0, "ERP", 0, "p"), (0, "ERP", 1, "gone"),
        (1, "revenue", 0, "p"), (2, "revenue", 0, "gone"), (2, "revenue", 1, "blank"),
    )
    none = spark.createDataFrame([], "company_id bigint, search_type string, raw string")
    answers = spark.createDataFrame(
        [(0, extraction()), (1, extraction(notes="absent")), (2, extraction())],
        "company_id bigint, raw string",
    )
    texts = pages(spark, p="<p>text</p>", blank="<p> </p>")
    got = E.enrich_with_responses(firms, hits, none, texts, answers, error_prefix="Error: ")
    assert got.columns == ["company_id", *RESULT_SCHEMA.names]
    rows = by_name(got)
    assert len(rows) == 5
    good, broken, unread, unnamed, alone = (rows[n] for n in ("Good", "Broken", "Unread", "", "Nolinks"))
    assert (good.erp_system, good.erp_confidence, good.sources_found) == ("SAP", 9, 2)
    assert (broken.erp_confidence, broken.revenue_confidence, broken.sources_found) == (0, 0, 0)
    assert broken.notes == "Error: missing or invalid in response: notes"
    assert (unread.erp_confidence, unread.sources_found) == (1, 2)
    assert unread.notes == alone.notes == "No content could be scraped from search results"
    assert (alone.erp_confidence, alone.sources_found) == (1, 0)
    assert unnamed.notes == "Error: company name is missing"
    errors = {r.company_name for r in results.error_rows(got).collect()}
    assert errors == {"Broken", ""}


def test_link_pages_and_content(spark):
    chosen = spark.createDataFrame(
        [(1, "ERP", 1, 1, "b"), (1, "revenue", 0, 2, "a"), (1, "revenue", 0, 1, "gone"), (2, "ERP", 1, 1, "e")],
        "company_id bigint, search_type string, type_ord int, rank int, url string",
    )
    linked = P.link_pages(chosen, pages(spark, a="<p>A</p>", b="B", e="<p>  </p>", x="unused"))
    assert {(r.url, r.markdown) for r in linked.collect()} == {
        ("a", "A"), ("b", "B"), ("gone", ""), ("e", ""),
    }
    assert [tuple(r) for r in P.combined_content(linked).collect()] == [(1, "A\n\n---\n\nB")]
    asked = prompts.extract_prompts(P.combined_content(linked), companies(spark, "x", "Acme"))
    text = asked.first().prompt
    assert "'Acme'" in text and "CONTENT TO ANALYZE:\nA\n\n---\n\nB\n\nInstructions:" in text


def test_link_prompts(spark):
    hits = links(spark, (0, "Revenue", 1, "b"), (0, "Revenue", 0, "a"), (0, "other", 0, "c"))
    got = {r.search_type: r.prompt for r in prompts.link_prompts(hits, companies(spark, "A")).collect()}
    block = "URL: a\nTitle: Annual report\nSnippet: revenue\n\nURL: b\nTitle: Annual report\nSnippet: revenue"
    assert f"Links to evaluate:\n{block}\n\nFocus specifically on revenue" in got["Revenue"]
    assert "PRIORITIZE for ERP search" in got["other"]


def test_hot_url(spark):
    """A third of all links lead to one page: its rows spread, and none is lost."""
    rows = spark.range(30000).select(
        F.col("id").alias("company_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), "id")).alias("url"),
    )
    payload = rows.select("url").distinct().withColumn("size", F.length("url"))
    joined = fan_out_join(rows, payload, "url", ["company_id"], target_rows=1000)
    assert joined.count() == 30000
    assert fan_out_join(rows, payload, "url", ["company_id"]).count() == 30000
    assert joined.where("url = 'hot'").agg(F.sum("size")).first()[0] == 30000
    plan = joined._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_only_hot_keys_are_copied(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("company_id"), F.when(F.col("id") < 300, "warm").when(F.col("id") < 1500, "hot").otherwise("u").alias("url")
    )
    payload = rows.select("url").distinct()
    copies = []
    fan_out_join(rows, payload, "url", ["company_id"], prepare=lambda df: copies.append(df) or df, target_rows=400).count()
    assert {r.url: r[SALTS] for r in copies[0].collect()} == {"warm": 1, "hot": 3, "u": 4}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_converted_once_and_after_the_lookup(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages(spark, a="<p>A</p>").write.parquet(path)
    web = spark.read.parquet(path)
    chosen = spark.createDataFrame(
        [(1, "ERP", 1, 1, "a", "t")],
        "company_id bigint, search_type string, type_ord int, rank int, url string, title string",
    )
    linked = P.link_pages(chosen, web)
    jobs = [
        linked,
        P.combined_content(linked),
        P.readable_companies(chosen, web),
        extract(chosen, web, companies(spark, "x", "A")),
    ]
    for job in jobs:
        plan = plan_of(job)
        assert plan.count("<script") == 1
        # Deeper operators come later in the text of a plan.
        assert plan.index("<script") < plan.rindex("Join [url") < plan.rindex("ReadSchema: struct<url:string,html")


def test_bucketed_pages_do_not_move(spark):
    """With at least as many buckets as shuffle partitions the html stays in place."""
    P_source.save_pages(pages(spark, a="<p>A</p>", b="B"), "bucketed_pages", 16)
    chosen = spark.createDataFrame([(1, "a")], "company_id bigint, url string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored = P.link_pages(chosen, spark.table("bucketed_pages"))
        lines = plan_of(stored).split("\n")
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "html" in line)
        lookup = max(i for i in range(scan) if "SortMergeJoin [url" in lines[i])
        assert not any("Exchange" in line for line in lines[lookup:scan])
        assert [r.markdown for r in stored.collect()] == ["A"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table bucketed_pages")


RULE_PAGES = {
    "press": "<h1>News</h1><p>Acme Corp. runs SAP as its ERP. Acme Corp posted revenue of INR 120 crore in 2023.</p>",
    "more": "<p>Acme Corp uses SAP. Acme Corp is a multinational manufacturer. Oracle too.</p>",
    "careers": "<p>Beta Ltd needs a Tally operator; Beta Ltd runs Tally.</p>",
    "plain": "<p>The sapling nursery of Gamma. Revenue was strong.</p>",
}


@pytest.fixture(scope="module")
def rule_rows(spark):
    hits = links(
        spark,
        (0, "revenue", 0, "press"), (0, "revenue", 1, "more"),
        (1, "revenue", 0, "careers", "Beta careers: annual report, investors"),
        (2, "revenue", 0, "plain"), (3, "revenue", 0, "gone"),
    )
    firms = companies(spark, "Acme Corp", "Beta Ltd", "Gamma", "Delta")
    return by_name(E.enrich_by_rules(firms, hits, pages(spark, **RULE_PAGES)))


def test_rules_explicit_mention(rule_rows):
    acme = rule_rows["Acme Corp"]
    assert (acme.erp_system, acme.erp_confidence) == ("SAP", 9)
    assert (acme.annual_revenue, acme.revenue_confidence) == ("INR 120 crore (2023)", 8)
    assert (acme.revenue_range, acme.company_size, acme.business_type) == (
        "$10M-$50M", "Enterprise", "Manufacturer",
    )
    assert acme.sources_found == 2 and acme.notes.startswith("ERP: SAP (2 mentions); Revenue: INR 120")


def test_rules_job_page_is_weak(rule_rows):
    assert (rule_rows["Beta Ltd"].erp_system, rule_rows["Beta Ltd"].erp_confidence) == ("Tally", 3)


def test_rules_nothing_found(rule_rows):
    gamma, delta = rule_rows["Gamma"], rule_rows["Delta"]
    assert (gamma.erp_system, gamma.erp_confidence, gamma.annual_revenue) == (None, 1, None)
    assert gamma.notes == "No clear information found"
    assert (delta.erp_confidence, delta.sources_found) == (1, 1)
    assert delta.notes == "No content could be scraped from search results"


def test_own_lexicons(spark):
    lexicons = Lexicons(brands=("Zorg ERP",), usd_rates={"USD": "1"})
    hits = links(spark, (0, "revenue", 0, "p"))
    html = "<p>Acme runs Zorg ERP and SAP. Acme sales were INR 5 crore.</p>"
    got = E.enrich_by_rules(companies(spark, "Acme"), hits, pages(spark, p=html), lexicons).first()
    assert got.erp_system == "Zorg ERP"
    assert (got.annual_revenue, got.revenue_range) == ("INR 5 crore", None)


def test_own_model(spark):
    record = extraction(erp_system="Oracle")

    def make_model():
        def answer(batch):
            return [
                record if "CONTENT TO ANALYZE" in prompt
                else '{"scored_links":[{"url":"p","score":9,"reason":"r"}]}' if "'Acme'" in prompt
                else None
                for prompt in batch
            ]

        return answer

    firms = companies(spark, "Acme", "Beta", "Gamma")
    hits = links(spark, (0, "revenue", 0, "q"), (0, "revenue", 1, "p"), (1, "ERP", 0, "q"), (2, "ERP", 0, "gone"))
    rows = by_name(E.enrich_with_model(firms, hits, pages(spark, p="P", q="Q"), make_model))
    assert (rows["Acme"].erp_system, rows["Acme"].sources_found) == ("Oracle", 1)
    assert (rows["Beta"].erp_system, rows["Beta"].sources_found) == ("Oracle", 1)
    assert (rows["Gamma"].erp_confidence, rows["Gamma"].sources_found) == (1, 1)


def test_failed_calls_cost_no_other_prompt(spark):
    prompts_table = spark.createDataFrame([(i, f"prompt {i}") for i in range(20)], "id int, prompt string")

    def make_client():
        def client(batch):
            if any(p.endswith("7") for p in batch):
                raise ConnectionError("down")
            return [p.upper() for p in batch if p != "prompt 3"]

        return client

    answers = {r.id: r.raw for r in infer(prompts_table, make_client, ["id"]).collect()}
    assert answers == {i: None if i in (3, 7, 17) else f"PROMPT {i}" for i in range(20)}


def test_summary(spark):
    systems = [None, ""] + ["SAP"] * 3 + ["Oracle"] * 3 + ["Tally"] * 2 + ["B", "A", "C", "D"]
    rows = [
        ("n", "", "", s, 1, "USD 1" if i % 2 else "", 1, "$100M+" if i < 3 else "Under $1M" if i < 6 else None, None, None, "", 0)
        for i, s in enumerate(systems)
    ]
    df = spark.createDataFrame(rows, RESULT_SCHEMA)
    assert tuple(summary.summary_counts(df).first()) == (14, 12, 7)
    assert [tuple(r) for r in summary.erp_top(df).collect()] == [
        ("Oracle", 3), ("SAP", 3), ("Tally", 2), ("A", 1), ("B", 1),
    ]
    assert [tuple(r) for r in summary.revenue_range_counts(df).collect()] == [
        ("$100M+", 3), ("Under $1M", 3),
    ]


def test_empty_input(spark):
    none = companies(spark).limit(0)
    hits = spark.createDataFrame([], LINK)
    got = E.enrich_by_rules(none, hits, pages(spark, p="x"))
    assert got.columns == ["company_id", *RESULT_SCHEMA.names] and got.count() == 0

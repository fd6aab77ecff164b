"""Steps that must not run twice, move early or read a text again for each phrase."""

from pyspark.sql import functions as F

from firmlens.functions import rubric, strict_json
from firmlens.functions import text as X
from firmlens.functions.declared import read
from firmlens.operators import curate, extract, score_links
from firmlens.operators.curate import REQUEST
from workload import registry, tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_responses_are_read_once_for_their_scores(spark):
    raw = '{"scored_links": [{"url": "a", "score": "7", "reason": "x"}]}'
    responses = spark.createDataFrame([(1, "ERP", raw), (2, "ERP", "{")], "company_id long, search_type string, raw string")
    scores = curate.scores_of(curate.parse_scores(responses))
    assert _plan(scores.repartition(2)).count("parse_json") <= 1
    assert [tuple(r) for r in scores.collect()] == [(1, "ERP", 0, "a", 7, "x")]


def test_scored_links_are_those_of_the_declared_type(spark):
    item = '{"url": "a", "score": %s, "reason": %s}'
    items = [item % (s, r) for s in ("7", '"7"', "7.0", "7.5", "true", "null", "[]", "99999999999") for r in ('"x"', "null", "1")]
    items += ["null", "1", "[]", "{}", '{"url": "a", "score": 1}', '{"url": "a", "url": "b", "score": 1, "reason": ""}']
    texts = ['{"scored_links": [%s]}' % i for i in ["", *items, ", ".join([item % ("1", '"x"')] * 2 + ["null"])]]
    texts += ["", "null", "[]", "{}", '{"scored_links": null}', '{"scored_links": {}}', '{"scored_links": "x"}', None]
    raw = F.col("raw")
    found = spark.createDataFrame([(t,) for t in texts], "raw string").select(
        "raw",
        strict_json.scored_links(raw).alias("fast"),
        read(raw, strict_json.SCORED_LINKS)["value"]["scored_links"].alias("declared"),
    )
    assert found.where("NOT (fast <=> declared)").count() == 0
    assert found.where("fast IS NOT NULL").count() >= 5


def test_rules_run_once_where_the_best_links_are_chosen(spark):
    links = spark.createDataFrame(
        [(1, "ERP", 0, "SAP case study", "u", "our customers"), (1, "ERP", 1, "nothing", "v", "login")],
        "company_id long, search_type string, pos int, title string, url string, snippet string",
    )
    best = curate.curate_rated(score_links.rate_links(links.repartition(2)))
    conditions = [line for line in _plan(best).splitlines() if "Filter" in line]
    assert not any("arrays_overlap" in line or "RLIKE" in line or "regexp" in line for line in conditions)
    assert [r.url for r in best.collect()] == ["u"]


def test_sentences_are_tested_once(spark):
    pages = spark.createDataFrame([("u", "We run SAP. Sales were USD 5 million in 2020. Nice weather.")], "url string, markdown string")
    found = extract.page_evidence(pages.repartition(2), extract.Lexicons())
    conditions = [line for line in _plan(found).splitlines() if "Filter" in line]
    assert not any("RLIKE" in line for line in conditions)
    assert sorted(r.kind for r in found.collect()) == ["erp", "page", "revenue"]


def test_hits_of_a_vocabulary_answer_every_question(spark):
    terms = ["business software", "software download", "software", "annual report", "annual reports", "a b c", "b c d", "c", "10-K"]
    texts = ["business software download", "the annual reports", "a b c d", "x 10 k", "softwares", "", "b c", "Annual-Report 10K"]
    padded = X.padded(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(padded.alias("p"))
    hits = rows.select("p", X.vocabulary_hits(F.col("p"), terms).alias("hits"))
    asked = [[t] for t in terms] + [terms[:3], terms[5:]]
    wrong = [X.hit_any(F.col("hits"), a, terms) != X.has_any(F.col("p"), a) for a in asked]
    assert hits.select(F.array(*wrong).alias("w")).where(F.array_contains("w", True)).count() == 0
    assert set(rubric.BRANDS) <= set(rubric.vocabulary())


def test_phrases_do_not_slice_their_text(spark):
    texts = spark.createDataFrame([(1, "a b a b c"), (2, "b"), (3, None)], "id long, text string")
    lexicon = spark.createDataFrame([("x", "A b"), ("x", "b"), ("y", "b a b c"), ("y", "q q q q q q q")], "category string, term string")
    found = score_links.lexicon_matches(texts, "id", "text", lexicon)
    assert "slice(" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, "x", "A b", 2), (1, "x", "b", 2), (1, "y", "b a b c", 1), (2, "x", "b", 1)]


def test_requests_without_a_valid_response_keep_their_first_links(spark):
    links = spark.createDataFrame([(c, "ERP", p, "t", f"u{p}", "s") for c in (1, 2) for p in range(5)], "company_id long, search_type string, pos int, title string, url string, snippet string")
    raw = '{"scored_links": [{"url": "u4", "score": 9, "reason": "x"}]}'
    responses = spark.createDataFrame([(1, "ERP", raw)], "company_id long, search_type string, raw string")
    found = curate.curate_with_responses(links, responses).orderBy(*REQUEST, "rank")
    assert [(r.company_id, r.url) for r in found.collect()] == [(1, "u4"), (2, "u0"), (2, "u1"), (2, "u2")]


def test_answers_of_a_model_are_read_once(spark, tmp_path):
    for name, rows, schema in (
        ("nation", [(1, "CHINA")], "n_nationkey int, n_name string"),
        ("customer", [(1, "A", 1, "BUILDING", 5.0)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"),
        ("orders", [(7, 1, "F", "1-URGENT", 10.0, "1995-01-01"), (8, 1, "O", "5-LOW", 10.0, "1995-01-01")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, o_orderdate string"),
        ("lineitem", [(7, 2, 3, 4, 1.0, "R", "O"), (7, 1, 3, 4, 1.0, "N", "F"), (7, 3, 9, 4, 1.0, "A", "F")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string, l_linestatus string"),
        ("pages", [(9, "http://p/9", ""), (9, "http://p/9b", "")], "page_id long, url string, html string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = registry.structured_inference(spark, str(tmp_path))
    conditions = [line for line in _plan(found).splitlines() if "Filter" in line]
    assert not any("parse_json" in line for line in conditions)
    reports = "https://filings.example.com/"
    given = {("erp", f"{reports}7"), ("erp", "http://p/9"), ("erp", "http://p/9b"), ("revenue", f"{reports}7"), ("revenue", f"{reports}8")}
    assert {(r.search_type.lower(), r.url) for r in found.where("valid").collect()} == given
    raw = tables.raw_hits(spark, str(tmp_path))
    # A line stays a narrow row until it has its place: no list of lines is built.
    assert "collect_list(struct(l_linenumber" not in _plan(raw)
    assert sorted((r.pos, r.title) for r in raw.where("lower(search_type) = 'erp'").collect())[:2] == [(0, None), (1, "A careers: Oracle consultant")]

import random

from firmlens.operators import curate as C
from firmlens.operators import score_links as L
from firmlens.operators.requests import search_context, search_requests

LINK = "company_id bigint, search_type string, pos int, title string, url string, snippet string"
SCORE = "company_id bigint, search_type string, scored_pos int, url string, score int, reason string"


def links(spark, urls, company=1, kind="revenue"):
    return spark.createDataFrame(
        [(company, kind, i, f"t{i}", u, "s") for i, u in enumerate(urls)], LINK
    )


def scores(spark, pairs, company=1, kind="revenue"):
    return spark.createDataFrame(
        [(company, kind, i, u, s, "r") for i, (u, s) in enumerate(pairs)], SCORE
    )


def urls(df):
    return [r.url for r in df.orderBy("company_id", "search_type", "rank").collect()]


def responses(spark, raws, kind="revenue"):
    return spark.createDataFrame(
        [(i, kind, raw) for i, raw in enumerate(raws)],
        "company_id bigint, search_type string, raw string",
    )


def test_threshold(spark):
    df = C.curate_links(links(spark, "abc"), scores(spark, [("a", 5), ("b", 6), ("c", 7)]))
    assert urls(df) == ["c", "b"]


def test_ties_keep_the_order_of_the_scores(spark):
    df = C.curate_links(links(spark, "abcd"), scores(spark, [(u, 8) for u in "dbac"]))
    assert urls(df) == ["d", "b", "a"]


def test_invented_urls_do_not_take_a_place(spark):
    pairs = [("x", 10), ("y", 10), ("z", 10), ("a", 6), ("b", 6), ("c", 6)]
    assert urls(C.curate_links(links(spark, "abc"), scores(spark, pairs))) == ["a", "b", "c"]


def test_repeated_url_takes_places_then_dedup_shrinks(spark):
    curated = C.curate_links(
        links(spark, "abc"), scores(spark, [("a", 9), ("a", 9), ("b", 8), ("c", 7)])
    )
    assert urls(curated) == ["a", "a", "b"]
    assert sorted(urls(C.dedup_links(curated))) == ["a", "b"]


def test_first_of_equal_links_is_taken(spark):
    df = C.curate_links(links(spark, "aab"), scores(spark, [("a", 9)]))
    assert [(r.pos, r.title) for r in df.collect()] == [(0, "t0")]


def test_scores_outside_one_to_ten_count(spark):
    assert urls(C.curate_links(links(spark, "ab"), scores(spark, [("a", 6), ("b", 99)]))) == ["b", "a"]


def test_score_validation(spark):
    def one(score, url='"a"', reason='"r"'):
        return f'{{"scored_links":[{{"url":{url},"score":{score},"reason":{reason}}}]}}'

    cases = {
        one("7"): 7, one("7.0"): 7, one('"7"'): 7, one('" 7 "'): 7, one('"7.0"'): 7,
        one("true"): 1, one("99"): 99, one("-3"): -3, one('"+7"'): 7,
        one("7.5"): None, one("null"): None, one('"x"'): None, one('"7.5"'): None, one("[7]"): None,
        one("7", url="1"): None, one("7", reason="null"): None,
        '{"scored_links":[{"url":"a","reason":"r"}]}': None,
        '{"scored_links":[{"url":"a","score":7,"reason":"r"},{"url":"b"}]}': None,
        '{"scored_links":7}': None, '{"scored_links":null}': None, "{}": None, "[]": None,
        "not json": None, '{"scored_links":[7]}': None,
        '{"scored_links":[{"url":"a","score":7,"reason":"r","more":[]}],"x":1}': 7,
    }
    parsed = C.parse_scores(responses(spark, list(cases))).orderBy("company_id").collect()
    got = [r.scored_links[0].score if r.valid else None for r in parsed]
    assert dict(zip(cases, got)) == cases


def test_empty_scoring_is_valid_and_gives_nothing(spark):
    hits = links(spark, "abcd", company=0)
    assert urls(C.curate_with_responses(hits, responses(spark, ['{"scored_links":[]}']))) == []


def test_invalid_or_missing_scoring_falls_back(spark):
    hits = links(spark, "abcd", company=0).unionByName(links(spark, "efgh", company=9))
    df = C.curate_with_responses(hits, responses(spark, ['{"scored_links":[{"url":"d"}]}']))
    assert urls(df) == ["a", "b", "c", "e", "f", "g"]


def test_dedup_prefers_revenue_and_drops_empty_urls(spark):
    both = C.curate_links(links(spark, ["a", ""]), scores(spark, [("a", 6), ("", 9)])).unionByName(
        C.curate_links(links(spark, "ab", kind="ERP"), scores(spark, [("a", 9), ("b", 8)], kind="ERP"))
    )
    rows = {(r.url, r.search_type) for r in C.dedup_links(both).collect()}
    assert rows == {("a", "revenue"), ("b", "ERP")}
    again = C.dedup_links(C.dedup_links(both))
    assert {(r.url, r.search_type) for r in again.collect()} == rows
    assert C.sources_found(C.dedup_links(both)).collect()[0].sources_found == 2


def test_one_company_with_very_many_scores(spark):
    """A third of all scores and links belongs to one request."""
    random.seed(1)
    rows = [(1, "revenue", i, f"u{i % 50}", random.randint(1, 10), "r") for i in range(3000)]
    rows += [(c, "ERP", i, f"u{i}", 6 + i % 3, "r") for c in range(2, 600) for i in range(10)]
    hits = [(1, "revenue", i, "t", f"u{i % 40}", "s") for i in range(3000)]
    hits += [(c, "ERP", i, "t", f"u{i}", "s") for c in range(2, 600) for i in range(8)]
    got = C.curate_links(spark.createDataFrame(hits, LINK), spark.createDataFrame(rows, SCORE))
    expected = set()
    for company in {r[0] for r in rows}:
        known = {h[4] for h in hits if h[0] == company}
        good = [r for r in rows if r[0] == company and r[4] >= 6 and r[3] in known]
        for rank, r in enumerate(sorted(good, key=lambda r: (-r[4], r[2]))[:3], 1):
            expected.add((company, rank, r[3]))
    assert {(r.company_id, r["rank"], r.url) for r in got.collect()} == expected


def test_requests(spark):
    df = spark.createDataFrame(
        [(1, "Acme", "Pune", ""), (2, "", "x", "y"), (3, "B", "", "Steel")],
        "company_id bigint, company_name string, location string, industry string",
    )
    got = {tuple(r) for r in search_requests(df).collect()}
    assert got == {
        (1, "revenue", "Acme revenue"), (1, "ERP", 'Acme "ERP"'),
        (3, "revenue", "B revenue"), (3, "ERP", 'B "ERP"'),
    }
    assert {tuple(r) for r in search_context(df).collect()} == {
        (1, "Acme Pune"), (2, " x y"), (3, "B Steel"),
    }


def rated(spark, kind, title, snippet="", url="https://x.test"):
    df = spark.createDataFrame([(1, kind, 0, title, url, snippet)], LINK)
    row = L.score_links(df).first()
    return row.score, row.reason


def test_rule_scores(spark):
    assert rated(spark, "revenue", "Nothing here") == (1, "")
    assert rated(spark, "Revenue", "Annual report", "revenue of 5")[0] == 10
    assert rated(spark, "revenue", "Annual report", "sign in, then subscribe")[0] == 5
    assert rated(spark, "revenue", "Jobs at Acme", "annual report")[0] == 3
    # A job post counts against a link, unless it names an ERP brand.
    assert rated(spark, "ERP", "Careers", "implementation")[0] == 1
    assert rated(spark, "ERP", "Careers: SAP consultant", "implementation")[0] == 8
    assert rated(spark, "anything", "Case study")[0] == 6


def test_lexicon_matches_terms_of_any_width(spark):
    texts = spark.createDataFrame(
        [(1, "SAP, sap! sapling Microsoft  Dynamics"), (2, ""), (3, "of the of the"),
         (4, "The Ministry of Corporate Affairs, one two three four five six seven.")],
        "id int, body string",
    )
    lexicon = spark.createDataFrame(
        [("brand", "SAP"), ("brand", "Microsoft Dynamics"), ("w", "of the of"), ("w", "the"),
         ("long", "ministry of corporate affairs"), ("long", "one two three four five six seven")],
        "category string, term string",
    )
    expected = {
        (1, "brand", "SAP", 2), (1, "brand", "Microsoft Dynamics", 1),
        (3, "w", "of the of", 1), (3, "w", "the", 2), (4, "w", "the", 1),
        (4, "long", "ministry of corporate affairs", 1), (4, "long", "one two three four five six seven", 1),
    }
    assert {tuple(r) for r in L.lexicon_matches(texts, "id", "body", lexicon).collect()} == expected


def test_dedup_ignores_the_case_of_the_type(spark):
    curated = spark.createDataFrame(
        [(1, "ERP", 1, 0, "t", "a", "s"), (1, "Revenue", 3, 0, "t", "a", "s")],
        "company_id int, search_type string, rank int, pos int, title string, url string, snippet string",
    )
    assert [r.search_type for r in C.dedup_links(curated).collect()] == ["Revenue"]

"""Scopes of negation by hand-written sentences, and rule extraction with them."""

import pytest
from pyspark.sql import functions as F

from firmlens.functions import negation
from firmlens.functions import text as X
from firmlens.operators import extract as E

CASES = [
    ("It is no start-up.", "start up", False),
    ("It is a start-up.", "start up", True),
    ("Acme does not use SAP.", "sap", False),
    ("Acme doesn't use SAP", "sap", False),
    ("Acme can’t run SAP, it runs Oracle.", "sap", False),
    ("Acme can’t run SAP, it runs Oracle.", "oracle", True),
    ("Acme never had SAP but runs Tally.", "tally", True),
    ("Acme never had SAP but runs Tally.", "sap", False),
    ("Neither SAP nor Oracle is used: Tally is.", "oracle", False),
    ("Neither SAP nor Oracle is used: Tally is.", "tally", True),
    ("Not only SAP, also Oracle.", "sap", True),
    ("There is no doubt that SAP is in use.", "sap", True),
    ("SAP was replaced by Oracle.", "sap", False),
    ("SAP was replaced by Oracle.", "oracle", True),
    ("They replaced SAP with Oracle.", "sap", False),
    ("They replaced SAP with Oracle.", "oracle", True),
    ("SAP has been phased out.", "sap", False),
    ("Runs SAP without Salesforce.", "sap", True),
    ("Runs SAP without Salesforce.", "salesforce", False),
    ("Oracle (not SAP) is the ERP.", "oracle", True),
    ("Oracle (not SAP) is the ERP.", "sap", False),
    ("Die Firma nutzt kein SAP, sondern Oracle.", "sap", False),
    ("Die Firma nutzt kein SAP, sondern Oracle.", "oracle", True),
    ("A notable nordic knot: SAP.", "sap", True),
    ("A small, business-like firm", "small business", True),
    ("No. 1 in retail - SAP user", "sap", True),
    ("", "sap", False),
    ("not", "sap", False),
    ("|#~ SAP", "sap", True),
]


@pytest.fixture(scope="module")
def asserted(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "s string").distinct()
    rows = df.select("s", negation.asserted(F.col("s")).alias("a")).collect()
    return {r.s: r.a for r in rows}


@pytest.mark.parametrize(("sentence", "term", "said"), CASES)
def test_scope(asserted, sentence, term, said):
    assert (f" {X.phrase(term)} " in asserted[sentence]) == said


def test_plain_sentences_read_as_before(spark):
    texts = ["Acme Corp. runs SAP (and Oracle), since 2020!", "a  b\tc", "", "Ünïcode, wörds", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select(negation.asserted(F.col("s")).alias("a"), X.padded(F.col("s")).alias("p")).collect():
        assert r.a == r.p


def test_extraction_with_and_without(spark):
    companies = spark.createDataFrame([(1, "Acme", "", "")], "company_id bigint, company_name string, location string, industry string")
    links = spark.createDataFrame([(1, "u", "Acme", 0, 0)], "company_id bigint, url string, title string, type_ord int, rank int")
    html = "<p>Acme does not use SAP. Acme runs Oracle. It is no start-up, it is a multinational and never was a factory.</p>"
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    found = {}
    for negated in (False, True):
        r = E.extract(links, pages, companies, E.Lexicons(negation=negated)).collect()[0]
        found[negated] = (r.erp_system, r.company_size, r.business_type)
    assert found[True] == ("Oracle", "Enterprise", None)
    assert found[False][2] == "Manufacturer"

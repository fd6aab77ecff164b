"""Domain tables derived from the bundled tables, with whole tables as input.

- companies: every customer, with its nation and market segment;
- web pages: one report page per order (text made of the order's own values), and
  the given ``pages``;
- search hits: for a revenue search the company's orders, for an ERP search the
  lines of its orders, which lead to the report page, to a given page or to a part
  page that does not exist. Every order and order line is a hit;
- responses: JSON texts such as a search API or a model returns, built from the
  hits and customers, with the faults that such texts have.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.functions.lineage import cut
from firmlens.schemas import ERP, REVENUE

BRAND_OF_SEGMENT = {
    "AUTOMOBILE": "SAP",
    "BUILDING": "Oracle",
    "FURNITURE": "Microsoft Dynamics",
    "HOUSEHOLD": "Tally",
    "MACHINERY": "NetSuite",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(column: str, values: dict) -> Column:
    chain = F
    for key, value in values.items():
        chain = chain.when(F.col(column) == key, F.lit(value))
    return chain


def raw_companies(spark, sf_dir) -> DataFrame:
    """Companies as a messy file would have them."""
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer")
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < -900, F.lit("N/A"))
        .otherwise(F.concat(F.lit("\t "), "c_name", F.lit(" \n")))
        .alias("firm"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("null"))
        .otherwise(F.concat("n_name", F.lit("  ")))
        .alias("city"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("sector"),
    )


def companies(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer")
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("company_id"),
        F.col("c_name").alias("company_name"),
        F.col("n_name").alias("location"),
        F.col("c_mktsegment").alias("industry"),
    )


def _amount() -> Column:
    """The price of an order as its report writes it."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    units = F.floor(cents / F.lit(1000)).cast("bigint")
    number = F.concat(
        F.floor(units / F.lit(100)).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((units % 100).cast("string"), 2, "0"),
    )
    currency = _cases("o_orderstatus", {"F": "USD", "O": "INR", "P": "€"})
    scale = _cases(
        "o_orderpriority",
        {
            "1-URGENT": " million",
            "2-HIGH": " thousand",
            "3-MEDIUM": " crore",
            "4-NOT SPECIFIED": " lakh",
            "5-LOW": "",
        },
    )
    return F.concat(currency, F.lit(" "), number, scale)


def _report_url(order: str) -> Column:
    return F.concat(F.lit("https://filings.example.com/"), order)


def _orders(spark, sf_dir) -> DataFrame:
    """Orders with their customer and the words that their report page uses."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "c_name",
        "c_mktsegment",
        F.year("o_orderdate").cast("string").alias("year"),
        _amount().alias("amount"),
        _cases("c_mktsegment", BRAND_OF_SEGMENT).alias("brand"),
        _report_url("o_orderkey").alias("url"),
    )


def _report_html() -> Column:
    c = F.col
    erp = (
        F.when(c("o_orderpriority") == "5-LOW", F.lit("The sapling nursery grew."))
        .when(c("o_orderstatus") == "F", F.concat(c("c_name"), F.lit(" runs "), c("brand"), F.lit(" as its ERP.")))
        .when(c("o_orderstatus") == "O", F.concat(F.lit("The group migrated its ERP to "), c("brand"), F.lit(" &amp; Salesforce.")))
        .otherwise(F.concat(F.lit("Partners include "), c("brand"), F.lit(".")))
    )
    revenue = (
        F.when(
            c("o_orderpriority") == "5-LOW",
            F.concat(F.lit("In "), c("year"), F.lit(" it made "), c("amount"), F.lit(" in sales.")),
        )
        .when(
            c("o_orderstatus") == "P",
            F.concat(F.lit("Its turnover reached "), c("amount"), F.lit(".")),
        )
        .otherwise(
            F.concat(c("c_name"), F.lit(" posted annual revenue of "), c("amount"), F.lit(" in "), c("year"), F.lit(", and revenue grew by 12.5%."))
        )
    )
    size = (
        F.when(c("o_orderstatus") == "F", F.lit("a large enterprise"))
        .when(c("o_orderstatus") == "O", F.lit("a mid-sized firm"))
        .otherwise(F.lit("no start-up"))
    )
    business = _cases(
        "c_mktsegment",
        {"AUTOMOBILE": "manufacturer", "BUILDING": "consulting firm", "FURNITURE": "wholesaler", "HOUSEHOLD": "distributor", "MACHINERY": "factory"},
    )
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), c("c_name"), F.lit(" report "), c("year"),
        F.lit('</title><script>var r = "revenue of USD 1 million";</script></head><body><h1>'),
        c("c_name"), F.lit(" annual report</h1><p>"), revenue, F.lit("<p><b>"), erp,
        F.lit('</b></p><ul><li>It is '), size, F.lit('</li><li><a href="/about">A '), business,
        F.lit("</a></li></ul><!-- oracle --></body></html>"),
    )


def web_pages(spark, sf_dir) -> DataFrame:
    """Given pages and report pages: ``url, html``.

    Orders are spread over the cluster before their rows grow into pages.
    """
    spread = _orders(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    reports = spread.select("url", _report_html().alias("html"))
    return table(spark, sf_dir, "pages").select("url", "html").unionByName(reports)


def raw_hits(spark, sf_dir) -> DataFrame:
    """Hits with nulls where the search API leaves a key out, and the model's score.

    Lines meet their order as narrow rows, and both go to their company; places and texts are
    made there. So rows stay narrow until nothing moves any more, and what goes on by company
    needs no further exchange.
    """
    c = F.col
    given = table(spark, sf_dir, "pages").groupBy("page_id").agg(F.collect_list(F.struct(c("url").alias("page_url"))).alias("given"))
    # All urls of a page meet its lines before their places are counted. They are written first,
    # which tells Spark their size: few enough are broadcast, and no line moves for them.
    flag = F.when(c("l_returnflag") == "R", 1).when(c("l_returnflag") == "A", 2).alias("flag")
    at = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "flag", "open"]
    lines = (
        table(spark, sf_dir, "lineitem")
        .where("l_orderkey IS NOT NULL")
        .select("l_orderkey", *at[:4], flag, (c("l_linestatus") == "O").alias("open"))
        .join(cut(given), c("l_partkey") == c("page_id"), "left")
        .select("l_orderkey", *at, "given")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    reports = orders.withColumn("search_type", F.lit(REVENUE))
    erp = orders.join(lines, c("o_orderkey") == c("l_orderkey")).withColumn("search_type", F.lit(ERP))
    # A line's place in its order goes by number, part, supplier and price.
    window = Window.partitionBy("company_id", "search_type").orderBy("o_orderkey", *at)
    placed = (
        reports.unionByName(erp.drop("l_orderkey"), allowMissingColumns=True)
        # Before texts are made, also where customers are few enough to be broadcast.
        .repartition("o_custkey")
        .join(customers, c("o_custkey") == c("c_custkey"))
        .withColumnRenamed("o_custkey", "company_id")
        .withColumn("place", F.row_number().over(window))
        .select("*", F.inline_outer("given"))
    )
    year, brand = F.year("o_orderdate").cast("string"), _cases("c_mktsegment", BRAND_OF_SEGMENT)
    is_report = c("search_type") == REVENUE
    title = (
        F.when(
            is_report,
            F.when(c("o_orderstatus") == "F", F.concat(c("c_name"), F.lit(" annual report "), year))
            .when(c("o_orderstatus") == "O", F.concat("c_name", F.lit(" quarterly sales, about us"))),
        )
        .when(c("flag") == 1, F.concat(c("c_name"), F.lit(" careers: "), brand, F.lit(" consultant")))
        .when(c("flag") == 2, F.concat(brand, F.lit(" case study, implementation at "), "c_name"))
    )
    own = is_report | (c("l_linenumber") <= 2)
    url = F.when(own, _report_url("o_orderkey")).otherwise(
        F.coalesce("page_url", F.concat(F.lit("https://parts.example.com/jobs/"), "l_partkey"))
    )
    snippet = (
        F.when(
            is_report,
            F.when(c("o_orderpriority") != "5-LOW", F.concat(F.lit("Revenue of "), _amount(), F.lit(" in "), year)),
        )
        .when(c("open"), F.lit("Press release. Subscribe to read."))
        .otherwise(F.concat(F.lit("Our customers on "), brand))
    )
    score = F.when(is_report, F.substring("o_orderpriority", 1, 1).cast("int") * 2).otherwise(c("l_linenumber") + 2)
    return placed.select(
        "company_id",
        "search_type",
        (c("place") - 1).alias("pos"),
        title.alias("title"),
        url.alias("url"),
        snippet.alias("snippet"),
        score.alias("score"),
    )


def hits(raw_hits: DataFrame) -> DataFrame:
    """Search hits with the default texts in place."""
    return raw_hits.select(
        "company_id",
        "search_type",
        "pos",
        F.coalesce("title", F.lit("No Title")).alias("title"),
        "url",
        F.coalesce("snippet", F.lit("No description available")).alias("snippet"),
    )


def _quoted(text: Column) -> Column:
    """As ``to_json`` writes it, which only texts that need an escape go through."""
    written = F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":|\}$', "")
    plain = ~text.rlike(r'["\\\x00-\x1f]')
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(written)


def search_responses(spark, sf_dir, raw_hits: DataFrame) -> DataFrame:
    """Search API responses; broken for customers in debt, listless for one segment."""
    c = F.col
    item = F.struct("title", F.col("url").alias("link"), "snippet")
    listed = raw_hits.groupBy("company_id", "search_type").agg(
        F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("items")
    )
    body = F.to_json(F.struct(F.col("items.item").alias("organic")))
    customers = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("company_id"), "c_acctbal", "c_mktsegment"
    )
    no_list = (c("c_mktsegment") == "BUILDING") & (c("search_type") == ERP)
    return listed.join(customers, "company_id").select(
        "company_id",
        "search_type",
        F.when(c("c_acctbal") < 0, F.regexp_replace(body, r"\}$", ""))
        .when(no_list, F.lit('{"answerBox": {}}'))
        .otherwise(body)
        .alias("raw"),
    )


def score_responses(spark, sf_dir, raw_hits: DataFrame) -> DataFrame:
    """Curation responses of a model.

    Customers in debt get broken JSON, BUILDING customers below 2,000 an empty
    list, MACHINERY customers their first hit again, FURNITURE ones an invented
    url, and some scores come as text or with a decimal point.
    """
    c = F.col
    numbered = F.when(c("search_type") == ERP, F.concat(F.lit('"'), "score", F.lit('"'))).otherwise(
        F.concat("score", F.lit(".0"))
    )
    item = F.concat(
        F.lit('{"url": '), _quoted(c("url")), F.lit(', "score": '), numbered,
        F.lit(', "reason": "hit '), "pos", F.lit('"}'),
    )
    listed = raw_hits.groupBy("company_id", "search_type").agg(
        F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("items")
    )
    customers = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("company_id"), "c_acctbal", "c_mktsegment"
    )
    items = F.col("items.item")
    more = (
        F.when(c("c_mktsegment") == "MACHINERY", F.slice(items, 1, 1))
        .when(
            c("c_mktsegment") == "FURNITURE",
            F.array(F.lit('{"url": "https://invented.example.com/", "score": 10, "reason": "made up"}')),
        )
        .otherwise(F.array().cast("array<string>"))
    )
    body = F.concat(
        F.lit('{"scored_links": ['), F.array_join(F.concat(items, more), ", "), F.lit("]}")
    )
    empty = (c("c_mktsegment") == "BUILDING") & (c("c_acctbal") < 2000)
    return listed.join(customers, "company_id").select(
        "company_id",
        "search_type",
        F.when(c("c_acctbal") < 0, F.regexp_replace(body, r"\}\]\}$", ""))
        .when(empty, F.lit('{"scored_links": []}'))
        .otherwise(body)
        .alias("raw"),
    )


def extraction_responses(spark, sf_dir) -> DataFrame:
    """Extraction responses of a model, one per customer.

    Above 9,000 the notes are absent; HOUSEHOLD customers below 1,000 have a
    confidence with a fraction; the rest is valid, with nulls.
    """
    c = F.col
    customers = table(spark, sf_dir, "customer")

    def text(value: Column) -> Column:
        return F.when(value.isNull(), F.lit("null")).otherwise(
            F.concat(F.lit('"'), value, F.lit('"'))
        )

    brand = F.when(c("c_acctbal") >= 500, _cases("c_mktsegment", BRAND_OF_SEGMENT))
    revenue = F.when(
        c("c_acctbal") >= 1500,
        F.concat(F.lit("USD "), F.floor(c("c_acctbal") / F.lit(50)).cast("bigint"), F.lit(" million")),
    )
    band = (
        F.when(c("c_acctbal") < 1500, F.lit(None))
        .when(c("c_acctbal") < 2500, F.lit("$10M-$50M"))
        .when(c("c_acctbal") < 5000, F.lit("$50M-$100M"))
        .otherwise(F.lit("$100M+"))
    )
    confidence = F.when(
        (c("c_mktsegment") == "HOUSEHOLD") & (c("c_acctbal") < 1000), F.lit("7.5")
    ).otherwise(F.concat((c("c_nationkey") + 1).cast("string")))
    notes = F.when(c("c_acctbal") > 9000, F.lit("")).otherwise(
        F.concat(F.lit(', "notes": "segment '), c("c_mktsegment"), F.lit('"'))
    )
    return customers.select(
        c("c_custkey").alias("company_id"),
        F.concat(
            F.lit('{"erp_system": '), text(brand),
            F.lit(', "erp_confidence": '), confidence,
            F.lit(', "annual_revenue": '), text(revenue),
            F.lit(', "revenue_confidence": "8"'),
            F.lit(', "revenue_range": '), text(band),
            F.lit(', "company_size": "Medium", "business_type": null'),
            notes,
            F.lit(', "extra": [1]}'),
        ).alias("raw"),
    )


def order_responses(spark, sf_dir) -> DataFrame:
    """A nested response per order. By the last digit of its key it has: 3, a fraction as the
    quantity of its lines numbered 2; 4, an unknown status; 5, no amount; 6, no closing brace;
    7, no note; 8, an empty note and amounts as text; others fit."""
    c = F.col
    digit = c("o_orderkey") % 10
    quantity = F.when((c("l_orderkey") % 10 == 3) & (c("l_linenumber") == 2), F.lit("7.5")).otherwise(
        c("l_quantity").cast("int").cast("string")
    )
    line = F.struct(
        c("l_linenumber").alias("number"),
        quantity.alias("quantity"),
        F.when(c("l_linestatus") == "F", F.lit("yes")).otherwise(F.lit("no")).alias("final"),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct(order.alias("order"), line.alias("line")))).alias("lines"))
        .select(c("l_orderkey").alias("o_orderkey"), F.to_json(F.col("lines.line")).alias("lines"))
    )
    amount = F.when(digit == 8, F.concat(F.lit('"'), c("o_totalprice").cast("string"), F.lit('"'))).otherwise(
        c("o_totalprice").cast("string")
    )
    total = F.when(digit == 5, F.lit("{}")).otherwise(F.concat(F.lit('{"amount": '), amount, F.lit("}")))
    note = F.when(digit == 8, F.lit("null")).otherwise(_quoted(c("o_orderpriority")))
    body = F.concat(
        F.lit('{"order": '), "o_orderkey", F.lit(', "status": "'),
        F.when(digit == 4, F.lit("closed")).otherwise(c("o_orderstatus")), F.lit('"'),
        F.when(digit == 7, F.lit("")).otherwise(F.concat(F.lit(', "note": '), note)),
        F.lit(', "total": '), total, F.lit(', "lines": '), F.coalesce("lines", F.lit("[]")),
        F.when(digit == 6, F.lit("")).otherwise(F.lit("}")),
    )
    # Responses are read right away, at some cost a row: they are spread over the cluster first.
    spread = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").repartition(
        spark.sparkContext.defaultParallelism, "o_orderkey"
    )
    return spread.select("o_orderkey", body.alias("raw"))


def order_prompts(spark, sf_dir) -> DataFrame:
    """A question per order; all orders of a status and a priority ask the same."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("How late is an order of status "), "o_orderstatus", F.lit(" and priority "), "o_orderpriority", F.lit("?")).alias("prompt"),
    )

"""Rule extraction of ERP system, revenue, size and business type from pages.

Pages turn into small evidence rows first; page text never moves. The evidence of
a page is found once and joined with every link to it.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions import negation, rubric
from firmlens.functions import revenue as R
from firmlens.functions import text as X
from firmlens.functions.joins import SALTS, fan_out_join
from firmlens.functions.markdown import markdown

PAGE, ERP_BRAND, REVENUE, SIZE, TYPE, GROWTH, MARKET_CAP = (
    "page", "erp", "revenue", "size", "type", "growth", "market cap",
)

EVIDENCE = (
    "array<struct<kind string, value string, has_context boolean, year int, "
    "usd decimal(38,2)>>"
)


@dataclass
class Lexicons:
    """Word lists and exchange rates of the extraction, all replaceable. With ``negation``,
    brands, sizes and types count only where the sentence does not take them back."""

    brands: tuple = rubric.BRANDS
    context: list = field(default_factory=lambda: list(rubric.ERP_CONTEXT))
    sizes: dict = field(default_factory=lambda: dict(rubric.SIZES))
    types: dict = field(default_factory=lambda: dict(rubric.BUSINESS_TYPES))
    weak_sources: list = field(default_factory=lambda: list(rubric.WEAK_SOURCES))
    usd_rates: dict = field(default_factory=lambda: dict(R.USD_RATES))
    negation: bool = False


def _item(kind: str, value: Column, context=None, year=None, usd=None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        value.alias("value"),
        (F.lit(False) if context is None else context).alias("has_context"),
        (F.lit(None) if year is None else year).cast("int").alias("year"),
        (F.lit(None) if usd is None else usd).cast("decimal(38,2)").alias("usd"),
    )


def _terms(kind: str, padded: Column, classes: dict, context=None) -> Column:
    """One evidence item per occurrence of a term: ``classes`` is class -> terms."""
    names = {X.phrase(t): name for name, terms in classes.items() for t in terms}
    found = X.mentions(padded, list(names))
    items = F.transform(found, lambda phrase: _item(kind, X.lookup(phrase, names), context))
    return items.cast(EVIDENCE)


def _one(kind: str, value: Column, **more) -> Column:
    """One evidence item, or none when the value is empty."""
    return F.when(value != "", F.array(_item(kind, value, **more)).cast(EVIDENCE)).otherwise(
        F.array().cast(EVIDENCE)
    )


def page_evidence(pages: DataFrame, lexicons: Lexicons) -> DataFrame:
    """Evidence rows of page texts (``url, markdown`` and any further columns).

    Each non-blank page gives one ``page`` row, and one row per mention or figure
    with the words of its sentence.
    """
    kept = [c for c in pages.columns if c != "markdown"]
    sentence, lower = F.col("sentence"), F.col("lower")
    all_terms = [t for group in (lexicons.sizes, lexicons.types) for ts in group.values() for t in ts]
    # Blank pages give no sentences. A filter would move down to the scan and convert
    # every page a second time.
    split = F.when(F.trim("markdown") != "", X.sentences(F.col("markdown")))
    told = (
        pages.select(*kept, F.posexplode(split).alias("at", "sentence"))
        .withColumns({"words": X.padded(sentence), "lower": F.lower(sentence)})
        .withColumns(
            {
                "named": X.has_any(F.col("words"), [*lexicons.brands, *all_terms]),
                "money": lower.contains("revenue")
                | lower.contains("turnover")
                | lower.contains("sales"),
                "cap": lower.contains("market cap"),
            }
        )
    )
    # Each step is a column of its own, so that no pattern runs twice. A sentence without any of
    # it passes without cost and gives no item; a filter would move down and test it all again.
    figured = R.with_figure(told, sentence, F.col("money"), lexicons.usd_rates).withColumns(
        {
            "said": F.when(F.col("named"), negation.asserted(sentence)) if lexicons.negation else F.col("words"),
            "growth": F.when(F.col("money"), R.growth_rate(sentence)),
            "market_cap": F.when(F.col("cap"), R.market_cap(sentence)),
        }
    )
    context = X.has_any(F.col("words"), lexicons.context)
    none = F.array().cast(EVIDENCE)
    items = F.concat(
        F.when(F.col("at") == 0, F.array(_item(PAGE, F.lit(""))).cast(EVIDENCE)).otherwise(none),
        F.when(
            F.col("named"),
            F.concat(
                _terms(ERP_BRAND, F.col("said"), {b: [b] for b in lexicons.brands}, context),
                _terms(SIZE, F.col("said"), lexicons.sizes),
                _terms(TYPE, F.col("said"), lexicons.types),
            ),
        ).otherwise(none),
        _one(REVENUE, F.col("amount"), year=F.col("amount_year"), usd=F.col("amount_usd")),
        _one(GROWTH, F.col("growth")),
        _one(MARKET_CAP, F.col("market_cap")),
    )
    return figured.select(*kept, "words", F.inline(items))


def link_evidence(
    links: DataFrame, pages: DataFrame, companies: DataFrame, lexicons: Lexicons
) -> DataFrame:
    """Evidence of each company from its links: rows with a ``level`` of trust.

    A sentence that names the company counts 8; otherwise a brand with ERP words
    nearby or a figure with a year counts 6, and a bare mention 4. A job or social
    page never counts more than 3.
    """
    weak = X.has_any(X.padded(F.concat_ws(" ", "title", "url")), lexicons.weak_sources)
    named = links.select("company_id", "url", weak.alias("weak")).join(
        companies.select("company_id", X.padded(F.col("company_name")).alias("name_words")),
        "company_id",
    )

    def evidence(found: DataFrame) -> DataFrame:
        text = found.select("url", SALTS, markdown(F.col("html")).alias("markdown"))
        return page_evidence(text, lexicons)

    rows = fan_out_join(
        named, pages.select("url", "html"), "url", ["company_id"], prepare=evidence, how="inner"
    )
    explicit = F.contains("words", "name_words")
    level = (
        F.when(explicit, 8)
        .when(F.col("has_context") | F.col("year").isNotNull(), 6)
        .otherwise(4)
    )
    return rows.select(
        "company_id", "url", "kind", "value", "year", "usd",
        F.when(F.col("weak"), F.least(level, F.lit(3))).otherwise(level).alias("level"),
    )


def company_findings(evidence: DataFrame) -> DataFrame:
    """Findings per company: each distinct value with confidence and mentions.

    Further pages that name the company add 1 each, up to 10. Both steps combine
    map-side, so a value repeated all over a page moves once.
    """
    value = ["company_id", "kind", "value", "year", "usd"]
    per_page = evidence.groupBy(*value, "url").agg(
        F.max("level").alias("level"), F.count("*").alias("n")
    )
    explicit_pages = F.count_if(F.col("level") == 8)
    best = F.max("level")
    extra = F.when(best == 8, F.least(F.lit(2), explicit_pages - 1)).otherwise(0)
    return per_page.groupBy(*value).agg(
        (best + extra).cast("int").alias("confidence"), F.sum("n").alias("mentions")
    )


def _pick(kind: str, *order: Column) -> Column:
    """The first finding of a kind in the given order, as a map-side aggregate."""
    ranked = F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)],
        F.col("value"), F.col("confidence"), F.col("mentions"), F.col("year"), F.col("usd"),
    )
    return F.min(F.when(F.col("kind") == kind, ranked)).alias(kind.replace(" ", "_"))


def extraction_records(findings: DataFrame) -> DataFrame:
    """One extraction record per company with any readable page."""
    by_mentions = -F.col("mentions")
    picked = findings.groupBy("company_id").agg(
        _pick(ERP_BRAND, -F.col("confidence"), by_mentions),
        _pick(
            REVENUE,
            -F.col("confidence"),
            -F.coalesce("year", F.lit(0)),
            -F.coalesce("usd", F.lit(0).cast("decimal(38,2)")),
        ),
        *[_pick(kind, by_mentions) for kind in (SIZE, TYPE, GROWTH, MARKET_CAP)],
    )
    year = F.col("revenue.year")
    amount = F.when(
        F.col("revenue.value").isNotNull(),
        F.concat(
            F.col("revenue.value"),
            F.when(year.isNotNull(), F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(F.lit("")),
        ),
    )

    def note(label: str, column: str, *more: Column) -> Column:
        return F.concat(F.lit(label + ": "), F.col(column + ".value"), *more)

    mentions = F.concat(F.lit(" ("), F.col("erp.mentions"), F.lit(" mentions)"))
    notes = F.concat_ws(
        "; ",
        note("ERP", "erp", mentions),
        F.concat(F.lit("Revenue: "), amount),
        note("Size", "size"),
        note("Type", "type"),
        note("Growth", "growth"),
        note("Market cap", "market_cap"),
    )
    return picked.select(
        "company_id",
        F.lit(None).cast("string").alias("error"),
        F.col("erp.value").alias("erp_system"),
        F.coalesce("erp.confidence", F.lit(1)).alias("erp_confidence"),
        amount.alias("annual_revenue"),
        F.coalesce("revenue.confidence", F.lit(1)).alias("revenue_confidence"),
        rubric.revenue_range(F.col("revenue.usd")).alias("revenue_range"),
        F.col("size.value").alias("company_size"),
        F.col("type.value").alias("business_type"),
        F.when(notes != "", notes).otherwise(F.lit("No clear information found")).alias("notes"),
    )


def extract(
    links: DataFrame, pages: DataFrame, companies: DataFrame, lexicons: Lexicons | None = None
) -> DataFrame:
    """Extraction records of the companies from deduplicated links and pages."""
    evidence = link_evidence(links, pages, companies, lexicons or Lexicons())
    return extraction_records(company_findings(evidence))


def erp_findings(records: DataFrame) -> DataFrame:
    return records.select("company_id", "erp_system", "erp_confidence")


def revenue_findings(records: DataFrame) -> DataFrame:
    return records.select("company_id", "annual_revenue", "revenue_confidence", "revenue_range")


def size_type_findings(records: DataFrame) -> DataFrame:
    return records.select("company_id", "company_size", "business_type")

"""Word lists of the scoring and extraction rules, and the rules per text.

The lists are arguments everywhere; these are the defaults.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmlens.functions import text as X
from firmlens.schemas import REVENUE, REVENUE_RANGES

# --- fixed values: brands and classes ---------------------------------------

BRANDS = (
    "SAP",
    "Oracle",
    "Microsoft Dynamics",
    "Salesforce",
    "NetSuite",
    "Tally",
    "QuickBooks",
)

# --- end of fixed values ----------------------------------------------------

# What a useful link for each kind of search looks like: category -> terms.
PRIORITIZE = {
    "revenue": {
        "annual reports": ["annual report", "financial statement", "financial statements", "balance sheet"],
        "investor filings": ["sec filing", "sec filings", "10 k", "investor relations"],
        "revenue directories": ["company profile", "turnover", "annual turnover", "revenue"],
        "financial news": ["quarterly results", "net profit", "quarterly sales", "earnings"],
        "government data": ["registrar of companies", "ministry of corporate affairs", "gov"],
        "investor pages": ["investors", "shareholders", "investor"],
        "industry reports": ["industry report", "market report", "market research"],
    },
    "erp": {
        "implementation news": ["implementation", "implements", "go live", "migrated"],
        "company software pages": ["our systems", "business software", "enterprise system", "enterprise systems"],
        "job posts naming a system": ["sap consultant", "oracle consultant", "erp consultant", "tally operator"],
        "case studies": ["case study", "case studies", "success story", "success stories"],
        "vendor customer lists": ["our customers", "customer list", "customer stories"],
        "industry publications": ["digital transformation", "technology adoption"],
        "press releases": ["press release", "announces", "selects"],
        "consulting clients": ["our clients", "client list", "implementation partner"],
        "technology directories": ["technology stack", "tech stack", "directory"],
    },
}

AVOID = {
    "revenue": {
        "job sites": ["careers", "jobs", "job", "hiring", "vacancy"],
        "general descriptions": ["about us", "who we are", "overview"],
        "social posts": ["facebook", "twitter", "instagram", "linkedin"],
        "news without figures": ["opinion", "editorial", "blog"],
        "product content": ["product page", "catalog", "user manual", "software download"],
    },
    "erp": {
        "purely financial": ["annual report", "stock price", "dividend", "quarterly results"],
        "general descriptions": ["about us", "who we are", "overview"],
        "job sites": ["careers", "jobs", "job", "hiring", "vacancy"],
        "social posts": ["facebook", "twitter", "instagram", "linkedin"],
        "unrelated technology": ["smartphone", "gadget", "video game"],
    },
}

JOB_CATEGORY = "job sites"

CREDIBLE = [
    "gov", "sec", "reuters", "bloomberg", "annual report", "filings", "press release",
    "official", "case study", "stock exchange",
]
GATED = ["login", "log in", "sign in", "subscribe", "subscription", "paywall", "members only"]

ERP_CONTEXT = [
    "erp", "enterprise resource planning", "business software", "business management software",
    "implementation", "implemented", "migrated", "integration", "integrated", "enterprise system",
    "enterprise systems", "implementation partner", "go live",
]

SIZES = {
    "Startup": ["startup", "start up", "early stage", "seed funded"],
    "Small": ["small business", "small enterprise", "small company", "micro enterprise", "msme"],
    "Medium": ["sme", "mid sized", "mid size", "medium sized", "medium enterprise", "mid market"],
    "Large": ["large company", "large business", "large employer", "large scale"],
    "Enterprise": ["large enterprise", "global enterprise", "multinational", "fortune 500", "conglomerate"],
}

BUSINESS_TYPES = {
    "Manufacturer": ["manufacturer", "manufacturers", "manufacturing", "manufactures", "factory"],
    "Distributor": ["distributor", "distributors", "distribution", "wholesaler", "stockist"],
    "Service Provider": ["service provider", "services provider", "consultancy", "consulting", "outsourcing"],
}

WEAK_SOURCES = [
    "careers", "jobs", "job", "hiring", "vacancy", "facebook", "twitter", "instagram", "linkedin",
]


def kind_of_search(search_type: Column) -> Column:
    """``revenue`` in any case is revenue; everything else is an ERP search."""
    return F.when(F.lower(search_type) == REVENUE, F.lit("revenue")).otherwise(F.lit("erp"))


def vocabulary() -> list[str]:
    """All terms that the rules for links look for."""
    lists = [terms for rules in (PRIORITIZE, AVOID) for kind in rules.values() for terms in kind.values()]
    return sorted({*BRANDS, *CREDIBLE, *GATED, *(term for terms in lists for term in terms)})


def categories(hits: Column, kind: str) -> tuple[Column, Column]:
    """Names of the useful and of the unwanted categories by the terms found in a text."""
    has = lambda terms: X.hit_any(hits, terms, vocabulary())
    brand = has(BRANDS)
    useful = [F.when(has(terms), F.lit(c)) for c, terms in PRIORITIZE[kind].items()]
    unwanted = []
    for category, terms in AVOID[kind].items():
        hit = has(terms)
        if kind == "erp" and category == JOB_CATEGORY:
            hit = hit & ~brand
        unwanted.append(F.when(hit, F.lit("avoid " + category)))
    return F.array(*useful), F.array(*unwanted)


def link_score(n_useful: Column, n_unwanted: Column, credible: Column, gated: Column) -> Column:
    """Score 1-10: relevance 70 %, credibility 20 %, free access 10 %; whole numbers only."""
    relevance = F.greatest(F.lit(0), F.least(F.lit(2), n_useful - n_unwanted))
    points = (
        F.lit(35) * relevance
        + F.lit(20) * credible.cast("int")
        + F.lit(10) * (~gated).cast("int")
    )
    return (F.lit(1) + F.floor(points * F.lit(9) / F.lit(100))).cast("int")


def revenue_range(usd: Column) -> Column:
    """Range class of a yearly revenue in US dollars; lower bounds are inclusive."""
    under_1m, to_10m, to_50m, to_100m, above = REVENUE_RANGES
    return (
        F.when(usd.isNull(), F.lit(None).cast("string"))
        .when(usd < 1_000_000, F.lit(under_1m))
        .when(usd < 10_000_000, F.lit(to_10m))
        .when(usd < 50_000_000, F.lit(to_50m))
        .when(usd < 100_000_000, F.lit(to_100m))
        .otherwise(F.lit(above))
    )

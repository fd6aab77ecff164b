"""Prompt texts for the two model stages, rendered as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: prompt texts ---------------------------------------------
# {company}, {links} and {content} are filled in per row.

REVENUE_LINKS_PROMPT = """You are a research analyst evaluating web links for finding REVENUE and FINANCIAL information about '{company}'.

Score each link from 1-10 based on:
- Likelihood of containing revenue/financial data (70%)
- Source credibility and reliability (20%)
- Accessibility (no paywalls/login required) (10%)

PRIORITIZE for REVENUE search:
- Company annual reports and financial statements
- SEC filings and investor relations pages
- Business directories with revenue/turnover data
- Financial news articles with specific revenue figures
- Government databases with financial information
- Company websites with investor/financial sections
- Industry reports with company financials

AVOID for REVENUE search:
- Job posting sites
- General company descriptions without financial data
- Social media posts
- News articles without specific financial figures
- Technology/product focused content

Links to evaluate:
{links}

Focus specifically on revenue, turnover, financial performance, and company size indicators."""

ERP_LINKS_PROMPT = """You are a research analyst evaluating web links for finding ERP SYSTEMS and TECHNOLOGY information about '{company}'.

Score each link from 1-10 based on:
- Likelihood of containing ERP/technology system information (70%)
- Source credibility and reliability (20%)
- Accessibility (no paywalls/login required) (10%)

PRIORITIZE for ERP search:
- News articles about technology implementations
- Company websites mentioning software systems
- Job postings mentioning specific ERP systems
- Case studies and success stories
- Technology vendor websites with customer lists
- Industry publications about tech adoption
- Company press releases about system implementations
- IT consulting firm websites with client mentions
- Business directories with technology details

AVOID for ERP search:
- Pure financial/revenue focused content
- General company descriptions without tech details
- Job postings (unless they mention specific ERP systems)
- Social media posts
- Unrelated technology news

Look specifically for mentions of (if possible): SAP, Oracle, Microsoft Dynamics, Salesforce, NetSuite, Tally, QuickBooks, ERP systems, business software, enterprise systems.

Links to evaluate:
{links}

Focus specifically on ERP systems, business software, and technology implementations."""

EXTRACTION_PROMPT = """You are a business analyst extracting ERP system and revenue information from web content about '{company}'.

Analyze the following content and extract:

1. ERP SYSTEM: Look for mentions of:
   - Enterprise Resource Planning (ERP) systems
   - Business management software
   - Specific ERP brands: SAP, Oracle, Microsoft Dynamics, Salesforce, NetSuite, Tally, QuickBooks, etc.
   - Implementation partners or consultants
   - You can also infer the ERP systems from social posts, job postings, and other sources.(but they will have low confidence)
   - System integrations

2. REVENUE INFORMATION: Look for:
   - Annual revenue/turnover figures
   - Sales figures
   - Financial performance data
   - Revenue growth percentages
   - Market capitalization

3. COMPANY SIZE INDICATORS: Look for:
   - Company classification (SME, Large Enterprise, etc.)
   - Business scale indicators

CONTENT TO ANALYZE:
{content}

Instructions:
- Be conservative with confidence scores (only give 8-10 for explicit mentions)
- For revenue, include currency and year if available
- Categorize revenue into ranges: Under $1M, $1M-$10M, $10M-$50M, $50M-$100M, $100M+
- If no clear information is found, set fields to null and confidence to 1-3
- Provide reasoning in notes field"""

# --- end of fixed values ----------------------------------------------------


def render(template: str, **slots: Column) -> Column:
    """Fill the named slots of a template, each of which occurs once."""
    parts, rest = [], template
    for name, value in sorted(slots.items(), key=lambda s: template.index("{" + s[0] + "}")):
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))

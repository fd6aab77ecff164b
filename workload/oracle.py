"""SQL counterparts of the registered queries, for an independent engine.

Each text is put together from common table expressions; patterns and word lists
come from the library, the logic does not.
"""

from firmlens.functions import markdown as M
from firmlens.functions import negation as N
from firmlens.functions import prompts as P
from firmlens.functions import revenue as R
from firmlens.functions import rubric
from firmlens.functions import text as X
from firmlens.operators import corpus_search as S
from firmlens.schemas import NA_VALUES, NO_SNIPPET, NO_TITLE
from workload.tables import BRAND_OF_SEGMENT


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cases(column: str, values: dict) -> str:
    whens = " ".join(f"when {lit(k)} then {lit(str(v))}" for k, v in values.items())
    return f"case {column} {whens} end"


BLANK_CHARS = lit(X.BLANKS)
WORD_GAP = lit(X.NOT_A_WORD)


def words(text: str) -> str:
    return f"(' ' || trim(regexp_replace(lower({text}), {WORD_GAP}, '  ', 'g')) || ' ')"


def any_of(text: str, terms) -> str:
    return f"regexp_matches({text}, {lit(X.phrase_pattern(terms))})"


def markdown(html: str) -> str:
    text = html
    for pattern, replacement in M.REWRITES:
        replacement = replacement.replace("$1", r"\1").replace("$2", r"\2")
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)}, 'g')"
    for old, new in M.LITERALS:
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    for pattern, replacement in M.CLEAN_UP:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return f"trim({text}, {lit(' ' + chr(10))})"


# --- derived tables ----------------------------------------------------------

CO = """co as (
  select c_custkey company_id, c_name company_name, n_name as location, c_mktsegment industry,
         c_acctbal bal, c_nationkey nk
  from customer join nation on c_nationkey = n_nationkey)"""

ORD = f"""ord as (
  select o_orderkey, o_custkey company_id, o_orderstatus st, o_orderpriority pr, c_name,
         c_mktsegment seg, cast(year(o_orderdate) as varchar) yr,
         case o_orderstatus when 'F' then 'USD' when 'O' then 'INR' when 'P' then '€' end
           || ' ' || (u // 100) || '.' || lpad(cast(u % 100 as varchar), 2, '0')
           || case o_orderpriority when '1-URGENT' then ' million' when '2-HIGH' then ' thousand'
                when '3-MEDIUM' then ' crore' when '4-NOT SPECIFIED' then ' lakh' else '' end amount,
         {cases('c_mktsegment', BRAND_OF_SEGMENT)} brand,
         'https://filings.example.com/' || o_orderkey url
  from (select *, cast(round(o_totalprice * 100) as bigint) // 1000 u from orders)
  join customer on o_custkey = c_custkey)"""

WEB = """web as (
  select url, html from pages
  union all
  select url, '<!DOCTYPE html><html><head><title>' || c_name || ' report ' || yr
    || '</title><script>var r = "revenue of USD 1 million";</script></head><body><h1>'
    || c_name || ' annual report</h1><p>'
    || case when pr = '5-LOW' then 'In ' || yr || ' it made ' || amount || ' in sales.'
            when st = 'P' then 'Its turnover reached ' || amount || '.'
            else c_name || ' posted annual revenue of ' || amount || ' in ' || yr
                 || ', and revenue grew by 12.5%.' end
    || '<p><b>'
    || case when pr = '5-LOW' then 'The sapling nursery grew.'
            when st = 'F' then c_name || ' runs ' || brand || ' as its ERP.'
            when st = 'O' then 'The group migrated its ERP to ' || brand || ' &amp; Salesforce.'
            else 'Partners include ' || brand || '.' end
    || '</b></p><ul><li>It is '
    || case st when 'F' then 'a large enterprise' when 'O' then 'a mid-sized firm' else 'no start-up' end
    || '</li><li><a href="/about">A '
    || case seg when 'AUTOMOBILE' then 'manufacturer' when 'BUILDING' then 'consulting firm'
         when 'FURNITURE' then 'wholesaler' when 'HOUSEHOLD' then 'distributor' else 'factory' end
    || '</a></li></ul><!-- oracle --></body></html>' html
  from ord)"""

RAW = """raw_hits as (
  select company_id, 'revenue' search_type, cast(place - 1 as integer) pos,
         case st when 'F' then c_name || ' annual report ' || yr
                 when 'O' then c_name || ' quarterly sales, about us' end title,
         url, case when pr <> '5-LOW' then 'Revenue of ' || amount || ' in ' || yr end snippet,
         2 * cast(substr(pr, 1, 1) as integer) score
  from (select *, row_number() over (partition by company_id order by o_orderkey) place from ord)
  union all
  select company_id, 'ERP', cast(place - 1 as integer),
         case l_returnflag when 'R' then c_name || ' careers: ' || brand || ' consultant'
              when 'A' then brand || ' case study, implementation at ' || c_name end,
         case when l_linenumber <= 2 then lines.url
              else coalesce(pages.url, 'https://parts.example.com/jobs/' || l_partkey) end,
         case when l_linestatus = 'O' then 'Press release. Subscribe to read.'
              else 'Our customers on ' || brand end,
         l_linenumber + 2
  from (select *, row_number() over (partition by company_id order by
                    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) place
        from lineitem join ord on l_orderkey = o_orderkey) lines
  left join pages on l_partkey = page_id),
hits as (
  select company_id, search_type, pos, coalesce(title, 'No Title') title, url,
         coalesce(snippet, 'No description available') snippet, score
  from raw_hits)"""

SCORES = """scores as (
  select company_id, search_type, cast(row_number() over (
           partition by company_id, search_type order by again, pos) - 1 as integer) scored_pos,
         url, score, reason
  from (
    select 0 again, company_id, search_type, pos, url, score, 'hit ' || pos reason
    from hits
    union all
    select 1, company_id, search_type, pos, url, score, 'hit ' || pos
    from hits join co using (company_id) where pos = 0 and industry = 'MACHINERY'
    union all
    select 1, company_id, search_type, 0, 'https://invented.example.com/', 10, 'made up'
    from hits join co using (company_id) where pos = 0 and industry = 'FURNITURE')
  join co using (company_id)
  where bal >= 0 and not (industry = 'BUILDING' and bal < 2000))"""


def curated(scores: str, name: str) -> str:
    return f"""{name} as (
  select company_id, search_type, cast(rk as integer) "rank", pos, title, url, snippet
  from (
    select s.company_id, s.search_type, s.url, h.pos, h.title, h.snippet,
           row_number() over (partition by s.company_id, s.search_type
                              order by s.score desc, s.scored_pos) rk
    from {scores} s join (
      select * from hits qualify row_number() over (
        partition by company_id, search_type, url order by pos) = 1) h
    on s.company_id = h.company_id and s.search_type = h.search_type and s.url = h.url
    where s.score >= 6)
  where rk <= 3)"""


FALLBACK = """curated as (
  select * from chosen
  union all
  select company_id, search_type, pos + 1, pos, title, url, snippet
  from hits join co using (company_id) where bal < 0 and pos < 3)"""


def dedup(source: str) -> str:
    return f"""links as (
  select company_id, search_type, type_ord, "rank", title, url, snippet
  from (select *, case search_type when 'revenue' then 0 else 1 end type_ord from {source})
  where url <> ''
  qualify row_number() over (partition by company_id, url order by type_ord, "rank") = 1)"""


MD = f"md as (select url, {markdown('html')} markdown from web)"

CONTENT = """content as (
  select company_id, string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10)
                                order by type_ord, "rank") content
  from links join md using (url) where markdown <> '' group by company_id)"""

BY_MODEL = [CO, ORD, RAW, SCORES, curated("scores", "chosen"), FALLBACK, dedup("curated")]


def query(ctes: list[str], body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body


# --- rule scores -------------------------------------------------------------


def _rating(kind: str) -> tuple[str, str]:
    def flag(condition: str) -> str:
        return f"cast({condition} as integer)"

    brand = any_of("w", rubric.BRANDS)
    plus, minus, reasons = [], [], []
    for category, terms in rubric.PRIORITIZE[kind].items():
        plus.append(flag(any_of("w", terms)))
        reasons.append(f"case when {any_of('w', terms)} then {lit(category)} end")
    for category, terms in rubric.AVOID[kind].items():
        hit = any_of("w", terms)
        if kind == "erp" and category == "job sites":
            hit = f"({hit} and not {brand})"
        minus.append(flag(hit))
        reasons.append(f"case when {hit} then {lit('avoid ' + category)} end")
    credible, gated = any_of("w", rubric.CREDIBLE), any_of("w", rubric.GATED)
    reasons.append(f"case when {credible} then 'credible source' end")
    reasons.append(f"case when {gated} then 'gated' end")
    rel = f"greatest(0, least(2, {' + '.join(plus)} - ({' + '.join(minus)})))"
    points = f"(35 * {rel} + 20 * {flag(credible)} + 10 * {flag('not ' + gated)})"
    return f"cast(1 + ({points} * 9) // 100 as integer)", f"concat_ws(', ', {', '.join(reasons)})"


_rev_score, _rev_reason = _rating("revenue")
_erp_score, _erp_reason = _rating("erp")

RULE_SCORES = f"""rule_scores as (
  select company_id, search_type, pos scored_pos, url,
         case when search_type = 'revenue' then {_rev_score} else {_erp_score} end score,
         case when search_type = 'revenue' then {_rev_reason} else {_erp_reason} end reason
  from (select *, {words("concat_ws(' ', title, snippet, url)")} w from hits))"""

ONCE = """once as (
  select * from rule_scores qualify row_number() over (
    partition by company_id, search_type, url order by scored_pos) = 1)"""

BY_RULES = [CO, ORD, RAW, RULE_SCORES, ONCE, curated("once", "chosen"), dedup("chosen")]

# --- rule extraction ---------------------------------------------------------

_abbr = lit(X.ABBREVIATION_DOT)
SENTENCES = f"""sent as (
  select url, unnest(parts) sentence from (
    select url, regexp_split_to_array(
             regexp_replace(markdown, {_abbr}, '\\1\\2', 'g'), {lit(X.SENTENCE_END)}) parts
    from md where markdown <> '' and url in (select url from links))),
said as (select *, {words('sentence')} w from sent)"""


def _rewrites(text: str, rewrites) -> str:
    for pattern, replacement in rewrites:
        replacement = replacement.replace("$1", r"\1").replace("$2", r"\2")
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return text


_padded = "' ' || trim({}) || ' '"
_clauses = _rewrites("(" + _padded.format(_rewrites("lower(sentence)", N.WORDS)) + ")", N.CLAUSES)
_kept = f"array_to_string(list_transform(string_split({_clauses}, '{N.CLAUSE}'), lambda c: {_rewrites('c', N.SCOPES)}), ' ')"
ASSERTED = SENTENCES.replace("select *, ", f"select *, {_padded.format(_rewrites(_kept, N.TOGETHER))} a, ")


def _mentions(kind: str, classes: dict, context: str = "false", text: str = "w") -> str:
    names = {X.phrase(t): name for name, ts in classes.items() for t in ts}
    pattern = lit(X.phrase_pattern(list(names)))
    return f"""select url, w, '{kind}' kind, {cases('phrase', names)} as value, ctx,
       cast(null as integer) yr, cast(null as decimal(38,2)) usd
  from (select url, w, {context} ctx, unnest(regexp_extract_all({text}, {pattern}, 1)) phrase from said)"""


def _amount(symbol: str, number: str, scale: str) -> str:
    return f"concat_ws(' ', nullif({symbol}, ''), nullif({number}, ''), nullif({scale}, ''))"


_after, _before = lit(R.AFTER_KEYWORD), lit(R.BEFORE_KEYWORD)
_growth, _cap = lit(R.GROWTH), lit(R.MARKET_CAP)
_scale = " ".join(f"when {lit(k)} then {v}" for k, v in R.SCALES.items())
_rate = " ".join(f"when {lit(k)} then {R.USD_RATES[v]}" for k, v in R.CURRENCIES.items())

def evidence(text: str) -> str:
    return f"""figure as (
  select url, w, sentence,
         case when regexp_extract(sentence, {_after}, 2) <> '' then
           [regexp_extract(sentence, {_after}, 1), regexp_extract(sentence, {_after}, 2),
            regexp_extract(sentence, {_after}, 3), regexp_extract(sentence, {_after}, 0)]
         else [regexp_extract(sentence, {_before}, 1), regexp_extract(sentence, {_before}, 2),
               regexp_extract(sentence, {_before}, 3), regexp_extract(sentence, {_before}, 0)] end f
  from said),
matched as (
  select url, w, sentence, f, regexp_extract(f[4], {lit(R.FIRST_AMOUNT)}, 0) written
  from figure where f[2] <> ''),
placed as (
  select url, w, f, substr(sentence, 1, place - 1) head, substr(sentence, place + length(f[2])) tail
  from (select *, strpos(sentence, f[4]) + strpos(f[4], written) + strpos(written, f[2]) - 2 place
        from matched)),
dated as (
  select url, w, f,
         nullif(regexp_extract(tail, {lit(R.YEAR_AFTER)}, 2), '') ya,
         nullif(regexp_extract(head, {lit(R.YEAR_BEFORE)}, 1), '') yb,
         length(regexp_extract(tail, {lit(R.YEAR_AFTER)}, 1)) ga,
         length(regexp_extract(head, {lit(R.YEAR_BEFORE)}, 2)) gb
  from placed),
evidence as (
  {_mentions('erp', {b: [b] for b in rubric.BRANDS}, any_of('w', rubric.ERP_CONTEXT), text)}
  union all {_mentions('size', rubric.SIZES, text=text)}
  union all {_mentions('type', rubric.BUSINESS_TYPES, text=text)}
  union all
  select url, w, 'revenue', {_amount('f[1]', 'f[2]', 'f[3]')}, false,
         cast(case when ya is not null and (yb is null or ga <= gb) then ya else yb end as integer),
         cast(cast(cast(replace(f[2], ',', '') as decimal(18,4))
                   * cast(case lower(f[3]) {_scale} else 1 end as decimal(10,0)) as decimal(24,2))
              * cast(case lower(f[1]) {_rate} end as decimal(12,6)) as decimal(38,2))
  from dated
  union all
  select url, w, 'growth', regexp_extract(sentence, {_growth}, 1) || '%', false, null, null
  from said where regexp_extract(sentence, {_growth}, 1) <> ''
  union all
  select url, w, 'market cap', {_amount(f'regexp_extract(sentence, {_cap}, 1)', f'regexp_extract(sentence, {_cap}, 2)', f'regexp_extract(sentence, {_cap}, 3)')}, false, null, null
  from said where regexp_matches(sentence, {_cap})),
found as (
  select company_id, kind, value, yr, usd, e.url,
         max(case when weak then least(3, lvl) else lvl end) lvl, count(*) n
  from (select l.company_id, l.url, ev.kind, ev.value, ev.yr, ev.usd,
               {any_of(words("concat_ws(' ', l.title, l.url)"), rubric.WEAK_SOURCES)} weak,
               case when contains(ev.w, {words('c.company_name')}) then 8
                    when ev.ctx or ev.yr is not null then 6 else 4 end lvl
        from links l join co c using (company_id) join evidence ev on ev.url = l.url) e
  group by all),
rated as (
  select company_id, kind, value, yr, usd,
         max(lvl) + case when max(lvl) = 8 then least(2, count(*) filter (lvl = 8) - 1) else 0 end conf,
         sum(n) n
  from found group by all),
best as (
  select * from rated qualify row_number() over (
    partition by company_id, kind
    order by case when kind in ('erp', 'revenue') then -conf else 0 end,
             case when kind = 'revenue' then -coalesce(yr, 0) else -n end,
             case when kind = 'revenue' then -coalesce(usd, 0) else 0 end, value) = 1),
records as (
  select company_id,
    max(value) filter (kind = 'erp') erp_system,
    cast(coalesce(max(conf) filter (kind = 'erp'), 1) as integer) erp_confidence,
    max(value || coalesce(' (' || yr || ')', '')) filter (kind = 'revenue') annual_revenue,
    cast(coalesce(max(conf) filter (kind = 'revenue'), 1) as integer) revenue_confidence,
    max(case when usd < 1000000 then 'Under $1M' when usd < 10000000 then '$1M-$10M'
             when usd < 50000000 then '$10M-$50M' when usd < 100000000 then '$50M-$100M'
             when usd is not null then '$100M+' end) filter (kind = 'revenue') revenue_range,
    max(value) filter (kind = 'size') company_size,
    max(value) filter (kind = 'type') business_type,
    coalesce(string_agg(case kind
        when 'erp' then 'ERP: ' || value || ' (' || n || ' mentions)'
        when 'revenue' then 'Revenue: ' || value || coalesce(' (' || yr || ')', '')
        when 'size' then 'Size: ' || value when 'type' then 'Type: ' || value
        when 'growth' then 'Growth: ' || value else 'Market cap: ' || value end, '; '
      order by case kind when 'erp' then 1 when 'revenue' then 2 when 'size' then 3
                         when 'type' then 4 when 'growth' then 5 else 6 end)
      filter (kind is not null), 'No clear information found') notes
  from (select distinct company_id from links join md using (url) where markdown <> '')
  left join best using (company_id)
  group by company_id)"""

EVIDENCE = evidence("w")
RULE_RECORDS = [*BY_RULES, WEB, MD, SENTENCES, EVIDENCE]
ASSERTED_RECORDS = [*BY_RULES, WEB, MD, ASSERTED, evidence("a")]

# --- model extraction --------------------------------------------------------

ANSWERS = f"""answers as (
  select company_id,
         case when industry = 'HOUSEHOLD' and bal < 1000 and bal > 9000
                then 'erp_confidence, notes'
              when industry = 'HOUSEHOLD' and bal < 1000 then 'erp_confidence'
              when bal > 9000 then 'notes' end bad,
         case when bal >= 500 then {cases('industry', BRAND_OF_SEGMENT)} end erp_system,
         nk + 1 erp_confidence,
         case when bal >= 1500 then 'USD ' || cast(floor(bal / 50) as bigint) || ' million' end
           annual_revenue,
         8 revenue_confidence,
         case when bal < 1500 then null when bal < 2500 then '$10M-$50M'
              when bal < 5000 then '$50M-$100M' else '$100M+' end revenue_range,
         'Medium' company_size, cast(null as varchar) business_type,
         'segment ' || industry notes
  from co)"""

MODEL_RESULTS = """results as (
  select company_id, company_name, location, industry,
    case when read and bad is null then a.erp_system end erp_system,
    case when not read then 1 when bad is null then a.erp_confidence else 0 end erp_confidence,
    case when read and bad is null then a.annual_revenue end annual_revenue,
    case when not read then 1 when bad is null then a.revenue_confidence else 0 end
      revenue_confidence,
    case when read and bad is null then a.revenue_range end revenue_range,
    case when read and bad is null then a.company_size end company_size,
    case when read and bad is null then a.business_type end business_type,
    case when not read then 'No content could be scraped from search results'
         when bad is null then a.notes
         else 'Error during processing: missing or invalid in response: ' || bad end notes,
    case when read and bad is not null then 0 else cast(n as integer) end sources_found
  from (select co.*, coalesce(n, 0) n, coalesce(read, false) as read
        from co
        left join (select company_id, count(*) n from links group by 1) using (company_id)
        left join (select distinct company_id, true as read from links join md using (url)
                   where markdown <> '') using (company_id)) co
  join answers a using (company_id))"""

MODEL_CHAIN = [*BY_MODEL, WEB, MD, ANSWERS, MODEL_RESULTS]

RESULT_COLUMNS = """company_id, company_name, location, industry, erp_system, erp_confidence,
annual_revenue, revenue_confidence, revenue_range, company_size, business_type, notes,
sources_found"""


def _slots(template: str, **values: str) -> str:
    for name, value in values.items():
        template = template.replace("{" + name + "}", "\0" + value + "\0")
    parts = template.split("\0")
    return " || ".join(lit(p) if i % 2 == 0 else p for i, p in enumerate(parts))


NA = ", ".join(lit(v) for v in NA_VALUES)


def _cell(expression: str) -> str:
    return (
        f"coalesce(trim(case when {expression} not in ({NA}) then {expression} end, "
        f"{BLANK_CHARS}), '')"
    )


_name = "case when c_acctbal < -900 then 'N/A' else chr(9) || ' ' || c_name || ' ' || chr(10) end"
_city = "case when c_mktsegment = 'BUILDING' then 'null' else n_name || '  ' end"
_sector = "case when c_acctbal >= 0 then c_mktsegment end"
COMPANY_SCAN = f"""select c_custkey company_id, {_cell(_name)} company_name,
  {_cell(_city)} as location, {_cell(_sector)} industry
from customer join nation on c_nationkey = n_nationkey"""

TERMS = """q as (
  select distinct item_id query_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) term
  from benchmark),
t as (
  select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) term from documents),
p as (select doc_id, term, count(*) tf from t where term <> '' group by all),
w as (
  select term, ln((select count(*) from documents) / count(*)) idf from p group by term)"""

RANKED = """select query_id, cast(rk as integer) "rank", doc_id, score
from (select *, row_number() over (partition by query_id order by score desc, doc_id) rk
      from (select query_id, doc_id, round(sum(tf * idf), 6) score
            from q join p using (term) join w using (term) group by all) scored
      where {hits})
where rk <= 8"""

REQUIRED = """item as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from benchmark),
needs as (
  select item_id query_id, ' ' || array_to_string(w[1:2], ' ') || ' ' phrase from item where item_id % 3 <> 0 and len(w) > 0
  union all
  select item_id, ' ' || w[5] || ' ' from item where item_id % 3 <> 0 and item_id % 2 = 0 and len(w) > 4),
said as (
  select doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' words
  from documents)"""

REQUESTS = """requests as (
  select company_id, search_type,
         company_name || case search_type when 'revenue' then ' revenue' else ' "ERP"' end query
  from co, (values ('revenue'), ('ERP')) kinds(search_type))"""

PAGE_TERMS = """q as (
  select distinct company_id, search_type,
         unnest(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}]+')) term
  from requests),
t as (
  select url, unnest(regexp_split_to_array(lower(markdown), '[^\\p{L}\\p{N}]+')) term from md),
p as (
  select url, term, count(*) tf from t
  where term <> '' and term in (select term from q) group by all),
w as (select term, ln((select count(*) from web) / count(*)) idf from p group by term)"""


def _own(pattern: str, default: str) -> str:
    text = markdown(f"regexp_extract(html, {lit(pattern)}, 1)")
    return f"coalesce(nullif({text}, ''), {lit(default)})"


ORACLE = {
    "company_scan": COMPANY_SCAN,
    "company_preview": COMPANY_SCAN + " order by c_custkey limit 5",
    "search_requests": query([CO, REQUESTS], "select * from requests"),
    "search_pages": query([CO, ORD, WEB, MD, REQUESTS, PAGE_TERMS], f"""select company_id, search_type,
  cast(rk - 1 as integer) pos, {_own(S.TITLE, NO_TITLE)} title, url,
  {_own(S.DESCRIPTION, NO_SNIPPET)} snippet
from (select *, row_number() over (partition by company_id, search_type
                                   order by score desc, url) rk
      from (select company_id, search_type, url, round(sum(tf * idf), 6) score
            from q join p using (term) join w using (term) group by all)
      where score > 0)
join web using (url)
where rk <= 8"""),
    "search_context": query([CO], """select company_id,
  company_name || ' ' || location || ' ' || industry search_context from co"""),
    "search_hits": query([CO, ORD, RAW], """select company_id, search_type, pos, title, url, snippet
from hits join co using (company_id)
where bal >= 0 and not (co.industry = 'BUILDING' and search_type = 'ERP')"""),
    "parse_scores": query([CO, ORD, RAW, SCORES], """select r.company_id, r.search_type, bal >= 0 as valid,
  s.scored_pos, s.url, s.score, s.reason
from (select distinct company_id, search_type from hits) r
join co using (company_id)
left join scores s on s.company_id = r.company_id and s.search_type = r.search_type"""),
    "curate_links": query([CO, ORD, RAW, SCORES, curated("scores", "chosen")], "select * from chosen"),
    "curate_fallback": query(BY_MODEL, "select * from curated"),
    "top_scored": query([CO, ORD, RAW, SCORES], """select company_id, search_type, scored_pos, url, score, reason,
  cast(rk as integer) "rank"
from (select *, row_number() over (partition by company_id, search_type
                                   order by score desc, scored_pos) rk from scores)
where rk <= 3"""),
    "curated_counts": query(BY_MODEL, """select company_id, search_type, count(*) n_links
from curated group by company_id, search_type"""),
    "dedup_links": query(BY_MODEL, "select * from links"),
    "link_pages": query([*BY_MODEL, WEB, MD], """select company_id, url, type_ord, "rank",
  cast(length(coalesce(markdown, '')) as integer) markdown_length, md5(coalesce(markdown, '')) markdown_md5
from links left join md using (url)"""),
    "pages_to_markdown": query([ORD, WEB, MD], """select url, cast(length(markdown) as integer) markdown_length,
  md5(markdown) markdown_md5 from md"""),
    "combined_content": query([*BY_MODEL, WEB, MD, CONTENT], """select company_id,
  cast(length(content) as integer) content_length, md5(content) content_md5 from content"""),
    "link_prompts": query([CO, ORD, RAW], f"""select company_id, search_type,
  cast(length(prompt) as integer) prompt_length, md5(prompt) prompt_md5
from (select company_id, search_type,
        case search_type
          when 'revenue' then {_slots(P.REVENUE_LINKS_PROMPT, company='company_name', links='listed')}
          else {_slots(P.ERP_LINKS_PROMPT, company='company_name', links='listed')} end prompt
      from co join (
        select company_id, search_type, string_agg(
                 'URL: ' || url || chr(10) || 'Title: ' || title || chr(10) || 'Snippet: ' || snippet,
                 chr(10) || chr(10) order by pos) listed
        from hits group by 1, 2) using (company_id))"""),
    "extract_prompts": query([*BY_MODEL, WEB, MD, CONTENT], f"""select company_id,
  cast(length(prompt) as integer) prompt_length, md5(prompt) prompt_md5
from (select company_id, {_slots(P.EXTRACTION_PROMPT, company='company_name', content='content')} prompt
      from content join co using (company_id))"""),
    "parse_extractions": query([CO, ANSWERS], """select company_id,
  'missing or invalid in response: ' || bad as error, erp_system,
  case when bad like '%erp_confidence%' then null else erp_confidence end erp_confidence,
  annual_revenue, revenue_confidence, revenue_range, company_size, business_type,
  case when bad like '%notes%' then null else notes end notes
from answers"""),
    "structured_inference": query([CO, ORD, RAW], """select company_id, search_type, true as valid, url,
  cast(least(10, 1 + pos) as integer) score, 'place ' || pos reason from hits"""),
    "parse_orders": """select o_orderkey, fault,
  case when fault is null then cast(o_orderkey as integer) end order_number,
  case when fault is null then o_orderstatus end status,
  case when fault is null and o_orderkey % 10 <> 8 then o_orderpriority end note,
  case when fault is null then o_totalprice end amount,
  case when fault is null then 'USD' end currency,
  case when fault is null then cast(n_lines as integer) end n_lines,
  case when fault is null then cast(quantity as bigint) end quantity,
  case when fault is null then cast(n_final as integer) end n_final
from (
  select orders.*, coalesce(n_lines, 0) n_lines, coalesce(quantity, 0) quantity, coalesce(n_final, 0) n_final,
    case o_orderkey % 10
      when 3 then case when n_twos > 0 then '$.lines[' || n_before || '].quantity: not a whole number' end
      when 4 then '$.status: not one of F, O, P'
      when 5 then '$.total.amount: missing'
      when 6 then '$: not JSON'
      when 7 then '$.note: missing' end fault
  from orders left join (
    select l_orderkey, count(*) n_lines, sum(cast(l_quantity as bigint)) quantity,
           count(*) filter (l_linestatus = 'F') n_final,
           count(*) filter (l_linenumber = 2) n_twos, count(*) filter (l_linenumber < 2) n_before
    from lineitem group by l_orderkey) on l_orderkey = o_orderkey)""",
    "stored_inference": """select o_orderkey, o_orderpriority <> '5-LOW' answered,
  case when o_orderpriority <> '5-LOW'
       then case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end * cast(substr(o_orderpriority, 1, 1) as integer) end as days,
  case when o_orderpriority <> '5-LOW' then length(o_orderpriority) || ' letters' end reason
from orders""",
    "error_rows": query(MODEL_CHAIN, f"""select {RESULT_COLUMNS} from results
where erp_confidence = 0 and sources_found = 0"""),
    "corpus_search": query([TERMS], RANKED.format(hits="score > 0")),
    "index_search": query([TERMS], RANKED.format(hits="score > 0")),
    "phrase_search": query([TERMS, REQUIRED], RANKED.format(hits="""score > 0 and not exists (
  select * from needs where needs.query_id = scored.query_id
    and not exists (select * from said where said.doc_id = scored.doc_id and contains(said.words, needs.phrase)))""")),
    "lexicon_join": """with words as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w
  from benchmark),
lexicon as (
  select distinct 'word' category, unnest(w) term from words
  union
  select distinct 'pair', w[i] || ' ' || w[i + 1] from words, range(1, 100000) r(i) where i < len(w)
  union
  select distinct 'seven', array_to_string(w[i:i + 6], ' ') from words, range(1, 100000) r(i) where i + 6 <= len(w)),
docs as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w
  from documents),
tok as (select doc_id, unnest(w) a, unnest(list_append(w[2:], null)) b from docs),
said as (
  select doc_id, 'word' category, a term from tok
  union all
  select doc_id, 'pair', a || ' ' || b from tok where b is not null
  union all
  select doc_id, 'seven', unnest(list_transform(range(1, len(w) - 5), lambda i: array_to_string(w[i:i + 6], ' '))) from docs)
select doc_id, category, term, count(*) n from said join lexicon using (category, term) group by all""",
    "score_links_rules": query([CO, ORD, RAW, RULE_SCORES], "select * from rule_scores"),
    "extract_erp": query(RULE_RECORDS, "select company_id, erp_system, erp_confidence from records"),
    "extract_revenue": query(RULE_RECORDS, """select company_id, annual_revenue, revenue_confidence, revenue_range
from records"""),
    "extract_size_type": query(RULE_RECORDS, "select company_id, company_size, business_type from records"),
    "extract_asserted": query(ASSERTED_RECORDS, """select company_id, erp_system, erp_confidence, company_size, business_type
from records"""),
    "revenue_bucket": """select o_orderkey, case when usd < 1000000 then 'Under $1M'
  when usd < 10000000 then '$1M-$10M' when usd < 50000000 then '$10M-$50M'
  when usd < 100000000 then '$50M-$100M' else '$100M+' end revenue_range
from (select o_orderkey, cast(o_totalprice as decimal(18,2)) * 300 usd from orders)""",
    "summary_counts": query(MODEL_CHAIN, """select count(*) total_companies,
  count(*) filter (erp_system <> '') with_erp, count(*) filter (annual_revenue <> '') with_revenue
from results"""),
    "erp_top5": query(MODEL_CHAIN, """select erp_system, count(*) n_companies from results
where erp_system <> '' group by 1 order by 2 desc, 1 limit 5"""),
    "revenue_range_counts": query(MODEL_CHAIN, """select revenue_range, count(*) n_companies from results
where revenue_range <> '' group by 1"""),
    "enrich_companies": query(MODEL_CHAIN, f"select {RESULT_COLUMNS} from results"),
    "enrich_by_rules": query(RULE_RECORDS, """select company_id, company_name, location, industry,
  erp_system, cast(coalesce(erp_confidence, 1) as integer) erp_confidence,
  annual_revenue, cast(coalesce(revenue_confidence, 1) as integer) revenue_confidence,
  revenue_range, company_size, business_type,
  coalesce(notes, 'No content could be scraped from search results') notes,
  cast(coalesce(n, 0) as integer) sources_found
from co left join records using (company_id)
left join (select company_id, count(*) n from links group by 1) using (company_id)"""),
}

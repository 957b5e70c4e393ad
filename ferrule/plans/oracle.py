"""The catalogue's queries in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

from ..operators.extract import LABEL_STARTS, NO_LABELS, PROSE
from . import catalogue as q

PARTS = "p as (select p_partkey as part_id, p_brand || '-' || p_partkey as part_number, upper(regexp_replace(p_brand || '-' || p_partkey, '[\\s\\-/_.]', '', 'g')) as part_key, p_brand as manufacturer, p_type as category, p_name as description from part)"
SPECS = (
    "s as (select part_id, family, property, value from (select p_partkey as part_id, p_type as family, unnest(['brand', 'name', 'size', 'range']) as property, "
    "unnest([p_brand, p_name, case when p_size % 7 <> 0 then p_size::varchar end, p_size || '..' || (p_size + 5)]) as value from part) where trim(value) <> '')"
)
PAIRS = (
    "pr as (select * from (select b.part_id as base_id, b.category as base_family, b.part_number as base_number, c.part_id as candidate_id, c.category as candidate_family, c.part_number as candidate_number, "
    "row_number() over (partition by b.part_id order by c.part_number) as n from p b join p c on b.category = c.category and b.part_id <> c.part_id) where n <= 3)"
)
CELLS = (
    "b as (select base_id, candidate_id, property, value from pr join s on s.part_id = base_id), c as (select base_id, candidate_id, property, value from pr join s on s.part_id = candidate_id), "
    "cells as (select coalesce(b.base_id, c.base_id) as base_id, coalesce(b.candidate_id, c.candidate_id) as candidate_id, coalesce(b.property, c.property) as property, b.value as base_value, c.value as candidate_value, "
    "case when b.value is null then 'candidate_only' when c.value is null then 'base_only' when lower(b.value) = lower(c.value) then 'equal' else 'different' end as state "
    "from b full join c on b.base_id = c.base_id and b.candidate_id = c.candidate_id and b.property = c.property)"
)
COUNTS = (
    "counts as (select base_id, candidate_id, count(*) filter (state = 'equal') as equal, count(*) filter (state = 'different') as different, count(*) filter (state = 'base_only') as missing, "
    "count(*) filter (state = 'candidate_only') as candidate_only, count(*) filter (state = 'not_comparable') as not_comparable from cells group by 1, 2)"
)
NUMBER = "try_cast(regexp_extract({0}, '(-?\\d+(?:\\.\\d+)?)', 1) as double)"


def _values(rows: list[tuple]) -> str:
    shown = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "values " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


RESULTS = (
    f"ru(family, ord, property, level, operator, tol) as ({_values(q.RULES)}), "
    f"rv as (select pr.base_id, pr.candidate_id, ru.*, x.value as a, y.value as z, {NUMBER.format('x.value')} as na, {NUMBER.format('y.value')} as nz from pr join ru on ru.family = pr.base_family "
    "left join s x on x.part_id = pr.base_id and x.property = ru.property left join s y on y.part_id = pr.candidate_id and y.property = ru.property), "
    "rr as (select base_id, candidate_id, ord, property, level, case when a is null or z is null then 'missing' "
    "when operator = 'equal' then case when lower(a) = lower(z) then 'equal' else 'different' end "
    "when operator = 'range_overlap' then case when greatest(na, nz) <= least(na, nz) + 5 then 'equal' else 'different' end "
    "when na is null or nz is null then 'not_comparable' "
    "when operator = 'gte' then case when nz >= na then 'equal' else 'different' end when operator = 'lte' then case when nz <= na then 'equal' else 'different' end "
    "when operator = 'within_tolerance' then case when abs(nz - na) <= abs(na) * coalesce(tol, 0) / 100 then 'equal' else 'different' end else 'not_comparable' end as state from rv)"
)
FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
OCCURRENCES = (
    f"terms(area, term, kind, weight) as ({_values(q.TERMS)}), "
    f"d as (select doc_id, list_filter(string_split({FOLD.format('text')}, ' '), lambda t: t <> '') as tk from documents), "
    "o as (select doc_id, tk, area, term, kind, weight, unnest(list_filter(range(0, len(tk) - len(w) + 1), lambda i: tk[i + 1 : i + len(w)] = w)) as pos from d cross join (select *, string_split(term, ' ') as w from terms)), "
    "n as (select doc_id, area, term, kind, weight, pos, len(list_filter(range(greatest(pos - 3, 0), pos), lambda i: tk[i + 1] in ('non', 'not', 'no', 'sin') and not (tk[i + 1] = 'sin' and coalesce(tk[i + 2], '') = 'embargo'))) > 0 as negated from o)"
)
SCORES = (
    "once as (select doc_id, area, term, kind, max(weight) as weight from n where not negated group by all), "
    "sc as (select doc_id, area, coalesce(sum(weight) filter (kind = 'include'), 0)::bigint as product_score, count(*) filter (kind = 'include') as n_include, count(*) filter (kind <> 'include') as n_exclude, "
    "(coalesce(sum(weight) filter (kind = 'include'), 0) - 80 * count(*) filter (kind <> 'include'))::bigint as score from once group by 1, 2)"
)
LINES = "l as (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') as ls from documents))"

#: Lines without Markdown's links, URLs and marks; no target of a link in the tables holds brackets.
CLEANED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '(?s)```.*?```', ' ', 'g'), '!?\\[[^\\]]*\\]\\s*(\\([^()]*\\)|\\([^\\n]*)', ' ', 'g'), '(?i)javascript\\s*:|void\\s*\\(\\s*0\\s*\\)|blob://|data:(text|image)/[^\\s)]+|(https?:)?//[^\\s)]+', ' ', 'g'), '\\s+\\n', '\n', 'g'), '\\n\\s+', '\n', 'g')"
BARE_LINES = (
    "l as (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from (select doc_id, list_filter(list_transform(string_split_regex("
    + CLEANED.format("text")
    + ", '\\r?\\n'), lambda x: trim(regexp_replace(regexp_replace(x, '^[\\s>*#-]+', ''), '[*_`]', '', 'g'))), lambda x: x <> '') as ls from documents))"
)


#: Documents with the lines of a data sheet behind them.
SHEETS = f"sheets as (select doc_id, coalesce(text, '') || coalesce({q.SHEET_LINES}, '') as text from documents left join part on p_partkey = doc_id)"


def _search(query: str) -> str:
    """sr: part_id, score, match of the ladder."""
    words, low = query.lower().split(), query.lower()
    key = "".join(c for c in query.upper() if c not in " -/_.")
    has = lambda field, w: f"contains({field}, '{w}')"
    number = [f"({has('num', w)} or contains(part_key, '{w.upper()}'))" for w in words]
    fields = [f"({a} or {has('mk', w)} or {has('cat', w)} or {has('des', w)})" for a, w in zip(number, words, strict=True)]
    total = lambda cs: "(" + " + ".join(f"({c})::int" for c in cs) + ")"
    des, cat, mk, n = total([has("des", w) for w in words]), total([has("cat", w) for w in words]), total([has("mk", w) for w in words]), len(words)
    rungs = [
        (f"num = '{low}'", "1000", "part_number_exact"), (f"part_key = '{key}'", "950", "part_number_normalized"), (f"starts_with(num, '{low}')", "900", "part_number_prefix"), (has("num", low), "800", "part_number_contains"),
        (f"mk = '{low}'", "700", "manufacturer_exact"), (has("mk", low), "600", "manufacturer_contains"), (f"{total(fields)} = {n}", str(650 + 5 * n), "all_query_tokens"),
        (f"{total(fields)} < {n} and {total(number)} > 0", f"550 + 10 * {total(number)}", "part_number_token"), (f"{des} = {n}", str(500 + n), "description_all_tokens"), (f"{des} between 1 and {n - 1}", f"300 + {des}", "description_partial"),
        (f"{cat} = {n}", "450", "category_all_tokens"), (f"{cat} between 1 and {n - 1}", "250", "category_partial"), (f"{mk} > 0", f"200 + {mk}", "manufacturer_token"),
    ]
    score = "greatest(" + ", ".join(f"case when {c} then {v} else 0 end" for c, v, _ in rungs) + ")"
    match = "case when score = 0 then 'none' " + " ".join(f"when ({c}) and score = {v} then '{m}'" for c, v, m in rungs) + " end"
    return f"lo as (select *, lower(part_number) as num, lower(manufacturer) as mk, lower(category) as cat, lower(description) as des from p), sb as (select *, ({score})::bigint as score from lo), sr as (select *, {match} as match from sb)"


ENTITIES = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&deg;', '°'), '&micro;', 'µ'), '&amp;', '&')"
VISIBLE = "trim(regexp_replace(" + ENTITIES.format("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', '')"
PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
NORMAL = "'(?i)^(https?)://(?:[^/@?#]*@)?([^/:?#]+)(:\\d+)?([^#]*)'"


def oracle_sql() -> dict[str, str]:
    small = "'" + "', '".join(q.COMMON) + "'"
    search = f"with {PARTS}, {_search(q.QUERY)}"
    pairs = f"with {PARTS}, {SPECS}, {PAIRS}"
    fingerprint = (
        f"fp as (select part_id, 'fnv1a-' || lower(to_hex(list_reduce(list_transform(string_split({FOLD.format('part_number')} || '|' || {FOLD.format('description')} || '|' || {FOLD.format('category')} || '|{{}}', ''), lambda c: ascii(c)::bigint), "
        "lambda h, x: (xor(h, x) * 16777619) % 4294967296, 2166136261::bigint))) as fingerprint from p)"
    )
    starts, prose, heads = "|".join(LABEL_STARTS), "|".join(PROSE), "|".join(NO_LABELS)
    return {
        "norm_part_number": f"with {PARTS} select part_id, part_key, length(part_number) between 2 and 40 and regexp_matches(part_number, '^[A-Za-z0-9][A-Za-z0-9\\-/_.]*$') and regexp_matches(part_number, '[0-9]') as looks_like_part, "
        "regexp_replace(regexp_replace(part_number, '[A-Z]', 'A', 'g'), '[0-9]', 'N', 'g') as signature, regexp_replace(lower(part_number), '[^a-z0-9]', '', 'g') as alnum_key from p",
        "split_value_unit": "with r as (select p_partkey as part_id, case when p_size % 3 = 0 then ' <' || p_size || ',5 VDC ' when p_size % 3 = 1 then p_size || 'mm' else 'M' || p_size end as raw from part), "
        "m as (select *, regexp_extract(trim(raw), '^([<>~]?\\s*[-+]?\\d+(?:[.,]\\d+)?)\\s*([A-Za-z°²µ·/]+)?$', 1) as v, regexp_extract(trim(raw), '^([<>~]?\\s*[-+]?\\d+(?:[.,]\\d+)?)\\s*([A-Za-z°²µ·/]+)?$', 2) as u from r) "
        "select part_id, case when v = '' then trim(raw) else replace(v, ',', '.') end as value, case lower(u) when 'vdc' then 'V' else u end as unit, " + NUMBER.format("replace(raw, ',', '.')") + " as number from m",
        "tokenise_terms": "select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct from (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s,;]+'), lambda t: length(t) > 1) as t from documents)",
        "phrase_hits": f"with {OCCURRENCES} select doc_id, area, term, count(*) as n_hits, count(*) filter (negated) as n_negated, min(pos) as first_position from n group by 1, 2, 3",
        "classify_scores": f"with {OCCURRENCES}, {SCORES} select * from sc",
        "classify_margin": f"with {OCCURRENCES}, {SCORES}, areas(area, rule_index, min_score) as ({_values(q.AREAS)}), "
        "ok as (select *, row_number() over (partition by doc_id order by score desc, n_include desc, rule_index) as k from sc join areas using (area) where score >= min_score and product_score > 0 and n_exclude = 0), "
        "top as (select doc_id, max(area) filter (k = 1) as area, max(score) filter (k = 1) as a, max(score) filter (k = 2) as b, count(*) as n_accepted from ok group by 1) "
        "select documents.doc_id, area, case when n_accepted = 1 then 'auto_accept' else 'shadow_review' end as status, coalesce(least(1.0, a / 100.0), 0)::double as confidence, coalesce(a - coalesce(b, 0), 0)::bigint as margin, coalesce(n_accepted, 0) as n_accepted from documents left join top using (doc_id)",
        "search_scores": f"{search} select part_id, score, match from sr",
        "search_ranked": f"{search} select part_id, part_number, score, match from sr where score > 0 order by score desc, part_number limit 20",
        "search_page": f"with {PARTS}, s as (select part_id, part_number, row_number() over (order by part_number) as n, count(*) over () as c from p where category = 'SMALL') select part_id, part_number, c > 45 as has_more from s where n between 31 and 45",
        "search_facets": f"{search}, top as (select * from sr where score > 0 order by score desc, part_number limit 50) select 'manufacturer' as facet, manufacturer as value, count(*) as n from top group by 2 union all select 'category', category, count(*) from top group by 2",
        "suggest_topk": f"with {PARTS}, r as (select part_number as label, 'part' as type, case when part_key = 'BRAND#1' then 300 when starts_with(lower(part_number), 'brand#1') then 250 when starts_with(lower(manufacturer), 'brand#1') then 200 end as score from p "
        "union all select distinct manufacturer, 'manufacturer', 80 from p where starts_with(lower(manufacturer), 'brand#1')) select label, type, score::bigint as score from r where score is not null order by score desc, label limit 8",
        "relevance_scores": f"with {PARTS}, w as (select part_id, " + ", ".join(
            f"case when contains(lower(description), '{x}') then 80 when contains(lower(manufacturer), '{x}') then 65 when contains(lower(category), '{x}') then 45 when contains(lower(part_number), '{x}') then 35 else 0 end as {x}" for x in ("blue", "promo")
        ) + " from p) select part_id, (case when blue = 0 or promo = 0 then 0 else blue + promo end)::bigint as relevance from w",
        "best_image_per_part": "with i as (select l_partkey, 'img/' || l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || l_quantity as url, row_number() over (partition by l_partkey order by l_returnflag = 'R' desc, l_shipdate desc, 'img/' || l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || l_quantity) as n from lineitem) "
        "select p_partkey as part_id, url from part left join i on l_partkey = p_partkey and n = 1",
        "family_labels": "select p_partkey as part_id, case p_type when 'SMALL' then 'Small parts' when 'LARGE' then 'Large parts' when 'PROMO' then 'Offers' else p_type end as family_name from part",
        "label_fallback": f"with {SPECS} select property, count(*) as n, case property when 'size' then 'Größe' when 'brand' then 'Marca' when 'range' then 'Range' else property end as label from s group by 1",
        "spec_long": f"with {SPECS} select part_id, family, property, value from s",
        "compare_matrix": f"{pairs}, {CELLS} select * from cells",
        "compare_counts": f"{pairs}, {CELLS}, {COUNTS} select *, case when different > 0 then 'review' when equal > 0 and not_comparable = 0 and missing = 0 then 'compatible' else 'review' end as state from counts",
        "alternatives_visible": f"{pairs}, {CELLS}, {COUNTS} select base_id, candidate_id, equal, different from counts where not (equal = 0 and different > 0)",
        "rule_eval": f"{pairs}, {RESULTS} select base_id, candidate_id, ord::bigint as ord, property, level, state from rr",
        "crossref_state": f"{pairs}, {RESULTS}, {_decisions()} select base_id, candidate_id, state, {_display()} as display, score, critical_fail, required_fail, missing from dc",
        "crossref_verdict": f"{pairs}, {CELLS}, {COUNTS}, {RESULTS}, {_decisions()}, sh as (select dc.*, {_display()} as display from dc left join counts on counts.base_id = dc.base_id and counts.candidate_id = dc.candidate_id where not coalesce(equal = 0 and different > 0, false)), "
        "f as (select base_id, bool_or(display = 'compatible') as any_ok, count(*) as alternatives from sh group by 1) select part_id as base_id, case when alternatives is null then 'insufficient' when any_ok then 'compatible_found' else 'review_required' end as verdict, coalesce(alternatives, 0) as alternatives from p left join f on base_id = part_id",
        "alias_best_match": f"with al(alias, property) as ({_values(q.ALIASES)}), lb as (select distinct p_name as label from part), "
        "m as (select label, property, case when label = alias then 10000 when contains(label, alias) then 5000 when length(label) >= 8 and contains(alias, label) then 4000 end + length(alias) as score from lb cross join al), "
        "r as (select *, row_number() over (partition by label order by score desc, property) as n from m where score is not null) select label, property, score::bigint as score from r where n = 1",
        "fingerprint_fnv": f"with {PARTS}, {fingerprint} select * from fp",
        "changed_parts": "select p_partkey as part_id, case when p_partkey % 5 = 0 then 'new' when p_partkey % 7 = 0 or p_partkey % 9 = 0 then 'changed' else 'unchanged' end as change from part",
        "page_title_text": "select page_id, trim(" + ENTITIES.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + f") as title, {VISIBLE} as visible from pages",
        "page_links": "select page_id, generate_subscripts(h, 1) - 1 as link_no, unnest(h) as href from (select page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"''#]+)[\"'']', 1) as h from pages)",
        "url_parts": f"with u as (select page_id, url, {HOST} as host, string_split({HOST}, '.') as ls, regexp_extract(url, {NORMAL}, 1) as sc, regexp_extract(url, {NORMAL}, 2) as nm, regexp_extract(url, {NORMAL}, 3) as po, regexp_extract(url, {NORMAL}, 4) as re, list_filter(string_split({PATH}, '/'), lambda x: x <> '') as pp from pages), "
        "b as (select *, case when len(ls) <= 2 then host when length(ls[-2]) <= 2 then array_to_string(ls[-3:], '.') else array_to_string(ls[-2:], '.') end as base from u) "
        "select page_id, host, base, string_split(base, '.')[1] as token, lower(sc) || '://' || lower(nm) || case when (lower(sc) = 'http' and po = ':80') or (lower(sc) = 'https' and po = ':443') then '' else po end || case when re = '' then '/' when starts_with(re, '?') then '/' || re else re end as normalized, "
        f"(case when pp[1] = 'en' then len(pp) - 1 else -1 end)::bigint as depth, regexp_replace(lower({PATH}), '/+$', '') as image_key from b",
        "robots_longest_match": f"with ru(kind, path) as ({_values(q.ROBOTS)}), u as (select page_id, case when {PATH} = '' then '/' else {PATH} end as pth from pages), "
        "h as (select page_id, max(length(path)) filter (kind = 'allow') as a, max(length(path)) filter (kind = 'disallow') as d from u join ru on starts_with(pth, path) group by 1) select u.page_id, coalesce(a, 0) >= coalesce(d, 0) as allowed from u left join h using (page_id)",
        "kv_lines": f"with {SHEETS}, {LINES.replace('from documents', 'from sheets')}, m as (select doc_id, line_no, trim(regexp_extract(line, '^(.{{2,55}}?)\\s*[:：]\\s*([^\\n:]{{1,45}})$', 1)) as attribute, trim(regexp_extract(line, '^(.{{2,55}}?)\\s*[:：]\\s*([^\\n:]{{1,45}})$', 2)) as value from l where length(line) <= 140) "
        "select * from m where attribute <> '' and regexp_matches(value, '[0-9]') and len(string_split_regex(attribute, '\\s+')) <= 6",
        "pipe_lines": "select p_partkey as part_id, 0::bigint as line_no, 'size' as attribute, p_size || ' mm' as value from part union all select p_partkey, 2, p_name, p_brand from part",
        "adjacent_lines": f"with {SHEETS}, {BARE_LINES.replace('from documents', 'from sheets')}, nx as (select *, lead(line) over (partition by doc_id order by line_no) as value from l), "
        "f as (select doc_id, line_no, trim(regexp_replace(line, '[:：-]\\s*$', '')) as attribute, trim(regexp_replace(value, '[,;]$', '')) as value from nx where value is not null and length(line) between 2 and 60 and len(string_split_regex(line, '\\s+')) <= 5 "
        f"and not regexp_matches(line, '[0-9]|[.!?]$') and not regexp_matches(line, '(?i)^(?:{starts})([^A-Za-z0-9_]|$)') and not regexp_matches(line, '(?i)^(?:{heads})$') and length(value) <= 60 and len(string_split_regex(value, '\\s+')) <= 3 and regexp_matches(value, '^[0-9]') and not regexp_matches(value, '[.!?]$') "
        f"and not regexp_matches(value, '(?i)(^|[^A-Za-z0-9_])(?:{prose})([^A-Za-z0-9_]|$)')), g as (select *, row_number() over (partition by doc_id, lower(attribute), lower(value) order by line_no) as k from f), "
        "r as (select *, row_number() over (partition by doc_id order by line_no) as n from g where k = 1) select doc_id, line_no, attribute, value from r where n <= 25",
        "ordered_distinct": f"with {LINES}, m as (select doc_id, min(line_no) as line_no from l group by doc_id, lower(line)) select doc_id, count(*) as n_lines, sum(line_no)::bigint as sum_positions from m group by 1",
        "readability_density": "with d as (select doc_id, length(coalesce(text, '')) as chars, len(regexp_extract_all(coalesce(text, ''), '\\S+')) as words, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) as letters, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) as signals, "
        f"len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x in ({small}))) as common from documents) "
        "select doc_id, chars, words, case when chars = 0 then 0 else round(letters / chars, 9) end as letter_density, case when words = 0 then 0 else round(common / words, 9) end as common_ratio, case when words = 0 then 0 else round(signals / words, 9) end as signal_density from d",
        "upsert_latest": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1",
        "community_totals": "select user_id, count(*) filter (event_type = 'purchase') as confirmed, count(*) filter (event_type = 'error') as rejected, count(*) filter (event_type = 'view') as viewed from events group by 1",
        "outcome_accounting": "with e as (select strftime(ts, '%Y-%m-%d') as day, count(*) as seen, count(*) filter (event_type = 'purchase') as n_new, count(*) filter (event_type = 'view') as n_known, count(*) filter (event_type = 'click') as n_rejected, count(*) filter (event_type = 'error') as n_error from events group by 1) select *, seen = n_new + n_known + n_rejected + n_error as balanced from e",
        "queue_routing": "select event_id, case when user_id % 10 = 0 or event_id % 17 = 0 or event_id % 6 > 3 then 'needs_review' when event_type <> 'error' then 'processing' when event_id % 2 = 0 and event_id % 6 < 3 then 'retry' else 'needs_review' end as state from events",
        "area_counts_domain": f"with d(category) as ({_values([(a,) for a in q.AREA_DOMAIN])}) select category, count(p_partkey) as n from d left join part on p_type = category group by 1",
        "grammar_mode": f"with {PARTS}, f as (select category, regexp_replace(regexp_replace(part_number, '[A-Z]', 'A', 'g'), '[0-9]', 'N', 'g') as format, count(*) as n from p group by 1, 2) select category, format, n from (select *, row_number() over (partition by category order by n desc, format) as k from f) where k = 1",
        "grammar_holdout": f"with {PARTS}, n as (select *, row_number() over (partition by category order by part_id) as n, count(*) over (partition by category) as docs from p), m as (select *, greatest(1, ceil(docs * 0.6::double))::bigint as split from n), "
        "c as (select category, part_id, n, split, 0 as position, regexp_replace(regexp_replace(part_number, '[A-Z]', 'A', 'g'), '[0-9]', 'N', 'g') as format, case when part_id % 3 = 0 or category = 'SMALL' then 'positive' when part_id % 7 = 1 then 'negative' else 'none' end as lt, part_id % 2 = 0 as ti from m "
        "union all select category, part_id, n, split, 1, 'AAN', case when part_id % 4 = 0 then 'negative' else 'none' end, false from m), "
        "se as (select category, max(docs) as docs, max(split) as split, count(*) filter (n <= split and (part_id % 3 = 0 or category = 'SMALL')) as lab from m group by 1), "
        "fo as (select c.category, format, count(*) as k from c join se on se.category = c.category where n <= c.split and case when lab >= ceil(se.split * 0.5::double) then lt = 'positive' else ti and lt <> 'negative' end group by 1, 2), "
        "be as (select category, format as best from (select *, row_number() over (partition by category order by k desc, format) as r from fo) where r = 1), "
        "ng as (select category, string_agg(distinct format, ',' order by format) as negs from c where n <= split and lt = 'negative' group by 1), "
        "hi as (select c.category, part_id, arg_min(lt, position) as lt from c join be on be.category = c.category where n > split and lt <> 'negative' and format = best group by 1, 2), tp as (select category, count(*) filter (lt = 'positive') as tp from hi group by 1), "
        "r as (select se.category, case when lab >= ceil(split * 0.5::double) then 'positive_label' else 'title_format' end as selector, coalesce(best, '') as format, coalesce(negs, '') as negative_formats, split as n_train, coalesce(tp, 0) as tp, docs, split from se left join be using (category) left join ng using (category) left join tp using (category)) "
        "select category, selector, format, negative_formats, n_train, tp, 0::bigint as fp, docs - split - tp as fn, case when tp > 0 then 'active' else 'pending' end as status, "
        "list_reduce(list_transform(string_split(selector || '|' || format || '|' || negative_formats, ''), lambda c: ascii(c)::bigint), lambda h, x: xor((h * 33) % 4294967296, x), 5381::bigint) as grammar_hash from r",
        "weakest_class": "with c as (select l_orderkey as order_id, case when l_linenumber <= 3 then l_linenumber - 1 when l_linenumber < 7 then 3 when l_quantity < 49 then 4 end as r from lineitem) "
        "select order_id, case when count(*) = count(r) then ['cross_validated', 'grammar_validated', 'literal_occurrence', 'inferred', 'unknown'][max(r) + 1] end as weakest from c group by 1",
        "gate_causes": "with g as (select p_partkey as part_id, array_to_string(list_filter([case when p_partkey % 5 = 0 then 'missing manufacturer_name' end, case when p_partkey % 4 = 0 then 'part_number_evidence_missing' end, case when p_size - 3 < 1 then 'part_number_page_missing' end], lambda x: x is not null), ',') as basic, "
        "case when p_size % 3 = 0 then 'no specifications extracted from document' when p_size % 2 >= p_size % 3 then 'all specifications lack complete evidence' else '' end as later from part) "
        "select part_id, case when basic <> '' then 'rejected' when later <> '' then 'incomplete' else 'published' end as status, case when basic <> '' then basic else later end as causes from g",
        "image_candidates": "select p_partkey as part_id, 'jsonld' as method, 'https://img.example.com/a/' || (p_partkey % 7) || '.jpg' as url, (100 + case when contains(p_name, 'widget') and contains(p_name, 'blue') then 40 when contains(p_name, 'widget') then 25 when contains(p_name, 'blue') then 20 else 0 end)::bigint as score from part",
    }


def _decisions() -> str:
    failed = "state <> 'equal'"
    ready = "critical_total > 0"
    relation = "case when candidate_id % 11 = 0 then 'compatible' when candidate_id % 13 = 0 and candidate_id % 2 = 0 then 'successor' end"
    return (
        f"fg as (select base_id, candidate_id, count(*) as rules, count(*) filter (state = 'equal') as equal, count(*) filter (state = 'missing') as missing, count(*) filter (state = 'not_comparable') as nc, count(*) filter (level = 'critical' and {failed}) as critical_fail, count(*) filter (level = 'critical') as critical_total, "
        f"count(*) filter (level = 'required' and {failed}) as required_fail from rr group by 1, 2), "
        "ev as (select pr.base_id, pr.candidate_id, base_family, coalesce(rules, 0) as rules, coalesce(equal, 0) as equal, coalesce(missing, 0) as missing, coalesce(nc, 0) as nc, coalesce(critical_fail, 0) as critical_fail, coalesce(critical_total, 0) as critical_total, coalesce(required_fail, 0) as required_fail from pr left join fg on fg.base_id = pr.base_id and fg.candidate_id = pr.candidate_id), "
        f"te as (select *, {relation} as rel, case when base_family = 'MEDIUM' then 'SIMILAR_REVIEW' when critical_fail > 0 then 'NOT_SUBSTITUTABLE' when required_fail > 0 then 'INSUFFICIENT_EVIDENCE' "
        f"when rules = 0 or missing > 0 or nc > 0 or not {ready} then case when candidate_id % 2 = 0 then 'SIMILAR_REVIEW' else 'INSUFFICIENT_EVIDENCE' end else 'EQUIVALENT' end as technical, case when base_family = 'MEDIUM' or rules = 0 then 0 else floor(100 * equal / rules + 0.5) end as sc from ev), "
        "dc as (select base_id, candidate_id, case rel when 'compatible' then 'COMPATIBLE' when 'successor' then 'REPLACE' else technical end as state, greatest(sc, case rel when 'compatible' then 70 when 'successor' then 95 else 0 end)::bigint as score, critical_fail, required_fail, missing from te)"
    )


def _display() -> str:
    return "case when state in ('EXACT', 'REPLACE', 'EQUIVALENT', 'COMPATIBLE') then 'compatible' when state = 'NOT_SUBSTITUTABLE' then 'not_compatible' when state = 'INSUFFICIENT_EVIDENCE' then 'insufficient' else 'review' end"

"""Queries over identity: its contract, identifiers in any script, canonical JSON, images of linked data, ranking; each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions.text import is_unicode_identifier, unicode_signature
from ..operators import contracts, search
from ..sources.tables import parts, table
from .catalogue import long

#: Lines of an order as segments of a number; the same text is Spark's SQL and DuckDB's.
FIELDS = {
    "segment_id": "case when s % 11 = 0 then ' ' else 'g' || (s % 6) end", "token": "case when s % 13 > 0 then 't' || s end", "validity": "case s % 7 when 0 then 'guess' when 1 then 'literal' when 2 then null else 'grammar' end",
    "semantics": "case s % 9 when 0 then 'open' when 1 then 'constant_no_legend' else 'resolved' end", "evidence_class": "case s % 8 when 0 then 'external_record' when 1 then 'inferred' when 2 then 'literal_occurrence' when 3 then 'literal_occurrence' else 'grammar_validated' end",
    "document_id": "case when s % 5 > 0 then 'd' end", "document_edition": "case when s % 17 > 0 then 'e' else '' end", "page": "case s % 4 when 0 then '0' when 1 then '2.5' when 2 then '7' else '12' end", "evidence_text": "case when s % 19 > 0 then 'seen' end",
    "grammar_id": "case when s % 10 > 0 then 'g' end", "grammar_version": "case when s % 12 > 0 then '1' end", "rule_id": "case when s % 14 > 0 then 'r' end",
}
PART = "case when o % 23 > 0 then 'P-' || o end"
STATUS = "case o % 6 when 0 then 'not_applicable' when 1 then 'later' else 'evaluated' end"
REASON = "case when o % 12 = 0 then 'none applies' else '  ' end"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("s"))


def identity_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = F.when(F.expr("s % 3 > 0"), F.array(F.expr("named_struct('document_id', case when s % 6 > 1 then 'd' end, 'edition', 'e')"), F.expr("named_struct('document_id', 'x', 'edition', case when s % 4 > 0 then 'e' else ' ' end)")))
    segment = F.struct(*(F.expr(x).alias(c) for c, x in FIELDS.items()), documents.alias("supporting_documents"))
    rule = F.struct(F.expr("case when s % 15 > 0 then 'r' || (s % 5) end").alias("rule_id"), F.expr("case s % 16 when 0 then 'fail' when 1 then 'unknown' when 2 then 'not_applicable' else 'pass' end").alias("status"))
    in_order = lambda what: F.transform(F.array_sort(F.collect_list(F.struct("n", what.alias("x")))), lambda v: v["x"])
    rows = _lines(spark, sf_dir).groupBy("o").agg(in_order(segment).alias("segments"), in_order(rule).alias("results"))
    results = F.when(F.expr("o % 7 > 0"), F.col("results"))
    cross = F.when(F.expr("o % 9 > 0"), F.struct(F.expr(STATUS).alias("evaluation_status"), F.expr(REASON).alias("reason"), results.alias("results")))
    v = contracts.validated(F.expr(PART), F.when(F.expr("o % 29 > 0"), F.col("segments")), cross)
    return rows.select(F.col("o").alias("order_id"), v["pass"].alias("passes"), F.array_join(v["errors"], ",").alias("errors"), v["summary"].alias("summary"), contracts.summary(F.col("segments")).alias("weakest"))


WRITTEN = "case p_partkey % 6 when 0 then 'LTC-' || p_size || 'e' || chr(769) when 1 then 'β-' || p_partkey || 'α' when 2 then p_brand || '-' || p_partkey when 3 then 'n' || chr(771) || '_' || p_size || '/B' when 4 then 'o' || chr(776) || 'lx' else 'A ' || p_size end"


def unicode_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(WRITTEN.replace("chr(769)", "'́'").replace("chr(771)", "'̃'").replace("chr(776)", "'̈'"))
    whole = canonical.composed(raw)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), canonical.identifier_key(raw).alias("identifier"), is_unicode_identifier(whole).alias("detected"), unicode_signature(whole).alias("signature"))


NESTED = {
    0: """'{"b": [' || p_size || ', {"z": null, "a": "' || p_name || '"}], "a": {"é": 1.50, "B": true, "10": ' || p_partkey || ', "9": {}}}'""",
    1: """'{"a":{"9":{},"B":true,"é":1.5,"10":' || p_partkey || '},"b":[' || p_size || '.0,{"a":"' || p_name || '","z":null}]}'""",
    2: """'{"b":["' || p_size || '",{"a":"' || p_name || '"}],"a":[]}'""",
    3: """'{"b": ' || p_size || ', "a"'""",
}
STABLE = {
    0: """'{"a":{"9":{},"10":' || p_partkey || ',"B":true,"é":1.5},"b":[' || p_size || ',{"a":"' || p_name || '","z":null}]}'""",
    2: """'{"a":[],"b":["' || p_size || '",{"a":"' || p_name || '"}]}'""",
}


def stable_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writings of one object, and one in which a number is a string and a null is missing; and one that is no JSON."""
    p = table(spark, sf_dir, "part")
    text = F.expr("case p_partkey % 4 " + " ".join(f"when {k} then {x}" for k, x in NESTED.items()) + " end")
    return p.select(F.col("p_partkey").alias("part_id"), canonical.stable_json(text).alias("stable"))


def linked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of products in graphs inside graphs, beside other types, broken scripts and scripts of another kind."""
    product = lambda kind, image: f"""'{{"@type": ' || {kind} || ', "name": "' || p_name || '", "image": ' || {image} || '}}'"""
    kind = """case p_partkey % 3 when 0 then '"Product"' when 1 then '["Thing", "IndividualProduct"]' else '"Organization"' end"""
    image = """case p_partkey % 4 when 0 then '"https://h.example/' || p_partkey || '.jpg"' when 1 then '["/a.jpg", {"url": "https://h.example/b' || p_size || '.jpg"}, {"x": 1}]' when 2 then '{"url": "c.jpg"}' else 'null' end"""
    inner = f"""'{{"@graph": [{{"@graph": [' || {product(kind, image)} || ']}}, ' || {product("'\"product\"'", "'\"https://h.example/last.jpg\"'")} || ']}}'"""
    html = f"""'<html><script type="application/ld+json">' || {inner} || '</script><script type="text/plain">' || {product("'\"Product\"'", "'\"no.jpg\"'")} || '</script><script type="application/ld+json">{{broken</script></html>'"""
    found = F.posexplode(canonical.product_images(F.expr(html))).alias("image_no", "i")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), found).select("part_id", long("image_no").alias("image_no"), "i.url", "i.alt")


LETTERS = "case p_partkey % 7 when 0 then 'á' when 1 then 'A' when 2 then 'b' when 3 then 'B' when 4 then 'é' when 5 then '-' else 'Z' end"
STATE = "case p_partkey % 5 when 0 then 'published' when 1 then 'validated' when 2 then 'incomplete' when 3 then 'rejected' else 'draft' end"


def ranked_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty parts for a query: by score, then state, then number as a reader orders it."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"{LETTERS} || p_brand || '-' || p_partkey").alias("number"), F.expr(STATE).alias("state"))
    rows = parts(spark, sf_dir).join(p, F.col("part_id") == F.col("p_partkey")).withColumn("part_number", F.col("number"))
    return search.ranked(rows, "small ring", 50, state_rank=search.state_rank(F.col("state"))).select("part_id", "part_number", "state", long("score").alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (identity_contracts, unicode_identifiers, stable_specs, linked_images, ranked_states)}


def _contract_sql() -> str:
    blank = lambda c: f"trim(coalesce({c}, '')) = ''"
    code = lambda cond, text: f"case when {cond} then {text} end"
    literal = "evidence_class = 'literal_occurrence'"
    grammar = "evidence_class = 'grammar_validated'"
    checks = [
        code(blank("segment_id"), "'segment_id_missing'"), code(blank("token"), "'token_missing'"), code(f"not {blank('segment_id')} and place > 1", "'duplicate_segment_id'"),
        code("coalesce(validity, '') not in ('literal', 'grammar', 'unknown')", "'validity_invalid'"), code("semantics not in ('resolved', 'constant_no_legend', 'unknown')", "'semantics_invalid'"),
        code("evidence_class = 'inferred'", "'evidence_class_invalid'"), code("evidence_class = 'external_record'", "'external_record_defined_unverified'"),
        code(f"{literal} and {blank('document_id')}", "'literal_document_id_missing'"), code(f"{literal} and {blank('document_edition')}", "'literal_document_edition_missing'"),
        code(f"{literal} and not (page::double >= 1 and page::double = floor(page::double))", "'literal_page_missing'"), code(f"{literal} and {blank('evidence_text')}", "'literal_evidence_text_missing'"),
        code(f"{grammar} and {blank('grammar_id')}", "'grammar_id_missing'"), code(f"{grammar} and {blank('grammar_version')}", "'grammar_version_missing'"), code(f"{grammar} and {blank('rule_id')}", "'grammar_rule_id_missing'"),
        code(f"{grammar} and s % 3 = 0", "'grammar_supporting_documents_missing'"), code(f"{grammar} and s % 3 > 0 and s % 6 <= 1", "'grammar_document_0_id_missing'"), code(f"{grammar} and s % 3 > 0 and s % 4 = 0", "'grammar_document_1_edition_missing'"),
        code(f"{grammar} and coalesce(validity, '') <> 'grammar'", "'grammar_validity_mismatch'"),
    ]
    rules = [
        code("rule is null", "'rule_id_missing'"), code("rule is not null and again > 1", "'duplicate_rule_id'"), code("rule is not null and status = 'unknown'", "'invalid_status'"), code("rule is not null and status = 'fail'", "'rule_failed:' || rule"),
    ]
    listed = lambda items: f"list_filter([{', '.join(items)}], lambda x: x is not null)"
    return f"""with g as (select l_orderkey as o, l_linenumber as n, min(l_suppkey) as s from lineitem group by 1, 2),
f as (select o, n, s, row_number() over (partition by o order by n) - 1 as i, {', '.join(f"{x} as {c}" for c, x in FIELDS.items())} from g),
p as (select *, row_number() over (partition by o, segment_id order by i) as place from f),
e as (select o, i, evidence_class, list_transform({listed(checks)}, lambda x: 'segment_' || i || ':' || x) as codes from p),
seg as (select o, flatten(list(codes order by i)) as codes, case when count(*) filter (evidence_class not in ('literal_occurrence', 'grammar_validated')) = 0 then min(evidence_class) end as weakest from e group by o),
r0 as (select o, i, case when s % 15 > 0 then 'r' || (s % 5) end as rule, case s % 16 when 0 then 'fail' when 1 then 'unknown' when 2 then 'not_applicable' else 'pass' end as status from f),
r1 as (select *, row_number() over (partition by o, rule order by i) as again from r0),
r2 as (select o, flatten(list(list_transform({listed(rules)}, lambda x: 'cross_rule_' || i || ':' || x) order by i)) as codes from r1 group by o),
every as (
  select o, weakest, list_concat(case when o % 23 = 0 then ['part_number_missing'] else []::varchar[] end, case when o % 29 = 0 then ['segments_missing'] else seg.codes end,
    case when o % 9 = 0 then ['cross_rules_missing'] when {STATUS} = 'evaluated' then case when o % 7 = 0 then ['cross_rules_evaluated_without_results'] else r2.codes end
      when {STATUS} = 'not_applicable' then case when trim({REASON}) = '' then ['cross_rules_not_applicable_reason_missing'] else []::varchar[] end else ['cross_rules_evaluation_status_invalid'] end) as codes
  from seg join r2 using (o))
select o as order_id, len(codes) = 0 as passes, array_to_string(codes, ',') as errors, case when len(codes) = 0 then weakest end as summary, weakest from every"""


def oracle_sql() -> dict[str, str]:
    whole = f"nfc_normalize({WRITTEN})"
    stable = "case p_partkey % 4 " + " ".join(f"when {k} then {STABLE[min(k, 2) if k != 1 else 0]}" for k in (0, 1, 2)) + " end"
    return {
        "identity_contracts": _contract_sql(),
        "unicode_identifiers": f"select p_partkey as part_id, regexp_replace(upper({whole}), '[\\s\\-/_.]+', '', 'g') as identifier, length({whole}) between 2 and 40 and regexp_matches({whole}, '^[\\pL\\pN][\\pL\\pN\\-/_.]*$') and regexp_matches({whole}, '\\pN') as detected, "
        f"regexp_replace(regexp_replace({whole}, '\\pL', 'A', 'g'), '\\pN', 'N', 'g') as signature from part",
        "stable_specs": f"select p_partkey as part_id, {stable} as stable from part",
        "linked_images": "with p as (select *, p_partkey % 3 < 2 as product from part), i as (select p_partkey, p_name, unnest(case when not product then []::varchar[] else case p_partkey % 4 when 0 then ['https://h.example/' || p_partkey || '.jpg'] "
        "when 1 then ['/a.jpg', 'https://h.example/b' || p_size || '.jpg'] when 2 then ['c.jpg'] else []::varchar[] end end || ['https://h.example/last.jpg']) as url, generate_subscripts(case when not product then []::varchar[] else case p_partkey % 4 when 0 then ['a'] when 1 then ['a', 'b'] when 2 then ['c'] else []::varchar[] end end || ['l'], 1) - 1 as image_no from p) "
        "select p_partkey as part_id, image_no, url, p_name as alt from i",
        "ranked_states": f"with p as (select p_partkey, {LETTERS} || p_brand || '-' || p_partkey as number, {STATE} as state, p_name, p_type, p_brand from part), "
        "h as (select *, contains(lower(p_name), 'small')::int + contains(lower(p_name), 'ring')::int as d, contains(lower(p_type), 'small') or contains(lower(p_type), 'ring') as c, contains(lower(number), 'small') or contains(lower(number), 'ring') as nn from p), "
        "s as (select *, case when d = 2 then 660 when d = 1 and c and contains(lower(p_name), 'ring') then 660 when d = 1 then 301 when c then 250 else 0 end as score from h) select p_partkey as part_id, number as part_number, state, score::bigint as score from s where score > 0 "
        "order by score desc, case state when 'published' then 3 when 'validated' then 2 when 'incomplete' then 1 when 'rejected' then -1 else 0 end desc, number collate en, number limit 50",
    }

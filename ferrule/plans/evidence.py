"""More of the catalogue's queries: readers, geometry, gates, records and roles, each beside its SQL for DuckDB.

Data sheets, fragments and labels are put together from the driver's tables, so every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, urls
from ..functions import text as t
from ..operators import compare, discovery, extract, gates, geometry, images, ingest, readers, records, search
from ..sources.tables import dealt, parts, specs, table
from . import gateway
from .catalogue import long

SIZE_ALIASES = [("body", "small widget"), ("body", "widget"), ("finish", "cold"), ("seal", "ring"), ("colour", "blue")]
CANONICAL = {"brand": "manufacturer", "name": "title"}
DEFINITIONS = [("size", "number"), ("range", "measure"), ("brand", "text"), ("name", "text")]
RANGES = [("size", 5.0, 45.0)]
PART_LABELS = ["part number", "mpn"]
DOCUMENT_ATTRIBUTES = ["datasheet", "revision"]
SHEET = "concat('**', p_name, '** [more](https://x.example/a_(b)_c) end', chr(10), '   ', chr(10), 'size: ', p_size, ' mm //cdn.example/x.js ```code', chr(10), '1``` ![pic](i.png)', chr(10), 'last')"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "part_id")


def _sheet(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """part_id, text: a data sheet put together by an expression over part's columns."""
    return _part(spark, sf_dir).select("part_id", F.expr(sql).alias("text"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments a band, the second of a pair half a unit lower and 30 to the right; doc is the order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), "l_suppkey")
    li = dealt(li, "doc").groupBy("doc", "idx").agg(F.min("l_suppkey").alias("s"))
    pair, second = F.floor((F.col("idx") - 1) / 2), F.col("idx") % 2 == 0
    return li.select("doc", F.lit(1).alias("page"), "idx", F.concat(F.lit("t"), F.col("s").cast("string")).alias("text"), F.when(second, 40.0).otherwise(10.0).alias("x"), (700 - 10 * pair - F.when(second, 0.5).otherwise(0.0)).cast("double").alias("y"), F.when(F.col("s") % 2 == 0, 25.0).otherwise(8.0).alias("w"), F.lit(6.0).alias("h"))


FRAGMENTS = (
    "f as (select doc, idx, 't' || s as text, s, (idx - 1) // 2 as pr, case when idx % 2 = 0 then 40.0 else 10.0 end as x, 700 - 10 * ((idx - 1) // 2) - case when idx % 2 = 0 then 0.5 else 0.0 end as y, case when s % 2 = 0 then 25.0 else 8.0 end as w "
    "from (select l_orderkey as doc, l_linenumber as idx, min(l_suppkey) as s from lineitem group by 1, 2)), b as (select *, dense_rank() over (partition by doc order by pr) - 1 as band from f)"
)


#: Inputs of the rules below, in the SQL that Spark and DuckDB share: fields vary apart from each other, so that rules meet all their mixtures.
MENTION = "'see ' || case part_id % 8 when 0 then ' ' when 1 then 'x' when 2 then '-' when 3 then '(' when 4 then '7' when 5 then '' when 6 then '/' else 'é' end || case when p_size % 2 = 0 then lower(p_brand) else p_brand end || '-' || part_id || case p_size % 7 when 0 then ',' when 1 then 'z' when 2 then ' ' when 3 then '-1' when 4 then '9' when 5 then '' else '.' end || case when p_size % 9 = 0 then ' or ' || p_brand || '-' || part_id else '' end"
ROLE_INPUT = {
    "label": "case part_id % 9 when 0 then ' Part  Number ' when 1 then 'MPN' when 2 then 'Revision' when 3 then 'drawing no' when 4 then 'Device' when 5 then 'component' when 6 then 'mpn code' when 7 then null else 'Note' end",
    "value": "case p_size % 7 when 0 then part_id || ' mV' when 1 then '1.5kohm' when 2 then 'AB' || part_id when 3 then '24V' when 4 then '24 V x' when 5 then 'v 5' else '' end",
    "context": "case part_id % 5 when 0 then 'see the Graph' when 1 then 'Figure 3' when 2 then null else 'text' end",
}
SPEC_INPUT = {
    "attribute": "case part_id % 10 when 0 then '' when 1 then 'Price list' when 2 then repeat('long ', 12) when 3 then 'Protection class' when 4 then 'Supply  voltage' when 5 then 'Rated current (max)' when 6 then 'overvoltages' when 7 then 'Remark' when 8 then null else repeat('x', 101) end",
    "value": "case p_size % 8 when 0 then p_size || ' V' when 1 then '<' || p_size || ',5mm' when 2 then 'IP67' when 3 then '' when 4 then 'order 5 V' when 5 then p_size || ' vx' when 6 then '+-' || p_size || ' mm/s' else '5' end",
}
LINK_INPUT = {
    "link": "case part_id % 9 when 0 then 'HTTPS://a.example/x' when 1 then '//b.example/y' when 2 then '/z?q=1' when 3 then 'mailto:x@y' when 4 then '#top' when 5 then '' when 6 then '?p=2' when 7 then 'a/b:c' else 'img/i.png' end",
    "base": "case p_size % 5 when 0 then 'http://h.example' when 1 then 'https://h.example/p/' when 2 then 'https://h.example/p/page.html?x=/y/z' when 3 then 'https://h.example/page#a/b' else 'https://h.example:8443/' || part_id || '/q/' end",
}


MIXED_LINES = (
    "case p_size % 5 when 0 then 'Size: ' || p_size || ' mm' when 1 then 'Size   ' || p_size when 2 then 'Compare' when 3 then p_size || ',5' else 'Rated ' || p_name end || chr(10) || "
    "case part_id % 4 when 0 then '12' when 1 then 'Brand name   ' || p_brand when 2 then ' share ' else p_brand || ' : ' || p_size end || chr(10) || chr(10) || "
    "case part_id % 3 when 0 then repeat('long ', 40) || p_size when 1 then p_size || ' kg' else 'no pair here' end || chr(10) || "
    "case p_size % 3 when 0 then 'Next' when 1 then part_id || ' V' else 'a: b' end || chr(10) || case part_id % 7 when 0 then 'Print' when 1 then '9' else 'tail: x: ' || p_size end"
)
NUMBER_INPUT = (
    "case part_id % 7 when 0 then '' when 1 then ' ' when 2 then '-' when 3 then '+' when 4 then 'MIL_' when 5 then 'vref' else 'AB' end || "
    "case p_size % 6 when 0 then '' || p_size when 1 then p_size || '.5' when 2 then 'iso' || p_size when 3 then '' when 4 then p_size || ',25' else 'β' || p_size end || case part_id % 9 when 0 then 'V' when 1 then ' mm' when 2 then 'kohm' when 3 then '%' when 4 then '/7' when 5 then ' x' else '' end"
)
HTML_TAG = "case p_size % 2 when 0 then 'th' else 'td' end"
#: Cells as they are seen; the first and the last three are a row each, the first and the last but one a definition.
HTML_CELLS = (
    "case part_id % 5 when 0 then 'Size' when 1 then '' when 2 then 'Brand &amp; make' when 3 then '<i>Mass</i>' else 'Link' end", "case p_size % 4 when 0 then p_size || ' mm' when 1 then ' ' when 2 then 'https://x.example/' else '<b>' || p_size || '</b>&nbsp;kg' end",
    "case part_id % 3 when 0 then p_brand when 1 then '' else '-' end", "case p_size % 3 when 0 then 'alone' else '' end", "case part_id % 4 when 0 then '' when 1 then 'logo.png' when 2 then '![a](b)' else p_name end",
)


def markdown_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir, SHEET).select("part_id", t.markdown_cleaned(F.col("text")).alias("text"))


def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = specs(spark, sf_dir).groupBy("part_id").agg(F.count_if(F.col("property") == "size").alias("spec_count"))
    p = parts(spark, sf_dir).join(counts, "part_id", "left").withColumn("validation_state", F.when(F.col("part_id") % 3 == 0, "published").otherwise("candidate"))
    return records.faceted(p, ["SMALL", "PROMO"], True, True).select("part_id", "category")


def browse_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).withColumn("archived_at", F.when(F.col("part_id") % 5 == 0, F.lit("2026-01-01"))).withColumn("status", F.when(F.col("part_id") % 2 == 0, "verified").when(F.col("part_id") % 3 == 0, "rejected").otherwise("candidate"))
    return gateway.browse_mode(p, "SMALL", 20, 5).select("part_id", "part_number", "has_more")


def alias_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _part(spark, sf_dir).select("part_id", F.when(F.col("part_id") % 2 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("left"), F.when(F.col("part_id") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name")).alias("right"))
    return records.oriented(pairs, spark.createDataFrame(SIZE_ALIASES, "code string, alias string"), "part_id").select("part_id", "code", "label", "value", "orientation")


def alias_prefix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.lines(_sheet(spark, sf_dir, "concat(p_name, ' ', p_size, ' mm', chr(10), 'print', chr(10), p_name)"), "part_id")
    out = records.alias_prefixed(rows, spark.createDataFrame(SIZE_ALIASES, "code string, alias string"))
    return out.select(F.col("id").alias("part_id"), long("line_no").alias("line_no"), "code", "label", "value")


def _family_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    return compare.same_family_pairs(p, p, 2).select("base_id", "candidate_id")


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _family_pairs(spark, sf_dir)
    cells = compare.matrix(pairs, specs(spark, sf_dir).filter("property <> 'range'"))
    return records.aligned(pairs, specs(spark, sf_dir), cells.select("base_id", "candidate_id", "property", "state"), CANONICAL)


def spec_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("property") == "brand", 1).when(F.col("property") == "name", 2).when(F.col("property") == "range", 3).otherwise(4)
    rows = specs(spark, sf_dir).select("part_id", order.alias("ord"), F.col("property").alias("attribute"))
    return records.row_order(_family_pairs(spark, sf_dir), rows).withColumn("place", long("place"))


def datatype_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = specs(spark, sf_dir).select("part_id", "property", F.when((F.col("part_id") % 9 == 0) & (F.col("property") == "name"), "12 mm").when((F.col("part_id") % 8 == 0) & (F.col("property") == "size"), "large").otherwise(F.col("value")).alias("value"))
    out = records.typed(rows, spark.createDataFrame(DEFINITIONS, "property string, data_type string"), spark.createDataFrame(RANGES, "property string, low double, high double"))
    return out.select("part_id", "property", "value", F.coalesce("reason", F.lit("pass")).alias("reason"))


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select(F.concat_ws("|", "p_name", "p_type").alias("fingerprint"), F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("area"), F.when(F.col("p_type") == "PROMO", "auto_accept").otherwise("shadow_review").alias("status"))
    return records.batch_metrics(rows, "fingerprint", 500)


def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.gate_metrics(_part(spark, sf_dir).withColumn("expected", F.when(F.col("part_id") % 6 == 0, "OTHER").otherwise(F.col("p_type"))), "expected", "p_type")


def longest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.longest_values(specs(spark, sf_dir), ["family", "property"], "value", [F.asc("value"), F.asc("part_id")]).select("family", "property", "value", "part_id")


def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (-F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderdate").alias("created_at"))
    return records.queue_head(q, 25).select("id", long("priority").alias("priority"))


def maker_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    makers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("maker"), F.array(F.concat(F.lit("WWW"), (F.col("s_suppkey") % 3).cast("string"), F.lit(".example"))).alias("official"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(" www0.example "), F.lit(" "), F.lit("shop.example"))).alias("authorized"))
    return records.allowed_domains(makers)


def specs_not_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = specs(spark, sf_dir).select("part_id", "property", "value")
    return records.not_shown(s, s.filter("part_id % 2 = 0 and property <> 'range'").select(F.upper("property").alias("property"), F.concat(F.col("value"), F.lit("!")).alias("value")), ["property", "value"])


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_id"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")).alias("source_id"), F.concat(F.lit("https://x.example/"), (F.col("l_suppkey") % 7).cast("string")).alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_returnflag")
    sources = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("source_id"), F.lower(F.regexp_replace("s_name", "#", "-")).alias("url"))
    side = lambda which: li.filter(which).drop("l_returnflag")
    return records.merged_sources(side("l_returnflag = 'R'"), side("l_returnflag <> 'R'"), sources)


def exact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", records.exact_token(F.expr(MENTION), F.expr("p_brand || '-' || part_id")).alias("found"))


def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _sheet(spark, sf_dir, f"concat('<table><tr>', {', '.join(f"'<' || {HTML_TAG} || ' x=1>' || {c} || '</' || {HTML_TAG} || '>'" for c in HTML_CELLS[:3])}, '</tr><TR class=a>', {', '.join(f"'<td>' || {c} || '</td>'" for c in HTML_CELLS[3:])}, '</TR></table><dl><dt>', {HTML_CELLS[0]}, '</dt> <dd><b>', {HTML_CELLS[4]}, '</b></dd></dl>')")
    return extract.html_rows(pages, "part_id", "text").select(F.col("id").alias("part_id"), long("row_no").alias("row_no"), "attribute", "value")


def compact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sheet(spark, sf_dir, "concat('Bore diameter of ', p_size, ' MM, then Stroke ', p_size, ',5 cm; Foo 3 xyz. Stroke ', p_size, ',5 cm')")
    return extract.compact_pairs(docs, "part_id").select(F.col("id").alias("part_id"), "attribute", "value")


def value_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sheet(spark, sf_dir, "concat('with ', p_size, 'mm Piston, M10x1.5 Rod thread; G 1/8 Port and ', p_size, ' xyz Other')")
    return readers.value_first_pairs(docs, "part_id").select(F.col("id").alias("part_id"), "attribute", "value")


def spaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.lines(_sheet(spark, sf_dir, MIXED_LINES), "part_id")
    return readers.spaced_pairs(rows).select(F.col("id").alias("part_id"), long("line_no").alias("line_no"), "attribute", "value")


def next_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.lines(_sheet(spark, sf_dir, MIXED_LINES), "part_id")
    return readers.next_line_pairs(rows).select(F.col("id").alias("part_id"), long("line_no").alias("line_no"), "attribute", "value")


def type_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.lines(_sheet(spark, sf_dir, "concat(100000 + p_partkey, chr(10), 'text', chr(10), 'dsnu-', p_size, chr(10), 200000 + p_partkey, chr(10), 300000 + p_partkey, chr(10), 'DSNU-', p_size, '-P')".replace("p_partkey", "part_id")), "part_id")
    return readers.catalogue_pairs(rows, "DSNU").select(F.col("id").alias("part_id"), "part_number", "type_code")


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    cells = F.when(F.col("l_linenumber") % 3 == 1, F.array(F.concat(F.lit("S"), F.col("s").cast("string")))).otherwise(F.array(F.lit("a"), F.col("s").cast("string")))
    out = extract.sectioned(li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("row_no"), cells.alias("cells")))
    return out.select(F.col("id").alias("order_id"), long("row_no").alias("row_no"), "section", F.get("cells", 1).alias("value"))


def band_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.cells(geometry.banded(_fragments(spark, sf_dir)))
    return out.select("doc", long("band").alias("band"), long("cell").alias("cell"), "text", "x0", "x1")


def fragment_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.tables(geometry.cells(geometry.banded(_fragments(spark, sf_dir))))
    return out.select("doc", long("band").alias("band"), long("cell").alias("cell"), long("table").alias("table"))


def fragment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.merged_box(_fragments(spark, sf_dir), ["doc", "page"]).select("doc", "x0", "y0", "x1", "y1")


def nearest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fragments(spark, sf_dir)
    columns = spark.createDataFrame([(1, 0, 8.0), (1, 1, 24.0), (1, 2, 60.0)], "page int, column_id int, x double")
    docs = f.select("doc").distinct().withColumn("page", F.lit(1)).join(F.broadcast(columns), "page").select("doc", "page", "column_id", "x")
    out = geometry.nearest_column(f.select("doc", "page", F.col("idx").alias("value_id"), (F.col("x") + F.col("w")).alias("x")), docs)
    return out.select("doc", long("value_id").alias("value_id"), long("column_id").alias("column_id"))


def identifier_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, value, context = (F.expr(ROLE_INPUT[c]) for c in ("label", "value", "context"))
    r = discovery.identifier_role(label, value, context, F.expr("p_size % 3 = 0"), PART_LABELS, "revision|drawing", "graph|figure")
    return _part(spark, sf_dir).select("part_id", r["role"].alias("role"), r["demonstrated"].alias("demonstrated"), r["reason"].alias("reason"))


def spec_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    g = gates.spec_gate(F.when(F.col("part_id") % 5 != 0, F.col("p_name")), F.when(F.col("part_id") % 4 != 0, F.lit("e")), F.col("p_size") - 3, F.col("part_id") % 2 == 0, F.when(F.col("part_id") % 6 != 0, F.lit("TECHNICAL_SPECIFICATION")), F.when(F.col("part_id") % 7 == 0, " Revision").when(F.col("part_id") % 11 == 0, "figure 2").otherwise("size"), DOCUMENT_ATTRIBUTES, "(?i)figure|graph")
    return p.select("part_id", g["pass"].alias("passes"), F.array_join(g["causes"], ",").alias("causes"))


def evidence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    segment = F.struct(
        F.when(F.col("s") % 5 != 0, F.concat(F.lit("s"), (F.col("s") % 3).cast("string"))).alias("segment_id"), F.lit("t").alias("token"), F.when(F.col("s") % 4 != 0, "inferred").otherwise("guess").alias("evidence_class"),
        F.lit("d").alias("document_id"), (F.col("s") % 2).cast("int").alias("page"),
    )
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", segment.alias("g")))), lambda x: x["g"]).alias("segments"))
    return rows.select(F.col("l_orderkey").alias("order_id"), F.array_join(gates.evidence_errors(F.col("segments")), ",").alias("errors"))


def publish_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "purchase", "published").when(F.col("event_type") == "view", "already_exists").when(F.col("event_type") == "click", "review_required").otherwise(F.col("event_type"))
    return e.select("event_id", ingest.publish_status(outcome).alias("state"))


def new_dimension_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    names = c.select(F.concat(F.col("c_mktsegment"), F.lit(" & Co. "), (F.col("c_nationkey") % 4).cast("string")).alias("name"))
    known = spark.createDataFrame([("furnitureco1",), ("buildingco2",)], "name_key string")
    return ingest.dimension_keys(names, known).select("name_key")


def decision_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("part_id")
    state = gateway.decision_status(F.when(n % 4 == 0, "replace"), F.when(n % 3 == 0, "review"), F.when(n % 5 == 0, "open"), n % 2 == 0)
    return parts(spark, sf_dir).select("part_id", state.alias("status"))


def score_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", long(compare.score_ring(F.col("p_size") % 7, F.col("p_size") % 9)).alias("ring"))


def first_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda status, value, parsed: F.struct(F.lit(status).alias("status"), value.alias("value"), parsed.alias("parsed"), F.lit("V").alias("unit"))
    size, none = F.col("p_size").cast("string"), F.lit(None).cast("string")
    levels = F.array(level("raw", none, F.when(F.col("p_size") % 3 != 0, size)), level("normalized", F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(".0"))), none))
    return _part(spark, sf_dir).select("part_id", compare.first_level(levels).alias("shown"))


def technical_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = discovery.technical_spec(F.expr(SPEC_INPUT["attribute"]), F.expr(SPEC_INPUT["value"]), "price|order", ["protection class"], "voltage|current", ["v", "mm"])
    return _part(spark, sf_dir).select("part_id", r["ok"].alias("ok"), r["reason"].alias("reason"))


def domain_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.in_domain(h, urls.registrable(h)).alias("own"), urls.in_domain(h, F.lit("example.com")).alias("example"))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", urls.resolved(F.expr(LINK_INPUT["link"]), F.expr(LINK_INPUT["base"])).alias("url"))


def djb2_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("part_id", hashing.djb2(F.col("part_number")).alias("hash"))


def invalid_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr(NUMBER_INPUT)
    return _part(spark, sf_dir).select("part_id", discovery.invalid_part_number(value).alias("invalid"), t.is_weak_reference(value).alias("weak"), t.is_unicode_identifier(value).alias("identifier"), t.unicode_signature(value).alias("signature"))


def notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("⌀ "), F.col("p_size").cast("string"), F.lit(" x "), F.col("p_size").cast("string"), F.lit("×3  um"))
    return _part(spark, sf_dir).select("part_id", t.notation(raw).alias("shown"))


def ordering_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cells = li.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("table"), F.floor(F.col("l_linenumber") / 2).alias("row"), F.concat(F.lit("X-"), (F.col("l_suppkey") % 3).cast("string")).alias("token"))
    return readers.ordered_parts(cells).select("doc", long("row").alias("row"), "token")


def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _sheet(spark, sf_dir, "concat('<meta property=\"og:image\" content=\"https://h.example/', part_id, '.jpg\"><img alt=x src=\"/a', part_id, '.png\"><script type=\"application/ld+json\">{\"@type\": \"Product\", \"image\": [\"https://h.example/ld', part_id, '.jpg\"]}</script>')")
    out = extract.images(html, "part_id", "text")
    return out.select(F.col("id").alias("part_id"), long("image_no").alias("image_no"), "method", "url")


def attached_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_id"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("url"), (F.col("l_returnflag") == "R").alias("main"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("verified"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("created"))
    best = li.groupBy("part_id").agg(F.max_by("url", F.struct("main", F.coalesce("verified", F.lit("1900-01-01").cast("timestamp")), "created", "url")).alias("url"))
    out = images.attach(parts(spark, sf_dir).select("part_id"), li.join(best, ["part_id", "url"], "left_semi").dropDuplicates(["part_id", "url"]), F.col("main"), F.col("verified"), F.col("created"))
    return out.select("part_id", "image_url")


def known_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that each line of an order asks for, by a number written in its own way; every seventh number is of no part."""
    asked = F.expr("case when l_partkey % 7 = 0 then '?' else '' end || case l_linenumber % 3 when 0 then lower(p_brand) when 1 then p_brand else upper(p_brand) end || '-' || l_partkey")
    lines = table(spark, sf_dir, "lineitem").join(_part(spark, sf_dir), F.col("l_partkey") == F.col("part_id"))
    found = gateway.known_parts(lines.select(asked.alias("asked")), parts(spark, sf_dir), "asked")
    return found.groupBy("part_id").agg(F.countDistinct("asked").alias("n_writings"), F.count("*").alias("n_lines"))


def use_case_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([("pumps", "SMALL"), ("pumps", "LARGE"), ("signs", "PROMO"), ("none", "UNUSED")], "use_case string, category string")
    return gateway.use_cases_mode(cases, parts(spark, sf_dir))


def industrial_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.when(F.col("part_id") % 4 == 0, "").when(F.col("part_id") % 4 == 1, F.concat(F.lit("cheap hotel "), F.col("p_name"))).when(F.col("part_id") % 4 == 2, "hotel").otherwise(F.col("p_name"))
    return _part(spark, sf_dir).select("part_id", search.looks_industrial(query, "widget|gear|bolt", "hotel|recipe").alias("industrial"))


def _values(rows: list[tuple]) -> str:
    return "values " + ", ".join("(" + ", ".join("'" + x + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        markdown_clean, facet_filter, browse_live, alias_orientation, alias_prefix_lines, canonical_rows, spec_row_order, datatype_gate, batch_metrics, gate_metrics, longest_values, queue_head, maker_domains,
        specs_not_shown, part_sources, exact_tokens, html_table_rows, compact_labels, value_first, spaced_lines, next_lines, type_codes, section_rows, band_cells, fragment_tables, fragment_boxes, nearest_columns,
        identifier_roles, spec_gates, evidence_contract, publish_states, new_dimension_names, decision_states, score_rings, first_levels, technical_specs, domain_members, resolved_links, djb2_hashes, invalid_numbers,
        notations, ordering_parts, image_urls, attached_images, known_numbers, use_case_reach, industrial_queries,
    )
    return {f.__name__: f for f in own}


COLON = r"^(.{2,120}?)\s*[:：]\s*(.{1,150})$"
GAPPED = r"^([A-Za-z][A-Za-z0-9À-ÿ()/,.\-\s]{2,110}?)\s{2,}(.{1,150})$"


def _mixed_lines() -> str:
    return f"q as (select *, p_partkey as part_id from part), l as (select part_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from (select part_id, list_filter(list_transform(string_split({MIXED_LINES}, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from q))"


def oracle_sql() -> dict[str, str]:
    from .oracle import HOST, PARTS, SPECS

    pairs = "pr as (select base_id, candidate_id from (select b.part_id as base_id, c.part_id as candidate_id, row_number() over (partition by b.part_id order by c.part_number, c.part_id) as n from p b join p c on b.category = c.category and b.part_id <> c.part_id) where n <= 2)"
    aliases = f"al(code, alias) as ({_values(SIZE_ALIASES)})"
    best = "case when l = alias or starts_with(l, alias || ' ') then 0 when r = alias or starts_with(r, alias || ' ') then 1 end"
    canonical = "case property when 'brand' then 'manufacturer' when 'name' then 'title' else property end"
    return {
        "markdown_clean": "select p_partkey as part_id, '**' || p_name || '**   end' || chr(10) || 'size: ' || p_size || ' mm' || chr(10) || 'last' as text from part",
        "facet_filter": f"with {PARTS}, {SPECS} select part_id, category from p where part_id % 3 = 0 and category in ('SMALL', 'PROMO') and part_id in (select part_id from s where property = 'size')",
        "browse_live": f"with {PARTS}, l as (select *, row_number() over (order by part_number, part_id) as n, count(*) over () as c from p where category = 'SMALL' and part_id % 5 <> 0 and (part_id % 2 = 0 or part_id % 3 <> 0)) select part_id, part_number, c > 25 as has_more from l where n between 6 and 25",
        "alias_orientation": f"with {aliases}, x as (select p_partkey as part_id, case when p_partkey % 2 = 0 then p_name else p_size::varchar end as l, case when p_partkey % 2 = 0 then p_size::varchar else p_name end as r from part), "
        f"m as (select *, {best} as side from x cross join al), k as (select *, row_number() over (partition by part_id order by side, length(alias) desc, alias) as n from m where side is not null) "
        "select part_id, code, case when side = 0 then l else r end as label, case when side = 0 then r else l end as value, case when side = 0 then 'label_to_value' else 'value_to_label' end as orientation from k where n = 1",
        "alias_prefix_lines": f"with {aliases}, x as (select p_partkey as part_id, 0::bigint as line_no, p_name || ' ' || p_size || ' mm' as line from part union all select p_partkey, 2, p_name from part), "
        "k as (select *, row_number() over (partition by part_id, line_no order by length(alias) desc, alias) as n from x join al on starts_with(line, alias || ' ')) select part_id, line_no, code, alias as label, trim(substr(line, length(alias) + 1)) as value from k where n = 1",
        "canonical_rows": f"with {PARTS}, {SPECS}, {pairs}, q as (select part_id, {canonical} as attribute, property, value from s), "
        "r as (select base_id, candidate_id, a.attribute, a.property, a.value as v, (select max(value) from q z where z.part_id = candidate_id and z.property = a.property) as w from pr join q a on a.part_id = base_id) "
        "select base_id, candidate_id, attribute, case when property = 'range' then case when w is null then 'base_only' else 'not_comparable' end when w is null then 'base_only' when lower(v) = lower(w) then 'equal' else 'different' end as state from r",
        "spec_row_order": f"with {PARTS}, {SPECS}, {pairs}, o as (select *, case property when 'brand' then 1 when 'name' then 2 when 'range' then 3 else 4 end as ord from s), "
        "u as (select base_id, candidate_id, property, 0 as side, ord from pr join o on part_id = base_id union all select base_id, candidate_id, property, 1, ord from pr join o on part_id = candidate_id), "
        "f as (select base_id, candidate_id, property as attribute, min(side * 10 + ord) as k from u group by 1, 2, 3) select base_id, candidate_id, attribute, row_number() over (partition by base_id, candidate_id order by k) as place from f",
        "datatype_gate": f"with {SPECS}, v as (select part_id, property, case when part_id % 9 = 0 and property = 'name' then '12 mm' when part_id % 8 = 0 and property = 'size' then 'large' else value end as value from s) "
        "select part_id, property, value, case when property in ('size', 'range') and not regexp_matches(value, '[0-9]') then 'numeric_property_requires_recognizable_number' "
        "when property = 'size' and (value::double < 5 or value::double > 45) then 'value_failed_plausibility_rules' when property = 'name' and value = '12 mm' then 'categorical_property_requires_real_word_after_unit_filter' else 'pass' end as reason from v",
        "batch_metrics": "with k as (select p_name || '|' || p_type as f, count(*) as n, count(*) filter (p_type <> 'SMALL') as c, count(*) filter (p_type <> 'PROMO') as r from part group by 1) "
        "select sum(n)::bigint as processed, (sum(n) - count(*))::bigint as cache_hits, sum(c)::bigint as classified, sum(r)::bigint as shadow_review, ceil(sum(n) / 500.0)::bigint as batches, count(*) as cache_size from k",
        "gate_metrics": "select count(*) as total, count(*) filter (p_partkey % 6 <> 0) as passed, count(*) filter (p_partkey % 6 <> 0) / count(*) as precision, count(*) filter (p_partkey % 6 <> 0) / count(*) as recall, count(*) filter (p_partkey % 6 <> 0) / count(*) as f1 from part",
        "longest_values": f"with {SPECS}, r as (select *, row_number() over (partition by family, property order by length(value) desc, value, part_id) as n from s) select family, property, value, part_id from r where n = 1",
        "queue_head": "select o_orderkey as id, -(o_orderpriority[1]::bigint) as priority from orders order by o_orderpriority[1]::bigint, o_orderdate, o_orderkey limit 25",
        "maker_domains": "select s_name as maker, 'www' || (s_suppkey % 3) || '.example' as domain from supplier union select s_name, 'www0.example' from supplier where s_suppkey % 2 = 0 union select s_name, 'shop.example' from supplier where s_suppkey % 2 = 0",
        "specs_not_shown": f"with {SPECS}, e as (select distinct property, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) as v from s where part_id % 2 = 0 and property <> 'range') "
        "select part_id, s.property, value from s left join e on e.property = s.property and e.v = trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) where e.v is null",
        "part_sources": "with x as (select l_partkey as part_id, case when l_suppkey % 4 <> 0 then l_suppkey end as source_id, case when l_suppkey % 4 <> 0 and l_suppkey % 2 = 0 then lower(replace(s_name, '#', '-')) else 'https://x.example/' || (l_suppkey % 7) end as url, "
        "case when l_returnflag = 'R' then 0 else 1 end as o, l_orderkey * 10 + l_linenumber as ord from lineitem left join supplier on s_suppkey = l_suppkey), "
        "k as (select *, row_number() over (partition by part_id, coalesce(source_id::varchar, url) order by o, ord) as n from x) select part_id, source_id, url, case when o = 0 then 'link' else 'evidence' end as origin from k where n = 1",
        "exact_tokens": f"with q as (select *, p_partkey as part_id from part) select part_id, regexp_matches(lower({MENTION}), '(^|[^a-z0-9])' || lower(p_brand || '-' || part_id) || '($|[^a-z0-9])') as found from q",
        "html_table_rows": "with q as (select *, p_partkey as part_id from part), "
        + f"c as (select part_id, {', '.join(f"trim(regexp_replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), ' +', ' ', 'g')) as c{i}" for i, x in enumerate(HTML_CELLS))} from q), "
        "r as (select *, list_filter([c0, c1, c2], lambda x: x <> '') as one, list_filter([c3, c4], lambda x: x <> '') as two from c), "
        "a as (select part_id, list_filter([one, two], lambda x: len(x) >= 2) as rows, c0, c4 from r), "
        "k as (select part_id, unnest(list_append(list_transform(rows, lambda x: struct_pack(attribute := x[1], value := array_to_string(x[2:], ' '))), struct_pack(attribute := c0, value := c4))) as p, "
        "generate_subscripts(list_append(list_transform(rows, lambda x: 1), 1), 1) - 1 as row_no from a) "
        f"select part_id, row_no, p.attribute as attribute, p.value as value from k where p.attribute <> '' and p.value <> '' and not regexp_matches(p.attribute || ' ' || p.value, '{extract.UNSAFE}') and lower(p.value) not in ({', '.join(repr(x) for x in extract.NOTHING)})",
        "compact_labels": "select p_partkey as part_id, 'Bore diameter' as attribute, p_size || ' mm' as value from part union all select p_partkey, 'Stroke', p_size || ',5 cm' from part",
        "value_first": "select p_partkey as part_id, 'Piston' as attribute, p_size || ' mm' as value from part union all select p_partkey, 'Rod thread', 'M10x1.5' from part union all select p_partkey, 'Port and', 'G 1/8' from part",
        "spaced_lines": f"with {_mixed_lines()} select part_id, line_no, trim(case when regexp_matches(line, '{COLON}') then regexp_extract(line, '{COLON}', 1) else regexp_extract(line, '{GAPPED}', 1) end) as attribute, "
        f"trim(case when regexp_matches(line, '{COLON}') then regexp_extract(line, '{COLON}', 2) else regexp_extract(line, '{GAPPED}', 2) end) as value from l where length(line) <= 260 and (regexp_matches(line, '{COLON}') or regexp_matches(line, '{GAPPED}'))",
        "next_lines": f"with {_mixed_lines()}, n as (select *, lower(line) in ({', '.join(repr(x) for x in readers.NOISE)}) or length(line) <= 2 as noise, length(line) > 180 as long, regexp_matches(line, '[0-9]') as digit from l), "
        "w as (select *, " + ", ".join(f"lead({c}, {i}) over v as {c}{i}" for i in (1, 2, 3) for c in ("line", "noise", "long", "digit")) + " from n window v as (partition by part_id order by line_no)), "
        "u as (select *, case when not noise1 and not long1 and digit1 then line1 when not noise1 and long1 then null when not noise2 and not long2 and digit2 then line2 when not noise2 and long2 then null when not noise3 and not long3 and digit3 then line3 end as value from w) "
        "select part_id, line_no, line as attribute, value from u where value is not null and length(line) between 2 and 120 and not noise and regexp_matches(line, '[A-Za-zÀ-ÿ]') and not regexp_matches(line, '^[0-9+\\-.,%\\s]+$')",
        "type_codes": "select p_partkey as part_id, (100000 + p_partkey)::varchar as part_number, 'DSNU-' || p_size as type_code from part union all select p_partkey, (300000 + p_partkey)::varchar, 'DSNU-' || p_size || '-P' from part",
        "section_rows": "with x as (select l_orderkey, l_linenumber, min(l_suppkey) as s from lineitem group by 1, 2), k as (select *, last_value(case when l_linenumber % 3 = 1 then 'S' || s end ignore nulls) over (partition by l_orderkey order by l_linenumber) as section from x) "
        "select l_orderkey as order_id, l_linenumber as row_no, section, s::varchar as value from k where l_linenumber % 3 <> 1",
        "band_cells": f"with {FRAGMENTS}, c as (select *, lag(x + w) over (partition by doc, band order by x) as e from b), d as (select *, case when x - e >= 10 then 1 else 0 end as cell from c) "
        "select doc, band, cell::bigint as cell, string_agg(text, ' ' order by x) as text, min(x)::double as x0, max(x + w)::double as x1 from d group by 1, 2, 3",
        "fragment_tables": f"with {FRAGMENTS}, c as (select *, lag(x + w) over (partition by doc, band order by x) as e from b), d as (select *, case when x - e >= 10 then 1 else 0 end as cell from c), "
        "n as (select doc, band, max(cell) + 1 as k from d group by 1, 2), i as (select *, band - row_number() over (partition by doc order by band) as g from n where k >= 2), z as (select *, count(*) over (partition by doc, g) as size from i), "
        "y as (select *, dense_rank() over (partition by doc order by g) - 1 as tab from z where size >= 2) select distinct d.doc, d.band, d.cell::bigint as cell, y.tab as \"table\" from d join y on y.doc = d.doc and y.band = d.band",
        "fragment_boxes": f"with {FRAGMENTS} select doc, min(x)::double as x0, min(y)::double as y0, max(x + w)::double as x1, max(y + 6)::double as y1 from f group by 1",
        "nearest_columns": f"with {FRAGMENTS}, c(column_id, cx) as (values (0, 8.0), (1, 24.0), (2, 60.0)) select doc, idx as value_id, arg_min(column_id, abs(x + w - cx) * 10 + column_id)::bigint as column_id from f cross join c group by 1, 2",
        "identifier_roles": f"with q as (select *, p_partkey as part_id from part), n as (select part_id, p_size % 3 = 0 as bound, {', '.join(f"lower(trim(regexp_replace(coalesce({x}, ''), '[ ]+', ' ', 'g'))) as {c}" for c, x in ROLE_INPUT.items())} from q), "
        "r as (select part_id, case when label in ('part number', 'mpn') then case when bound then 1 else 2 end when regexp_matches(label, 'revision|drawing') then 3 when regexp_matches(value, '^[0-9]+([.][0-9]+)? *(v|mv|kv|a|ma|ua|hz|khz|mhz|ohm|kohm|mohm|w|mw)$') then 4 "
        "when regexp_matches(context, 'graph|figure') then 5 when label in ('device', 'component') then 6 else 7 end as k from n) "
        "select part_id, ['PART_NUMBER', 'IDENTIFIER_CANDIDATE', 'DOCUMENT_REFERENCE', 'ELECTRICAL_VALUE', 'DOCUMENT_REFERENCE', 'IDENTIFIER_CANDIDATE', 'UNKNOWN'][k] as role, k = 1 as demonstrated, "
        "['explicit_part_number_label', 'part_label_not_structurally_bound', 'negative_identifier_label', 'value_shape_not_identifier', 'excluded_document_context', 'contextual_label_requires_corroboration', 'insufficient_semantic_evidence'][k] as reason from r",
        "spec_gates": "with c as (select p_partkey as part_id, array_to_string(list_filter([case when p_partkey % 5 = 0 then 'empty original_value' end, case when p_partkey % 4 = 0 then 'missing evidence_text' end, case when p_partkey % 2 <> 0 and p_size - 3 < 1 then 'missing evidence_locator' end, "
        "case when p_partkey % 6 = 0 then 'technical_specification_role_not_demonstrated' end, case when p_partkey % 7 = 0 then 'non_technical_document_attribute' end, case when p_partkey % 7 <> 0 and p_partkey % 11 = 0 then 'graph_or_document_context' end], lambda x: x is not null), ',') as causes from part) "
        "select part_id, causes = '' as passes, causes from c",
        "evidence_contract": "with x as (select l_orderkey, l_linenumber, min(l_suppkey) as s, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as i from lineitem where l_linenumber <= 3 group by 1, 2), "
        "e as (select *, list_filter([case when s % 5 = 0 then 'segment[' || i || '].segment_id' end, case when s % 4 = 0 then 'segment[' || i || '].evidence_class' end, case when s % 2 < 1 then 'segment[' || i || '].page' end], lambda v: v is not null) as bad from x), "
        "g as (select l_orderkey as order_id, flatten(list(bad order by i)) as bad, count(*) filter (s % 5 <> 0) as n, count(distinct s % 3) filter (s % 5 <> 0) as d from e group by 1) select order_id, array_to_string(list_concat(bad, case when d < n then ['duplicate_segment_id'] else [] end), ',') as errors from g",
        "publish_states": "select event_id, case when event_type in ('purchase', 'view') then 'resolved' when event_type = 'click' then 'needs_review' else 'rejected' end as state from events",
        "new_dimension_names": "select distinct lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g')) || 'co' || (c_nationkey % 4) as name_key from customer where lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g')) || 'co' || (c_nationkey % 4) not in ('furnitureco1', 'buildingco2')",
        "decision_states": "select p_partkey as part_id, case when p_partkey % 4 = 0 then 'replace' when p_partkey % 3 = 0 then 'review' when p_partkey % 5 = 0 then 'open' when p_partkey % 2 = 0 then 'eligible' else 'not_eligible' end as status from part",
        "score_rings": "select p_partkey as part_id, case when p_size % 9 <> 0 then floor((p_size % 7) * 100 / (p_size % 9) + 0.5)::bigint end as ring from part",
        "first_levels": "select p_partkey as part_id, case when p_size % 2 = 0 then p_size || '.0 V' when p_size % 3 <> 0 then p_size || ' V' end as shown from part",
        "technical_specs": f"with q as (select *, p_partkey as part_id from part), n as (select part_id, lower(trim(regexp_replace(coalesce({SPEC_INPUT['attribute']}, ''), '[ ]+', ' ', 'g'))) as a, trim({SPEC_INPUT['value']}) as v from q), "
        "r as (select part_id, case when a = '' or v = '' then 1 when regexp_matches(a, 'price|order') or regexp_matches(lower(v), 'price|order') then 2 when length(a) > 100 or len(string_split(a, ' ')) > 8 then 3 when a = 'protection class' then 4 "
        "when regexp_matches(a, '(^|[^a-z])(voltage|current)($|[^a-z])') and regexp_matches(v, '(?i)[0-9]([.,][0-9]+)? *(v|mm)($|[ ,;/])') then 5 else 6 end as k from n) "
        "select part_id, k in (4, 5) as ok, ['missing_attribute_or_value', 'non_technical_document_or_graph_context', 'attribute_too_long', 'demonstrated_qualitative_technical_attribute', 'technical_attribute_and_engineering_value', 'insufficient_technical_semantics'][k] as reason from r",
        "domain_members": f"with u as (select page_id, {HOST} as host from pages) select page_id, true as own, host = 'example.com' or ends_with(host, '.example.com') as example from u",
        "resolved_links": f"with q as (select *, p_partkey as part_id from part), n as (select part_id, {LINK_INPUT['link']} as link, {LINK_INPUT['base']} as base from q), b as (select *, regexp_extract(base, '^(https?://[^/?#]+)', 1) as origin, regexp_extract(base, '^(https?://[^?#]*/)', 1) as folder from n) "
        "select part_id, case when regexp_matches(link, '(?i)^https?://') then link when starts_with(link, '//') then split_part(base, '//', 1) || link when starts_with(link, '/') then origin || link when regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') or starts_with(link, '#') then null "
        "else case when folder in ('', 'http://', 'https://') then origin || '/' else folder end || link end as url from b",
        "djb2_hashes": f"with {PARTS} select part_id, list_reduce(list_transform(string_split(part_number, ''), lambda c: ascii(c)::bigint), lambda h, x: xor((h * 33) % 4294967296, x), 5381::bigint) as hash from p",
        "invalid_numbers": f"with q as (select *, p_partkey as part_id from part), v as (select part_id, {NUMBER_INPUT} as raw, trim({NUMBER_INPUT}) as v from q) "
        "select part_id, v <> '' and (not regexp_matches(v, '[0-9]') or regexp_matches(v, '(?i)^VREF[0-9]*$') or regexp_matches(v, '(?i)^(JEP|JESD|IEC|ISO|MIL)[-_]?[0-9]') or regexp_matches(v, '(?i)^[0-9]+([.][0-9]+)?(V|MV|KV|A|MA|HZ|KHZ|MHZ|W|MW|OHM|KOHM)$')) as invalid, "
        "regexp_matches(v, '(?i)^[-+]?[0-9]+([.,][0-9]+)? *(mm|cm|m|v|a|ma|w|kw|bar|mpa|psi|hz|kg|g|nm|n|rpm|°c|°f|%)?$') as weak, "
        "length(v) between 2 and 40 and regexp_matches(v, '^[\\pL\\pN][\\pL\\pN/_.-]*$') and regexp_matches(v, '[0-9]') as identifier, regexp_replace(regexp_replace(raw, '\\pL', 'A', 'g'), '[0-9]', 'N', 'g') as signature from v",
        "notations": "select p_partkey as part_id, 'Ø' || p_size || ' × ' || p_size || ' × 3 µm' as shown from part",
        "ordering_parts": "with x as (select l_orderkey as doc, l_linenumber // 2 as row, 'X-' || (l_suppkey % 3) as token from lineitem), r as (select doc, row, count(distinct token) as n, min(token) as token from x group by 1, 2) select doc, min(row)::bigint as row, token from r where n = 1 group by doc, token",
        "image_urls": "select p_partkey as part_id, 0::bigint as image_no, 'jsonld' as method, 'https://h.example/ld' || p_partkey || '.jpg' as url from part union all select p_partkey, 1, 'og', 'https://h.example/' || p_partkey || '.jpg' from part union all select p_partkey, 2, 'html', '/a' || p_partkey || '.png' from part",
        "attached_images": "with x as (select l_partkey, l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || l_quantity as url, row_number() over (partition by l_partkey order by l_returnflag = 'R' desc, case when l_linestatus = 'F' then l_shipdate end desc nulls last, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 desc, l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || l_quantity desc) as n from lineitem) "
        "select p_partkey as part_id, url as image_url from part left join x on l_partkey = p_partkey and n = 1",
        "known_numbers": "with a as (select case when l_partkey % 7 = 0 then '?' else '' end || case l_linenumber % 3 when 0 then lower(p_brand) when 1 then p_brand else upper(p_brand) end || '-' || l_partkey as asked from lineitem join part on l_partkey = p_partkey) "
        "select p_partkey as part_id, count(distinct asked) as n_writings, count(*) as n_lines from a join part on lower(asked) = lower(p_brand || '-' || p_partkey) group by 1",
        "use_case_reach": "with c(use_case, category) as (values ('pumps', 'SMALL'), ('pumps', 'LARGE'), ('signs', 'PROMO'), ('none', 'UNUSED')) select use_case, count(p_partkey) as n_parts from c left join part on p_type = category group by 1",
        "industrial_queries": "select p_partkey as part_id, case p_partkey % 4 when 0 then true when 2 then false when 1 then regexp_matches(p_name, 'widget|gear|bolt') else true end as industrial from part",
    }

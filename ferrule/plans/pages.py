"""Queries over pages of fragments: lines, columns, specifications, selection tables; each beside its SQL for DuckDB.

Fragments are put together from the driver's tables, so every query runs over whole tables. Where a rule goes from
fragment to fragment, the SQL does so too, by recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, geometry, layout
from ..sources.tables import dealt, table
from .catalogue import long

SCATTERED = "with g as (select l_orderkey as doc, l_linenumber as idx, min(l_suppkey) as s from lineitem group by 1, 2), f as (select doc, idx, s, case when s % 3 = 0 then 'T' || s else 'word' || s end as text, ((s * 5) % 40)::double as x, ((s * 7 + idx * 3) % 23)::double as y, ((s % 14) + 2)::double as h from g)"


def _scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of an order's page, scattered over few heights."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx")).agg(F.min("l_suppkey").alias("s"))
    s = F.col("s")
    text = F.concat(F.when(s % 3 == 0, "T").otherwise("word"), s.cast("string"))
    return g.select("doc", F.lit(1).alias("page"), "idx", text.alias("text"), ((s * 5) % 40).cast("double").alias("x"), ((s * 7 + F.col("idx") * 3) % 23).cast("double").alias("y"), F.lit(4.0).alias("w"), (s % 14 + 2).cast("double").alias("h"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page with their type and the box of the block with the same text."""
    found = layout.blocks(layout.lined(_scattered(spark, sf_dir)))
    rows = layout.located(found.select("doc", "page", "band", "block_type", "text"), found)
    return rows.select("doc", long("band").alias("band"), "text", "block_type", "x0", "y1")


def column_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _scattered(spark, sf_dir).withColumn("s", F.regexp_extract("text", "([0-9]+)", 1).cast("long"))
    pair = F.array(F.struct(F.lit(0).alias("cell"), (F.col("s") % 30).cast("double").alias("x0")), F.struct(F.lit(1).alias("cell"), (F.col("s") * 3 % 50 + 20).cast("double").alias("x0")))
    cells = g.select("doc", "page", F.lit(0).alias("table"), F.col("idx").alias("band"), F.explode(pair).alias("c")).select("doc", "page", "table", "band", "c.*")
    out = layout.anchored(cells)
    return out.select("doc", long("band").alias("band"), long("cell").alias("cell"), long("col").alias("col"))


def _page(rows: list[list[tuple[float, str]]]) -> str:
    """SQL for an array of fragments: rows of (x, text expression) from the top; a null text is left out."""
    at = [f"named_struct('idx', {i * 10 + j}, 'text', string({t}), 'x', double({x}), 'y', double({700 - 10 * i}), 'w', double(3 * length(string({t}))), 'h', 8.0d)" for i, row in enumerate(rows) for j, (x, t) in enumerate(row)]
    return f"filter(array({', '.join(at)}), f -> f.text is not null)"


def _pages(df: DataFrame, key: str, choices: list[tuple[str, list]]) -> DataFrame:
    """Fragments (doc, page, ...) of each row's page, laid out by the first condition that holds."""
    items = F.expr("case " + " ".join(f"when {c} then {_page(rows)}" for c, rows in choices) + " end")
    return df.select(F.col(key).alias("doc"), F.lit(1).alias("page"), F.explode(items).alias("f")).select("doc", "page", "f.*")


VALUE = "case p_size % 6 when 0 then '' || p_size when 1 then '<' || p_size when 2 then p_size || ',5' when 3 then 'n/a' when 4 then '≥ ' || p_size else p_size || '-' || (p_size + 1) end"
UNIT = "case p_partkey % 4 when 0 then 'mm' when 1 then '°C' when 2 then 'units' else 'rpm' end"


def page_specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications of one page a part: headed with one or two numbers, without a header, in lines, and under a part number's header."""
    v, u = f"({VALUE})", f"({UNIT})"
    choices = [
        ("p_partkey % 5 = 0", [[(0, "'Parameter'"), (200, "'Min'"), (300, "'Unit'")], [(0, "p_name"), (203, v), (300, u)], [(2, "'depth'"), (197, "'' || p_size"), (300, "'mm'")]]),
        ("p_partkey % 5 = 1", [[(0, "p_name"), (200, v), (300, u)], [(0, "p_brand"), (200, "'' || p_partkey"), (300, v)]]),
        ("p_partkey % 5 = 2", [[(0, "'Item'"), (200, "'Min.'"), (250, "'typical'"), (300, "'MAX'"), (350, "'units'")], [(0, "p_name"), (250, v), (300, "case when p_size % 4 = 0 then '' || p_size end"), (350, u)], [(0, "'span'"), (300, "'7'")]]),
        ("p_partkey % 5 = 3", [[(0, f"p_name || ': ' || {v} || ' ' || {u}")], [(0, f"p_name || ' ' || {v} || ' ' || {u}")], [(0, f"'Rated ' || p_name || ' ' || {v} || {u}")]]),
        ("true", [[(0, "'Part number'"), (200, "'Colour'")], [(0, "p_brand || '-' || p_partkey"), (200, "'red'")], [(0, "p_name"), (200, v)]]),
    ]
    return layout.structured_specs(_pages(dealt(table(spark, sf_dir, "part"), "p_partkey"), "p_partkey", choices)).select(F.col("doc").alias("part_id"), "source", "attribute", "value")


def selection_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order's selection table with the options they choose, and the specifications they share."""
    code = lambda n: f"element_at(s, {n})"
    model = lambda n: f"case when size(s) >= {n} then case when {code(n)} % 9 = 4 then 'see note' else 'SKU-' || {code(n)} end end"
    pick = lambda n, x: (x, f"case when size(s) >= {n} then case {code(n)} % 4 when 0 then '—' when 1 then 'o' when 2 then 'x' || {code(n)} else ' ' end end")
    head = [[(0, "'Modelo'")], [(60, "'Rc3/8'"), (120, "'Rc1/2'"), (180, "case when doc % 3 = 0 then 'M5' end")]]
    rows = [[(0, model(n)), pick(n, 60 + 7 * (n - 2)), pick(n, 145)] for n in (1, 2, 3)]
    tail = [[(0, "case when doc % 5 > 0 then 'Especificaciones' end")], [(0, "'Fluido'"), (80, "'Aire'"), (140, "'' || doc")], [(0, "'solo'")], [(0, "case when doc % 4 = 0 then 'Forma de pedido' end")], [(0, "'Rosca'"), (80, "'G1'")]]
    late = [[(0, "'Modelo'")], [(60, "'a long heading'")]]
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_suppkey")
    docs = dealt(lines, "doc").groupBy("doc").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    pages = _pages(docs, "doc", [("doc % 7 = 0", late), ("doc % 2 = 0", [*late, *head, *rows, *tail]), ("true", [*head, *rows, *tail])])
    return layout.sku_tables(geometry.banded(pages)).withColumnRenamed("doc", "order_id")


def grid_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one column of a part's grid that holds the two known numbers, between the rows that carry its labels."""
    shift = "(p_size % 3) * 0.5"
    rows = [
        [(0, "'note'"), (10, "'1'")],
        [(0, "case when p_partkey % 17 > 0 then 'bo re' end"), (30, "'Ø' || (p_size % 4)"), (f"60 + {shift}", "(p_size % 5) || ' mm'"), (90, "'' || (p_size % 3)")],
        [(0, "'gap'"), (31, "'1'")],
        [(0, "'mass'"), (30, "'' || (p_partkey % 3)"), (60, "'' || (p_partkey % 4)"), (f"90 - {shift}", "'' || (p_partkey % 2)")],
        [(0, "'end'")],
    ]
    pages = _pages(table(spark, sf_dir, "part"), "p_partkey", [("true", rows)])
    docs = pages.select("doc", "page").distinct()
    inside = layout.region(pages, docs.withColumns({"first": F.lit("bore"), "last": F.lit("mass")}))
    anchors = docs.withColumn("a", F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(x).alias("label"), F.lit("1").alias("expected")) for i, x in enumerate(("bore", "mass")))))).select("doc", "page", "a.*")
    grid = layout.gridded(geometry.banded(inside))
    out = layout.calibrated(grid, anchors.join(inside.select("doc", "page").distinct().hint("merge"), ["doc", "page"]))
    return out.select(F.col("doc").alias("part_id"), "state", long("col").alias("col"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (page_lines, column_anchors, page_specifications, selection_parts, grid_calibration)}


def _safe(a: str, v: str) -> str:
    """Whether a pair is kept: the patterns are the extractor's, in RE2's dialect."""
    return f"{a} <> '' and {v} <> '' and length({a}) <= 100 and length({v}) <= 200 and not regexp_matches({a} || ' ' || {v}, '{extract.UNSAFE}') and lower({v}) not in ({', '.join(repr(x) for x in extract.NOTHING)})"


def _line_rule() -> str:
    """attribute and value of `line` by the two rules for lines."""
    colon, bare = layout.COLON, layout.NO_COLON
    after = layout.UNIT_AFTER.replace("(?iu)", "(?i)").replace("(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])")
    is_colon = f"regexp_matches(line, '{colon}') and regexp_matches(regexp_extract(line, '{colon}', 2), '[0-9]')"
    is_bare = f"regexp_matches(line, '{bare}') and regexp_matches(regexp_replace(regexp_extract(line, '{bare}', 2), '{layout.SIGNED}', ''), '{after}')"
    pair = lambda i: f"case when {is_colon} then regexp_extract(line, '{colon}', {i}) when {is_bare} then regexp_extract(line, '{bare}', {i}) end"
    return f"trim({pair(1)}) as attribute, trim({pair(2)}) as value"


def oracle_sql() -> dict[str, str]:
    recursive = SCATTERED.replace("with ", "with recursive ", 1)
    unit = layout.UNIT_CELL.replace("(?iu)", "(?i)")
    scalar = lambda c: f"regexp_matches({c}, '{layout.SCALAR}')"
    return {
        "page_lines": f"""{recursive}, k as (select *, row_number() over (partition by doc order by y desc, x, idx) as k from f),
r(doc, k, ys, ids) as (
  select distinct doc, 0::bigint, []::double[], []::integer[] from f
  union all
  select doc, k, case when near > 0 then ys else list_append(ys, y) end, list_append(ids, case when near > 0 then near else len(ys) + 1 end::integer)
  from (select r.doc, k.k, r.ys, r.ids, k.y, coalesce(list_position(list_transform(r.ys, lambda v: abs(v - k.y) <= 3), true), 0) as near from r join k on k.doc = r.doc and k.k = r.k + 1) z),
ends as (select doc, arg_max(ys, k) as ys, arg_max(ids, k) as ids from r group by doc),
lines as (select k.doc, k.idx, k.x, k.y, k.h, k.text, len(list_filter(e.ys, lambda v: v > e.ys[e.ids[k.k]])) as band from k join ends e on e.doc = k.doc),
b as (select doc, band, string_agg(text, ' ' order by x, idx) as text, max(h) as h, min(x) as x0, max(y) as y1 from lines group by 1, 2),
t as (select *, length(regexp_replace(text, '[^A-Z]', '', 'g')) as caps, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters from b)
select doc, band, text, case when length(text) <= 100 and (caps > 0.8 * letters or h >= 14) then 'heading_or_label' else 'text' end as block_type,
  last_value(x0) over same as x0, last_value(y1) over same as y1 from t window same as (partition by doc, text order by band rows between unbounded preceding and unbounded following)""",
        "column_anchors": f"""{recursive}, c as (select doc, idx as band, 0 as cell, (s % 30)::double as x from f union all select doc, idx, 1, (s * 3 % 50 + 20)::double from f),
k as (select *, row_number() over (partition by doc order by band, cell) as k from c),
r(doc, k, anchors, ids) as (
  select distinct doc, 0::bigint, []::struct(x double, n integer)[], []::integer[] from c
  union all
  select doc, k, case when near > 0 then list_transform(anchors, lambda a, i: case when i = near then struct_pack(x := (a.x * a.n + x) / (a.n + 1), n := (a.n + 1)::integer) else a end) else list_append(anchors, struct_pack(x := x, n := 1::integer)) end,
    list_append(ids, case when near > 0 then near else len(anchors) + 1 end::integer)
  from (select r.doc, k.k, r.anchors, r.ids, k.x, coalesce(list_position(list_transform(r.anchors, lambda a: abs(a.x - k.x) <= 12), true), 0) as near from r join k on k.doc = r.doc and k.k = r.k + 1) z),
ends as (select doc, arg_max(anchors, k) as anchors, arg_max(ids, k) as ids from r group by doc)
select k.doc, band, cell::bigint as cell, len(list_filter(list_transform(e.anchors, lambda a, i: struct_pack(x := a.x, i := i)), lambda a: a.x < e.anchors[e.ids[k.k]].x or (a.x = e.anchors[e.ids[k.k]].x and a.i < e.ids[k.k])))::bigint as col
from k join ends e on e.doc = k.doc""",
        "page_specifications": f"""with p as (select *, {VALUE} as v, {UNIT} as u, p_partkey % 5 as kind, '' || p_size as size, p_size % 4 = 0 as doubled from part),
rows as (
  select p_partkey, p_name as attribute, v || ' ' || u as value from p where kind = 0 union all select p_partkey, 'depth', size || ' mm' from p where kind = 0
  union all select p_partkey, p_name, case when regexp_matches(u, '{unit}') then v || ' ' || u else v end from p where kind = 1 and {scalar('v')} and not {scalar('u')}
  union all select p_partkey, p_brand, p_partkey::varchar from p where kind = 1 and not {scalar('v')}
  union all select p_partkey, p_name, v || ' ' || u from p where kind = 2 and not doubled
  union all select p_partkey, 'span', '7' from p where kind = 2
  union all select p_partkey, p_name, v from p where kind = 4 and {scalar('v')}),
lines as (
  select p_partkey, unnest(case kind when 0 then [p_name || ' ' || v || ' ' || u, 'depth ' || size || ' mm'] when 1 then [p_name || ' ' || v || ' ' || u, p_brand || ' ' || p_partkey || ' ' || v]
    when 2 then [concat_ws(' ', p_name, v, case when doubled then size end, u), 'span 7'] when 3 then [p_name || ': ' || v || ' ' || u, p_name || ' ' || v || ' ' || u, 'Rated ' || p_name || ' ' || v || u] else [p_brand || '-' || p_partkey || ' red', p_name || ' ' || v] end) as line from p),
found as (
  select p_partkey, 'table' as source, null as line, attribute, value from rows where regexp_matches(value, '[0-9]')
  union all select * from (select p_partkey, 'line', line, {_line_rule()} from lines) where attribute is not null)
select p_partkey as part_id, source, attribute, value from (select distinct * from found) where {_safe('attribute', 'value')}""",
        "selection_parts": """with o as (select l_orderkey as doc, list_sort(list(distinct l_suppkey)) as s from lineitem group by 1),
n as (select doc, s, unnest(generate_series(1, least(3, len(s)))) as n from o where doc % 7 <> 0),
m as (select *, s[n] as code, bool_or(s[n] % 9 = 4) over (partition by doc order by n) as ended from n),
parts as (select * from m where not ended),
cells as (select doc, code, 60 + 7 * (n - 2) as x, 1 as place, code % 4 as k from parts union all select doc, code, 145, 2, code % 4 from parts),
heads as (select doc, h.x as hx, h.t from o, (values (60, 'Rc3/8'), (120, 'Rc1/2'), (180, 'M5')) h(x, t) where t <> 'M5' or doc % 3 = 0),
near as (select c.*, arg_min(t, abs(hx - x) * 1000 + hx) as t from cells c join heads h on h.doc = c.doc where k in (1, 2) group by all),
own as (select doc, code, t, arg_max(case k when 1 then 'o' else 'x' || code end, place) as v from near group by 1, 2, 3),
shared as (select doc, 'Fluido' as a, 'Aire ' || doc as v from o where doc % 5 > 0 union all select doc, 'Rosca', 'G1' from o where doc % 5 > 0 and doc % 4 > 0)
select doc as order_id, 'SKU-' || code as part_number, t as attribute, v as value, false as shared from own
union all select p.doc, 'SKU-' || code, a, v, true from parts p join shared using (doc)""",
        "grid_calibration": """with c as (select p_partkey as part_id, list_filter([1, 2, 3], lambda i: [p_size % 4, p_size % 5, p_size % 3][i] = 1) as b, list_filter([1, 2, 3], lambda i: [p_partkey % 3, p_partkey % 4, p_partkey % 2][i] = 1) as m from part where p_partkey % 17 > 0),
d as (select part_id, b, m, list_filter(b, lambda i: list_contains(m, i)) as i from c)
select part_id, case when len(b) = 0 or len(m) = 0 then 'missing value' when len(i) = 1 then 'ok' when len(i) > 1 then 'ambiguous' else 'empty' end as state, case when len(b) > 0 and len(m) > 0 and len(i) = 1 then i[1] end::bigint as col from d""",
    }

"""Lines, columns, header roles and rows of specifications on pages of fragments (doc, page, idx, text, x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .extract import safe_pair
from .geometry import cells, on_pages, spread, tables

#: A line takes fragments this near, a column those this near to its mean, a grid's column these.
LINE, COLUMN, GRID = 3.0, 12.0, 2.0
#: Headings are this short and in capitals to this share or this high.
HEADING_LENGTH, CAPITALS, HEADING_HEIGHT = 100, 0.8, 14.0
#: Roles of header cells by their text; the first that holds counts.
ROLES = (
    ("PART_NUMBER", r"(?i)^(?:part(?:[ ]+number|[ ]+no\.?|[ ]+#)|p/n|pn|mpn|order(?:ing|able)?[ ]+(?:part[ ]+number|number|no\.?|code)|model[ ]+(?:number|no\.?)|product[ ]+number)$"),
    ("PART_MARKING", r"(?i)^(?:part[ ]+marking|marking)$"),
    ("PARAMETER", r"(?i)^(?:parameter|param|spec(?:ification)?|characteristic|item)$"),
    ("TEST_CONDITION", r"(?i)^(?:test[ ]+conditions?|conditions?|test)$"),
    ("MIN", r"(?i)^min(?:imum)?$"),
    ("TYP", r"(?i)^(?:typ|typical)$"),
    ("MAX", r"(?i)^max(?:imum)?$"),
    ("UNIT", r"(?i)^(?:unit|units)$"),
    ("PACKAGE", r"(?i)^package(?:[ ]+type)?$"),
    ("DESCRIPTION", r"(?i)^(?:description|feature|features)$"),
)
#: Units of a cell, a bare number, and units behind a number where no colon stands.
UNIT_CELL = (
    r"(?iu)^(?:%|°?c|°?f|v|mv|kv|a|ma|ua|μa|µa|hz|khz|mhz|ghz|ohm|ω|kohm|mohm|f|uf|μf|µf|nf|pf|h|uh|μh|µh|mh|w|mw|kw|mm|cm|m|um|μm|µm|nm|in|mil|kg|g|mg|lb|n|kn|l|ml|bar|kpa|mpa|psi|rpm|ms|us|μs|µs|ns|s|db|dbm|deg|degree|x)$"
)
SCALAR = r"^[<>≤≥+\-±]?\s*[0-9]+(?:[.,][0-9]+)?$"
UNIT_AFTER = r"(?iu)^(?:%|°?[cf]|mm|cm|km|kn|n|kg|mg|g|kw|mw|w|kv|mv|v|ma|ua|μa|µa|a|khz|mhz|hz|rpm|r/min|kpa|mpa|bar|psi|nm|dm[23²³]?|mm[23²³]?|ms|us|μs|µs|s|db|dbm)(?![A-Za-z0-9_])"
COLON = r"^(.{2,80}?)\s*[:：]\s*([^:]{1,80})$"
NO_COLON = r"^([A-Za-z][A-Za-z0-9À-ÿ()/,.\-\s]{1,60}?)\s+([<>≤≥+\-±]?[0-9]+(?:[.,][0-9]+)?\s*[^\s]*)$"
SIGNED = r"^[<>≤≥+\-±]?\s*[0-9]+(?:[.,][0-9]+)?\s*"
#: The words of a selection table's sections.
MODELS, SHARED, SECTION_END = "Modelo", "Especificaciones", r"(?i)^(Dise[nñ]o\s*/\s*Dimensiones|Lista de componentes|Forma de pedido)$"
SKU = r"^[A-Z][A-Z0-9-]{3,}$"


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _first_near(places: Column, at: Column, tolerance: Column) -> Column:
    """From 1: the first of the places that is near; 0 if none is."""
    return F.array_position(F.transform(places, lambda p: F.abs(p - at) <= tolerance), True).cast("int")


def lined(fragments: DataFrame, tolerance: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """fragments that aren't blank with `band`, their line from the top: each goes into the first line there is whose own first fragment
    is at most `tolerance` away in y, else it begins one.

    The order decides which fragment is a line's first: from the top and then from the left, or as given. tolerance may depend on the fragment's h.
    """
    rows = fragments.withColumn("text", clean(F.col("text"))).filter("text <> ''").withColumn("_near", (F.lit(LINE) if tolerance is None else tolerance).cast("double")).withColumn("y", F.col("y").cast("double"))

    def step(s: Column, x: Column) -> Column:
        hit = _first_near(s["ys"], x["y"], x["_near"])
        return F.struct(F.when(hit > 0, s["ys"]).otherwise(F.array_append(s["ys"], x["y"])).alias("ys"), F.array_append(s["of"], F.when(hit > 0, hit).otherwise(F.size(s["ys"]) + 1)).alias("of"))

    start = F.struct(F.array().cast("array<double>").alias("ys"), F.array().cast("array<int>").alias("of"))
    pages = on_pages(rows, order or ["-y", "x", "idx"]).withColumn("_s", F.aggregate("items", start, step))
    # lines from the top, those of one height as they were begun
    ranks = F.transform(F.array_sort(F.transform("_s.ys", lambda y, i: F.struct((-y).alias("y"), i.alias("i")))), lambda p: p["i"])
    pages = pages.withColumn("_of", F.transform("_s.of", lambda n: (F.array_position(ranks, n - 1) - 1).cast("int")))
    return spread(pages, F.col("_of"), "band").drop("_near")


def blocks(lines: DataFrame) -> DataFrame:
    """doc, page, band, text, block_type and box of each line. A short line in capitals, or a high one, is a heading or label."""
    items = F.array_sort(F.collect_list(F.struct("x", "idx", "text")))
    out = lines.groupBy("doc", "page", "band").agg(
        clean(F.array_join(F.transform(items, lambda s: s["text"]), " ")).alias("text"), F.max("h").alias("_h"), F.min("x").alias("x0"), F.min(F.col("y") - F.col("h")).alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max("y").alias("y1"),
    )
    letters, capitals = (F.length(F.regexp_replace("text", p, "")) for p in ("[^A-Za-z]", "[^A-Z]"))
    ratio = F.when(letters > 0, capitals / letters).otherwise(0.0)
    heading = (F.length("text") <= HEADING_LENGTH) & ((ratio > CAPITALS) | (F.col("_h") >= HEADING_HEIGHT))
    return out.withColumn("block_type", F.when(heading, "heading_or_label").otherwise("text")).drop("_h")


def located(rows: DataFrame, page_blocks: DataFrame) -> DataFrame:
    """rows (doc, page, text, ...) with the box of the block with that text on that page; of several the last one, null if there is none."""
    last = page_blocks.groupBy("doc", "page", "text").agg(F.max_by(F.struct("x0", "y0", "x1", "y1"), "band").alias("_box"))
    return rows.join(last, ["doc", "page", "text"], "left").select(*rows.columns, "_box.*")


def anchored(table_cells: DataFrame, within: float = COLUMN) -> DataFrame:
    """cells of tables (doc, page, table, band, cell, x0, ...) with `col`: a cell belongs to the first anchor within reach of its left edge,
    which moves to the mean of its cells; columns are the anchors from left to right. Cells come row by row; a table is a group."""
    rest = [c for c in table_cells.columns if c not in ("doc", "page", "table")]
    grouped = table_cells.groupBy("doc", "page", "table").agg(F.array_sort(F.collect_list(F.struct("band", "cell", F.struct(*rest).alias("item")))).alias("items"))

    def step(s: Column, item: Column) -> Column:
        x, anchors = item["item"]["x0"], s["anchors"]
        hit = _first_near(F.transform(anchors, lambda a: a["x"]), x, F.lit(within))
        moved = F.transform(anchors, lambda a, i: F.when(i == hit - 1, F.struct(((a["x"] * a["n"] + x) / (a["n"] + 1)).alias("x"), (a["n"] + 1).alias("n"))).otherwise(a))
        grown = F.array_append(anchors, F.struct(x.alias("x"), F.lit(1).alias("n")))
        return F.struct(F.when(hit > 0, moved).otherwise(grown).alias("anchors"), F.array_append(s["of"], F.when(hit > 0, hit).otherwise(F.size(anchors) + 1)).alias("of"))

    start = F.struct(F.array().cast("array<struct<x: double, n: int>>").alias("anchors"), F.array().cast("array<int>").alias("of"))
    folded = grouped.withColumn("_s", F.aggregate("items", start, step))
    ranks = F.transform(F.array_sort(F.transform("_s.anchors", lambda a, i: F.struct(a["x"].alias("x"), i.alias("i")))), lambda p: p["i"])
    both = F.transform("items", lambda x, i: F.struct(x["item"].alias("item"), (F.array_position(ranks, F.get("_s.of", i) - 1) - 1).cast("int").alias("col")))
    return folded.select("doc", "page", "table", F.explode(both).alias("_x")).select("doc", "page", "table", "_x.item.*", "_x.col")


def role_of(c: Column) -> Column:
    return F.coalesce(*(F.when(clean(c).rlike(p), F.lit(r)) for r, p in ROLES), F.lit(""))


def headed(columned: DataFrame) -> DataFrame:
    """cells with `header`, the role of their column, `is_header` and `row_no`.

    The header is the first of a table's first three rows with two roles or more, or with a part number's. Where two of its cells are in a
    column the right one names it.
    """
    table = ["doc", "page", "table"]
    rows = columned.withColumn("_role", role_of(F.col("text"))).withColumn("row_no", F.dense_rank().over(Window.partitionBy(*table).orderBy("band")) - 1)
    in_row, in_table, in_column = (Window.partitionBy(*table, *more) for more in (["row_no"], [], ["col"]))
    names = (F.count_if(F.col("_role") != "").over(in_row) >= 2) | F.bool_or(F.col("_role") == "PART_NUMBER").over(in_row)
    rows = rows.withColumn("_names", names).withColumn("_header", F.min(F.when((F.col("row_no") < 3) & F.col("_names"), F.col("row_no"))).over(in_table))
    rows = rows.withColumn("is_header", F.coalesce(F.col("row_no") == F.col("_header"), F.lit(False)))
    rows = rows.withColumn("header", F.coalesce(F.max_by("_role", F.when(F.col("is_header"), F.col("cell"))).over(in_column), F.lit("")))
    return rows.select(*table, "col", *(c for c in columned.columns if c not in (*table, "col")), "row_no", "is_header", "header")


def spec_rows(headed_cells: DataFrame) -> DataFrame:
    """doc, page, table, row_no, attribute, value, ambiguous, n_columns of the rows below or without a header.

    The attribute is the PARAMETER cell, or the first. The value is the one MIN, TYP or MAX cell, or where none is headed so the one bare
    number in a column without a role, followed by its unit. Several numbers are never put together: the row is ambiguous and has no value.
    """
    cell = F.struct("cell", "text", "header", "is_header")
    rows = headed_cells.groupBy("doc", "page", "table", "row_no").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    rows = rows.filter((F.size("cells") >= 2) & ~F.get("cells", F.lit(0))["is_header"])
    attribute = F.coalesce(F.get(F.filter("cells", lambda c: c["header"] == "PARAMETER"), F.lit(0)), F.get("cells", F.lit(0)))
    rows = rows.withColumn("_a", attribute).withColumn("_v", F.filter("cells", lambda c: c["cell"] != F.col("_a.cell")))
    unit = F.get(F.filter("_v", lambda c: (c["header"] == "UNIT") | c["text"].rlike(UNIT_CELL)), F.lit(0))["text"]
    scalars = F.filter("_v", lambda c: c["header"].isin("MIN", "TYP", "MAX"))
    bare = F.filter("_v", lambda c: (c["header"] == "") & c["text"].rlike(SCALAR))
    chosen = F.when(F.size(scalars) > 0, scalars).otherwise(bare)
    one = F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0))["text"])
    value = F.when(one.isNull() | (one == ""), F.lit("")).when(F.coalesce(unit, F.lit("")) != "", F.concat_ws(" ", one, unit)).otherwise(one)
    return rows.select("doc", "page", "table", "row_no", clean(F.col("_a.text")).alias("attribute"), value.alias("value"), (F.size(chosen) != 1).alias("ambiguous"), F.size("cells").alias("n_columns"))


def structured_specs(fragments: DataFrame) -> DataFrame:
    """doc, page, source, place, attribute, value: the specifications on pages of fragments, from table rows and from lines.

    Table rows count if their one value has a digit; lines as 'label: value' with a digit in the value, or as 'label 25 mm' with a known unit.
    Unsafe pairs go, and of equal pairs at one place all but one.
    """
    lines = lined(fragments)
    in_tables = tables(cells(lines))
    rows = spec_rows(headed(anchored(in_tables))).filter(~F.col("ambiguous") & F.col("value").rlike("[0-9]"))
    rows = rows.select("doc", "page", F.lit("table").alias("source"), F.concat_ws("/", F.col("table").cast("string"), F.col("row_no").cast("string")).alias("place"), "attribute", "value")
    group = lambda pattern, i: F.regexp_extract("text", pattern, i)
    colon = F.col("text").rlike(COLON) & group(COLON, 2).rlike("[0-9]")
    bare = F.col("text").rlike(NO_COLON) & F.regexp_replace(group(NO_COLON, 2), SIGNED, "").rlike(UNIT_AFTER)
    pair = lambda i: F.when(colon, group(COLON, i)).when(bare, group(NO_COLON, i))
    text_rows = blocks(lines).select("doc", "page", F.lit("line").alias("source"), F.col("band").cast("string").alias("place"), trimmed(pair(1)).alias("attribute"), trimmed(pair(2)).alias("value"))
    both = rows.unionByName(text_rows.filter("attribute <> ''"))
    return both.filter(safe_pair(F.col("attribute"), F.col("value"))).distinct()


def gridded(bands: DataFrame, within: float = GRID) -> DataFrame:
    """fragments in bands with `col`: columns begin from left to right, each new x within reach moves a column halfway to it; a fragment
    belongs to the nearest column, the left one of two."""
    def step(cs: Column, x: Column) -> Column:
        hit = _first_near(cs, x, F.lit(within))
        return F.when(hit > 0, F.transform(cs, lambda c, i: F.when(i == hit - 1, (c + x) / 2).otherwise(c))).otherwise(F.array_append(cs, x))

    xs = bands.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.col("x").cast("double"))).alias("_xs"))
    centres = xs.select("doc", "page", F.array_sort(F.aggregate("_xs", F.array().cast("array<double>"), step)).alias("_cs"))
    nearest = F.array_min(F.transform("_cs", lambda c, i: F.struct(F.abs(c - F.col("x")).alias("d"), i.alias("i"))))["i"]
    return bands.join(centres.hint("merge"), ["doc", "page"]).withColumn("col", nearest).drop("_cs")


def region(fragments: DataFrame, labels: DataFrame) -> DataFrame:
    """The fragments between two rows: from the lowest to the highest that carries the first or the last label (doc, page, first, last), one
    unit around. Pages where less than two fragments carry one have no region."""
    bare = F.regexp_replace("text", r"(?U)\s+", "")
    marked = fragments.join(labels.hint("merge"), ["doc", "page"]).filter(bare.isin(F.col("first"), F.col("last")))
    ends = marked.groupBy("doc", "page").agg(F.min("y").alias("_low"), F.max("y").alias("_high"), F.count("*").alias("_n")).filter("_n >= 2")
    return fragments.join(ends.hint("merge"), ["doc", "page"]).filter((F.col("y") >= F.col("_low") - 1) & (F.col("y") <= F.col("_high") + 1)).select(*fragments.columns)


def calibrated(grid: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc, page, state, col: the one column that holds, for every anchor (doc, page, ord, label, expected), the expected number in the first row with the label.

    state is ok, or of the first anchor that fails: missing label, missing value; ambiguous or empty if not one column is in all.
    """
    bare = F.regexp_replace("text", r"(?U)\s+", "")
    page = ["doc", "page"]
    rows = grid.withColumn("_bare", bare).join(anchors.hint("merge"), page).filter(F.col("_bare") == F.col("label")).groupBy(*page, "ord").agg(F.min("band").alias("band"))
    held = grid.withColumn("_number", F.regexp_replace("text", r"[^0-9.]", "")).join(rows.hint("merge"), [*page, "band"]).join(anchors.hint("merge"), [*page, "ord"]).filter(F.col("_number") == F.col("expected"))
    per = anchors.join(rows.withColumn("_row", F.lit(True)).hint("merge"), [*page, "ord"], "left").join(held.groupBy(*page, "ord").agg(F.collect_set("col").alias("_cols")).hint("merge"), [*page, "ord"], "left")
    why = F.when(F.col("_row").isNull(), "missing label").when(F.col("_cols").isNull(), "missing value")
    all_of = per.groupBy(*page).agg(F.min_by(why, F.when(why.isNotNull(), F.col("ord"))).alias("_why"), F.array_sort(F.collect_list(F.struct("ord", F.col("_cols").alias("cols")))).alias("_all"))
    common = F.aggregate(F.slice("_all", 2, 1_000_000), F.get("_all", F.lit(0))["cols"], lambda s, a: F.array_intersect(s, a["cols"]))
    out = all_of.withColumn("_common", F.when(F.col("_why").isNull(), common))
    state = F.coalesce("_why", F.when(F.size("_common") == 1, "ok").when(F.size("_common") > 1, "ambiguous").otherwise("empty"))
    return out.select(*page, state.alias("state"), F.when(F.size("_common") == 1, F.get("_common", F.lit(0))).alias("col"))


def sku_tables(bands: DataFrame) -> DataFrame:
    """doc, part_number, attribute, value, shared: a selection table's parts with the options they choose, and the specifications all share.

    bands: fragments with `band` from the top. The table is headed by a band that reads MODELS and is followed by short option codes; parts follow
    until a band begins with none. A part's cell belongs to the option nearest in x, the left one of two; dashes choose nothing. The shared block
    begins below the band that reads SHARED, on the first page that has one, else on the models' page, and ends at a lone title of another section.
    """
    cell = F.struct("x", "idx", trimmed(F.col("text")).alias("text"))
    rows = bands.groupBy("doc", "page", "band").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    rows = rows.withColumn("full", F.filter("cells", lambda c: c["text"] != "")).withColumn("title", F.array_join(F.transform("cells", lambda c: c["text"]), ""))
    in_doc, on_page = Window.partitionBy("doc"), Window.partitionBy("doc", "page").orderBy("band")
    so_far = on_page.rowsBetween(Window.unboundedPreceding, 0)
    # one pass over a document's bands in order: the windows share one sort, and no band is made twice
    rows = rows.withColumn("_next", F.lead("full").over(on_page))
    first_page = lambda word: F.min(F.when(F.col("title") == word, F.col("page"))).over(in_doc)
    here = rows.withColumns({"_models": first_page(MODELS), "_shared": first_page(SHARED)}).filter("_models is not null and doc is not null")
    here = here.withColumns({"_model": F.col("page") == F.col("_models"), "_block": F.col("page") == F.coalesce("_shared", "_models")})
    short = (F.size("_next") > 0) & F.forall("_next", lambda c: (F.length(c["text"]) <= 12) & ~c["text"].rlike(r"(?U)\s"))
    head = F.when(F.col("_model") & (F.col("title") == MODELS) & F.coalesce(short, F.lit(False)), F.col("band"))
    start = F.when(F.col("_block") & (F.col("title") == SHARED), F.col("band"))
    here = here.withColumns({"_head": F.min(head).over(in_doc), "options": F.min_by("_next", head).over(in_doc), "_start": F.min(start).over(in_doc)})
    here = here.withColumns({"part_number": F.get("cells", F.lit(0))["text"], "_below": F.coalesce(F.col("_model") & (F.col("band") > F.col("_head")), F.lit(False)), "_block": F.coalesce(F.col("_block") & (F.col("band") > F.col("_start")), F.lit(False))})
    here = here.withColumn("_i", F.sum(F.col("_below").cast("int")).over(so_far))
    ended = F.col("_below") & (F.col("_i") > 1) & ~F.col("part_number").rlike(SKU)
    over = F.col("_block") & (F.size("full") == 1) & F.get("full", F.lit(0))["text"].rlike(SECTION_END)
    here = here.withColumns({"_ended": F.sum(ended.cast("int")).over(so_far), "_over": F.sum(over.cast("int")).over(so_far)})
    part = F.when(F.col("_below") & (F.col("_i") > 1) & (F.col("_ended") == 0), F.struct("part_number", "options", "cells"))
    fact = F.struct(F.get("full", F.lit(0))["text"].alias("attribute"), F.array_join(F.transform(F.slice("full", 2, 1_000_000), lambda c: c["text"]), " ").alias("value"))
    fact = F.when(F.col("_block") & (F.col("_over") == 0) & (F.size("full") >= 2), fact)
    docs = here.select("doc", part.alias("_part"), fact.alias("_fact")).filter("_part is not null or _fact is not null").groupBy("doc").agg(F.collect_list("_part").alias("_parts"), F.collect_set("_fact").alias("_facts"))
    parts = docs.select("doc", "_facts", F.explode("_parts").alias("p"))
    cells = F.transform(F.slice("p.cells", 2, 1_000_000), lambda c, i: F.struct(i.alias("n"), c["x"].alias("x"), c["text"].alias("text")))
    near = lambda c: F.array_min(F.transform("p.options", lambda o, i: F.struct(F.abs(o["x"] - c["x"]).alias("d"), i.alias("i"), o["text"].alias("text"))))["text"]
    row = lambda attribute, value, n, shared: F.struct(attribute.alias("attribute"), value.alias("value"), n.alias("n"), F.lit(shared).alias("shared"))
    own = F.transform(F.filter(cells, lambda c: ~c["text"].isin("", "—", "-")), lambda c: row(near(c), c["text"], c["n"], False))
    every = F.concat(own, F.transform("_facts", lambda f: row(f["attribute"], f["value"], F.lit(0), True)))
    rows = parts.select("doc", "p.part_number", F.explode(every).alias("r")).select("doc", "part_number", "r.*")
    # an option's last cell counts; shared specifications differ by their value too
    kept = rows.groupBy("doc", "part_number", "attribute", "shared", F.when(F.col("shared"), F.col("value")).alias("_of")).agg(F.max_by("value", "n").alias("value"))
    return kept.select("doc", "part_number", "attribute", "value", "shared")

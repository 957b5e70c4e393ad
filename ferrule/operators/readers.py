"""Further readers of data sheets: value-first rows, next-line values, strided cells, catalogue pairs, triage, and the
choice of part numbers among candidates. Rows come as (id, line_no, line) from extract.lines unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier_signature, part_key, text
from .extract import TRAILING, UNITS, first_of, lines

NOISE = ("compare", "add to list", "add to my list", "share", "print", "download", "back", "next", "previous", "home", "menu", "search", "login", "sign in", "sign up")
#: How many next lines may hold a value, how far a type code may stand from its number, how many a document has.
REACH, CODE_REACH, MOST_PAIRS = 3, 4, 250
IDENTIFIER = r"(?<![A-Za-z0-9_])([A-Z0-9][A-Z0-9._/-]{2,29})(?![A-Za-z0-9_])"
#: Roles that keep a candidate from being a part number.
EXCLUDED_ROLES = ("ELECTRICAL_VALUE", "VOLTAGE_REFERENCE", "STANDARD_REFERENCE", "DOCUMENT_REFERENCE", "REVISION", "PACKAGE", "LITERATURE_NUMBER")


def quantity(c: Column) -> Column:
    """struct(value, unit): a number followed by a unit, before any other number; unit null without one."""
    pattern = r"([+-]?[0-9]+(?:[.,][0-9]+)?)\s*([A-Za-zµμΩω°%/²³]+)"
    value, bare = F.regexp_extract(text(c), pattern, 1), F.regexp_extract(text(c), r"([+-]?[0-9]+(?:[.,][0-9]+)?)", 1)
    found = F.when(value != "", value).when(bare != "", bare)
    return F.struct(F.replace(found, F.lit(","), F.lit(".")).try_cast("double").alias("value"), F.when(value != "", F.lower(F.regexp_extract(text(c), pattern, 2))).alias("unit"))


def value_first_pairs(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """attribute, value of '25mm Piston', 'M10x1.5 Rod' and 'G 1/8 Port'; the first of equal pairs."""
    flat, label = F.regexp_replace(text(F.col(text_col)), r"\s+", " "), r"\s+([A-ZÀ-Ý][a-zà-ÿ]+(?:\s+[a-zà-ÿ]+)?)"
    measure, metric, pipe = r"([0-9]+(?:[.,][0-9]+)?)\s*([a-zA-Z°µ%]{1,6})" + label, r"(?<![A-Za-z0-9_])(M[0-9]+(?:x[0-9]+(?:\.[0-9]+)?)?)()" + label, r"(?<![A-Za-z0-9_])(G\s*[0-9]+/[0-9]+)()" + label
    hits = F.array(*(F.regexp_extract_all(flat, F.lit(p), F.lit(0)) for p in (measure, metric, pipe)))
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(hits).alias("kind", "found")).select("id", "kind", F.posexplode("found").alias("n", "hit"))
    part = lambda i: F.coalesce(*(F.when(F.col("kind") == j, F.regexp_extract("hit", p, i)) for j, p in enumerate((measure, metric, pipe))))
    unit = F.lower(part(2))
    value = F.when(F.col("kind") == 0, F.concat_ws(" ", part(1), unit)).otherwise(F.regexp_replace(part(1), r"\s+", " "))
    out = rows.filter((F.col("kind") > 0) | unit.isin(*UNITS)).select("id", (F.shiftleft(F.col("kind").cast("long"), 32) + F.col("n")).alias("line_no"), F.trim(part(3)).alias("attribute"), value.alias("value"))
    out = out.filter(F.length("attribute").between(2, 50) & ~F.lower("attribute").isin(*TRAILING))
    return first_of(out, ["id", F.lower("attribute"), F.lower("value")], "line_no")


def spaced_pairs(rows: DataFrame) -> DataFrame:
    """attribute, value of 'label: value' lines, else of lines cut by two spaces or more."""
    colon, gap = r"^(.{2,120}?)\s*[:：]\s*(.{1,150})$", r"^([A-Za-z][A-Za-z0-9À-ÿ()/,.\-\s]{2,110}?)\s{2,}(.{1,150})$"
    pattern = lambda i: F.when(F.col("line").rlike(colon), F.regexp_extract("line", colon, i)).otherwise(F.regexp_extract("line", gap, i))
    hit = rows.filter((F.length("line") <= 260) & (F.col("line").rlike(colon) | F.col("line").rlike(gap)))
    return hit.select("id", "line_no", F.trim(pattern(1)).alias("attribute"), F.trim(pattern(2)).alias("value"))


def next_line_pairs(rows: DataFrame) -> DataFrame:
    """attribute, value of a label line and the first of the next three lines that isn't a button and holds a number."""
    noise = lambda c: F.lower(F.trim(c)).isin(*NOISE) | (F.length(F.trim(c)) <= 2)
    label = F.length("line").between(2, 120) & ~noise("line") & F.col("line").rlike("[A-Za-zÀ-ÿ]") & ~F.col("line").rlike(r"^[0-9+\-.,%\s]+$")
    in_doc = Window.partitionBy("id").orderBy("line_no")
    ahead = [F.lead("line", i).over(in_doc) for i in range(1, REACH + 1)]
    # a line that is too long ends the search
    seen, value = F.lit(True), F.lit(None).cast("string")
    for a in ahead:
        usable = a.isNotNull() & ~noise(a)
        value = F.coalesce(value, F.when(seen & usable & (F.length(a) <= 180) & a.rlike("[0-9]"), a))
        seen = seen & ~F.coalesce(usable & (F.length(a) > 180), F.lit(False))
    out = rows.withColumn("value", value).filter(label & F.col("value").isNotNull())
    return out.select("id", "line_no", F.col("line").alias("attribute"), "value")


def strided(rows: DataFrame, size: int = 4) -> DataFrame:
    """rows (id, row_no, cells) as groups of `size` cells: id, row_no, group, cells; a rest that is shorter goes."""
    at = F.sequence(F.lit(0), F.floor(F.size("cells") / size).cast("int") - 1)
    groups = F.when(F.size("cells") >= size, F.transform(at, lambda i: F.slice("cells", i * size + 1, size)))
    return rows.select("id", "row_no", F.posexplode(groups).alias("group", "cells"))


def catalogue_pairs(rows: DataFrame, prefix: str) -> DataFrame:
    """part_number, type_code: a line of 4 to 10 digits and a code with the prefix in the next four lines, before the
    next such number; distinct, and 250 of a document, as a catalogue page holds."""
    number = lambda c: c.rlike(r"^[0-9]{4,10}$")
    in_doc = Window.partitionBy("id").orderBy("line_no")
    open_, code = F.lit(True), F.lit(None).cast("string")
    for i in range(1, CODE_REACH + 1):
        a = F.lead("line", i).over(in_doc)
        open_ = open_ & ~F.coalesce(number(a), F.lit(False))
        code = F.coalesce(code, F.when(open_ & F.upper(a).startswith(f"{prefix.upper()}-"), F.upper(a)))
    out = rows.withColumn("type_code", code).filter(number(F.col("line")) & F.col("type_code").isNotNull())
    first = first_of(out.select("id", "line_no", F.col("line").alias("part_number"), "type_code"), ["id", "part_number", part_key(F.col("type_code"))], "line_no")
    return first.withColumn("_n", F.row_number().over(in_doc)).filter(F.col("_n") <= MOST_PAIRS).drop("_n")


def triage(pages: DataFrame, common: list[str], signal: str, ordering: str) -> DataFrame:
    """Per document (doc, page, text, has_model, has_specs) its kind: text_extraction_failed, configurator,
    simple_datasheet, possible_product_catalog or unclassified_review. Figures are summed per page first."""
    t = text(F.col("text"))
    tokens = F.filter(F.split(F.lower(t), "[^a-záéíóúñ]+"), lambda x: F.length(x).between(2, 12))
    per_page = pages.select(
        "doc", F.length(t).alias("chars"), F.regexp_count(t, F.lit("�|[\\x00-\\x08]")).alias("garbled"), F.size(tokens).alias("tokens"), F.aggregate(tokens, F.lit(0), lambda s, x: s + F.length(x)).alias("letters"),
        F.size(F.filter(tokens, lambda x: x.isin(*common))).alias("common"), F.regexp_count(t, F.lit(r"\S+")).alias("words"), F.regexp_count(t, F.lit(signal)).alias("signals"), t.rlike(ordering).alias("ordering"), "has_model", "has_specs",
    )
    d = per_page.groupBy("doc").agg(*(F.sum(c).alias(c) for c in ("chars", "garbled", "tokens", "letters", "common", "words", "signals")), F.count("*").alias("pages"), *(F.bool_or(c).alias(c) for c in ("ordering", "has_model", "has_specs")))
    ratio = lambda a, b, none: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(none))
    unreadable = (F.col("chars") >= 300) & ((ratio("letters", "chars", 1.0) < 0.35) | ((F.col("tokens") >= 30) & (ratio("common", "tokens", 1.0) < 0.02)))
    dense = (F.col("words") >= 30) & (ratio("signals", "words", 0.0) >= 0.015)
    kind = (
        F.when((F.col("chars") == 0) | (ratio("garbled", "chars", 0.0) > 0.03) | unreadable, "text_extraction_failed").when(F.col("ordering"), "configurator")
        .when((F.col("pages") <= 6) & F.col("has_model") & F.col("has_specs"), "simple_datasheet").when(dense, "possible_product_catalog").otherwise("unclassified_review")
    )
    return d.select("doc", kind.alias("kind"), "pages", "chars")


def candidates(pages: DataFrame, positive: list[str], negative: list[str], contextual: list[str]) -> DataFrame:
    """Identifier-like tokens of pages (doc, page, text): doc, page, line_no, token, format, label, label_type,
    same_line, exclusive, in_title, context (two lines on either side).

    A label counts on the token's own line, or as the only content of the line before; the own line, then the longest, wins.
    """
    rows = lines(pages.withColumn("_id", F.struct("doc", "page")), "_id").select("id.doc", "id.page", "line_no", "line")
    in_page = Window.partitionBy("doc", "page").orderBy("line_no")
    near = F.concat_ws(" ", *(F.lag("line", i).over(in_page) for i in (2, 1)), "line", *(F.lead("line", i).over(in_page) for i in (1, 2)))
    rows = rows.withColumn("before", F.lower(F.trim(F.regexp_replace(F.coalesce(F.lag("line").over(in_page), F.lit("")), r"[：:]\s*$", "")))).withColumn("context", near)
    every = sorted([(x, "positive") for x in positive] + [(x, "negative") for x in negative] + [(x, "contextual") for x in contextual], key=lambda x: -len(x[0]))
    quoted = lambda x: "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in x)
    label = lambda hit, x, kind, same: F.when(hit, F.struct(F.lit(x).alias("label"), F.lit(kind).alias("type"), F.lit(same).alias("same")))
    own = [label(F.col("line").rlike(f"(?i)(?:^|[^a-z0-9]){quoted(x)}(?:$|[^a-z0-9])"), x, k, True) for x, k in every]
    prior = [label(F.col("before") == x, x, k, False) for x, k in every]
    rows = rows.withColumn("l", F.coalesce(*own, *prior))
    tokens = F.array_distinct(F.filter(F.regexp_extract_all("line", F.lit(IDENTIFIER), F.lit(1)), lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]")))
    out = rows.withColumn("token", F.explode(tokens))
    return out.select(
        "doc", "page", "line_no", "token", identifier_signature(F.col("token")).alias("format"), "l.label", F.coalesce("l.type", F.lit("none")).alias("label_type"), F.coalesce("l.same", F.lit(False)).alias("same_line"),
        F.coalesce(~F.col("l.same"), F.lit(False)).alias("exclusive"), ((F.col("page") == 1) & (F.col("line_no") <= 2)).alias("in_title"), "context",
    )


def chosen(found: DataFrame, role: Column, grammars: DataFrame) -> DataFrame:
    """Per document the part number its candidates prove: an explicit one, then the first of the active grammar's format,
    then one seen twice or more on page 1 and in the title or on another page. doc, token, reason.

    role: the candidates' role (discovery.identifier_role); grammars: doc, format of the active one.
    """
    rows = found.withColumn("role", role).join(grammars.withColumnRenamed("format", "_g"), "doc", "left")
    free = ~F.col("role").isin(*EXCLUDED_ROLES) & (F.col("label_type") != "negative") & (F.col("role") != "PART_NUMBER")
    explicit = rows.filter(F.col("role") == "PART_NUMBER").select("doc", F.lit(0).alias("p"), F.lit("explicit_part_number").alias("reason"), "page", "line_no", "token")
    grammar = rows.filter(free & (F.col("format") == F.col("_g"))).select("doc", F.lit(1).alias("p"), F.lit("active_grammar").alias("reason"), "page", "line_no", "token")
    seen = rows.filter(free).groupBy("doc", "token").agg(F.count_if(F.col("page") == 1).alias("one"), F.bool_or("in_title").alias("title"), F.bool_or(F.col("page") > 1).alias("elsewhere"))
    seen = seen.filter((F.col("one") >= 2) & (F.col("title") | F.col("elsewhere")))
    context = seen.select("doc", F.lit(2).alias("p"), F.lit("contextual_identity_corroborated").alias("reason"), (~F.col("title")).cast("int").alias("page"), (-F.col("one")).cast("int").alias("line_no"), "token")
    order = Window.partitionBy("doc").orderBy("p", "page", "line_no", "token")
    every = explicit.unionByName(grammar).unionByName(context)
    return every.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("doc", "token", "reason")


def ordered_parts(cells: DataFrame) -> DataFrame:
    """Part numbers of ordering rows (doc, page, table, row, token under a part-number header): rows with exactly one
    distinct number; the first of each."""
    key = part_key(F.col("token"))
    rows = cells.groupBy("doc", "page", "table", "row").agg(F.count_distinct(key).alias("n"), F.min("token").alias("token")).filter("n = 1")
    order = Window.partitionBy("doc", part_key(F.col("token"))).orderBy("page", "table", "row")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("doc", "page", "table", "row", "token")


def applicable_specs(specs: DataFrame, parts: DataFrame) -> DataFrame:
    """specs (doc, attribute, value, context) of parts (doc, token, marking) that name the part, or a version (A, B, K,
    BA, KA) that the part's number or marking carries."""
    corpus = F.concat_ws(" ", "attribute", "value", "context")
    listed = F.regexp_extract_all(corpus, F.lit(r"(?i)(?<![A-Za-z0-9_])((?:BA|KA|B|A|K)(?:\s*,\s*(?:BA|KA|B|A|K))*)\s+versions?(?![A-Za-z0-9_])"), F.lit(1))
    versions = F.transform(F.flatten(F.transform(listed, lambda x: F.split(x, ","))), lambda x: F.upper(F.trim(x)))
    number, marking = F.upper(F.regexp_replace("token", r"\s", "")), F.upper(F.regexp_replace(text(F.col("marking")), r"\s", ""))
    grade = F.regexp_extract(number, r"[0-9](BA|KA|B|A|K)[A-Z0-9._/-]*$", 1)
    named = F.upper(F.regexp_replace(corpus, r"\s", "")).contains(number)
    ok = named | F.exists(versions, lambda v: (grade == v) | marking.endswith(v))
    return specs.join(parts.select("doc", "token", "marking"), "doc").filter((number != "") & ok).select("doc", "token", "attribute", "value")

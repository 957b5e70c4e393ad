"""Attribute/value rows out of lines and HTML, by generator expressions on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SCRIPTS, entities_decoded, markdown_cleaned, text, visible_text

#: What can't be an attribute's value or name.
UNSAFE = r"(?i)!?\[[^\]]*\]\s*\(|javascript\s*:|blob://|data:(?:text|image)/|localhost(?:[:/]|$)|127\.0\.0\.1|(?:https?:)?//"
NOTHING = ("s/f", "n/a", "none", "null", "undefined")
#: Units behind a number, words that begin no label, words of prose, words that a label drops at its end.
UNITS = ("mm", "cm", "km", "m", "n", "kn", "bar", "mpa", "kpa", "psi", "v", "mv", "kv", "a", "ma", "ua", "hz", "khz", "mhz", "w", "kw", "mw", "va", "kg", "g", "mg", "lb", "nm", "µm", "μm", "rpm", "°c", "°f", "%", "l", "ml", "ms", "s", "db", "torr", "pa", "mbar", "ips", "in", "ft", "cfm", "lpm", "gpm")
LABEL_STARTS = ("the", "a", "an", "this", "these", "those", "some", "any", "our", "your", "its", "all", "each", "every", "no", "both", "such", "that", "which", "what", "when", "where", "how", "why", "who", "from", "with", "for", "and", "but", "or", "nor", "so", "yet")
PROSE = ("the", "a", "an", "with", "for", "and", "of", "to", "in", "is", "are", "includes", "has", "have", "that", "this", "which", "from", "by", "at", "on", "or", "as", "be", "been", "was", "were", "will", "would", "can", "could", "should", "may", "might", "must", "shall", "do", "does", "did", "not", "no", "yes")
TRAILING = ("at", "with", "of", "in", "on", "for", "to", "en", "de", "para", "con", "por", "the", "a", "an", "y", "and", "or", "del", "la", "el", "las", "los")
#: Lines that head or surround a data sheet and name no attribute.
NO_LABELS = (
    "specifications?", "general", "description", "features", "overview", "details?", "characteristics", "properties", "technical data", "information", "related products?", "see also", "menu", "footer",
    "copyright", "all rights reserved", "home", "back", "next", "previous", "share", "print", "download", "resources?", "documentation", "support", "contact", "company", "about", "reviews", "comments",
    "qty", "quantity", "price", "add to cart", "buy now", "in stock", "out of stock", "sku", "model", "series", "brand", "manufacturer", "category", "origin", "warranty", "shipping",
)
#: Fixed value: pairs of label and value lines that a document gives at most.
MOST_ADJACENT = 25


def safe_pair(attribute: Column, value: Column) -> Column:
    a, v = F.trim(text(attribute)), F.trim(text(value))
    return (a != "") & (v != "") & (F.length(a) <= 100) & (F.length(v) <= 200) & ~F.concat_ws(" ", a, v).rlike(UNSAFE) & ~F.lower(v).isin(*NOTHING)


def lines(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, line_no, line: trimmed lines that aren't empty, numbered in order."""
    kept = F.filter(F.transform(F.split(text(F.col(text_col)), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(F.col(id_col).alias("id"), F.posexplode(kept).alias("line_no", "line"))


def bare_lines(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, line_no, line: lines of the cleaned text without Markdown's marks, numbered in order; empty ones go."""
    bare = F.transform(F.split(markdown_cleaned(F.col(text_col)), r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\s>*#-]+", ""), r"[*_`]", "")))
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.filter(bare, lambda x: x != "")).alias("line_no", "line"))


def colon_pairs(rows: DataFrame) -> DataFrame:
    """attribute, value of lines 'label: value' with a digit in the value, up to six words in the label."""
    pattern = r"^(.{2,55}?)\s*[:：]\s*([^\n:]{1,45})$"
    out = rows.filter(F.length("line") <= 140).select("*", F.trim(F.regexp_extract("line", pattern, 1)).alias("attribute"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))
    return out.filter((F.col("attribute") != "") & F.col("value").rlike("[0-9]") & (F.size(F.split("attribute", r"\s+")) <= 6)).drop("line")


def adjacent_pairs(rows: DataFrame) -> DataFrame:
    """attribute, value of a short label line without digits and the line after it that starts with a digit.

    Lines come from bare_lines. Headings and shop words are no labels. The first of equal pairs of a document counts, and up
    to 25 of a document: more is no data sheet.
    """
    in_doc = Window.partitionBy("id").orderBy("line_no")
    nxt = F.lead("line").over(in_doc)
    both = rows.withColumn("value", nxt).filter("value is not null")
    words = lambda c: F.size(F.split(c, r"\s+"))
    label = F.length("line").between(2, 60) & (words("line") <= 5) & ~F.col("line").rlike(r"[0-9]|[.!?]$") & ~F.col("line").rlike(r"(?i)^(?:" + "|".join(LABEL_STARTS) + r")(?![A-Za-z0-9_])") & ~F.col("line").rlike(r"(?i)^(?:" + "|".join(NO_LABELS) + r")$")
    value = (F.length("value") <= 60) & (words("value") <= 3) & F.col("value").rlike("^[0-9]") & ~F.col("value").rlike("[.!?]$") & ~F.col("value").rlike(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(PROSE) + r")(?![A-Za-z0-9_])")
    out = both.filter(label & value).select("id", "line_no", F.trim(F.regexp_replace("line", r"[:：-]\s*$", "")).alias("attribute"), F.trim(F.regexp_replace("value", "[,;]$", "")).alias("value"))
    first = first_of(out, ["id", F.lower("attribute"), F.lower("value")], "line_no")
    return first.withColumn("_n", F.row_number().over(in_doc)).filter(F.col("_n") <= MOST_ADJACENT).drop("_n")


def pipe_pairs(rows: DataFrame) -> DataFrame:
    """attribute, value of lines of two cells between bars, with a digit in the value."""
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(F.regexp_replace(x, "[*_`]", ""))), lambda x: x != "")
    two = rows.withColumn("_c", cells).filter(F.size("_c") == 2).select("id", "line_no", F.get("_c", 0).alias("attribute"), F.get("_c", 1).alias("value"))
    rule = lambda c: F.col(c).rlike("^[-: ]+$")
    return two.filter(~rule("attribute") & ~rule("value") & F.col("value").rlike("[0-9]") & (F.length("value") <= 160) & safe_pair(F.col("attribute"), F.col("value")))


def compact_pairs(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """attribute, value of 'Label 25 mm': a capitalised label of up to six words, a number and a known unit."""
    pattern = r"([A-ZÀ-Ý][A-Za-zÀ-ÿ/]+(?:\s+[A-Za-zÀ-ÿ/]+){0,5}?)\s+(\d+(?:[.,]\d+)?)\s*([a-zA-Z°µ%]{1,6})(?![A-Za-z0-9_])"
    flat = F.regexp_replace(text(F.col(text_col)), r"\s+", " ")
    hits = docs.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(flat, F.lit(pattern), F.lit(0))).alias("line_no", "hit"))
    part = lambda i: F.regexp_extract("hit", pattern, i)
    label = F.trim(F.regexp_replace(part(1), r"(?i)(?:\s+(?:" + "|".join(TRAILING) + r"))+$", ""))
    rows = hits.select("id", "line_no", label.alias("attribute"), F.concat_ws(" ", part(2), F.lower(part(3))).alias("value"), F.lower(part(3)).alias("unit"))
    rows = rows.filter(F.col("unit").isin(*UNITS) & F.length("attribute").between(2, 50)).drop("unit")
    return first_of(rows, ["id", F.lower("attribute"), "value"], "line_no")


def first_of(rows: DataFrame, keys: list, order: str) -> DataFrame:
    """Ordered distinct: of rows with equal keys the first."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_first = 1").drop("_first")


def html_title(html: Column) -> Column:
    return F.trim(entities_decoded(F.regexp_extract(text(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_rows(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """id, row_no, attribute, value of table rows (first cell, rest joined) and definition lists."""
    html = F.regexp_replace(text(F.col(html_col)), SCRIPTS, " ")
    cells = lambda r: F.filter(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), visible_text), lambda x: x != "")
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: cells(r))
    table = F.transform(F.filter(rows, lambda c: F.size(c) >= 2), lambda c: F.struct(F.get(c, 0).alias("attribute"), F.array_join(F.slice(c, 2, F.size(c) - 1), " ").alias("value")))
    defs = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)(<dt[^>]*>.*?</dt>\s*<dd[^>]*>.*?</dd>)"), F.lit(1)),
        lambda d: F.struct(visible_text(F.regexp_extract(d, r"(?is)<dt[^>]*>(.*?)</dt>", 1)).alias("attribute"), visible_text(F.regexp_extract(d, r"(?is)<dd[^>]*>(.*?)</dd>", 1)).alias("value")),
    )
    out = pages.select(F.col(id_col).alias("id"), F.posexplode(F.concat(table, defs)).alias("row_no", "r")).select("id", "row_no", "r.attribute", "r.value")
    return out.filter(safe_pair(F.col("attribute"), F.col("value")))


def links(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """id, link_no, href: anchors in order."""
    found = F.regexp_extract_all(text(F.col(html_col)), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"'#]+)[\"']"), F.lit(1))
    return pages.select(F.col(id_col).alias("id"), F.posexplode(found).alias("link_no", "href"))


def images(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """id, method, url: og/twitter images, img sources and JSON-LD product images."""
    html = text(F.col(html_col))
    og = F.regexp_extract_all(html, F.lit(r"(?is)<meta[^>]*(?:property|name)=[\"'](?:og:image|twitter:image)[\"'][^>]*content=[\"']([^\"']+)"), F.lit(1))
    img = F.regexp_extract_all(html, F.lit(r"(?is)<img[^>]*\ssrc=[\"']([^\"']+)"), F.lit(1))
    ld = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), lambda j: F.regexp_extract_all(j, F.lit(r"\"image\"\s*:\s*\[?\s*\"([^\"]+)\""), F.lit(1))))
    found = lambda method: lambda u: F.struct(F.lit(method).alias("method"), u.alias("url"))
    each = [F.transform(a, found(m)) for m, a in (("jsonld", ld), ("og", og), ("html", img))]
    return pages.select(F.col(id_col).alias("id"), F.posexplode(F.concat(*each)).alias("image_no", "i")).select("id", "image_no", "i.method", "i.url")


def part_numbers(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, position, token: tokens shaped like a part number (1 to 4 capitals, a digit, more)."""
    found = F.regexp_extract_all(text(F.col(text_col)), F.lit(r"(?<![A-Za-z0-9_])([A-Z]{1,4}-?[0-9][A-Z0-9-]{1,12})(?![A-Za-z0-9_])"), F.lit(1))
    return docs.select(F.col(id_col).alias("id"), F.posexplode(found).alias("position", "token"))


def sectioned(rows: DataFrame) -> DataFrame:
    """rows (id, row_no, cells) with the section that the last one-cell row before them names; such rows go."""
    name = F.when(F.size("cells") == 1, F.get("cells", 0))
    so_far = Window.partitionBy("id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(name, ignorenulls=True).over(so_far)).filter(F.size("cells") > 1)


def continued(rows: DataFrame, is_label: Column) -> DataFrame:
    """id, line_no, text: lines joined to the label line before them; lines before any label go."""
    so_far = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_g", F.sum(is_label.cast("int")).over(so_far)).filter("_g > 0")
    joined = marked.groupBy("id", "_g").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return joined.select("id", "line_no", F.array_join(F.transform("_l", lambda x: x["line"]), " ").alias("text"))


def density(c: Column, signal: str, common: list[str]) -> Column:
    """struct(chars, words, letter_density, common_ratio, signal_density) of a text, by which scans are sorted out."""
    t = text(c)
    n, w = F.length(t), F.regexp_count(t, F.lit(r"\S+"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    words = F.regexp_count(F.lower(t), F.lit(r"(?<![a-z])(?:" + "|".join(common) + r")(?![a-z])"))
    return F.struct(n.alias("chars"), w.alias("words"), ratio(F.regexp_count(t, F.lit(r"[A-Za-z]")), n).alias("letter_density"), ratio(words, w).alias("common_ratio"), ratio(F.regexp_count(t, F.lit(signal)), w).alias("signal_density"))

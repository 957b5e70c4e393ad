"""What a search page shows and how it reads a query, as Column expressions. Null counts as empty text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text, trimmed

# The words, hosts, patterns and codes below decide what is shown.
COMMERCIAL = (
    "stock", "inventory", "availability", "available", "in stock", "out of stock", "quantity", "qty", "price", "cost", "msrp", "list price", "sale price", "lead time", "delivery", "shipping", "order status", "cart", "sku",
)
MARKUP = r"(?i)!\[[^\]]*\]|\]\(|(?:https?:)?//|javascript\s*:|void\s*\(\s*0\s*\)|blob://|data:(?:text|image)/"
ASSET = r"(?i)^(?:/|\./|\.\./).*\.(?:svg|gif|png|jpe?g|webp|ico)(?:[?#].*)?$"
DECORATION = r"(?i)logo|logotype|brandmark|banner|favicon|navbar|navigation|search icon|location icon|contact icon|social icon|tracking pixel|sprite"
IMAGE_PATH = r"(?i)\.(?:svg|gif|png|jpe?g|webp|ico)|/images?/|/media/|/assets?/"
MARKETPLACES = r"(?i)amazon|ebay|mercadolibre|aliexpress|alibaba|walmart|shopify|etsy|shop\.|store\.|marketplace|classifieds"
LABEL_PREFIXES = ("siemens_", "mouser_", "analog_", "diodes_")
CATEGORIES = (
    ("proximity_sensor", "proximity|inductive sensor|sensor inductivo"),
    ("pressure_sensor", "pressure sensor|sensor de presión"),
    ("servo_drive", "servo drive|servodrive|servo amplifier"),
    ("servo_motor", "servo motor"),
    ("solenoid_valve", "solenoid valve|válvula solenoide"),
    ("fieldbus_node", "fieldbus|remote i/o|fieldbus node"),
)
FILE_PREFIXES = ("ADN", "ADVC", "ADVUL", "DSNU", "DSBC", "DNC", "DSBF", "DSBG", "DGST", "DGSL", "DSNA", "DSNB", "DGC", "DGS", "DN", "ESNU", "DFSP", "DRVS", "DSW")


def is_part_number_query(query: Column) -> Column:
    """One token of 3 to 40 characters, no fraction, that starts with a short letter prefix and a digit, or with a digit and has a letter."""
    q = trimmed(query)
    token = ~q.rlike(r"\s") & ~q.rlike(r"\d+\s*/\s*\d+") & F.length(q).between(3, 40)
    mixed = q.rlike(r"^[A-Za-z0-9][A-Za-z0-9\-/_.]*$") & q.rlike("[A-Za-z]") & q.rlike("[0-9]")
    return token & mixed & (q.rlike(r"^[A-Za-z]{1,8}[-_.]?[0-9][A-Za-z0-9\-/_.]{1,30}$") | q.rlike(r"^[0-9][A-Za-z0-9\-/_.]{2,39}$"))


def query_part_number(query: Column) -> Column:
    """The first token of a query that is built like a part number; empty if none is."""
    hits = F.filter(F.split(text(query), r"\s+"), lambda t: t.rlike(r"^[A-Z]{1,4}-?[0-9][A-Z0-9-]{1,12}$"))
    return F.coalesce(F.get(hits, 0), F.lit(""))


def is_displayable(attribute: Column, value: Column) -> Column:
    """A technical row: both sides given, nothing commercial, no markup, no asset path, no image of the page's decoration."""
    a, v = trimmed(attribute), trimmed(value)
    commercial = F.lower(a).isin(*COMMERCIAL)
    markup = F.concat(a, F.lit(" "), v).rlike(MARKUP)
    return (a != "") & (v != "") & ~commercial & ~markup & ~v.rlike(ASSET) & ~(a.rlike(DECORATION) & v.rlike(IMAGE_PATH))


def is_specification_blob(description: Column) -> Column:
    """Two 'label: value' pairs, or one in more than 120 characters. A value runs up to the next colon, over the next label."""
    v = trimmed(description)
    pairs = F.regexp_count(v, F.lit(r"[^:]{2,80}:\s*[^:]{1,120}"))
    return (pairs >= 2) | ((F.length(v) > 120) & (pairs >= 1))


def humanised(label: Column) -> Column:
    """A raw label without a known prefix and underscores, its first letter in upper case."""
    bare = F.regexp_replace(trimmed(label), "(?i)^(?:" + "|".join(LABEL_PREFIXES) + ")", "")
    bare = F.trim(F.regexp_replace(F.translate(bare, "_", " "), r"\s+", " "))
    return F.concat(F.upper(F.substring(bare, 1, 1)), bare.substr(F.lit(2), F.length(bare)))


def first_page(needle: Column, pages: Column) -> Column:
    """The 1-based number of the first page that contains the needle; null if none does, or the needle is empty."""
    at = F.array_position(F.transform(pages, lambda p: F.coalesce(F.contains(p, needle), F.lit(False))), True)
    return F.when((F.length(needle) > 0) & (at > 0), at)


def is_marketplace(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))).rlike(MARKETPLACES)


def reference_category(category: Column, *descriptions: Column) -> Column:
    """The first category whose words are in the category or the descriptions; the given category if none is."""
    raw = F.lower(F.concat_ws(" ", text(category), *map(text, descriptions)))
    return reduce(lambda out, c: F.when(raw.rlike(c[1]), c[0]).otherwise(out), reversed(CATEGORIES), text(category))


def file_prefix(url: Column) -> Column:
    """The first prefix, in the list's order, that the name of the URL's file starts with; null if none or no URL."""
    name = F.upper(F.element_at(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), -1))
    found = F.coalesce(*(F.when(name.startswith(p), p) for p in FILE_PREFIXES))
    return F.when(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull(), found)


def file_family(type_code: Column) -> Column:
    return F.when(text(type_code).rlike("(?i)^(DGST|DGSL)"), "pneumatic_mini_slide").otherwise("pneumatic_cylinder")


def is_given(value: Column, low: Column, high: Column) -> Column:
    """A specification with a value that isn't empty, or a limit."""
    return (text(value) != "") | low.isNotNull() | high.isNotNull()


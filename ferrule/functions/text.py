"""Identifiers, units, values and labels as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of units and their symbol.
UNITS = {
    "v": "V", "volt": "V", "volts": "V", "voltage": "V", "vdc": "V", "vac": "V",
    "a": "A", "amp": "A", "amps": "A", "amperes": "A", "ma": "mA", "aa": "AA",
    "w": "W", "watt": "W", "watts": "W", "kw": "kW", "hz": "Hz", "khz": "kHz", "mhz": "MHz",
    "bar": "bar", "mpa": "MPa", "pa": "Pa", "psi": "psi", "mm": "mm", "cm": "cm", "m": "m",
    "kg": "kg", "g": "g", "n": "N", "nm": "Nm", "rpm": "rpm", "c": "°C", "f": "°F",
}


#: Parts of a page that hold no text.
SCRIPTS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"


def text(c: Column) -> Column:
    """The value as text; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def mapped(c: Column, values: dict[str, str]) -> Column:
    """values[c], null where it has none."""
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c]


def normalize_unit(c: Column) -> Column:
    key = F.regexp_replace(F.lower(trimmed(c)), r"[\s.]", "")
    return F.coalesce(mapped(key, UNITS), trimmed(c))


def split_value_unit(c: Column) -> Column:
    """struct(value, unit): a number with at most one sign and comparison, and letters behind it; else all is value."""
    s, pattern = trimmed(c), r"^([<>~]?\s*[-+]?\d+(?:[.,]\d+)?)\s*([A-Za-z°²µ·/]+)?$"
    number = F.replace(F.regexp_replace(F.regexp_extract(s, pattern, 1), r"\s", ""), F.lit(","), F.lit("."))
    hit = s.rlike(pattern)
    return F.struct(F.when(hit, number).otherwise(s).alias("value"), F.when(hit, F.regexp_extract(s, pattern, 2)).otherwise("").alias("unit"))


def part_key(c: Column) -> Column:
    """Upper case without white space and - / _ . : the form in which part numbers are compared."""
    return F.regexp_replace(F.upper(text(c)), r"[\s\-/_.]", "")


def alnum_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]", "")


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the letters without them."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(i))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Lower case, Latin accents off, all but [a-z0-9] one space."""
    marked, plain = _folds()
    base = F.lower(F.translate(F.regexp_replace(text(c), r"[̀-ͯ]", ""), marked, plain))
    return F.trim(F.regexp_replace(base, "[^a-z0-9]+", " "))


def identifier_signature(c: Column) -> Column:
    """ASCII upper-case letters as A, digits as N, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(text(c), "[A-Z]", "A"), "[0-9]", "N")


def unicode_signature(c: Column) -> Column:
    """Any letter as A, any number as N. Input is taken as composed (NFC)."""
    return F.regexp_replace(F.regexp_replace(text(c), r"\p{L}", "A"), r"\p{N}", "N")


def looks_like_part_number(c: Column) -> Column:
    s = trimmed(c)
    return F.length(s).between(2, 40) & s.rlike(r"^[A-Za-z0-9][A-Za-z0-9\-/_.]*$") & s.rlike("[0-9]")


def is_unicode_identifier(c: Column, least: int = 2, most: int = 40, digit: bool = True) -> Column:
    s = trimmed(c)
    ok = F.length(s).between(least, most) & s.rlike(r"^[\p{L}\p{N}][\p{L}\p{N}\-/_.]*$")
    return ok & s.rlike(r"\p{N}") if digit else ok


def tokens(c: Column) -> Column:
    """Lower-case tokens of two characters or more, split at white space, commas and semicolons."""
    return F.filter(F.split(F.lower(text(c)), r"[\s,;]+"), lambda t: F.length(t) > 1)


def number(c: Column) -> Column:
    """The first signed decimal; only the first comma counts as a point, so 6,300 is 6.3."""
    return F.regexp_extract(F.regexp_replace(text(c), "^([^,]*),", "$1."), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def number_range(c: Column) -> Column:
    """struct(low, high) of 'a..b', 'a-b' or 'a to b', ends in order; of a single number both are that; else null."""
    s, pattern = F.regexp_replace(trimmed(c), "^([^,]*),", "$1."), r"(?i)(-?\d+(?:\.\d+)?)\s*(?:\.\.\.?|-|–|—|to)\s*(-?\d+(?:\.\d+)?)"
    a, b = (F.regexp_extract(s, pattern, i).try_cast("double") for i in (1, 2))
    one = number(s)
    both = F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    return F.when(a.isNotNull(), both).when(one.isNotNull(), F.struct(one.alias("low"), one.alias("high")))


def is_weak_reference(c: Column) -> Column:
    """A bare measure such as '24 V' names no part."""
    return trimmed(c).rlike(r"(?i)^[-+]?\d+(?:[.,]\d+)?\s*(?:mm|cm|m|v|a|ma|w|kw|bar|mpa|psi|hz|kg|g|nm|n|rpm|°c|°f|%)?$")


def notation(c: Column) -> Column:
    """One spelling of diameters, micrometres and dimensions."""
    steps = ((r"[⌀∅øØ]\s*", "Ø"), (r"μm|µm|\bum\b", "µm"), (r"(\d)\s*[xX×]\s*(?=\d)", "$1 × "), (r"\s+", " "))
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, *s), steps, text(c)))


def entities_decoded(c: Column) -> Column:
    """The common HTML entities; &amp; last, so that nothing is decoded twice."""
    pairs = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&deg;", "°"), ("&micro;", "µ"), ("&amp;", "&"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text(c))


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(text(html), SCRIPTS, " ")
    return F.trim(F.regexp_replace(entities_decoded(F.regexp_replace(bare, "(?s)<[^>]+>", " ")), r"\s+", " "))


def negated(tokens_: Column, at: Column) -> Column:
    """Whether one of the three tokens before a position negates it; 'sin embargo' doesn't."""
    three = F.sequence(F.greatest(at - 3, F.lit(0)), F.greatest(at - 1, F.lit(0)))
    says = lambda i: F.get(tokens_, i).isin("non", "not", "no", "sin") & ~((F.get(tokens_, i) == "sin") & F.coalesce(F.get(tokens_, i + 1) == "embargo", F.lit(False)))
    return (at > 0) & F.exists(three, lambda i: F.coalesce(says(i), F.lit(False)))


def phrase_positions(tokens_: Column, words: Column) -> Column:
    """Zero-based positions at which the words stand in the tokens in a row."""
    last = F.size(tokens_) - F.size(words)
    at = F.when((last >= 0) & (F.size(words) > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.slice(tokens_, i + 1, F.size(words)) == words)


def markdown_cleaned(c: Column) -> Column:
    """Text without fenced code, Markdown images and links and bare URLs, and without white space around line ends.

    The target of a link may hold brackets, four deep; one that isn't closed goes up to the end of its line.
    """
    inner = r"[^()]*+"
    for _ in range(3):
        inner = rf"(?:[^()]++|\({inner}\))*+"
    target = rf"\[[^\]]*\]\s*(?:\({inner}\)|\([^\n]*)"
    steps = ((r"(?s)```.*?```", " "), ("!" + target, " "), (target, " "), (r"(?i)javascript\s*:|void\s*\(\s*0\s*\)|blob://|data:(?:text|image)/[^\s)]+|(?:https?:)?//[^\s)]+", " "), (r"\s+\n", "\n"), (r"\n\s+", "\n"))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, text(c))

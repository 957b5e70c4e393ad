"""Published non-cryptographic hashes, in bigint arithmetic that stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _codes(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))


def fnv1a(c: Column) -> Column:
    """FNV-1a with 32 bits over the characters' codes, in unpadded lower-case hex."""
    step = lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(16777619), F.lit(1 << 32))
    return F.lower(F.hex(F.aggregate(_codes(c), F.lit(2166136261).cast("long"), step)))


def djb2(c: Column) -> Column:
    """djb2 in its xor form, with 32 bits."""
    step = lambda h, x: F.pmod(h * 33, F.lit(1 << 32)).bitwiseXOR(x)
    return F.aggregate(_codes(c), F.lit(5381).cast("long"), step)


def stable_map(specs: Column) -> Column:
    """A map<string, string> as text that doesn't depend on the order of its keys; null and missing differ."""
    entries = F.array_sort(F.map_entries(specs))
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    pair = lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(quoted(e["value"]), F.lit("null")))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform(entries, pair), ","), F.lit("")), F.lit("}"))

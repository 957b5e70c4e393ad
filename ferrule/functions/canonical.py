"""Forms that compare equal: composed Unicode, and JSON with its keys in order at every depth. Arrow batches, since Spark has neither."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import text

INDEX = re.compile(r"0|[1-9][0-9]{0,9}")


@F.pandas_udf(StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda x: x if x is None or x.isascii() or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def composed(c: Column) -> Column:
    """Text in Unicode's composed form (NFC); ASCII goes through as it is."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_composed(c))


def identifier_key(c: Column) -> Column:
    """Composed and in upper case, without white space and - / _ . ; letters of any script stay."""
    return F.regexp_replace(F.upper(composed(text(c))), r"(?U)[\s\-/_.]+", "")


def _number(x: float | int) -> str:
    """A number as JavaScript reads and writes it: as a double, in the fewest digits, with an exponent from 1e21 and below 1e-6."""
    try:
        x = float(x)
    except OverflowError:
        return "null"
    if not math.isfinite(x):
        return "null"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if text == "0":
        return "0"
    if len(text) <= point <= 21:
        out = text.ljust(point, "0")
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{text}"
    else:
        out = f"{text[0]}{'.' * (len(text) > 1)}{text[1:]}e{point - 1:+d}"
    return "-" * sign + out


def _ordered(keys: list[str]) -> list[str]:
    """As an object has them whose keys were put in by their UTF-16 units: array indices first."""
    index = [k for k in keys if INDEX.fullmatch(k) and int(k) < (1 << 32) - 1]
    return sorted(index, key=int) + sorted(set(keys) - set(index), key=lambda k: k.encode("utf-16-be", "surrogatepass"))


def canonical(value: object) -> str:
    """The one text of a JSON value."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in _ordered(list(value))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return _number(value)


def _parsed(x: str | None) -> object:
    """The value of a JSON text; ValueError if it is none."""
    try:
        return json.loads(x or "", parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except RecursionError as error:
        raise ValueError("too deep") from error


@F.pandas_udf(StringType())
def _stable(values: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return canonical(_parsed(x))
        except ValueError:
            return None

    return values.map(one)


def stable_json(c: Column) -> Column:
    """A JSON text with the keys of its objects in order at every depth and without white space; null if it is no JSON.

    20 and "20" differ, as do null and a key that isn't there; 20 and 20.0 are one number.
    """
    return _stable(c)


def _product_images(node: object, found: list) -> None:
    """Images of nodes whose type says product; a graph's nodes are looked at in turn."""
    todo = [node]
    while todo:
        x = todo.pop(0)
        if not isinstance(x, dict):
            continue
        kind = x.get("@type")
        if kind is not None and "product" in (",".join(map(str, kind)) if isinstance(kind, list) else str(kind)).lower():
            name = next((str(x[k]) for k in ("name", "sku", "mpn") if x.get(k)), "")
            images = x.get("image")
            for image in images if isinstance(images, list) else [images]:
                url = image.get("url") if isinstance(image, dict) else image
                if isinstance(url, str) and url:
                    found.append({"url": url, "alt": name})
        if isinstance(x.get("@graph"), list):
            todo = [*x["@graph"], *todo]


@F.pandas_udf(ArrayType(StructType([StructField("url", StringType()), StructField("alt", StringType())])))
def _linked_images(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        out = []
        for scripts in values:
            found: list = []
            for script in scripts if scripts is not None else []:
                try:
                    data = _parsed(script.strip())
                except ValueError:
                    continue
                for node in data if isinstance(data, list) else [data]:
                    _product_images(node, found)
            out.append(found)
        yield pd.Series(out, index=values.index, dtype=object)


SCRIPT = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def product_images(html: Column) -> Column:
    """array<struct<url, alt>>: images of products in a page's JSON-LD, graphs inside graphs included, in order. Scripts that are no JSON are left out."""
    return _linked_images(F.regexp_extract_all(text(html), F.lit(SCRIPT), F.lit(1)))

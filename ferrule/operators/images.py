"""Image candidates: filters, scores and the best of each product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum_key
from ..functions.urls import image_key, usable_image

#: What a way of finding an image is worth.
BASES = {"jsonld": 100, "part_context": 85, "maker_context": 70, "og": 50, "provider": 30, "html": 20, "markdown": 10}
REJECTED = r"(?i)logo|icon|favicon|sprite|banner|avatar|placeholder|tracking|pixel|spinner|loading|badge|social|\.(?:svg|ico)(?:[?#]|$)"

#: Fixed value: an image with a side of so many pixels or less in its URL only counts visits.
TRACKING_PIXELS = 2


def tracking(url: Column) -> Column:
    """Whether the first 'width x height' of a URL is that of a tracking pixel."""
    side = lambda i: F.regexp_extract(url, r"(\d+)x(\d+)", i).try_cast("decimal(38,0)")
    return F.coalesce(F.least(side(1), side(2)) <= TRACKING_PIXELS, F.lit(False))


def scored(candidates: DataFrame) -> DataFrame:
    """candidates (id, url, method, context, part_number, manufacturer) that can be product images, with score.

    The part number is compared without separators but the context as it is, so numbers with hyphens rarely match.
    """
    low = F.lower(F.coalesce("context", F.lit("")))
    has = lambda c: (alnum_key(F.col(c)) != "") & low.contains(alnum_key(F.col(c)))
    base = F.coalesce(*(F.when(F.col("method") == m, F.lit(s)) for m, s in BASES.items()), F.lit(0))
    bonus = F.when(has("part_number") & has("manufacturer"), 40).when(has("part_number"), 25).when(has("manufacturer"), 20).otherwise(0)
    rows = candidates.filter(usable_image(F.col("url")) & ~F.concat_ws(" ", "url", "context").rlike(REJECTED) & ~tracking(F.col("url")))
    return rows.withColumn("score", base + bonus)


def best(candidates: DataFrame) -> DataFrame:
    """The best image of each id, after the best of those with the same path."""
    rows = scored(candidates).withColumn("_k", image_key(F.col("url")))
    one = lambda df, keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("url")))).filter("_n = 1").drop("_n")
    return one(one(rows, ["id", "_k"]), ["id"]).drop("_k")


def attach(parts: DataFrame, images: DataFrame, primary: Column, verified_at: Column, created_at: Column) -> DataFrame:
    """parts with url of their best verified image (part_id): primary, then latest verified, then latest created."""
    order = Window.partitionBy("part_id").orderBy(primary.desc(), verified_at.desc_nulls_last(), created_at.desc())
    top = images.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("part_id", F.col("url").alias("image_url"))
    return parts.join(top, "part_id", "left")

"""Cells and tables out of text fragments with coordinates (doc, page, idx, text, x, y, w, h).

Grouping into bands, lines and columns depends on what came first, so it is a fold over a page's fragments in order. A page
is small and is the unit of a group; the folds are expressions over its array and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt

GAP = 10.0


def on_pages(fragments: DataFrame, order: list[str]) -> DataFrame:
    """doc, page, items: a page's fragments as one array of structs; order: columns by which they come, a minus before those that fall."""
    key = lambda c: (-F.col(c[1:])).alias(f"_{c[1:]}") if c.startswith("-") else F.col(c).alias(f"_{c}")
    rest = [c for c in fragments.columns if c not in ("doc", "page")]
    items = F.array_sort(F.collect_list(F.struct(*(key(c) for c in order), F.struct(*rest).alias("item"))))
    return fragments.groupBy("doc", "page").agg(F.transform(items, lambda x: x["item"]).alias("items"))


def spread(pages: DataFrame, numbers: Column, name: str) -> DataFrame:
    """The fragments of on_pages() again, each with its number."""
    both = F.transform(F.col("items"), lambda x, i: F.struct(x.alias("item"), F.get(numbers, i).alias("n")))
    rows = pages.select("doc", "page", F.explode(both).alias("_x"))
    return rows.select("doc", "page", "_x.item.*", F.col("_x.n").alias(name))


def banded(fragments: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """fragments with `band`: from top to bottom, a fragment further than `tolerance` from its band's first starts a new one."""

    def step(s: Column, x: Column) -> Column:
        new = s["first"].isNull() | (F.abs(s["first"] - x["y"]) > tolerance)
        n = s["n"] + new.cast("int")
        return F.struct(F.when(new, x["y"]).otherwise(s["first"]).alias("first"), n.alias("n"), F.array_append(s["of"], n).alias("of"))

    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("of"))
    pages = on_pages(fragments.withColumn("y", F.col("y").cast("double")), ["-y", "x", "idx"])
    return spread(pages.withColumn("_of", F.aggregate("items", start, step, lambda s: s["of"])), F.col("_of"), "band").select(*fragments.columns, "band")


def cells(bands: DataFrame, gap: float = GAP) -> DataFrame:
    """doc, page, band, cell, text, x0, x1: a band cut where the horizontal gap reaches `gap`."""
    in_band = Window.partitionBy("doc", "page", "band").orderBy("x", "idx")
    apart = F.col("x") - F.lag(F.col("x") + F.col("w")).over(in_band) >= gap
    rows = bands.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("cell", F.sum("_new").over(in_band).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "idx", "text"))), lambda s: s["text"]), " ")
    return rows.groupBy("doc", "page", "band", "cell").agg(joined.alias("text"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))


def tables(cell_rows: DataFrame) -> DataFrame:
    """cells of two or more bands in a row that have two cells or more, with `table` numbered per page."""
    on_page = Window.partitionBy("doc", "page")
    n = F.count("*").over(Window.partitionBy("doc", "page", "band"))
    wide = cell_rows.filter("doc is not null and page is not null and band is not null").withColumn("n", n).filter("n >= 2")
    wide = wide.withColumn("_i", F.col("band") - F.dense_rank().over(on_page.orderBy("band")))
    island = Window.partitionBy("doc", "page", "_i")
    islands = wide.withColumn("_more", F.min("band").over(island) < F.max("band").over(island)).filter("_more")
    numbered = islands.withColumn("table", F.dense_rank().over(on_page.orderBy("_i")) - 1)
    return numbered.select("doc", "page", "band", *(c for c in cell_rows.columns if c not in ("doc", "page", "band")), "table")


def nearest_column(values: DataFrame, columns: DataFrame) -> DataFrame:
    """values (doc, page, value_id, x) with the column (doc, page, column_id, x) of their page nearest in x."""
    held = columns.groupBy("doc", "page").agg(F.collect_list(F.struct("column_id", F.col("x").alias("cx"))).alias("_columns"))
    rows = dealt(values, "doc", "page").join(held.hint("merge"), ["doc", "page"])
    near = F.array_min(F.transform("_columns", lambda c: F.struct(F.abs(F.col("x") - c["cx"]).alias("d"), c["column_id"].alias("column_id"))))
    return rows.withColumn("_near", near).groupBy("doc", "page", "value_id").agg(F.min("_near")["column_id"].alias("column_id"))


def merged_box(fragments: DataFrame, keys: list[str]) -> DataFrame:
    return fragments.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))

"""Upserts, queue outcomes and community totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(current: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """current with incoming merged by key: of equal keys the first in `order` stays; incoming beats current on a tie."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(rows, key, [*order, F.desc("_new")]).drop("_new")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def totals(rows: DataFrame, key: str, kinds: dict[str, Column]) -> DataFrame:
    """Per key how many rows each condition holds for."""
    return rows.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))


def publish_status(outcome: Column) -> Column:
    return F.when(outcome.isin("published", "already_exists_evidence_added", "already_exists", "would_publish"), "resolved").when(outcome == "review_required", "needs_review").otherwise("rejected")


def routed(maker: Column, family: Column, route: Column, attempts: Column, error: Column) -> Column:
    """What becomes of a queue row: needs_review without maker, family or route or after three attempts; retry on
    network errors before that."""
    network = F.coalesce(error.rlike("(?i)timeout|network|fetch|econn|socket|5[0-9][0-9]"), F.lit(False))
    return F.when(maker.isNull() | family.isNull() | route.isNull() | (attempts > 3), "needs_review").when(error.isNull(), "processing").when(network & (attempts < 3), "retry").otherwise("needs_review")


def dimension_keys(names: DataFrame, known: DataFrame, name_col: str = "name") -> DataFrame:
    """name_key, id of names not yet known: the id is a hash of the normalised name, so it needs no sequence."""
    key = F.regexp_replace(F.lower(name_col), "[^a-z0-9]", "")
    rows = names.select(key.alias("name_key")).filter("name_key <> ''").distinct().join(known.select("name_key"), "name_key", "left_anti")
    return rows.withColumn("id", F.xxhash64("name_key"))

"""Mixing sources to target weights by temperature.

Source shares of the tokens are raised to an exponent and normalised. The exponent is bisected until the weights reach a
target entropy, or until no source is repeated more often than allowed, whichever flattens less. The weights become
budgets, and each source fills its budget with block permutations: every epoch deals its documents into blocks by a
seeded hash, takes whole blocks in order, and cuts the last one by the hash inside it.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Blocks that one source's epoch is dealt into.
BLOCKS = 1024
#: Up to so many sources the plan (a few dozen bytes each) is broadcast; beyond, it is joined by source and salt.
BROADCAST_SOURCES = 50_000
SALTS = 64
STEPS = 40


def token_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_totals(docs: DataFrame, source_col: str, tokens: Column) -> DataFrame:
    """Tokens and documents of each source; a null source is one of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs"))


def weights(totals: DataFrame, exponent: float) -> DataFrame:
    """totals with share and weight (share ** exponent, normalised). Sources without tokens have weight 0."""
    total = totals.agg(F.sum("tokens")).first()[0]
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.lit(total).cast("long")), F.lit(0.0))
    powered = F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    rows = totals.withColumn("share", share).withColumn("powered", powered)
    z = rows.agg(F.sum("powered")).first()[0]
    return rows.withColumn("weight", F.coalesce(F.try_divide("powered", F.lit(z).cast("double")), F.lit(0.0))).drop("powered")


def _flatness(totals: DataFrame, exponent: float) -> tuple[float, float]:
    """Entropy in bits of the weights, and how often the most repeated source is repeated if none is cut.

    Two small aggregates over the table of sources: no source is collected.
    """
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return 0.0, 1.0
    p = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent))
    # entropy of p / sum(p) = log2(sum p) - sum(p log2 p) / sum p
    row = totals.filter("tokens > 0").agg(F.sum(p).alias("z"), F.sum(p * F.log2(p)).alias("e"), F.max(p / F.col("tokens")).alias("high"), F.min(p / F.col("tokens")).alias("low")).first()
    return log2(row.z) - row.e / row.z, row.high / row.low


def exponent(totals: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The largest exponent in [0, 1] that meets the target entropy, but none so small that a source is repeated more
    often than max_repetition when the least repeated is taken once. Without a target: the smallest the limit allows."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        entropy, repetition = _flatness(totals, middle)
        too_flat = (max_repetition is not None and repetition > max_repetition) or (target_entropy is not None and entropy > target_entropy)
        low, high = (middle, high) if too_flat else (low, middle)
        if high - low < 1e-6:
            break
    return high


def _place(key: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, key)


def _block(place: Column) -> Column:
    return F.pmod(place, F.lit(BLOCKS))


def plan(rows: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: int | None, seed: int) -> DataFrame:
    """For rows (source, key, n), per source: tokens, share, weight, target (its budget), epochs taken whole, and where the last one is cut.

    Blocks before last_block are taken whole; of last_block, the documents up to last_place.
    Without a budget it is the least that takes every document once.
    """
    totals = saved(source_totals(rows, "source", F.col("n")), "sources")
    alpha = exponent(totals, target_entropy, max_repetition)
    weighted = weights(totals, alpha).withColumn("exponent", F.lit(alpha))
    whole = F.lit(weighted.agg(F.max(F.try_divide(F.col("tokens").cast("double"), F.col("weight")))).first()[0]).cast("double")
    target = F.col("weight") * (F.lit(float(budget)) if budget is not None else whole)
    # rounded to whole tokens, so that a source taken once is taken whole
    weighted = weighted.withColumn("target", F.coalesce(F.round(target), F.lit(0.0)).cast("long"))
    weighted = weighted.withColumn("whole_epochs", F.coalesce(F.floor(F.try_divide(F.col("target").cast("double"), F.col("tokens"))), F.lit(0)).cast("long"))
    weighted = saved(weighted.withColumn("rest", F.col("target") - F.col("whole_epochs") * F.col("tokens")), "weights")
    few = weighted.count() <= BROADCAST_SOURCES
    rest = weighted.filter("rest > 0").select("source", "whole_epochs", "rest")
    cut = _with_plan(rows, rest, few).withColumn("place", _place(F.col("key"), F.col("whole_epochs"), seed)).withColumn("block", _block(F.col("place")))
    blocks = cut.groupBy("source", "block", "rest").agg(F.sum("n").alias("n"))
    in_source = Window.partitionBy("source").orderBy("block")
    blocks = blocks.withColumn("before", F.sum("n").over(in_source) - F.col("n"))
    last = blocks.filter("before < rest and before + n >= rest").groupBy("source").agg(F.min(F.struct("block", "before")).alias("last")).select("source", F.col("last.block").alias("last_block"), F.col("last.before").alias("before"))
    last = saved(last, "last")
    # inside the last block: documents in order of place, until the budget is reached
    same = F.col("c.source").eqNullSafe(F.col("l.source")) & (F.col("c.block") == F.col("l.last_block"))
    inside = cut.alias("c").join(F.broadcast(last.alias("l")) if few else last.alias("l"), same).select("c.source", "c.place", "c.n", "c.rest", "l.before", "l.last_block")
    inside = inside.withColumn("until", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("place")) - F.col("n"))
    inside = inside.filter("until < rest").groupBy("source", "last_block").agg(F.max("place").alias("last_place"))
    out = weighted.alias("w").join(inside.alias("i"), F.col("w.source").eqNullSafe(F.col("i.source")), "left")
    return saved(out.select("w.*", "i.last_block", "i.last_place"), "plan")


def _with_plan(rows: DataFrame, plan_: DataFrame, few: bool) -> DataFrame:
    """rows joined with the plan of their source: broadcast where it is small, else by source and salt."""
    source, right = F.col("r.source").eqNullSafe(F.col("p.source")), plan_
    if few:
        return rows.alias("r").join(F.broadcast(right.alias("p")), source).select("r.*", *(f"p.{c}" for c in plan_.columns if c != "source"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.alias("r").join(right.alias("p"), source & (F.col("r.salt") == F.col("p.salt")))
    return joined.select(*(f"r.{c}" for c in rows.columns), *(f"p.{c}" for c in plan_.columns if c != "source"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, max_repetition: float | None = 2.0, budget: int | None = None, seed: int = 0, with_text: bool = True) -> DataFrame:
    """The rows of docs in the mixture, with `epoch`, `block` and `place` (their order inside the source) behind their columns.

    A row comes once for each epoch that takes it. Without a budget every row comes at least once. A null source is a
    source; null and empty texts have no tokens, and rows without tokens come in whole epochs and in the blocks taken;
    a source without any tokens is left out of the weights and its rows come once. Repeated rows are rows of their own
    with the same place. A column of docs named epoch, block or place is replaced. with_text=False leaves text_col out.
    """
    key = F.xxhash64(id_col, text_col)
    extra = [c for c in docs.columns if c not in ("epoch", "block", "place") and (with_text or c != text_col)]
    counted = saved(docs.select(F.col(source_col).alias("source"), key.alias("key"), token_count(F.col(text_col)).alias("n")), "counted")
    p = plan(counted, target_entropy, max_repetition, budget, seed)
    few = p.count() <= BROADCAST_SOURCES
    rows = docs.select(F.col(source_col).alias("source"), key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in extra)).alias("row"))
    columns = p.select("source", "whole_epochs", "last_block", "last_place", "tokens")
    joined = _with_plan(rows, columns, few)
    partial = F.when(F.col("last_block").isNotNull(), F.col("whole_epochs")).otherwise(F.col("whole_epochs") - 1)
    until = F.when(F.col("tokens") > 0, partial).otherwise(F.lit(0)).cast("long")
    epochs = F.when(until >= 0, F.sequence(F.lit(0).cast("long"), until)).otherwise(F.array().cast("array<bigint>"))
    each = joined.withColumn("epoch", F.explode(epochs)).withColumn("place", _place(F.col("key"), F.col("epoch"), seed)).withColumn("block", _block(F.col("place")))
    in_cut = (F.col("block") < F.col("last_block")) | ((F.col("block") == F.col("last_block")) & (F.col("place") <= F.col("last_place")))
    taken = each.filter((F.col("tokens") == 0) | F.col("tokens").isNull() | (F.col("epoch") < F.col("whole_epochs")) | in_cut)
    return taken.select("row.*", "epoch", "block", "place")

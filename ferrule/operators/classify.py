"""Rule-based classification with local negation, fingerprints and incremental change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a, stable_map
from ..functions.text import folded, negated

EXCLUSION = 80


def occurrences(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, area, term, kind, weight, position, negated: where the terms of the rules stand in the texts.

    terms: area, term, kind (include, exclude), weight. Every token of a text that some term starts with is a row with the few
    words from it on and the three before it, and meets those terms: linear in the text, and no text is copied per term. The
    terms' first words are collected; they are part of the rules, not of the texts.
    """
    words = terms.select("area", "term", "kind", "weight", F.split(folded(F.col("term")), " ").alias("words")).withColumn("head", F.get("words", 0)).filter("head <> ''")
    found = words.agg(F.max(F.size("words")), F.collect_set("head")).first()
    longest, heads = found[0] or 1, sorted(found[1])
    rows = texts.select(F.col(id_col).alias("id"), F.filter(F.split(folded(F.col(text_col)), " "), lambda t: t != "").alias("tokens")).filter(F.size("tokens") > 0)
    seen = lambda i: F.struct(
        i.alias("position"), F.get("tokens", i).alias("head"), F.slice("tokens", i + 1, longest).alias("following"), F.slice("tokens", F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3)) + 1).alias("context")
    )
    # only the tokens that some term starts with become rows, with the few words around them
    begins = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i).isin(heads))
    each = rows.select("id", F.explode(F.transform(begins, seen)).alias("t")).select("id", "t.*")
    hits = each.join(words, "head").filter(F.slice("following", 1, F.size("words")) == F.col("words"))
    return hits.select("id", "area", "term", "kind", "weight", "position", negated(F.col("context"), F.size("context") - 1).alias("negated"))


def scores(found: DataFrame, makers: DataFrame | None = None) -> DataFrame:
    """id, area, product_score, n_include, n_exclude, score: every distinct term counts once, at its greatest weight.

    makers: id, area of texts whose manufacturer supports the area (5 more where the product scores 30).
    """
    once = found.filter("not negated").groupBy("id", "area", "term", "kind").agg(F.max("weight").alias("weight"))
    include = F.col("kind") == "include"
    out = once.groupBy("id", "area").agg(
        F.coalesce(F.sum(F.when(include, F.col("weight"))), F.lit(0)).cast("long").alias("product_score"), F.count_if(include).alias("n_include"), F.count_if(~include).alias("n_exclude")
    )
    bonus = F.lit(0)
    if makers is not None:
        out = out.join(makers.select("id", "area").distinct().withColumn("_maker", F.lit(True)), ["id", "area"], "left")
        bonus = F.when((F.col("product_score") >= 30) & F.coalesce("_maker", F.lit(False)), 5).otherwise(0)
    out = out.withColumn("score", (F.col("product_score") + bonus - EXCLUSION * F.col("n_exclude")).cast("long"))
    return out.select("id", "area", "product_score", "n_include", "n_exclude", "score")


def decided(texts: DataFrame, scored: DataFrame, areas: DataFrame, id_col: str) -> DataFrame:
    """id, area, status, confidence, margin, n_accepted: accepted areas ranked by score, number of terms and rule order.

    areas: area, rule_index, min_score. One accepted area is taken, several or none go to review.
    """
    ok = scored.join(areas, "area").filter((F.col("score") >= F.col("min_score")) & (F.col("product_score") > 0) & (F.col("n_exclude") == 0))
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("n_include"), F.asc("rule_index"))
    top = ok.withColumn("n", F.row_number().over(order)).groupBy("id").agg(
        F.max(F.when(F.col("n") == 1, F.col("area"))).alias("area"), F.max(F.when(F.col("n") == 1, F.col("score"))).alias("first"),
        F.max(F.when(F.col("n") == 2, F.col("score"))).alias("second"), F.count("*").alias("n_accepted"),
    )
    rows = texts.select(F.col(id_col).alias("id")).join(top, "id", "left").fillna(0, ["n_accepted"])
    status = F.when(F.col("n_accepted") == 1, "auto_accept").otherwise("shadow_review")
    confidence = F.coalesce(F.least(F.lit(1.0), F.col("first") / 100), F.lit(0.0))
    margin = F.coalesce(F.col("first") - F.coalesce("second", F.lit(0)), F.lit(0)).cast("long")
    return rows.select("id", "area", status.alias("status"), confidence.alias("confidence"), margin.alias("margin"), "n_accepted")


def fingerprint(columns: list[Column], specs: Column | None = None) -> Column:
    """FNV-1a of folded columns and the specs in key order."""
    last = stable_map(specs) if specs is not None else F.lit("{}")
    return F.concat(F.lit("fnv1a-"), fnv1a(F.concat_ws("|", *(folded(c) for c in columns), last)))


def changed(now: DataFrame, before: DataFrame, key: str, version: str) -> DataFrame:
    """now with `change` (new, changed, unchanged): the fingerprint or the rules' version differs from the last run."""
    old = before.select(key, F.col("fingerprint").alias("_old"), F.col("rule_version").alias("_version"))
    rows = now.join(old, key, "left")
    kind = F.when(F.col("_old").isNull(), "new").when((F.col("_old") != F.col("fingerprint")) | (F.col("_version") != version), "changed").otherwise("unchanged")
    return rows.withColumn("change", kind).drop("_old", "_version")


def classified_once(rows: DataFrame, classify, key: str = "fingerprint") -> DataFrame:
    """classify(distinct rows by key) joined back: equal rows are classified once."""
    once = classify(rows.dropDuplicates([key]))
    return rows.join(once.select(key, *(c for c in once.columns if c not in rows.columns)), key)

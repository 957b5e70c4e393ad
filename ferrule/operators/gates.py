"""Quality gates, evidence contracts, identity and grammar rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import djb2
from ..functions.text import trimmed
from .containment import held

#: Evidence classes from strong to weak.
CLASSES = ("cross_validated", "grammar_validated", "literal_occurrence", "inferred", "unknown")


def blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def causes(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def part_gate(number: Column, maker: Column, role: Column, evidence: Column, page: Column, rule: Column, specs: Column, specs_without: Column) -> Column:
    """struct(status, causes): rejected if anything basic is missing, incomplete without specs or if none has evidence."""
    basic = causes({
        "missing part_number": blank(number), "missing manufacturer_name": blank(maker), "part_number_role_not_demonstrated": F.coalesce(role != "PART_NUMBER", F.lit(True)),
        "part_number_evidence_missing": blank(evidence), "part_number_page_missing": F.coalesce(page < 1, F.lit(True)), "part_number_rule_missing": blank(rule),
    })
    n = F.coalesce(specs, F.lit(0))
    later = causes({"no specifications extracted from document": n == 0, "all specifications lack complete evidence": (n > 0) & (specs_without >= n)})
    status = F.when(F.size(basic) > 0, "rejected").when(F.size(later) > 0, "incomplete").otherwise("published")
    return F.struct(status.alias("status"), F.when(F.size(basic) > 0, basic).otherwise(later).alias("causes"))


def spec_gate(value: Column, evidence: Column, page: Column, website: Column, role: Column, attribute: Column, documents: list[str], graph: str) -> Column:
    """struct(pass, causes); documents: attributes that describe a document, graph: pattern of graph or page context."""
    why = causes({
        "empty original_value": blank(value), "missing evidence_text": blank(evidence), "missing evidence_locator": ~website & F.coalesce(page < 1, F.lit(True)),
        "technical_specification_role_not_demonstrated": F.coalesce(role != "TECHNICAL_SPECIFICATION", F.lit(True)), "non_technical_document_attribute": F.lower(trimmed(attribute)).isin(*documents),
        "graph_or_document_context": attribute.rlike(graph) | value.rlike(graph),
    })
    return F.struct((F.size(why) == 0).alias("pass"), why.alias("causes"))


def weakest_class(rows: DataFrame, key: str, class_col: str) -> DataFrame:
    """key, weakest: the weakest evidence class of each key; null if any is null or unknown to the order."""
    order = F.create_map(*(F.lit(x) for i, c in enumerate(CLASSES) for x in (c, i)))
    rank = order[F.col(class_col)]
    out = rows.groupBy(key).agg(F.max(rank).alias("_r"), F.bool_or(rank.isNull()).alias("_u"))
    names = F.array(*(F.lit(c) for c in CLASSES))
    return out.select(key, F.when(~F.col("_u"), F.get(names, F.col("_r"))).alias("weakest"))


def mode_key(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, of equally frequent ones the first in order: pre-aggregated, then one row a value."""
    n = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), F.asc(value)))).filter("_r = 1").drop("_r")


def ranked_ids(docs: DataFrame, family: str, doc_id: str, checkpoint) -> DataFrame:
    """family, doc_id, n: the place of each distinct document in its family by id. Ranges of (family, id) are numbered by
    themselves and then moved on by the counts of those before them, so a large family is many tasks."""
    ranged = docs.select(family, doc_id).filter(F.col(family).isNotNull()).distinct().repartitionByRange(family, doc_id)
    ranged = checkpoint(ranged.withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_part", family).orderBy(doc_id))
    counts = ranged.groupBy(family, "_part").agg(F.count("*").alias("_c"))
    before = counts.select(family, "_part", (F.sum("_c").over(Window.partitionBy(family).orderBy("_part")) - F.col("_c")).alias("_before"))
    return ranged.withColumn("n", inside).join(before, [family, "_part"]).select(family, doc_id, (F.col("n") + F.col("_before")).alias("n"))


def induced_grammar(candidates: DataFrame, family: str, doc_id: str, checkpoint) -> DataFrame:
    """Per family the format of its part numbers, from the first 60 % of its documents (by id, rounded up, one at least),
    and how the rest fares.

    candidates: family, doc_id, position, format, label_type (positive, negative or none), in_title. If half of the first
    documents have a positive label, the format is the most frequent under such labels, else the most frequent in titles
    without a negative label. In each of the rest the first candidate of the format without a negative label is a hit (tp)
    if its own label is positive, else a miss (fn), as no candidate is; none can be wrong (fp), as the label isn't
    negative. Active with tp > 0. grammar_hash is of selector, format and negative formats.
    """
    n = ranked_ids(candidates, family, doc_id, checkpoint)
    sizes = n.groupBy(family).agg(F.max("n").alias("docs"))
    split = sizes.withColumn("_split", F.greatest(F.lit(1), F.ceil(F.col("docs") * F.lit(0.6))))
    rows = candidates.join(n, [family, doc_id]).join(split, family)
    train, positive, negative = F.col("n") <= F.col("_split"), F.col("label_type") == "positive", F.col("label_type") == "negative"
    labelled = rows.filter(train & positive).select(family, doc_id).distinct().groupBy(family).agg(F.count("*").alias("_labelled"))
    selector = split.join(labelled, family, "left").withColumn("selector", F.when(F.coalesce("_labelled", F.lit(0)) >= F.ceil(F.col("_split") * F.lit(0.5)), "positive_label").otherwise("title_format"))
    mode = lambda which, name: mode_key(rows.filter(train & which), [family], "format").select(family, F.col("format").alias(name))
    best = selector.join(mode(positive, "_p"), family, "left").join(mode(F.col("in_title") & ~negative, "_t"), family, "left")
    best = best.select(family, "docs", "_split", "selector", F.when(F.col("selector") == "positive_label", F.col("_p")).otherwise(F.col("_t")).alias("best"))
    against = rows.filter(train & negative).groupBy(family).agg(F.array_join(F.sort_array(F.collect_set("format")), ",").alias("negative_formats"))
    held = rows.join(best.select(family, "best"), family).filter(~train & ~negative & (F.col("format") == F.col("best")))
    first = held.groupBy(family, doc_id).agg(F.min_by("label_type", "position").alias("label_type"))
    hits = first.groupBy(family).agg(F.count_if(positive).alias("tp"))
    out = best.join(hits, family, "left").join(against, family, "left").withColumns({"tp": F.coalesce("tp", F.lit(0)), "negative_formats": F.coalesce("negative_formats", F.lit(""))})
    code = djb2(F.concat_ws("|", "selector", F.coalesce("best", F.lit("")), "negative_formats"))
    return out.select(
        family, "selector", F.coalesce("best", F.lit("")).alias("format"), "negative_formats", F.col("_split").cast("long").alias("n_train"), "tp", F.lit(0).cast("long").alias("fp"),
        (F.col("docs") - F.col("_split") - F.col("tp")).cast("long").alias("fn"), F.when(F.col("tp") > 0, "active").otherwise("pending").alias("status"), code.alias("grammar_hash"),
    )


def evidence_errors(segments: Column) -> Column:
    """Errors of segments array<struct<segment_id, token, evidence_class, document_id, page>>; none means the contract holds."""
    bad = lambda s: causes({"segment_id": blank(s["segment_id"]), "token": blank(s["token"]), "evidence_class": ~F.coalesce(s["evidence_class"].isin(*CLASSES), F.lit(False)), "document_id": blank(s["document_id"]), "page": F.coalesce(s["page"] < 1, F.lit(True))})
    each = F.flatten(F.transform(segments, lambda s, i: F.transform(bad(s), lambda e: F.concat(F.lit("segment["), i.cast("string"), F.lit("]."), e))))
    ids = F.filter(F.transform(segments, lambda s: s["segment_id"]), lambda x: x.isNotNull())
    twice = F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.array(F.lit("duplicate_segment_id"))).otherwise(F.array().cast("array<string>"))
    none = F.when(F.coalesce(F.size(segments), F.lit(0)) <= 0, F.array(F.lit("no_segments"))).otherwise(F.array().cast("array<string>"))
    return F.concat(none, F.coalesce(each, F.array().cast("array<string>")), F.coalesce(twice, F.array().cast("array<string>")))


def alias_matches(labels: DataFrame, aliases: DataFrame, checkpoint, label_col: str = "label") -> DataFrame:
    """label, property, score: the best alias of each distinct label - equal, then inside the label, then around it (labels of
    eight letters or more), longer ones first, then in order. aliases: alias, property.

    Labels and aliases that contain one another are found by the index of grams, in either direction. Labels whose
    normal form is empty and nulls have no alias.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    rows = labels.select(F.col(label_col).alias("label")).filter("label is not null").distinct().withColumn("_l", norm(F.col("label")))
    names = aliases.select("property", norm(F.col("alias")).alias("_a")).filter("_a <> ''").distinct()
    of_labels, of_aliases = rows.select("_l").distinct(), names.select("_a").distinct()
    inside = held(of_labels, of_aliases, checkpoint, "_l", "_l", "_a", "_a")
    around = held(of_aliases, of_labels.filter("length(_l) >= 8"), checkpoint, "_a", "_a", "_l", "_l").select("_l", "_a")
    score = F.when(F.col("_l") == F.col("_a"), 10000).when(F.col("_in"), 5000).otherwise(4000) + F.length("_a")
    either = inside.withColumn("_in", F.lit(True)).unionByName(around.withColumn("_in", F.lit(False))).groupBy("_l", "_a").agg(F.bool_or("_in").alias("_in"))
    best = either.withColumn("score", score).join(names, "_a").groupBy("_l").agg(F.min(F.struct((-F.col("score")).alias("score"), "property")).alias("best"))
    return rows.join(best, "_l").select("label", "best.property", (-F.col("best.score")).alias("score"))

"""Small joins and gates over catalogue records: facets, aliases, canonical attributes, data types, queues and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, number, text, trimmed
from .compare import sided, stated
from .extract import first_of
from .readers import NOISE

#: Words that are units and make no value a word.
UNIT_WORDS = (
    "a", "ma", "ka", "v", "mv", "kv", "w", "kw", "mw", "hz", "khz", "mhz", "ghz", "ohm", "kohm", "mohm", "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "um", "nm", "bar", "mbar", "pa", "kpa", "mpa", "psi",
    "rpm", "deg", "degree", "degrees", "c", "f", "n", "kn", "l", "ml", "s", "ms", "us", "min", "h", "kg", "g", "mg",
)
#: Data types that need a number.
NUMERIC = ("number", "measure", "count")


def faceted(results: DataFrame, categories: list[str], only_published: bool = True, has_specification: bool = False) -> DataFrame:
    """results (validation_state, category, spec_count) that the chosen facets leave; no category chosen means all."""
    out = results.filter("validation_state = 'published'") if only_published else results
    out = out.filter(F.col("category").isin(categories)) if categories else out
    return out.filter("spec_count > 0") if has_specification else out


def _aliases(aliases: DataFrame) -> DataFrame:
    return aliases.select(F.col("code"), F.col("alias"), folded(F.col("alias")).alias("norm")).filter("norm <> ''")


def oriented(pairs: DataFrame, aliases: DataFrame, id_col: str) -> DataFrame:
    """pairs (id_col, left, right) with the alias that one side is or starts with: id_col, code, label, value, orientation.

    The left side is asked first; of several aliases the longest counts, then the first in order. The prefixes of a side that end
    with a word are looked up by key, so there is no comparison of every pair with every alias.
    """
    known = _aliases(aliases)
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, " "))), lambda i: F.array_join(F.slice(F.split(c, " "), F.lit(1), i), " "))
    sides = [pairs.select(id_col, F.lit(i).alias("_side"), F.col(a).alias("label"), F.col(b).alias("value"), F.explode(prefixes(folded(F.col(a)))).alias("norm")) for i, (a, b) in enumerate((("left", "right"), ("right", "left")))]
    hits = sides[0].unionByName(sides[1]).join(known, "norm")
    best = first_of(hits.withColumn("_o", F.struct("_side", -F.length("norm"), "norm", "code")), [id_col], "_o")
    return best.select(id_col, "code", "label", "value", F.when(F.col("_side") == 0, "label_to_value").otherwise("value_to_label").alias("orientation"))


def alias_prefixed(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (id, line_no, line) that start with an alias and go on: id, line_no, code, label, value; the longest alias counts.

    The value is what follows as many characters as the alias has. Buttons, lines over 260 and values over 180 characters go.
    """
    norm = folded(F.col("line"))
    words = F.split(norm, " ")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    rows = rows.filter((norm != "") & (F.length("line") <= 260) & ~F.lower(F.trim("line")).isin(*NOISE) & (F.size(words) > 1)).withColumn("norm", F.explode(heads))
    hits = rows.join(_aliases(aliases), "norm").withColumn("value", F.trim(F.expr("substr(line, length(alias) + 1)"))).filter("value <> '' and length(value) <= 180")
    best = first_of(hits.withColumn("_o", F.struct(-F.length("norm"), "norm", "code")), ["id", "line_no"], "_o")
    return best.select("id", "line_no", "code", F.col("alias").alias("label"), "value")


def canonical(attribute: Column, names: dict[str, str]) -> Column:
    """The canonical name of an attribute, or its folded form where the table has none."""
    key = folded(attribute)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[key], key) if names else key


def aligned(pairs: DataFrame, specs: DataFrame, cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """base_id, candidate_id, attribute, state for every spec of a base: the state of the compared cell with the same canonical
    attribute; without one not_comparable if the candidate has the attribute, else base_only.

    pairs (base_id, candidate_id), specs (part_id, property), cells (base_id, candidate_id, property, state)
    """
    keys = specs.select("part_id", canonical(F.col("property"), names).alias("attribute")).distinct()
    base = pairs.join(keys.withColumnRenamed("part_id", "base_id").hint("merge"), "base_id")
    hit = cells.select("base_id", "candidate_id", canonical(F.col("property"), names).alias("attribute"), "state").groupBy("base_id", "candidate_id", "attribute").agg(F.min("state").alias("state"))
    there = stated(pairs, keys).withColumn("_there", F.lit(True))
    rows = base.join(there, ["candidate_id", "attribute"], "left").join(hit.hint("merge"), ["base_id", "candidate_id", "attribute"], "left")
    return rows.select("base_id", "candidate_id", "attribute", F.coalesce("state", F.when(F.col("_there"), "not_comparable").otherwise("base_only")).alias("state"))


def row_order(pairs: DataFrame, specs: DataFrame) -> DataFrame:
    """base_id, candidate_id, attribute, place: a base's attributes in their order, then those only the candidate has, in its
    order. specs: part_id, ord, attribute."""
    rows = sided(pairs, specs.select("part_id", "ord", "attribute"))
    side = lambda n, c: F.coalesce(F.transform(c, lambda x: F.struct(F.lit(n).alias("side"), x["ord"].alias("ord"), x["attribute"].alias("attribute"))), F.array())
    rows = rows.select("base_id", "candidate_id", F.sort_array(F.concat(side(0, "base"), side(1, "candidate"))).alias("all"))
    first = F.filter("all", lambda x, i: ~F.exists(F.slice("all", F.lit(1), i), lambda y: y["attribute"].eqNullSafe(x["attribute"])))
    rows = rows.select("base_id", "candidate_id", F.posexplode(first).alias("n", "x"))
    return rows.select("base_id", "candidate_id", F.col("x.attribute").alias("attribute"), (F.col("n") + 1).alias("place"))


def has_real_word(c: Column) -> Column:
    """A word of two letters or more that is no unit."""
    plain = F.translate(F.lower(text(c)), "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc")
    return F.exists(F.regexp_extract_all(plain, F.lit(r"[a-z]+(?:[-'][a-z]+)*"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(*UNIT_WORDS))


def typed(values: DataFrame, definitions: DataFrame, ranges: DataFrame) -> DataFrame:
    """values (property, value) with `reason`, null where they pass: numeric properties need a number inside the property's range
    (ranges: property, low, high; none means any), other properties a real word. definitions: property, data_type."""
    rows = values.join(definitions, "property", "left").join(ranges, "property", "left")
    n = number(F.col("value"))
    implausible = (n < F.col("low")) | (n > F.col("high"))
    reason = (
        F.when(F.col("data_type").isin(*NUMERIC) & n.isNull(), "numeric_property_requires_recognizable_number")
        .when(F.col("data_type").isin(*NUMERIC) & F.coalesce(implausible, F.lit(False)), "value_failed_plausibility_rules")
        .when(~F.coalesce(F.col("data_type").isin(*NUMERIC), F.lit(False)) & ~has_real_word(F.col("value")), "categorical_property_requires_real_word_after_unit_filter")
    )
    return rows.withColumn("reason", reason).select(*values.columns, "reason")


def batch_metrics(results: DataFrame, key: str, batch_size: int = 500) -> DataFrame:
    """processed, cache_hits, classified, shadow_review, batches and cache_size of results (key, area, status): equal keys are
    classified once, and each further one is a hit."""
    per_key = results.groupBy(key).agg(F.count("*").alias("n"), F.count("area").alias("_c"), F.count_if(F.col("status") == "shadow_review").alias("_r"))
    sums = per_key.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "_c", "_r")), F.count("*").alias("cache_size"))
    return sums.select(F.col("n").alias("processed"), (F.col("n") - F.col("cache_size")).alias("cache_hits"), F.col("_c").alias("classified"), F.col("_r").alias("shadow_review"), F.ceil(F.col("n") / batch_size).alias("batches"), "cache_size")


def gate_metrics(cases: DataFrame, expected: str, actual: str) -> DataFrame:
    """total, passed, precision, recall, f1: the gate takes passed / total as both precision and recall."""
    out = cases.agg(F.count("*").alias("total"), F.count_if(F.col(expected).eqNullSafe(F.col(actual))).alias("passed"))
    ratio = F.coalesce(F.try_divide(F.col("passed").cast("double"), F.col("total")), F.lit(0.0))
    return out.select("total", "passed", ratio.alias("precision"), ratio.alias("recall"), ratio.alias("f1"))


def longest_values(rows: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """Of each key the longest value, of equally long ones the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.length(value)), *order))).filter("_n = 1").drop("_n")


def queue_head(queue: DataFrame, limit: int) -> DataFrame:
    """The next rows of a queue: highest priority, then oldest, then id."""
    return queue.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(limit)


def allowed_domains(makers: DataFrame) -> DataFrame:
    """maker, domain: official and authorised domains (arrays) as distinct rows, lower case, blank ones dropped."""
    both = F.concat(F.coalesce("official", F.array().cast("array<string>")), F.coalesce("authorized", F.array().cast("array<string>")))
    return makers.select("maker", F.explode(F.transform(both, lambda d: F.lower(F.trim(d)))).alias("domain")).filter("domain <> ''").distinct()


def not_shown(basic: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """basic without what is shown already, by keys in their folded form."""
    fold = lambda df: df.withColumns({f"_{k}": folded(F.col(k)) for k in keys})
    return fold(basic).join(fold(shown).select(*(f"_{k}" for k in keys)).distinct(), [f"_{k}" for k in keys], "left_anti").drop(*(f"_{k}" for k in keys))


def merged_sources(links: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """part_id, source_id, url, origin: sources of a part by its links and then by its evidence, once for each id or, without one, url.

    links and evidence: part_id, source_id, url, ord; sources: source_id, url.
    """
    both = links.withColumn("_o", F.lit(0)).unionByName(evidence.withColumn("_o", F.lit(1)))
    rows = both.join(sources.withColumnRenamed("url", "_u"), "source_id", "left").withColumn("url", F.coalesce("_u", "url"))
    key = F.coalesce(F.col("source_id").cast("string"), "url")
    first = first_of(rows.withColumn("_k", key).filter("_k is not null").withColumn("_s", F.struct("_o", "ord")), ["part_id", "_k"], "_s")
    return first.select("part_id", "source_id", "url", F.when(F.col("_o") == 0, "link").otherwise("evidence").alias("origin"))


def exact_token(document: Column, token: Column) -> Column:
    """Whether the document holds the token between characters that are no ASCII letters or digits."""
    bare = F.concat(F.lit("\x01"), F.upper(text(document)), F.lit("\x01"))
    escaped = F.regexp_replace(F.upper(trimmed(token)), r"([^A-Z0-9])", r"\\$1")
    return (trimmed(token) != "") & F.regexp_like(bare, F.concat(F.lit("[^A-Z0-9]"), escaped, F.lit("[^A-Z0-9]")))

"""Property-by-property comparison and cross-reference decisions. Rules are rows, not code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number, number_range, text, trimmed
from ..sources.tables import dealt

#: Strength of declared relations, strongest first.
RELATIONS = {"official_replacement": 100, "successor": 95, "equivalent": 90, "compatible": 70, "similar": 40}
OVERRIDES = ("official_replacement", "successor", "compatible")


def _key(c: Column) -> Column:
    return F.lower(trimmed(c))


def stated(pairs: DataFrame, specs: DataFrame) -> DataFrame:
    """The specs (part_id, ...) of the parts that pairs have as candidates, by candidate_id.

    Many bases share few candidates, so a join by candidate_id meets hot keys. What it needs is cut down first: Spark then
    broadcasts it where it is small as written, and splits hot keys where it isn't. specs grow with the catalogue and are far larger
    than their file, so their own joins are merges and never broadcast on an estimate.
    """
    wanted = pairs.select("candidate_id").distinct()
    return wanted.join(specs.withColumnRenamed("part_id", "candidate_id").hint("merge"), "candidate_id")


def sided(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """base_id, candidate_id, base, candidate: each pair once with its two parts' rows (part_id, ...) as sorted arrays, null without any.

    Both are dealt by the part before anything is put together, so nothing gathers in the few tasks that read a small file.
    """
    held = dealt(rows, "part_id").groupBy("part_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in rows.columns if c != "part_id")))).alias("candidate"))
    both = dealt(pairs.select("base_id", "candidate_id"), "base_id").distinct()
    both = both.join(stated(both, held), "candidate_id", "left")
    return both.join(held.select(F.col("part_id").alias("base_id"), F.col("candidate").alias("base")).hint("merge"), "base_id", "left")


def matrix(pairs: DataFrame, specs: DataFrame) -> DataFrame:
    """base_id, candidate_id, property, base_value, candidate_value, state: a full outer match inside each pair.

    A part's properties are one array (of equal ones the greatest value counts), so a pair is one row until its cells are known;
    no row is compared with a part outside its pair.
    """
    last = lambda c: F.filter(c, lambda x, i: (i + 1 == F.size(c)) | ~F.get(F.col(c), i + 1)["property"].eqNullSafe(x["property"]))
    rows = sided(pairs, specs.select("part_id", "property", "value")).select("base_id", "candidate_id", last("base").alias("b"), last("candidate").alias("c"))
    same = lambda c, x: F.filter(c, lambda y: y["property"].eqNullSafe(x["property"]))
    value = lambda c, name: c.cast("string").alias(name)
    cell = lambda x, base, candidate: F.struct(x["property"].alias("property"), value(base, "base_value"), value(candidate, "candidate_value"))
    empty = lambda c: F.coalesce(c, F.filter(F.coalesce("b", "c"), lambda x: F.lit(False)))
    rows = rows.withColumns({"b": empty("b"), "c": empty("c")})
    base = F.transform("b", lambda x: cell(x, x["value"], F.get(same("c", x), F.lit(0))["value"]))
    other = F.transform(F.filter("c", lambda x: F.size(same("b", x)) == 0), lambda x: cell(x, F.lit(None), x["value"]))
    both = rows.select("base_id", "candidate_id", F.explode(F.concat(base, other)).alias("x")).select("base_id", "candidate_id", "x.*")
    return both.withColumn("state", cell_state(F.col("base_value"), F.col("candidate_value")))


def cell_state(base: Column, candidate: Column) -> Column:
    blank = lambda c: c.isNull() | (trimmed(c) == "")
    return F.when(blank(base) & blank(candidate), "not_comparable").when(blank(candidate), "base_only").when(blank(base), "candidate_only").when(_key(base) == _key(candidate), "equal").otherwise("different")


def counts(cells: DataFrame) -> DataFrame:
    """Per pair the number of cells in each state; base_only counts as missing."""
    n = lambda s, name: F.count_if(F.col("state") == s).alias(name)
    return cells.groupBy("base_id", "candidate_id").agg(n("equal", "equal"), n("different", "different"), n("base_only", "missing"), n("candidate_only", "candidate_only"), n("not_comparable", "not_comparable"))


def selection_state() -> Column:
    """Of counts(): the state of a pair chosen by hand. candidate_only doesn't block."""
    e, d, m, c, x = (F.col(n) for n in ("equal", "different", "missing", "candidate_only", "not_comparable"))
    return F.when(d > 0, "review").when((e > 0) & (x == 0) & (m == 0), "compatible").when(e + d + m + c + x > 0, "review").otherwise("insufficient")


def rule_state(base: Column, candidate: Column, operator: Column, tolerance: Column) -> Column:
    """equal, different, missing or not_comparable by one rule.

    The text comparison ignores case; tolerances are inclusive and 0 where null; an unknown operator compares nothing.
    """
    blank = base.isNull() | candidate.isNull() | (base == "") | (candidate == "")
    a, b, ra, rb = number(base), number(candidate), number_range(base), number_range(candidate)
    state = lambda ok: F.when(ok, "equal").otherwise("different")
    numeric = a.isNotNull() & b.isNotNull()
    overlap = F.greatest(ra["low"], rb["low"]) <= F.least(ra["high"], rb["high"])
    return (
        F.when(blank, "missing")
        .when(operator == "equal", state(_key(base) == _key(candidate)))
        .when((operator == "range_overlap") & ra.isNotNull() & rb.isNotNull(), state(overlap))
        .when((operator == "gte") & numeric, state(b >= a))
        .when((operator == "lte") & numeric, state(b <= a))
        .when((operator == "within_tolerance") & numeric, state(F.abs(b - a) <= F.abs(a) * F.coalesce(tolerance, F.lit(0.0)) / 100))
        .otherwise("not_comparable")
    )


def rule_results(pairs: DataFrame, specs: DataFrame, rules: DataFrame) -> DataFrame:
    """base_id, candidate_id, family, ord, property, level, state: every active rule of the base's family, rules driving.

    Rules are a small dimension; Spark broadcasts them by their size.
    """
    base = specs.select(F.col("part_id").alias("base_id"), "property", F.col("value").alias("base_value")).hint("merge")
    candidate = stated(pairs, specs.select("part_id", "property", F.col("value").alias("candidate_value")))
    active = rules.filter(F.coalesce(F.col("active"), F.lit(True)))
    rows = pairs.join(active, _key(F.col("base_family")) == _key(F.coalesce(F.col("family"), F.col("base_family"))))
    rows = rows.join(candidate, ["candidate_id", "property"], "left").join(base, ["base_id", "property"], "left")
    state = rule_state(F.col("base_value"), F.col("candidate_value"), F.col("operator"), F.col("tolerance_pct"))
    return rows.select("base_id", "candidate_id", "ord", "property", F.lower(F.coalesce("level", F.lit("supporting"))).alias("level"), state.alias("state"))


def decisions(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """One decision per pair.

    pairs: base_id, candidate_id, base_number, candidate_number, base_family, candidate_family, blocked (reason or null),
    has_evidence, relations array<struct<type, from_number, verified>>.

    The first that holds decides: blocked family, different family, same part number, a critical rule failed (a missing
    value fails it), a required rule failed, anything missing or ungoverned, else equivalent. Then the strongest
    declared relation overrides, whatever was decided; only official_replacement and successor need verified
    evidence, and a relation without a part number holds for any base.
    """
    failed = F.col("state") != "equal"
    of = lambda level: F.col("level") == level
    n = lambda c, name: F.count_if(c).alias(name)
    reason = F.when(of("critical") | of("required"), F.concat(F.upper("level"), F.lit("_"), F.upper("state"), F.lit(":"), F.col("property")))
    reasons = F.array_sort(F.collect_list(F.when(failed & reason.isNotNull(), F.struct("ord", reason.alias("reason")))))
    sums = results.groupBy("base_id", "candidate_id").agg(
        F.count("*").alias("rules"), n(F.col("state").isin("equal", "different"), "compared"), n(F.col("state") == "equal", "equal"), n(F.col("state") == "different", "different"),
        n(F.col("state") == "missing", "missing"), n(F.col("state") == "not_comparable", "not_comparable"), n(of("critical") & failed, "critical_fail"), n(of("critical"), "critical_total"),
        n(of("required") & failed, "required_fail"), n(of("required"), "required_total"), F.transform(reasons, lambda r: r["reason"]).alias("reasons"),
    )
    figures = ["rules", "compared", "equal", "different", "missing", "not_comparable", "critical_fail", "critical_total", "required_fail", "required_total"]
    rows = pairs.join(sums.hint("merge"), ["base_id", "candidate_id"], "left").fillna(0, figures)
    same_family = (_key(F.col("base_family")) != "") & (_key(F.col("base_family")) == _key(F.col("candidate_family")))
    same_number = (_key(F.col("base_number")) != "") & (_key(F.col("base_number")) == _key(F.col("candidate_number")))
    ready = F.when(F.col("critical_total") + F.col("required_total") == 0, "REVIEW_ONLY_NO_GOVERNED_RULES").when(F.col("critical_total") == 0, "REVIEW_ONLY_NO_CRITICAL_RULES").otherwise("READY")
    open_ = (F.col("rules") == 0) | (F.col("missing") > 0) | (F.col("not_comparable") > 0) | (ready != "READY")
    blocked = F.col("blocked").isNotNull()
    technical = (
        F.when(blocked, "SIMILAR_REVIEW").when(~same_family, "NOT_SUBSTITUTABLE").when(same_number, "EXACT").when(F.col("critical_fail") > 0, "NOT_SUBSTITUTABLE")
        .when(F.col("required_fail") > 0, "INSUFFICIENT_EVIDENCE").when(open_ & F.col("has_evidence"), "SIMILAR_REVIEW").when(open_, "INSUFFICIENT_EVIDENCE").otherwise("EQUIVALENT")
    )
    score = F.when(blocked | ~same_family, 0).when(same_number, 100).when(F.col("rules") == 0, 0).otherwise(F.floor(F.try_divide(F.col("equal") * 100, F.col("rules")) + 0.5).cast("int"))
    declared = lambda kind: F.exists(
        F.coalesce("relations", F.array().cast("array<struct<type:string,from_number:string,verified:boolean>>")),
        lambda r: (r["type"] == kind) & (_key(F.coalesce(F.when(r["from_number"] != "", r["from_number"]), F.col("base_number"))) == _key(F.col("base_number"))) & (F.lit(kind == "compatible") | F.coalesce(r["verified"], F.lit(False))),
    )
    override = F.coalesce(*(F.when(declared(k), F.lit(k)) for k in OVERRIDES))
    strength = F.coalesce(*(F.when(override == k, F.lit(RELATIONS[k])) for k in OVERRIDES))
    state = F.when(override.isin("official_replacement", "successor"), "REPLACE").when(override == "compatible", "COMPATIBLE").otherwise(technical)
    empty = F.array().cast("array<string>")
    why = (
        F.when(blocked, F.array("blocked")).when(~same_family, F.array(F.lit("FAMILY_MISMATCH"))).when(same_number, F.array(F.lit("EXACT_PART_NUMBER"))).when(technical == "EQUIVALENT", F.array(F.lit("ALL_ACTIVE_RULES_PASS")))
        .when((F.col("critical_fail") + F.col("required_fail") == 0) & open_, F.concat(F.when(F.col("missing") > 0, F.array(F.lit("MISSING_REQUIRED_COMPARISON_DATA"))).otherwise(empty), F.when(F.col("not_comparable") > 0, F.array(F.lit("NON_COMPARABLE_DATA"))).otherwise(empty)))
        .otherwise(F.coalesce("reasons", empty))
    )
    why = F.when(override.isNotNull(), F.concat(why, F.array(F.concat(F.lit("DECLARED_"), F.upper(override))))).otherwise(why)
    return rows.select("base_id", "candidate_id", state.alias("state"), F.greatest(score, F.coalesce(strength, score)).alias("score"), ready.alias("readiness"), *figures, why.alias("reasons"))


def display_state(state: Column) -> Column:
    """The four states shown to a reader."""
    return F.when(state.isin("EXACT", "REPLACE", "EQUIVALENT", "COMPATIBLE"), "compatible").when(state == "NOT_SUBSTITUTABLE", "not_compatible").when(state == "INSUFFICIENT_EVIDENCE", "insufficient").otherwise("review")


def visible(counted: DataFrame) -> DataFrame:
    """Alternatives without those that were compared and differ in all."""
    return counted.filter(_shown())


def _shown() -> Column:
    return F.coalesce(~((F.col("equal") + F.col("different") > 0) & (F.col("equal") == 0) & (F.col("different") > 0)), F.lit(False))


def verdict(bases: DataFrame, states: DataFrame, counted: DataFrame) -> DataFrame:
    """Per base (base_id) the verdict over the display states of its visible alternatives: insufficient without any.

    counted: counts of the pairs, one row each; a pair without a row there was not compared and stays visible.
    """
    hidden = counted.filter(~_shown()).select("base_id", "candidate_id").hint("merge")
    shown = states.join(hidden, ["base_id", "candidate_id"], "left_anti")
    found = shown.groupBy("base_id").agg(F.bool_or(F.col("display") == "compatible").alias("any_ok"), F.count("*").alias("alternatives"))
    rows = bases.select("base_id").join(found.hint("merge"), "base_id", "left")
    state = F.when(F.col("alternatives").isNull(), "insufficient").when(F.col("any_ok"), "compatible_found").otherwise("review_required")
    return rows.select("base_id", state.alias("verdict"), F.coalesce("alternatives", F.lit(0)).alias("alternatives"))


def same_family_pairs(parts: DataFrame, bases: DataFrame, limit: int) -> DataFrame:
    """For a stated set of bases, the first `limit` parts of their family by part number, without the base itself.

    part_id is unique in both. Each family is ranked once and keeps limit + 1 parts, which is one more than a base can need;
    Spark cuts the rank before the shuffle, so a large family costs no more than a small one. Families are the small side, a row
    each, and are broadcast; on estimates Spark would rather send out all bases, whose file is small.
    """
    order = Window.partitionBy("category").orderBy("part_number", "part_id")
    top = parts.select("category", "part_id", "part_number").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit + 1)
    families = top.groupBy(F.col("category").alias("candidate_family")).agg(F.sort_array(F.collect_list(F.struct("n", "part_id", "part_number"))).alias("first"))
    left = bases.select(F.col("part_id").alias("base_id"), F.col("category").alias("base_family"), F.col("part_number").alias("base_number"))
    rows = left.join(F.broadcast(families), F.col("base_family") == F.col("candidate_family"))
    others = F.slice(F.filter("first", lambda c: c["part_id"] != F.col("base_id")), 1, limit)
    rows = rows.withColumn("c", F.explode(others))
    return rows.select("base_id", "base_family", "base_number", F.col("c.part_id").alias("candidate_id"), "candidate_family", F.col("c.part_number").alias("candidate_number"))


def first_level(levels: Column) -> Column:
    """Of levels array<struct<status, value, parsed, unit>>: 'value unit' of the first normalised one, else of the first parsed."""
    shown = lambda l, v: F.trim(F.concat_ws(" ", v, l["unit"]))  # noqa: E731,E741
    normal = F.transform(F.filter(levels, lambda l: (l["status"] == "normalized") & l["value"].isNotNull()), lambda l: shown(l, l["value"]))  # noqa: E741
    parsed = F.transform(F.filter(levels, lambda l: l["parsed"].isNotNull()), lambda l: shown(l, l["parsed"]))  # noqa: E741
    return F.coalesce(F.get(normal, 0), F.get(parsed, 0))


def score_ring(equal: Column, compared: Column) -> Column:
    """Whole per cent of equal among compared; null without any."""
    return F.floor(F.try_divide(equal * 100, compared) + 0.5).cast("int")


def labelled(properties: DataFrame, labels: DataFrame, language: str) -> DataFrame:
    """properties with a label: in the language, else Spanish, else English, else the code."""
    wide = labels.groupBy("property").agg(*(F.max(F.when(F.col("language") == x, F.col("label"))).alias(f"_{x}") for x in dict.fromkeys((language, "es", "en"))))
    names = [F.col(f"_{x}") for x in dict.fromkeys((language, "es", "en"))]
    return properties.join(wide, "property", "left").withColumn("label", F.coalesce(*names, text(F.col("property")))).drop(*(f"_{x}" for x in (language, "es", "en")))

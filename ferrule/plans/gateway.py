"""The gateway's modes: one function each, over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import part_key
from ..operators import compare, images, search
from ..sources.tables import from_options

MAX_AREA, MAX_COMPARE, MAX_SELECTION = 20, 10, 4


def search_mode(parts: DataFrame, query: str, limit: int | None = None, manufacturer: str | None = None, fallback: DataFrame | None = None, specs: DataFrame | None = None) -> DataFrame:
    """Ranked parts; where there are none, ranked rows of the fallback. provenance says which."""
    only = lambda df: df.filter(F.lower("manufacturer") == manufacturer.lower()) if manufacturer else df
    found = search.ranked(only(parts), query, limit, specs=specs)
    return from_options(found, search.ranked(only(fallback), query, limit)) if fallback is not None else found.withColumn("provenance", F.lit("primary"))


def part_mode(parts: DataFrame, part_id: int, image_rows: DataFrame, families: DataFrame) -> DataFrame:
    """One part with its best image and family name."""
    one = images.attach(parts.filter(F.col("part_id") == part_id), image_rows, F.col("is_primary"), F.col("verified_at"), F.col("created_at"))
    return one.join(families, "category", "left").withColumn("family_name", F.coalesce("family_name", "category"))


def browse_mode(parts: DataFrame, category: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of a category's live parts (archived_at null, status candidate or verified) with has_more."""
    live = parts.filter((F.col("category") == category) & F.col("archived_at").isNull() & F.col("status").isin("candidate", "verified"))
    return search.page(live, [F.col("part_number"), F.col("part_id")], limit, offset)


def area_mode(parts: DataFrame, areas: DataFrame, area: str, limit: int | None = None) -> DataFrame:
    """The first parts of an area (areas: category, area), at most 20."""
    rows = parts.join(areas.filter(F.col("area") == area), "category")
    return rows.orderBy("part_number", "part_id").limit(search.clamp(limit, most=MAX_AREA))


def labels_mode(specs: DataFrame, labels: DataFrame, language: str = "es") -> DataFrame:
    return compare.labelled(specs.select("property").distinct(), labels, language)


def compare_mode(parts: DataFrame, specs: DataFrame, part_number: str, limit: int = 3) -> DataFrame:
    """Counts and state of the visible alternatives of a part's family; the first part with the number is the base."""
    base = parts.filter(F.lower("part_number") == part_number.lower()).orderBy("part_id").limit(1)
    pairs = compare.same_family_pairs(parts, base, search.clamp(limit, 3, MAX_COMPARE))
    counts = compare.counts(compare.matrix(pairs.select("base_id", "candidate_id"), specs))
    return compare.visible(counts).withColumn("state", compare.selection_state())


def selection_mode(parts: DataFrame, specs: DataFrame, part_ids: list[int]) -> DataFrame:
    """The first of two to four chosen parts against the others."""
    if not 2 <= len(dict.fromkeys(part_ids)) <= MAX_SELECTION:
        raise ValueError("two to four different parts are compared")
    first, *others = dict.fromkeys(part_ids)
    pairs = parts.filter(F.col("part_id").isin(others)).select(F.lit(first).cast("long").alias("base_id"), F.col("part_id").alias("candidate_id"))
    return compare.counts(compare.matrix(pairs, specs)).withColumn("state", compare.selection_state())


def reference_mode(parts: DataFrame, specs: DataFrame, category: str, requirements: dict[str, str], limit: int = 10) -> DataFrame:
    """Parts of a category by how many of the requirements their specs equal; nothing is stored."""
    spark = parts.sparkSession
    wanted = spark.createDataFrame([(k, v) for k, v in requirements.items() if k.strip() and v.strip()], "property string, wanted string")
    rows = parts.filter(F.col("category") == category).select("part_id", "part_number").join(specs.select("part_id", "property", "value"), "part_id").join(wanted, "property")
    equal = F.count_if(compare.cell_state(F.col("wanted"), F.col("value")) == "equal")
    out = rows.groupBy("part_id", "part_number").agg(equal.alias("equal"), F.count("*").alias("compared"))
    return out.withColumn("score", compare.score_ring(F.col("equal"), F.col("compared"))).orderBy(F.desc("equal"), F.desc("score"), F.asc("part_number")).limit(search.clamp(limit))


def decision_status(decision: Column, state: Column, status: Column, eligible: Column) -> Column:
    """Of a decision's fields the first that is set; else by its eligibility."""
    return F.coalesce(decision, state, status, F.when(eligible, "eligible").otherwise("not_eligible"))


def use_cases_mode(use_cases: DataFrame, parts: DataFrame) -> DataFrame:
    """use_cases (use_case, category) with the number of parts each reaches."""
    n = parts.groupBy("category").agg(F.count("*").alias("n"))
    return use_cases.join(n, "category", "left").groupBy("use_case").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_parts"))


def known_part(parts: DataFrame, number: str) -> DataFrame:
    """Parts whose number is the same in the form in which numbers are compared."""
    return parts.filter(F.col("part_key") == part_key(F.lit(number)))


def known_parts(asked: DataFrame, parts: DataFrame, number_col: str) -> DataFrame:
    """asked with part_id of the part with that number, whatever its case; of several parts the one with the least id. Unknown and null numbers go."""
    first = parts.groupBy(F.lower("part_number").alias("_number")).agg(F.min("part_id").alias("part_id"))
    return asked.join(first, F.lower(number_col) == F.col("_number")).drop("_number")

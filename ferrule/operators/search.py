"""Search scores, ranking, suggestions, facets and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import part_key, text, trimmed

#: What each kind of match is worth.
SCORES = {"exact": 1000, "key": 950, "prefix": 900, "contains": 800, "maker": 700, "maker_part": 600, "all": 650, "number_token": 550, "text_all": 500, "specs": 400, "category_all": 450, "text_some": 300, "category_some": 250, "maker_token": 200}
DEFAULT_LIMIT, MAX_LIMIT = 10, 50


#: How sure a state is, above and below unknown ones, and the collation in which part numbers come.
STATES = {"published": 3, "validated": 2, "incomplete": 1, "processed": 0, "rejected": -1}
LOCALE = "UNICODE"


def state_rank(state: Column) -> Column:
    return F.coalesce(*(F.when(state == k, F.lit(n)) for k, n in STATES.items()), F.lit(0))


def clamp(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    """The limit a caller gets: the default without one, at least 1, at most `most`."""
    return min(max(int(limit or default), 1), most)


def _tokens(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\s,;]+", query.lower()) if len(t) > 1]


def score(query: str, spec_hits: Column | None = None) -> Column:
    """struct(score, match) of columns part_number, part_key, manufacturer, category, description.

    A ladder: the highest rung that holds wins, in case of a tie the earlier one. The query is a constant, so all of it
    folds into one projection. A token of separators only has an empty key, which every part key contains.
    """
    raw = query.strip()
    if not raw:
        return F.struct(F.lit(0).alias("score"), F.lit("none").alias("match"))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    number, key, maker, category, description = low("part_number"), F.coalesce(F.col("part_key"), F.lit("")), low("manufacturer"), low("category"), low("description")
    q, words, s = F.lit(raw.lower()), _tokens(raw), SCORES
    total = lambda conditions: sum((c.cast("int") for c in conditions), F.lit(0))
    in_number = [number.contains(t) | key.contains(part_key(F.lit(t))) for t in words]
    fields = [a | maker.contains(t) | category.contains(t) | description.contains(t) for a, t in zip(in_number, words, strict=True)]
    n, hits = len(words), lambda c: total([c.contains(t) for t in words])
    rungs = [
        ((number != "") & (number == q), s["exact"], "part_number_exact"),
        ((key != "") & (key == part_key(F.lit(raw))), s["key"], "part_number_normalized"),
        (number.startswith(q), s["prefix"], "part_number_prefix"),
        (number.contains(q), s["contains"], "part_number_contains"),
        (maker == q, s["maker"], "manufacturer_exact"),
        (maker.contains(q), s["maker_part"], "manufacturer_contains"),
    ]
    if words:
        rungs += [
            (total(fields) == n, s["all"] + 5 * n, "all_query_tokens"),
            ((total(fields) < n) & (total(in_number) > 0), s["number_token"] + 10 * total(in_number), "part_number_token"),
            (hits(description) == n, s["text_all"] + n, "description_all_tokens"),
            (hits(description).between(1, n - 1), s["text_some"] + hits(description), "description_partial"),
            (hits(category) == n, F.lit(s["category_all"]), "category_all_tokens"),
            (hits(category).between(1, n - 1), F.lit(s["category_some"]), "category_partial"),
            (hits(maker) > 0, s["maker_token"] + hits(maker), "manufacturer_token"),
        ]
        if spec_hits is not None:
            rungs.append((spec_hits > 0, s["specs"] + F.least(spec_hits, F.lit(10)), "specification_text"))
    each = [F.struct(F.when(c, v if isinstance(v, Column) else F.lit(v)).otherwise(0).cast("int").alias("score"), F.lit(-i).alias("rung"), F.lit(m).alias("match")) for i, (c, v, m) in enumerate(rungs)]
    best = F.array_max(F.array(*each))
    return F.struct(best["score"].alias("score"), F.when(best["score"] > 0, best["match"]).otherwise("none").alias("match"))


def spec_hits(specs: DataFrame, query: str) -> DataFrame:
    """part_id and the number of its specs whose text holds a token of the query."""
    text = F.lower(F.concat_ws(" ", "property", "value"))
    found = [text.contains(t) for t in _tokens(query)]
    if not found:
        return specs.limit(0).groupBy("part_id").agg(F.count("*").alias("spec_hits"))
    hit = found[0]
    for f in found[1:]:
        hit = hit | f
    return specs.filter(hit).groupBy("part_id").agg(F.count("*").alias("spec_hits"))


def ranked(parts: DataFrame, query: str, limit: int | None = None, offset: int = 0, specs: DataFrame | None = None, state_rank: Column | None = None) -> DataFrame:
    """The page of best matches: score, then state, then part number in the order of its letters, not of its bytes. Top-k per task, so nothing is sorted whole."""
    rows = parts
    if specs is not None:
        rows = parts.join(spec_hits(specs, query), "part_id", "left")
    s = score(query, F.coalesce(F.col("spec_hits"), F.lit(0)) if specs is not None else None)
    rows = rows.withColumn("_s", s).filter("_s.score > 0").withColumn("_state", state_rank if state_rank is not None else F.lit(0))
    out = rows.select(*parts.columns, "_s.score", "_s.match", "_state").orderBy(F.desc("score"), F.desc("_state"), F.collate("part_number", LOCALE).asc(), F.asc("part_number"))
    return (out.offset(offset) if offset else out).limit(clamp(limit)).drop("_state")


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of rows with has_more: one row beyond the page is looked at."""
    n = clamp(limit)
    ahead = rows.orderBy(*order).offset(offset).limit(n + 1)
    number = F.row_number().over(Window.orderBy(*order))
    seen = ahead.withColumn("_n", number).withColumn("has_more", F.count("*").over(Window.partitionBy()) > n)
    return seen.filter(F.col("_n") <= n).drop("_n")


def facets(page_rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n over a returned page."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return page_rows.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def suggestions(parts: DataFrame, query: str, most: int = 8) -> DataFrame:
    """label, type, score: parts whose number equals the query in the form of comparison (300), starts with it (250) or
    whose manufacturer does (200), and manufacturers that start with it (80). A query under two characters has none."""
    q, key = query.strip().lower(), part_key(F.lit(query))
    number, maker = F.lower(text(F.col("part_number"))), F.lower(text(F.col("manufacturer")))
    worth = F.when((key != "") & (part_key(F.col("part_number")) == key), 300).when(number.startswith(q), 250).when(maker.startswith(q), 200)
    named = parts.select(F.when(number != "", F.col("part_number")).otherwise(F.col("manufacturer")).alias("label"), F.lit("part").alias("type"), worth.alias("score"))
    makers = parts.filter(maker.startswith(q)).select(F.col("manufacturer").alias("label"), F.lit("manufacturer").alias("type"), F.lit(80).alias("score"))
    rows = named.unionByName(makers).filter(F.col("score").isNotNull() & (F.col("label") != "") & F.lit(len(q) >= 2))
    return rows.groupBy("type", F.lower("label").alias("_l")).agg(F.min("label").alias("label"), F.max("score").alias("score")).drop("_l").orderBy(F.desc("score"), F.asc("label")).limit(most)


def relevance(query: str, title: Column, maker: Column, snippet: Column, url: Column) -> Column:
    """Sum over the query's tokens of the first field that holds each (80, 65, 45, 35); of several tokens all must hit."""
    words = [w for w in _tokens(query)]
    fields = ((title, 80), (maker, 65), (snippet, 45), (url, 35))
    each = []
    for t in words:
        c = F.lit(0)
        for field, worth in reversed(fields):
            c = F.when(F.lower(F.coalesce(field, F.lit(""))).contains(t), worth).otherwise(c)
        each.append(c)
    total = sum(each, F.lit(0))
    if len(words) > 1:
        for e in each:
            total = F.when(e == 0, 0).otherwise(total)
    return total


def best_per(rows: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def looks_industrial(query: Column, context: str, blocked: str) -> Column:
    """The query gate with its vocabularies as patterns: context wins over the block list."""
    q = trimmed(query)
    return (q == "") | q.rlike(f"(?i){context}") | ~q.rlike(f"(?i){blocked}")

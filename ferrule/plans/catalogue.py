"""The catalogue's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..operators import classify, compare, crawl, extract, gates, images, ingest, search
from ..sources.shared import checkpointed
from ..sources.tables import parts, specs, table

QUERY = "blue bolt Brand#1"
#: Small dimensions of the queries: stated rows, as a curator would keep them.
RULES = [("SMALL", 1, "size", "critical", "within_tolerance", 10.0), ("SMALL", 2, "range", "required", "range_overlap", None), ("SMALL", 3, "brand", "supporting", "equal", None), ("LARGE", 1, "size", "critical", "gte", None), ("LARGE", 2, "name", "required", "equal", None), ("PROMO", 1, "size", "required", "lte", None)]
RULE_COLUMNS = "family string, ord int, property string, level string, operator string, tolerance_pct double"
TERMS = [
    ("news", "the", "include", 10), ("news", "of the", "include", 25), ("news", "que la", "exclude", 0), ("story", "la", "include", 20), ("story", "de la", "include", 30),
    ("story", "der", "exclude", 0), ("report", "der", "include", 20), ("report", "und", "include", 20), ("report", "in der", "include", 15), ("report", "the", "exclude", 0),
]
AREAS = [("news", 0, 35), ("story", 1, 35), ("report", 2, 35)]
ALIASES = [("widget", "body"), ("small widget", "small_body"), ("bolt", "fastener"), ("ring", "seal"), ("large gear wheel assembly", "drive"), ("blue", "colour")]
ROBOTS = [("disallow", "/en/"), ("allow", "/en/6"), ("disallow", "/fr/8"), ("allow", "/fr/825"), ("disallow", "/de/1"), ("allow", "/de/1")]
#: Path parts below the seed's that a crawl goes down: the reference's default.
MAX_DEPTH = 5
AREA_DOMAIN = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "UNUSED"]
COMMON = ["the", "of", "and", "de", "la", "der", "que", "is", "in", "to"]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_COLUMNS).withColumn("active", F.lit(True))


def long(c: str | object) -> object:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def norm_part_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    return p.select("part_id", "part_key", t.looks_like_part_number(F.col("part_number")).alias("looks_like_part"), t.identifier_signature(F.col("part_number")).alias("signature"), t.alnum_key(F.col("part_number")).alias("alnum_key"))


def split_value_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" <"), F.col("p_size").cast("string"), F.lit(",5 VDC "))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit("mm"))).otherwise(F.concat(F.lit("M"), F.col("p_size").cast("string")))
    s = t.split_value_unit(raw)
    return p.select(F.col("p_partkey").alias("part_id"), s["value"].alias("value"), t.normalize_unit(s["unit"]).alias("unit"), t.number(raw).alias("number"))


def tokenise_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("tokens"))
    return d.select("doc_id", long(F.size("tokens")).alias("n_tokens"), long(F.size(F.array_distinct("tokens"))).alias("n_distinct"))


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "area string, term string, kind string, weight int")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.occurrences(table(spark, sf_dir, "documents"), _terms(spark), "doc_id")


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _occurrences(spark, sf_dir)
    return found.groupBy(F.col("id").alias("doc_id"), "area", "term").agg(F.count("*").alias("n_hits"), F.count_if("negated").alias("n_negated"), long(F.min("position")).alias("first_position"))


def classify_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.scores(_occurrences(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def classify_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = spark.createDataFrame(AREAS, "area string, rule_index int, min_score int")
    out = classify.decided(table(spark, sf_dir, "documents"), classify.scores(_occurrences(spark, sf_dir)), areas, "doc_id")
    return out.select(F.col("id").alias("doc_id"), "area", "status", "confidence", "margin", "n_accepted")



def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.score(QUERY)
    return parts(spark, sf_dir).select("part_id", long(s["score"]).alias("score"), s["match"].alias("match"))


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.ranked(parts(spark, sf_dir), QUERY, limit=20)
    return out.select("part_id", "part_number", long("score").alias("score"), "match")


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).filter("category = 'SMALL'").select("part_id", "part_number")
    return search.page(p, [F.col("part_number")], limit=15, offset=30)


def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(search.ranked(parts(spark, sf_dir), QUERY, limit=50), ["manufacturer", "category"])


def suggest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.suggestions(parts(spark, sf_dir), "brand#1")
    return out.select("label", "type", long("score").alias("score"))


def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    r = search.relevance("blue promo", F.col("description"), F.col("manufacturer"), F.col("category"), F.col("part_number"))
    return p.select("part_id", long(r).alias("relevance"))


def best_image_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_id"), F.concat_ws("/", F.lit("img"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("url"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("at"))
    best = search.best_per(li, "part_id", [(F.col("flag") == "R").desc(), F.desc("at"), F.asc("url")])
    return parts(spark, sf_dir).select("part_id").join(best.select("part_id", "url"), "part_id", "left")


def family_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = spark.createDataFrame([("SMALL", "Small parts"), ("LARGE", "Large parts"), ("PROMO", "Offers")], "category string, family_name string")
    p = parts(spark, sf_dir).join(families, "category", "left")
    return p.select("part_id", F.coalesce("family_name", "category").alias("family_name"))


def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([("size", "de", "Größe"), ("size", "es", "Tamaño"), ("brand", "es", "Marca"), ("range", "en", "Range")], "property string, language string, label string")
    s = specs(spark, sf_dir).groupBy("property").agg(F.count("*").alias("n"))
    return compare.labelled(s, labels, "de")


def spec_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs(spark, sf_dir)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the first three others of its family."""
    p = parts(spark, sf_dir)
    return compare.same_family_pairs(p, p, 3)


def compare_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.matrix(_pairs(spark, sf_dir).select("base_id", "candidate_id"), specs(spark, sf_dir))


def compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compare.counts(compare_matrix(spark, sf_dir))
    return c.withColumn("state", compare.selection_state())


def alternatives_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.visible(compare.counts(compare_matrix(spark, sf_dir))).select("base_id", "candidate_id", "equal", "different")


def rule_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.rule_results(_pairs(spark, sf_dir), specs(spark, sf_dir), _rules(spark)).withColumn("ord", long("ord"))


def crossref_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.when(F.col("candidate_id") % 11 == 0, F.array(F.struct(F.lit("compatible").alias("type"), F.lit(None).cast("string").alias("from_number"), F.lit(False).alias("verified")))).when(
        F.col("candidate_id") % 13 == 0, F.array(F.struct(F.lit("successor").alias("type"), F.col("base_number").alias("from_number"), (F.col("candidate_id") % 2 == 0).alias("verified")))
    )
    blocked = F.when(F.col("base_family") == "MEDIUM", F.lit("BLOCKED_MIXED_FAMILY"))
    pairs = _pairs(spark, sf_dir).withColumns({"blocked": blocked, "has_evidence": F.col("candidate_id") % 2 == 0, "relations": relation})
    out = compare.decisions(pairs, compare.rule_results(pairs, specs(spark, sf_dir), _rules(spark)))
    return out.select("base_id", "candidate_id", "state", compare.display_state(F.col("state")).alias("display"), long("score").alias("score"), "critical_fail", "required_fail", "missing")


def crossref_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = parts(spark, sf_dir).select(F.col("part_id").alias("base_id"))
    return compare.verdict(bases, crossref_state(spark, sf_dir), compare.counts(compare_matrix(spark, sf_dir)))


def alias_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "alias string, property string")
    out = gates.alias_matches(parts(spark, sf_dir), aliases, checkpointed, "description")
    return out.withColumn("score", long("score"))


def fingerprint_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    return p.select("part_id", classify.fingerprint([F.col("part_number"), F.col("description"), F.col("category")]).alias("fingerprint"))


def changed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = fingerprint_fnv(spark, sf_dir)
    old = table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_partkey") % 7 == 0, "fnv1a-0").alias("other"))
    before = now.join(old, "part_id").select("part_id", F.coalesce("other", "fingerprint").alias("fingerprint"), F.when(F.col("part_id") % 9 == 0, "v1").otherwise("v2").alias("rule_version"))
    return classify.changed(now, before, "part_id", "v2").select("part_id", "change")


def page_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", extract.html_title(F.col("html")).alias("title"), t.visible_text(F.col("html")).alias("visible"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.links(table(spark, sf_dir, "pages"), "page_id")
    return out.select(F.col("id").alias("page_id"), long("link_no").alias("link_no"), "href")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("host", urls.host(F.col("url")))
    root = F.concat(F.lit("https://"), F.col("host"), F.lit("/en"))
    return p.select("page_id", "host", urls.registrable(F.col("host")).alias("base"), urls.base_token(F.col("host")).alias("token"), urls.normalized(F.col("url")).alias("normalized"), long(urls.depth_below(F.col("url"), root)).alias("depth"), urls.image_key(F.col("url")).alias("image_key"))


def robots_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    rules = p.select(urls.host(F.col("url")).alias("host")).distinct().crossJoin(F.broadcast(spark.createDataFrame(ROBOTS, "kind string, path string")))
    return crawl.robots_allowed(p, rules, "page_id")


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    edges = checkpointed(crawl.link_edges(p, extract.links(p, "page_id")))
    seeds = p.filter("page_id % 20 = 0").select(urls.normalized(F.col("url")).alias("url"))
    every = edges.select(F.col("dst").alias("url")).union(seeds).filter("url is not null").distinct()
    rules = every.select(urls.host(F.col("url")).alias("host")).distinct().crossJoin(F.broadcast(spark.createDataFrame(ROBOTS, "kind string, path string")))
    allowed = crawl.robots_allowed(every, rules, "url").filter("allowed")
    edges = checkpointed(edges.join(allowed.select(F.col("url").alias("dst")), "dst", "left_semi"))
    # a seed that robots forbid isn't reported, but its links are followed, as in the reference
    out = crawl.frontier(seeds, edges, None, checkpointed, lambda url, seed: crawl.in_scope(url, seed, MAX_DEPTH))
    out = out.join(allowed.select("url"), "url", "left_semi")
    return out.withColumn("depth", long("depth"))


#: Lines of a data sheet behind a document, by the part of that number.
SHEET_LINES = "chr(10) || p_name || ': ' || p_size || ' mm' || chr(10) || 'Price class: none' || chr(10) || 'a b c d e f ' || p_brand || ': 7' || chr(10) || '**Rated ' || p_name || '**' || chr(10) || p_size || case p_size % 4 when 0 then ' bar,' when 1 then ' and more' when 2 then '.5' else ' kg' end || chr(10) || case p_partkey % 3 when 0 then 'Mass' when 1 then 'Mass 2' else '- Notes:' end || chr(10) || p_partkey || ' g' || chr(10) || 'rated ' || p_name || chr(10) || p_size || ' kg'"


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: documents, with the lines of a data sheet behind those whose number is a part's."""
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(SHEET_LINES.replace("chr(10)", "'\\n'")).alias("sheet"))
    return table(spark, sf_dir, "documents").join(lines, "doc_id", "left").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.coalesce("sheet", F.lit(""))).alias("text"))


def kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.colon_pairs(extract.lines(_sheets(spark, sf_dir), "doc_id"))
    return out.select(F.col("id").alias("doc_id"), long("line_no").alias("line_no"), "attribute", "value")


def pipe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    sheet = F.concat(F.lit("**size** | "), F.col("p_size").cast("string"), F.lit(" mm\n|---|---|\n"), F.col("p_name"), F.lit(" | "), F.col("p_brand"), F.lit("\na | b | 3\nsite | https://x.example.com/1"))
    out = extract.pipe_pairs(extract.lines(p.select("p_partkey", sheet.alias("text")), "p_partkey"))
    return out.select(F.col("id").alias("part_id"), long("line_no").alias("line_no"), "attribute", "value")


def adjacent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.bare_lines(_sheets(spark, sf_dir), "doc_id")
    out = extract.adjacent_pairs(rows)
    return out.select(F.col("id").alias("doc_id"), long("line_no").alias("line_no"), "attribute", "value")


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.lines(table(spark, sf_dir, "documents"), "doc_id")
    first = extract.first_of(rows, ["id", F.lower("line")], "line_no")
    return first.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_lines"), long(F.sum("line_no")).alias("sum_positions"))


def readability_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.density(F.col("text"), r"[0-9]+", COMMON)
    out = table(spark, sf_dir, "documents").select("doc_id", d.alias("d"))
    return out.select("doc_id", long("d.chars").alias("chars"), long("d.words").alias("words"), *(F.round(f"d.{c}", 9).alias(c) for c in ("letter_density", "common_ratio", "signal_density")))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    out = ingest.upserted(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return out.select("user_id", "event_type", "event_id", "value")


def community_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = lambda k: F.col("event_type") == k
    return ingest.totals(e, "user_id", {"confirmed": kind("purchase"), "rejected": kind("error"), "viewed": kind("view")})


def outcome_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "purchase", "new").when(F.col("event_type") == "view", "known").when(F.col("event_type") == "click", "rejected").when(F.col("event_type") == "error", "error")
    return crawl.accounted(e.withColumn("outcome", outcome).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], "outcome")


def queue_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    error = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "network timeout").otherwise("bad page"))
    state = ingest.routed(F.when(F.col("user_id") % 10 != 0, "m"), F.lit("f"), F.when(F.col("event_id") % 17 != 0, "r"), F.col("event_id") % 6, error)
    return e.select("event_id", state.alias("state"))


def area_counts_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = parts(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(a,) for a in AREA_DOMAIN], "category string")
    return domain.join(n, "category", "left").fillna(0, ["n"])


def grammar_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).withColumn("format", t.identifier_signature(F.col("part_number")))
    return gates.mode_key(p, ["category"], "format")


def grammar_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    label = F.when((F.col("part_id") % 3 == 0) | (F.col("category") == "SMALL"), "positive").when(F.col("part_id") % 7 == 1, "negative").otherwise("none")
    other = F.struct(F.lit(1).alias("position"), t.identifier_signature(F.concat(F.lit("DS"), (F.col("part_id") % 5).cast("string"))).alias("format"), F.when(F.col("part_id") % 4 == 0, "negative").otherwise("none").alias("label_type"), F.lit(False).alias("in_title"))
    own = F.struct(F.lit(0).alias("position"), t.identifier_signature(F.col("part_number")).alias("format"), label.alias("label_type"), (F.col("part_id") % 2 == 0).alias("in_title"))
    rows = p.select("category", "part_id", F.explode(F.array(own, other)).alias("c")).select("category", "part_id", "c.*")
    return gates.induced_grammar(rows, "category", "part_id", checkpointed)


def weakest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cls = F.when(F.col("l_linenumber") == 1, "cross_validated").when(F.col("l_linenumber") == 2, "grammar_validated").when(F.col("l_linenumber") == 3, "literal_occurrence").when(F.col("l_linenumber") < 7, "inferred").when(F.col("l_quantity") < 49, "unknown")
    return gates.weakest_class(li.withColumn("evidence_class", cls).withColumnRenamed("l_orderkey", "order_id"), "order_id", "evidence_class")


def gate_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    g = gates.part_gate(F.col("p_name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")), F.lit("PART_NUMBER"), F.when(F.col("p_partkey") % 4 != 0, F.lit("e")), F.col("p_size") - 3, F.lit("r"), F.col("p_size") % 3, F.col("p_size") % 2)
    return p.select(F.col("p_partkey").alias("part_id"), g["status"].alias("status"), F.array_join(g["causes"], ",").alias("causes"))


def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(
        F.col("p_partkey").alias("part_id"),
        F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.concat(F.lit(u), (F.col("p_partkey") % k).cast("string"), F.lit(".jpg")).alias("url")) for m, u, k in (("jsonld", "https://img.example.com/a/", 7), ("og", "http://cdn.example.org/logo/", 5), ("part_context", "http://cdn.example.org/px/1x1/", 3), ("html", "https://IMG.example.com/A/", 7), ("markdown", "ftp://x/", 3))))).alias("i"),
        F.col("p_name").alias("context"), F.lit("widget").alias("part_number"), F.lit("blue").alias("manufacturer"),
    )
    out = images.best(rows.select(F.col("part_id").alias("id"), "i.method", "i.url", "context", "part_number", "manufacturer"))
    return out.select(F.col("id").alias("part_id"), "method", "url", long("score").alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        norm_part_number, split_value_unit, tokenise_terms, phrase_hits, classify_scores, classify_margin, search_scores, search_ranked, search_page, search_facets, suggest_topk,
        relevance_scores, best_image_per_part, family_labels, label_fallback, spec_long, compare_matrix, compare_counts, alternatives_visible, rule_eval, crossref_state, crossref_verdict,
        alias_best_match, fingerprint_fnv, changed_parts, page_title_text, page_links, url_parts, robots_longest_match, crawl_frontier, kv_lines, pipe_lines, adjacent_lines, ordered_distinct,
        readability_density, upsert_latest, community_totals, outcome_accounting, queue_routing, area_counts_domain, grammar_mode, grammar_holdout, weakest_class, gate_causes, image_candidates,
    )
    return {f.__name__: f for f in own}

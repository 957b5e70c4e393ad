"""Web results: source classes, content tiers, filters, identity and ranking. Vocabularies are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import is_part_number_query
from ..functions.text import alnum_key, part_key, text, trimmed
from ..functions.urls import base_token, host, in_domain

#: Rank of a source's class, and how many results a search returns.
SOURCES = {"official": 5, "authorized_distributor": 4, "distributor": 3, "web_discovery": 1, "untrusted": 0}
MOST_RESULTS = 20
STRUCTURAL = r"(?<![A-Za-z0-9_])([A-Z]{1,4}-?[0-9][A-Z0-9\-]{1,18})(?![A-Za-z0-9_])"
LABELLED = r"(?i)(?<![A-Za-z0-9_])(?:part\s*(?:number|no\.?|#)|p/n|pn|model\s*(?:number|no\.?)?|mpn|order(?:ing)?\s*(?:number|no\.?|code)|article\s*(?:number|no\.?))\s*[:：]\s*([A-Za-z0-9][A-Za-z0-9\-/.]{2,30})"
NO_PART = r"(?i)^VREF[0-9]*$|^(?:JEP|JESD|IEC|ISO|MIL)[-_]?[0-9]|^[0-9]+(?:\.[0-9]+)?(?:V|MV|KV|A|MA|HZ|KHZ|MHZ|W|MW|OHM|KOHM)$"

#: What pages about a company say, what pages of products say, and what catalogues say.
CORPORATE_HARD = (
    r"(?i)(?:investor relations|investors?|financials?|earnings?|annual report|quarterly report|shareholders?|stock price|press release|newsroom|businesswire|headquarters|company profile|company size|specialties|public company|remote workstation|vpn|careers?|jobs?|"
    r"employee\s*(?:count|number|size)|energy corporation|refining company|refinery company)"
)
CORPORATE_PAGE = (
    r"(?i)(?:about us|about the company|a global manufacturer|global manufacturer|company profile|corporate|headquarters|locations?|careers?|jobs?|investor relations|investors|financials?|earnings?|annual report|quarterly report|shareholders?|stock price|press release|newsroom|contact us|"
    r"our company|who we are|public company|company size|specialties|industry\s*[:\-]|website\s*[:\-]|employee|employees|linkedin|businesswire|remote workstation|vpn|energy corporation|refining company|refinery company)"
)
PRODUCT_RESULT = (
    r"(?i)(?:product|products|catalog|catalogue|datasheet|data sheet|part number|order number|model|series|pneumatic|electromechanical|electrical|automation|actuator|cylinder|valve|sensor|gripper|drive|motor|controller|plc|connector|fitting|regulator|filter|vacuum|component|refaccion|repuesto|componente)"
)
NUMBER_IN_RESULT = r"[A-Za-z]{1,6}[-_]?[0-9][A-Za-z0-9_-]{2,}"
CATALOGUE = (
    r"(?i)(?:catalog(?:ue)?|product\s+(?:catalog|listing|overview|selector)|product\s+family|product\s+line|products?\s*(?:&|and)\s*components|products?\s+(?:selection|portfolio|range|overview|listing)|manufacturer\s+(?:products?|catalog)|\bseries\b|\bfamily\b|\brange\b)"
)


def brand_tokens(query: Column, generic: list[str]) -> Column:
    """The different runs of three letters or more that aren't generic, in order."""
    return F.array_distinct(F.filter(F.split(text(query), "[^A-Za-z]+"), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*generic)))


def is_maker_query(query: Column, generic: list[str]) -> Column:
    """One word with one name in it that isn't built like a part number."""
    words = F.filter(F.split(text(query), r"(?U)\s+"), lambda t: t != "")
    return (F.size(words) == 1) & (F.size(brand_tokens(query, generic)) == 1) & ~is_part_number_query(query)


def is_product_result(title: Column, snippet: Column, url: Column) -> Column:
    """Whether a result for a maker's name is about a product: nothing corporate in it, and a product's word or number."""
    every = F.concat_ws(" ", text(title), text(snippet), text(url))
    return ~every.rlike(CORPORATE_PAGE) & ~every.rlike(CORPORATE_HARD) & (every.rlike(PRODUCT_RESULT) | every.rlike(NUMBER_IN_RESULT))


def is_catalogue(title: Column, snippet: Column, url: Column) -> Column:
    """Whether a result is about a catalogue, family or range, which is no part by itself."""
    return F.concat_ws(" ", text(title), text(snippet), text(url)).rlike(CATALOGUE)


@dataclass(frozen=True)
class Vocabulary:
    """Patterns (case is ignored) that say what a text is about; they come with the catalogue, not with the code."""

    context: str
    blocked: str
    excluded_hosts: str
    corporate_hard: str
    corporate_soft: str
    product: str
    datasheet: str
    family: str
    buy: str
    editorial: str
    editorial_url: str
    part_in_text: str = r"\b[A-Z]{2,6}[-_]?\d{2,}[A-Z0-9-_/]*\b"

    def has(self, name: str, c: Column) -> Column:
        pattern = getattr(self, name)
        return text(c).rlike(pattern if name == "part_in_text" else f"(?i){pattern}")


def with_source(results: DataFrame, policies: DataFrame, distributors: list[str], maker_col: str = "manufacturer") -> DataFrame:
    """results (url, maker_col) with source_type.

    policies: maker_key, kind (official, authorized_distributor), domain. A registered domain of the result's maker
    decides, then the distributors, then a registrable domain that is the maker's name; a part of the name is none.
    """
    key = alnum_key(F.col(maker_col))
    rows = results.withColumn("_h", host(F.col("url"))).withColumn("_m", key)
    hit = rows.select("_h", "_m").distinct().join(policies, F.col("_m") == F.col("maker_key")).filter(in_domain(F.col("_h"), F.col("domain")))
    best = hit.groupBy("_h", "_m").agg(F.max(F.when(F.col("kind") == "official", 2).otherwise(1)).alias("_k"))
    rows = rows.join(best, ["_h", "_m"], "left")
    known = F.lit(False)
    for d in distributors:
        known = known | in_domain(F.col("_h"), F.lit(d))
    kind = (
        F.when(F.col("_h") == "", "untrusted").when(F.col("_k") == 2, "official").when(F.col("_k") == 1, "authorized_distributor").when(known, "distributor")
        .when((key != "") & (key == alnum_key(base_token(F.col("_h")))), "official").otherwise("web_discovery")
    )
    return rows.withColumn("source_type", kind).select(*results.columns, "source_type")


def tier(v: Vocabulary) -> Column:
    """struct(type, tier) of columns title, snippet, url, source_type, part_number, n_specs; the first that holds counts."""
    both = F.concat_ws(" ", "title", "snippet")
    product = v.has("part_in_text", both) | (F.length(trimmed(F.col("part_number"))) >= 3)
    sheet, family, buy, specs = v.has("datasheet", both), v.has("family", both), v.has("buy", both), F.coalesce(F.col("n_specs"), F.lit(0)) > 0
    official, seller = F.col("source_type") == "official", F.col("source_type") == "distributor"
    corporate = v.has("corporate_hard", both) | (v.has("corporate_soft", both) & ~v.has("product", both))
    out = lambda name, n: F.struct(F.lit(name).alias("type"), F.lit(n).alias("tier"))
    return (
        F.when(text(F.col("url")).rlike(r"(?i)\.pdf(?:$|[?#])"), out("datasheet", 5))
        .when(~sheet & v.has("editorial_url", F.col("url")) & v.has("editorial", F.col("title")), out("article_editorial", 1))
        .when(corporate & ~product & ~sheet, out("corporate", 0))
        .when(product & (official | seller | sheet | buy | specs), out("product_page", 5))
        .when(sheet & (official | seller | product | specs), out("technical_catalog", 5))
        .when(seller & (buy | product | family | specs), out("distributor_listing", 4))
        .when(family & (official | seller), out("product_family", 4))
        .when(product | specs, out("product_page", 3))
        .when(v.has("editorial", both) | v.has("editorial", F.col("url")), out("article_editorial", 1))
        .otherwise(out("other_industrial", 2))
    )


def relevant(v: Vocabulary, query: str, is_part_number: bool) -> Column:
    """Filters of results by content: hosts, the block list, then a part-number query or industrial context."""
    every = F.concat_ws(" ", "title", "snippet", "url")
    blocked = v.has("blocked", F.concat_ws(" ", every, F.lit(query)))
    corporate = v.has("corporate_hard", every) | (v.has("corporate_soft", every) & ~v.has("product", every))
    h = host(F.col("url"))
    return (h != "") & ~h.rlike(f"(?i){v.excluded_hosts}") & ~blocked & ~corporate & (F.lit(is_part_number) | v.has("context", every))


def ranked(results: DataFrame, relevance: Column, v: Vocabulary, limit: int = MOST_RESULTS) -> DataFrame:
    """results by relevance, tier, source and the provider's score (columns ord and provider_score), ties by order."""
    t = tier(v)
    source = F.coalesce(*(F.when(F.col("source_type") == k, F.lit(n)) for k, n in SOURCES.items()), F.lit(0))
    rows = results.withColumn("relevance", relevance).withColumn("content_type", t["type"]).withColumn("tier", t["tier"]).withColumn("_s", source)
    return rows.orderBy(F.desc("relevance"), F.desc("tier"), F.desc("_s"), F.desc("provider_score"), F.asc("ord")).limit(limit).drop("_s")


def invalid_part_number(c: Column) -> Column:
    """Without a digit, a reference voltage, a standard or a bare electrical value."""
    s = trimmed(c)
    return (s != "") & (~s.rlike("[0-9]") | s.rlike(NO_PART))


def query_derived(maker: Column, query: Column, generic: list[str]) -> Column:
    """Whether a maker's name is a generic term or a token of the query, whole or as a part of four letters or more."""
    m, raw = alnum_key(maker), F.lower(trimmed(maker))
    tokens = F.transform(F.filter(F.split(text(query), "[^A-Za-z0-9]+"), lambda t: t != ""), lambda t: F.lower(t))
    inside = F.exists(tokens, lambda t: (t == m) | ((F.length(t) >= 4) & (F.length(m) >= 4) & t.contains(m)))
    return (F.length(m) >= 2) & (raw.isin(*generic) | m.isin(*generic) | inside)


def cleaned_identity(results: DataFrame, query: str, generic: list[str]) -> DataFrame:
    """results with manufacturer and part_number emptied where nothing proves them, then set to what identity
    (identity_manufacturer, identity_part_number) has proved.

    A maker equal to the query stays if an official source names it in its text or domain.
    """
    maker, number = F.col("manufacturer"), F.col("part_number")
    m = alnum_key(maker)
    named = alnum_key(F.concat_ws("", "title", "snippet")).contains(m) | (alnum_key(base_token(host(F.col("url")))) == m)
    proved = (F.col("source_type") == "official") & (m != "") & (m == alnum_key(F.lit(query))) & named
    maker = F.when(query_derived(maker, F.lit(query), generic) & ~proved, "").otherwise(text(maker))
    number = F.when(invalid_part_number(number), "").otherwise(text(number))
    same = (alnum_key(maker) != "") & ((alnum_key(maker) == alnum_key(number)) | (alnum_key(maker) == alnum_key(F.col("identity_part_number"))))
    maker = F.when(same, "").otherwise(maker)
    proven = lambda c, other: F.when(text(F.col(c)) != "", F.col(c)).otherwise(other)
    return results.withColumns({"manufacturer": proven("identity_manufacturer", maker), "part_number": proven("identity_part_number", number)})


def identities(docs: DataFrame, makers: list[str], categories: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """Per document (title, text, part_hint): part_numbers (hint, then labelled, then in the title; five at most, distinct
    by key), manufacturer (the first known one that the content names), category (the first pattern that holds) and
    identified."""
    content = F.concat_ws("\n", "title", "text")
    hint = F.when(trimmed(F.col("part_hint")) != "", F.array(trimmed(F.col("part_hint")))).otherwise(F.array().cast("array<string>"))
    every = F.concat(hint, F.regexp_extract_all(content, F.lit(LABELLED), F.lit(1)), F.regexp_extract_all(text(F.col("title")), F.lit(STRUCTURAL), F.lit(1)))
    keys = F.transform(every, part_key)
    first = F.filter(every, lambda x, i: F.array_position(keys, part_key(x)) == i + 1)
    low, bare = F.lower(content), alnum_key(content)
    maker = F.coalesce(*(F.when(low.contains(m.lower()) | bare.contains("".join(c for c in m.lower() if c.isascii() and c.isalnum())), F.lit(m)) for m in makers), F.lit(""))
    corpus = F.concat_ws(" ", "title", F.get(first, 0), maker, F.substring("text", 1, 500))
    category = F.coalesce(*(F.when(corpus.rlike(f"(?i){p}"), F.lit(c)) for c, p in categories.items()), F.lit("general"))
    out = docs.select(F.col(id_col), F.slice(first, 1, 5).alias("part_numbers"), maker.alias("manufacturer"), category.alias("category"))
    known = (F.size("part_numbers") > 0) | ((F.col("manufacturer") != "") & (F.col("category") != "general"))
    return out.withColumn("identified", known)


def identifier_role(label: Column, value: Column, context: Column, bound: Column, labels: list[str], negative: str, excluded: str) -> Column:
    """struct(role, demonstrated, reason): a part label that is bound to the value proves it; a document's label, the
    shape of a measure or a document's context rule it out."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.translate(text(c), "–—", "--"), r"\s+", " ")))
    lab, val, ctx = norm(label), norm(value), norm(context)
    out = lambda role, ok, reason: F.struct(F.lit(role).alias("role"), F.lit(ok).alias("demonstrated"), F.lit(reason).alias("reason"))
    measure = r"^[0-9]+(?:\.[0-9]+)?\s*(?:v|mv|kv|a|ma|ua|hz|khz|mhz|ohm|kohm|mohm|w|mw)$"
    return (
        F.when(lab.isin(*labels) & bound, out("PART_NUMBER", True, "explicit_part_number_label"))
        .when(lab.isin(*labels), out("IDENTIFIER_CANDIDATE", False, "part_label_not_structurally_bound"))
        .when(lab.rlike(negative), out("DOCUMENT_REFERENCE", False, "negative_identifier_label"))
        .when(val.rlike(measure), out("ELECTRICAL_VALUE", False, "value_shape_not_identifier"))
        .when(ctx.rlike(excluded), out("DOCUMENT_REFERENCE", False, "excluded_document_context"))
        .when(lab.isin("device", "component"), out("IDENTIFIER_CANDIDATE", False, "contextual_label_requires_corroboration"))
        .otherwise(out("UNKNOWN", False, "insufficient_semantic_evidence"))
    )


def technical_spec(attribute: Column, value: Column, commercial: str, qualitative: list[str], technical: str, units: list[str]) -> Column:
    """struct(ok, reason): missing, commercial or document data, too long, a proven qualitative attribute, or a technical
    attribute with a number and a unit."""
    a, v = F.lower(F.trim(F.regexp_replace(text(attribute), r"\s+", " "))), trimmed(value)
    number = r"(?i)[<>≤≥+\-±]?\s*[0-9]+(?:[.,][0-9]+)?\s*(?:" + "|".join(units) + r")(?:$|[ ,;/])"
    out = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))
    return (
        F.when((a == "") | (v == ""), out(False, "missing_attribute_or_value"))
        .when(a.rlike(commercial) | F.lower(v).rlike(commercial), out(False, "non_technical_document_or_graph_context"))
        .when((F.length(a) > 100) | (F.size(F.split(a, " +")) > 8), out(False, "attribute_too_long"))
        .when(a.isin(*qualitative), out(True, "demonstrated_qualitative_technical_attribute"))
        .when(a.rlike(f"(?:^|[^a-z])(?:{technical})(?:$|[^a-z])") & v.rlike(number), out(True, "technical_attribute_and_engineering_value"))
        .otherwise(out(False, "insufficient_technical_semantics"))
    )


def expanded(results: DataFrame, found: DataFrame, id_col: str = "ord", most: int = 12) -> DataFrame:
    """Results that are no catalogue pages as they are, and of catalogue pages (is_catalog) one row a proven part
    (found: id_col, part_number, position; the first `most`); a catalogue page without any goes."""
    first = Window.partitionBy(id_col).orderBy("position")
    parts = found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).select(id_col, F.col("part_number").alias("_p"))
    pages = results.filter("is_catalog").drop("part_number").join(parts, id_col).withColumnRenamed("_p", "part_number")
    return results.filter("not is_catalog").unionByName(pages)

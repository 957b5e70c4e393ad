"""The contract of identity evidence: every segment of a part number is proved, and the rules between segments were evaluated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: What the fields of a segment and of a rule between segments may be. An external record is defined, but not yet admitted.
CLASSES, EXTERNAL = ("literal_occurrence", "grammar_validated", "external_record"), "external_record"
VALIDITY, SEMANTICS, STATUS = ("literal", "grammar", "unknown"), ("resolved", "constant_no_legend", "unknown"), ("pass", "fail", "not_applicable")
#: What each class has to name, and the error if it doesn't.
LITERAL = (("document_id", "literal_document_id_missing"), ("document_edition", "literal_document_edition_missing"), ("page", "literal_page_missing"), ("evidence_text", "literal_evidence_text_missing"))
GRAMMAR = (("grammar_id", "grammar_id_missing"), ("grammar_version", "grammar_version_missing"), ("rule_id", "grammar_rule_id_missing"))
#: From weak to strong.
STRENGTH = ("grammar_validated", "literal_occurrence")

SEGMENT = (
    "segment_id: string, token: string, validity: string, semantics: string, evidence_class: string, document_id: string, document_edition: string, page: string, evidence_text: string, "
    "grammar_id: string, grammar_version: string, rule_id: string, supporting_documents: array<struct<document_id: string, edition: string>>"
)
CROSS_RULES = "evaluation_status: string, reason: string, results: array<struct<rule_id: string, status: string>>"

_NONE = "array<string>"


def _blank(c: Column) -> Column:
    return trimmed(c) == ""


def _one_of(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def _codes(*pairs: tuple[Column, str | Column]) -> Column:
    """The codes whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(e) if isinstance(e, str) else e) for c, e in pairs)))


def _page_wrong(c: Column) -> Column:
    n = trimmed(c).try_cast("double")
    return ~F.coalesce((n >= 1) & (n == F.floor(n)), F.lit(False))


def _numbered(prefix: str, i: Column, codes: Column) -> Column:
    return F.transform(codes, lambda e: F.concat(F.lit(prefix), i.cast("string"), F.lit(":"), e))


def _again(items: Column, i: Column, key: str, value: Column) -> Column:
    """Whether an item before the i-th has the value, which isn't blank."""
    return ~_blank(value) & F.exists(F.slice(items, F.lit(1), i), lambda x: F.coalesce(x[key] == value, F.lit(False)))


def _segment_codes(segments: Column, s: Column, i: Column) -> Column:
    kind = s["evidence_class"]
    known = _one_of(kind, CLASSES)
    first = _codes(
        (_blank(s["segment_id"]), "segment_id_missing"), (_blank(s["token"]), "token_missing"), (_again(segments, i, "segment_id", s["segment_id"]), "duplicate_segment_id"),
        (~_one_of(s["validity"], VALIDITY), "validity_invalid"), (~_one_of(s["semantics"], SEMANTICS), "semantics_invalid"), (~known, "evidence_class_invalid"), (known & (kind == EXTERNAL), "external_record_defined_unverified"),
    )
    literal = _codes(*(((_page_wrong if f == "page" else _blank)(s[f]), e) for f, e in LITERAL))
    documents = s["supporting_documents"]
    grammar = _codes(*((_blank(s[f]), e) for f, e in GRAMMAR), (F.coalesce(F.size(documents), F.lit(0)) <= 0, "grammar_supporting_documents_missing"))
    of_document = lambda d, k: _codes((_blank(d["document_id"]), F.concat(F.lit("grammar_document_"), k.cast("string"), F.lit("_id_missing"))), (_blank(d["edition"]), F.concat(F.lit("grammar_document_"), k.cast("string"), F.lit("_edition_missing"))))
    supported = F.coalesce(F.flatten(F.transform(documents, of_document)), F.array().cast(_NONE))
    mismatch = _codes((~F.coalesce(s["validity"] == "grammar", F.lit(False)), "grammar_validity_mismatch"))
    more = F.when(kind == "literal_occurrence", literal).when(kind == "grammar_validated", F.concat(grammar, supported, mismatch)).otherwise(F.array().cast(_NONE))
    return F.concat(first, more)


def _rule_codes(results: Column, r: Column, i: Column) -> Column:
    failed = F.when(r["status"] == "fail", F.concat(F.lit("rule_failed:"), r["rule_id"]))
    named = F.concat(_codes((_again(results, i, "rule_id", r["rule_id"]), "duplicate_rule_id"), (~_one_of(r["status"], STATUS), "invalid_status")), F.array_compact(F.array(failed)))
    return F.when(_blank(r["rule_id"]), F.array(F.lit("rule_id_missing"))).otherwise(named)


def cross_rule_errors(rules: Column) -> Column:
    """Errors of struct CROSS_RULES: that none was applicable has to be said, with a reason."""
    results = rules["results"]
    each = F.flatten(F.transform(results, lambda r, i: _numbered("cross_rule_", i, _rule_codes(results, r, i))))
    status, one = rules["evaluation_status"], lambda e: F.array(F.lit(e))
    return (
        F.when(rules.isNull(), one("cross_rules_missing"))
        .when(status == "evaluated", F.when(F.coalesce(F.size(results), F.lit(0)) <= 0, one("cross_rules_evaluated_without_results")).otherwise(each))
        .when(status == "not_applicable", _codes((_blank(rules["reason"]), "cross_rules_not_applicable_reason_missing")))
        .otherwise(one("cross_rules_evaluation_status_invalid"))
    )


def summary(segments: Column) -> Column:
    """The weakest class of all segments; null if there is none or one has no strength."""
    ranks = F.transform(segments, lambda s: F.coalesce(F.array_position(F.array(*map(F.lit, STRENGTH)), s["evidence_class"]), F.lit(0)))
    return F.when((F.size(segments) > 0) & (F.array_min(ranks) > 0), F.element_at(F.array(*map(F.lit, STRENGTH)), F.array_min(ranks).cast("int")))


def validated(part_number: Column, segments: Column, cross_rules: Column) -> Column:
    """struct(pass, errors, summary) of a part number with segments array<struct<SEGMENT>> and cross_rules struct<CROSS_RULES>.

    Errors stand in the order of the segments and name their place from 0; nulls count as blank. The summary is null if there is any error.
    """
    each = F.flatten(F.transform(segments, lambda s, i: _numbered("segment_", i, _segment_codes(segments, s, i))))
    some = F.when(F.coalesce(F.size(segments), F.lit(0)) <= 0, F.array(F.lit("segments_missing"))).otherwise(each)
    errors = F.concat(_codes((_blank(part_number), "part_number_missing")), some, cross_rule_errors(cross_rules))
    return F.struct((F.size(errors) == 0).alias("pass"), errors.alias("errors"), F.when(F.size(errors) == 0, summary(segments)).alias("summary"))

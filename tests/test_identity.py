"""The identity contract's golden cases, identifiers of any script, canonical JSON, and the order of part numbers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ferrule.functions import canonical
from ferrule.functions.text import is_unicode_identifier, looks_like_part_number, part_key, unicode_signature
from ferrule.operators import contracts, search

SCHEMA = f"name string, part_number string, segments array<struct<{contracts.SEGMENT}>>, cross_rules struct<{contracts.CROSS_RULES}>"
FIELDS = [x.split(":")[0] for x in contracts.SEGMENT.split(", supporting_documents")[0].split(", ")] + ["supporting_documents"]


def segment(**values):
    return tuple(values.get(f) for f in FIELDS)


def grammar(segment_id, token, rule_id, **more):
    return segment(**{"segment_id": segment_id, "token": token, "validity": "grammar", "semantics": "resolved", "evidence_class": "grammar_validated", "grammar_id": "G", "grammar_version": "1.0.0", "rule_id": rule_id, "supporting_documents": [("doc", "CAT-1")]} | more)


def literal(segment_id, token, **more):
    return segment(**{"segment_id": segment_id, "token": token, "validity": "literal", "semantics": "resolved", "evidence_class": "literal_occurrence", "document_id": "doc", "document_edition": "JA", "page": "530", "evidence_text": token} | more)


GOOD = [literal("base", "VQZ3521"), grammar("solenoid", "5", "s5"), grammar("constant", "1", "c1", semantics="constant_no_legend"), grammar("suffix", "Q", "q")]
RULES = ("evaluated", None, [("one", "pass"), ("two", "not_applicable")])
CASES = [
    ("mixed vector passes", "P", GOOD, RULES, [], "grammar_validated"),
    ("segment without evidence", "P", [GOOD[0], grammar("x", "5", "r", supporting_documents=None)], RULES, ["segment_1:grammar_supporting_documents_missing"], None),
    ("rules can't be left out", "P", GOOD, (None, None, None), ["cross_rules_evaluation_status_invalid"], None),
    ("none applicable is said", "P", GOOD, ("not_applicable", "no constraints", None), [], "grammar_validated"),
    ("a failed rule rejects", "P", GOOD, ("evaluated", None, [("one", "fail")]), ["cross_rule_0:rule_failed:one"], None),
    ("external records are not admitted", "P", [literal("a", "b", evidence_class="external_record")], RULES, ["segment_0:external_record_defined_unverified"], None),
    ("all segments count", "P", [GOOD[0]], RULES, [], "literal_occurrence"),
    ("nothing at all", None, None, None, ["part_number_missing", "segments_missing", "cross_rules_missing"], None),
    ("many errors in order", " ", [grammar("a", " ", "", validity="literal", grammar_id=None), literal("a", "t", page="2.5", semantics="?", document_id="\t"), segment(segment_id="b", token="t", validity="x")], ("evaluated", None, [(None, "pass"), ("r", "?"), ("r", "fail")]),
     ["part_number_missing", "segment_0:token_missing", "segment_0:grammar_id_missing", "segment_0:grammar_rule_id_missing", "segment_0:grammar_validity_mismatch", "segment_1:duplicate_segment_id", "segment_1:semantics_invalid", "segment_1:literal_document_id_missing",
      "segment_1:literal_page_missing", "segment_2:validity_invalid", "segment_2:semantics_invalid", "segment_2:evidence_class_invalid", "cross_rule_0:rule_id_missing", "cross_rule_1:invalid_status", "cross_rule_2:duplicate_rule_id", "cross_rule_2:rule_failed:r"], None),
    ("no results, and no reason", "P", GOOD, ("evaluated", None, []), ["cross_rules_evaluated_without_results"], None),
    ("a reason is missing", "P", GOOD, ("not_applicable", " ", None), ["cross_rules_not_applicable_reason_missing"], None),
]


def test_the_contract_s_cases(spark):
    df = spark.createDataFrame([c[:4] for c in CASES], SCHEMA)
    got = {r.name: (r.v["pass"], list(r.v["errors"]), r.v["summary"]) for r in df.select("name", contracts.validated(F.col("part_number"), F.col("segments"), F.col("cross_rules")).alias("v")).collect()}
    assert got == {c[0]: (not c[4], c[4], c[5]) for c in CASES}


@pytest.mark.parametrize("raw,key,ascii_too", [("LTC-450α", "LTC450Α", False), ("β-120", "Β120", False), ("VIO-50Bα", "VIO50BΑ", False), ("é-1", "É1", False), ("6ES7214-1AG40-0XB0", "6ES72141AG400XB0", True), ("DSNU-25-25-PPV-A", "DSNU2525PPVA", True), ("MT-05K", "MT05K", True)])
def test_identifiers_of_any_script(spark, raw, key, ascii_too):
    r = spark.createDataFrame([(raw,)], "x string").select(canonical.identifier_key(F.col("x")).alias("key"), part_key(F.col("x")).alias("old"), is_unicode_identifier(canonical.composed(F.col("x"))).alias("ok"), looks_like_part_number(F.col("x")).alias("shape"), unicode_signature(canonical.composed(F.col("x"))).alias("sig")).first()
    assert r.key == key and r.ok and r.shape == ascii_too and (r.old == key or not ascii_too) and len(r.sig) == len(raw) - raw.count("́")


def test_canonical_json_does_not_depend_on_writing(spark):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind >= 6:
            return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 6 else {rng.choice(["a", "B", "é", "10", "9", "01", "", "ź", "\U0001f600", "￿"]): value(depth - 1) for _ in range(rng.randrange(5))}
        return [None, True, rng.randrange(-99, 99), str(rng.randrange(99)), rng.random() * 10 ** rng.randrange(-9, 9), "x\"\n"][kind]

    def shuffled(x):
        if isinstance(x, dict):
            keys = list(x)
            rng.shuffle(keys)
            return {k: shuffled(x[k]) for k in keys}
        return [shuffled(v) for v in x] if isinstance(x, list) else x

    values = [value(5) for _ in range(300)]
    rows = [(i, json.dumps(shuffled(v), ensure_ascii=bool(n), indent=n)) for i, v in enumerate(values) for n in (None, 1)]
    out = spark.createDataFrame(rows, "i int, x string").select("i", canonical.stable_json(F.col("x")).alias("s")).collect()
    texts = {}
    for r in out:
        texts.setdefault(r.i, set()).add(r.s)
    assert all(len(t) == 1 for t in texts.values())
    assert all(json.loads(texts[i].copy().pop()) == v for i, v in enumerate(values))


@pytest.mark.parametrize("text,want", [('{"b":20,"a":"20"}', '{"a":"20","b":20}'), ('{"a":null}', '{"a":null}'), ("{}", "{}"), ("20.0", "20"), ("1e21", "1e+21"), ("0.0000015", "0.0000015"), ("1.5e-7", "1.5e-7"), ("12345678901234567890", "12345678901234567000"), ('{"10":1,"9":2,"a":3}', '{"9":2,"10":1,"a":3}'), ("{", None), ("NaN", None), ("[" * 50_000, None), (None, None)])
def test_canonical_values(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(canonical.stable_json(F.col("x"))).first()[0] == want


def test_numbers_come_in_the_order_of_their_letters(spark):
    names = ["b-1", "A1", "a1", "á1", "Z", "a-1", "10", "9"]
    df = spark.createDataFrame([(i, n, f"k{n}", "m", "c", "same ring") for i, n in enumerate(names)], "part_id long, part_number string, part_key string, manufacturer string, category string, description string")
    state = search.state_rank(F.when(F.col("part_number") == "Z", "published").otherwise("unknown"))
    assert [r.part_number for r in search.ranked(df, "ring", 20, state_rank=state).collect()] == ["Z", "10", "9", "a-1", "a1", "A1", "á1", "b-1"]

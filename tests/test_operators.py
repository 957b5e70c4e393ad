"""Golden cases of functions and operators that the driver's tables don't reach."""

import datetime

import pytest
from pyspark.sql import functions as F

from ferrule.functions import hashing, text, urls
from ferrule.operators import compare, crawl, extract, gates, geometry, images, ingest, search
from ferrule.sources.shared import checkpointed


def values(spark, c, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", c(F.col("x")).alias("y"))
    return [r.y for r in df.orderBy("i").collect()]


def test_numbers_and_ranges(spark):
    assert values(spark, text.number, ["-3,5 V", "6,300", "x", None, "1.25e"]) == [-3.5, 6.3, None, None, 1.25]
    got = values(spark, text.number_range, ["1..5", "9 to 2", "3–4", "7", "none", None])
    assert [tuple(r) if r else None for r in got] == [(1, 5), (2, 9), (3, 4), (7, 7), None, None]


def test_values_and_units(spark):
    got = values(spark, text.split_value_unit, ["24 V", "0,2A", ">=10 bar", "NPN", "", None, "<5 mm"])
    assert [tuple(r) for r in got] == [("24", "V"), ("0.2", "A"), (">=10 bar", ""), ("NPN", ""), ("", ""), ("", ""), ("<5", "mm")]
    assert values(spark, text.normalize_unit, ["VDC", "m.m", "Zoll", None]) == ["V", "mm", "Zoll", ""]


def test_identifiers(spark):
    assert values(spark, text.part_key, ["6es7-214/1 a.b_c", None]) == ["6ES72141ABC", ""]
    assert values(spark, text.looks_like_part_number, ["6205", "AB 12", "ABC", "a" * 41 + "1", "-1", "X_1"]) == [True, False, False, False, False, True]
    assert values(spark, text.is_unicode_identifier, ["α12", "Ж9", "abc", "é 1"]) == [True, True, False, False]
    assert values(spark, text.unicode_signature, ["αB-12"]) == ["AA-NN"]
    assert values(spark, text.folded, ["Válvula  NEUMÁTICA, ½", None]) == ["valvula neumatica", ""]
    assert values(spark, text.is_weak_reference, ["24 V", "10mm", "AB24"]) == [True, True, False]


def test_published_hashes(spark):
    assert values(spark, hashing.fnv1a, ["abc", ""]) == ["1a47e90b", "811c9dc5"]
    assert values(spark, hashing.djb2, [""]) == [5381]
    m = spark.range(1).select(hashing.stable_map(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit(None).cast("string"))).alias("x")).first().x
    assert m == '{"a":null,"b":"1"}'


def test_urls(spark):
    assert values(spark, lambda c: urls.registrable(urls.host(c)), ["https://www.a.b.co.uk/x", "http://x.example.com", "nonsense"]) == ["b.co.uk", "example.com", ""]
    assert values(spark, urls.normalized, ["HTTP://u:p@A.com:80/x?y#z", "https://a.com:443", "ftp://a"]) == ["http://a.com/x?y", "https://a.com/", None]
    base = F.lit("https://a.com/x/y?q=1")
    assert values(spark, lambda c: urls.resolved(c, base), ["/z", "//b.com/c", "w", "http://q/", "mailto:x@y"]) == ["https://a.com/z", "https://b.com/c", "https://a.com/x/w", "http://q/", None]
    assert values(spark, lambda c: urls.depth_below(c, F.lit("https://a.com/p")), ["https://a.com/p/q/r", "https://a.com/x", "https://b.com/p"]) == [2, -1, -1]


@pytest.mark.parametrize(("base", "candidate", "operator", "tolerance", "state"), [
    ("24", "24,0", "within_tolerance", None, "equal"), ("100", "109", "within_tolerance", 10.0, "equal"), ("100", "111", "within_tolerance", 10.0, "different"), ("1..5", "5-9", "range_overlap", None, "equal"),
    ("1..5", "6", "range_overlap", None, "different"), ("5", "6", "gte", None, "equal"), ("5", "6", "lte", None, "different"), ("NPN", "npn ", "equal", None, "equal"), ("", "x", "equal", None, "missing"), ("a", "b", "gte", None, "not_comparable"), ("1", "1", "other", None, "not_comparable"),
])
def test_rule_states(spark, base, candidate, operator, tolerance, state):
    row = spark.createDataFrame([(base, candidate, operator, tolerance)], "a string, b string, o string, t double")
    assert row.select(compare.rule_state(F.col("a"), F.col("b"), F.col("o"), F.col("t")).alias("s")).first().s == state


def decide(spark, specs_a, specs_b, rules, **more):
    pair = {"base_id": 1, "candidate_id": 2, "base_number": "A1", "candidate_number": "B1", "base_family": "f", "candidate_family": "f", "blocked": None, "has_evidence": False, "relations": None} | more
    pairs = spark.createDataFrame([tuple(pair.values())], "base_id long, candidate_id long, base_number string, candidate_number string, base_family string, candidate_family string, blocked string, has_evidence boolean, relations array<struct<type:string,from_number:string,verified:boolean>>")
    specs = spark.createDataFrame([(1, k, v) for k, v in specs_a.items()] + [(2, k, v) for k, v in specs_b.items()], "part_id long, property string, value string")
    ru = spark.createDataFrame([("f", i, p, level, op, None, True) for i, (p, level, op) in enumerate(rules)], "family string, ord int, property string, level string, operator string, tolerance_pct double, active boolean")
    return compare.decisions(pairs, compare.rule_results(pairs, specs, ru)).first()


def test_decisions_in_order(spark):
    rules = [("v", "critical", "equal"), ("w", "required", "equal"), ("x", "supporting", "equal")]
    good = {"v": "1", "w": "2", "x": "3"}
    assert decide(spark, good, good, rules).state == "EQUIVALENT"
    # a failing supporting rule doesn't block
    r = decide(spark, good, good | {"x": "9"}, rules)
    assert (r.state, r.score, r.reasons) == ("EQUIVALENT", 67, ["ALL_ACTIVE_RULES_PASS"])
    # a missing value of a critical rule fails it
    r = decide(spark, good, {"w": "2", "x": "3"}, rules)
    assert (r.state, r.reasons) == ("NOT_SUBSTITUTABLE", ["CRITICAL_MISSING:v"])
    assert decide(spark, good, good | {"w": "0"}, rules).state == "INSUFFICIENT_EVIDENCE"
    assert decide(spark, good, {"v": "1", "w": "2"}, rules, has_evidence=True).state == "SIMILAR_REVIEW"
    assert decide(spark, good, good, [], has_evidence=False).state == "INSUFFICIENT_EVIDENCE"
    assert decide(spark, good, good, rules, candidate_family="g").reasons == ["FAMILY_MISMATCH"]
    assert decide(spark, good, {}, rules, candidate_number=" a1 ").state == "EXACT"
    assert decide(spark, good, good, rules, blocked="mixed").reasons == ["mixed"]


def test_declared_relations_override(spark):
    rules = [("v", "critical", "equal")]
    # compatible needs no evidence and holds in spite of another family
    r = decide(spark, {"v": "1"}, {"v": "2"}, rules, candidate_family="g", relations=[("compatible", None, False)])
    assert (r.state, r.score, r.reasons[-1]) == ("COMPATIBLE", 70, "DECLARED_COMPATIBLE")
    assert decide(spark, {"v": "1"}, {"v": "1"}, rules, relations=[("successor", "A1", False)]).state == "EQUIVALENT"
    assert decide(spark, {"v": "1"}, {"v": "2"}, rules, relations=[("successor", "a1", True), ("compatible", None, True)]).state == "REPLACE"
    assert decide(spark, {"v": "1"}, {"v": "1"}, rules, relations=[("compatible", "ZZ", True)]).state == "EQUIVALENT"


def test_extraction(spark):
    html = "<title>A &amp; B</title><script>x('<td>')</script><table><tr><th>Voltage</th><td>24</td><td>V</td></tr><tr><td>only</td></tr></table><dl><dt>Weight</dt> <dd><b>3</b> kg</dd></dl><img alt=x src='/a.png'><meta property=\"og:image\" content=\"https://h/i.jpg\">"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.attribute, r.value) for r in extract.html_rows(pages, "page_id").orderBy("row_no").collect()] == [("Voltage", "24 V"), ("Weight", "3 kg")]
    assert [(r.method, r.url) for r in extract.images(pages, "page_id").orderBy("image_no").collect()] == [("og", "https://h/i.jpg"), ("html", "/a.png")]
    docs = spark.createDataFrame([(1, "Payload\n5 kg\nReach\n886.5 mm\nThe end\n3 kg\nPayload\n5 kg\nSee ABC-123 and X9Y"), (2, None)], "doc_id long, text string")
    assert [(r.attribute, r.value) for r in extract.adjacent_pairs(extract.lines(docs, "doc_id")).orderBy("line_no").collect()] == [("Payload", "5 kg"), ("Reach", "886.5 mm")]
    assert [r.token for r in extract.part_numbers(docs, "doc_id").orderBy("position").collect()] == ["ABC-123", "X9Y"]
    compact = spark.createDataFrame([(1, "Piston diameter 25 mm, Stroke of 30 MM; Foo 3 xyz. Piston diameter 25 mm")], "doc_id long, text string")
    assert [(r.attribute, r.value) for r in extract.compact_pairs(compact, "doc_id").orderBy("line_no").collect()] == [("Piston diameter", "25 mm"), ("Stroke", "30 mm")]
    rows = spark.createDataFrame([(1, 0, ["Input"]), (1, 1, ["V", "24"]), (1, 2, ["Output"]), (1, 3, ["V", "5"])], "id long, row_no int, cells array<string>")
    assert [r.section for r in extract.sectioned(rows).orderBy("row_no").collect()] == ["Input", "Output"]
    lines = spark.createDataFrame([(1, 0, "x"), (1, 1, "A: 1"), (1, 2, "more"), (1, 3, "B: 2")], "id long, line_no int, line string")
    assert [r.text for r in extract.continued(lines, F.col("line").contains(":")).orderBy("line_no").collect()] == ["A: 1 more", "B: 2"]


@pytest.mark.parametrize(("a", "v", "ok"), [("Voltage", "24 V", True), ("![logo](", "x", False), ("a", "//cdn/x.png", False), ("a", "N/A", False), ("", "x", False), ("a" * 101, "1", False), ("a", "javascript:void(0)", False)])
def test_safe_pairs(spark, a, v, ok):
    assert spark.createDataFrame([(a, v)], "a string, v string").select(extract.safe_pair(F.col("a"), F.col("v")).alias("s")).first().s is ok


def test_robots_and_frontier(spark):
    files = spark.createDataFrame([("h", "User-agent: bot\nDisallow: /\nUser-agent: *\nDisallow: /a\nAllow: /a/b # x\nDisallow:\n")], "host string, text string")
    rules = crawl.robots_rules(files)
    pages = spark.createDataFrame([(1, "http://h/a/x"), (2, "http://h/a/b/c"), (3, "http://h/z"), (4, "http://other/a")], "page_id long, url string")
    assert {r.page_id: r.allowed for r in crawl.robots_allowed(pages, rules, "page_id").collect()} == {1: False, 2: True, 3: True, 4: True}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r.depth for r in crawl.frontier(seeds, edges, 3, checkpointed).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_gates(spark):
    seg = "array<struct<segment_id:string,token:string,evidence_class:string,document_id:string,page:int>>"
    df = spark.createDataFrame([([("s", "t", "inferred", "d", 1)],), ([("s", "", "x", "d", 0), ("s", "t", "inferred", "d", 1)],), ([],), (None,)], f"s {seg}")
    got = [sorted(r.e) for r in df.select(gates.evidence_errors(F.col("s")).alias("e")).collect()]
    assert got == [[], ["duplicate_segment_id", "segment[0].evidence_class", "segment[0].page", "segment[0].token"], ["no_segments"], ["no_segments"]]


def test_geometry(spark):
    rows = [(1, 1, 0, "Voltage", 0.0, 100.0, 30.0, 5.0), (1, 1, 1, "24 V", 60.0, 100.5, 20.0, 5.0), (1, 1, 2, "Weight", 0.0, 90.0, 20.0, 5.0), (1, 1, 3, "net", 22.0, 90.0, 10.0, 5.0), (1, 1, 4, "3 kg", 60.0, 90.9, 20.0, 5.0), (1, 1, 5, "note", 0.0, 50.0, 20.0, 5.0)]
    f = spark.createDataFrame(rows, "doc long, page int, idx int, text string, x double, y double, w double, h double")
    c = geometry.cells(geometry.banded(f))
    assert sorted((r.band, r.cell, r.text) for r in c.collect()) == [(0, 0, "Voltage"), (0, 1, "24 V"), (1, 0, "Weight net"), (1, 1, "3 kg"), (2, 0, "note")]
    assert {(r.band, r.table) for r in geometry.tables(c).collect()} == {(0, 0), (1, 0)}
    assert geometry.merged_box(f, ["doc"]).first().x1 == 80.0


def test_images_and_upsert(spark):
    cols = "id long, method string, url string, context string, part_number string, manufacturer string"
    df = spark.createDataFrame([(1, "og", "https://h/A.jpg", "acme x1", "X-1", "Acme"), (1, "jsonld", "https://h/a.jpg", "", "X-1", "Acme"), (1, "html", "https://h/logo.png", "", "X-1", "Acme"), (2, "html", "http://localhost/x.jpg", "", "a", "b")], cols)
    assert [(r.id, r.method, r.score) for r in images.best(df).collect()] == [(1, "jsonld", 100)]
    now = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, t long, v string")
    new = spark.createDataFrame([(1, 5, "c"), (2, 4, "d"), (3, 1, "e")], "k long, t long, v string")
    assert {r.k: r.v for r in ingest.upserted(now, new, ["k"], [F.desc("t")]).collect()} == {1: "c", 2: "b", 3: "e"}


def test_search_edges(spark):
    p = spark.createDataFrame([(1, "AB-1", "AB1", "Acme", "valve", "ball valve")], "part_id long, part_number string, part_key string, manufacturer string, category string, description string")
    top = lambda q: tuple(p.select(search.score(q).alias("s")).first().s)
    assert top("ab-1") == (1000, "part_number_exact") and top("ab1") == (950, "part_number_normalized") and top("acme") == (700, "manufacturer_exact") and top("  ") == (0, "none")
    # a token of separators has an empty key, which every key contains
    assert top("zzz --")[1] == "part_number_token"
    assert search.clamp(None) == 10 and search.clamp(500) == 50 and search.clamp(-3) == 1


def test_streaming_ingestion(spark, tmp_path):
    from ferrule.streaming.ingestion import current, run_available

    schema = spark.createDataFrame([], "k long, t timestamp, v string").schema
    at = datetime.datetime(2024, 1, 1)
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), str(tmp_path / "cp"), ["k"], ["t"])
    put([(1, at, "a"), (2, at, "b")])
    go()
    put([(1, at + datetime.timedelta(1), "c"), (2, at - datetime.timedelta(1), "old"), (3, at, "d")])
    go()
    assert {r.k: r.v for r in current(spark, str(tmp_path / "state"), schema).collect()} == {1: "c", 2: "b", 3: "d"}


V = dict(context="valve|sensor", blocked="recipe", excluded_hosts=r"(?:^|\.)tube\.", corporate_hard="annual report", corporate_soft="about us", product="products", datasheet="data ?sheet", family="series", buy="buy now", editorial="what is|blog", editorial_url="/blog/")


def test_discovery(spark):
    from ferrule.operators import discovery as d

    v = d.Vocabulary(**V)
    cols = "ord int, url string, title string, snippet string, manufacturer string, part_number string, n_specs int, provider_score double, is_catalog boolean"
    rows = [
        (0, "https://www.acme.com/p/AB-1234.html", "Acme AB-1234 valve", "", "Acme", "", 0, 0.1, False),
        (1, "https://shop.sells.com/x", "Valve series", "buy now", "Acme", "", 0, 0.9, False),
        (2, "https://x.org/blog/what", "What is a valve", "", "", "", 0, 0.5, False),
        (3, "https://acmesupply.com/a.pdf", "valve", "", "Acme", "", 0, 0.2, True),
        (4, "https://v.tube.com/", "valve", "", "", "", 0, 0.2, False),
        (5, "https://acme.de/about", "About us", "annual report valve", "Acme", "", 0, 0.2, False),
    ]
    df = spark.createDataFrame(rows, cols)
    policies = spark.createDataFrame([("acme", "official", "acme.com"), ("acme", "authorized_distributor", "partner.com")], "maker_key string, kind string, domain string")
    sourced = d.with_source(df, policies, ["sells.com"])
    assert {r.ord: r.source_type for r in sourced.collect()} == {0: "official", 1: "distributor", 2: "web_discovery", 3: "web_discovery", 4: "web_discovery", 5: "official"}
    out = d.ranked(sourced.filter(d.relevant(v, "valve", False)), F.lit(1), v)
    assert [(r.ord, r.content_type, r.tier) for r in out.collect()] == [(0, "product_page", 5), (3, "datasheet", 5), (1, "distributor_listing", 4), (2, "article_editorial", 1)]
    found = spark.createDataFrame([(3, "B-2", 1), (3, "A-1", 0)], "ord int, part_number string, position int")
    assert sorted((r.ord, r.part_number) for r in d.expanded(df, found).collect() if r.ord >= 3) == [(3, "A-1"), (3, "B-2"), (4, ""), (5, "")]


def test_identity(spark):
    from ferrule.operators import discovery as d

    docs = spark.createDataFrame([(1, "Ball valve AB-12 XY9Z", "Part number: ab12; P/N: Q-77 by ACME", None), (2, "thing", "", " H1 "), (3, "motor", "acme drive", "")], "doc_id long, title string, text string, part_hint string")
    got = {r.doc_id: r for r in d.identities(docs, ["Acme"], {"valve": "valve", "motor": "motor|drive"}).collect()}
    assert got[1].part_numbers == ["ab12", "Q-77", "XY9Z"] and got[1].manufacturer == "Acme" and got[1].category == "valve"
    assert (got[2].part_numbers, got[2].category, got[2].identified) == (["H1"], "general", True)
    assert got[3].identified and not got[3].part_numbers
    cols = "url string, title string, snippet string, source_type string, manufacturer string, part_number string, identity_manufacturer string, identity_part_number string"
    rows = [("https://acme.com", "x", "", "official", "Acme", "VREF2", None, None), ("https://b.com", "valve", "", "web", "valve", "ABC", None, "Z9"), ("https://b.com", "acme", "", "web", "acme", "ISO-9", "Real", None), ("u", "", "", "web", "Z9", "Z-9", None, None)]
    out = d.cleaned_identity(spark.createDataFrame(rows, cols), "acme", ["valve"]).collect()
    assert [(r.manufacturer, r.part_number) for r in out] == [("Acme", ""), ("", "Z9"), ("Real", ""), ("", "Z-9")]
    role = spark.createDataFrame([("Part Number", "X1", "", True), ("part number", "X1", "", False), ("Revision", "B", "", True), ("", "5 V", "", False), ("", "X1", "document number 3", False), ("device", "X1", "", False)], "l string, v string, c string, b boolean")
    r = role.select(d.identifier_role(F.col("l"), F.col("v"), F.col("c"), F.col("b"), ["part number"], "revision|serial", "document (?:number|no)").alias("r")).collect()
    assert [x.r.role for x in r] == ["PART_NUMBER", "IDENTIFIER_CANDIDATE", "DOCUMENT_REFERENCE", "ELECTRICAL_VALUE", "DOCUMENT_REFERENCE", "IDENTIFIER_CANDIDATE"]
    spec = spark.createDataFrame([("Supply voltage", "24 V"), ("Price", "24 V"), ("Valve function", "5/2"), ("Voltage", "high"), ("", "1")], "a string, v string")
    ok = spec.select(d.technical_spec(F.col("a"), F.col("v"), "^(?:price|stock)$", ["valve function"], "voltage|current", ["v", "a"]).alias("s")).collect()
    assert [x.s.ok for x in ok] == [True, False, True, False, False]


def test_readers(spark):
    from ferrule.operators import readers as r

    docs = spark.createDataFrame([(1, "25mm Piston and M10x1.5 Rod, G 1/8 Port; 25 mm Piston; 3 foo Bar")], "doc_id long, text string")
    assert {(x.attribute, x.value) for x in r.value_first_pairs(docs, "doc_id").collect()} >= {("Port", "G 1/8"), ("Rod", "M10x1.5"), ("Piston", "25 mm")}
    q = spark.createDataFrame([("DIN 1343) 330 l/min",), ("7",), ("x",)], "x string").select(r.quantity(F.col("x")).alias("q")).collect()
    assert [tuple(x.q) for x in q] == [(330.0, "l/min"), (7.0, None), (None, None)]
    sheet = spark.createDataFrame([(1, "Stroke\nShare\n25 mm\nWeight  3 kg\n123456\nx\nADN-20\n123457\n999999\nADN-30")], "doc_id long, text string")
    rows = extract.lines(sheet, "doc_id")
    assert ("Stroke", "25 mm") in [(x.attribute, x.value) for x in r.next_line_pairs(rows).collect()]
    assert [(x.attribute, x.value) for x in r.spaced_pairs(rows).collect()] == [("Weight", "3 kg")]
    assert sorted((x.part_number, x.type_code) for x in r.catalogue_pairs(rows, "adn").collect()) == [("123456", "ADN-20"), ("999999", "ADN-30")]
    cells = spark.createDataFrame([(1, 0, list("abcdefghi")), (1, 1, ["a"])], "id long, row_no int, cells array<string>")
    assert [x.cells for x in r.strided(cells).orderBy("group").collect()] == [list("abcd"), list("efgh")]


def test_triage_and_part_numbers(spark):
    from ferrule.operators import readers as r

    good = "the valve of the line is rated for 20 mm and 15 bar " * 6
    pages = spark.createDataFrame([(1, 1, good, False, False), (2, 1, "", False, False), (3, 1, good + "how to order", False, False), (4, 1, "Model the", True, True), (5, 1, "zxq wvk " * 50, False, False), (6, 1, "the plain of it " * 30, False, False)], "doc long, page int, text string, has_model boolean, has_specs boolean")
    got = {x.doc: x.kind for x in r.triage(pages, ["the", "of", "is", "for"], r"\d+ (?:mm|bar)", "how to order").collect()}
    assert got == {1: "possible_product_catalog", 2: "text_extraction_failed", 3: "configurator", 4: "simple_datasheet", 5: "text_extraction_failed", 6: "unclassified_review"}
    pages = spark.createDataFrame([(1, 1, "LM324 amplifier\nPart number: LM324B\nLM324 again"), (1, 2, "LM324"), (2, 1, "XY12 device\nXY12"), (2, 2, "XY12 of\nRevision\nB2C"), (3, 1, "ZZ9X")], "doc long, page int, text string")
    found = r.candidates(pages, ["part number"], ["revision"], ["device"])
    by = {(x.doc, x.page, x.line_no, x.token): x for x in found.collect()}
    assert by[1, 1, 1, "LM324B"].label == "part number" and by[1, 1, 1, "LM324B"].same_line and by[2, 2, 2, "B2C"].exclusive
    role = F.when((F.col("label_type") == "positive") & (F.col("same_line") | F.col("exclusive")), "PART_NUMBER").otherwise("UNKNOWN")
    grammars = spark.createDataFrame([(3, "AANA")], "doc long, format string")
    assert sorted(tuple(x) for x in r.chosen(found, role, grammars).collect()) == [(1, "LM324B", "explicit_part_number"), (2, "XY12", "contextual_identity_corroborated"), (3, "ZZ9X", "active_grammar")]
    cells = spark.createDataFrame([(1, 1, 0, 1, "A-1"), (1, 1, 0, 1, "a1"), (1, 1, 0, 2, "B1"), (1, 1, 0, 2, "C1"), (1, 2, 0, 1, "A 1")], "doc long, page int, table int, row int, token string")
    assert [(x.page, x.row) for x in r.ordered_parts(cells).collect()] == [(1, 1)]
    specs = spark.createDataFrame([(1, "Gain", "3", "B, K versions"), (1, "Offset", "1", "A version"), (1, "Rate", "2", "LM 324 BIDR")], "doc long, attribute string, value string, context string")
    parts = spark.createDataFrame([(1, "LM324BIDR", "")], "doc long, token string, marking string")
    assert sorted(x.attribute for x in r.applicable_specs(specs, parts).collect()) == ["Gain", "Rate"]


def test_gateway_modes(spark):
    from ferrule.plans import gateway as g

    rows = [(i, f"AB-{i}", f"AB{i}", "Acme", "valve" if i < 5 else "motor", "thing", None, "verified" if i != 3 else "rejected") for i in range(1, 8)]
    p = spark.createDataFrame(rows, "part_id long, part_number string, part_key string, manufacturer string, category string, description string, archived_at timestamp, status string")
    s = spark.createDataFrame([(i, "size", str(i % 2)) for i in range(1, 8)] + [(1, "name", "x"), (2, "name", "x")], "part_id long, property string, value string")
    assert [r.part_id for r in g.search_mode(p, "ab-2").collect()] == [2]
    assert {r.provenance for r in g.search_mode(p.limit(0), "ab", fallback=p).collect()} == {"fallback"}
    assert [(r.part_id, r.has_more) for r in g.browse_mode(p, "valve", 2).collect()] == [(1, True), (2, True)]
    assert [r.part_id for r in g.browse_mode(p, "valve", 2, 2).collect()] == [4]
    assert {r.candidate_id: r.state for r in g.compare_mode(p, s, "ab-1").collect()} == {2: "review", 3: "review"}
    assert {r.candidate_id: (r.equal, r.different, r.missing) for r in g.selection_mode(p, s, [1, 2, 3]).collect()} == {2: (1, 1, 0), 3: (1, 0, 1)}
    with pytest.raises(ValueError):
        g.selection_mode(p, s, [1, 1])
    assert [(r.part_id, r.equal, r.score) for r in g.reference_mode(p, s, "valve", {"size": "1", "name": "X", " ": "y"}).collect()][:2] == [(1, 2, 100), (3, 1, 100)]
    areas = spark.createDataFrame([("valve", "fluid")], "category string, area string")
    assert g.area_mode(p, areas, "fluid", 3).count() == 3
    assert [(r.use_case, r.n_parts) for r in g.use_cases_mode(spark.createDataFrame([("u", "valve"), ("u", "none")], "use_case string, category string"), p).collect()] == [("u", 4)]
    images_ = spark.createDataFrame([(1, "a", False, None, None), (1, "b", True, None, None)], "part_id long, url string, is_primary boolean, verified_at timestamp, created_at timestamp")
    one = g.part_mode(p, 1, images_, spark.createDataFrame([("valve", "Valves")], "category string, family_name string")).first()
    assert (one.image_url, one.family_name) == ("b", "Valves")
    assert g.known_part(p, "a b/3").first().part_id == 3


def test_family_pairs_rank_a_family_once(spark):
    rows = [(i, f"P{(i * 37) % 400:03d}", "hot" if i % 3 else f"f{i % 20}") for i in range(400)] + [(900, "Z", "alone"), (901, "Y", None)]
    parts = spark.createDataFrame(rows, "part_id long, part_number string, category string")
    out = compare.same_family_pairs(parts, parts, 3)
    want = {(i, c) for i, _, f in rows for c in [c for n, c in sorted((n, c) for c, n, g in rows if f and g == f and c != i)[:3]]}
    got = [(r.base_id, r.candidate_id) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    # no base is joined with each part of its family
    assert max(r.candidates for r in out.groupBy("base_id").agg(F.count("*").alias("candidates")).collect()) == 3
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 1 and "NOT" not in joins[0]


def _site(spark, folder):
    root = "https://h.example.com/fr"
    urls_ = [root, *(f"{root}/p{i}" for i in range(1, 11))]
    deep = f"{root}/a/b/c/d/e"
    more = {3: [f"{deep}", f"{deep}/f", "https://other.example.com/fr/x", "https://h.example.com/es/x", f"{root}/logo.png"], 10: [root, f"{root}/8/x"]}
    href = lambda i: "".join(f'<a href="{u}">x</a>' for u in [*urls_[i + 1 : i + 2], *more.get(i, [])])
    rows = [(20 if i == 0 else i, u, f"<html>{href(i)}</html>") for i, u in enumerate(urls_)]
    # robots forbid /fr/8 for all hosts; a page behind it is reached by no other way
    rows += [(31, "https://h.example.com/fr/8/x", f'<a href="{root}/lost">x</a>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return {u: i for i, u in enumerate(urls_)} | {deep: 4}


def test_frontier_reaches_the_end_of_a_chain(spark, tmp_path):
    from ferrule.plans.catalogue import crawl_frontier

    want = _site(spark, tmp_path)
    assert {r.url: r.depth for r in crawl_frontier(spark, str(tmp_path)).collect()} == want
    edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(10)], "src string, dst string")
    assert {r.url: r.depth for r in crawl.frontier(spark.createDataFrame([("u0",)], "url string"), edges, None, checkpointed).collect()} == {f"u{i}": i for i in range(11)}


def test_suggestions_labels_and_verdicts(spark):
    parts = spark.createDataFrame([(1, "AB-12", "Acme"), (2, "AB-123", "Acme"), (3, "ZZ-9", "Abtec"), (4, "Q-1", None)], "part_id long, part_number string, manufacturer string")
    got = [(r.label, r.type, r.score) for r in search.suggestions(parts, " ab12").collect()]
    assert got == [("AB-12", "part", 300)]
    got = [(r.label, r.type, r.score) for r in search.suggestions(parts, "ab").collect()]
    assert got == [("AB-12", "part", 250), ("AB-123", "part", 250), ("ZZ-9", "part", 200), ("Abtec", "manufacturer", 80)]
    assert search.suggestions(parts, "a").count() == 0
    docs = spark.createDataFrame([(1, "Specifications\n3 kg\n> **Payload:**\n5 kg\nSKU\n12\n[Reach](https://x/(a))\n9 mm")], "doc_id long, text string")
    assert [(r.attribute, r.value) for r in extract.adjacent_pairs(extract.bare_lines(docs, "doc_id")).collect()] == [("Payload", "5 kg")]
    bases = spark.createDataFrame([(1,), (2,), (3,)], "base_id long")
    states = spark.createDataFrame([(1, 9, "compatible"), (2, 9, "compatible"), (2, 8, "review")], "base_id long, candidate_id long, display string")
    counted = spark.createDataFrame([(2, 9, 0, 3)], "base_id long, candidate_id long, equal long, different long")
    got = {r.base_id: (r.verdict, r.alternatives) for r in compare.verdict(bases, states, counted).collect()}
    assert got == {1: ("compatible_found", 1), 2: ("review_required", 1), 3: ("insufficient", 0)}

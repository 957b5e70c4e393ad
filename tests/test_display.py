"""What is shown: golden cases with nulls, empty texts and ties."""

import pytest
from pyspark.sql import functions as F

from ferrule.functions import display

L = F.lit


@pytest.fixture
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c).first()[0]


@pytest.mark.parametrize(
    ("query", "want"),
    [("6205-2RS", True), ("DSBC-32", True), (" AB12 ", True), ("1/2", False), ("AB 12", False), ("sensor", False), ("12345", False), ("A1", False), ("ABCDEFGHIJ12", False), ("", False), (None, False)],
)
def test_part_number_queries(one, query, want):
    assert one(display.is_part_number_query(L(query))) is want


@pytest.mark.parametrize(("query", "want"), [("valve VQZ115-5 MXJ6", "VQZ115-5"), ("vqz115", ""), ("", ""), (None, ""), ("TOOLONG123 Q9", "")])
def test_query_part_number(one, query, want):
    assert one(display.query_part_number(L(query))) == want


@pytest.mark.parametrize(
    ("attribute", "value", "want"),
    [
        ("Bore", "32 mm", True),
        ("Stock", "12", False),
        ("Stock temperature", "12 C", True),
        ("Bore", "see https://x.example", False),
        ("Bore", "![a](b)", False),
        ("View", "./a/b.png", False),
        ("Logo", "cdn/images/a", False),
        ("Logo", "round", True),
        ("", "1", False),
        ("Bore", None, False),
    ],
)
def test_displayable(one, attribute, value, want):
    assert one(display.is_displayable(L(attribute), L(value))) is want


def test_blobs_and_labels(one):
    blob = lambda x: one(display.is_specification_blob(L(x)))
    # a value runs up to the next colon, so two labels are one pair and three are two
    assert [blob("Bore: 32 mm. Stroke: 10. Load: 5"), blob("Bore: 32 mm. Stroke: 10"), blob("x" * 120 + " Bore: 32"), blob(""), blob(None)] == [True, False, True, False, False]
    label = lambda x: one(display.humanised(L(x)))
    assert [label("siemens_mouser_rated__voltage "), label("bore"), label("SIEMENS_x"), label(""), label(None)] == ["Mouser rated voltage", "Bore", "X", "", ""]


def test_pages_hosts_and_files(one):
    pages = F.array(L("a"), L(None), L("bore 32"), L("bore 32"))
    assert [one(display.first_page(L(x), pages)) for x in ("32", "z", "", None)] == [3, None, None, None]
    assert one(display.first_page(L("a"), L(None).cast("array<string>"))) is None
    assert [one(display.is_marketplace(L(x))) for x in ("https://www.eBay.com/x", "https://x.example/ebay", "ebay", None)] == [True, False, False, False]
    assert [one(display.file_prefix(L(x))) for x in ("https://x.example/dnc-1.pdf", "https://x.example/", "ADN", None)] == ["DNC", None, None, None]
    assert [one(display.file_family(L(x))) for x in ("DGSL-8", "DNC", None)] == ["pneumatic_mini_slide", "pneumatic_cylinder", "pneumatic_cylinder"]


def test_categories_and_given(one):
    category = lambda a, b: one(display.reference_category(L(a), L(b)))
    assert [category("x", "Servo amplifier, servo motor"), category("valve", None), category(None, None)] == ["servo_drive", "valve", ""]
    assert [one(display.is_given(L(v), L(a).cast("double"), L(None))) for v, a in (("", None), ("", 1.0), ("x", None), (None, None))] == [False, True, True, False]

"""Layout against the same rules written one fragment after the other, on random pages."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import geometry, layout

SCHEMA = "doc long, page int, idx int, text string, x double, y double, w double, h double"


def page_rows(rng, doc, page, n):
    return [(doc, page, i, rng.choice(["a", "B", "cc", "12", " ", "MIN"]), float(rng.randint(0, 60)), float(rng.randint(0, 40)), float(rng.randint(1, 9)), float(rng.randint(2, 16))) for i in range(n)]


def some_pages(spark, seed, pages=25, most=40):
    rng = random.Random(seed)
    rows = [r for d in range(pages) for r in page_rows(rng, d, d % 2 + 1, rng.randint(1, most))]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[1]), []).append(r)
    return out


def test_bands_begin_with_their_first(spark):
    rows, df = some_pages(spark, 1)
    want = set()
    for page, items in by_page(rows).items():
        band, first = -1, None
        for r in sorted(items, key=lambda r: (-r[5], r[4], r[2])):
            if first is None or abs(first - r[5]) > 1:
                band, first = band + 1, r[5]
            want.add((*page, r[2], band))
    assert {(r.doc, r.page, r.idx, r.band) for r in geometry.banded(df).collect()} == want


@pytest.mark.parametrize("given", [False, True])
def test_lines_take_what_fits_the_first(spark, given):
    rows, df = some_pages(spark, 2)
    near = (lambda r: max(2.0, 0.5 * r[7])) if given else (lambda r: 3.0)
    order = (lambda r: r[2]) if given else (lambda r: (-r[5], r[4], r[2]))
    want = set()
    for page, items in by_page(rows).items():
        lines = []
        for r in sorted((r for r in items if r[3].strip()), key=order):
            line = next((x for x in lines if abs(x[0] - r[5]) <= near(r)), None)
            if line is None:
                lines.append(line := (r[5], []))
            line[1].append(r[2])
        for i, (_, ids) in enumerate(sorted(lines, key=lambda x: -x[0])):
            want |= {(*page, n, i) for n in ids}
    got = layout.lined(df, F.greatest(F.lit(2.0), F.col("h") / 2), ["idx"]) if given else layout.lined(df)
    assert {(r.doc, r.page, r.idx, r.band) for r in got.collect()} == want


def test_columns_follow_their_mean(spark):
    rng = random.Random(3)
    cells = [(t, 1, t % 3, b, c, float(rng.randint(0, 120)), "x") for t in range(40) for b in range(rng.randint(2, 6)) for c in range(rng.randint(2, 5))]
    df = spark.createDataFrame(cells, "doc long, page int, table int, band int, cell int, x0 double, text string").repartition(3)
    want = set()
    for t in {c[0] for c in cells}:
        anchors, of = [], {}
        for c in sorted((c for c in cells if c[0] == t), key=lambda c: (c[3], c[4])):
            a = next((a for a in anchors if abs(a[0] - c[5]) <= 12), None)
            if a is None:
                anchors.append(a := [c[5], 0])
            a[0], a[1] = (a[0] * a[1] + c[5]) / (a[1] + 1), a[1] + 1
            of[c[3], c[4]] = a
        order = sorted(range(len(anchors)), key=lambda i: anchors[i][0])
        rank = {id(anchors[i]): n for n, i in enumerate(order)}
        want |= {(t, b, c, rank[id(a)]) for (b, c), a in of.items()}
    assert {(r.doc, r.band, r.cell, r["col"]) for r in layout.anchored(df).collect()} == want


def test_grid_columns_region_and_calibration(spark):
    rows, df = some_pages(spark, 4)
    want = set()
    for page, items in by_page(rows).items():
        cs = []
        for x in sorted(r[4] for r in items):
            i = next((i for i, c in enumerate(cs) if abs(c - x) <= 2), None)
            if i is None:
                cs.append(x)
            else:
                cs[i] = (cs[i] + x) / 2
        cs.sort()
        want |= {(*page, r[2], min(range(len(cs)), key=lambda i: (abs(cs[i] - r[4]), i))) for r in items}
    grid = layout.gridded(geometry.banded(df))
    assert {(r.doc, r.page, r.idx, r["col"]) for r in grid.collect()} == want

    labels = df.select("doc", "page").distinct().withColumns({"first": F.lit("a"), "last": F.lit("B")})
    inside = {(r.doc, r.page, r.idx) for r in layout.region(df, labels).collect()}
    expected = set()
    for page, items in by_page(rows).items():
        ys = [r[5] for r in items if r[3] in ("a", "B")]
        if len(ys) >= 2:
            expected |= {(*page, r[2]) for r in items if min(ys) - 1 <= r[5] <= max(ys) + 1}
    assert inside == expected


@pytest.mark.parametrize("rows,state", [
    ([("bore", 1, 10.0, "12"), ("bore", 1, 40.0, "16"), ("mass", 2, 10.0, "5 g"), ("mass", 2, 40.0, "7 g")], ("ok", 2)),
    ([("bore", 1, 10.0, "12"), ("bore", 1, 40.0, "16"), ("mass", 2, 10.0, "7"), ("mass", 2, 40.0, "8")], ("empty", None)),
    ([("bore", 1, 10.0, "16"), ("bore", 1, 40.0, "16"), ("mass", 2, 10.0, "7"), ("mass", 2, 40.0, "7")], ("ambiguous", None)),
    ([("bore", 1, 10.0, "12"), ("mass", 2, 10.0, "7")], ("missing value", None)),
    ([("mass", 2, 10.0, "7")], ("missing label", None)),
])
def test_anchors_meet_in_one_column(spark, rows, state):
    items, seen = [], set()
    for label, line, x, text in rows:
        if label not in seen:
            items.append((1, 1, len(items), label, 0.0, 100.0 - 10 * line, 5.0, 5.0))
            seen.add(label)
        items.append((1, 1, len(items), text, x, 100.0 - 10 * line, 5.0, 5.0))
    anchors = spark.createDataFrame([(1, 1, 0, "bore", "16"), (1, 1, 1, "mass", "7")], "doc long, page int, ord int, label string, expected string")
    grid = layout.gridded(geometry.banded(spark.createDataFrame(items, SCHEMA)))
    assert [(r.state, r["col"]) for r in layout.calibrated(grid, anchors).collect()] == [state]


def lay(rows):
    """Fragments of rows of (x, text), ten units apart."""
    return [(1, 1, i * 100 + j, text, float(x), 700.0 - 10 * i, 4.0 * len(text), 8.0) for i, row in enumerate(rows) for j, (x, text) in enumerate(row)]


def test_specifications_of_a_page(spark):
    rows = [
        [(0, "ELECTRICAL CHARACTERISTICS")],
        [(0, "Parameter"), (150, "Min"), (200, "Max"), (250, "Unit")],
        [(0, "Supply voltage"), (152, "10"), (251, "V")],
        [(3, "Supply current"), (149, "5"), (201, "9"), (250, "mA")],
        [(0, "Mode"), (200, "auto"), (250, "V")],
        [(0, "Bore diameter 25 mm")],
        [(0, "Operating pressure: 1 to 10 bar")],
        [(0, "Weight"), (150, "0.4"), (250, "kg")],
        [(0, "Stroke"), (150, "100"), (200, "mm")],
        [(0, "Price 25 units")],
    ]
    got = sorted((r.source, r.attribute, r.value) for r in layout.structured_specs(spark.createDataFrame(lay(rows), SCHEMA)).collect())
    assert got == sorted([
        ("table", "Supply voltage", "10 V"), ("line", "Bore diameter", "25 mm"), ("line", "Operating pressure", "1 to 10 bar"), ("table", "Weight", "0.4 kg"), ("table", "Stroke", "100 mm"),
        ("line", "Weight", "0.4 kg"), ("line", "Stroke", "100 mm"), ("line", "Supply voltage", "10 V"), ("line", "Supply current 5", "9 mA"),
    ])
    told = {r.attribute: (r.value, r.ambiguous) for r in layout.spec_rows(layout.headed(layout.anchored(geometry.tables(geometry.cells(layout.lined(spark.createDataFrame(lay(rows), SCHEMA))))))).collect()}
    assert told["Supply current"] == ("", True) and told["Mode"] == ("auto V", False)
    kinds = {r.text: r.block_type for r in layout.blocks(layout.lined(spark.createDataFrame(lay(rows), SCHEMA))).collect()}
    assert kinds["ELECTRICAL CHARACTERISTICS"] == "heading_or_label" and kinds["Bore diameter 25 mm"] == "text"


def test_parts_of_a_selection_table(spark):
    rows = [
        [(0, "Modelo")], [(0, "Datos generales del producto")],
        [(0, "Modelo")],
        [(60, "Rc3/8"), (120, "Rc1/2")],
        [(0, "AK-DPY-3"), (62, "o"), (118, "—")],
        [(0, "AK-DPY-4"), (58, "-"), (121, "x")],
        [(0, "nota")], [(0, "AK-LATE"), (60, "o")],
        [(0, "Especificaciones")],
        [(0, "Fluido"), (80, "Aire"), (110, "seco")], [(0, "stray")], [(0, "Presión"), (80, "1.0 MPa")],
        [(0, "Forma de pedido")], [(0, "Otro"), (80, "no")],
    ]
    got = {tuple(r)[1:] for r in layout.sku_tables(geometry.banded(spark.createDataFrame(lay(rows), SCHEMA))).collect()}
    shared = {(p, *x, True) for p in ("AK-DPY-3", "AK-DPY-4") for x in (("Fluido", "Aire seco"), ("Presión", "1.0 MPa"))}
    assert got == {("AK-DPY-3", "Rc3/8", "o", False), ("AK-DPY-4", "Rc1/2", "x", False)} | shared


def test_boxes_by_text_and_empty_pages(spark):
    df = spark.createDataFrame(lay([[(0, "same")], [(5, "same")], [(9, "other")]]), SCHEMA)
    found = layout.blocks(layout.lined(df))
    rows = layout.located(spark.createDataFrame([(1, 1, "same"), (1, 1, "none"), (1, 2, "same")], "doc long, page int, text string"), found).collect()
    assert {(r.page, r.text, r.x0) for r in rows} == {(1, "none", None), (1, "same", 5.0), (2, "same", None)}
    none = df.limit(0)
    assert layout.structured_specs(none).count() == layout.sku_tables(geometry.banded(none)).count() == layout.gridded(geometry.banded(none)).count() == 0

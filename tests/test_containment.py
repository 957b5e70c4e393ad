import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.operators import containment, gates
from ferrule.sources.shared import checkpointed


def pairs(spark, texts, needles):
    t = spark.createDataFrame(texts, "t long, body string").withColumn("gram", F.lit("clash")).repartition(3)
    n = spark.createDataFrame(needles, "n long, word string")
    return sorted(tuple(r) for r in containment.held(t, n, checkpointed, "t", "body", "n", "word").collect())


def brute(texts, needles):
    return sorted({(i, j) for i, x in texts for j, w in needles if x and w and w in x})


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(containment, "STEP", 50)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abéß1") for _ in range(n))
    texts = [(i, word(rng.randint(0, 200))) for i in range(80)] + [(100, None), (101, ""), (102, "a" * 5000), (103, "né"), (103, "a"), (104, "the number AB-12-345 of this")]
    needles = [(i, word(rng.randint(1, 12))) for i in range(120)] + [(200, None), (201, ""), (202, "a"), (203, "a" * 300), (204, "é"), (205, "AB-12-345"), (206, "absent words"), (207, "AB-12-345"), (208, "x" * 7000)]
    assert pairs(spark, texts, needles) == brute(texts, needles)


def test_nothing(spark):
    assert pairs(spark, [], [(1, "a")]) == [] and pairs(spark, [(1, "a")], []) == [] and pairs(spark, [(1, "bcd")], [(1, "a")]) == []


def test_needles_that_cannot_occur_are_left_out_before_any_shuffle(spark):
    texts = spark.createDataFrame([(1, "see BRAND-00007 and BRAND-00123 here")], "t long, body string")
    needles = spark.range(3000).select(F.col("id").alias("n"), F.format_string("BRAND-%05d", "id").alias("word"))
    written = []
    found = containment.held(texts, needles, lambda df: written.append(checkpointed(df)) or written[-1], "t", "body", "n", "word")
    kept = [{r._needle_id for r in df.collect()} for df in written if "_needle_id" in df.columns]
    assert len(kept) == 1 and {7, 123} <= kept[0] and len(kept[0]) < 10
    assert {tuple(r) for r in found.collect()} == {(1, 7), (1, 123)}


def test_grams_of_a_batch_of_mixed_needles():
    needles = pa.array(["skipped", "é", "ab", "abcdefgh", "a", "abcdef"])[1:]
    got = sorted((o, p, int(g)) for gram, of, place in containment._grams(needles) for g, o, p in zip(gram, of.tolist(), place.tolist(), strict=True))
    of = lambda x: len(x) << 48 | int.from_bytes(x, "big")
    want = [(0, 0, of("é".encode())), (1, 0, of(b"ab")), *((2, i, of(b"abcdefgh"[i : i + 6])) for i in range(3)), (3, 0, of(b"a")), (4, 0, of(b"abcdef"))]
    assert got == want


def test_hot_grams_meet_by_key_and_without_nested_loops(spark):
    texts = spark.range(3000).select(F.col("id").alias("t"), F.concat(F.lit("PART-NUMBER-PART-NUMBER-"), "id").alias("body"))
    needles = spark.range(300).select(F.col("id").alias("n"), F.concat(F.lit("PART-NUMBER-"), "id").alias("word"))
    found = containment.held(texts, needles, checkpointed, "t", "body", "n", "word")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(i, n) for i in range(3000) for n in range(300) if str(i).startswith(str(n))}
    assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize("label,want", [("Supply voltage", ("volt", 10014)), ("the supply voltage (max)", ("volt", 5014)), ("nominal", None), ("operating tem", ("temp", 4021)), ("temp", None), ("***", None)])
def test_alias_order(spark, label, want):
    aliases = spark.createDataFrame([("Supply-Voltage", "volt"), ("voltage", "other"), ("operating temperature", "temp"), ("", "none")], "alias string, property string")
    got = gates.alias_matches(spark.createDataFrame([(label,), (None,)], "label string"), aliases, checkpointed).collect()
    assert [tuple(r) for r in got] == ([] if want is None else [(label, *want)])

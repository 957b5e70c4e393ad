import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrule.llm import mixing as m


def corpus(spark):
    sizes = {"a": 900, "b": 300, "c": 100, None: 50}
    rows, n = [], 0
    for s, k in sizes.items():
        for i in range(k):
            rows.append((n, "w " * (1 + i % 7), s))
            n += 1
    return spark.createDataFrame([*rows, (n, None, "a"), (n + 1, "", "empty")], "doc_id long, text string, source string")


def tokens(rows):
    out = Counter()
    for s, t, k in rows:
        out[s] += k * len((t or "").split())
    return out


def test_exponent_meets_its_target(spark):
    df = corpus(spark)
    totals = m.source_totals(df, "source", m.token_count(F.col("text"))).cache()
    n = {r.source: r.tokens for r in totals.collect() if r.tokens}
    for target in (1.4, 1.8):
        a = m.exponent(totals, target_entropy=target)
        p = [x**a for x in n.values()]
        p = [x / sum(p) for x in p]
        assert -sum(x * math.log2(x) for x in p) == pytest.approx(target, abs=1e-4)
    a = m.exponent(totals, max_repetition=3.0)
    r = [x ** (a - 1) for x in n.values()]
    assert max(r) / min(r) == pytest.approx(3.0, abs=1e-3)
    assert m.exponent(totals, target_entropy=9.0, max_repetition=3.0) == pytest.approx(a, abs=1e-5)


def test_without_budget_every_row_comes_and_weights_hold(spark):
    df = corpus(spark)
    out = m.mixed(df, max_repetition=3.0, seed=4)
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) == {r.doc_id for r in df.collect()}
    got = tokens([(r.source, r.text, 1) for r in out.collect()])
    n = tokens([(r.source, r.text, 1) for r in df.collect()])
    repeated = {s: got[s] / n[s] for s in n if n[s]}
    assert repeated["a"] == 1.0 and max(repeated.values()) == pytest.approx(3.0, abs=0.05)
    # an epoch takes a row at most once, and a row's copies differ in their epoch
    assert out.groupBy("doc_id", "epoch").count().filter("count > 1").count() == 0


def test_budget_is_met_within_a_document(spark):
    df = corpus(spark)
    out = m.mixed(df, max_repetition=2.0, budget=1000, seed=1).collect()
    got = tokens([(r.source, r.text, 1) for r in out])
    assert 1000 <= sum(got.values()) <= 1000 + 7 * 4
    again = m.mixed(df.repartition(7), max_repetition=2.0, budget=1000, seed=1).collect()
    assert sorted((r.doc_id, r.epoch) for r in out) == sorted((r.doc_id, r.epoch) for r in again)
    assert {(r.doc_id, r.epoch) for r in m.mixed(df, budget=1000, seed=2).collect()} != {(r.doc_id, r.epoch) for r in out}


def test_the_join_for_very_many_sources_gives_the_same(spark, monkeypatch):
    df = corpus(spark)
    rows = lambda: sorted((r.doc_id, r.epoch) for r in m.mixed(df, budget=2000).collect())
    one = rows()
    monkeypatch.setattr(m, "BROADCAST_SOURCES", 0)
    assert rows() == one


def test_clashing_names_and_empty_table(spark):
    df = corpus(spark).withColumn("epoch", F.lit("x")).withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    assert m.mixed(df).columns == ["doc_id", "text", "source", "key", "row", "epoch", "block", "place"]
    assert m.mixed(df.limit(0)).count() == 0


def test_weights_put_no_table_in_one_task(spark):
    from ferrule.llm import mixing

    totals = spark.createDataFrame([("a", 30, 1), ("b", 10, 1), ("c", 0, 1), (None, 60, 1)], "source string, tokens long, docs long")
    out = mixing.weights(totals, 0.5)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    z = 0.3**0.5 + 0.1**0.5 + 0.6**0.5
    got = {r.source: (r.share, r.weight) for r in out.collect()}
    want = {"a": (0.3, 0.3**0.5 / z), "b": (0.1, 0.1**0.5 / z), "c": (0.0, 0.0), None: (0.6, 0.6**0.5 / z)}
    assert all(abs(x - y) < 1e-12 for k in want for x, y in zip(got[k], want[k], strict=True))
    assert mixing.weights(totals.limit(0), 0.5).count() == 0

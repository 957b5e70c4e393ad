import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import norm_buckets as nb


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for n, (q, x) in enumerate(good):
        if q % every == 0:
            scores = sorted((-max(-nb.LARGEST, min(nb.LARGEST, sum(a * b for a, b in zip(x, y, strict=True)))), c, m) for m, (c, y) in enumerate(good) if m != n and len(x) == len(y))
            out += [(q, rank, c, -s) for rank, (s, c, _) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("key", F.lit("x")).withColumn("class", F.lit(1)).repartition(5)
    return sorted(tuple(r) for r in nb.top_products(df, F.col("vec_id") % 50 == 0, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nb, "CHUNK", 64)
    monkeypatch.setattr(nb, "BLOCK", 16)


def test_lengths_copies_and_odd_rows(spark, small_blocks):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)) * np.exp(rng.standard_normal((1500, 1)))
    x[200:700] = x[0]
    x[700:730] = 0
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2050, [float("nan")] * 16), (2100, [None] + [1.0] * 15), (2150, [float("inf")] + [1.0] * 15), (None, [9.0] * 16), (2200, [1.0] * 4), (2201, [-1.0] * 4), (2250, []), (2251, []), (2300, [1.0] * 7), (2350, [0.0] * 16)]
    assert run(spark, rows) == brute(rows)


def test_near_copies_prune_by_coordinates(spark, small_blocks):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 32))
    x = base[rng.integers(0, 60, 2000)] + 0.02 * rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_large_sizes_and_nothing(spark, small_blocks):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, [1.0, 2.0]), (50, [-1.0, -1.0]), (51, [1e17, -3e17]), (100, [1e17, 1e17]), (150, [-1e200, 1.0]), (52, [1e306, 1.0])]
    assert run(spark, rows, "double") == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []


@pytest.mark.parametrize("coordinate", [0.2, 0.9, 2.0])
def test_either_pruning_finds_the_same(coordinate):
    rng = np.random.default_rng(5)
    c = np.floor(256 * rng.standard_normal((400, 12)) * np.exp(rng.standard_normal((400, 1)) / 2))
    c = c[np.argsort(-np.linalg.norm(c, axis=1))]
    q = np.floor(256 * rng.standard_normal((40, 12)))
    q[:20] = c[rng.integers(0, 400, 20)] + 3
    q = q[np.argsort(-np.linalg.norm(q, axis=1))]
    scores = q @ c.T
    bound = np.sort(scores, 1)[:, -7]
    side = lambda x, keys, bounds: {"keys": keys, "lengths": np.linalg.norm(x, axis=1), "bounds": bounds, "matrix": x}
    row, column, product = nb.searched(side(q, np.arange(1000, 1040), bound), side(c, np.arange(400), np.full(400, -np.inf)), 5, coordinate)
    want = {(i, j, scores[i, j]) for i in range(40) for j in sorted(range(400), key=lambda j: (-scores[i, j], j))[:5]}
    assert set(zip(row, column, product, strict=True)) == want and len(row) == len(want)


def test_components_lie_within_the_ranges():
    rng = np.random.default_rng(6)
    q, c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((500, 6)), rng.standard_normal((500, 6))))
    focus = np.argsort(-np.abs(q), axis=1)[:, :4]
    low, high = nb.ranges(q, (q * c).sum(1), focus)
    at = np.take_along_axis(c, focus, 1)
    assert ((low <= at) & (at <= high)).all()


def test_sql_states_the_same(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = duck.execute(nb.top_products_sql())
    names = [d[0] for d in want.description]
    got = nb.top_products(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in got.select(*names).collect())

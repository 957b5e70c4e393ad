import numpy as np
import pyarrow.parquet as pq
import pytest

from ferrule.llm.cross_polytope import buckets, hadamard, linked, most_apart, signs


def brute(rows, threshold=0.93):
    good = [(k, np.array(v, np.float64), lab) for k, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = {k: k for k, _, _ in rows}, dict.fromkeys((k for k, _, _ in rows), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[:i]:
            if la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (links[k], find(k), find(k) == k) for k, _, _ in rows}


def test_linked_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(60):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 9)):
            v = (base + rng.normal(size=64) * rng.choice([0, 0.05, 0.2, 0.3])).astype(np.float32)
            rows.append((n, [float(x) for x in v], int(rng.integers(0, 2))))
            n += 1
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None, 1.0], 1), (904, rows[0][1], None), (905, [], 1), (906, rows[0][1][:32], rows[0][2]), (907, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in linked(df.withColumn("key", df.label)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("sf", ["0.01"])
def test_full_recall_on_the_table(spark, sf):
    path = f"/root/testdata/sf{sf}/embeddings.parquet"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(path).to_pylist()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in linked(spark.read.parquet(path)).collect()}
    assert got == brute(rows)


def test_pairs_at_the_threshold_meet_in_some_bucket():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    a, b = buckets(x), buckets(y)
    met = ((a[:, :, :, None] == b[:, :, None, :1]).any((1, 2, 3))) | ((b[:, :, :, None] == a[:, :, None, :1]).any((1, 2, 3)))
    assert met.mean() >= 0.9999


def test_hadamard_keeps_length_and_odd_tables(spark):
    x = np.random.default_rng(1).normal(size=(5, 8))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.n_links, r.component_id) for r in linked(df).collect()) == [(2, 0)] * 3 or len({r.component_id for r in linked(df).collect()}) == 1
    assert linked(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [64, 384, 768])
def test_recall_at_the_threshold_by_width(width):
    rng = np.random.default_rng(width)
    n = 3000
    a = rng.standard_normal((n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal((n, width))
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * other
    found_a, found_b = buckets(a), buckets(b)
    meet = ((found_a[:, :, :1] == found_b).any(2) | (found_b[:, :, :1] == found_a).any(2)).any(1)
    apart = np.bitwise_count(signs(a).view(np.uint64) ^ signs(b).view(np.uint64)).sum(1)
    assert (meet & (apart <= most_apart(0.93))).mean() >= 0.99


def test_sizes_of_vectors_do_not_matter(spark):
    rows = [(i, [x * s, y * s, 0.0], 1) for i, (x, y, s) in enumerate([(1.0, 1.0, 1e200), (1.0, 1.01, 1e200), (1.0, 1.0, 1e-200), (1.0, 1.01, 1.0)])]
    got = linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.n_links for r in got} == {3}

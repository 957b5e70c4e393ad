import random
import re
from collections import Counter

import numpy as np

from ferrule.llm.bagminhash import FEW, REGISTERS, bags, classes, difference, jaccard, representatives, signatures

WORD = re.compile("[^\x20\x09-\x0D]+")


def bag(text):
    words = WORD.findall(text or "")
    if len(words) < 5:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def weighted(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(rows):
    rows = sorted((k, bag(t)) for k, t in rows)
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and weighted(x, y) >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k, _ in rows}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 150, 400]))]
        if rng.random() < 0.3:
            base = base[:30] * 6
        for _ in range(rng.choice([1, 2, 8])):
            words = list(base)
            for _ in range(int(len(words) * rng.choice([0, 0.005, 0.02, 0.04, 0.1]))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += rng.randint(1, 4)
    return [*rows, (5000, None), (5001, ""), (5002, " "), (5003, "a"), (5004, "a"), (5005, rows[0][1])]


def test_classes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        expected = brute(rows)
        got = {r.doc_id: r for r in classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert {k: r.class_id for k, r in got.items()} == expected
        assert all(r.kept == (k == r.class_id) for k, r in got.items())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(5):
        grams = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        one, two = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
        one[:40], two[:40] = 50, 37
        text = np.concatenate([np.zeros((one > 0).sum(), np.int64), np.ones((two > 0).sum(), np.int64)])
        least = signatures(text, np.concatenate([grams[one > 0], grams[two > 0]]), np.concatenate([one[one > 0], two[two > 0]]), 2, 4096)
        exact = np.minimum(one, two).sum() / np.maximum(one, two).sum()
        assert abs((least[0] == least[1]).mean() - exact) < 5 * np.sqrt(exact * (1 - exact) / 4096)
        assert abs(jaccard((grams[one > 0], one[one > 0]), (grams[two > 0], two[two > 0])) - exact) < 1e-12


def test_representatives_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text, 1, "x"), (3, text, 2, "y"), (3, text, 2, "y"), (4, None, 3, "z")], "doc_id long, text string, key int, class_id string")
    got = representatives(df)
    assert got.columns == df.columns and sorted((r.doc_id or 0, r.key) for r in got.collect()) == [(0, 1), (4, 3)]
    assert classes(df).count() == 4
    assert classes(df.limit(0)).count() == 0 and representatives(df.limit(0)).count() == 0
    assert bags(np.zeros(0, np.uint64), np.zeros(2, np.int64))[0].size == 0 and REGISTERS == 128


def test_large_buckets_equal_brute_force(spark):
    """Near copies at about the threshold, in groups with several variants, many more than are compared pair by pair."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(120)]
        variants = [base] + [base[:60] + [rng.choice(vocabulary) for _ in range(25)] + base[85:] for _ in range(2)]
        for _ in range(5 * FEW):
            words = list(rng.choice(variants))
            for _ in range(rng.choice([0, 1, 2, 3, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words[: rng.choice([120, 120, 110, 90])])))
    got = {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) > 20


def test_differences_tell_which_pairs_are_similar():
    rng = np.random.default_rng(3)
    grams = np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    for _ in range(300):
        draw = [rng.integers(0, 4, 60) * (rng.random(60) < 0.9) for _ in range(1)]
        draw += [np.where(rng.random(60) < 0.15, rng.integers(0, 4, 60), draw[0]) for _ in range(2)]
        hub, one, two = ((grams[d > 0], d[d > 0]) for d in draw)
        (near1, cost1, room, size1, small1, large1, parts1), (near2, cost2, _, size2, small2, large2, parts2) = (difference(hub, x, 0.8) for x in (one, two))
        shared = len(np.intersect1d(parts1, parts2))
        similar = jaccard(one, two) >= 0.8 - 1e-12
        assert (cost1 + cost2 <= room + 1.8 * shared + 1e-9) == similar
        assert size1 == len(set(parts1.tolist())) and near1 == (jaccard(hub, one) >= 0.8 - 1e-12)
        if similar and not (near1 and near2) and size1 and size2:
            # found by the prefixes, in any order of the parts
            (small, a), (large, b) = ((small1, parts1), (large2, parts2)) if cost1 <= cost2 else ((small2, parts2), (large1, parts1))
            assert np.intersect1d(np.sort(a)[:small], np.sort(b)[:large]).size


def test_different_long_words_share_nothing(spark):
    letters = lambda n, one, two: "".join(two if bin(i).count("1") % 2 else one for i in range(n))
    rows = [(1, " ".join(letters(1024, "a", "b") + str(i) for i in range(10))), (2, " ".join(letters(1024, "b", "a") + str(i) for i in range(10)))]
    assert [r.kept for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [True, True]
    long = "x" * 3_000_000
    rows = [(1, f"{long} a b c d e"), (2, f"{long} a b c d e"), (3, "y " * 400_000)]
    assert sorted(r.class_id for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 1, 3]

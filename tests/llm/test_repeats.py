import hashlib
import random
import re

import pytest

from ferrule.llm.rlz import parse
from ferrule.llm.suffix_array import repeated_spans, without_repeats

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window):
    """doc id -> (words, removed flags); rows are (id, text) in order."""
    seen, out = set(), []
    for key, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        out.append((key, words, gone))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(12)] + [f"v{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 2)
                words += p[a : a + rng.randint(10, 90)]
            else:
                words += [rng.choice(vocabulary[: rng.choice([2, 12, 400])]) for _ in range(rng.randint(1, 60))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1000 + i, "a " * 70) for i in range(3)] + [(2000, None), (2001, ""), (2002, " \n "), (2003, rows[3][1]), (2004, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_parse_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in parse(df).collect()}
    assert len(got) == len(rows)
    for key, words, gone in brute(sorted(rows), 20):
        kept = " ".join(x for x, g in zip(words, gone) if not g)
        r = got[key]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), key
        assert all(f.words >= 20 for f in r.factors)


def test_factors_point_to_earlier_equal_words(spark):
    rows = corpus(5)
    texts = {k: WORD.findall(t or "") for k, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n = 0
    for r in parse(df).collect():
        for f in r.factors:
            n += 1
            assert (f.source_key, f.source_start) < (r.doc_id, f.start)
            assert texts[r.doc_id][f.start : f.start + f.words] == texts[f.source_key][f.source_start : f.source_start + f.words]
    assert n > 50


def test_spans_equal_brute_force(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in repeated_spans(df).collect()}
    left = {r.doc_id: r.text for r in without_repeats(df.withColumn("_key", df.doc_id)).collect()}
    removed = 0
    for key, words, gone in brute(sorted(rows, key=lambda r: r[0]), 50):
        r = got[key]
        assert (r.n_words, r.n_removed) == (len(words), sum(gone)), key
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert WORD.findall(left[key] or "") == [x for x, g in zip(words, gone) if not g]
        if not any(gone):
            assert left[key] == dict(rows)[key]
        removed += sum(gone)
    assert removed > 0


def test_null_and_repeated_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (None, text), (7, text), (7, text), (8, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in parse(df).collect()) == [(0, 0), (0, 30), (7, 30), (7, 30), (8, 0)]
    empty = df.limit(0)
    assert parse(empty).count() == 0 and repeated_spans(empty).count() == 0 and without_repeats(empty).count() == 0


def alternating(n, first, second):
    """The first n letters of the Thue-Morse sequence over two letters."""
    return "".join(second if bin(i).count("1") % 2 else first for i in range(n))


def test_long_words_that_differ_are_told_apart(spark):
    for shared in (19, 49):
        rest = [f"s{i}" for i in range(shared)]
        df = spark.createDataFrame([(1, " ".join([alternating(1024, "a", "b"), *rest])), (2, " ".join([alternating(1024, "b", "a"), *rest]))], "doc_id long, text string")
        if shared == 19:
            assert [r.n_removed for r in parse(df).collect()] == [0, 0]
        assert [r.n_removed for r in repeated_spans(df).collect()] == [0, 0]
    same = spark.createDataFrame([(1, " ".join(["x" * 5000, *rest])), (2, " ".join(["x" * 5000, *rest]))], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeated_spans(same).collect()) == [0, 50]


def test_extra_columns_stay_and_one_partition_or_many_give_the_same(spark):
    rows = corpus(7, 60)
    df = spark.createDataFrame([(k, t, i, "x") for i, (k, t) in enumerate(rows)], "doc_id long, text string, gram int, runs string")
    got = {r.doc_id: r for r in without_repeats(df.repartition(1)).collect()}
    assert {(r.doc_id, r.gram, r.runs) for r in got.values()} == {(k, i, "x") for i, (k, _) in enumerate(rows)}
    spread = {r.doc_id: r.text for r in without_repeats(df.repartition(13)).collect()}
    assert spread == {k: r.text for k, r in got.items()}


def test_minimisers_in_parts():
    import numpy as np

    from ferrule.llm.repeats import minimisers

    hashes = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    counts = np.array([120, 0, 10, 370])
    whole, parts = minimisers(hashes, counts, 20, 5), minimisers(hashes, counts, 20, 5, most=64)
    at = lambda found: {(int(t), a): int(m) for t, f, e, m in zip(*found[:4]) for a in range(int(f), int(e) + 1)}
    assert at(whole) == at(parts) and len(at(whole)) == 101 + 351


def test_tables_of_steps_that_are_done_are_gone_before_the_last(spark):
    from pathlib import Path

    from ferrule.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / spark.sparkContext.applicationId
    there = lambda: set(folder.iterdir()) if folder.exists() else set()
    before = there()
    out = repeated_spans(spark.createDataFrame(corpus(3), "doc_id long, text string"))
    assert sorted(x.name.split("-")[0] for x in there() - before) == ["late", "matches", "texts"]
    assert out.count() == len(corpus(3))

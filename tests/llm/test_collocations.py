import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.llm import collocations as co

SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL))]


def brute(rows, least=10, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces_of(text):
            n[lang] += len(p)
            for size in (1, 2, 3):
                f[lang].update(tuple(p[i : i + size]) for i in range(len(p) - size + 1))
    out = []
    for lang, counts in f.items():
        good = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        longer = defaultdict(int)
        for g, a in good.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for g, a in good.items():
            if len(g) == 2 and 100 * longer[g] >= 50 * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(6)
    return sorted(tuple(r) for r in co.phrases(df, **more).collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(co, "RANGE", 200)
    rng = np.random.default_rng(1)
    words = ["the", "The", "of", "Größe", "x\x01", "x", "naïve", "a", "b\x0b", "c,", "d\t", "e.f", "g  ", "\n", "h?", "ſ", "É", "long" * 90]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 60), p=rng.dirichlet(np.ones(len(words))))), (None, "en", "de", "und", "")[i % 5]) for i in range(900)]
    rows += [(None, "en"), ("", "en"), ("word", None), ("very frequent pair " * 20_000, "en"), ("very frequent pair", "fr")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_count=30, most=7) == brute(rows, 30, 7)


def test_phrases_inside_longer_ones_and_cuts(spark):
    rows = [("new york city", "en")] * 10 + [("new york", "en")] * 10 + [("york city", "en")] * 11 + [("a b c. b c", "en")] * 10 + [("a a a a a", "en")] * 10
    got = run(spark, rows)
    assert got == brute(rows)
    assert {"new york city", "york city"} <= {r[2] for r in got} and "new york" not in {r[2] for r in got}


def test_repeated_rows_and_nothing(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("", "en"), (" \n.", "en")]) == []
    rows = [("tick tock", None)] * 3000
    assert run(spark, rows) == brute(rows)


@given(st.lists(st.text("aB .,\n\t\x0b\x00é ", max_size=30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_and_pieces(texts):
    data = [t.encode() for t in texts]
    buf = co.SMALL[np.frombuffer(b"".join(data), np.uint8)]
    starts, ends, opens = co.cut(buf, np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))
    got = []
    for s, e, o in zip(starts, ends, opens, strict=True):
        if o:
            got.append([])
        got[-1].append(bytes(buf[s:e]).decode())
    assert got == [p for t in texts for p in pieces_of(t) if p]


def test_radix_order_and_runs():
    rng = np.random.default_rng(2)
    pair, third = rng.integers(0, 1 << 40, 5000) // (1 << 33), rng.integers(0, 70_000, 5000).astype(np.int32) // 30_000
    pair = pair << 33
    order = co.radix_order(pair, third)
    assert (order == np.lexsort((third, pair))).all()
    p, t, n = co.runs(pair, third, np.arange(5000))
    want = Counter()
    for key, x in zip(zip(pair, third, strict=True), range(5000), strict=True):
        want[key] += x
    assert dict(zip(zip(p, t, strict=True), n, strict=True)) == want


@pytest.mark.parametrize("a,b,c", [(10**13, 10**14, 10**15), (999_999_999_999_999, 10**15, 10**15 + 7), (3, 7, 11), (10, 10, 10)])
def test_scores_are_exact(spark, a, b, c):
    assert spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")).select(co.score("a", "b", "c")).first()[0] == 10**6 * a * a // (b * c)


def test_sql_states_the_same(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    out = duck.execute(co.phrases_sql())
    names = [d[0] for d in out.description]
    want = sorted(out.fetchall())
    got = sorted(tuple(r) for r in co.phrases(spark.read.parquet(f"{folder}/documents.parquet")).select(*names).collect())
    assert got == want and got


def test_few_blocks_lie_in_a_row_group(spark, monkeypatch):
    """A writer or reader holds a row group: of blocks of megabytes there are few in one."""
    import pyarrow.parquet as pq

    kept = []
    monkeypatch.setattr(co, "forgotten", lambda *tables: kept.extend(tables))
    docs = spark.range(60).coalesce(1).selectExpr("repeat('ab cd ef ', 120000) as text", "'en' as lang")
    assert co.phrases(docs).count() > 0
    found = [f for df in kept if {"codes", "stream"} & set(df.columns) for f in df.inputFiles()]
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in found]
    assert groups and max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 4

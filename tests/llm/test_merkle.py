import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from ferrule.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row[c] for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Top hash, and per node its siblings and slots level by level."""
    tracks = [[i] for i in range(len(nodes))]
    paths = [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for track, path in zip(tracks, paths, strict=True):
            at = track[-1]
            path.append((runs[at // 8], at % 8))
            track.append(at // 8)
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r, leaf(r, r["text"])))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    ends, below = [], []
    for lang in langs:
        trees[lang].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        top, paths = climb([x[1] for x in trees[lang]])
        ends.append(top)
        below.append(paths)
    root, above = climb(ends) if ends else (None, [])
    out = []
    for lang, subroot, paths, rest in zip(langs, ends, below, above, strict=True):
        for (r, own), path in zip(trees[lang], paths, strict=True):
            at = own
            if r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                at = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            beside = ""
            for run, slot in path + rest:
                beside += "".join(run[:slot] + run[slot + 1 :])
                at = h("".join([*run[:slot], at, *run[slot + 1 :]]))
            out.append((r["doc_id"], own, subroot, root, h(beside), at, at == root))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("clash")).withColumn("hash", F.lit(1)).repartition(3)
    got = merkle.audited(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([dict(zip(SCHEMA.replace(" long", "").replace(" string", "").split(", "), r, strict=True)) for r in rows])
    return got


def test_equals_brute_force(spark):
    rows = [(i, f"Text {i} Größe", ("en", "de", "en", "fr")[i % 4] if i % 11 else None, "s", i) for i in range(650)]
    got = check(spark, rows)
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "A", "en", "x", 1), (5, "A", "en", "x", 1), (5, "A", "en", "x", 1), (5, "B", "en", None, 1), (6, "", "", "", 0), (7, "Ab" * 200_000, "de", "x", 9), (-3, "no capitals", "en", "x", 1)]
    check(spark, rows)


def test_many_languages_one_leaf_and_none(spark):
    check(spark, [(i, f"T{i}", f"l{i}", "s", 1) for i in range(70)])
    check(spark, [(1, "T", "en", "s", 1)])
    check(spark, [(i, "same", "en", "s", 1) for i in range(8)])
    check(spark, [(i, "same", "en", "s", 1) for i in range(65)])
    assert merkle.audited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_states_the_same(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    out = duck.execute(merkle.audited_sql())
    names = [d[0] for d in out.description]
    want = sorted(out.fetchall(), key=str)
    assert want == sorted((tuple(r) for r in merkle.audited(spark.read.parquet(f"{folder}/documents.parquet")).select(*names).collect()), key=str)


def test_stored_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, ("en", "de")[i % 2], h(str(i))) for i in range(100)], "id long, lang string, hash string")
    made = merkle.manifest(rows)
    made.write(str(tmp_path / "m"))
    read = merkle.Manifest.read(spark, str(tmp_path / "m"))
    assert read.root() == made.root() and len(made.root()) == 64
    path = lambda m: sorted((r.id, [tuple(p) for p in r.path]) for r in m.proofs().collect())
    assert path(read) == path(made)

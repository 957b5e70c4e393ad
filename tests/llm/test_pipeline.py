"""Every stage of the pipeline against brute force on its own input."""

import base64
import hashlib
import sys
from pathlib import Path

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from ferrule.llm.vocabularies import path

sys.path.insert(0, str(Path(__file__).parent))
from test_bagminhash import brute as near  # noqa: E402
from test_fertility import base  # noqa: E402
from test_repeats import WORD  # noqa: E402
from test_repeats import brute as repeats  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        inputs[name] = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, SF)
        if name != "byte-level bpe":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    result = sorted(tuple(r) for r in docs.collect())
    assert result == sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())

    ids = lambda name: [r["doc_id"] for r in inputs[name]]
    failed = {r["doc_id"] for r in inputs["quality rules"] if (b := base(r["text"]))[0] < 50 or 100 * b[4] > 50 * b[0]}
    gone = set(ids("quality rules")) - set(ids("minhash near-dedup"))
    assert failed <= gone and len(gone - failed) <= 0.01 * len(ids("quality rules"))

    group = near([(r["doc_id"], r["text"]) for r in inputs["minhash near-dedup"]])
    assert sorted(ids("suffix-array dedup")) == sorted(k for k, g in group.items() if k == g)

    left = {r["doc_id"]: r for r in inputs["source mixing"]}
    assert sorted(left) == sorted(ids("suffix-array dedup"))
    for key, words, out in repeats(sorted((r["doc_id"], r["text"]) for r in inputs["suffix-array dedup"]), 50):
        assert WORD.findall(left[key]["text"]) == [x for x, g in zip(words, out) if not g]
        assert left[key]["n_chars"] == len(left[key]["text"])

    assert set(ids("byte-level bpe")) == set(left)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in inputs["byte-level bpe"]:
        i = library.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert result == sorted(want)


def test_an_empty_table_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as bigint) n_chars")
    for i, rows in enumerate((docs.limit(0), odd.unionByName(docs.limit(30)).unionByName(docs.limit(3)))):
        folder = str(tmp_path / str(i))
        rows.write.parquet(f"{folder}/documents.parquet")
        assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

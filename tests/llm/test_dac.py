import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ferrule.llm import dac
from ferrule.llm.dac import Codes, coded, digests, read, segments, tokens_at
from ferrule.llm.vocabularies import path


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_any_token(n):
    ids = np.random.default_rng(n).choice([3, 255, 256, 70_000, 49_000, 1 << 25], n).astype(np.uint32)
    codes = Codes(coded(ids))
    assert (codes.all() == ids).all()
    at = np.random.default_rng(1).integers(0, max(n, 1), 300 if n else 0)
    assert (codes.at(at) == ids[at]).all()


def texts():
    rng = random.Random(4)
    parts = ["The", "thand,", "été", "ÉTÉ", "日本 語", "ΑΣ ΑΣ.", "don't", "1234", "<|endoftext|>", "x<|startoftext|>", "\x1c", "\x00", "  ", "\t\n", "́a", "é", "İſ", "😀!!", " ", "'S"]
    out = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    return [*out, "", None, "word " * 4000, "z" * 2000]


def test_digests_equal_the_library(spark):
    rows = [(7 * i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in digests(df).collect()}
    start, every = 0, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)
        every += ids
    files = segments(df)
    assert {r.doc_key: r.ids for r in read(files).collect()}[14] == every[got[14].start : got[14].start + got[14].n_tokens]
    at = sorted(random.Random(1).sample(range(len(every)), 200))
    assert [(r.position, r.id) for r in tokens_at(files, at).orderBy("position").collect()] == [(i, every[i]) for i in at]


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a"), (3, "b c"), (3, "b c"), (3, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in digests(df).collect())
    assert got == [(0, None, 2), (2, 3, 1), (3, 3, 3), (6, 3, 3)]
    assert digests(df.limit(0)).count() == 0


def ids_of(code, words):
    data = [x.encode() for x in words]
    solid = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    found, cuts, before = dac.pieces(np.frombuffer(b"".join(data), np.uint8), solid)
    values, sizes = code(found, cuts)
    edge = np.concatenate([[0], np.cumsum(sizes)])[before]
    return [values[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def test_pieces_of_odd_words_equal_the_library():
    rng, library = random.Random(9), Tokenizer.from_file(path("word_bpe_49k.json"))
    parts = ["H\u0331", "I\u0307", "\u0130", "\u00d7", "\u00f7", "\u00c9", "\u017f", "\u0149", "'S", "'", "'re", "<|", "|>", "<", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "\u0661", ".", ",,", "##", "a", "Bc", "\x7f", "\x1c", "\u00a0", "\u03a3", "\u2014", "\U0001f600", "z" * 70]
    words = [*parts, *("".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(3000))]
    code = dac._encoder.__wrapped__(path("word_bpe_49k.json"))
    for _ in range(2):  # new pieces, then remembered ones
        for word, ids in zip(words, ids_of(code, words), strict=True):
            assert ids == library.encode(word, add_special_tokens=False).ids, repr(word)


def test_forms_of_a_word_are_encoded_once():
    code = dac._encoder.__wrapped__(path("word_bpe_49k.json"))
    asked, encode = [], code.encode
    code.encode = lambda p: asked.append(p) or encode(p)
    ids_of(code, ["Thatén", "thatén,", "THATén.", "thatén###", "thatén12"])
    ids_of(code, ["thatén", "thatén2"])
    assert sorted(asked) == sorted(x.encode() for x in ["thatén", ",", ".", "###", "1", "2"])

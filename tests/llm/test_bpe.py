import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import bpe
from ferrule.llm.bpe import Prefixes, decode, encode, round_trip, vocabulary
from ferrule.llm.vocabularies import Ragged, Remembered, path

FILE = path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


SPACES = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0      　​"


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "thand", "é", "ße", "日本", "x", "'ll", "'s", "12", "½", "!!", "...", "́", "😀", "ñ", "Ünder", "a" * 40, "<|endoftext|>", "\x00", "\x7f"]
    return ["".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice(SPACES) * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_round_trip_equals_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate([*texts(1, 3000), "", " ", "word " * 5000, "z" * 3000, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in round_trip(df).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(t)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.data())
def test_appends_and_edits_equal_encoding_anew(data, draw):
    v = vocabulary(FILE)
    own = Prefixes(v)
    for i in range(0, len(data), 7):
        own.append(data[i : i + 7])
    assert own.ids() == [v.ranks[p] for p in v.merged(data)]
    a = draw.draw(st.integers(0, len(data)))
    b = draw.draw(st.integers(a, len(data)))
    new = draw.draw(st.binary(max_size=5))
    own.replace(a, b, new)
    assert own.ids() == [v.ranks[p] for p in v.merged(data[:a] + new + data[b:])]


def test_edit_of_a_long_text_stays_near():
    v = vocabulary(FILE)
    data = "".join(random.Random(3).choice(["ther", "ing", "on", "st", "qu", "x"]) for _ in range(4000)).encode()
    own = Prefixes(v, data)
    looked = own.replace(100, 102, b"zz")
    assert looked < 5 * v.longest and own.ids() == Prefixes(v, data[:100] + b"zz" + data[102:]).ids()


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", 5, None)], "doc_id long, text string, ids int, decoded string")
    assert encode(df).columns == ["doc_id", "text", "decoded", "ids"]
    assert decode(encode(df)).collect()[0].decoded == b"a b"
    assert round_trip(df.limit(0)).count() == 0


def split(rows):
    data = [t.encode() for t in rows]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def test_a_later_block_encodes_only_new_chunks(monkeypatch):
    seen, encode_ = [], bpe.Tables.encode
    monkeypatch.setattr(bpe.Tables, "encode", lambda self, pieces: seen.append(pieces) or encode_(self, pieces))
    first, second = ["qwzx uvvwq xqzzk!", "uvvwq"], ["xqzzk! uvvwq", "a qwzx uvvwq xqzzk!", "zzqqy uvvwq"]
    bpe.encoded(*split(first), FILE, P.PATTERN)
    bpe.encoded(*split(second), FILE, P.PATTERN)
    assert sorted(seen[1]) == [b" qwzx", b"!", b"a", b"xqzzk", b"zzqqy"] and b" uvvwq" in seen[0]


def test_blocks_equal_the_library_while_what_is_remembered_goes(library, monkeypatch):
    known = Remembered(60)
    monkeypatch.setattr(bpe, "_remembered", lambda file, pattern: known)
    rows = texts(7, 600)
    for i in range(0, 600, 20):
        values, edge = bpe.encoded(*split(rows[i : i + 20]), FILE, P.PATTERN)
        assert [values[a:b].tolist() for a, b in zip(edge, edge[1:], strict=False)] == [library.encode_ordinary(t) for t in rows[i : i + 20]]
        assert len(known.met) <= 60


def test_remembered_tells_equal_first_hashes_apart():
    known = Remembered(4)
    u = lambda *x: np.array(x, np.uint64)
    known.add(u(1, 5), u(10, 50), Ragged.of(np.array([7, 8, 9], np.int32), np.array([0, 2, 3])))
    assert known.find(u(1, 5, 5), u(10, 50, 51)).tolist() == [0, 1, -1]
    known.add(u(0), u(0), Ragged.of(np.array([4], np.int32), np.array([0, 1])))
    row = known.find(u(0, 1), u(0, 10))
    assert known.ids.take(row)[0].tolist() == [4, 7, 8]

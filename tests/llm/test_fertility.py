import random
import re
from collections import Counter

import pytest

from ferrule.llm.fertility import judged, kept

WORD = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rng = random.Random(6)
    parts = ["the", "été", "日本", "a|b", "<x>", "##", "\n", "\n", "a", "b", " \n", "\t", "é\n"]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(800)]
    return [*out, "", None, "\n\n", "x", "a b c a b c", "one two three " * 60, "\nq", "q\n"]


def test_base_counts_equal_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)).collect()}
    for i, t, _ in rows:
        r, b = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, repr(t)
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)


def test_measures_equal_the_libraries(spark):
    import math

    import sentencepiece
    import tiktoken

    from ferrule.llm.vocabularies import path, ranks
    from public_tokenizers import PATTERN

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in judged(df).collect()}
    for row in df.limit(40).collect():
        words = WORD.findall(row.text)
        ids = [i for x in words for i in pieces.encode(x)]
        r, counts = got[row.doc_id], Counter(ids)
        chars = sum(map(len, words))
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
        assert r.n_tokens == len(ids) and r.chars_per_token == pytest.approx(chars / len(ids))
        assert r.chars_per_byte_token == pytest.approx(chars / sum(len(bpe.encode_ordinary(" " + x)) for x in words))
        assert r.fallback_share == pytest.approx(sum(pieces.IsByte(i) for i in ids) / len(ids))
        assert r.token_entropy == pytest.approx(entropy / math.log2(min(len(ids), 1024)) if len(ids) > 1 else 0.0, abs=1e-9)


def test_prose_stays_and_noise_goes(spark):
    rng = random.Random(1)
    english = ("It was a bright cold day in April, and the clocks were striking thirteen while people hurried along the street "
               "past doors that nobody had painted since the last war ended and the factories closed one after another without notice "
               "so that children played in the yards where lorries once stood waiting for the morning shift to begin")
    russian = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по своему; " + " ".join(rng.choice(["мысль", "дом", "река", "город", "вечер"]) + rng.choice(["ами", "ою", "ы", "у", "ных"]) for _ in range(60))
    noise = " ".join("".join(chr(rng.randint(0x2580, 0x2BFF)) for _ in range(8)) for _ in range(80))
    digits = " ".join("".join(rng.choice("01") for _ in range(300)) for _ in range(60))
    df = spark.createDataFrame([(1, english, "en"), (2, russian, None), (3, noise, "en"), (4, digits, "en")], "doc_id long, text string, lang string")
    verdict = {r.doc_id: r.kept for r in judged(df).collect()}
    assert verdict == {1: True, 2: True, 3: False, 4: False}
    out = kept(df.withColumn("_fertility", df.doc_id).withColumn("_band", df.doc_id))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, None), (1, "a", None), (1, "a", None)], "doc_id long, text string, lang string")
    assert [r.kept for r in judged(df).collect()] == [False] * 3
    assert judged(df.limit(0)).count() == 0 and kept(df.limit(0)).columns == df.columns


def test_a_verdict_depends_on_the_row_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
    verdict = lambda rows: {r.doc_id: r.kept for r in judged(rows).collect()}
    whole = verdict(df)
    for part in (df.filter("doc_id % 20 = 0"), df.filter("doc_id % 2 = 1"), df.unionByName(df.filter("doc_id < 60")), df.filter("doc_id = 83"), df.filter("doc_id = 30")):
        assert all(whole[i] == ok for i, ok in verdict(part).items())
    assert {r.doc_id for r in kept(df).collect()} == {i for i, ok in whole.items() if ok}


def test_laden_prose_goes_and_clean_prose_stays(spark):
    """Documents without symbols, as they are and with bars between their words."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if not re.search(r"[#*$%&|<>]", r.text)]
    docs = [d for d in docs if len(WORD.findall(d[1])) >= 100]
    laden = [(i, " | ".join(WORD.findall(t)), lang) for i, t, lang in docs[:40]]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clean, noisy = ([r for r in judged(frame(rows)).collect() if not r.base_failed] for rows in (docs, laden))
    assert len(clean) > 400 and all(r.kept for r in clean)
    assert len(noisy) >= 30 and sum(r.kept for r in noisy) == 0


def test_a_very_long_text(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice(["the", "or", "an", "ing", "st", "wh", "ou", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(400_000))
    r = judged(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    assert r.n_words == 400_000 and r.word_chars == len(text) - 399_999

"""Substring deduplication by relative Lempel-Ziv parsing.

Every block of texts is a reference block. Its phrases are indexed by content: for every window of `window` words the
leftmost least k-gram inside it is its minimiser, and the words of consecutive windows with the same minimiser are a
phrase, so that equal passages have equal phrases inside, whatever surrounds them. A phrase that an earlier place holds
as well is a hit, and a text is parsed greedily: a factor begins at the first hit and goes on as long as the next words
follow it in the source too. The words of the factors are the duplicate spans.

Where factors end or begin, windows straddle phrases that differ further out. A window of a phrase's first place can
have an earlier copy only in another phrase's first place with the same k-gram, so only phrases whose k-gram begins
another phrase as well are checked, window by window, and what is found there makes the factors longer.

Copies inside a block are resolved there and don't enter the index under their k-gram, so a passage that a third of the
texts hold sends one row a block. Phrases and windows are told apart by 128-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .common import keyed, plain_ids, saved, tidied
from .repeats import minimisers, ragged

FACTORS = "array<struct<start: int, words: int, source_key: long, source_start: int>>"
FIELDS = [
    ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("kept_sha256", pa.string()),
    ("factors", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source_key", pa.int64()), ("source_start", pa.int32())]))),
]
RESULT = f"n_words long, n_removed long, kept_sha256 string, factors {FACTORS}"
PHRASES = "gram long, content long, _key long, start int, windows int, source_key long, source_start int"


def _firsts(order: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in an order: which equal the one before in the columns, and the first of each run of equal ones."""
    same = np.concatenate([[False], np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])])
    return same, order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]


def _phrases(window: int, k: int) -> Callable:
    """The index rows of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in w.blocks(batches, "text"):
            buf, bounds = w.buffer(block.column("text"))
            starts, ends, counts = w.spans(buf, bounds)
            hashes = w.word_hashes(buf, starts, ends)
            text, first, last, at, gram = minimisers(hashes, counts, window, k)
            if not len(text):
                continue
            before = np.cumsum(counts) - counts
            keys = block.column("_key").to_numpy()[text]
            # a phrase is less than two windows long: its first and last window say what it is
            whole = w.grams(w.word_hashes(buf, starts, ends, 1), window)
            gram, content = gram[at], w.combined(w.combined(whole[first], whole[last]), (last - first).astype(np.uint64))
            start = (first - before[text]).astype(np.int32)
            order = np.lexsort((start, keys, content, gram))
            same, head = _firsts(order, gram, content)
            source_key, source_start = np.full(len(text), -1), np.full(len(text), -1, np.int32)
            copy = order[same]
            source_key[copy], source_start[copy] = keys[head[same]], start[head[same]]
            # a copy inside this block is settled: it goes to a partition of its own choice, not to its k-gram's
            gram[copy] = w.mix(keys[copy].astype(np.uint64) * np.uint64(w.BASES[1]) + start[copy].astype(np.uint64))
            columns = [gram.view(np.int64), content.view(np.int64), keys, start, (last - first + 1).astype(np.int32), source_key, source_start]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in PHRASES.split(", ")])

    return run


def hits(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Per text (_key) its phrases that an earlier place holds (source_start >= 0) or that have to be checked (source_start < 0)."""
    rows = docs.select("_key", "text").mapInArrow(_phrases(window, k), PHRASES)
    place = F.struct(F.col("_key").alias("key"), "start")
    # local copies sit alone under a mixed k-gram; the neighbours of the others in sorted order are their copies
    by_content = Window.partitionBy("gram", "content").orderBy("_key", "start")
    by_gram = Window.partitionBy("gram")
    rows = rows.withColumn("least", F.first(place).over(by_content)).withColumn("many", F.min("content").over(by_gram) != F.max("content").over(by_gram))
    earlier = (F.col("least.key") != F.col("_key")) | (F.col("least.start") != F.col("start"))
    local = F.col("source_start") >= 0
    rows = rows.filter(local | earlier | F.col("many")).select(
        "_key",
        F.struct(
            "start",
            "windows",
            F.when(local, F.col("source_key")).when(earlier, F.col("least.key")).otherwise(F.lit(-1)).alias("source_key"),
            F.when(local, F.col("source_start")).when(earlier, F.col("least.start")).otherwise(F.lit(-1)).alias("source_start"),
        ).alias("s"),
    )
    return rows.groupBy("_key").agg(F.collect_list("s").alias("phrases"))


def factors(found: np.ndarray, window: int) -> np.ndarray:
    """Greedy parse. found: repeated windows (start, source key, source start), sorted. A factor (start, words, source key,
    source start) takes in window after window as long as they follow each other in its source."""
    if not len(found):
        return np.zeros((0, 4), np.int64)
    new = np.flatnonzero(np.concatenate([[True], (found[1:, 0] != found[:-1, 0] + 1) | (found[1:, 1] != found[:-1, 1]) | (found[1:, 2] != found[:-1, 2] + 1)]))
    last = np.concatenate([new[1:], [len(found)]]) - 1
    return np.stack([found[new, 0], found[last, 0] - found[new, 0] + window, found[new, 1], found[new, 2]], 1)


def removed(parsed: np.ndarray, n_words: int) -> np.ndarray:
    """Of each word: whether a factor holds it."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, parsed[:, 0], 1)
    np.add.at(edge, parsed[:, 0] + parsed[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _finish(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: np.ndarray, window: int) -> tuple:
    """The fields of a text with its repeated windows."""
    parsed = factors(found, window)
    gone = removed(parsed, len(starts))
    raw = data.tobytes()
    kept = b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
    listed = [{"start": a, "words": n, "source_key": key, "source_start": s} for a, n, key, s in parsed.tolist()]
    return len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), listed


def _expanded(phrases: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Repeated windows (start, source key, source start), and starts of windows to be checked."""
    if not phrases:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    s = np.array([(x["start"], x["windows"], x["source_key"], x["source_start"]) for x in phrases], np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    row, step = ragged(s[:, 1])
    each, done = s[row], s[row, 3] >= 0
    at = each[:, 0] + step
    return np.stack([at, each[:, 2], each[:, 3] + step], 1)[done], at[~done]


OPEN = "_key long, open array<struct<high: long, low: long, start: int>>, known binary, text string"
OPEN_TYPE = pa.list_(pa.struct([("high", pa.int64()), ("low", pa.int64()), ("start", pa.int32())]))


def _parsed(docs: DataFrame, window: int, k: int) -> DataFrame:
    """_key and the fields of every text of docs (a unique _key, text)."""
    joined = docs.select("_key", "text").join(hits(docs, window, k), "_key", "left")
    names = [n for n, _ in FIELDS]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without windows to be checked are parsed; the others wait with the hashes of those windows."""
        for block in w.blocks(batches, "text"):
            buf, bounds = w.buffer(block.column("text"))
            starts, ends, counts = w.spans(buf, bounds)
            before = np.cumsum(counts) - counts
            keys = block.column("_key").to_numpy()
            found = [_expanded(x) for x in block.column("phrases").to_pylist()]
            sizes = np.array([len(x[1]) for x in found])
            text, _ = ragged(sizes)
            at = np.concatenate([np.zeros(0, np.int64), *(x[1] + b for x, b in zip(found, before, strict=True))])
            start = at - before[text]
            high, low = (w.grams(w.word_hashes(buf, starts, ends, seed), window)[at].view(np.int64) for seed in (0, 1)) if len(at) else (at, at)
            source = np.full((len(at), 3), -1)
            if len(at):
                order = np.lexsort((start, keys[text], low, high))
                same, head = _firsts(order, high, low)
                copy = order[same]
                source[copy] = np.stack([start[copy], keys[text[head[same]]], start[head[same]]], 1)
            rest = source[:, 0] < 0
            left = np.bincount(text[rest], minlength=len(keys))
            edge, out = np.concatenate([[0], np.cumsum(sizes)]), [[] for _ in (*names, "known")]
            for i in range(len(keys)):
                known = found[i][0]
                if (done := source[edge[i] : edge[i + 1]][~rest[edge[i] : edge[i + 1]]]).size:
                    known = np.concatenate([known, done])
                    known = known[np.argsort(known[:, 0], kind="stable")]
                mine = slice(before[i], before[i] + counts[i])
                values = (None,) * len(names) if left[i] else _finish(buf[bounds[i] : bounds[i + 1]], starts[mine] - bounds[i], ends[mine] - bounds[i], known, window)
                for x, v in zip(out, (*values, known.astype(np.int64).tobytes() if left[i] else None), strict=True):
                    x.append(v)
            windows = pa.StructArray.from_arrays([pa.array(high[rest]), pa.array(low[rest]), pa.array(start[rest].astype(np.int32))], names=["high", "low", "start"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), windows)
            fields = [pa.array(x, t) for x, (_, t) in zip(out, FIELDS, strict=False)]
            yield pa.RecordBatch.from_arrays([block.column("_key"), lists, pa.array(out[-1], pa.binary()), w.only(block.column("text"), left > 0), *fields], names=["_key", "open", "known", "text", *names])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in w.blocks(batches, "text"):
            buf, bounds = w.buffer(block.column("text"))
            starts, ends, counts = w.spans(buf, bounds)
            before, out = np.cumsum(counts) - counts, [[] for _ in FIELDS]
            for i, (known, more) in enumerate(zip(block.column("known").to_pylist(), block.column("late").to_pylist(), strict=True)):
                found = np.frombuffer(known, np.int64).reshape(-1, 3)
                if more:
                    found = np.concatenate([found, np.array([(x["start"], x["key"], x["from"]) for x in more], np.int64)])
                    found = found[np.argsort(found[:, 0], kind="stable")]
                mine = slice(before[i], before[i] + counts[i])
                for x, v in zip(out, _finish(buf[bounds[i] : bounds[i + 1]], starts[mine] - bounds[i], ends[mine] - bounds[i], found, window), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([block.column("_key"), *(pa.array(x, t) for x, (_, t) in zip(out, FIELDS, strict=True))], names=["_key", *names])

    checked = saved(joined.select("_key", "text", "phrases").mapInArrow(check, f"{OPEN}, {RESULT}"), "checked")
    del joined
    tidied(docs.sparkSession)
    waiting = checked.filter("text is not null")
    windows = waiting.select("_key", F.explode("open").alias("o")).select("_key", "o.*")
    least = windows.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(F.struct(F.col("_key").alias("key"), "start")).alias("least")).filter("n > 1").select("high", "low", "least")
    late = windows.join(least, ["high", "low"]).filter((F.col("least.key") != F.col("_key")) | (F.col("least.start") != F.col("start")))
    late = late.groupBy("_key").agg(F.collect_list(F.struct("start", F.col("least.key").alias("key"), F.col("least.start").alias("from"))).alias("late"))
    last = waiting.select("_key", "text", "known").join(late, "_key", "left").mapInArrow(end, f"_key long, {RESULT}")
    return checked.filter("text is null").select("_key", *names).unionByName(last)


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, k: int = 5) -> DataFrame:
    """Factors of every text and the digest of its words outside them.

    Returns id_col, n_words, n_removed, kept_sha256 and factors (start, words, source_key, source_start; the
    source is an earlier place with the same words, keys being ids where those are unique). A word is removed if a
    window of `window` words covers it whose words also start earlier: in a row with a smaller id, or before in the
    same text. Null and empty texts have no words; texts shorter than a window keep all. Ids that are null or
    repeated: every row is a text of its own, in order of id (nulls first) and then the other columns, so the second
    of two equal rows is a copy. Other columns of docs are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    plain = plain_ids(own)
    rows = keyed(own, plain=plain)
    out = _parsed(rows, window, k)
    if plain:
        return out.select(F.col("_key").cast(own.schema["doc_id"].dataType).alias(id_col), "n_words", "n_removed", "kept_sha256", "factors")
    return rows.select("_key", F.col("doc_id").alias(id_col)).join(out, "_key").select(id_col, "n_words", "n_removed", "kept_sha256", "factors")

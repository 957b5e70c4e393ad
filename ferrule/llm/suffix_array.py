"""Substring deduplication with a sparse suffix array.

For every window of `window` words the leftmost least k-gram inside it is its minimiser. Only the suffixes that begin
at minimisers are retained, and of these only the ones whose first k words begin another retained suffix as well: equal
windows have equal minimisers at equal offsets, so no other suffix can lie in a repeat.

The retained suffixes of all texts are sorted by their words (range partitions by content, then place), and each is
compared with its neighbours in that order: how many words they share from the minimiser on, and how many before it. A
match extended so to the left and to the right settles all windows around the minimiser that lie inside it. Windows
that no match with a neighbour settles (their earlier copy is a suffix further off in the order, or there is none) are
compared by 128-bit hashes of their words with the other unsettled windows of suffixes with the same first words.

No task holds a group: the order is cut by content and place, first places are pre-aggregated, and joins can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import forgotten, keyed, saved, tidied
from .repeats import minimisers, ragged

SPANS = "array<struct<start: int, end: int, first_doc: long>>"
SPANS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc", pa.int64())]))
POSITIONS = "gram long, _key long, place int, first int, last int"
SUFFIX = pa.struct([("gram", pa.int64()), ("lead", pa.bool_()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])
SUFFIX_SQL = "array<struct<gram: long, lead: boolean, place: int, first: int, last: int, before: binary, after: binary>>"
MATCHES = "_key long, place int, gram long, lead boolean, first int, last int, low int, high int, source_key long, shift int, words binary, n_before int"


def _positions(window: int, k: int) -> Callable:
    """Minimisers of every text with the windows that they are the minimiser of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in w.blocks(batches, "text"):
            buf, bounds = w.buffer(block.column("text"))
            starts, ends, counts = w.spans(buf, bounds)
            text, first, last, at, gram = minimisers(w.word_hashes(buf, starts, ends), counts, window, k)
            before = (np.cumsum(counts) - counts)[text]
            columns = [gram[at].view(np.int64), block.column("_key").to_numpy()[text], *((x - before).astype(np.int32) for x in (at, first, last))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["gram", "_key", "place", "first", "last"])

    return run


def _retained(docs: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Per text (_key) its minimisers whose k-gram begins several suffixes (lead marks the earliest of a k-gram), and the written
    table of those k-grams."""
    rows = docs.select("_key", "text").mapInArrow(_positions(window, k), POSITIONS)
    shared = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min(F.struct("_key", "place")).alias("least")).filter("n > 1").select("gram", "least")
    # written, so that the join can be split where a k-gram is in very many texts
    shared = saved(shared, "shared")
    tidied(docs.sparkSession)
    kept = rows.join(shared, "gram").withColumn("lead", (F.col("least._key") == F.col("_key")) & (F.col("least.place") == F.col("place")))
    return kept.groupBy("_key").agg(F.collect_list(F.struct("gram", "lead", "place", "first", "last")).alias("suffixes")), shared


def _words_of(column: pa.Array, width: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first words of each value (the last ones, nearest first, if last) as rows of a matrix, and their number."""
    buf, bounds = w.buffer(column)
    starts, ends, counts = w.spans(buf, bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros((len(counts), width), np.uint64)
    out[row, np.repeat(counts, counts) - 1 - nth if last else nth] = w.word_hashes(buf, starts, ends)
    return out, counts


def _shared(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading columns are equal, `most` at most."""
    same = a == b
    return np.minimum(np.where(same.all(1), a.shape[1], same.argmin(1)), most)


def _neighbours(window: int, k: int) -> Callable:
    """Rows come in the order of the suffix array: each gets the windows (low..high) settled by one of its two neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before waits for its other neighbour
        for batch in batches:
            if batch.num_rows:
                rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                if rows.num_rows > 1:
                    yield compared(rows, batch_first=held is None).slice(0 if held is None else 1, rows.num_rows - (1 if held is None else 2))
                held = rows.slice(max(0, rows.num_rows - 2))
        if held is not None:
            yield compared(held, batch_first=False).slice(held.num_rows - 1)
        w.released()

    def compared(rows: pa.RecordBatch, batch_first: bool) -> pa.RecordBatch:
        key, place, first, last = (rows.column(c).to_numpy().astype(np.int64) for c in ("_key", "place", "first", "last"))
        after, n_after = _words_of(rows.column("after"), window, False)
        before, n_before = _words_of(rows.column("before"), window - k, True)
        low, high, source, shift = (np.zeros(len(key), np.int64) for _ in range(4))
        high[:] = -1
        if len(key) > 1:
            right = _shared(after[1:], after[:-1], np.minimum(n_after[1:], n_after[:-1]))
            left = _shared(before[1:], before[:-1], np.minimum(n_before[1:], n_before[:-1]))
            for mine, other in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                earlier = (key[other] < key[mine]) | ((key[other] == key[mine]) & (place[other] < place[mine]))
                a = np.maximum(first[mine], place[mine] - left)
                b = np.minimum(last[mine], place[mine] + right - window)
                better = earlier & (b >= a) & (b - a > high[mine] - low[mine])
                for column, value in ((low, a), (high, b), (source, key[other]), (shift, place[other] - place[mine])):
                    column[mine] = np.where(better, value, column[mine])
        settled = (low <= first) & (high >= last)
        context = pa.compute.binary_join_element_wise(rows.column("before"), rows.column("after"), b" ")
        columns = [rows.column(c) for c in ("_key", "place", "gram", "lead", "first", "last")]
        found = [pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(source), pa.array(shift.astype(np.int32)), w.only(context, ~settled), pa.array(n_before.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*columns, *found], names=[x.split()[0] for x in MATCHES.split(", ")])

    return run


def _unsettled(window: int) -> Callable:
    """The windows of a suffix that no neighbour settled, by hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in w.blocks(iter([batch]), "words"):
                buf, bounds = w.buffer(rows.column("words"))
                starts, ends, counts = w.spans(buf, bounds)
                key, place, first, last, low, high, n_before = (rows.column(c).to_numpy().astype(np.int64) for c in ("_key", "place", "first", "last", "low", "high", "n_before"))
                row, step = ragged(last - first + 1)
                start = first[row] + step
                rest = (start < low[row]) | (start > high[row])
                row, start = row[rest], start[rest]
                at = (np.cumsum(counts) - counts + n_before - place)[row] + start
                both = [w.grams(w.word_hashes(buf, starts, ends, seed), window)[at].view(np.int64) for seed in (0, 1)] if len(at) else [at, at]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*both, key[row], start.astype(np.int32))], names=["one", "two", "_key", "start"])

    return run


class Text:
    """A text's bytes and word bounds, and the runs of its repeated windows (first, last, source key), sorted."""

    def __init__(self, data: memoryview, starts: np.ndarray, ends: np.ndarray, runs: np.ndarray, window: int):
        self.data, self.starts, self.ends, self.runs = data, starts, ends, runs
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, runs[:, 0], 1)
        np.add.at(edge, runs[:, 1] + window, -1)
        self.gone = np.cumsum(edge[:-1]) > 0

    def spans(self) -> list[dict]:
        """Maximal runs of repeated words, with an earlier text of their first window."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], self.gone, [False]]).astype(np.int8)))
        first = np.searchsorted(self.runs[:, 0], edge[::2])
        return [{"start": int(a), "end": int(b), "first_doc": int(self.runs[i, 2])} for a, b, i in zip(edge[::2], edge[1::2], first, strict=True)]

    def without(self) -> bytes:
        """The text's bytes without the words gone and the white space after each of them."""
        data = np.frombuffer(self.data, np.uint8)
        if not self.gone.any():
            return data.tobytes()
        until = np.append(self.starts[1:], len(data))
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, self.starts[self.gone], 1)
        np.add.at(edge, until[self.gone], -1)
        kept = data[np.cumsum(edge[:-1]) == 0]
        if self.gone[-1]:  # the last word left keeps no trailing white space
            solid = np.flatnonzero(~w.SPACE[kept])
            kept = kept[: solid[-1] + 1] if len(solid) else kept[:0]
        return kept.tobytes()


NO_RUNS = np.zeros((0, 3), np.int64)


def deduplicated(docs: DataFrame, window: int, k: int, finish: Callable[[Text], tuple], result: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """finish() of every text of docs (a unique `_key`, `text`, and other columns, which come along). finish(Text) returns a
    tuple of the fields in `result` (as a DDL string) and `fields` (as Arrow types)."""
    extra = [c for c in docs.columns if c not in ("_key", "text")]
    names = [n for n, _ in fields]
    passed = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*extra).schema] if extra else []

    def finished(block: pa.RecordBatch, buf: np.ndarray, bounds: np.ndarray, spans: tuple, runs: list[np.ndarray | None]) -> list[pa.Array]:
        starts, ends, counts = spans
        before, out = np.cumsum(counts) - counts, [[] for _ in fields]
        for i, mine in enumerate(runs):
            own = slice(before[i], before[i] + counts[i])
            values = (None,) * len(fields) if mine is None else finish(Text(buf[bounds[i] : bounds[i + 1]].data, starts[own] - bounds[i], ends[own] - bounds[i], mine, window))
            for x, v in zip(out, values, strict=True):
                x.append(v)
        return [*(pa.array(x, t) for x, (_, t) in zip(out, fields, strict=True)), *(block.column(c) for c in extra)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without suffixes are finished; the others come with their suffixes' words."""
        for block in w.blocks(batches, "text"):
            buf, bounds = w.buffer(block.column("text"))
            starts, ends, counts = spans = w.spans(buf, bounds)
            lists = block.column("suffixes")
            some = lists.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.where(some, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            flat = lists.flatten()
            place = flat.field("place").to_numpy().astype(np.int64)
            text = np.repeat(np.arange(len(sizes)), sizes)
            low = (np.cumsum(counts) - counts)[text]
            at, end = low + place, low + counts[text]
            solid, offset = _spaced(buf, starts, ends)
            sides = [_slices(solid, offset[np.maximum(low, at - (window - k))], offset[at]), _slices(solid, offset[at], offset[np.minimum(end, at + window)])]
            struct = pa.StructArray.from_arrays([*(flat.field(c) for c in ("gram", "lead", "place", "first", "last")), *sides], fields=list(SUFFIX))
            suffixes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), struct)
            yield pa.RecordBatch.from_arrays([block.column("_key"), w.only(block.column("text"), some), suffixes, *finished(block, buf, bounds, spans, [None if s else NO_RUNS for s in some])], names=["_key", "text", "suffixes", *names, *extra])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in w.blocks(batches, "text"):
            buf, bounds = w.buffer(block.column("text"))
            runs = []
            for found in block.column("runs").to_pylist():
                mine = np.array([(x["low"], x["high"], x["source_key"]) for x in found], np.int64) if found else NO_RUNS
                runs.append(mine[np.lexsort((mine[:, 2], -mine[:, 1], mine[:, 0]))])
            yield pa.RecordBatch.from_arrays([block.column("_key"), *finished(block, buf, bounds, w.spans(buf, bounds), runs)], names=["_key", *names, *extra])

    retained, shared = _retained(docs, window, k)
    joined = docs.join(retained, "_key", "left").select("_key", "text", "suffixes", *extra)
    texts = saved(joined.mapInArrow(cut, ", ".join(["_key long, text string", f"suffixes {SUFFIX_SQL}", result, *passed])), "texts")
    del joined, retained
    forgotten(shared)
    tidied(docs.sparkSession)
    suffixes = texts.filter("text is not null").select("_key", F.explode("suffixes").alias("s")).select("_key", "s.*")
    order = ["after", "_key", "place"]
    matches = saved(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(window, k), MATCHES), "matches")
    tidied(docs.sparkSession)
    unsettled = matches.filter("words is not null")
    several = unsettled.filter("not lead").select("gram").distinct()
    windows = saved(unsettled.join(several, "gram", "left_semi").mapInArrow(_unsettled(window), "one long, two long, _key long, start int"), "windows")
    tidied(docs.sparkSession)
    least = windows.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("_key", "start")).alias("least")).filter("n > 1").select("one", "two", "least")
    late = windows.join(least, ["one", "two"]).filter((F.col("least._key") != F.col("_key")) | (F.col("least.start") != F.col("start")))
    # written, so that the shuffles of windows are gone before the texts are shuffled once more
    late = saved(late.select("_key", F.col("start").alias("low"), F.col("start").alias("high"), F.col("least._key").alias("source_key")), "late")
    del least
    forgotten(windows)
    tidied(docs.sparkSession)
    runs = matches.filter("high >= low").select("_key", "low", "high", "source_key").unionByName(late)
    runs = runs.groupBy("_key").agg(F.collect_list(F.struct("low", "high", "source_key")).alias("runs"))
    last = texts.filter("text is not null").select("_key", "text", *extra).join(runs, "_key", "left").mapInArrow(end, ", ".join(["_key long", result, *passed]))
    return texts.filter("text is null").select("_key", *names, *extra).unionByName(last)


def _spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins there."""
    sizes = ends - starts + 1
    offset = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(offset[-1], 0x20, np.uint8)
    inside = np.ones(offset[-1], bool)
    inside[offset[1:] - 1] = False
    out[inside] = buf[~w.SPACE[buf]]
    return out, offset


def _slices(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """data[low[i]:high[i]] for each i."""
    row, step = ragged(high - low)
    bounds = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(bounds), pa.py_buffer(data[low[row] + step])])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 10) -> DataFrame:
    """Maximal spans of words that repeat an earlier text, and the digest of what is left.

    Returns one row a text: id_col, n_words, n_removed, spans (word offsets start and end, and first_doc, the key of a
    text that has the first `window` words of the span earlier) and kept_sha256 of the text without them. Of all
    places with the same `window` words the earliest, by id and then position, stays. Null and empty texts have no words
    and no spans; shorter texts stay whole. Rows with null or repeated ids are texts of their own, ordered by id
    (nulls first) and the other columns. Other columns of docs are ignored.
    """
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", SPANS_TYPE)]

    def finish(text: Text) -> tuple:
        return len(text.gone), int(text.gone.sum()), hashlib.sha256(text.without()).hexdigest(), text.spans()

    out = deduplicated(rows, window, k, finish, f"n_words long, n_removed long, kept_sha256 string, spans {SPANS}", fields)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256", "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 10) -> DataFrame:
    """docs with repeated spans cut from text_col; all rows and columns stay. A null text stays null."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(text_col).alias("text"))
    rows = keyed(rows, names[id_col])
    missing = rows.withColumn("null_text", F.col("text").isNull())

    def finish(text: Text) -> tuple:
        return (text.without().decode(),)

    out = deduplicated(missing, window, k, finish, "left_text string", [("left_text", pa.string())])
    text = F.when(~F.col("null_text"), F.col("left_text")).alias(text_col)
    return out.select(*(text if c == text_col else F.col(names[c]).alias(c) for c in docs.columns))

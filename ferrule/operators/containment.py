"""Which of many needles stand in which texts: an index of the needles by their rarest gram.

Comparing every text with every needle is a product of both. Here a needle (a part number, an alias) is looked up by one of its grams
of up to GRAM bytes, the one that the texts hold least often; a needle with a gram that no text holds can't occur, and is left out in
one pass over the needles, before any are shuffled. Texts are read twice: once to count the grams that needles have, once to give a
row for every place of a gram that was chosen. Those rows meet the needles in a join by gram, which Spark can split where a gram is hot, and are compared byte by byte. UTF-8 is self-synchronising,
so bytes that are equal are characters that are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

GRAM = 6
#: Bits of the map of grams that texts are tested against: eight megabytes, whatever the number of needles.
BITS = 26
#: Bytes of text that are looked at at once.
STEP = 2 << 20


def _packed(buf: np.ndarray, size: int) -> np.ndarray:
    """Every gram of `size` bytes as a number, its size in the upper bits."""
    n = len(buf) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(size):
        out = (out << np.uint64(8)) | buf[i : i + len(out)]
    return out | np.uint64(size << 8 * GRAM)


def _place(gram: np.ndarray) -> np.ndarray:
    return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _mapped(grams: Callable[[pa.RecordBatch], Iterator[np.ndarray]]):
    """word, bits: the map's words that a task's grams set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS - 6, np.uint64)
        for batch in batches:
            for gram in grams(batch) if batch.num_rows else ():
                at = np.unique(_place(gram))
                word, first = np.unique(at >> 6, return_index=True)
                if len(word):
                    bits[word] |= np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
        word = np.flatnonzero(bits)
        for i in range(0, len(word), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(word[i : i + 100_000]), pa.array(bits[word[i : i + 100_000]].view(np.int64))], names=["word", "bits"])

    return run


def _bitmap(rows: DataFrame, grams: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> bytes:
    """The map of the rows' grams, of fixed size."""
    words = rows.mapInArrow(_mapped(grams), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    bits = np.zeros(1 << BITS - 6, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.tobytes()


def _set(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    at = _place(gram)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _of_column(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column("gram").to_numpy()


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fill_null("").cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def _grams(needles: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams, their needles and their places in them: of a needle below GRAM bytes it's itself."""
    buf, bounds = _buffer(needles)
    whose = np.repeat(np.arange(len(needles)), np.diff(bounds))
    sizes = np.minimum(np.diff(bounds), GRAM)
    for size in np.unique(sizes).tolist():
        gram = _packed(buf, size)
        of, place = whose[: len(gram)], np.arange(len(gram))
        own = (sizes[of] == size) & (place + size <= bounds[of + 1])
        yield gram[own].astype(np.int64), of[own], (place - bounds[of])[own]


def _of_needles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (gram for gram, _, _ in _grams(batch.column("_needle")))


def _possible(bitmap):
    """The needles of whose grams the map has all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                keep = np.ones(batch.num_rows, bool)
                for gram, of, _ in _grams(batch.column("_needle")):
                    keep[of[~_set(bits, gram)]] = False
                yield batch.filter(pa.array(keep))

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """needle, offset, gram: a row for each gram of a needle."""
    for batch in batches:
        if batch.num_rows:
            needles = batch.column("_needle").cast(pa.binary())
            for gram, of, offset in _grams(needles):
                for i in range(0, len(gram), 20_000):
                    part = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays([needles.take(pa.array(of[part])), pa.array(offset[part].astype(np.int32)), pa.array(gram[part])], names=["needle", "offset", "gram"])


def _hits(buf: np.ndarray, bounds: np.ndarray, bits: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams, their places and their texts, of those that are in the map."""
    for low in range(0, len(buf), STEP):
        for size in sizes:
            gram = _packed(buf[low : low + STEP + size - 1], size)
            found = np.flatnonzero(_set(bits, gram))
            place = found + low
            of = np.searchsorted(bounds, place, "right") - 1
            whole = place + size <= bounds[of + 1]
            yield gram[found[whole]].astype(np.int64), place[whole], of[whole]


def _counted(bitmap, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                for gram, _, _ in _hits(*_buffer(batch.column("text")), bits, sizes):
                    grams, n = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    return run


def _found(bitmap, sizes: list[int], longest: int):
    """id, gram, window, at: the bytes around each place of a gram, as many on either side as the longest needle has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, bounds = _buffer(batch.column("text"))
            for gram, place, of in _hits(buf, bounds, bits, sizes):
                for i in range(0, len(gram), 20_000):
                    p, o = place[i : i + 20_000], of[i : i + 20_000]
                    first, last = np.maximum(bounds[o], p - longest), np.minimum(bounds[o + 1], p + longest)
                    offsets = np.concatenate([[0], np.cumsum(last - first)])
                    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], last - first)
                    window = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(p), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[at]))])
                    columns = [batch.column("id").take(pa.array(o)), pa.array(gram[i : i + 20_000]), window.cast(pa.binary()), pa.array(p - first)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "gram", "window", "at"])

    return run


def held(texts: DataFrame, needles: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], text_id: str, text_col: str, needle_id: str, needle_col: str) -> DataFrame:
    """text_id, needle_id of texts that contain the needle as it is, once a pair.

    Null and empty texts and needles have no pair. Equal needles are looked up once; rows with one id count as one. Texts of any length
    are read whole. checkpoint(df) writes the texts' counts, the needles that may occur and their index, so that none is made again.
    """
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    rows = texts.select(F.col(text_id).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    named = needles.select(F.col(needle_id).alias("_needle_id"), F.col(needle_col).cast("string").alias("_needle")).filter("_needle <> ''")
    sizes = sorted(named.agg(F.collect_set(F.least(F.octet_length("_needle"), F.lit(GRAM)))).first()[0])
    bitmap = spark.sparkContext.broadcast(_bitmap(named.select("_needle"), _of_needles))
    counts = checkpoint(rows.select("text").mapInArrow(_counted(bitmap, sizes), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    bitmap = spark.sparkContext.broadcast(_bitmap(counts.select("gram"), _of_column))
    words = checkpoint(named.mapInArrow(_possible(bitmap), named.schema).distinct())
    grams = words.select("_needle").distinct().mapInArrow(_exploded, "needle binary, offset int, gram long")
    rarest = grams.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram")).alias("of"))
    index = checkpoint(rarest.filter("of.n > 0").select(F.col("needle"), "of.offset", "of.gram"))
    bitmap = spark.sparkContext.broadcast(_bitmap(index.select("gram"), _of_column))
    sizes, longest = index.agg(F.collect_set(F.least(F.octet_length("needle"), F.lit(GRAM))), F.max(F.octet_length("needle"))).first()
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("gram", LongType()), StructField("window", BinaryType()), StructField("at", LongType())])
    places = rows.mapInArrow(_found(bitmap, sorted(sizes), longest or 0), schema)
    same = (F.col("at") >= F.col("offset")) & (F.substring("window", (F.col("at") - F.col("offset") + 1).cast("int"), F.octet_length("needle")) == F.col("needle"))
    pairs = places.join(index, "gram").filter(same).select("id", F.col("needle").cast("string").alias("_needle")).distinct()
    return pairs.join(words, "_needle").select(F.col("id").alias(text_id), F.col("_needle_id").alias(needle_id)).distinct()

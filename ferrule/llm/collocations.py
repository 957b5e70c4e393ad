"""Phrase collocations: dictionary codes of frequent words, packed n-gram keys, range partitions, radix sort and run lengths.

1. Blocks of texts are cut into pieces and words; each block keeps its words as numbers into its own list of words.
2. Words found MIN_COUNT times in their language make the dictionary and get dense codes. Blocks look their words up by a join; a word that is
   not in the dictionary breaks the piece, since no phrase that holds it is found often enough.
3. Every run of two coded words is packed into a key of fixed width (twelve bytes: two codes and, for three words, the third). Each task
   sorts and counts its own keys; keys are then dealt out by ranges, sorted by radix, and equal ones counted in runs. A key in
   many tasks may lie in several ranges; the runs at the ends of a range are added up apart.
4. The same for three words, of which only those are packed whose two pairs are both frequent: a bitmap of fixed size over the frequent
   pairs lets through all of these and few others.

Counts are exact: bitmap and dictionary leave out only what can't reach MIN_COUNT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .common import forgotten, light, numbered, saved

MIN_COUNT = 10
#: A phrase goes if this share of its occurrences, in per cent, is inside one longer phrase.
INSIDE = 50
MOST_PHRASES = 2000
SCORE = 1_000_000
#: Keys that a task gathers before it sorts and counts them, and keys of a range.
GATHERED, RANGE = 2_000_000, 2_000_000
#: Bits of the map of frequent pairs: eight megabytes.
BITS = 26
#: Blocks of a Parquet row group: each holds some megabytes.
BLOCKS_AT_ONCE = 4
#: The top phrases of a language are taken in so many shares first.
SHARES = 64
UNKNOWN = "und"

#: What stands between pieces, and between words.
BREAK, GAP, WORD = 0, 1, 2
KIND = np.full(256, WORD, np.uint8)
KIND[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = BREAK
KIND[np.frombuffer(b" \t", np.uint8)] = GAP
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32

BLOCKS = "codes binary, langs array<string>, sizes array<long>, of array<int>, words array<string>, counts array<long>"
KEYS = "pair long, third int, n long"


def cut(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie end to end, and whether a piece begins with the word."""
    kind = KIND[buf]
    word = kind == WORD
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(buf))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    breaks = np.concatenate([np.flatnonzero(kind == BREAK), bounds[:-1]])
    breaks.sort()
    # a break or a text's start at or before the word and after the word before
    before = np.searchsorted(breaks, starts, "right")
    return starts, ends, np.diff(before, prepend=0) > 0


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word in the list of different words, and that list."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[at])))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: a stream of numbers into the block's words (from 1; 0 between pieces), and those words with language and count."""
    for block in w.blocks(batches, "text"):
        buf, bounds = w.buffer(block.column("text"))
        buf = SMALL[buf]
        starts, ends, opens = cut(buf, bounds)
        lang = block.column("lang").dictionary_encode()
        lang_of_text, langs = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary
        of = lang_of_text[np.searchsorted(bounds, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
        number, words = distinct(buf, starts, ends)
        both, code, counts = np.unique(of * max(1, len(words)) + number, return_inverse=True, return_counts=True)
        codes = np.zeros(len(starts) + int(opens.sum()), np.int32)
        codes[np.arange(len(starts)) + np.cumsum(opens)] = code + 1
        of_word, which = np.divmod(both, max(1, len(words)))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        rows = [
            pa.array([codes.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(langs)], pa.int32()), langs.cast(pa.string())), one(np.bincount(of, minlength=len(langs)), pa.int64()),
            one(of_word.astype(np.int32), pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(which)], pa.int32()), words.take(pa.array(which)).cast(pa.string())), one(counts, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(rows, names=["codes", "langs", "sizes", "of", "words", "counts"])


def _looked_up(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """A block's stream in the dictionary's codes: 0 for what isn't in it. A zero follows or leads no other."""
    out = []
    for row in blocks.column("codes"):
        codes = np.frombuffer(row.as_buffer(), np.int32)
        to = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
        to[found.column("at").to_numpy()] = found.column("code").to_numpy()
        stream = to[codes]
        keep = stream > 0
        keep[1:] |= stream[:-1] > 0
        out.append(stream[keep].tobytes())
    return pa.table({"stream": pa.array(out if found.num_rows else [], pa.binary())})


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by keys, the first counting most: least digits of 16 bits first, each by a stable radix sort."""
    order = None
    for key in reversed(keys):
        top = int(key.max(initial=0))
        for shift in range(0, max(1, top.bit_length()), 16):
            digit = ((key >> shift) & 0xFFFF).astype(np.uint16)
            by = np.argsort(digit if order is None else digit[order], kind="stable")
            order = by if order is None else order[by]
    return order


def runs(pair: np.ndarray, third: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of n."""
    if not len(pair):
        return pair, third, n
    order = radix_order(pair, third)
    pair, third, n = pair[order], third[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
    return pair[first], third[first], np.add.reduceat(n, first)


def place(pair: np.ndarray) -> np.ndarray:
    """A pair's place in the map of frequent pairs."""
    return (w.mix(pair.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _keys(three: bool, bitmap=None):
    """Keys of the streams' pairs, or of the triples that have two pairs in the bitmap, counted task by task."""

    def packed(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = (stream[:-1] << 31) | stream[1:]
        good = (stream[:-1] > 0) & (stream[1:] > 0)
        if not three:
            return pair[good], np.zeros(int(good.sum()), np.int32)
        bits = np.frombuffer(bitmap.value, np.uint8)
        at = place(pair)
        good &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        both = good[:-1] & good[1:]
        return pair[:-1][both], stream[2:][both].astype(np.int32)

    def counted(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair, third = (np.concatenate(x) for x in zip(*held, strict=True))
        return runs(pair, third, np.ones(len(pair), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                stream = np.frombuffer(batch.column("stream")[i].as_buffer(), np.int32).astype(np.int64)
                held.append(packed(stream))
                size += len(held[-1][0])
                if size >= GATHERED:
                    yield from _rows(*counted(held))
                    held, size = [], 0
        if size:
            yield from _rows(*counted(held))
        w.released()

    return run


def _rows(*columns: np.ndarray, names: tuple[str, ...] = ("pair", "third", "n")) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))
    for at in range(0, batch.num_rows, 200_000):
        yield batch.slice(at, 200_000)


def _run_lengths(least: int):
    """Run lengths of a range: those of at least `least`, and the first and last of any length, marked as ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(c).to_numpy() for c in ("pair", "third", "n")] for batch in batches if batch.num_rows]
        if held:
            pair, third, n = runs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            end = np.zeros(len(n), bool)
            end[[0, -1]] = True
            keep = end | (n >= least)
            yield from _rows(pair[keep], third[keep], n[keep], end[keep], names=("pair", "third", "n", "end"))
        w.released()

    return run


def frequent(keys: DataFrame, least: int) -> DataFrame:
    """pair, third, n of the keys that come at least so often in a written table of keys."""
    spark = keys.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // RANGE))
    counted = saved(keys.repartitionByRange(parts, "pair", "third", "n").mapInArrow(_run_lengths(least), KEYS + ", end boolean"), "runs")
    ends = counted.filter("end").groupBy("pair", "third").agg(F.sum("n").alias("n"))
    return counted.filter("not end").select("pair", "third", "n").unionByName(ends).filter(F.col("n") >= least)


def _bitmap(pairs: DataFrame) -> bytes:
    """The map of frequent pairs: of fixed size, whatever the number of pairs."""
    bits = np.zeros(1 << BITS - 3, np.uint8)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column("pair").to_numpy()))], names=["at"])

    at = pairs.select("pair").mapInArrow(places, "at long")
    found = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    bits.view("<i8")[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.tobytes()


def score(whole: str, first: str, rest: str) -> Column:
    """floor(SCORE * whole * whole / (first * rest)), in decimals of 38 digits."""
    return F.expr(f"(cast({whole} as decimal(16,0)) * cast({whole} as decimal(15,0)) * {SCORE}) div (cast({first} as decimal(18,0)) * cast({rest} as decimal(18,0)))")


def _first_rows(rows: DataFrame, most: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, most: int = MOST_PHRASES) -> DataFrame:
    """The first `most` phrases of two or three words of every language: lang, rank, phrase, a, l, r, n, score.

    A-Z count as small letters. A text is split at `.,;:!?` and line breaks into pieces, and these at spaces and tabs into words. n is the
    language's number of words, a how often the phrase comes, l and r its parts at the cut with the lowest score. Phrases
    that come less than min_count times, or of whose occurrences half or more lie in one longer phrase, are left out. Order: score and a
    descending, phrase by its bytes. Null and empty texts have no words; a null language is `und`. Repeated rows count each.
    A text of any length is read whole, by itself in a block if it is long. Other columns are ignored. A table without phrases gives no rows.
    """
    spark = docs.sparkSession
    rows = light(docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang")))
    blocks = saved(rows.mapInArrow(_cut, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks", BLOCKS_AT_ONCE)
    totals = saved(blocks.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n")), "totals")
    words = blocks.select("block", "langs", F.posexplode(F.arrays_zip("of", "words", "counts")).alias("at", "x"))
    words = words.select("block", F.expr("at + 1").alias("at"), F.expr("langs[x.of]").alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    known = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    coded = numbered(known.withColumn("all", F.lit("")), "all", ["lang", "word"], "dictionary")
    known = saved(coded.select("lang", "word", "f", F.expr("cast(pos + 1 as int)").alias("code")), "coded")

    # one block at a time in Python: lists of a block's words would lie in the JVM's heap, for many blocks at once and unseen by Spark
    found = words.join(known, ["lang", "word"]).select(F.col("block").alias("of_block"), "at", "code")
    streams = blocks.select("block", "codes").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_looked_up, "stream binary")
    streams = saved(streams, "streams", BLOCKS_AT_ONCE)
    forgotten(blocks)
    pairs = saved(streams.mapInArrow(_keys(False), KEYS), "pairs")
    two = saved(frequent(pairs, min_count).select("pair", F.col("n").alias("a")), "frequent-pairs")
    forgotten(pairs)
    triples = saved(streams.mapInArrow(_keys(True, spark.sparkContext.broadcast(_bitmap(two))), KEYS), "triples")
    three = saved(frequent(triples, min_count).select("pair", "third", F.col("n").alias("a")), "frequent-triples")
    forgotten(triples, streams)

    code = lambda n, *more: known.select(F.col("code").alias(f"c{n}"), F.col("word").alias(f"w{n}"), F.col("f").alias(f"f{n}"), *more)
    of_pair = lambda name, f: two.select(F.col("pair").alias(name), F.col("a").alias(f))
    split = [F.expr("cast(shiftright(pair, 31) as int)").alias("c1"), F.expr("cast(pair & 2147483647 as int)").alias("c2")]
    three = three.select("pair", "third", "a", *split).withColumn("last", F.expr("shiftleft(cast(c2 as bigint), 31) + third"))
    inside = three.select("pair", "a").unionByName(three.select(F.col("last").alias("pair"), "a")).groupBy("pair").agg(F.max("a").alias("longer"))
    left = two.select("pair", "a", *split).join(inside, "pair", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a")))
    left = left.join(code(1, "lang"), "c1").join(code(2), "c2")
    left = left.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))
    three = three.join(of_pair("pair", "f12"), "pair").join(of_pair("last", "f23"), "last").join(code(1, "lang"), "c1").join(code(2), "c2").join(code(3), F.col("third") == F.col("c3"))
    three = three.withColumn("early", score("a", "f1", "f23")).withColumn("late", score("a", "f12", "f3")).withColumn("first", F.col("early") <= F.col("late"))
    of = lambda early, late: F.when(F.col("first"), F.col(early)).otherwise(F.col(late))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", of("f1", "f12").alias("l"), of("f23", "f3").alias("r"), of("early", "late").alias("score"))

    # the first of each share, then the first of all: a language of any size is dealt out
    shared = left.unionByName(three).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    top = _first_rows(_first_rows(shared, most, "lang", "share"), most, "lang")
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases_sql(min_count: int = MIN_COUNT, most: int = MOST_PHRASES) -> str:
    """The same in DuckDB's SQL."""
    grams = lambda n: f"select lang, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])) as g from pieces"
    value = lambda a, b, c: f"({SCORE}::hugeint * {a} * {a}) // ({b}::hugeint * {c})"
    return rf"""
with lines as (
  select coalesce(lang, '{UNKNOWN}') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece
  from documents),
pieces as (select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') as w from lines),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
one as (select lang, g, count(*) as f from ({grams(1)}) group by all),
two as (select lang, g, count(*) as f from ({grams(2)}) group by all having count(*) >= {min_count}),
three as (select lang, g, count(*) as f from ({grams(3)}) group by all having count(*) >= {min_count}),
inside as (
  select lang, g, max(f) as f from (select lang, g[1:2] as g, f from three union all select lang, g[2:3], f from three) group by lang, g),
cuts as (
  select t.lang, t.g, t.f as a, 1 as k, x.f as l, y.f as r from two t join one x on x.lang = t.lang and x.g = t.g[1:1] join one y on y.lang = t.lang and y.g = t.g[2:2]
  left join inside i on i.lang = t.lang and i.g = t.g where i.f is null or 100 * i.f < {INSIDE} * t.f
  union all
  select t.lang, t.g, t.f, 1, x.f, y.f from three t join one x on x.lang = t.lang and x.g = t.g[1:1] join two y on y.lang = t.lang and y.g = t.g[2:3]
  union all
  select t.lang, t.g, t.f, 2, x.f, y.f from three t join two x on x.lang = t.lang and x.g = t.g[1:2] join one y on y.lang = t.lang and y.g = t.g[3:3]),
scored as (select *, array_to_string(g, ' ') as phrase, ({value('a', 'l', 'r')})::bigint as score from cuts),
lowest as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from lowest)
select t.lang, rank, phrase, a, l, r, n, score from ranked join totals t on t.lang = ranked.lang where rank <= {most}
"""

"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds every id's lowest chunk; a bitmap says which ids go on, and level
1 holds the next chunk of those, and so forth. The number of bits set before a position, from a directory with a count
every 512 bits, is that id's place in the next level: any token is read without decoding those before it.

A file set is a table in the shared folder: a row is a segment of whole documents in ascending id order, with its
levels, bitmaps and rank directories. Spark's writer commits it, so a lost executor's part is written again.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .common import keyed, plain_ids, saved
from .vocabularies import Ragged, Remembered, alike, path, strings

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Tokens after which a segment ends with its document.
SEGMENT = 1 << 19
DIRECTORY = 512
#: Positions looked up in one go.
AT_ONCE = 1 << 16
#: Parts are as many as tasks write; up to so many rows of 16 bytes are broadcast, more are joined by a shuffle.
BROADCAST_PARTS = 1 << 20
LEVEL = pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())])
SCHEMA = "part int, seq int, inside long, n_tokens long, n_docs int, doc_ids binary, doc_bounds binary, levels array<struct<chunks: binary, bitmap: binary, ranks: binary>>"


def coded(ids: np.ndarray) -> list[dict]:
    """The levels of an array of non-negative ids."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // DIRECTORY) * DIRECTORY, bool)
        padded[: len(more)] = more
        counts = padded.reshape(-1, DIRECTORY).sum(1)
        ranks = (np.cumsum(counts) - counts).astype("<u4")
        out.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "bitmap": bits.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more] >> 8
        if not len(rest):
            return out


class Codes:
    """Reads ids out of their levels."""

    def __init__(self, levels: list[dict]):
        self.levels = []
        for x in levels:
            bitmap = np.frombuffer(x["bitmap"], np.uint8)
            lanes = np.concatenate([bitmap, np.zeros(-len(bitmap) % (DIRECTORY // 8), np.uint8)]).view("<u8")
            inside = np.bitwise_count(lanes).reshape(-1, DIRECTORY // 64).astype(np.uint32)
            inside = (np.cumsum(inside, 1) - inside).astype(np.uint16).reshape(-1)
            self.levels.append((np.frombuffer(x["chunks"], np.uint8), lanes, np.frombuffer(x["ranks"], "<u4"), inside))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Bits set before each position: the directory's count, that of whole lanes of 64 bits after it, and part of one lane."""
        _, lanes, ranks, inside = self.levels[level]
        lane = at >> 6
        below = lanes[lane] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return ranks[at // DIRECTORY].astype(np.int64) + inside[lane] + np.bitwise_count(below)

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions, without decoding any others."""
        at, out, open_ = np.asarray(positions, np.int64), None, None
        for level, (chunks, lanes, _, _) in enumerate(self.levels):
            value = chunks[at].astype(np.uint32) << np.uint32(8 * level)
            if out is None:
                out, open_ = value, np.arange(len(at))
            else:
                out[open_] |= value
            more = (lanes[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            if not more.any():
                break
            at, open_ = self.rank(level, at[more]), open_[more]
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, open_ = self.levels[0][0].astype(np.uint32), np.arange(len(self))
        for level in range(1, len(self.levels)):
            more = np.unpackbits(self.levels[level - 1][1].view(np.uint8), count=len(open_), bitorder="little").astype(bool)
            open_ = open_[more]
            out[open_] |= self.levels[level][0].astype(np.uint32) << np.uint32(8 * level)
        return out


#: The rules of the vocabulary file that the cutting of words below follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Letters beyond ASCII whose normal form, lower case and bytes need no table: Latin-1 and Latin Extended-A, but for I with a dot.
LATIN = "\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u017f"


#: Bytes that a word which is cut into pieces doesn't have: white space, controls, the apostrophe, and leads of characters beyond LATIN's blocks.
OTHER = np.ones(256, bool)
OTHER[0x21:0x7F] = OTHER[0x80:0xC0] = OTHER[0xC3:0xC6] = False
OTHER[ord("'")] = True
#: Kinds of bytes: letters (those of LATIN too), digits, symbols.
KIND = np.full(256, 2, np.uint8)
KIND[0x80:] = KIND[0x41:0x5B] = KIND[0x61:0x7B] = 0
KIND[0x30:0x3A] = 1
CAPITAL = np.zeros(256, bool)
CAPITAL[0x41:0x5B] = True
#: Longer pieces are not remembered.
BRIEF = 64


def pieces(data: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, which are data[solid[i]:solid[i + 1]], cut where the file's rules cut them: the data with A-Z in lower case there, the
    pieces' bounds, and how many pieces lie before each word and in all.

    Only words of ASCII and Latin letters, digits and symbols without an apostrophe or "<|" are cut up; others stay whole.
    No piece of the former has the bytes of one of the latter, so bytes alone tell what a piece's ids are.
    """
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(1, np.int64)
    other = OTHER[data]
    this, then = data[:-1], data[1:]
    other[:-1] |= ((this == 0xC3) & ((then == 0x97) | (then == 0xB7))) | ((this == 0xC4) & (then == 0xB0)) | ((this == ord("<")) & (then == ord("|")))
    plain = np.repeat(~np.logical_or.reduceat(other, solid[:-1]), np.diff(solid))
    kind = KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 1))
    edge[solid[:-1]] = True
    starts = np.flatnonzero(edge)
    return data + (0x20 * (CAPITAL[data] & plain)).astype(np.uint8), np.append(starts, len(data)), np.searchsorted(starts, solid)


class Encoder:
    """Ids of pieces; the library's model encodes those that were not met before."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        self.encode, self.known = encode, Remembered()

    def __call__(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data[cuts[i]:cuts[i + 1]] end to end, and how many each has."""
        if len(cuts) < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        first, one, two, at = alike(data, cuts)
        row = self.known.find(one, two)
        new = np.flatnonzero(row < 0)
        starts, ends = cuts[:-1][first[new]], cuts[1:][first[new]]
        fresh = Ragged([self.encode(p) for p in strings(data, starts, ends)])
        known = self.known.ids
        row[new] = len(known.sizes) + np.arange(len(new))
        both = Ragged.of(np.append(known.values, fresh.values), np.append(known.bounds, known.bounds[-1] + fresh.bounds[1:]))
        out = both.take(row[at])
        brief = np.flatnonzero(ends - starts <= BRIEF)
        kept, each = fresh.take(brief)
        self.known.add(one[new[brief]], two[new[brief]], Ragged.of(kept, np.concatenate([[0], np.cumsum(each)])))
        return out


@lru_cache(2)
def _encoder(file: str) -> Encoder:
    """Ids of pieces() of words without ASCII white space. In this vocabulary nothing crosses white space.

    Words of ASCII and Latin letters are cut up here as the file's own rules say, and the library's model encodes the
    pieces; other words go to the library whole. A file with other rules is refused.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(file)
    with open(file, "rb") as f:
        rules = json.load(f)
    if rules["normalizer"] != NORMALIZER or rules["pre_tokenizer"] != PRE_TOKENIZER:
        raise ValueError(f"{file} has other rules than {VOCABULARY}: words can't be encoded one by one")
    model = whole.model
    split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+")
    plain = regex.compile(rf"[!-~{LATIN}]+")
    # how the model spells the bytes of UTF-8
    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    wide = {chr(i): as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x180)}
    table = str.maketrans(wide)

    def piece(text: str) -> list[int]:
        return [t.id for t in model.tokenize(text if text.isascii() else text.translate(table))]

    def word(data: bytes) -> bytes:
        text = data.decode()
        if data.isalpha():
            ids = piece(text.lower())
        elif plain.fullmatch(text) and "<|" not in text:
            ids = [i for p in split.findall(text.lower()) for i in piece(p)]
        else:
            ids = whole.encode(text, add_special_tokens=False).ids
        return array("i", ids).tobytes()

    return Encoder(word)


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None, end: int = END) -> DataFrame:
    """Rows of the file format: texts encoded by the tokenizers library, `end` after each, in ascending id order."""
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return _segments(rows, file or path(VOCABULARY), end)


def _segments(rows: DataFrame, file: str, end: int) -> DataFrame:
    rows = rows.select("_key", "text").repartitionByRange("_key").sortWithinPartitions("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq, written, held = _encoder(file), TaskContext.get().partitionId(), 0, 0, []

        def segment() -> pa.RecordBatch:
            ids, sizes = np.concatenate([x for x, _, _ in held]), np.concatenate([x for _, x, _ in held])
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
            keys = np.concatenate([x for _, _, x in held]).astype("<i8")
            row = {"part": [part], "seq": [seq], "inside": [written], "n_tokens": [len(ids)], "n_docs": [len(keys)], "doc_ids": [keys.tobytes()], "doc_bounds": [bounds.tobytes()], "levels": [coded(ids)]}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(LEVEL)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for block in w.blocks(batches, "text"):
            buf, bounds = w.buffer(block.column("text"))
            starts, ends, counts = w.spans(buf, bounds)
            solid = np.concatenate([[0], np.cumsum(ends - starts)])
            data, cuts, before = pieces(buf[~w.SPACE[buf]], solid)
            values, sizes = code(data, cuts)
            total = np.concatenate([[0], np.cumsum(sizes)])[before[np.cumsum(counts)]]
            ids = np.insert(values, total, end)
            held.append((ids, np.diff(np.concatenate([[0], total])) + 1, block.column("_key").to_numpy()))
            if sum(len(x) for x, _, _ in held) >= SEGMENT:
                yield segment()
                seq, written, held = seq + 1, written + sum(len(x) for x, _, _ in held), []
        if held:
            yield segment()

    return rows.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, target: str, **options) -> None:
    """Write the file set to `target`, a folder that all executors share."""
    segments(docs, **options).write.parquet(target)


def placed(files: DataFrame) -> DataFrame:
    """The segments with `first`, the number of tokens before each. Each segment knows those before it in its part, so only a
    row a part, which is a task that wrote, has to be summed up and joined; the codes stay where they are."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = saved(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "parts")
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    return files.join(parts, "part").withColumn("first", F.col("before") + F.col("inside")).drop("before")


def read(files: DataFrame) -> DataFrame:
    """Per document of a file set: doc_key, start (tokens before it), ids (with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, starts, bounds, ids in _decoded(batches):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(starts), lists], names=["doc_key", "start", "ids"])

    return placed(files).mapInArrow(run, "doc_key long, start long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per segment: keys, first token and bounds of its documents, and their ids, looked up at their positions."""
    for batch in batches:
        for row in _segment_rows(batch):
            bounds, codes = np.frombuffer(row["doc_bounds"], "<i8"), Codes(row["levels"])
            ids = np.concatenate([np.zeros(0, np.uint32), *(codes.at(np.arange(i, min(i + AT_ONCE, len(codes)))) for i in range(0, len(codes), AT_ONCE))])
            yield np.frombuffer(row["doc_ids"], "<i8"), row["first"] + bounds[:-1], bounds, ids


def _segment_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A segment at a time: it is some megabytes in a few values."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def tokens_at(files: DataFrame, positions: list[int]) -> DataFrame:
    """(position, id) of some positions, read directly in their segments; the positions are few, named by the caller."""
    wanted = np.unique(np.array(positions, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _segment_rows(batch):
                mine = wanted[np.searchsorted(wanted, row["first"]) : np.searchsorted(wanted, row["first"] + row["n_tokens"])]
                if len(mine):
                    ids = Codes(row["levels"]).at(mine - row["first"]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(ids)], names=["position", "id"])

    return placed(files).mapInArrow(run, "position long, id long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the file set of docs to the shared folder, reads it back, and returns per document id_col, start, n_tokens
    (with the end id) and ids_crc32 of its ids as little-endian unsigned 32-bit integers.

    A null text counts as empty: one token, the end id. With null or repeated ids every row is a document of its own,
    numbered in order of id (nulls first) and text; id_col then holds the ids again. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    plain = plain_ids(rows)
    own = keyed(rows, plain=plain)
    files = saved(_segments(own, path(VOCABULARY), END), "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, starts, bounds, ids in _decoded(batches):
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(starts), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["_key", "start", "n_tokens", "ids_crc32"])

    out = placed(files).mapInArrow(run, "_key long, start long, n_tokens long, ids_crc32 long")
    if plain:
        return out.withColumnRenamed("_key", id_col)
    return out.join(own.select("_key", F.col("doc_id").alias(id_col)), "_key").select(id_col, "start", "n_tokens", "ids_crc32")

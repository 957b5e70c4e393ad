"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are the encoding of their own
bytes. So each byte prefix of a piece has one valid last token, found from those of shorter prefixes; the encoding is
read off backwards. Appends go on from the stored tokens, and after an edit only the tokens near it change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from . import words as w
from .common import light, with_column
from .vocabularies import Ragged, Remembered, alike, path, ranks, strings
from .words import mix

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pairs whose validity is remembered at once.
PAIRS = 50_000
#: The same, as arrays (9 bytes a pair).
MANY_PAIRS = 3_000_000
#: Bytes of the pieces that are encoded many at once.
LONGEST = 16
#: Bytes of the chunks whose ids are remembered from block to block.
BRIEF = 64


class Vocabulary:
    """Tokens of a byte-level BPE vocabulary by rank."""

    def __init__(self, tokens: dict[bytes, int]):
        self.ranks, self.bytes = tokens, {i: t for t, i in tokens.items()}
        self.longest = max(map(len, tokens))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reached: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The BPE encoding of a short string by merging the lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in found if r is not None), default=None)
            if best is None:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether [a, b] is the encoding of its bytes."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.bytes[a], self.bytes[b]
            ok = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return ok

    def alone(self, a: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        ok = self.reached.get(a)
        if ok is None:
            ok = self.reached[a] = len(self.merged(self.bytes[a])) == 1
        return ok


class Prefixes:
    """The last token of every prefix of `data`, kept up to date under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token(self, end: int) -> int:
        ranks_, last, data, v = self.vocabulary.ranks, self.last, self.data, self.vocabulary
        for start in range(max(0, end - v.longest), end):
            t = ranks_.get(data[start:end])
            if t is not None and (v.follows(last[start - 1], t) if start else v.alone(t)):
                return t
        raise ValueError(f"no token for byte {data[end - 1]}")

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        for end in range(at + 1, len(self.data) + 1):
            self.last.append(self._token(end))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` in place of data[start:end]; returns how many prefixes had to be looked at again.

        Once as many tokens in a row as the longest has bytes are those of before, all later ones are.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same = old[:start], 0
        for at in range(start + 1, len(self.data) + 1):
            token = self._token(at)
            self.last.append(token)
            before = at - shift
            same = same + 1 if before > end and old[before - 1] == token else 0
            if same >= self.vocabulary.longest:
                self.last += old[before:]
                return at - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, at, size = [], len(self.data), self.vocabulary.bytes
        while at:
            out.append(self.last[at - 1])
            at -= len(size[out[-1]])
        return out[::-1]


class Tables:
    """The tokens as sorted arrays by length, for many pieces at once.

    The last 8 and the up to 8 bytes before them are held as numbers, so equality is exact; longer tokens are left to
    Prefixes, as are pieces in which they could occur.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.by_length = v, {}
        for k in range(1, LONGEST + 1):
            own = [(int.from_bytes(t[-8:], "big"), int.from_bytes(t[:-8], "big"), i) for t, i in v.ranks.items() if len(t) == k and v.alone(i)]
            own.sort()
            if own:
                low, high, ids = (np.array(x, np.uint64) for x in zip(*own, strict=True))
                key = low if k <= 8 else mix(low ^ mix(high))
                order = np.argsort(key, kind="stable")
                self.by_length[k] = key[order], low[order], high[order], ids[order].astype(np.int64)
        self.pairs, self.valid = np.zeros(0, np.int64), np.zeros(0, bool)
        self.lengths = np.array([len(v.bytes.get(i, b"")) for i in range(max(v.bytes) + 1)])

    def follow(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (a << 20 | b) of tokens is the encoding of its bytes."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == pairs if len(self.pairs) else np.zeros(len(pairs), bool)
        ok = np.zeros(len(pairs), bool)
        ok[known] = self.valid[at[known]]
        if not known.all():
            new, back = np.unique(pairs[~known], return_inverse=True)
            found = np.array([self.v.follows(int(p) >> 20, int(p) & 0xFFFFF) for p in new])
            ok[~known] = found[back]
            if len(self.pairs) > MANY_PAIRS:
                self.pairs, self.valid = self.pairs[:0], self.valid[:0]
            every = np.concatenate([self.pairs, new])
            order = np.argsort(every, kind="stable")
            self.pairs, self.valid = every[order], np.concatenate([self.valid, found])[order]
        return ok

    def last_tokens(self, data: np.ndarray) -> np.ndarray:
        """n x width array of the last token of every prefix, for n pieces padded to a width of LONGEST at most.

        What comes after a piece's end doesn't matter to its own prefixes.
        """
        n, width = data.shape
        low = np.zeros((width + 1, n), np.uint64)
        for i in range(width):
            low[i + 1] = (low[i] << np.uint64(8)) | data[:, i]
        last = np.full((width + 1, n), -1, np.int64)
        for end in range(1, width + 1):
            open_ = np.arange(n)
            for k in range(end, 0, -1):
                if k not in self.by_length or not len(open_):
                    continue
                keys, lows, highs, ids = self.by_length[k]
                a = low[end][open_] & np.uint64((1 << 8 * min(k, 8)) - 1)
                b = low[end - 8][open_] & np.uint64((1 << 8 * (k - 8)) - 1) if k > 8 else np.zeros(len(open_), np.uint64)
                key = a if k <= 8 else mix(a ^ mix(b))
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero((lows[at] == a) & (highs[at] == b))
                if not len(hit):
                    continue
                token, rows = ids[at[hit]], open_[hit]
                if end > k:
                    before = last[end - k][rows]
                    ok = before >= 0
                    ok[ok] = self.follow(before[ok] << 20 | token[ok])
                    token, rows, hit = token[ok], rows[ok], hit[ok]
                last[end][rows] = token
                open_ = np.delete(open_, hit)
        return last[1:].T

    def encode(self, pieces: list[bytes]) -> Ragged:
        """Ids of each piece; one that is a token gets that."""
        out: list[bytes] = [b""] * len(pieces)
        v, sizes = self.v, np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((v.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        short = np.flatnonzero((whole < 0) & (sizes <= LONGEST))
        for i in np.flatnonzero(whole >= 0):
            out[i] = int(whole[i]).to_bytes(4, "little")
        for i in np.flatnonzero((whole < 0) & (sizes > LONGEST)):
            out[i] = np.array(Prefixes(v, pieces[i]).ids(), np.int32).tobytes()
        short = short[np.argsort(sizes[short], kind="stable")]
        for part in np.array_split(short, max(1, len(short) // 20_000)) if len(short) else []:
            width = int(sizes[part[-1]])
            data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
            last = self.last_tokens(data)
            # backwards from each piece's end
            at, rows, steps = sizes[part].copy(), np.arange(len(part)), []
            while len(rows):
                token = last[rows, at[rows] - 1]
                steps.append((rows, token))
                at[rows] -= self.lengths[token]
                rows = rows[at[rows] > 0]
            row, token = np.concatenate([r for r, _ in steps]), np.concatenate([t for _, t in steps])
            step = np.concatenate([np.full(len(r), i) for i, (r, _) in enumerate(steps)])
            order = np.lexsort((-step, row))
            ids, edge = token[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))])
            for j, i in enumerate(part):
                out[i] = ids[edge[j] : edge[j + 1]].tobytes()
        return Ragged(out)


@lru_cache(4)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(ranks(file))


@lru_cache(4)
def _tables(file: str) -> Tables:
    return Tables(vocabulary(file))


@lru_cache(4)
def _remembered(file: str, pattern: str) -> Remembered:
    return Remembered()


def encoded(buf: np.ndarray, bounds: np.ndarray, file: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and their bounds: distinct chunks that were not met before are split, their distinct pieces encoded once."""
    cuts, counts = chunk_bounds(buf, bounds)
    if len(cuts) < 2:
        return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    first, one, two, at = alike(buf, cuts)
    known = _remembered(file, pattern)
    row = known.find(one, two)
    new = np.flatnonzero(row < 0)
    starts, ends = cuts[:-1][first[new]], cuts[1:][first[new]]
    split, number, places, sizes = regex.compile(pattern), {}, [], []
    for c in strings(buf, starts, ends):
        found = split.findall(c.decode())
        sizes.append(len(found))
        places += [number.setdefault(p, len(number)) for p in found]
    ids = _tables(file).encode([p.encode() for p in number])
    values, each = ids.take(np.array(places, np.int64))
    fresh = Ragged.of(values, np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])])
    row[new] = len(known.met) + np.arange(len(new))
    both = Ragged.of(np.append(known.ids.values, fresh.values), np.append(known.ids.bounds, known.ids.bounds[-1] + fresh.bounds[1:]))
    out, sizes_ = both.take(row[at])
    brief = np.flatnonzero(ends - starts <= BRIEF)
    kept, each = fresh.take(brief)
    known.add(one[new[brief]], two[new[brief]], Ragged.of(kept, np.concatenate([[0], np.cumsum(each)])))
    return out, np.concatenate([[0], np.cumsum(sizes_)])[np.concatenate([[0], np.cumsum(counts)])]


def byte_table(file: str) -> pa.LargeBinaryArray:
    """The bytes of every id; null where there is none."""
    known = vocabulary(file).bytes
    return pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary())


def decoded(ids: pa.Array, table: pa.LargeBinaryArray) -> tuple[pa.Buffer, np.ndarray]:
    """Bytes of the ids end to end, and the bounds of each id's."""
    data = table.take(ids)
    if data.null_count:
        raise ValueError("ids outside the vocabulary")
    if not len(ids):
        return pa.py_buffer(b""), np.zeros(1, np.int64)
    return data.buffers()[2], np.frombuffer(data.buffers()[1], np.int64)[: len(ids) + 1]


def chunk_bounds(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts every text before white space that follows a byte which is surely none: there a match of the pattern ends.

    Returns the chunks' bounds and how many each text has (an empty text: none).
    """
    if not len(buf):
        return np.zeros(1, np.int64), np.zeros(len(bounds) - 1, np.int64)
    solid = (buf > 0x20) & (buf < 0x7F)
    solid[1:] |= (buf[1:] >= 0x80) & (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xDF)
    cut = np.zeros(len(buf), bool)
    cut[1:] = w.SPACE[buf[1:]] & solid[:-1]
    cut[bounds[:-1][bounds[:-1] < len(buf)]] = True
    starts = np.flatnonzero(cut)
    return np.append(starts, len(buf)), np.diff(np.searchsorted(starts, bounds))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", file: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with the token ids of text_col as ids_col (array<int>). Null and empty texts have no tokens.

    Each match of `pattern` is encoded separately; a match that is itself a token gets that. All rows and columns
    of docs stay (one named as ids_col is replaced), texts of any length are taken whole.
    """
    import public_tokenizers

    file, pattern = file or path(VOCABULARY), pattern or public_tokenizers.PATTERN
    kept = light(docs).drop(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in w.blocks(batches, text_col):
            values, edge = encoded(*w.buffer(block.column(text_col)), file, pattern)
            ids = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([*block.columns, ids], names=[*block.schema.names, ids_col])

    return kept.mapInArrow(run, with_column(kept, ids_col, ArrayType(IntegerType())))


def decode(encoded: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", file: str | None = None) -> DataFrame:
    """encoded with the bytes of its ids as bytes_col (binary). Null ids give no bytes; an unknown id fails."""
    file, kept = file or path(VOCABULARY), encoded.drop(bytes_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(file)
        for batch in batches:
            lists = batch.column(ids_col)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            data, edge = decoded(lists.flatten(), table)
            own = edge[np.concatenate([[0], np.cumsum(sizes)])]
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(own.astype(np.int64)), data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, bytes_col])

    return kept.mapInArrow(run, with_column(kept, bytes_col, BinaryType()))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256 of the decimal ids joined by a space, decoded_sha256 of the decoded bytes.

    What encode() and decode() do with a block, without carrying the ids to Spark and back in between. Null and empty
    texts have no tokens; ids of rows stay as they are, null or repeated; other columns of docs are ignored.
    """
    import public_tokenizers

    file, pattern = path(VOCABULARY), public_tokenizers.PATTERN
    rows = light(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(file)
        decimal = pa.array([f"{i} ".encode() for i in range(len(table))], pa.large_binary())
        for block in w.blocks(batches, "text"):
            values, edge = encoded(*w.buffer(block.column("text")), file, pattern)
            ids, digests = pa.array(values), []
            for data, at in (decoded(ids, decimal), decoded(ids, table)):
                view, own = memoryview(data), at[edge]
                last = int(data is not None and not digests)  # of the decimals, the space behind the last
                digests.append([hashlib.sha256(view[a : max(a, b - last)]).hexdigest() for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(edge)), *(pa.array(d, pa.string()) for d in digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)

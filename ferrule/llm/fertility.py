"""Quality rules: tokeniser fertility.

Two public vocabularies encode every word of a text. Characters per token, the share of byte-fallback tokens and the
entropy of the tokens must lie in bands that depend on the text's language, or on its script where the language has
no band. The bands are fixed: a text's verdict depends on its own text, language and script alone, whatever table it stands
in. Simple counts (words, symbols, repeated lines and words) reject texts before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words as w
from .common import light, with_column
from .vocabularies import Ragged, distinct, path, ranks

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.tiktoken"
MIN_WORDS = 50
MAX_REPEATED = 50
ENOUGH = 1024


class Band(NamedTuple):
    """Accepted values. Entropy is in bits, relative to the most that as many tokens could have, or ENOUGH if they are
    more. Prose of fewer tokens repeats fewer of them, so its least entropy rises by `rise` for every halving below ENOUGH."""

    low_chars: float
    high_chars: float
    max_fallback: float
    low_entropy: float
    rise: float = 0.0


#: Rejection bands by language, then by script, wide enough for prose of real and invented words. The curve of the least
#: entropy lies 0.01 to 0.04 below what any prose without symbols reached in 10,000 documents of the four languages; texts laden
#: with a few symbols, which come again and again, lie around it.
BANDS = {
    "en": Band(1.35, 7.0, 0.05, 0.595, 0.055),
    "fr": Band(1.25, 7.0, 0.05, 0.595, 0.055),
    "de": Band(1.25, 7.0, 0.05, 0.595, 0.055),
    "es": Band(1.25, 7.0, 0.05, 0.595, 0.055),
    "latin": Band(1.2, 7.5, 0.1, 0.4),
    "greek": Band(0.5, 5.0, 0.3, 0.35),
    "cyrillic": Band(0.5, 6.0, 0.3, 0.35),
    "arabic": Band(0.4, 5.0, 0.5, 0.35),
    "indic": Band(0.3, 4.0, 0.8, 0.3),
    "han": Band(0.25, 3.0, 0.9, 0.3),
    "hangul": Band(0.25, 3.0, 0.9, 0.3),
    "other": Band(0.2, 8.0, 1.0, 0.25),
}
SCRIPTS = ("latin", "greek", "cyrillic", "arabic", "indic", "han", "hangul", "other")
#: Script of a letter by the first byte of its UTF-8 form; -1: no letter, or not the first byte.
LEAD = np.full(256, -1, np.int8)
for _first, _last, _script in ((0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xC3, 0xCC, 0), (0xCD, 0xCF, 1), (0xD0, 0xD4, 2), (0xD5, 0xD7, 7), (0xD8, 0xDD, 3), (0xE0, 0xE0, 4), (0xE3, 0xE9, 5), (0xEA, 0xED, 6), (0xF0, 0xF4, 7)):
    LEAD[_first : _last + 1] = _script
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_byte_token double, fallback_share double, token_entropy double, band string"


class _Encoders:
    """Pieces of words and their number under both vocabularies."""

    def __init__(self):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path(PIECES))
        self.bytes = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path(BYTES)), special_tokens={})
        self.line = self.bytes.encode_single_token("\n")
        self.fallback = np.array([self.pieces.IsByte(i) for i in range(self.pieces.GetPieceSize())])

    def __call__(self, words: list[bytes]) -> tuple[Ragged, np.ndarray, np.ndarray]:
        """Of each word: piece ids, how many of them are bytes, and how many byte-level tokens it has behind a space."""
        texts = [x.decode() for x in words]
        ids = Ragged([np.array(x, np.int32).tobytes() for x in self.pieces.encode(texts, num_threads=1)]) if texts else Ragged([])
        fallback = np.diff(np.concatenate([[0], np.cumsum(self.fallback[ids.values])])[ids.bounds])
        # words hold no line ends, and a line end before a space is a token of its own
        every = np.array(self.bytes.encode_ordinary("".join(f" {x}\n" for x in texts)), np.int64)
        ends = np.flatnonzero(every == self.line)
        return ids, fallback, np.diff(np.concatenate([[-1], ends])) - 1


@lru_cache(1)
def _encoders() -> _Encoders:
    return _Encoders()


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def _copies(text: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether the same item comes earlier in the same text, for rows in order."""
    order = np.lexsort((np.arange(len(item)), item, text))
    out = np.zeros(len(item), bool)
    out[order[1:]] = (item[order[1:]] == item[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    return out


def _dup_lines(buf: np.ndarray, bounds: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    if not len(buf):
        return np.zeros(n, np.int64)
    # a line ends at \n or at its text's end; its bytes are compared with the \n left out
    ends = np.unique(np.concatenate([np.flatnonzero(buf == 10), bounds[1:]]))
    starts = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, bounds[:-1]]))
    # the end of the text before stands where a line starts; empty lines have no word
    starts = starts[starts < len(buf)]
    starts = starts[buf[starts] != 10]
    stop = ends[np.searchsorted(ends, starts, "right")]
    some = np.searchsorted(word_starts, stop) > np.searchsorted(word_starts, starts)
    starts, stop = starts[some], stop[some]
    if not len(starts):
        return np.zeros(n, np.int64)
    # lines end to end without what lies between them
    edge = np.zeros(len(buf) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stop, -1)
    data = buf[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    _, line = distinct(data, np.concatenate([[0], np.cumsum(stop - starts)]))
    text = np.searchsorted(bounds, starts, "right") - 1
    return np.bincount(text[_copies(text, line)], minlength=n)


def _repeated_words(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words inside a window of three that the text has twice or more."""
    n = len(counts)
    if len(word) < 3:
        return np.zeros(n, np.int64)
    text = np.repeat(np.arange(n), counts)
    fits = np.flatnonzero(text[:-2] == text[2:])
    if not len(fits):
        return np.zeros(n, np.int64)
    pair = np.unique(word[:-1].astype(np.int64) * (int(word.max()) + 1) + word[1:], return_inverse=True)[1]
    window = pair[fits].astype(np.int64) * (int(word.max()) + 1) + word[fits + 2]
    t = text[fits]
    order = np.lexsort((window, t))
    same = (window[order[1:]] == window[order[:-1]]) & (t[order[1:]] == t[order[:-1]])
    twice = np.zeros(len(fits), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(word), bool)
    for step in range(3):
        covered[fits[twice] + step] = True
    return np.bincount(text[covered], minlength=n)


def _measures(buf: np.ndarray, bounds: np.ndarray, langs: list[str | None]) -> list[np.ndarray | list]:
    n = len(bounds) - 1
    starts, ends, counts = w.spans(buf, bounds)
    solid = ~w.SPACE[buf]
    data = buf[solid]
    words, word = distinct(data, np.concatenate([[0], np.cumsum(ends - starts)]))
    at = np.concatenate([[0], np.cumsum(counts)])
    chars = _per_text(solid & ((buf & 0xC0) != 0x80), bounds)
    ids, fallback, byte_tokens = _encoders()(words)
    tokens = _per_text(ids.sizes[word], at)
    # entropy: the tokens of each text, counted
    values, _ = ids.take(word)
    text = np.repeat(np.arange(n), tokens)
    key = np.sort(text * (1 << 20) + values)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    weighted = np.bincount(key[new] >> 20, times * np.log2(times), minlength=n) if len(key) else np.zeros(n)
    held = np.maximum(tokens, 1)
    entropy = np.log2(held) - weighted / held
    relative = np.where(tokens > 1, entropy / np.log2(np.clip(tokens, 2, ENOUGH)), 0.0)
    lead = LEAD[buf]
    script = np.stack([_per_text(lead == s, bounds) for s in range(len(SCRIPTS))])
    main = np.where(script.sum(0) > 0, script.argmax(0), len(SCRIPTS) - 1)
    band = [x if x in BANDS else SCRIPTS[m] for x, m in zip(langs, main, strict=True)]
    some = counts > 0
    ratio = lambda a, b: np.where(some, a / np.maximum(b, 1), 0.0)
    return [
        counts,
        chars,
        _per_text(SYMBOL[buf], bounds),
        _dup_lines(buf, bounds, starts),
        _repeated_words(word, counts),
        tokens,
        ratio(chars, tokens),
        ratio(chars, _per_text(byte_tokens[word], at)),
        ratio(_per_text(fallback[word], at), tokens),
        np.round(relative, 12),
        band,
    ]


def measured(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs with one struct column `_fertility` of all measures. Null texts count as empty."""
    lang = F.col(lang_col) if lang_col else F.lit(None)
    band = "_band"
    while band in docs.columns:
        band += "_"
    rows = docs.withColumn(band, F.lower(lang.cast("string")))
    kept = [c for c in docs.columns if c != "_fertility"]
    names = [x.split()[0] for x in FIELDS.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in w.blocks(batches, text_col):
            buf, bounds = w.buffer(block.column(text_col))
            columns = _measures(buf, bounds, block.column(band).to_pylist())
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in kept), struct], names=[*kept, "_fertility"])

    return light(rows).mapInArrow(run, with_column(docs.select(*kept), "_fertility", StructType.fromDDL(FIELDS)))


def base_failed() -> F.Column:
    m = F.col("_fertility")
    return (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEATED * m.n_words)


def in_band() -> F.Column:
    """Whether the measures lie in the text's band."""
    m, out = F.col("_fertility"), F.lit(False)
    halvings = F.greatest(F.lit(0.0), F.log2(F.lit(float(ENOUGH)) / F.greatest(m.n_tokens, F.lit(1))))
    for band, b in BANDS.items():
        ok = m.chars_per_token.between(b.low_chars, b.high_chars) & (m.chars_per_byte_token <= b.high_chars) & (m.fallback_share <= b.max_fallback)
        out = F.when(m.band == band, ok & (m.token_entropy >= b.low_entropy + b.rise * halvings)).otherwise(out)
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Measures and verdict of every row: id_col, the counts, base_failed, kept, then the fertility measures and band.

    Null or repeated ids stay as they are, row by row, and no row's verdict depends on another. Null and empty texts have no words
    and fail. A text of any length is measured whole. A null or unknown language is judged by the script most of its letters have.
    Other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("lang"))
    out = measured(rows).select("doc_id", "_fertility").withColumn("base_failed", base_failed())
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_tokens", "chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy", "band"]
    return out.select(F.col("doc_id").alias(id_col), *(f"_fertility.{c}" for c in base), "base_failed", (~F.col("base_failed") & in_band()).alias("kept"), *(f"_fertility.{c}" for c in more))


def kept(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    rows = measured(docs, text_col, lang_col)
    return rows.filter(~base_failed() & in_band()).select(*(c for c in rows.columns if c != "_fertility"))

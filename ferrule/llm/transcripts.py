"""Transcript parsing by a hidden Markov model.

A line of a transcript is seen through its speaker marker and its shape. The hidden states are a role's first line of a
turn and its further lines; Viterbi finds the likeliest states, and turns are rendered in one form.

Transcripts are cut into blocks of turns. A block's lines act on the state like a matrix of best log probabilities
(max-plus); those matrices, a few numbers a block, are chained per transcript, and then every block is decoded by
itself between its known ends. So a transcript of any length spreads over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

ROLES = ("system", "user", "assistant")
#: State 2 * role: first line of a turn; 2 * role + 1: further line.
STATES = 2 * len(ROLES)
BLOCK = 64
#: Place of rows without one: behind all others.
LAST = (1 << 62) - 1
#: Markers by which transcripts name a speaker.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "you", "me", "customer", "prompt"),
    "assistant": ("assistant", "ai", "answer", "a", "bot", "agent", "model", "response"),
}
_ROLE_OF = {m: r for r, ms in MARKERS.items() for m in ms}
MARKER = re.compile(r"^\s*[\[<|*#(]*\s*(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*[\])|*]*\s*[:>]+[\s*|>\])]*", re.I)
#: Marker kinds: none, one of each role.
KINDS = ("none", *ROLES)
#: Shapes: length in four steps, ends with a question mark, starts like a list or code, comes first in the transcript.
SHAPES = 4 * 2 * 2 * 2
LENGTHS = (40, 160, 500)
SMOOTH = 0.5


def observed(line: str, first: bool) -> tuple[int, int]:
    """Marker kind and shape of a line."""
    m = MARKER.match(line)
    kind = KINDS.index(_ROLE_OF[m[1].lower()]) if m else 0
    text = line[m.end() :] if m else line
    length = sum(len(text) > n for n in LENGTHS)
    return kind, ((length * 2 + text.rstrip().endswith("?")) * 2 + text.lstrip().startswith(("-", "*", "```", ">", "1."))) * 2 + first


class Model:
    """Log probabilities: start, moves, and of markers and shapes in each state."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, kinds: np.ndarray, shapes: np.ndarray):
        norm = lambda x: np.log((x + SMOOTH) / (x + SMOOTH).sum(-1, keepdims=True))
        allowed = np.zeros((STATES, STATES))
        for s in range(STATES):
            for t in range(STATES):
                # a further line belongs to its own turn; a first line may follow any
                allowed[s, t] = 0 if t % 2 == 0 or s // 2 == t // 2 else -1e9
        self.start = norm(start) + np.where(np.arange(STATES) % 2, -1e9, 0)
        self.moves, self.kinds, self.shapes = norm(moves) + allowed, norm(kinds), norm(shapes)

    def emissions(self, seen: list[tuple[int, int]]) -> np.ndarray:
        at = np.array(seen).reshape(-1, 2)
        return (self.kinds[:, at[:, 0]] + self.shapes[:, at[:, 1]]).T

    def matrix(self, emissions: np.ndarray) -> np.ndarray:
        """Best log probability from the state before a block's lines to that of its last line."""
        out = np.where(np.eye(STATES) > 0, 0.0, -1e18)
        for e in emissions:
            out = (out[:, :, None] + self.moves[None]).max(1) + e
        return out

    def from_start(self, emissions: np.ndarray) -> np.ndarray:
        """The same for a transcript's first lines: every row holds what its start gives."""
        best = self.start + emissions[0]
        for e in emissions[1:]:
            best = (best[:, None] + self.moves).max(0) + e
        return np.tile(best, (STATES, 1))

    def path(self, emissions: np.ndarray, entry: int, last: int) -> np.ndarray:
        """Likeliest states of the lines; entry: state before them, or -1 at the start; last: state of the last line."""
        best = self.start + emissions[0] if entry < 0 else self.moves[entry] + emissions[0]
        back = np.zeros((len(emissions), STATES), np.int64)
        for i, e in enumerate(emissions[1:], 1):
            step = best[:, None] + self.moves
            back[i] = step.argmax(0)
            best = step.max(0) + e
        out = np.empty(len(emissions), np.int64)
        out[-1] = last
        for i in range(len(emissions) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def blocks(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str | None = None) -> DataFrame:
    """Pieces of transcripts in blocks of BLOCK rows: conv, block, items (place, text, role).

    Rows are in order of their turn, then of text and role; those with a null turn come last, in blocks of their own. Repeated
    rows with a turn are one piece, and with a null turn as many as they are. Rows are numbered inside their range partition first, then by
    the counts of the partitions before it, so no task holds all rows of a conversation or of one turn.
    """
    role = F.lower(F.col(role_col)) if role_col else F.lit(None).cast("string")
    every = turns.select(F.col(id_col).alias("conv"), F.col(order_col).cast("long").alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), role.alias("role"))
    counted = every.groupBy("conv", "turn", "text", "role").agg(F.count("*").alias("n"))
    counted = counted.select("conv", F.coalesce("turn", F.lit(LAST)).alias("place"), F.col("turn").isNull().alias("late"), "text", "role", F.when(F.col("turn").isNull(), F.col("n")).otherwise(1).alias("n"))
    order = ["late", "place", "text", "role"]
    ranged = saved(counted.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    before = F.sum("n").over(Window.partitionBy("conv", "late").orderBy("part")) - F.col("n")
    offsets = ranged.groupBy("conv", "late", "part").agg(F.sum("n").alias("n")).select(F.col("conv").alias("c"), F.col("late").alias("l"), F.col("part").alias("p"), before.alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("conv", "late", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rows = ranged.withColumn("inside", inside).join(offsets, F.col("conv").eqNullSafe(F.col("c")) & (F.col("late") == F.col("l")) & (F.col("part") == F.col("p")))
    rows = rows.withColumn("at", F.col("offset") + F.col("inside"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("n") - 1) / BLOCK))))
    copies = F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("at"), F.col("block") * BLOCK)
    items = F.array_repeat(F.struct("place", "text", "role"), copies.cast("int"))
    block = F.when(F.col("late"), F.col("block") + LAST // BLOCK).otherwise(F.col("block"))
    return rows.groupBy("conv", block.alias("block")).agg(F.sort_array(F.flatten(F.collect_list(items))).alias("items"))


def fit(labelled: DataFrame) -> Model:
    """Counts of moves and features over all blocks whose pieces hold roles (see blocks), moves from one block to the next
    included. The counts are a fixed number of cells, summed by Spark.
    """
    sizes = [STATES, STATES * STATES, STATES * len(KINDS), STATES * SHAPES]
    edge = np.concatenate([[0], np.cumsum(sizes)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(edge[-1], np.int64)
        for batch in batches:
            for block, items in zip(batch.column("block").to_pylist(), batch.column("items").to_pylist(), strict=True):
                before = -1
                for j, item in enumerate(items):
                    if item["role"] not in ROLES:
                        before = -1
                        continue
                    for k, line in enumerate(item["text"].split("\n")):
                        first = block == 0 and j == 0 and k == 0
                        kind, shape = observed(line, first)
                        state = 2 * ROLES.index(item["role"]) + (k > 0)
                        if first:
                            cells[state] += 1
                        elif before >= 0:
                            cells[edge[1] + before * STATES + state] += 1
                        cells[edge[2] + state * len(KINDS) + kind] += 1
                        cells[edge[3] + state * SHAPES + shape] += 1
                        before = state
        held = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(cells[held])], names=["cell", "n"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States of a block's first and last line, null where the role is unknown."""
        for batch in batches:
            out = []
            for items in batch.column("items").to_pylist():
                first, last = (ROLES.index(items[i]["role"]) if items[i]["role"] in ROLES else None for i in (0, -1))
                out.append((None if first is None else 2 * first, None if last is None else 2 * last + ("\n" in items[-1]["text"])))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1))], names=["conv", "block", "first", "last"])

    ends = labelled.select("conv", "block", "items").mapInArrow(borders, f"conv {labelled.schema['conv'].dataType.simpleString()}, block long, first long, last long")
    after = ends.select(F.col("conv").alias("c"), (F.col("block") - 1).alias("b"), F.col("first").alias("next")).filter("next is not null")
    moved = ends.filter("last is not null").join(after, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    between = moved.select((F.lit(int(edge[1])) + F.col("last") * STATES + F.col("next")).alias("cell"), F.lit(1).cast("long").alias("n"))

    cells = np.zeros(edge[-1])
    for row in labelled.mapInArrow(count, "cell long, n long").unionByName(between).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[row.cell] = row.n
    start, moves, kinds, shapes = (cells[a:b] for a, b in zip(edge, edge[1:], strict=False))
    return Model(start, moves.reshape(STATES, STATES), kinds.reshape(STATES, -1), shapes.reshape(STATES, -1))


def _seen(block_first: bool, items: list[dict]) -> tuple[list[str], list[tuple[int, int]]]:
    lines = [x for item in items for x in item["text"].split("\n")]
    return lines, [observed(x, block_first and i == 0) for i, x in enumerate(lines)]


def parsed(pieces: DataFrame, model: Model) -> DataFrame:
    """Decoded blocks (see blocks): conv, block, roles (of every line), begins (whether it starts a turn), lines."""
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    opened = pieces.groupBy("conv").agg(F.min("block").alias("b")).withColumnRenamed("conv", "c")
    held = pieces.join(opened, F.col("conv").eqNullSafe(F.col("c"))).withColumn("first", F.col("block") == F.col("b")).drop("c", "b")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for items, start in zip(batch.column("items").to_pylist(), batch.column("first").to_pylist(), strict=True):
                e = model.emissions(_seen(start, items)[1])
                out.append(model.from_start(e) if start else model.matrix(e))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array([m.reshape(-1) for m in out], pa.list_(pa.float64()))], names=["conv", "block", "matrix"])

    kind = pieces.schema["conv"].dataType.simpleString()
    chained = held.mapInArrow(matrices, f"conv {kind}, block long, matrix array<double>").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("all"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, block, entry, last = [], [], [], []
            for c, every in zip(batch.column("conv").to_pylist(), batch.column("all").to_pylist(), strict=True):
                ms = [np.array(x["matrix"]).reshape(STATES, STATES) for x in every]
                best, back = ms[0][0], []
                for m in ms[1:]:
                    step = best[:, None] + m
                    back.append(step.argmax(0))
                    best = step.max(0)
                state = [int(best.argmax())]
                for b in reversed(back):
                    state.append(int(b[state[-1]]))
                state.reverse()
                conv += [c] * len(ms)
                block += [x["block"] for x in every]
                entry += [-1, *state[:-1]]
                last += state
            yield pa.RecordBatch.from_arrays([pa.array(conv, batch.column("conv").type), pa.array(block, pa.int64()), pa.array(entry, pa.int32()), pa.array(last, pa.int32())], names=["conv", "block", "entry", "last"])

    ended = chained.mapInArrow(ends, f"conv {kind}, block long, entry int, last int")
    joined = held.join(ended.withColumnsRenamed({"conv": "c", "block": "b"}), same)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, begins, texts = [], [], []
            for items, start, entry, last in zip(*(batch.column(c).to_pylist() for c in ("items", "first", "entry", "last")), strict=True):
                lines, seen = _seen(start, items)
                states = model.path(model.emissions(seen), entry, last)
                roles.append([ROLES[s // 2] for s in states])
                begins.append([bool(s % 2 == 0) for s in states])
                texts.append([MARKER.sub("", x, count=1) if s % 2 == 0 and seen[i][0] == 1 + s // 2 else x for i, (x, s) in enumerate(zip(lines, states, strict=True))])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(roles, pa.list_(pa.string())), pa.array(begins, pa.list_(pa.bool_())), pa.array(texts, pa.list_(pa.string()))], names=["conv", "block", "roles", "begins", "lines"])

    return joined.select("conv", "block", "items", "first", "entry", "last").mapInArrow(decode, f"conv {kind}, block long, roles array<string>, begins array<boolean>, lines array<string>")


def rendered(decoded: DataFrame) -> DataFrame:
    """decoded with `text`: the block in canonical form, a line `<|role|>` before each turn, and n_turns begun in it."""
    marks = F.zip_with(F.zip_with("roles", "begins", lambda r, b: F.when(b, F.concat(F.lit("<|"), r, F.lit("|>\n"))).otherwise(F.lit(""))), "lines", lambda m, x: F.concat(m, x))
    return decoded.withColumn("text", F.array_join(marks, "\n")).withColumn("n_turns", F.size(F.filter("begins", lambda b: b)).cast("long"))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """The conversations table as people write transcripts down: by conversation, markers of one of four styles on
    every turn, on the user's only, or on none. The role stays beside the text, for fitting and scoring."""
    style = F.pmod(F.xxhash64(F.col("conv_id")), F.lit(4))
    role = F.lower("role")
    long = F.when(role == "user", "User: ").when(role == "assistant", "Assistant: ").when(role == "system", "System: ").otherwise("")
    short = F.when(role == "user", "Q: ").when(role == "assistant", "A: ").when(role == "system", "[sys]: ").otherwise("")
    half = F.when(role == "user", "**Human:** ").otherwise("")
    mark = F.when(style == 0, long).when(style == 1, short).when(style == 2, half).otherwise("")
    return conversations.select("conv_id", "turn", role.alias("role"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))


def _held_out(conv: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), conv), F.lit(5)) == 0


def parse_conversations(conversations: DataFrame) -> DataFrame:
    """Writes the table's conversations as raw transcripts, fits the model to four of five of them (by a hash of the
    id), and parses them all.

    Returns per block of up to 64 rows of a conversation: conv_id, block, n_lines, n_turns begun, n_right (lines
    whose role was recovered), roles (of the turns begun), rendered_sha256 of the canonical form, and held_out (whether the
    model hasn't seen the conversation: by these rows it is to be judged). Rows repeated in all
    of conv_id, turn, role and text count once, unless turn is null; a null turn comes last, a null text is an empty line, a null or unknown
    role counts as not recovered and isn't learnt from. Rows with a null conv_id are one conversation. Other columns
    are ignored.
    """
    pieces = saved(blocks(raw_transcripts(conversations), role_col="role"), "pieces")
    model = fit(pieces.filter(~_held_out(F.col("conv"))))
    out = rendered(parsed(pieces, model))
    sizes = F.flatten(F.transform("items", lambda i: F.array_repeat(i["role"], F.size(F.split(i["text"], "\n", -1)))))
    truth = pieces.select(F.col("conv").alias("c"), F.col("block").alias("b"), sizes.alias("truth"))
    both = out.join(truth, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    right = F.size(F.filter(F.zip_with("roles", "truth", lambda a, b: a.eqNullSafe(b)), lambda x: x)).cast("long")
    begun = F.transform(F.filter(F.arrays_zip("roles", "begins"), lambda x: x["begins"]), lambda x: x["roles"])
    return both.select(
        F.col("conv").alias("conv_id"),
        F.col("block").cast("long").alias("block"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_turns",
        right.alias("n_right"),
        begun.alias("roles"),
        F.sha2("text", 256).alias("rendered_sha256"),
        _held_out(F.col("conv")).alias("held_out"),
    )


"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the signed axis nearest to
it. Two independent hashes make a bucket of a table. A vector is stored in its own bucket of each table and looked up
there and in the buckets next in line (multiprobe). Vectors that meet are compared by 128 signs of their rotations first,
inside the join, so that only pairs at about the threshold are made; each is verified by its cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import components, keyed, saved

THRESHOLD = 0.93
TABLES = 12
PROBES = 8
#: Axes of each hash that probes may use.
AXES = 4
#: Signs of random projections; a pair at the threshold differs in more than its share plus so many standard deviations with 1e-9.
SIGNS = 128
DEVIATIONS = 6


@lru_cache(4)
def _signs(dim: int, tables: int) -> np.ndarray:
    return np.random.default_rng(dim * 1000 + tables).choice([-1.0, 1.0], (tables, 2, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """n x tables x probes bucket numbers of unit vectors, a vector's own bucket first."""
    n, width = x.shape
    dim = 1 << max(1, (width - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - width)))
    axes = min(AXES, dim)
    rows = np.arange(n)[:, None]
    out = np.empty((n, tables, probes), np.int64)
    for t, signs in enumerate(_signs(dim, tables)):
        codes, costs = [], []
        for three in signs:
            y = x
            for s in three:
                y = hadamard(y * s)
            size = np.abs(y)
            best = np.argpartition(-size, axes - 1, 1)[:, :axes] if axes < dim else np.tile(np.arange(dim), (n, 1))
            best = np.take_along_axis(best, np.argsort(-size[rows, best], 1, kind="stable"), 1)
            codes.append(best * 2 + (y[rows, best] < 0))
            costs.append((size[rows, best[:, :1]] - size[rows, best]) ** 2)
        cost = (costs[0][:, :, None] + costs[1][:, None, :]).reshape(n, -1)
        code = (codes[0][:, :, None] * (2 * dim) + codes[1][:, None, :]).reshape(n, -1)
        order = np.argsort(cost, 1, kind="stable")[:, :probes]
        out[:, t, : order.shape[1]] = np.take_along_axis(code, order, 1)
        out[:, t, order.shape[1] :] = out[:, t, :1]
        out[:, t] += t * 4 * dim * dim
    return out


@lru_cache(8)
def _planes(width: int) -> np.ndarray:
    return np.random.default_rng(width).standard_normal((width, SIGNS))


def signs(x: np.ndarray) -> np.ndarray:
    """n x 2 numbers whose bits are the sides of random planes that the vectors lie on."""
    return np.packbits(x @ _planes(x.shape[1]) > 0, axis=1).view("<i8")


def most_apart(threshold: float) -> int:
    """Signs in which a pair at the threshold may differ."""
    share = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return int(np.ceil(SIGNS * share + DEVIATIONS * np.sqrt(SIGNS * share * (1 - share))))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("vector").value_lengths().to_numpy()
        for width in np.unique(sizes):
            part = batch.filter(pa.array(sizes == width))
            x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            x = x / np.abs(x).max(1, keepdims=True)
            found, side = buckets(x / np.linalg.norm(x, axis=1, keepdims=True)), signs(x)
            # label, width and bucket in one number
            label = part.column("label").to_numpy().astype(np.int64).view(np.uint64)[:, None, None]
            code = w.mix(w.mix(label * np.uint64(w.BASES[0]) + np.uint64(width)) + found.astype(np.uint64)).view(np.int64)
            n, tables, probes = code.shape
            lists = lambda c: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (c.size // max(n, 1))), pa.array(c.reshape(-1)))
            columns = [part.column("key"), pa.array(side[:, 0]), pa.array(side[:, 1]), lists(np.ascontiguousarray(code[:, :, 0])), lists(np.ascontiguousarray(code[:, :, 1:]))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "one", "two", "own", "others"])


def _near(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sizes = part.column("va").value_lengths().to_numpy()
                ok = np.zeros(part.num_rows, bool)
                for width in np.unique(sizes):
                    rows = np.flatnonzero(sizes == width)
                    a, b = (part.column(c).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) for c in ("va", "vb"))
                    # by powers of two, which change no digit, so that no square is too large or too small
                    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a, b))
                    ok[rows] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= threshold
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return run


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id_col, n_links, component_id, kept.

    Two rows link if their labels are equal and not null and their vectors, of the same length, have a cosine of at least
    the threshold. Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor do
    rows with a null label; they are their own component. Equal vectors are compared once and counted by their number.
    With null or repeated ids every row counts as its own, numbered in order of id (nulls first) and the other
    columns, and component_id is such a number. Further columns are ignored.
    """
    rows = keyed(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")), "id")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    good = rows.filter(F.coalesce(usable, F.lit(False)))
    same = saved(good.groupBy("label", "vector").agg(F.min("_key").alias("key"), F.count("*").alias("copies")), "vectors")
    hashed = saved(same.select("key", "label", "vector").mapInArrow(_hashed, "key long, one long, two long, own array<long>, others array<long>"), "hashes")
    own = hashed.select(F.col("key").alias("x"), F.col("one").alias("x1"), F.col("two").alias("x2"), F.explode("own").alias("bucket"))
    others = hashed.select(F.col("key").alias("y"), F.col("one").alias("y1"), F.col("two").alias("y2"), F.explode(F.array_distinct(F.concat("own", "others"))).alias("bucket"))
    alike = F.expr(f"x <> y and bit_count(x1 ^ y1) + bit_count(x2 ^ y2) <= {most_apart(threshold)}")
    pairs = own.join(others, (own["bucket"] == others["bucket"]) & alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda x: same.select(F.col("key").alias(x), F.col("vector").alias(f"v{x}"))
    links = saved(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near(threshold), "a long, b long"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(same.select(F.col("key").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("linked"))
    component = saved(components(links), "components")
    of_vector = (
        same.join(counts, same["key"] == counts["a"], "left")
        .join(component, same["key"] == component["id"], "left")
        .select("label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component_id"))
    )
    found = good.join(of_vector, ["label", "vector"]).select("_key", "n_links", "component_id")
    out = rows.select("_key", "id").join(found, "_key", "left")
    component_id = F.coalesce("component_id", "_key")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (component_id == F.col("_key")).alias("kept"))

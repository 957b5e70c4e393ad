"""Exact search for the largest inner products, by buckets of vectors of about one length.

Components are taken as floor(256 * x). Vectors are put into buckets by their length, in steps of an eighth of an octave, and buckets
of many vectors are dealt into chunks. A query is first compared with one chunk of each of the longest classes; its k-th best
score there is a bound that every result must reach. For each other chunk that bound, divided by the query's length and by
the chunk's largest, is a local threshold of the cosine. Above one, the chunk can't hold a result and is never
joined. From COORDINATE on, candidates are those whose components at the query's largest ones lie within the ranges that the threshold
allows (coordinate pruning); below it, those that are long enough (length pruning). What is left is verified by
exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .common import keyed, saved

SCALE = 256.0
#: Buckets of lengths in an octave.
STEPS = 8
#: Vectors of a chunk of a bucket, and of a block of queries.
CHUNK, BLOCK = 2048, 1024
#: The longest classes whose first chunks give the first bound.
SEEDS = 8
#: The local cosine threshold from which coordinates prune better than lengths, and how many of them are looked at.
COORDINATE, FOCUS = 0.9, 4
#: Bounds are widened by so much, so that rounding can lose nothing.
SLACK = 1e-9
#: The class of zero vectors.
ZERO = -(1 << 20)
#: A width has at most some 8,200 classes; so many rows of classes are broadcast.
BROADCAST_CLASSES = 100_000
#: Up to this size sums of products are exact in doubles.
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1

SCALED = "key long, asks boolean, width int, class int, length double, vector binary"
BLOCKS = "width int, class int, chunk long, keys binary, lengths binary, bounds binary, matrix binary"


def classes(length: np.ndarray) -> np.ndarray:
    """The bucket of a length."""
    out = np.full(len(length), ZERO, np.int64)
    out[length > 0] = np.floor(np.log2(length[length > 0]) * STEPS)
    return out


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("vector").value_lengths().to_numpy()
        for width in np.unique(sizes):
            part = batch.filter(pa.array(sizes == width))
            x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, width)
            x = np.floor(x * SCALE)
            top = np.abs(x).max(1, initial=0, keepdims=True)
            length = top[:, 0] * np.sqrt(((x / np.where(top > 0, top, 1)) ** 2).sum(1))
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("asks"), pa.array(np.full(len(x), width, np.int32)), pa.array(classes(length).astype(np.int32)), pa.array(length), rows], names=["key", "asks", "width", "class", "length", "vector"])


def _gathered(table: pa.Table) -> pa.Table:
    """One row for the vectors of a chunk, the longest first."""
    first = lambda c: table.column(c)[0].as_py()
    keys, length = table.column("key").to_numpy(), table.column("length").to_numpy()
    bound = table.column("bound").to_numpy()
    width = first("width")
    matrix = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(keys), width)
    order = np.lexsort((keys, -length))
    columns = [[first("width")], [first("class")], [first("chunk")], *([x[order].tobytes()] for x in (keys, length, bound, matrix))]
    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["width", "class", "chunk", "keys", "lengths", "bounds", "matrix"])


def gathered(rows: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """rows (as SCALED, with bound) in blocks of about `size`; sizes: width, class, rows. A class of any size is spread."""
    chunk = F.pmod(F.xxhash64("key"), F.expr(f"(rows + {size - 1}) div {size}"))
    dealt = rows.join(_few(sizes), ["width", "class"]).select(*rows.columns, chunk.alias("chunk"))
    return dealt.groupBy("width", "class", "chunk").applyInArrow(_gathered, BLOCKS)


def best(product: np.ndarray, bound: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row that reach the row's bound, ties to the smaller key."""
    if product.shape[1] > k:
        bound = np.maximum(bound, np.partition(product, -k, axis=1)[:, -k])
    row, column = np.nonzero((product >= bound[:, None]) & (product > -np.inf))
    order = np.lexsort((keys[column], -product[row, column], row))
    row, column = row[order], column[order]
    at = np.arange(len(row)) - np.searchsorted(row, row)
    return row[at < k], column[at < k]


def ranges(query: np.ndarray, threshold: np.ndarray, focus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest component at `focus` of unit vectors whose cosine with the unit vectors `query` is at least the threshold."""
    wide, apart = np.arccos(np.clip(threshold, -1, 1)), np.arccos(np.clip(np.take_along_axis(query, focus, 1), -1, 1))
    low, high = np.minimum(np.pi, apart + wide[:, None]), np.maximum(0, apart - wide[:, None])
    return np.cos(low) - 1e-7, np.cos(high) + 1e-7


def searched(query: dict, chunk: dict, k: int, coordinate: float = COORDINATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's rows, chunk's rows and products: per query the k best of the chunk that reach its bound, its own row left out."""
    q, c, bound = query["matrix"], chunk["matrix"], query["bounds"]
    long, short = chunk["lengths"], query["lengths"]
    with np.errstate(all="ignore"):
        need = np.where((bound > 0) & (short > 0), bound / short * (1 - SLACK), 0.0)
        local = np.where(need > 0, need / long[0], 0.0)
    local[~np.isfinite(local)] = 0.0
    alive = local <= 1
    found = []
    focused = np.flatnonzero(alive & (local >= coordinate))
    if len(focused):
        # all the vectors that are long enough, as unit vectors
        enough = np.searchsorted(-long, -need[focused].min(), "right")
        unit = c[:enough] / long[:enough, None]
        own = q[focused] / short[focused, None]
        axes = np.argsort(-np.abs(own), axis=1, kind="stable")[:, :FOCUS]
        low, high = ranges(own, local[focused], axes)
        orders, sizes, starts = {}, np.empty(axes.shape, np.int64), np.empty(axes.shape, np.int64)
        for axis in np.unique(axes):
            order = orders[axis] = np.argsort(unit[:, axis], kind="stable")
            at = axes == axis
            sorted_ = unit[order, axis]
            starts[at] = np.searchsorted(sorted_, low[at], "left")
            sizes[at] = np.searchsorted(sorted_, high[at], "right") - starts[at]
        narrow = sizes.argmin(1)
        for i in np.flatnonzero(sizes.min(1) > 0):
            n = narrow[i]
            rows = orders[axes[i, n]][starts[i, n] : starts[i, n] + sizes[i, n]]
            for other in range(axes.shape[1]):
                if other != n and len(rows):
                    x = unit[rows, axes[i, other]]
                    rows = rows[(x >= low[i, other]) & (x <= high[i, other])]
            rows = rows[chunk["keys"][rows] != query["keys"][focused[i]]]
            if len(rows):
                product = c[rows] @ q[focused[i]]
                _, column = best(product[None], bound[focused[i : i + 1]], chunk["keys"][rows], k)
                found.append((np.full(len(column), focused[i]), rows[column], product[column]))
    rest = np.flatnonzero(alive & (local < coordinate))
    if len(rest):
        enough = np.searchsorted(-long, -need[rest].min(), "right")
        product = q[rest] @ c[:enough].T
        product[query["keys"][rest][:, None] == chunk["keys"][:enough]] = -np.inf
        row, column = best(product, bound[rest], chunk["keys"][:enough], k)
        found.append((rest[row], column, product[row, column]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def whole(query: dict, chunk: dict, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """As searched(), in integers of any size: where sums of products may pass what doubles hold exactly."""
    vectors = [[int(x) for x in r] for r in chunk["matrix"]]
    rows, columns, products = [], [], []
    for i, r in enumerate(query["matrix"]):
        own = [int(x) for x in r]
        scores = ((sum(a * b for a, b in zip(own, v, strict=True)), int(key), n) for n, (v, key) in enumerate(zip(vectors, chunk["keys"], strict=True)) if key != query["keys"][i])
        least = query["bounds"][i] * (1 - np.sign(query["bounds"][i]) * SLACK)
        for product, _, n in sorted(((-max(-LARGEST, min(LARGEST, s)), key, n) for s, key, n in scores))[:k]:
            if -product >= least:
                rows.append(i)
                columns.append(n)
                products.append(-product)
    return np.array(rows, np.int64), np.array(columns, np.int64), products


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                side = []
                for of in "qc":
                    get = lambda name, of=of: batch.column(f"{of}_{name}")[i].as_buffer()
                    keys = np.frombuffer(get("keys"), np.int64)
                    side.append({"keys": keys} | {n: np.frombuffer(get(n), np.float64) for n in ("lengths", "bounds")} | {"matrix": np.frombuffer(get("matrix"), np.float64).reshape(len(keys), -1)})
                query, chunk = side
                exact = float(query["lengths"][0]) * float(chunk["lengths"][0]) < EXACT
                row, column, product = (searched if exact else whole)(query, chunk, k)
                score = pa.array(product.astype(np.int64) if exact else product, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(query["keys"][row]), pa.array(chunk["keys"][column]), score], names=["query", "key", "score"])
        w.released()

    return run


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("width", "class").agg(F.count("*").alias("rows"))


def _few(classes: DataFrame) -> DataFrame:
    return F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes


def _met(blocks: DataFrame, chunks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query, key, score of blocks and chunks that meet; pairs: block's and chunk's width, class and chunk."""
    side = lambda df, of: df.select("width", *(F.col(c).alias(f"{of}_{c}") for c in ("class", "chunk", "keys", "lengths", "bounds", "matrix")))
    met = pairs.join(side(blocks, "q"), ["width", "q_class", "q_chunk"]).join(side(chunks, "c"), ["width", "c_class", "c_chunk"])
    return met.select(*(f"{of}_{c}" for of in "qc" for c in ("keys", "lengths", "bounds", "matrix"))).mapInArrow(_searched(k), "query long, key long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def needed(bound: Column, length: Column) -> Column:
    """The lowest class that can hold a result."""
    least = F.floor(F.log2(bound / length * (1 - SLACK)) * STEPS - SLACK)
    return F.when((bound > 0) & (length > 0), F.coalesce(least, F.lit(ZERO))).otherwise(ZERO).cast("int")


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the largest inner products with each query: query_id, rank (from 1), vec_id, score; all rows if there are fewer.

    Queries are the rows of vectors for which is_query holds. Components count as floor(256 * x) of x as double. A query's own row isn't
    among its results; equal scores go to the smaller id. Vectors that are null, hold null or non-finite components (256 times one
    included) or have a null id take no part. Only vectors of one width are compared; empty vectors have the product 0 with
    each other. With repeated ids every row is a vector and a query of its own, in order of id and the other columns. A score
    beyond 63 bits counts as the largest or smallest number of 63 bits and a sign. Further columns are ignored.
    """
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < float("inf")))
    rows = keyed(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")), "id", key="key")
    good = rows.filter(F.col("id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    scaled = saved(good.select("key", "asks", "vector").mapInArrow(_scaled, SCALED), "scaled")
    none = F.lit(float("-inf")).alias("bound")
    sizes = saved(_sizes(scaled), "lengths")
    longest = sizes.groupBy("width").agg(F.max("class").alias("longest"))
    of_class = sizes.join(longest, "width").select("width", F.col("class").alias("c_class"), (F.col("class") > F.col("longest") - SEEDS).alias("first"), F.expr(f"(rows - 1) div {CHUNK}").alias("last"))
    chunks = saved(gathered(scaled.select("*", none), sizes, CHUNK), "chunks")
    asking = scaled.filter("asks")
    names = lambda blocks: blocks.select("width", F.col("class").alias("q_class"), F.col("chunk").alias("q_chunk"))

    # the first chunks of the longest classes
    first = asking.select("*", none)
    blocks = saved(gathered(first, _sizes(first), BLOCK), "queries")
    pairs = names(blocks).join(_few(of_class.filter("first").select("width", "c_class")), "width").withColumn("c_chunk", F.lit(0).cast("long"))
    seeded = saved(_ranked(_met(blocks, chunks, pairs, k), k), "seeded")

    # all other chunks of the classes that can reach the bound so found
    bound = seeded.groupBy("query").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
    reach = F.coalesce("least", F.lit(float("-inf")))
    second = asking.join(bound, F.col("key") == F.col("query"), "left").select("key", "asks", "width", needed(reach, F.col("length")).alias("class"), "length", "vector", reach.alias("bound"))
    second = saved(second, "bounded")
    blocks = saved(gathered(second, _sizes(second), BLOCK), "bounded-queries")
    pairs = names(blocks).join(_few(of_class), "width").filter("c_class >= q_class")
    pairs = pairs.withColumn("from", F.col("first").cast("long")).filter("from <= last").select("width", "q_class", "q_chunk", "c_class", F.explode(F.sequence("from", "last")).alias("c_chunk"))
    hits = _met(blocks, chunks, pairs, k).unionByName(seeded.select("query", "key", "score"))

    out = _ranked(hits, k)
    id_of = lambda key, name: rows.select(F.col("key").alias(key), F.col("id").alias(name))
    out = out.join(id_of("query", "query_id"), "query").join(id_of("key", "vec_id"), "key")
    return out.select("query_id", "rank", "vec_id", "score")


def top_products_sql(every: int = 50, k: int = 5) -> str:
    """The same in DuckDB's SQL for queries whose id is divisible by `every`."""
    return f"""
with scaled as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
products as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from scaled q join scaled c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % {every} = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from products)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= {k}
"""

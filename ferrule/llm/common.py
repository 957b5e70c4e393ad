"""Helpers the operators share: tables in the shared folder, row keys, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ferrule-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str, rows_at_once: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    rows_at_once: rows of a Parquet row group. Writers and readers hold a group (a hundred rows at least, else), so rows of megabytes need few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", rows_at_once) if rows_at_once else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def tidied(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when the driver collects its garbage, which may be long after."""
    for _ in range(2):  # the first lets go of the plans, the second of their shuffles
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def forgotten(*tables: DataFrame) -> None:
    """Delete tables that saved() wrote, once all that reads them is itself written."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a batch between the JVM and Python: rows hold long texts, and several workers share an executor's memory.
BATCH_BYTES = "8m"


def light(df: DataFrame) -> DataFrame:
    """df, after the session's batches for Python were bounded in bytes (a longer row is a batch of its own)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_column(df: DataFrame, name: str, kind: DataType) -> StructType:
    """The schema of df with one more column."""
    return StructType([*df.schema.fields, StructField(name, kind)])


def plain_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether ids are unique and not null: one scan of the id column finds out."""
    return docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty()


def keyed(docs: DataFrame, id_col: str = "doc_id", key: str = "_key", plain: bool | None = None) -> DataFrame:
    """docs with a unique, non-null long `key` in ascending order of id_col.

    Where ids are unique and not null the id is the key. Otherwise rows are ordered by id (nulls first) and then by
    all other columns, and numbered; the numbered table is written, so that every later read sees the same keys.
    """
    light(docs)
    if plain_ids(docs, id_col) if plain is None else plain:
        return docs.withColumn(key, F.col(id_col).cast("long"))
    order = [id_col, *(c for c, t in docs.dtypes if c != id_col and "map<" not in t)]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ranged.withColumn(key, F.monotonically_increasing_id()), "keyed")


def numbered(df: DataFrame, group: str, order: list[str], name: str = "numbered") -> DataFrame:
    """df with `pos`, a row's number from 0 in its `group` by ascending `order`, and `size`, the rows of the group; group is not null.

    Rows are dealt out by ranges of (group, order) and counted in each task, so that a group of any size is spread; what
    is added up per group is a row for each task that has rows of it. Rows equal in group and order may lie either way.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = saved(ranged.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_task", F.shiftright("_at", 33))
    parts = rows.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    all_of = Window.partitionBy(group)
    before = F.sum("_rows").over(all_of.orderBy("_task")) - F.col("_rows")
    parts = parts.select(group, "_task", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(all_of).alias("size"))
    return rows.join(parts, [group, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, component) per vertex of an edge,
    component being the smallest id reachable.

    Alternating large-star and small-star rounds: every vertex links its larger neighbours, then its
    smaller ones, to the least vertex it sees. The least vertex comes from a pre-aggregated groupBy, so a
    vertex with very many neighbours doesn't gather in one task. Each round is written to the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    links = saved(links, "links")
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.unionByName(least.filter("m < hi").select("hi", F.col("m").alias("lo"))).distinct()
        m = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(m, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, links = links, saved(small.unionByName(m.select("hi", F.col("m").alias("lo"))).filter("hi <> lo").distinct(), "links")
        forgotten(old)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("lo").alias("id")).distinct().withColumn("component", F.col("id"))
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)

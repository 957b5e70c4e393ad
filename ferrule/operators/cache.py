"""Classification that is done once for equal rows, across runs: results by version and fingerprint in a bucketed table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


class Cache:
    """Results of one version of the rules, kept in a folder from run to run.

    columns: the results' columns and types, as in a schema. The table is bucketed and sorted by key, so that looking keys up doesn't
    shuffle it. Every run appends once, after its classification is written; a run that dies before that is done again, one that dies
    in between may leave some of its results, which are right. A key that two runs append at a time counts once.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str, columns: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        self.path = f"{self.folder}/{hashlib.sha256(version.encode()).hexdigest()[:16]}"
        self.buckets, self.table = buckets, f"ferrule_cache_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        spark.sql(f"create table if not exists {self.table} (cache_key string, {columns}) using parquet clustered by (cache_key) sorted by (cache_key) into {buckets} buckets location '{self.path}'")

    def rows(self) -> DataFrame:
        """cache_key and results, once a key."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table).dropDuplicates(["cache_key"])

    def classified(self, rows: DataFrame, fingerprint: Column, order: str, classify: Callable[[DataFrame], DataFrame], checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows with cache_key, the results' columns and cache_hit: whether the result was there before the row's turn, by `order`.

        classify(rows) returns `order` and the results; it is given one row of each key that isn't in the table, the first
        by `order`, which must be unique. Rows without a fingerprint share the key of the empty one. Columns of rows that are named as the results are replaced.
        """
        before = self.rows()
        results = [c for c in before.columns if c != "cache_key"]
        rows = rows.drop(*results, "cache_key", "cache_hit").withColumn("cache_key", F.concat_ws(":", F.lit(self.version), F.coalesce(fingerprint, F.lit(""))))
        first = rows.groupBy("cache_key").agg(F.min(order).alias("_first"))
        new = checkpoint(first.join(before.select("cache_key"), "cache_key", "left_anti"))
        asked = rows.join(new.select(F.col("_first").alias(order)), order, "left_semi")
        fresh = checkpoint(classify(asked.drop("cache_key")).join(new.withColumnRenamed("_first", order), order).select("cache_key", *results))
        if not fresh.isEmpty():
            fresh.repartition(self.buckets, "cache_key").write.insertInto(self.table)
        out = rows.join(self.rows(), "cache_key").join(new, "cache_key", "left")
        return out.withColumn("cache_hit", F.col("_first").isNull() | (F.col("_first") != F.col(order))).drop("_first")

    def metrics(self, out: DataFrame, area: str, status: str, batch: int) -> dict[str, int]:
        """processed, cache_hits, classified, shadow_review, batches, cache_size of a run's rows."""
        sums = out.agg(F.count("*").alias("processed"), F.count_if("cache_hit").alias("cache_hits"), F.count(area).alias("classified"), F.count_if(F.col(status) == "shadow_review").alias("shadow_review"))
        found = sums.first().asDict()
        return found | {"batches": -(-found["processed"] // batch), "cache_size": self.rows().count()}

    def forget_others(self) -> None:
        """Delete the results of all other versions in the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in fs.listStatus(path) if fs.exists(path) else []:
            if found.getPath().getName() != self.path.rsplit("/", 1)[-1]:
                fs.delete(found.getPath(), True)

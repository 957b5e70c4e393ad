"""Claims on rows of a queue: two workers never get the same row, and a worker that is run again gets its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions

#: After so many versions one of them stands for all before it.
SUMMED = 20


class Claims:
    """Claims of a queue in a shared folder.

    A claim reads the newest version, writes the rows it takes as a table and adds the next version, which names the table. If another worker was faster it
    begins again with what is left. A worker that died before its version was added has claimed nothing; one that died
    after it finds its claim by its name. Tasks may be run twice, as only whole tables are named.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.versions = Versions(spark, f"{self.folder}/versions")

    def taken(self, versions: list[dict] | None = None) -> DataFrame:
        """key, worker of all claimed rows."""
        versions = self.versions.all() if versions is None else versions
        last = max((i for i, v in enumerate(versions) if "sum" in v), default=None)
        paths = [] if last is None else [versions[last]["sum"]]
        paths += [v["rows"] for v in (versions if last is None else versions[last:]) if v["rows"] not in paths]
        if not paths:
            return self.spark.createDataFrame([], f"`{self.key}` long, worker string")
        return self.spark.read.parquet(*paths).select(self.key, "worker").distinct()

    def claim(self, queue: DataFrame, worker: str, most: int, order: list[Column]) -> DataFrame:
        """The rows of queue (key, status, ...) that the worker has: up to `most` queued ones that nobody has claimed, the first by `order`.

        A worker's name stands for one claim: the same name gets the same rows again. Rows with a null key can't be claimed;
        of rows with one key all are.
        """
        while True:
            versions = self.versions.all()
            own = [v for v in versions if v["worker"] == worker]
            if not own:
                free = queue.filter((F.col("status") == "queued") & F.col(self.key).isNotNull()).join(self.taken(versions), self.key, "left_anti")
                path = f"{self.folder}/rows/{uuid.uuid4().hex}"
                free.orderBy(*order, self.key).limit(most).select(self.key, F.lit(worker).alias("worker")).write.mode("overwrite").parquet(path)
                content = {"worker": worker, "rows": path}
                if (len(versions) + 1) % SUMMED == 0:
                    content["sum"] = f"{path}-sum"
                    self.taken(versions).unionByName(self.spark.read.parquet(path).select(self.key, "worker")).write.mode("overwrite").parquet(content["sum"])
                if not self.versions.add(len(versions) + 1, content):
                    continue
                own = [content]
            return queue.join(self.spark.read.parquet(own[0]["rows"]).select(self.key).distinct(), self.key, "left_semi")

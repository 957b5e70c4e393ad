"""Numbered versions of a small state, of which exactly one writer can add the next: the compare-and-set that tables lack.

A version is a small file of JSON that names the tables it stands for; the tables themselves are written by Spark before and are
seen by nobody until their version is there. A file appears whole or not at all, and never twice under one number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """The versions in a folder that all writers share, numbered from 1."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def all(self) -> list[dict]:
        """Every version's content in order."""
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder)) if f.getPath().getName().endswith(".json"))
        return [self._read(n) for n in names]

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, number: int, content: dict) -> bool:
        """Whether this call made version `number`; False if another writer has. In a folder on a local disk a hard link decides, elsewhere a
        rename that doesn't overwrite, which is atomic in HDFS and its like."""
        made = f"{self.folder}/{uuid.uuid4().hex}.part"
        out = self._fs.create(self._path(made), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        final = f"{self.folder}/{number:012d}.json"
        try:
            if self._fs.getUri().getScheme() == "file":
                local = lambda name: self._jvm.java.nio.file.Path.of(self._path(name).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.String, 0))
                self._jvm.java.nio.file.Files.createLink(local(final), local(made))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(self._path(made), self._path(final), options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        finally:
            self._fs.delete(self._path(made), False)
        return True

"""A folder of parquet tables and metadata."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """``save`` / ``load`` / ``append`` / ``contains`` named tables under one root; metadata are JSON values in a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def contains(self, name: str) -> bool:
        fs, p = self._fs(name)
        return fs.exists(p)

    def save(self, name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.load(name)

    def append(self, name: str, table: DataFrame) -> None:
        table.write.mode("append").parquet(f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame:
        if not self.contains(name):
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def memo(self, name: str, make) -> DataFrame:
        """The table of that name, made and saved if it isn't there."""
        return self.load(name) if self.contains(name) else self.save(name, make())

    def remove(self, name: str) -> None:
        fs, p = self._fs(name)
        fs.delete(p, True)

    def tables(self) -> list[str]:
        fs, p = self._fs("")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def _versions(self) -> list[int]:
        return sorted(int(v) for t in self.tables() if (v := t.removeprefix("_metadata.v")) != t and v.isdigit())

    def set_metadata(self, **values) -> None:
        """Writes a new version; the one before it stays for those that read it, older ones go."""
        rows = self.metadata() | values
        data = [(k, json.dumps(v)) for k, v in sorted(rows.items())]
        versions = self._versions()
        self.spark.createDataFrame(data, "name string, value string").coalesce(1).write.mode("error").parquet(f"{self.path}/_metadata.v{max(versions, default=0) + 1}")
        for v in versions[:-1]:
            self.remove(f"_metadata.v{v}")

    def metadata(self) -> dict:
        """The last version that was written whole."""
        whole = [v for v in self._versions() if self.contains(f"_metadata.v{v}/_SUCCESS")]
        if not whole:
            return {}
        return {r[0]: json.loads(r[1]) for r in self.spark.read.schema("name string, value string").parquet(f"{self.path}/_metadata.v{whole[-1]}").collect()}

    def disk_usage(self) -> int:
        """Bytes under the root."""
        fs, p = self._fs("")
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def copy_to(self, path: str) -> Workspace:
        other = Workspace(self.spark, path)
        for name in self.tables():
            other.save(name, self.spark.read.parquet(f"{self.path}/{name}"))
        return other


def request_workspace(spark: SparkSession, root: str) -> Workspace:
    """A new workspace under a root, numbered above the largest; a file that only one caller can create claims it."""
    top = Workspace(spark, root)
    numbers = [int(n) for n in top.tables() if n.isdigit()]
    number = max(numbers, default=0) + 1
    while True:
        fs, p = top._fs(f"{number}/_claimed")
        try:
            fs.create(p, False).close()
            return Workspace(spark, f"{root.rstrip('/')}/{number}")
        except Py4JJavaError:
            if not fs.exists(p):
                raise
            number += 1

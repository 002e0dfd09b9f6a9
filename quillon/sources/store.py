"""Versioned tables in a folder: each write is a new version, and one rename makes it there as a whole.

A version is a Parquet folder v<number>, written elsewhere and moved in when it is whole; the highest is
the current one. There is no pointer beside it that could be lost. Readers keep the version they began
with. Two writers from the same version: the second is refused.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.errors import QueryError


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        folder = self._path(f"{self.root}/{table}")
        if not self._fs.exists(folder):
            return []
        found = (re.fullmatch(r"v(\d+)", status.getPath().getName()) for status in self._fs.listStatus(folder))
        return sorted(int(x[1]) for x in found if x)

    def version(self, table: str) -> int | None:
        return max(self.versions(table), default=None)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.version(table) if version is None else version
        if version is None:
            raise QueryError(f"The store has no table {table}")
        return self.spark.read.parquet(f"{self.root}/{table}/v{version}")

    def commit(self, table: str, df: DataFrame, read_version: int | None, partition_by: tuple[str, ...] = ()) -> int:
        """Write df as the version after read_version. A writer that dies before the rename leaves a tmp folder only."""
        new = (read_version or 0) + 1
        held, target = self._path(f"{self.root}/{table}/tmp-{uuid.uuid4().hex}"), self._path(f"{self.root}/{table}/v{new}")
        df.write.partitionBy(*partition_by).parquet(held.toString())
        # A rename onto a folder that is there would move into it, so that is looked at first; that the folder
        # moved is the one read back settles a race.
        moved = self.version(table) == read_version and not self._fs.exists(target) and self._fs.rename(held, target)
        nested = self._path(f"{target.toString()}/{held.getName()}")
        if not moved or self._fs.exists(nested):
            for lost in (held, nested):
                self._fs.delete(lost, True)
            raise QueryError(f"{table} was changed by another writer since version {read_version}")
        return new

    def clean(self, table: str, keep: int = 2) -> None:
        """Delete all but the latest versions."""
        for old in self.versions(table)[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{table}/v{old}"), True)

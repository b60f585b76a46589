"""The few file operations of table swaps and snapshots, on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Names only; contents are read and written by Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names of what lies in a folder; none if there is no such folder."""
        if not self.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(self._path(path)))

    def rename(self, path: str, to: str) -> None:
        if not self._files.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} could not be renamed to {to}")

    def delete(self, path: str) -> None:
        self._files.delete(self._path(path), True)

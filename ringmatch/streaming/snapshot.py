"""A small keyed table that a stream keeps up to date, as one compacted folder per version.

Version n is version n-1 merged with the rows of micro-batch n. A version counts when Spark's ``_SUCCESS`` mark is
in it. A batch that runs again writes its version again from the same one before; only the two newest
versions are kept, so files stay few however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ringmatch.sources.files import Files

KEPT = 2
#: Rows of the version before for each file of a version.
FILE_ROWS = 1 << 20


class Snapshot:
    """The versions below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = Files(spark, path)

    def versions(self) -> list[int]:
        """Numbers of the whole versions, oldest first."""
        numbers = [int(n[2:]) for n in self._files.names(self.path) if n.startswith("v=") and n[2:].isdigit()]
        return [n for n in sorted(numbers) if self._files.exists(f"{self.path}/v={n}/_SUCCESS")]

    def read(self) -> DataFrame:
        """The newest version."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"No version of a snapshot in {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}")

    def merge(self, changed: DataFrame, batch_id: int, reduce: Callable[[DataFrame], DataFrame]) -> None:
        """Write version ``batch_id``: ``reduce`` over the rows of the version before and the changed ones."""
        before = [n for n in self.versions() if n < batch_id]
        rows, files = changed, 1
        if before:
            held = self.spark.read.parquet(f"{self.path}/v={before[-1]}")
            rows, files = held.unionByName(changed), 1 + held.count() // FILE_ROWS
        # A shuffle: one task that reduced every partition would hold the memory of all of them at once.
        reduce(rows).repartition(files).write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        for number in before[: 1 - KEPT]:
            self._files.delete(f"{self.path}/v={number}")

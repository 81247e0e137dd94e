"""The best rows of a whole stream, not of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.operators import ranking

_VERSION = "batch="


class RunningTop:
    """The n best rows of all that has streamed in, kept as a table of n rows at most.

    Each micro-batch is merged with what was kept before it: both are n rows after each task's own top-N. The result is a
    new version of the table, named by the batch's number. A batch that runs again, after a failure, starts from the version before
    it, so that its rows count once. Order and ties are those of ranking.top(): by score, then the smaller id,
    a longer one before its own prefix.
    """

    def __init__(self, spark: SparkSession, path: str, n: int, score: str = "final_score"):
        self.spark, self.path, self.n, self.score = spark, path.rstrip("/"), n, score

    def _versions(self) -> list[int]:
        """Numbers of the batches whose versions are complete."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at)]
        done = lambda name: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))
        return sorted(int(n.removeprefix(_VERSION)) for n in names if n.startswith(_VERSION) and done(n))

    def _drop(self, number: int) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_VERSION}{number}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{_VERSION}{number}")

    def merge(self, batch: DataFrame, number: int) -> DataFrame:
        """The best rows after a batch; kept, while versions before the last one go."""
        versions = self._versions()
        before = [v for v in versions if v < number]
        rows = batch.unionByName(self._read(before[-1])) if before else batch
        ranking.top(rows, self.score, self.n).write.mode("overwrite").parquet(f"{self.path}/{_VERSION}{number}")
        for v in before[:-1]:
            self._drop(v)
        return self._read(number)

    def current(self) -> DataFrame | None:
        """The best rows so far; None before the first batch."""
        versions = self._versions()
        return self._read(versions[-1]) if versions else None

    def writer(self, scores: DataFrame, sink: Callable[[DataFrame, int], None] | None = None):
        """A stream writer that keeps the best of scores, and gives sink what it has after each batch."""

        def one(batch: DataFrame, number: int) -> None:
            best = self.merge(batch, number)
            if sink:
                sink(best, number)

        return scores.writeStream.foreachBatch(one)

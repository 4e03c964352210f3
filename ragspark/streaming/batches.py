"""Results of micro-batches, each written once: a log of commits keyed by the number of the batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class BatchLog:
    """A table that grows by a folder a batch, and a file for each batch that is wholly there.

    A batch that is run again, after a lost driver or a failed write, finds its commit and does nothing, or none and writes its folder
    anew. Readers see committed batches only. Paths may be in any file system that the cluster knows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, kind: str) -> list[int]:
        files, folder = self._at(kind)
        if not files.exists(folder):
            return []
        names = (status.getPath().getName() for status in files.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/{number:010d}"

    def committed(self) -> list[int]:
        return self._numbers("commits")

    def note(self, number: int) -> dict:
        """What was committed along with a batch."""
        files, path = self._at("commits", f"{number:010d}")
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, note: dict | None = None) -> None:
        files, path = self._at("commits", f"{number:010d}")
        out = files.create(path, False)
        out.write(bytearray(json.dumps(note or {}).encode()))
        out.close()

    def put(self, frame: DataFrame, number: int, note: dict | None = None) -> bool:
        """Write and commit a batch; false if it was committed before."""
        if number in self.committed():
            return False
        frame.write.mode("overwrite").parquet(self.folder("data", number))
        self.commit(number, note)
        return True

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        paths = [self.folder("data", n) for n in self.committed()]
        if not paths:
            raise FileNotFoundError(f"No batch is committed at {self.path}")
        return self.spark.read.parquet(*paths)

    # batches that could not be written yet wait beside the checkpoint

    def waiting(self) -> list[int]:
        return self._numbers("waiting")

    def drop(self, kind: str, number: int) -> None:
        files, path = self._at(kind, f"{number:010d}")
        files.delete(path, True)

"""A consumer over log records: positions, polls, seeks and commits, as calls that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import scans


class Consumer:
    """Reads one topic of records (topic, byte_offset, total_size, ...) from a position on.

    A stored offset, if `offsets` (a folder) has one for this name, beats `start`; a seek beats both.
    """

    def __init__(self, records: DataFrame, topic: str, name: str = "default", offsets: str | None = None, start: int = 0):
        self.records, self.topic, self.name, self.offsets = records.where(F.col("topic") == topic), topic, name, offsets
        stored = self.committed()
        self.position = start if stored is None else stored

    def end(self) -> int:
        return self.records.agg(F.sum("total_size")).first()[0] or 0

    def seek(self, to: int | str) -> int:
        """An offset, "beginning" or "end" (asked anew each time)."""
        self.position = {"beginning": lambda: 0, "end": self.end}[to]() if isinstance(to, str) else to
        return self.position

    def poll(self, max_bytes: int = 64 << 10) -> DataFrame:
        """The whole records that fit in max_bytes; the position moves past them (one that is larger than max_bytes comes alone)."""
        batch = scans.fetch_records(self.records, self.position, max_bytes)
        upto = batch.agg(F.max(F.col("byte_offset") + F.col("total_size"))).first()[0]
        if upto is None:
            size = self.records.where(F.col("byte_offset") >= self.position).agg(F.min_by("total_size", "byte_offset")).first()[0]
            batch = scans.fetch_records(self.records, self.position, size or 0)
            upto = self.position + (size or 0)
        self.position = upto
        return batch

    def commit(self) -> None:
        if self.offsets is None:
            raise ValueError("no folder for offsets")
        spark = self.records.sparkSession
        seq = (self._log().agg(F.max("seq")).first()[0] or 0) + 1 if self._there() else 1
        spark.createDataFrame([(seq, self.name, self.topic, self.position)], "seq long, consumer string, topic string, offset long").coalesce(1).write.mode("append").parquet(self.offsets)

    def committed(self) -> int | None:
        if self.offsets is None or not self._there():
            return None
        return self._log().agg(F.max_by("offset", "seq")).first()[0]

    def lag(self) -> int:
        return self.end() - (self.committed() or 0)

    def _log(self) -> DataFrame:
        return self.records.sparkSession.read.parquet(self.offsets).where((F.col("consumer") == self.name) & (F.col("topic") == self.topic))

    def _there(self) -> bool:
        spark = self.records.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.offsets)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

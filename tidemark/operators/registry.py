"""The topic registry: metadata statements over an append-only table of operations; the latest per topic id holds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "seq long, op string, topic_id long, name string, created_at long, max_age_secs long, max_bytes long"
NAME = re.compile(r"[A-Za-z0-9-]+\Z")


class TopicRegistry:
    """create, delete, set_retention, list and get; every call reads what is on disk, so any session sees the same topics."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def _put(self, op: str, topic_id: int, name: str, created_at: int = 0, max_age_secs: int | None = None, max_bytes: int | None = None) -> None:
        seq = (self._log().agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(seq, op, topic_id, name, created_at, max_age_secs, max_bytes)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def list(self) -> DataFrame:
        last = self._log().withColumn("_n", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("seq").desc())))
        return last.where("_n = 1 AND op = 'put'").select("topic_id", "name", "created_at", "max_age_secs", "max_bytes")

    def get(self, name: str):
        return self.list().where(F.col("name") == name).first()

    def create(self, name: str, topic_id: int | None = None, created_at: int = 0, max_age_secs: int | None = None, max_bytes: int | None = None) -> int:
        """A new topic; with a given id it replaces what holds that name or id. 0 as a limit means none."""
        if not NAME.match(name):
            raise ValueError(f"not a topic name: {name!r}")
        held = self.get(name)
        if topic_id is None:
            if held:
                raise ValueError(f"topic exists: {name}")
            topic_id = (self._log().agg(F.max("topic_id")).first()[0] or 0) + 1
        elif held and held.topic_id != topic_id:
            self.delete(name)
        self._put("put", topic_id, name, created_at, max_age_secs or None, max_bytes or None)
        return topic_id

    def delete(self, name: str) -> None:
        held = self.get(name)
        if held is None:
            raise KeyError(name)
        self._put("delete", held.topic_id, name)

    def set_retention(self, name: str, max_age_secs: int, max_bytes: int) -> None:
        held = self.get(name)
        if held is None:
            raise KeyError(name)
        self._put("put", held.topic_id, name, held.created_at, max_age_secs or None, max_bytes or None)

"""Registration of queries beside their DuckDB SQL, and the inputs derived from events, as the SQL derives them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import log as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW_NS = 1_706_745_600_000_000_000  # 2024-02-01
DAY_NS = 86_400_000_000_000
START_NS, END_NS = 1_704_844_800_000_000_000, 1_705_276_800_000_000_000  # 10 to 15 January 2024
HOUR_NS = 3_600_000_000_000

LOG = """WITH RECURSIVE log AS (
  SELECT event_type AS topic, dense_rank() OVER (ORDER BY event_type) AS topic_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS record_index,
         event_id, user_id, value, epoch_us(ts) * 1000 AS ts_ns, coalesce(props, '') AS payload, 5 + octet_length(encode(coalesce(props, ''))) AS total_size,
         CAST(coalesce(sum(5 + octet_length(encode(coalesce(props, '')))) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
  FROM events), seg0 AS (
  SELECT topic, topic_id, record_index // 250 AS seg, min(record_index) AS start_index, max(record_index) AS end_index, min(ts_ns) AS start_ns, max(ts_ns) AS last_ns, CAST(sum(total_size) AS BIGINT) AS size_bytes, count(*) AS records
  FROM log GROUP BY ALL), seg AS (
  SELECT *, seg = max(seg) OVER (PARTITION BY topic) AS is_active, CASE WHEN seg <> max(seg) OVER (PARTITION BY topic) THEN last_ns END AS end_ns FROM seg0), ends AS (
  SELECT topic, topic_id, CAST(sum(total_size) AS BIGINT) AS end_offset, count(*) AS records FROM log GROUP BY ALL), tidx AS (
  SELECT topic, record_index, ts_ns, byte_offset FROM (SELECT *, lag(ts_ns // 3600000000000) OVER (PARTITION BY topic ORDER BY record_index) AS p FROM log) WHERE p IS NULL OR p <> ts_ns // 3600000000000), probe AS (
  SELECT topic, ts_ns + 600000000000 AS t FROM log WHERE record_index % 40 = 0 UNION SELECT topic, ts_ns AS t FROM tidx WHERE record_index % 30 = 0), lat AS (
  SELECT event_id, event_type AS topic, user_id, CAST(floor(value * 1000 + 0.5) AS BIGINT) AS us FROM events), commits AS (
  SELECT topic, topic_id, user_id % 5 AS consumer_id, row_number() OVER (PARTITION BY topic, user_id % 5 ORDER BY event_id) AS commit_seq,
         CASE WHEN record_index % 70 = 0 THEN byte_offset // 2 ELSE byte_offset END AS off FROM log WHERE record_index % 10 = 0), msgs AS (
  SELECT user_id % 4 AS run_id, event_id AS seq, event_id + CASE WHEN event_id % 50 = 0 THEN 7 ELSE 0 END AS arrival, 0 AS copy FROM events WHERE event_id % 97 <> 0
  UNION ALL SELECT user_id % 4, event_id, event_id + 20, 1 FROM events WHERE event_id % 101 = 0 AND event_id % 97 <> 0), exp AS (
  SELECT *, coalesce(max(seq) OVER (ORDER BY arrival, seq, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, seq) AS expected FROM msgs)
"""


def query(name: str, sql: str | None, log: bool = True):
    """Register a query with its SQL; `log`: the SQL stands on the log view."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (LOG if log else "") + sql
        return f

    return put


def plain(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame], log: bool = True) -> None:
    """A query of the log records alone."""
    query(name, sql, log)(lambda spark, d: f(L.log_records(spark, d)))



# ---- the inputs derived from events, as LOG derives them
def hour_index(r: DataFrame) -> DataFrame:
    return L.time_index(r, HOUR_NS)


def probes(r: DataFrame) -> DataFrame:
    return r.where("record_index % 40 = 0").select("topic", (F.col("ts_ns") + 600_000_000_000).alias("t")).union(hour_index(r).where("record_index % 30 = 0").select("topic", F.col("ts_ns").alias("t"))).distinct()


def latencies(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "events").select("event_id", F.col("event_type").alias("topic"), "user_id", F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("us"))


def commits(r: DataFrame) -> DataFrame:
    off = F.when(F.col("record_index") % 70 == 0, F.expr("byte_offset div 2")).otherwise(F.col("byte_offset"))
    rows = r.where("record_index % 10 = 0").select("topic", "topic_id", (F.col("user_id") % 5).alias("consumer_id"), "event_id", off.alias("off"))
    return rows.withColumn("commit_seq", F.row_number().over(Window.partitionBy("topic", "consumer_id").orderBy("event_id")).cast("long")).drop("event_id")


def messages(spark: SparkSession, d: str) -> DataFrame:
    e = L.table(spark, d, "events").where("event_id % 97 <> 0")
    first = e.select((F.col("user_id") % 4).alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") + F.when(F.col("event_id") % 50 == 0, 7).otherwise(0)).alias("arrival"), F.lit(0).alias("copy"))
    return first.union(e.where("event_id % 101 = 0").select(F.col("user_id") % 4, "event_id", F.col("event_id") + 20, F.lit(1)))


def expected_seq(m: DataFrame, block: int = 1 << 20) -> DataFrame:
    """seq with the one expected: one past the largest before. Two levels of running maxima, by blocks of arrival."""
    m = m.withColumn("blk", F.expr(f"arrival div {block}"))
    before = m.groupBy("blk").agg(F.max("seq").alias("top")).withColumn("base", F.max("top").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    inside = F.max("seq").over(Window.partitionBy("blk").orderBy("arrival", "seq", "copy").rowsBetween(Window.unboundedPreceding, -1))
    return m.withColumn("top", inside).join(F.broadcast(before), "blk").withColumn("expected", F.coalesce(F.greatest("top", "base") + 1, F.col("seq"))).drop("blk", "top", "base")


def millis() -> Column:
    """The millisecond of a record."""
    return F.expr("ts_ns div 1000000")


def segments_of(r: DataFrame) -> DataFrame:
    return L.segments(r)

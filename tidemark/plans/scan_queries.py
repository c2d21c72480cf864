"""Scans, filters and seeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log as L
from ..operators import scans
from .base import END_NS, HOUR_NS, START_NS, hour_index, plain, probes, query

plain("topic_scan", "SELECT topic, topic_id, record_index, event_id, ts_ns, total_size, byte_offset FROM log", lambda r: r.select("topic", "topic_id", "record_index", "event_id", "ts_ns", "total_size", "byte_offset"))
plain("record_sizes", "SELECT event_id, total_size, octet_length(encode(payload)) AS payload_size FROM log", lambda r: r.select("event_id", "total_size", F.octet_length("payload").cast("long").alias("payload_size")))
query("line_batches", "SELECT event_id // 100 AS batch, count(*) AS lines, CAST(sum(octet_length(encode(coalesce(props, '')))) AS BIGINT) AS bytes FROM events GROUP BY ALL", log=False)(
    lambda s, d: L.table(s, d, "events").groupBy(F.expr("event_id div 100").alias("batch")).agg(F.count("*").alias("lines"), F.sum(F.octet_length(F.coalesce("props", F.lit("")))).alias("bytes"))
)
plain("fetch_bytes", "SELECT topic, record_index, greatest(5000 - byte_offset, 0) AS skip, least(byte_offset + total_size, 13192) - greatest(byte_offset, 5000) AS length FROM log WHERE byte_offset + total_size > 5000 AND byte_offset < 13192", lambda r: scans.fetch_bytes(r, 5000, 8192))
plain("fetch_records", "SELECT topic, record_index, byte_offset, total_size FROM log WHERE byte_offset >= 5000 AND byte_offset + total_size <= 13192", lambda r: scans.fetch_records(r, 5000, 8192).select("topic", "record_index", "byte_offset", "total_size"))
plain("topic_end_offset", "SELECT topic, end_offset FROM ends", scans.end_offsets)
_REQUESTS = [("click", None), ("click", 0), ("view", 10**12), ("nowhere", 0), ("purchase", 64), ("nowhere", 5)]
_REQ_SQL = "req AS (SELECT * FROM (VALUES ('click', NULL), ('click', 0), ('view', 1000000000000), ('nowhere', 0), ('purchase', 64), ('nowhere', 5)) v(topic, start))"


def _requests(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_REQUESTS, "topic string, start long")


query("fetch_status", f", {_REQ_SQL} SELECT r.topic, CAST(r.start AS BIGINT) AS start, CASE WHEN start IS NULL THEN 'TAIL' WHEN start > coalesce(end_offset, 0) THEN 'CATCHING_UP' WHEN start = coalesce(end_offset, 0) THEN 'EMPTY' ELSE 'RESPONSE' END AS status, CAST(CASE WHEN start IS NULL OR start > coalesce(end_offset, 0) THEN coalesce(end_offset, 0) ELSE start END AS BIGINT) AS next_offset FROM req r LEFT JOIN ends e ON r.topic = e.topic")(
    lambda s, d: scans.fetch_status(_requests(s), scans.end_offsets(L.log_records(s, d)))
)
query("seek_end", "SELECT topic, end_offset AS next_offset, 0 AS bytes FROM ends")(lambda s, d: scans.end_offsets(L.log_records(s, d)).select("topic", F.col("end_offset").alias("next_offset"), F.lit(0).cast("int").alias("bytes")))
plain("sparse_index", "SELECT topic, record_index, (ts_ns // 1000000) * 1048576 AS hlc, ts_ns, byte_offset FROM log WHERE record_index % 64 = 0", lambda r: L.sparse_index(r, 64))
plain("seek_record", "SELECT l.topic, l.record_index AS r, i.byte_offset FROM log l JOIN log i ON i.topic = l.topic AND i.record_index = l.record_index // 64 * 64", lambda r: scans.seek_record(L.sparse_index(r, 64), r.select("topic", F.col("record_index").alias("r")), 64))
plain("sparse_search", "SELECT p.topic, p.t AS x, CAST(count(i.ts_ns) FILTER (WHERE i.ts_ns < p.t) AS BIGINT) AS rank, coalesce(bool_or(i.ts_ns = p.t), FALSE) AS exact FROM probe p LEFT JOIN log i ON i.topic = p.topic AND i.record_index % 64 = 0 GROUP BY p.topic, p.t", lambda r: scans.search(L.sparse_index(r, 64), probes(r).select("topic", F.col("t").alias("x")), "ts_ns"))
plain("time_index", "SELECT topic, record_index, ts_ns, byte_offset FROM tidx", hour_index)
plain("time_index_default", "SELECT topic, record_index, ts_ns, byte_offset FROM (SELECT *, lag(ts_ns // 10000000) OVER (PARTITION BY topic ORDER BY record_index) AS p FROM log) WHERE p IS NULL OR p <> ts_ns // 10000000", L.time_index)


@query("time_range", f"SELECT event_id, event_type AS topic, epoch_us(ts) * 1000 AS ts_ns, value FROM events WHERE epoch_us(ts) * 1000 BETWEEN {START_NS} AND {END_NS}", log=False)
def _time_range(s: SparkSession, d: str) -> DataFrame:
    return L.time_filtered(s, d, START_NS, END_NS).select("event_id", F.col("event_type").alias("topic"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), "value")


plain("time_range_jitter", f"SELECT topic, record_index, ts_ns, byte_offset FROM tidx WHERE ts_ns BETWEEN {START_NS} AND {END_NS}", lambda r: hour_index(r).where(F.col("ts_ns").between(START_NS - 10_000_000, END_NS + 10_000_000)).where(F.col("ts_ns").between(START_NS, END_NS)))
plain("nearest", "SELECT p.topic, p.t, arg_min(i.ts_ns, abs(i.ts_ns - p.t)::HUGEINT * 4 + (i.ts_ns > p.t)::INT) AS nearest_ns FROM probe p JOIN tidx i ON i.topic = p.topic GROUP BY p.topic, p.t", lambda r: scans.nearest(hour_index(r), probes(r)))
plain("exists_in_window", f"SELECT p.topic, p.t, coalesce(bool_or(i.ts_ns IS NOT NULL), FALSE) AS found FROM probe p LEFT JOIN tidx i ON i.topic = p.topic AND i.ts_ns BETWEEN p.t - {HOUR_NS} AND p.t + {HOUR_NS} GROUP BY p.topic, p.t", lambda r: (p := probes(r)).join(scans.in_window(hour_index(r), p, HOUR_NS).select("topic", "t", F.lit(True).alias("f")).distinct(), ["topic", "t"], "left").select("topic", "t", F.coalesce("f", F.lit(False)).alias("found")))
plain(
    "point_in_time",
    f", a AS (SELECT p.topic, p.t, count(i.ts_ns) FILTER (WHERE i.ts_ns BETWEEN p.t - {HOUR_NS} AND p.t + {HOUR_NS}) AS entries, coalesce(bool_or(i.ts_ns = p.t), FALSE) AS exact, max(i.ts_ns) FILTER (WHERE i.ts_ns < p.t - {HOUR_NS}) AS b, min(i.ts_ns) FILTER (WHERE i.ts_ns > p.t + {HOUR_NS}) AS f FROM probe p LEFT JOIN tidx i ON i.topic = p.topic GROUP BY p.topic, p.t) SELECT topic, t, entries, exact, CASE WHEN NOT exact THEN b END AS before_ns, CASE WHEN NOT exact THEN f END AS after_ns FROM a",
    lambda r: scans.point_in_time(hour_index(r), probes(r), HOUR_NS),
)
plain("index_summary", "SELECT topic, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, arg_max(byte_offset, record_index) AS last_offset, count(*) AS entries FROM tidx GROUP BY topic", lambda r: hour_index(r).groupBy("topic").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.max_by("byte_offset", "record_index").alias("last_offset"), F.count("*").alias("entries")))
plain("dump_records", "SELECT topic, byte_offset, total_size, total_size - 5 AS payload_size FROM log ORDER BY topic, byte_offset LIMIT 20", lambda r: r.orderBy("topic", "byte_offset").limit(20).select("topic", "byte_offset", "total_size", (F.col("total_size") - 5).alias("payload_size")))
query("record_type_counts", "SELECT CASE b WHEN 1 THEN 'Data' WHEN 2 THEN 'Tombstone' WHEN 3 THEN 'Transaction' WHEN 4 THEN 'Checkpoint' WHEN 5 THEN 'Schema' WHEN 16 THEN 'Compressed' ELSE CASE WHEN b BETWEEN 128 AND 254 THEN 'UserDefined' ELSE 'Unknown' END END AS record_type, count(*) AS records FROM (SELECT event_id % 256 AS b FROM events) GROUP BY 1", log=False)(
    lambda s, d: L.table(s, d, "events").groupBy(scans.type_name(F.col("event_id") % 256).alias("record_type")).agg(F.count("*").alias("records"))
)
query("topic_lookup", "SELECT topic, topic_id FROM ends WHERE topic = 'click' OR topic_id = 2")(lambda s, d: L.topics(s, d).where("topic = 'click' OR topic_id = 2"))
query("valid_topic_names", "SELECT DISTINCT name, regexp_matches(name, '^[A-Za-z0-9-]+\\z') AS valid FROM (SELECT event_type AS name FROM events UNION SELECT c_name FROM customer UNION SELECT '')", log=False)(
    lambda s, d: L.table(s, d, "events").select(F.col("event_type").alias("name")).union(L.table(s, d, "customer").select("c_name")).union(s.sql("SELECT ''")).distinct().withColumn("valid", scans.valid_topic_name(F.col("name")))
)
query("topic_identity", "SELECT v.topic, v.epoch, CASE WHEN e.topic_id IS NULL THEN 'unknown' WHEN e.topic_id <> v.epoch THEN 'stale' ELSE 'ok' END AS identity FROM (VALUES ('click', 1), ('click', 7), ('none', 1)) v(topic, epoch) LEFT JOIN ends e ON v.topic = e.topic")(
    lambda s, d: s.createDataFrame([("click", 1), ("click", 7), ("none", 1)], "topic string, epoch int").join(L.topics(s, d), "topic", "left").select("topic", "epoch", F.when(F.col("topic_id").isNull(), "unknown").when(F.col("topic_id") != F.col("epoch"), "stale").otherwise("ok").alias("identity"))
)

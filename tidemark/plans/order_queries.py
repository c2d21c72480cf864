"""Clocks and total order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .base import DAY_NS, millis, plain

plain("hlc_pack", "SELECT event_id, (ts_ns // 1000000) * 1048576 + event_id % 1048576 AS hlc, ts_ns // 1000000 AS ms, event_id % 1048576 AS logical FROM log", lambda r: r.select("event_id", S.hlc(millis(), F.col("event_id") % 1048576).alias("hlc")).select("event_id", "hlc", S.hlc_ms(F.col("hlc")).alias("ms"), S.hlc_logical(F.col("hlc")).alias("logical")))
plain("hlc_sequence", ", m AS (SELECT topic, record_index, max(ts_ns // 86400000000000) OVER (PARTITION BY topic ORDER BY record_index) AS ms FROM log) SELECT topic, record_index, ms, row_number() OVER (PARTITION BY topic, ms ORDER BY record_index) - 1 AS logical FROM m", lambda r: r.withColumn("ms", F.max(F.expr(f"ts_ns div {DAY_NS}")).over(Window.partitionBy("topic").orderBy("record_index"))).select("topic", "record_index", "ms", (F.row_number().over(Window.partitionBy("topic", "ms").orderBy("record_index")) - 1).cast("long").alias("logical")))
plain(
    "hlc_merge",
    ", m AS (SELECT event_id, ts_ns // 1000000 AS w, ts_ns // 1000000 - 2 + event_id % 5 AS lm, event_id % 7 AS ll, ts_ns // 1000000 - 2 + event_id % 3 * 2 AS rm, CASE WHEN event_id % 11 = 0 THEN 1048575 ELSE event_id % 9 END AS rl FROM log) SELECT event_id, CASE WHEN w > lm AND w > rm THEN w ELSE greatest(lm, rm) END * 1048576 + least(CASE WHEN w > lm AND w > rm THEN 0 WHEN lm > rm THEN ll + 1 WHEN rm > lm THEN rl + 1 ELSE greatest(ll, rl) + 1 END, 1048575) AS hlc FROM m",
    lambda r: r.select("event_id", S.hlc_receive(millis(), S.hlc(millis() - 2 + F.col("event_id") % 5, F.col("event_id") % 7), S.hlc(millis() - 2 + F.col("event_id") % 3 * 2, F.when(F.col("event_id") % 11 == 0, F.lit(1048575)).otherwise(F.col("event_id") % 9))).alias("hlc")),
)
plain("clock_health", "SELECT event_id, CASE WHEN abs(d) > 1000 THEN 'critical' WHEN abs(d) > 100 THEN 'degraded' ELSE 'healthy' END AS health FROM (SELECT event_id, event_id % 3000 - 1500 AS d FROM log)", lambda r: r.select("event_id", S.clock_health(F.col("event_id") % 3000 - 1500).alias("health")))
plain("total_order", "SELECT event_id, row_number() OVER (PARTITION BY topic ORDER BY ts_ns // 86400000000000, user_id % 3, event_id) AS place FROM log", lambda r: r.select("event_id", F.row_number().over(Window.partitionBy("topic").orderBy(F.expr(f"ts_ns div {DAY_NS}"), F.col("user_id") % 3, "event_id")).cast("long").alias("place")))
plain("sort_key", "SELECT event_id, (ts_ns // 1000000) * 1048576 AS hlc, CAST(0 AS INTEGER) AS node_id, record_index AS sequence FROM log", lambda r: r.select("event_id", S.hlc(millis(), F.lit(0)).alias("hlc"), F.lit(0).alias("node_id"), F.col("record_index").alias("sequence")))
plain("fencing", "SELECT event_id, (user_id % 5 > 2 OR (user_id % 5 = 2 AND user_id % 3 >= 1)) AS accepted FROM log", lambda r: r.select("event_id", (F.struct(F.col("user_id") % 5, F.col("user_id") % 3) >= F.struct(F.lit(2).cast("long"), F.lit(1).cast("long"))).alias("accepted")))

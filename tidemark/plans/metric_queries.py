"""Histograms, percentiles, rates and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import log as L
from .base import latencies, millis, plain, query

BOUNDS = [100, 500, 1_000, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 5_000_000, 10_000_000]
_BOUNDS_SQL = f"bounds AS (SELECT unnest({BOUNDS}::BIGINT[]) AS bound)"


def _bucket(us: Column) -> Column:
    bound = F.lit(None).cast("long")
    for b in BOUNDS:
        bound = F.coalesce(bound, F.when(us <= b, F.lit(b).cast("long")))
    return bound


def _histogram(s: SparkSession, d: str) -> DataFrame:
    return latencies(s, d).groupBy("topic", _bucket(F.col("us")).alias("bound")).agg(F.count("*").alias("n"), F.max("us").alias("largest"))


_HIST = f", {_BOUNDS_SQL}, hist AS (SELECT topic, (SELECT min(bound) FROM bounds WHERE bound >= us) AS bound, us FROM lat), hs AS (SELECT topic, bound, count(*) AS n, max(us) AS largest FROM hist GROUP BY ALL)"
query("latency_histogram", _HIST + " SELECT topic, bound, n FROM hs")(lambda s, d: _histogram(s, d).select("topic", "bound", "n"))


def _percentiles(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("topic").orderBy(F.col("bound").asc_nulls_last())
    h = _histogram(s, d).withColumns({"cum": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy("topic"))})
    p = h.withColumn("p", F.explode(F.array(F.lit(50), F.lit(95), F.lit(99)))).where(F.col("cum") >= F.ceil(F.col("p") * F.col("total") / 100))
    return p.groupBy("topic", "p").agg(F.min_by(F.coalesce("bound", "largest"), "cum").alias("us"))


query("histogram_percentiles", _HIST + ", c AS (SELECT *, sum(n) OVER (PARTITION BY topic ORDER BY bound NULLS LAST) AS cum, sum(n) OVER (PARTITION BY topic) AS total FROM hs) SELECT topic, p, arg_min(coalesce(bound, largest), cum) AS us FROM c, (VALUES (50), (95), (99)) v(p) WHERE cum >= ceil(p * total / 100.0) GROUP BY topic, p")(_percentiles)
query("latency_avg", "SELECT topic, round(coalesce(CAST(sum(us) AS DOUBLE) / count(*), 0.0), 6) AS mean_us FROM lat GROUP BY topic")(lambda s, d: latencies(s, d).groupBy("topic").agg(F.round(F.coalesce(F.sum("us").cast("double") / F.count("*"), F.lit(0.0)), 6).alias("mean_us")))
query("sample_percentiles", ", r AS (SELECT topic, us, row_number() OVER (PARTITION BY topic ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY topic) AS n FROM lat) SELECT topic, p, us FROM r, (VALUES (50), (99)) v(p) WHERE i = CAST(floor(p / 100.0::DOUBLE * (n - 1) + 0.5) AS BIGINT)")(
    lambda s, d: latencies(s, d).withColumns({"i": F.row_number().over(Window.partitionBy("topic").orderBy("us")) - 1, "n": F.count("*").over(Window.partitionBy("topic"))}).withColumn("p", F.explode(F.array(F.lit(50), F.lit(99)))).where(F.col("i") == F.floor(F.col("p") / F.lit(100.0) * (F.col("n") - 1) + 0.5)).select("topic", "p", "us")
)
def _w100() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-99, 0)


query("rolling_p99", ", w AS (SELECT event_id, list_sort(list(us) OVER (PARTITION BY user_id ORDER BY event_id ROWS 99 PRECEDING)) AS a FROM lat) SELECT event_id, a[CAST(ceil(0.99::DOUBLE * len(a)) AS BIGINT)] AS p99 FROM w")(lambda s, d: latencies(s, d).withColumn("a", F.array_sort(F.collect_list("us").over(_w100()))).select("event_id", F.element_at("a", F.ceil(F.lit(0.99) * F.size("a")).cast("int")).alias("p99")))
query("rolling_mean", "SELECT event_id, round(CAST(sum(us) OVER w AS DOUBLE) / count(*) OVER w, 6) AS mean FROM lat WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 99 PRECEDING)")(lambda s, d: latencies(s, d).select("event_id", F.round(F.sum("us").over(_w100()).cast("double") / F.count("*").over(_w100()), 6).alias("mean")))
plain("rates", "SELECT topic, record_index, CASE WHEN dm > 0 THEN greatest(byte_offset - pv, 0) * 1000000 // dm // 1000 END AS rate FROM (SELECT *, lag(byte_offset) OVER o AS pv, ts_ns // 1000000 - lag(ts_ns // 1000000) OVER o AS dm FROM log WINDOW o AS (PARTITION BY topic ORDER BY record_index))", lambda r: r.withColumns({"pv": F.lag("byte_offset").over(Window.partitionBy("topic").orderBy("record_index")), "dm": millis() - F.lag(millis()).over(Window.partitionBy("topic").orderBy("record_index"))}).select("topic", "record_index", F.expr("CASE WHEN dm > 0 THEN greatest(byte_offset - pv, 0L) * 1000000 div dm div 1000 END").alias("rate")))
query("errors_by_type", "SELECT event_type AS error, count(*) AS n FROM events WHERE value > 50 GROUP BY ROLLUP (event_type)", log=False)(lambda s, d: L.table(s, d, "events").where("value > 50").rollup(F.col("event_type").alias("error")).agg(F.count("*").alias("n")))
query("saturation", "SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 0.0::DOUBLE ELSE round(count(*)::DOUBLE / (user_id % 10), 6) END AS ratio FROM events GROUP BY user_id", log=False)(lambda s, d: L.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(F.round(F.col("n").cast("double") / F.greatest(F.col("user_id") % 10, F.lit(1)), 6)).alias("ratio")))
query("golden_flags", "SELECT event_id, us > 100000 OR event_id % 100 > 70 AS warning, us > 1000000 OR event_id % 100 > 90 AS critical FROM lat")(lambda s, d: latencies(s, d).select("event_id", ((F.col("us") > 100_000) | (F.col("event_id") % 100 > 70)).alias("warning"), ((F.col("us") > 1_000_000) | (F.col("event_id") % 100 > 90)).alias("critical")))
query("sampled_latency", "SELECT event_id, us FROM lat WHERE event_id % 16 = 0")(lambda s, d: latencies(s, d).where("event_id % 16 = 0").select("event_id", "us"))
plain("consume_summary", "SELECT topic, CAST(sum(total_size) AS BIGINT) AS bytes, count(*) AS records, count(DISTINCT byte_offset // 4096) AS fetches, max(byte_offset + total_size) AS final_offset FROM log GROUP BY topic", lambda r: r.groupBy("topic").agg(F.sum("total_size").alias("bytes"), F.count("*").alias("records"), F.countDistinct(F.expr("byte_offset div 4096")).alias("fetches"), F.max(F.col("byte_offset") + F.col("total_size")).alias("final_offset")))
query("throughput_band", "SELECT event_id, CASE WHEN r < 1000 THEN 'CRITICAL' WHEN r < 10000 THEN 'LOW' WHEN r < 50000 THEN 'MODERATE' WHEN r < 100000 THEN 'GOOD' WHEN r < 500000 THEN 'EXCELLENT' WHEN r < 1000000 THEN 'OUTSTANDING' ELSE 'WORLD-CLASS' END AS band FROM (SELECT event_id, event_id * 997 % 1500000 AS r FROM events)", log=False)(lambda s, d: L.table(s, d, "events").select("event_id", S.throughput_band(F.col("event_id") * 997 % 1500000).alias("band")))
query("rate_5m", "SELECT event_type AS topic, epoch_us(b) AS window_us, round(count(*) / 300.0::DOUBLE, 9) AS rate FROM (SELECT event_type, ts, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS b FROM events, (SELECT unnest(range(5))::BIGINT AS k)) GROUP BY ALL", log=False)(lambda s, d: L.table(s, d, "events").groupBy(F.col("event_type").alias("topic"), F.window(F.col("ts").cast("timestamp"), "5 minutes", "1 minute").alias("w")).agg(F.count("*").alias("n")).select("topic", F.unix_micros("w.start").alias("window_us"), F.round(F.col("n") / F.lit(300.0), 9).alias("rate")))


def _buckets(s: SparkSession, d: str) -> DataFrame:
    """Every bucket of every topic, the empty ones too; a null bound is the overflow."""
    bounds = F.explode(F.array(*[F.lit(b).cast("long") for b in BOUNDS], F.lit(None).cast("long")))
    h = _histogram(s, d).select("topic", "bound", "n")
    every = L.topics(s, d).select("topic", bounds.alias("b"))
    return every.join(h.withColumnRenamed("topic", "t"), (F.col("topic") == F.col("t")) & F.col("b").eqNullSafe(F.col("bound")), "left").select("topic", F.col("b").alias("bound"), F.coalesce("n", F.lit(0)).alias("n"))


query("histogram_buckets", _HIST + ", every AS (SELECT topic, bound FROM ends, (SELECT bound FROM bounds UNION ALL SELECT NULL)) SELECT e.topic, e.bound, coalesce(h.n, 0) AS n FROM every e LEFT JOIN hs h ON h.topic = e.topic AND h.bound IS NOT DISTINCT FROM e.bound")(_buckets)
query("histogram_stats", "SELECT topic, count(*) AS n, CAST(sum(us) AS BIGINT) AS sum_us, min(us) AS min_us, max(us) AS max_us FROM lat GROUP BY topic")(
    lambda s, d: latencies(s, d).groupBy("topic").agg(F.count("*").alias("n"), F.sum("us").alias("sum_us"), F.min("us").alias("min_us"), F.max("us").alias("max_us"))
)
plain(
    "counter_snapshot",
    "SELECT 'log_records_total{topic=\"' || topic || '\"} ' || count(*) AS line FROM log GROUP BY topic UNION ALL SELECT 'log_bytes_total{topic=\"' || topic || '\"} ' || CAST(sum(total_size) AS BIGINT) FROM log GROUP BY topic",
    lambda r: r.groupBy("topic").agg(F.count("*").alias("log_records_total"), F.sum("total_size").alias("log_bytes_total")).unpivot("topic", ["log_records_total", "log_bytes_total"], "name", "value").select(F.concat("name", F.lit('{topic="'), "topic", F.lit('"} '), "value").alias("line")),
)
query(
    "bench_gates",
    ", r AS (SELECT topic, us, row_number() OVER (PARTITION BY topic ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY topic) AS n FROM lat), p AS (SELECT topic, max(us) FILTER (WHERE i = CAST(floor(0.5::DOUBLE * (n - 1) + 0.5) AS BIGINT)) AS p50, max(us) FILTER (WHERE i = CAST(floor(0.99::DOUBLE * (n - 1) + 0.5) AS BIGINT)) AS p99 FROM r GROUP BY topic) SELECT topic, p50, p99, p50 <= 60000 AND p99 <= 90000 AS passed FROM p",
)(
    lambda s, d: latencies(s, d).withColumns({"i": F.row_number().over(Window.partitionBy("topic").orderBy("us")) - 1, "n": F.count("*").over(Window.partitionBy("topic"))}).groupBy("topic").agg(*[F.max(F.when(F.col("i") == F.floor(F.lit(q) * (F.col("n") - 1) + 0.5), F.col("us"))).alias(name) for q, name in ((0.5, "p50"), (0.99, "p99"))]).withColumn("passed", (F.col("p50") <= 60_000) & (F.col("p99") <= 90_000))
)

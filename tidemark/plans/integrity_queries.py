"""Integrity of sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import log as L
from ..operators.fold import fold
from .base import expected_seq, messages, plain, query

query("seq_gaps", "SELECT seq, expected, seq - expected AS gap FROM exp WHERE seq > expected")(lambda s, d: expected_seq(messages(s, d)).where("seq > expected").select("seq", "expected", (F.col("seq") - F.col("expected")).alias("gap")))
query("seq_duplicates", "SELECT seq, expected, CASE WHEN seq + 1 = expected THEN 'replay' ELSE 'duplicate' END AS kind FROM exp WHERE seq < expected")(lambda s, d: expected_seq(messages(s, d)).where("seq < expected").select("seq", "expected", F.when(F.col("seq") + 1 == F.col("expected"), "replay").otherwise("duplicate").alias("kind")))
query("run_filter", "SELECT seq, arrival FROM msgs WHERE run_id = 2")(lambda s, d: messages(s, d).where("run_id = 2").select("seq", "arrival"))


def _report(m: DataFrame, *keys: str) -> DataFrame:
    dup = (F.col("seq") < F.col("expected")) & (F.col("seq") + 1 != F.col("expected"))
    out = m.groupBy(*keys).agg(F.count("*").alias("consumed"), F.sum(F.greatest(F.col("seq") - F.col("expected"), F.lit(0))).cast("long").alias("gaps"), F.count_if(dup).alias("duplicates"))
    return out.withColumn("passed", (F.col("consumed") > 0) & (F.col("gaps") == 0) & (F.col("duplicates") == 0))


_REPORT = "count(*) AS consumed, CAST(sum(greatest(seq - expected, 0)) AS BIGINT) AS gaps, count(*) FILTER (WHERE seq < expected AND seq + 1 <> expected) AS duplicates, sum(greatest(seq - expected, 0)) = 0 AND count(*) FILTER (WHERE seq < expected AND seq + 1 <> expected) = 0 AS passed FROM exp"
query("integrity_report", f"SELECT {_REPORT}")(lambda s, d: _report(expected_seq(messages(s, d))))
query("integrity_rollup", f"SELECT run_id, {_REPORT} GROUP BY ROLLUP (run_id)")(lambda s, d: (e := expected_seq(messages(s, d))) and _report(e, "run_id").unionByName(_report(e).withColumn("run_id", F.lit(None).cast("long"))))
query("gap_analysis", "SELECT event_id, greatest(l - f, 0) AS gap_bytes, greatest(l - f, 0) // 1048576 AS segments, greatest(l - f, 0) > 268435456 AS bulk FROM (SELECT event_id, event_id * 100003 % 900000000 AS l, event_id * 77 AS f FROM events)", log=False)(
    lambda s, d: L.table(s, d, "events").select("event_id", F.expr("greatest(event_id * 100003 % 900000000 - event_id * 77, 0)").alias("gap_bytes")).select("event_id", "gap_bytes", F.expr("gap_bytes div 1048576").alias("segments"), (F.col("gap_bytes") > 268435456).alias("bulk"))
)


def _ewma(rows: pd.DataFrame, state: dict | None = None) -> pd.DataFrame:
    state = {} if state is None else state
    rate, out = state.get("rate", 0.0), []
    for size, secs in zip(rows["total_size"], rows["secs"], strict=True):
        if secs > 0:
            rate = 0.3 * (size / secs) + 0.7 * rate
        out.append(rate)
    state["rate"] = rate
    return rows[["topic", "record_index"]].assign(rate=[round(x, 6) for x in out])


plain(
    "ewma_rate",
    ", e(topic, record_index, rate) AS (SELECT topic, record_index, CASE WHEN record_index % 4 > 0 THEN 0.3::DOUBLE * (total_size::DOUBLE / (record_index % 4)) ELSE 0::DOUBLE END FROM log WHERE record_index = 0 UNION ALL SELECT l.topic, l.record_index, CASE WHEN l.record_index % 4 > 0 THEN 0.3::DOUBLE * (l.total_size::DOUBLE / (l.record_index % 4)::DOUBLE) + 0.7::DOUBLE * e.rate ELSE e.rate END FROM e JOIN log l ON l.topic = e.topic AND l.record_index = e.record_index + 1) SELECT topic, record_index, round(rate, 6) AS rate FROM e",
    lambda r: fold(r.select("topic", "record_index", "total_size", (F.col("record_index") % 4).alias("secs")), ["topic"], ["record_index"], "topic string, record_index long, rate double", _ewma),
)

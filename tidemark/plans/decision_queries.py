"""Backpressure, quorums, health and scheduling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import log as L
from ..operators.fold import fold
from .base import DAY_NS, commits, latencies, millis, plain, query

_BP = "CASE WHEN q >= 5000 OR io >= 500 OR m >= 90 THEN 'Critical' ELSE CASE WHEN s = 0 THEN 'None' WHEN s <= 2 THEN 'Light' WHEN s <= 4 THEN 'Moderate' WHEN s <= 6 THEN 'Heavy' ELSE 'Critical' END END"
query(
    "backpressure_level",
    f"WITH a AS (SELECT event_id, event_id * 31 % 6000 AS q, event_id * 17 % 600 AS io, event_id * 7 % 100 AS m FROM events), b AS (SELECT *, CASE WHEN q >= 2500 THEN 3 WHEN q >= 1000 THEN 2 ELSE 0 END + CASE WHEN io >= 250 THEN 3 WHEN io >= 100 THEN 2 ELSE 0 END + CASE WHEN m >= 80 THEN 3 WHEN m >= 70 THEN 2 ELSE 0 END AS s FROM a), c AS (SELECT event_id, {_BP} AS level FROM b) SELECT event_id, level, CASE level WHEN 'Light' THEN 1.5 WHEN 'Moderate' THEN 2 WHEN 'Heavy' THEN 4 WHEN 'Critical' THEN 10 ELSE 1 END::DOUBLE AS delay, level <> 'Critical' AS accepts FROM c",
    log=False,
)(lambda s, d: L.table(s, d, "events").select("event_id", S.backpressure(F.col("event_id") * 31 % 6000, F.col("event_id") * 17 % 600, F.col("event_id") * 7 % 100).alias("level")).select("event_id", "level", S.delay_multiplier(F.col("level")).alias("delay"), (F.col("level") != "Critical").alias("accepts")))
query("quorum_math", "SELECT DISTINCT s_suppkey % 9 + 1 AS nodes, (s_suppkey % 9 + 1) // 2 + 1 AS quorum, (s_suppkey % 9 + 1) - ((s_suppkey % 9 + 1) // 2 + 1) AS tolerated FROM supplier", log=False)(lambda s, d: L.table(s, d, "supplier").select((F.col("s_suppkey") % 9 + 1).alias("nodes")).distinct().select("nodes", F.expr("nodes div 2 + 1").alias("quorum"), F.expr("nodes - (nodes div 2 + 1)").alias("tolerated")))


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    """Of each write (an order) its first decisive answer: the second success passes, the second failure fails, else partial."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    ok = F.col("l_returnflag") != "R"
    rows = L.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum(ok.cast("int")).over(order).alias("oks"), F.sum((~ok).cast("int")).over(order).alias("fails"))
    verdict = F.when(F.col("oks") >= 2, "success").when(F.col("fails") >= 2, "failed")
    return rows.groupBy(F.col("l_orderkey").alias("write_id")).agg(F.coalesce(F.min_by(verdict, F.when(verdict.isNotNull(), F.col("l_linenumber"))), F.lit("partial")).alias("outcome"))


query("quorum_outcome", "WITH a AS (SELECT l_orderkey, l_linenumber, sum((l_returnflag <> 'R')::INT) OVER w AS oks, sum((l_returnflag = 'R')::INT) OVER w AS fails FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT l_orderkey AS write_id, coalesce(arg_min(CASE WHEN oks >= 2 THEN 'success' WHEN fails >= 2 THEN 'failed' END, l_linenumber) FILTER (WHERE oks >= 2 OR fails >= 2), 'partial') AS outcome FROM a GROUP BY 1", log=False)(_outcomes)
query("joint_quorum", "SELECT l_orderkey AS write_id, count(DISTINCT l_suppkey % 3) >= 2 AND count(DISTINCT l_partkey % 5) >= 3 AS committed FROM lineitem GROUP BY 1", log=False)(lambda s, d: L.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("write_id")).agg(((F.countDistinct(F.col("l_suppkey") % 3) >= 2) & (F.countDistinct(F.col("l_partkey") % 5) >= 3)).alias("committed")))
query("commit_index", "SELECT user_id, list_sort(list(m))[len(list(m)) - (len(list(m)) // 2 + 1) + 1] AS commit_index FROM (SELECT user_id, event_type, max(event_id) AS m FROM events GROUP BY ALL) GROUP BY user_id", log=False)(lambda s, d: L.table(s, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("m")).groupBy("user_id").agg(F.array_sort(F.collect_list("m")).alias("a")).select("user_id", F.expr("element_at(a, cast(size(a) - (size(a) div 2 + 1) + 1 as int))").alias("commit_index")))


def _follower(limit: int = 60_000, slow_most: int = 3, recover: int = 2):
    def step(rows: pd.DataFrame, at: dict | None = None) -> pd.DataFrame:
        at = {} if at is None else at
        out, (status, slow, fast) = [], at.get("at", ("healthy", 0, 0))
        for us in rows["us"]:
            fast = 0 if us > limit else fast + 1  # the run of fast ones that ends here
            if us > limit:
                slow += 1
                if slow >= slow_most and status != "evicted":
                    status = "evicted"
                elif status == "healthy":
                    status = "degraded"
            elif status == "evicted":
                if fast >= recover:
                    status, slow = "healthy", 0
            else:
                status, slow = "healthy", 0
            out.append(status)
        at["at"] = status, slow, fast
        return rows[["user_id", "event_id"]].assign(status=out)

    return step


query(
    "follower_health",
    ", o AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM lat), f(user_id, k, event_id, status, slow, fast) AS (SELECT user_id, k, event_id, CASE WHEN us > 60000 THEN 'degraded' ELSE 'healthy' END, (us > 60000)::INT, (us <= 60000)::INT FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN o.us > 60000 THEN CASE WHEN f.slow + 1 >= 3 THEN 'evicted' WHEN f.status = 'healthy' THEN 'degraded' ELSE f.status END WHEN f.status = 'evicted' THEN CASE WHEN f.fast + 1 >= 2 THEN 'healthy' ELSE 'evicted' END ELSE 'healthy' END, CASE WHEN o.us > 60000 THEN f.slow + 1 WHEN f.status = 'evicted' AND f.fast + 1 < 2 THEN f.slow ELSE 0 END, CASE WHEN o.us > 60000 THEN 0 ELSE f.fast + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) SELECT user_id, event_id, status FROM f",
)(lambda s, d: fold(latencies(s, d), ["user_id"], ["event_id"], "user_id long, event_id long, status string", _follower()))


def _circuit(failures: int = 3, successes: int = 2, reset_ms: int = DAY_NS // 1_000_000, window_ms: int = 10 * DAY_NS // 1_000_000):
    def step(rows: pd.DataFrame, at: dict | None = None) -> pd.DataFrame:
        at = {} if at is None else at
        out, (state, failed, won, opened, last) = [], at.get("at", ("closed", 0, 0, 0, 0))
        for ms, ok in zip(rows["ms"], rows["ok"], strict=True):
            if state == "open" and ms - opened >= reset_ms:
                state, won = "half_open", 0
            if state == "closed":
                if ok:
                    failed = 0
                else:
                    failed = 1 if ms - last > window_ms else failed + 1
                    if failed > 1 and failed >= failures:
                        state, opened = "open", ms
                    last = ms
            elif state == "half_open":
                won += ok
                if not ok:
                    state, opened, won = "open", ms, 0
                elif won >= successes:
                    state, failed, won = "closed", 0, 0
            out.append(state)
        at["at"] = state, failed, won, opened, last
        return rows[["user_id", "event_id"]].assign(state=out)

    return step


plain(
    "circuit_state",
    f", o AS (SELECT user_id, event_id, ts_ns // 1000000 AS ms, value < 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM log),"
    " c(user_id, k, event_id, state, failed, won, opened, last) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 'closed', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM o UNION ALL"
    " SELECT o.user_id, o.k, o.event_id, CASE WHEN h.s = 'closed' AND NOT o.ok AND h.f > 1 AND h.f >= 3 THEN 'open' WHEN h.s = 'half_open' AND NOT o.ok THEN 'open' WHEN h.s = 'half_open' AND h.w + 1 >= 2 THEN 'closed' ELSE h.s END,"
    " CASE WHEN h.s = 'closed' THEN CASE WHEN o.ok THEN 0 ELSE h.f END WHEN h.s = 'half_open' AND o.ok AND h.w + 1 >= 2 THEN 0 ELSE c.failed END,"
    " CASE WHEN h.s = 'half_open' THEN CASE WHEN o.ok AND h.w + 1 < 2 THEN h.w + 1 ELSE 0 END ELSE h.w END,"
    " CASE WHEN NOT o.ok AND (h.s = 'half_open' OR (h.s = 'closed' AND h.f > 1 AND h.f >= 3)) THEN o.ms ELSE c.opened END, CASE WHEN h.s = 'closed' AND NOT o.ok THEN o.ms ELSE c.last END"
    f" FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1, LATERAL (SELECT c.state = 'open' AND o.ms - c.opened >= {DAY_NS // 1_000_000} AS go) g,"
    f" LATERAL (SELECT CASE WHEN g.go THEN 'half_open' ELSE c.state END AS s, CASE WHEN g.go THEN 0 ELSE c.won END AS w, CASE WHEN o.ms - c.last > {10 * DAY_NS // 1_000_000} THEN 1 ELSE c.failed + 1 END AS f) h)"
    " SELECT user_id, event_id, state FROM c WHERE k > 0",
    lambda r: fold(r.select("user_id", "event_id", millis().alias("ms"), (F.col("value") < 50).alias("ok")), ["user_id"], ["event_id"], "user_id long, event_id long, state string", _circuit()),
)
query("priority_strict", "SELECT event_id, user_id % 5 AS level, row_number() OVER (PARTITION BY event_type ORDER BY user_id % 5, event_id) AS place FROM events", log=False)(lambda s, d: L.table(s, d, "events").select("event_id", (F.col("user_id") % 5).alias("level"), F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("user_id") % 5, "event_id")).cast("long").alias("place")))
query("auth_decision", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'allowed' WHEN event_id % 3 = 0 THEN 'missing_token' WHEN user_id % 4 = 1 THEN 'allowed' ELSE 'invalid_token' END AS decision FROM events", log=False)(lambda s, d: L.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "allowed").when(F.col("event_id") % 3 == 0, "missing_token").when(F.col("user_id") % 4 == 1, "allowed").otherwise("invalid_token").alias("decision")))
query("retry_schedule", "SELECT k AS attempt, least(500 * pow(2, k), 30000)::BIGINT AS delay_ms FROM (SELECT unnest(range(30)) AS k)", log=False)(lambda s, d: s.range(30).select(F.col("id").alias("attempt"), F.least(F.lit(500) * F.pow(F.lit(2), F.col("id")), F.lit(30000)).cast("long").alias("delay_ms")))


def _stagnant(r: DataFrame) -> DataFrame:
    order = Window.partitionBy("topic", "consumer_id").orderBy("commit_seq")
    rows = commits(r).withColumn("o", F.expr("off div 4096"))
    rows = rows.withColumn("new", F.coalesce((F.col("o") != F.lag("o").over(order)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(order))
    return rows.groupBy("topic", "consumer_id", "run").agg(F.count("*").alias("replies"), F.min("o").alias("o")).where("replies >= 3").select("topic", "consumer_id", "o", "replies")


plain("stagnant_offsets", ", c AS (SELECT *, off // 4096 AS o FROM commits), d AS (SELECT *, (o IS DISTINCT FROM lag(o) OVER w)::INT AS n FROM c WINDOW w AS (PARTITION BY topic, consumer_id ORDER BY commit_seq)), g AS (SELECT *, sum(n) OVER (PARTITION BY topic, consumer_id ORDER BY commit_seq) AS run FROM d) SELECT topic, consumer_id, min(o) AS o, count(*) AS replies FROM g GROUP BY topic, consumer_id, run HAVING count(*) >= 3", _stagnant)


def _weighted(s: SparkSession, d: str) -> DataFrame:
    """Weighted dequeue of full queues: in each round every level gives as many as its weight, so a request's round is its place by that."""
    level = F.col("user_id") % 5
    weight = F.expr("shiftright(16, cast(user_id % 5 as int))")
    rows = L.table(s, d, "events").select("event_id", "event_type", level.alias("level"), weight.alias("weight"))
    own = F.row_number().over(Window.partitionBy("event_type", "level").orderBy("event_id")) - 1
    rows = rows.withColumn("round", F.floor(own / F.col("weight")))
    return rows.select("event_id", "level", F.row_number().over(Window.partitionBy("event_type").orderBy("round", "level", "event_id")).cast("long").alias("place"))


query("priority_weighted", "WITH q AS (SELECT event_id, event_type, user_id % 5 AS level, (row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY event_id) - 1) // (16 >> (user_id % 5)::INT) AS round FROM events) SELECT event_id, level, row_number() OVER (PARTITION BY event_type ORDER BY round, level, event_id) AS place FROM q", log=False)(_weighted)

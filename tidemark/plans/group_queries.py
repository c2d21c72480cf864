"""Consumers, positions, groups and producers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import log as L
from ..operators import scans
from ..operators.fold import fold
from .base import DAY_NS, NOW_NS, commits, millis, plain, query

plain("poll_batches", "SELECT topic, byte_offset // 4096 AS poll, count(*) AS records, CAST(max(byte_offset + total_size) AS BIGINT) AS next_offset, max(byte_offset + total_size) = any_value(e.end_offset) AS end_of_stream FROM log JOIN ends e USING (topic) GROUP BY topic, byte_offset // 4096", lambda r: r.groupBy("topic", F.expr("byte_offset div 4096").alias("poll")).agg(F.count("*").alias("records"), F.max(F.col("byte_offset") + F.col("total_size")).alias("next_offset")).join(scans.end_offsets(r), "topic").select("topic", "poll", "records", "next_offset", (F.col("next_offset") == F.col("end_offset")).alias("end_of_stream")))
plain("seek_modes", "SELECT topic, mode, CAST(CASE mode WHEN 'beginning' THEN 0 WHEN 'end' THEN end_offset ELSE 128 END AS BIGINT) AS position FROM ends, (VALUES ('beginning'), ('end'), ('offset')) m(mode)", lambda r: scans.end_offsets(r).select("topic", "end_offset", F.explode(F.array(*map(F.lit, ("beginning", "end", "offset")))).alias("mode")).select("topic", "mode", F.when(F.col("mode") == "beginning", F.lit(0)).when(F.col("mode") == "end", F.col("end_offset")).otherwise(128).cast("long").alias("position")))


def _state(r: DataFrame) -> DataFrame:
    return commits(r).groupBy("topic", "consumer_id").agg(F.max_by("off", "commit_seq").alias("committed"), F.max("off").alias("position"))


_STATE = ", st AS (SELECT topic, consumer_id, arg_max(off, commit_seq) AS committed, max(off) AS position FROM commits GROUP BY ALL)"
plain("offset_latest", _STATE + " SELECT topic, consumer_id, committed FROM st", lambda r: _state(r).select("topic", "consumer_id", "committed"))
plain("commit_state", "SELECT topic, consumer_id, commit_seq, off AS committed, max(off) OVER (PARTITION BY topic, consumer_id ORDER BY commit_seq) AS position FROM commits", lambda r: commits(r).select("topic", "consumer_id", "commit_seq", F.col("off").alias("committed"), F.max("off").over(Window.partitionBy("topic", "consumer_id").orderBy("commit_seq")).alias("position")))
plain("commit_deltas", "SELECT topic, consumer_id, commit_seq, off - lag(off) OVER (PARTITION BY topic, consumer_id ORDER BY commit_seq) AS delta FROM commits", lambda r: commits(r).select("topic", "consumer_id", "commit_seq", (F.col("off") - F.lag("off").over(Window.partitionBy("topic", "consumer_id").orderBy("commit_seq"))).alias("delta")))
plain("consumer_lag", _STATE + " SELECT topic, consumer_id, end_offset - committed AS lag FROM st JOIN ends USING (topic)", lambda r: _state(r).join(scans.end_offsets(r), "topic").select("topic", "consumer_id", (F.col("end_offset") - F.col("committed")).alias("lag")))
_ASK = "(VALUES (0), (NULL), (777)) q(ask)"


def _asks(r: DataFrame, keep: str) -> DataFrame:
    return r.select("topic").distinct().crossJoin(r.sparkSession.createDataFrame([(0,), (None,), (777,)], "ask long")).crossJoin(r.sparkSession.range(7).withColumnRenamed("id", "consumer_id")).join(_state(r), ["topic", "consumer_id"], "left").join(scans.end_offsets(r), "topic").select("topic", "consumer_id", "ask", F.expr(keep).alias("start"))


_ASKED = _STATE + f", asked AS (SELECT e.topic, c.consumer_id, CAST(q.ask AS BIGINT) AS ask, st.committed, e.end_offset FROM ends e, {_ASK}, (SELECT unnest(range(7)) AS consumer_id) c LEFT JOIN st ON st.topic = e.topic AND st.consumer_id = c.consumer_id)"
_RESOLVE, _RESUME = "CASE WHEN ask IS NULL THEN end_offset WHEN ask = 0 THEN coalesce(committed, 0) ELSE ask END", "coalesce(committed, ask, 0)"
plain("resolve_start", _ASKED + f" SELECT topic, consumer_id, ask, {_RESOLVE} AS start FROM asked", lambda r: _asks(r, _RESOLVE))
plain("resume_offset", _ASKED + f" SELECT topic, consumer_id, ask, {_RESUME} AS start FROM asked", lambda r: _asks(r, _RESUME))


def _parts(s: SparkSession, d: str) -> DataFrame:
    return L.table(s, d, "part").select(F.col("p_partkey").alias("topic_id"))


def _place(df: DataFrame) -> DataFrame:
    """The 0-based place of each topic id, by the two-level running count."""
    return L.running_total(df.withColumn("_all", F.lit(0)), ["_all"], "topic_id", {"place": F.lit(1)}).drop("_all")


_PARTS = "SELECT p_partkey AS topic_id, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS n FROM part"
query("assign_round_robin", f"SELECT topic_id, place % 7 AS worker FROM ({_PARTS})", log=False)(lambda s, d: _place(_parts(s, d)).select("topic_id", (F.col("place") % 7).alias("worker")))
_RANGE = "CASE WHEN place < (n % 7) * (n // 7 + 1) THEN place // (n // 7 + 1) ELSE (n % 7) + (place - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) END"
query("assign_range", f"SELECT topic_id, {_RANGE} AS worker FROM ({_PARTS})", log=False)(lambda s, d: (p := _place(_parts(s, d))).crossJoin(F.broadcast(p.agg(F.count("*").alias("n")))).select("topic_id", F.expr(_RANGE.replace("//", "div")).alias("worker")))


def _sticky(topics: DataFrame, workers: int = 7) -> DataFrame:
    """topics (topic_id, owner): kept by their owner, the others in order to the least loaded worker, ties to the lowest.

    The k-th of the others gets the k-th place when all workers' free places are ordered by (load, worker), so nothing is folded:
    from place `at` on the `opened` least loaded workers take turns. A worker's load is one number, of metadata.
    """
    held = {r.owner: r.n for r in topics.where("owner IS NOT NULL").groupBy("owner").agg(F.count("*").alias("n")).collect()}
    order = sorted((held.get(w, 0), w) for w in range(workers))
    turn = F.lit(None).cast("long")
    for opened in range(1, workers + 1):
        at = sum(order[opened - 1][0] - n for n, _ in order[: opened - 1])
        turns = F.array(*[F.lit(w).cast("long") for w in sorted(w for _, w in order[:opened])])
        turn = F.when(F.col("place") >= at, F.element_at(turns, ((F.col("place") - at) % opened + 1).cast("int"))).otherwise(turn)
    rest = _place(topics.where("owner IS NULL").select("topic_id"))
    return topics.where("owner IS NOT NULL").select("topic_id", F.col("owner").alias("worker")).unionByName(rest.select("topic_id", turn.alias("worker")))


query(
    "assign_sticky",
    "WITH RECURSIVE p AS (SELECT p_partkey AS topic_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 END AS owner FROM part), u AS (SELECT topic_id, row_number() OVER (ORDER BY topic_id) AS k FROM p WHERE owner IS NULL), l0 AS (SELECT list(coalesce(n, 0) ORDER BY w) AS load FROM (SELECT unnest(range(7)) AS w) LEFT JOIN (SELECT owner AS w, count(*) AS n FROM p WHERE owner IS NOT NULL GROUP BY 1) USING (w)), f(k, topic_id, worker, load) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, load FROM l0 UNION ALL SELECT u.k, u.topic_id, list_position(f.load, list_min(f.load)) - 1, list_transform(f.load, lambda x, i: x + CASE WHEN i = list_position(f.load, list_min(f.load)) THEN 1 ELSE 0 END) FROM f JOIN u ON u.k = f.k + 1) SELECT topic_id, CAST(worker AS BIGINT) AS worker FROM f WHERE k > 0 UNION ALL SELECT topic_id, owner FROM p WHERE owner IS NOT NULL",
    log=False,
)(lambda s, d: _sticky(_parts(s, d).withColumn("owner", F.when(F.col("topic_id") % 3 == 0, F.col("topic_id") % 4))))


def _assignment_diff(s: SparkSession, d: str) -> DataFrame:
    """What each worker loses and gains when one assignment follows another: set differences both ways."""
    part = L.table(s, d, "part")
    old = part.select((F.col("p_partkey") % 7).alias("worker"), F.col("p_partkey").alias("topic_id"))
    new = part.select((F.expr("p_partkey div 2") % 7).alias("worker"), F.col("p_partkey").alias("topic_id"))
    revoked = old.join(new, ["worker", "topic_id"], "left_anti").withColumn("change", F.lit("revoked"))
    return revoked.unionByName(new.join(old, ["worker", "topic_id"], "left_anti").withColumn("change", F.lit("added")))


_OLD_NEW = "SELECT p_partkey % 7 AS worker, p_partkey AS topic_id FROM part", "SELECT (p_partkey // 2) % 7 AS worker, p_partkey AS topic_id FROM part"
query(
    "assignment_diff",
    f"SELECT worker, topic_id, 'revoked' AS change FROM ({_OLD_NEW[0]} EXCEPT {_OLD_NEW[1]}) UNION ALL SELECT worker, topic_id, 'added' FROM ({_OLD_NEW[1]} EXCEPT {_OLD_NEW[0]})",
    log=False,
)(_assignment_diff)
plain("expired_workers", f"SELECT user_id AS worker, max(ts_ns) AS last_ns FROM log GROUP BY user_id HAVING {NOW_NS} - max(ts_ns) > {3 * DAY_NS}", lambda r: r.groupBy(F.col("user_id").alias("worker")).agg(F.max("ts_ns").alias("last_ns")).where(F.lit(NOW_NS) - F.col("last_ns") > 3 * DAY_NS))
query("actor_route", "SELECT p_partkey AS topic_id, CAST((p_partkey::HUGEINT * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT % 6 AS BIGINT) AS actor FROM part", log=False)(lambda s, d: L.table(s, d, "part").select(F.col("p_partkey").alias("topic_id"), S.actor(F.col("p_partkey"), 6).alias("actor")))


def _linger(limit: int = 2000, linger_ns: int = DAY_NS):
    def step(rows: pd.DataFrame, state: dict | None = None) -> pd.DataFrame:
        state = {} if state is None else state
        out, (batch, used, opened) = [], state.get("at", (0, 0, None))
        for size, ts in zip(rows["total_size"], rows["ts_ns"], strict=True):
            if opened is not None and (used >= limit or ts - opened >= linger_ns):
                batch, used, opened = batch + 1, 0, None
            opened = ts if opened is None else opened
            used += size
            out.append(batch)
        state["at"] = batch, used, opened
        return rows[["topic", "record_index"]].assign(batch=out)

    return step


plain(
    "producer_batches",
    f", b(topic, record_index, batch, used, opened) AS (SELECT topic, record_index, 0::BIGINT, total_size::BIGINT, ts_ns FROM log WHERE record_index = 0 UNION ALL SELECT l.topic, l.record_index, CASE WHEN t.f THEN b.batch + 1 ELSE b.batch END, CASE WHEN t.f THEN 0 ELSE b.used END + l.total_size, CASE WHEN t.f THEN l.ts_ns ELSE b.opened END FROM b JOIN log l ON l.topic = b.topic AND l.record_index = b.record_index + 1, LATERAL (SELECT b.used >= 2000 OR l.ts_ns - b.opened >= {DAY_NS} AS f) t) SELECT topic, record_index, batch FROM b",
    lambda r: fold(r.select("topic", "record_index", "total_size", "ts_ns"), ["topic"], ["record_index"], "topic string, record_index long, batch long", _linger()),
)
plain("buffer_drops", "SELECT topic, record_index, byte_offset + total_size > 30000 AS dropped FROM log", lambda r: r.select("topic", "record_index", (F.col("byte_offset") + F.col("total_size") > 30_000).alias("dropped")))


def _tokens(limit: int):
    def step(rows: pd.DataFrame, state: dict | None = None) -> pd.DataFrame:
        state = {} if state is None else state
        out, (tokens, last) = [], state.get("at", (limit, None))
        for ms, want in zip(rows["ms"], rows["total_size"], strict=True):
            last = ms if last is None else last
            more = limit * (ms - last) // 1000
            if more > 0:
                tokens, last = min(limit, tokens + more), ms
            got = min(tokens, want)
            tokens -= got
            out.append(got)
        state["at"] = tokens, last
        return rows[["topic", "record_index"]].assign(granted=out)

    return step


plain(
    "rate_limit",
    ", b(topic, record_index, granted, tokens, last) AS (SELECT topic, -1::BIGINT, 0::BIGINT, 100::BIGINT, NULL::BIGINT FROM ends UNION ALL"
    " SELECT l.topic, l.record_index, least(t.tokens, l.total_size)::BIGINT, (t.tokens - least(t.tokens, l.total_size))::BIGINT, t.last FROM b JOIN log l ON l.topic = b.topic AND l.record_index = b.record_index + 1,"
    " LATERAL (SELECT l.ts_ns // 1000000 AS ms, 100 * (l.ts_ns // 1000000 - coalesce(b.last, l.ts_ns // 1000000)) // 1000 AS more) m,"
    " LATERAL (SELECT CASE WHEN m.more > 0 THEN least(100, b.tokens + m.more) ELSE b.tokens END AS tokens, CASE WHEN m.more > 0 OR b.last IS NULL THEN m.ms ELSE b.last END AS last) t)"
    " SELECT topic, record_index, granted FROM b WHERE record_index >= 0",
    lambda r: fold(r.select("topic", "record_index", millis().alias("ms"), "total_size"), ["topic"], ["record_index"], "topic string, record_index long, granted long", _tokens(100)),
)
query("replay_dedup", "SELECT topic, write_offset, arg_max(event_id, event_id) AS event_id, count(*) AS copies FROM (SELECT topic, byte_offset // 300 AS write_offset, event_id FROM log) GROUP BY ALL")(lambda s, d: L.log_records(s, d).groupBy("topic", F.expr("byte_offset div 300").alias("write_offset")).agg(F.max("event_id").alias("event_id"), F.count("*").alias("copies")))
query("tumbling_counts", "SELECT event_type AS topic, epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS n FROM events GROUP BY ALL", log=False)(lambda s, d: L.table(s, d, "events").groupBy(F.col("event_type").alias("topic"), F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n")).select("topic", F.unix_micros("w.start").alias("window_us"), "n"))

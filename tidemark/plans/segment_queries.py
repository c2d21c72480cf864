"""The life of segments: rolling, sealing, retention, compaction, tiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import log as L
from ..operators.fold import fold
from .base import DAY_NS, NOW_NS, plain, query, segments_of

def _roll(limit: int):
    def step(rows: pd.DataFrame, state: dict | None = None) -> pd.DataFrame:
        state = {} if state is None else state
        out, (seg, used) = [], state.get("at", (0, 0))
        for size in rows["total_size"]:
            out.append(seg)
            used += size
            if used >= limit:
                seg, used = seg + 1, 0
        state["at"] = seg, used
        return rows[["topic", "record_index"]].assign(segment=out)

    return step


plain(
    "segment_roll",
    ", roll(topic, record_index, segment, used) AS (SELECT topic, record_index, 0::BIGINT, total_size::BIGINT FROM log WHERE record_index = 0 UNION ALL SELECT l.topic, l.record_index, CASE WHEN r.used >= 10000 THEN r.segment + 1 ELSE r.segment END, CASE WHEN r.used >= 10000 THEN 0 ELSE r.used END + l.total_size FROM roll r JOIN log l ON l.topic = r.topic AND l.record_index = r.record_index + 1) SELECT topic, record_index, segment FROM roll",
    lambda r: fold(r.select("topic", "record_index", "total_size"), ["topic"], ["record_index"], "topic string, record_index long, segment long", _roll(10_000)),
)
plain("next_segment_index", "SELECT topic, coalesce(max(end_index) + 1, 0) AS next_index FROM seg GROUP BY topic", lambda r: segments_of(r).groupBy("topic").agg(F.coalesce(F.max("end_index") + 1, F.lit(0)).alias("next_index")))
_NAME = "start_index || '_' || start_ns || coalesce('-' || end_ns, '') || '.lnc'"
plain("sealed_names", f"SELECT topic, {_NAME} AS name FROM seg WHERE NOT is_active", lambda r: segments_of(r).where("NOT is_active").select("topic", L.segment_name(F.col("start_index"), F.col("start_ns"), F.col("end_ns")).alias("name")))


def _meta(r: DataFrame) -> DataFrame:
    named = segments_of(r).select("topic", L.segment_name(F.col("start_index"), F.col("start_ns"), F.col("end_ns")).alias("name"))
    part = lambda i: F.regexp_extract("name", r"^(\d+)_(\d+)(?:-(\d+))?\.lnc$", i)
    return named.select("topic", "name", part(1).cast("long").alias("start_index"), part(2).cast("long").alias("start_ns"), F.when(part(3) != "", part(3)).cast("long").alias("end_ns"), (part(3) == "").alias("is_active"))


plain("segment_meta", f"SELECT topic, {_NAME} AS name, start_index, start_ns, end_ns, is_active FROM seg", _meta)
def _aged() -> Column:
    return F.col("end_ns").isNotNull() & (F.lit(NOW_NS) - F.col("end_ns") > 15 * DAY_NS)


plain("retention_age", f"SELECT topic, seg, size_bytes FROM seg WHERE end_ns IS NOT NULL AND {NOW_NS} - end_ns > {15 * DAY_NS}", lambda r: segments_of(r).where(_aged()).select("topic", "seg", "size_bytes"))


def _by_size(r: DataFrame, most: int = 6_000) -> DataFrame:
    left = segments_of(r).where(~F.coalesce(_aged(), F.lit(False)))
    excess = left.groupBy("topic").agg((F.sum("size_bytes") - most).alias("excess"))
    before = F.coalesce(F.sum("size_bytes").over(Window.partitionBy("topic").orderBy("start_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return left.where("NOT is_active").withColumn("freed", before).join(excess, "topic").where("excess > 0 AND freed < excess").select("topic", "seg", "size_bytes")


_SIZED = f", kept AS (SELECT *, sum(size_bytes) OVER (PARTITION BY topic) - 6000 AS excess FROM seg WHERE NOT coalesce({NOW_NS} - end_ns > {15 * DAY_NS}, FALSE)), cut AS (SELECT * FROM (SELECT *, coalesce(sum(size_bytes) OVER (PARTITION BY topic ORDER BY start_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM kept WHERE NOT is_active) WHERE excess > 0 AND freed < excess)"
plain("retention_size", _SIZED + " SELECT topic, seg, size_bytes FROM cut", _by_size)
plain("retention_plan", _SIZED + f" SELECT topic, count(*) AS segments, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT topic, size_bytes FROM cut UNION ALL SELECT topic, size_bytes FROM seg WHERE end_ns IS NOT NULL AND {NOW_NS} - end_ns > {15 * DAY_NS}) GROUP BY topic", lambda r: _by_size(r).union(segments_of(r).where(_aged()).select("topic", "seg", "size_bytes")).groupBy("topic").agg(F.count("*").alias("segments"), F.sum("size_bytes").alias("bytes")))
plain("compaction_trigger", "SELECT topic, count(*) FILTER (WHERE size_bytes < 1048576 AND NOT is_active) >= 4 AS compact FROM seg GROUP BY topic", lambda r: segments_of(r).groupBy("topic").agg((F.count_if((F.col("size_bytes") < 1 << 20) & ~F.col("is_active")) >= 4).alias("compact")))


def _select_for_compaction(rows: pd.DataFrame, state: dict | None = None, most: int = 60_000) -> pd.DataFrame:
    state = {} if state is None else state
    taken, (before, total, last, full) = [], state.get("at", (0, 0, None, False))
    for i, row in enumerate(rows.itertuples() if not full else ()):
        if total + row.size_bytes > most:
            full = True
            break
        if last is not None and row.start_index > last + 1:
            continue
        taken.append(i)
        total, last = total + row.size_bytes, row.end_index
        if before + len(taken) >= 16:
            full = True
            break
    state["at"] = before + len(taken), total, last, full
    return rows.iloc[taken][["topic", "seg", "size_bytes"]]


plain(
    "compaction_select",
    ", c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY start_index) AS k FROM seg WHERE NOT is_active), pick(topic, k, seg, size_bytes, take, total, last, n, stop) AS (SELECT topic, k, seg, size_bytes, size_bytes <= 60000, CASE WHEN size_bytes <= 60000 THEN size_bytes ELSE 0 END, CASE WHEN size_bytes <= 60000 THEN end_index END, CASE WHEN size_bytes <= 60000 THEN 1 ELSE 0 END, size_bytes > 60000 FROM c WHERE k = 1 UNION ALL SELECT c.topic, c.k, c.seg, c.size_bytes, t.go, p.total + CASE WHEN t.go THEN c.size_bytes ELSE 0 END, CASE WHEN t.go THEN c.end_index ELSE p.last END, p.n + CASE WHEN t.go THEN 1 ELSE 0 END, p.stop OR p.total + c.size_bytes > 60000 FROM pick p JOIN c ON c.topic = p.topic AND c.k = p.k + 1, LATERAL (SELECT NOT p.stop AND p.n < 16 AND p.total + c.size_bytes <= 60000 AND (p.last IS NULL OR c.start_index <= p.last + 1) AS go) t) SELECT topic, seg, size_bytes FROM pick WHERE take",
    lambda r: fold(segments_of(r).where("NOT is_active"), ["topic"], ["start_index"], "topic string, seg long, size_bytes long", _select_for_compaction),
)
_TIER_SQL = ", tiers AS (SELECT *, CASE seg % 4 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' WHEN 2 THEN 'cold' ELSE 'archive' END AS tier, 1706745600000000000 - coalesce(end_ns, last_ns) AS age_ns FROM seg)"


def _tiers(r: DataFrame) -> DataFrame:
    tier = F.element_at(F.array(*map(F.lit, ("hot", "warm", "cold", "archive"))), (F.col("seg") % 4 + 1).cast("int"))
    return segments_of(r).withColumns({"tier": tier, "age_ns": F.lit(NOW_NS) - F.col("last_ns")})


plain("tier_scan", _TIER_SQL + " SELECT topic, seg, tier, age_ns, row_number() OVER (PARTITION BY tier ORDER BY age_ns DESC, topic, seg) AS place FROM tiers", lambda r: _tiers(r).select("topic", "seg", "tier", "age_ns", F.row_number().over(Window.partitionBy("tier").orderBy(F.col("age_ns").desc(), "topic", "seg")).cast("long").alias("place")))
plain("next_tier", _TIER_SQL + " SELECT topic, seg, tier, CASE tier WHEN 'hot' THEN 'warm' WHEN 'warm' THEN 'cold' WHEN 'cold' THEN 'archive' END AS next FROM tiers", lambda r: _tiers(r).select("topic", "seg", "tier", S.next_tier(F.col("tier")).alias("next")))
plain("tier_moves", _TIER_SQL + f" SELECT topic, seg, tier FROM tiers WHERE tier <> 'archive' AND age_ns > CASE tier WHEN 'hot' THEN {5 * DAY_NS} WHEN 'warm' THEN {15 * DAY_NS} ELSE {25 * DAY_NS} END", lambda r: _tiers(r).where((F.col("tier") != "archive") & (F.col("age_ns") > F.when(F.col("tier") == "hot", 5 * DAY_NS).when(F.col("tier") == "warm", 15 * DAY_NS).otherwise(25 * DAY_NS))).select("topic", "seg", "tier"))
plain("tier_stats", _TIER_SQL + " SELECT tier, count(*) AS segments, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM tiers GROUP BY tier", lambda r: _tiers(r).groupBy("tier").agg(F.count("*").alias("segments"), F.sum("size_bytes").alias("bytes")))
plain("recovery_candidates", "SELECT topic, seg FROM seg WHERE is_active OR seg % 7 = 2", lambda r: segments_of(r).where("is_active OR seg % 7 = 2").select("topic", "seg"))
plain("empty_segments", "SELECT topic, seg FROM seg WHERE size_bytes - CASE WHEN seg % 6 = 1 THEN size_bytes ELSE 0 END = 0", lambda r: segments_of(r).withColumn("left", F.when(F.col("seg") % 6 == 1, 0).otherwise(F.col("size_bytes"))).where("left = 0").select("topic", "seg"))
query("orphaned_topics", "SELECT DISTINCT c_mktsegment AS directory FROM customer WHERE lower(c_mktsegment) NOT IN (SELECT topic FROM ends)")(lambda s, d: L.table(s, d, "customer").select(F.col("c_mktsegment").alias("directory")).distinct().join(L.topics(s, d), F.lower("directory") == F.col("topic"), "left_anti"))
plain("log_compaction_point", "SELECT topic, CASE WHEN records > 1000 THEN records - 100 END AS compact_before FROM ends", lambda r: r.groupBy("topic").agg(F.count("*").alias("n")).select("topic", F.when(F.col("n") > 1000, F.col("n") - 100).alias("compact_before")))

"""Records as bytes: encoding, parsing, recovery, logs, checksums and compression; and views of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import log as L
from ..sources import tlv
from .base import HOUR_NS, plain, query

# A record's type follows from its id: 1 to 250, every tenth an extended one.
_TYPED = ", typed AS (SELECT *, event_id % 250 + 1 AS code, event_id % 10 = 0 AS ext, octet_length(encode(payload)) AS n FROM log)"
_NAMES = "CASE WHEN ext THEN 'Unknown' " + " ".join(f"WHEN code = {k} THEN '{v}'" for k, v in tlv.CLIENT_TYPES.items()) + " WHEN code BETWEEN 128 AND 254 THEN 'UserDefined' ELSE 'Unknown' END"
_LE32 = "printf('%02X%02X%02X%02X', n & 255, (n >> 8) & 255, (n >> 16) & 255, (n >> 24) & 255)"


def _payload() -> Column:
    return F.encode("payload", "utf-8")


def _extended() -> Column:
    return F.when(F.col("event_id") % 10 == 0, F.col("event_id") % 65536)


def _encoded(extended: bool = True) -> Column:
    return tlv.encode(F.col("event_id") % 250 + 1, _payload(), _extended() if extended else None)


def _files(r: DataFrame, data: Column | None = None) -> DataFrame:
    """path, content: the bytes of each segment, which a segment's limit bounds."""
    rows = r.withColumn("seg", F.expr(f"record_index div {L.SEGMENT_RECORDS}")).withColumn("b", F.hex(_encoded() if data is None else data))
    held = rows.groupBy("topic", "seg").agg(F.array_sort(F.collect_list(F.struct("record_index", "b"))).alias("rows"))
    return held.select(F.concat_ws("/", "topic", "seg").alias("path"), F.unhex(F.array_join(F.transform("rows", lambda x: x["b"]), "")).alias("content"))


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"topic": F.split_part("path", F.lit("/"), F.lit(1)), "seg": F.split_part("path", F.lit("/"), F.lit(2)).cast("long")}).drop("path")


plain(
    "tlv_encode",
    _TYPED + f" SELECT event_id, CASE WHEN ext THEN 'FF' || printf('%02X%02X', (event_id % 65536) & 255, (event_id % 65536) >> 8) ELSE printf('%02X', code) END || {_LE32} || hex(encode(payload)) AS record FROM typed",
    lambda r: r.select("event_id", F.hex(_encoded()).alias("record")),
)
plain(
    "tlv_decode",
    _TYPED + " SELECT event_id, CASE WHEN ext THEN 255 ELSE code END::INT AS type_byte, CASE WHEN ext THEN event_id % 65536 END::INT AS extended_type, n AS length, CASE WHEN ext THEN 7 ELSE 5 END::INT AS header_size FROM typed",
    lambda r: r.select("event_id", tlv.decode_header(_encoded()).alias("h")).select("event_id", "h.*"),
)
plain(
    "tlv_scan",
    _TYPED + f" SELECT topic, record_index // 250 AS seg, CAST(coalesce(sum(n + CASE WHEN ext THEN 7 ELSE 5 END) OVER (PARTITION BY topic, record_index // 250 ORDER BY record_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", {_NAMES} AS record_type, n AS length, md5(payload) AS digest FROM typed",
    lambda r: _placed(tlv.records_of(_files(r))).select("topic", "seg", "offset", "record_type", "length", F.md5("payload").alias("digest")),
)
plain(
    "verify_counts",
    _TYPED + " SELECT topic, record_index // 250 AS seg, count(*) AS records, CAST(sum(n + CASE WHEN ext THEN 7 ELSE 5 END) AS BIGINT) AS valid_bytes FROM typed GROUP BY ALL",
    lambda r: _placed(tlv.recovery_scan(tlv.records_of(_files(r)))).select("topic", "seg", "records", "valid_bytes"),
)

# Of three segments one is whole, one loses its last 3 bytes, one gains a lone byte.
_CUT = ", cut AS (SELECT topic, record_index // 250 AS seg, count(*) AS n, CAST(sum(total_size) AS BIGINT) AS bytes, arg_max(total_size, record_index) AS last FROM log GROUP BY ALL)"


def _damaged(r: DataFrame) -> DataFrame:
    whole = _placed(_files(r, tlv.encode(F.lit(1), _payload())))
    size = F.octet_length("content")
    content = F.when(F.col("seg") % 3 == 1, F.expr("substring(content, 1, octet_length(content) - 3)")).when(F.col("seg") % 3 == 2, F.concat("content", F.unhex(F.lit("01")))).otherwise(F.col("content"))
    return whole.where(size > 0).select(F.concat_ws("/", "topic", "seg").alias("path"), content.alias("content"))


plain(
    "recovery_scan",
    _CUT + " SELECT topic, seg, n - CASE WHEN seg % 3 = 1 THEN 1 ELSE 0 END AS records, bytes - CASE WHEN seg % 3 = 1 THEN last ELSE 0 END AS valid_bytes, CASE seg % 3 WHEN 1 THEN last - 3 WHEN 2 THEN 1 ELSE 0 END AS truncated_bytes, CASE seg % 3 WHEN 1 THEN bytes - last WHEN 2 THEN bytes END AS corrupted_at FROM cut",
    lambda r: _placed(tlv.recovery_scan(tlv.records_of(_damaged(r)))).select("topic", "seg", "records", "valid_bytes", "truncated_bytes", "corrupted_at"),
)
plain(
    "tlv_errors",
    _CUT + " SELECT topic, seg, CASE seg % 3 WHEN 1 THEN 'short payload' ELSE 'short header' END AS error FROM cut WHERE seg % 3 > 0",
    lambda r: _placed(tlv.records_of(_damaged(r)).where("error IS NOT NULL").select("path", "error")).select("topic", "seg", "error"),
)
plain(
    "segment_truncate",
    _CUT + " SELECT topic, seg, bytes - CASE WHEN seg % 3 = 1 THEN last ELSE 0 END AS bytes, seg % 3 > 0 AS dirty FROM cut",
    lambda r: _placed(tlv.truncated(_damaged(r))).select("topic", "seg", F.octet_length("content").cast("long").alias("bytes"), "dirty"),
)
plain(
    "index_rebuild",
    f", t AS (SELECT topic, record_index // 250 AS seg, record_index % 250 AS record_index, ts_ns, CAST(coalesce(sum(total_size + 8) OVER w, 0) AS BIGINT) AS \"offset\", lag(ts_ns // {HOUR_NS}) OVER (PARTITION BY topic, record_index // 250 ORDER BY record_index) AS p FROM log WINDOW w AS (PARTITION BY topic, record_index // 250 ORDER BY record_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT topic, seg, record_index, ts_ns, \"offset\", record_index % 64 = 0 AS sparse, p IS NULL OR p <> ts_ns // {HOUR_NS} AS timed FROM t WHERE record_index % 64 = 0 OR p IS NULL OR p <> ts_ns // {HOUR_NS}",
    lambda r: _placed(tlv.rebuild_index(tlv.records_of(_files(r, tlv.encode(F.lit(1), F.concat(tlv.little_endian(F.col("ts_ns"), 8), _payload())))), 64, HOUR_NS)),
)
plain(
    "wal_replay",
    ", w AS (SELECT topic, record_index // 250 AS seg, total_size - 1 AS size, record_index = max(record_index) OVER (PARTITION BY topic, record_index // 250) AS cut FROM log) SELECT topic, seg, count(*) AS frames, CAST(sum(size - 4) AS BIGINT) AS bytes FROM w WHERE NOT cut GROUP BY ALL",
    lambda r: _placed(tlv.wal_records(_files(r, F.concat(tlv.little_endian(F.octet_length(_payload()), 4), _payload())).withColumn("content", F.expr("substring(content, 1, octet_length(content) - 1)")))).groupBy("topic", "seg").agg(F.count("*").alias("frames"), F.sum(F.octet_length("data")).alias("bytes")),
)
plain(
    "payload_crc",
    "SELECT event_id, event_id % 7 <> 0 AS valid FROM log",
    lambda r: r.select("event_id", tlv.valid_payload(_payload(), F.crc32(_payload()) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("valid")),
)
plain(
    "compressed_payloads",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'lz4' ELSE 'zstd' END AS algorithm, octet_length(encode(payload)) AS original_size, md5(payload) AS digest FROM log",
    lambda r: tlv.decompressed(tlv.compressed(r.select("event_id", F.element_at(F.array(*map(F.lit, ("none", "lz4", "zstd"))), (F.col("event_id") % 3 + 1).cast("int")).alias("algorithm"), _payload().alias("payload")), "algorithm")).select("event_id", tlv.compression_header(F.col("packed")).alias("h"), "payload").select("event_id", "h.algorithm", "h.original_size", F.md5("payload").alias("digest")),
)
plain(
    "record_predicates",
    "SELECT event_id, event_id % 8 = 1 AS is_data, event_id % 8 = 2 AS is_tombstone FROM log",
    lambda r: r.select("event_id", tlv.is_data(F.col("event_id") % 8).alias("is_data"), tlv.is_tombstone(F.col("event_id") % 8).alias("is_tombstone")),
)
plain(
    "scalar_views",
    ", v AS (SELECT event_id, payload, event_id % 2000 * 512 AS b, event_id % 20000 * 40 AS ns FROM log) SELECT event_id, hex(encode(payload)) AS hexed, payload AS utf8, CASE WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS size, CASE WHEN ns >= 1000 THEN printf('%.2f us', ns / 1000.0::DOUBLE) ELSE ns || ' ns' END AS took FROM v",
    lambda r: r.select("event_id", F.hex(_payload()).alias("hexed"), F.decode(_payload(), "utf-8").alias("utf8"), S.human_bytes(F.col("event_id") % 2000 * 512).alias("size"), S.human_ns(F.col("event_id") % 20000 * 40).alias("took")),
)
plain(
    "sort_key_hex",
    "SELECT event_id, printf('%016x%016x', (ts_ns // 1000000) * 1048576, (user_id % 7 << 48) | record_index) AS key FROM log",
    lambda r: r.select("event_id", S.sort_key_hex(S.hlc(F.expr("ts_ns div 1000000"), F.lit(0)), F.col("user_id") % 7, F.col("record_index")).alias("key")),
)
query(
    "session_counts",
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k",
    log=False,
)(lambda s, d: L.table(s, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n"))

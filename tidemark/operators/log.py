"""The log view of a table of events: topics, records with byte offsets, segments and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = 5
# Fixed value: the ending of segment file names.
SUFFIX = ".lnc"
BLOCK = 1 << 20
SEGMENT_RECORDS = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with exclusive running sums along an integer order column, per key.

    Two levels: windows over blocks of the order column, and a window over one row per block; no task sees a whole key.
    """
    df = df.withColumn("_blk", F.expr(f"`{order}` div {block}"))
    total = df.groupBy(*keys, "_blk").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(*keys, "_blk", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({f"_i_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(base, [*keys, "_blk"])
    return out.withColumns({k: (F.col(f"_i_{k}") + F.col(f"_b_{k}")).cast("long") for k in sums}).drop("_blk", *[f"_{x}_{k}" for k in sums for x in "ib"])


def previous(df: DataFrame, keys: list[str], order: str, value: Column, block: int = BLOCK) -> DataFrame:
    """df with _p, the value of the row before along an integer order column, per key; null for the first. Two levels, as running_total()."""
    df = df.withColumns({"_blk": F.expr(f"`{order}` div {block}"), "_v": value})
    ends = df.groupBy(*keys, "_blk").agg(F.max_by("_v", order).alias("_end"))
    base = ends.select(*keys, "_blk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_b"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    out = df.withColumns({"_i": F.lag("_v").over(inside), "_first": F.row_number().over(inside) == 1}).join(base, [*keys, "_blk"])
    return out.withColumn("_p", F.when(F.col("_first"), F.col("_b")).otherwise(F.col("_i"))).drop("_blk", "_v", "_i", "_first", "_b")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, topic_id: topics are metadata, a row each, numbered by name from 1."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()
    return names.withColumn("topic_id", F.row_number().over(Window.orderBy("topic")).cast("long"))


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, topic_id, record_index, event_id, user_id, value, ts_ns, payload, total_size, byte_offset."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"), "event_id", "user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.coalesce("props", F.lit("")).alias("payload"), (F.octet_length(F.coalesce("props", F.lit(""))) + HEADER).cast("long").alias("total_size"),
    )
    placed = running_total(events, ["topic"], "event_id", {"record_index": F.lit(1), "byte_offset": F.col("total_size")})
    return placed.join(F.broadcast(topics(spark, sf_dir)), "topic")


def time_filtered(spark: SparkSession, sf_dir: str, start_ns: int, end_ns: int) -> DataFrame:
    """Events of the closed time range; the comparison is on the stored column, so it reaches the Parquet scan."""
    ts = lambda ns: F.timestamp_micros(F.lit(ns // 1000)).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where((F.col("ts") >= ts(start_ns)) & (F.col("ts") <= ts(end_ns)))


def segments(records: DataFrame, per: int = SEGMENT_RECORDS) -> DataFrame:
    """A row per segment of `per` records; the last of a topic is active and has no end."""
    seg = records.groupBy("topic", "topic_id", F.expr(f"record_index div {per}").alias("seg")).agg(
        F.min("record_index").alias("start_index"), F.max("record_index").alias("end_index"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("last_ns"), F.sum("total_size").alias("size_bytes"), F.count("*").alias("records")
    )
    active = seg.withColumn("is_active", F.col("seg") == F.max("seg").over(Window.partitionBy("topic")))
    return active.withColumn("end_ns", F.when(~F.col("is_active"), F.col("last_ns")))


def segment_name(start: Column, start_ns: Column, end_ns: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("_"), start_ns.cast("string"), F.coalesce(F.concat(F.lit("-"), end_ns.cast("string")), F.lit("")), F.lit(SUFFIX))


def sparse_index(records: DataFrame, interval: int = 4096) -> DataFrame:
    """Every interval-th record: sort key (HLC of its millisecond, node 0) and byte offset."""
    return records.where(F.col("record_index") % interval == 0).select("topic", "record_index", F.expr("shiftleft(ts_ns div 1000000, 20)").alias("hlc"), "ts_ns", "byte_offset")


def time_index(records: DataFrame, bucket_ns: int = 10_000_000) -> DataFrame:
    """Records whose time bucket differs from that of the one before; the first always."""
    rows = previous(records.select("topic", "record_index", "ts_ns", "byte_offset"), ["topic"], "record_index", F.expr(f"ts_ns div {bucket_ns}"))
    return rows.where(F.col("_p").isNull() | (F.expr(f"ts_ns div {bucket_ns}") != F.col("_p"))).select("topic", "record_index", "ts_ns", "byte_offset")


def truncate_to(records: DataFrame, offset: int) -> DataFrame:
    """What stays when every topic is cut at an offset: whole records that end there or before."""
    return records.where(F.col("byte_offset") + F.col("total_size") <= offset)


def compact(records: DataFrame, chosen: DataFrame, per: int = SEGMENT_RECORDS) -> DataFrame:
    """Records with their segment number, those of the chosen segments (topic, seg) under the first chosen one of their topic."""
    first = chosen.groupBy("topic").agg(F.min("seg").alias("into"))
    numbered = records.withColumn("seg", F.expr(f"record_index div {per}"))
    return numbered.join(chosen.join(first, "topic"), ["topic", "seg"], "left").withColumn("seg", F.coalesce("into", "seg")).drop("into")


def replay(frames: DataFrame, records: DataFrame) -> DataFrame:
    """Records and, of frames of a write-ahead log (same columns), those not among them yet by topic and offset."""
    return records.unionByName(frames.join(records.select("topic", "byte_offset"), ["topic", "byte_offset"], "left_anti").dropDuplicates(["topic", "byte_offset"]))

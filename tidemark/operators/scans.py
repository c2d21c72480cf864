"""Offset and time scans, seeks and lookups over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_NS = 600_000_000_000  # of around(): ten minutes
TYPE_NAMES = {1: "Data", 2: "Tombstone", 3: "Transaction", 4: "Checkpoint", 5: "Schema", 16: "Compressed"}


def fetch_bytes(records: DataFrame, start: int, max_bytes: int) -> DataFrame:
    """The part of each record within the half-open byte range; the first and last may be cut."""
    end = F.col("byte_offset") + F.col("total_size")
    hit = records.where((end > start) & (F.col("byte_offset") < start + max_bytes))
    return hit.select("topic", "record_index", F.greatest(F.lit(start) - F.col("byte_offset"), F.lit(0)).alias("skip"), (F.least(end, F.lit(start + max_bytes)) - F.greatest("byte_offset", F.lit(start))).alias("length"))


def fetch_records(records: DataFrame, start: int, max_bytes: int) -> DataFrame:
    """Whole records within the byte range."""
    return records.where((F.col("byte_offset") >= start) & (F.col("byte_offset") + F.col("total_size") <= start + max_bytes))


def end_offsets(records: DataFrame) -> DataFrame:
    return records.groupBy("topic").agg(F.sum("total_size").alias("end_offset"))


def fetch_status(requests: DataFrame, ends: DataFrame) -> DataFrame:
    """requests (topic, start; null start: the tail) -> status and next offset."""
    end = F.coalesce("end_offset", F.lit(0))
    status = F.when(F.col("start").isNull(), "TAIL").when(F.col("start") > end, "CATCHING_UP").when(F.col("start") == end, "EMPTY").otherwise("RESPONSE")
    return requests.join(ends, "topic", "left").select("topic", "start", status.alias("status"), F.when(F.col("start").isNull() | (F.col("start") > end), end).otherwise(F.col("start")).alias("next_offset"))


def seek_record(index: DataFrame, wanted: DataFrame, interval: int) -> DataFrame:
    """wanted (topic, r) -> the index entry at or before record r."""
    floor = wanted.withColumn("record_index", F.expr(f"r div {interval} * {interval}"))
    return floor.join(index, ["topic", "record_index"], "left").select("topic", "r", "byte_offset")


def search(index: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted (topic, x): insertion rank of x among the keys of the index, and whether it is one of them; both are integers."""
    found = around(index.select("topic", F.col(key).alias("ts_ns")), wanted.select("topic", (F.col("x") - 1).alias("t"), F.lit(1).alias("kind")))
    return found.select("topic", (F.col("t") + 1).alias("x"), "rank", F.coalesce(F.col("after") == F.col("t") + 1, F.lit(False)).alias("exact"))


def around(index: DataFrame, wanted: DataFrame, block_ns: int = BLOCK_NS) -> DataFrame:
    """wanted (topic, t, kind) with, among the entries of the topic, how many are at t or before (rank), the last of those and the first after t.

    `kind` is any number over 0. Entries and probes are merged and cut into blocks of time: windows over blocks, both ways from the
    beginning of a frame (one that ends at its partition's end is computed anew for each row), and windows over one row per block. No
    probe is compared with every entry, and no task sees a whole topic. A null t has rank 0 and no neighbours.
    """
    entry = F.col("kind") == 0
    rows = index.where("ts_ns IS NOT NULL").select("topic", F.col("ts_ns").alias("t"), F.lit(0).alias("kind")).unionByName(wanted.select("topic", "t", F.col("kind").cast("int").alias("kind")))
    rows = rows.withColumn("blk", F.expr(f"t div {block_ns}")).repartition("topic", "blk")
    at = F.when(entry, F.col("t"))
    ends = rows.groupBy("topic", "blk").agg(F.count_if(entry).alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    up, down = (Window.partitionBy("topic").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("blk"), F.col("blk").desc()))
    base = ends.select(F.col("topic").alias("_topic"), F.col("blk").alias("_blk"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("_n"), F.max("high").over(up).alias("_high"), F.min("low").over(down).alias("_low"))
    inside = Window.partitionBy("topic", "blk")
    so_far = inside.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    still = inside.orderBy(F.col("t").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("topic", "blk", "t", "kind", F.sum(entry.cast("long")).over(so_far).alias("n"), F.max(at).over(so_far).alias("high"), F.min(at).over(still).alias("low")).where(~entry)
    found = own.join(base, F.col("topic").eqNullSafe(F.col("_topic")) & F.col("blk").eqNullSafe(F.col("_blk")))
    known = lambda c: F.when(F.col("t").isNotNull(), c)
    return found.select("topic", "t", "kind", F.coalesce(known(F.col("n") + F.col("_n")), F.lit(0)).alias("rank"), known(F.coalesce("high", "_high")).alias("before"), known(F.coalesce("low", "_low")).alias("after"))


def nearest(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entry nearest to t; a tie goes to the earlier one."""
    gap = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull() | (F.col("t") - F.col("before") <= F.col("after") - F.col("t")), F.col("before")).otherwise(F.col("after"))
    return around(index, wanted.select("topic", "t", F.lit(1).alias("kind"))).select("topic", "t", gap.alias("nearest_ns"))


def in_window(index: DataFrame, wanted: DataFrame, window_ns: int) -> DataFrame:
    """wanted (topic, t) with entries in [t - w, t + w]: both sides are dealt to buckets of width 2w, a probe to the two it may touch."""
    width = 2 * window_ns + 1
    keyed = index.select("topic", "ts_ns", F.expr(f"ts_ns div {width}").alias("b"))
    probes = wanted.select("topic", "t", F.explode(F.array_distinct(F.array(F.expr(f"(t - {window_ns}) div {width}"), F.expr(f"(t + {window_ns}) div {width}")))).alias("b"))
    return probes.join(keyed, ["topic", "b"]).where(F.col("ts_ns").between(F.col("t") - window_ns, F.col("t") + window_ns)).select("topic", "t", "ts_ns")


def point_in_time(index: DataFrame, wanted: DataFrame, window_ns: int) -> DataFrame:
    """Entries within the window, whether one is exact and, without an exact one, the nearest outside on each side; a row for each (topic, t).

    Each probe is looked up in three places, before its window, at t and at its window's end: entries are counted by rank, not one by one.
    """
    moves = {1: -window_ns - 1, 2: 0, 3: window_ns}
    places = wanted.select("topic", F.explode(F.array(*[F.struct((F.col("t") + m).alias("t"), F.lit(k).alias("kind")) for k, m in moves.items()])).alias("s")).select("topic", "s.*")
    back = F.element_at(F.array(*[F.lit(-m) for m in moves.values()]), F.col("kind"))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, c))
    found = around(index, places).groupBy("topic", (F.col("t") + back).alias("t")).agg(
        (of(3, F.col("rank")) - of(1, F.col("rank"))).alias("entries"), F.coalesce(of(2, F.col("before") == F.col("t")), F.lit(False)).alias("exact"), of(1, F.col("before")).alias("before"), of(3, F.col("after")).alias("after")
    )
    return found.select("topic", "t", "entries", "exact", F.when(~F.col("exact"), F.col("before")).alias("before_ns"), F.when(~F.col("exact"), F.col("after")).alias("after_ns"))


def type_name(byte: Column) -> Column:
    named = F.lit(None).cast("string")
    for code, name in TYPE_NAMES.items():
        named = F.coalesce(named, F.when(byte == code, name))
    return F.coalesce(named, F.when(byte.between(0x80, 0xFE), "UserDefined").otherwise("Unknown"))


def valid_topic_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9-]+\z")

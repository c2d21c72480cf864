import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import log, scans
from tidemark.operators.registry import TopicRegistry
from tidemark.plans import group_queries, segment_queries
from tidemark.sources import tlv
from tidemark.streaming import consume


def record(code, payload):
    return bytes([code]) + struct.pack("<I", len(payload)) + payload


def test_bytes_of_records(spark):
    frame = spark.createDataFrame([(1, b"hello", None), (16, b"", None), (128, b"x" * 300, 513)], "t int, p binary, e int")
    got = [bytes(r[0]) for r in frame.select(tlv.encode(F.col("t"), F.col("p"), F.col("e"))).collect()]
    assert got[0] == record(1, b"hello") and got[1] == record(16, b"") and got[2] == b"\xff" + struct.pack("<HI", 513, 300) + b"x" * 300
    back = spark.createDataFrame([(x,) for x in got] + [(b"\x01\x00",)], "d binary").select(tlv.decode_header(F.col("d")).alias("h")).collect()
    assert [tuple(r.h) if r.h else None for r in back] == [(1, None, 5, 5), (16, None, 0, 5), (255, 513, 300, 7), None]
    assert [r[5] for r in tlv.parse(record(1, b"hello") + record(1, b"world"))] == [0, 10]
    assert [r[-1] for r in tlv.parse(record(16, b"test payload") + b"\x10\x00\x10")] == [None, "short header"]
    assert [r[-1] for r in tlv.parse(record(1, b"abc")[:-1])] == ["short payload"] and [r[-1] for r in tlv.parse(record(1, b"abc"), most=2)] == ["too large"]
    assert list(tlv.wal_frames(struct.pack("<I", 2) + b"ab" + struct.pack("<I", 9) + b"cut")) == [b"ab"]
    head = spark.createDataFrame([(b"\x02\x10\x00\x00\x00zz",)], "d binary").select(tlv.compression_header(F.col("d")).alias("h")).first().h
    assert tuple(head) == ("zstd", 16)


def test_segment_files(spark, tmp_path):
    stamp = lambda ns: struct.pack("<Q", ns)
    (tmp_path / "t").mkdir()
    (tmp_path / "t/0_5-9.lnc").write_bytes(b"".join(record(1, stamp(ns)) for ns in (5_000_000, 8_000_000, 15_000_000, 18_000_000, 25_000_000)))
    (tmp_path / "t/5_10.lnc").write_bytes(record(16, b"test payload") + b"\x10\x00\x10")
    rows = tlv.read(spark, str(tmp_path))
    scan = {r.path.rsplit("/", 1)[1]: r for r in tlv.recovery_scan(rows).collect()}
    assert (scan["5_10.lnc"].records, scan["5_10.lnc"].truncated_bytes, scan["5_10.lnc"].corrupted_at) == (1, 3, 17)
    assert scan["0_5-9.lnc"].records == 5 and scan["0_5-9.lnc"].corrupted_at is None
    index = tlv.rebuild_index(rows, interval=2).where("path LIKE '%0_5-9%'").collect()
    assert sorted(r.ts_ns for r in index if r.timed) == [5_000_000, 15_000_000, 25_000_000] and sorted(r.record_index for r in index if r.sparse) == [0, 2, 4]
    assert tlv.read(spark, str(tmp_path), "DROPMALFORMED").count() == 6
    with pytest.raises(Exception, match="short header"):
        tlv.read(spark, str(tmp_path), "FAILFAST").collect()
    assert {r.sealed for r in tlv.manifest(spark, str(tmp_path)).collect()} == {True, False}


def test_export_and_pruned_segments(spark, tmp_path):
    records = log.log_records(spark, "/root/testdata/sf0.001")
    tlv.export_topic(records, "click", f"{tmp_path}/x")
    assert tlv.import_topic(spark, f"{tmp_path}/x").count() == records.where("topic = 'click'").count()
    tlv.write_segments(records, f"{tmp_path}/log")
    back = spark.read.parquet(f"{tmp_path}/log")
    assert scans.fetch_records(back, 500, 2000).count() == scans.fetch_records(records, 500, 2000).count()


def test_running_total_over_small_blocks(spark):
    frame = spark.createDataFrame([(i % 3, i, i % 7) for i in range(500)], "k long, at long, v long")
    small, large = (log.running_total(frame, ["k"], "at", {"s": F.col("v"), "n": F.lit(1)}, b) for b in (16, 1 << 20))
    assert sorted(small.collect()) == sorted(large.collect()) and small.where("s < 0").isEmpty()


def test_row_before_over_small_blocks(spark):
    rows = [(k, i, None if i % 11 == 0 else i * i % 5) for k in "ab" for i in range(0, 300, 1 if k == "a" else 7)]
    last, want = {}, {}
    for k, i, v in rows:
        want[k, i], last[k] = last.get(k), v
    frame = spark.createDataFrame(rows, "k string, at long, v long")
    for block in (16, 1 << 20):
        assert {(r.k, r.at): r._p for r in log.previous(frame, ["k"], "at", F.col("v"), block).collect()} == want


def test_folds_hold_a_batch_and_carry_their_state(spark):
    import pandas as pd

    from tidemark.operators.fold import fold
    from tidemark.plans import decision_queries, integrity_queries

    n = 700
    rows = [(k, i, i * i % 90 + 1, i % 4, 3_600_000_000_000 * (i * 7), i * 131 % 300, i * 37 % 11 > 5, i * 5309 % 120_000, i * 3 + 2) for k in ("a", None, "b") for i in range(n)]
    names = "topic string, record_index long, total_size long, secs long, ts_ns long, ms long, ok boolean, us long, end_index long"
    frame = spark.createDataFrame(rows, names).selectExpr("*", "topic AS user_id", "record_index AS event_id", "record_index AS seg", "total_size * 90 AS size_bytes", "record_index * 3 AS start_index")
    steps = [(integrity_queries._ewma, "rate double"), (segment_queries._roll(500), "segment long"), (group_queries._linger(), "batch long"), (group_queries._tokens(100), "granted long")]
    steps = [(s, f"topic string, record_index long, {c}", ["record_index"]) for s, c in steps]
    steps += [(s, f"user_id string, event_id long, {c} string", ["event_id"]) for s, c in ((decision_queries._follower(), "status"), (decision_queries._circuit(), "state"))]
    steps += [(segment_queries._select_for_compaction, "topic string, seg long, size_bytes long", ["start_index"])]
    whole = frame.toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for step, schema, order in steps:
            got = fold(frame.repartition(5), [schema.split()[0]], order, schema, step).collect()
            want = pd.concat([step(rows.sort_values(order)) for _, rows in whole.groupby("topic", dropna=False)])
            assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(None if x is None or x != x else x for x in r)) for r in want.astype(object).itertuples(index=False))
        seen = fold(frame, ["topic"], ["record_index"], "topic string, n long", lambda rows, state: pd.DataFrame({"topic": rows["topic"][:1], "n": len(rows)})).collect()
        assert max(r.n for r in seen) <= 64 and sum(r.n for r in seen) == 3 * n
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors(spark):
    index = spark.createDataFrame([("t", i * 1_000_000) for i in range(100)], "topic string, ts_ns long")
    assert index.where(F.col("ts_ns").between(20_000_000, 30_000_000)).count() == 11
    probe = lambda *ts: spark.createDataFrame([("t", t) for t in ts], "topic string, t long")
    few = spark.createDataFrame([("t", x) for x in (10, 20)], "topic string, ts_ns long")
    assert scans.nearest(few, probe(15, 0, 99)).orderBy("t").select("nearest_ns").collect() == [(10,), (10,), (20,)]
    three = spark.createDataFrame([("t", x) for x in (0, 100, 200)], "topic string, ts_ns long")
    got = {r.t: tuple(r)[2:] for r in scans.point_in_time(three, probe(90, 100), 5).collect()}
    assert got == {90: (0, False, 0, 100), 100: (1, True, None, None)}
    one = spark.range(1).select(scalars.hlc(F.lit(1).cast("long"), F.lit(1).cast("long")), scalars.actor(F.lit(1), 4), scalars.human_bytes(F.lit(1536))).first()
    assert one[0] == 1048577 and one[1] == 0x9E3779B97F4A7C15 % 4 and one[2] == "1.50 KB"
    roll = segment_queries._roll(8)
    import pandas as pd

    assert roll(pd.DataFrame({"topic": "t", "record_index": range(4), "total_size": 4})).segment.tolist() == [0, 0, 1, 1]
    bucket = group_queries._tokens(100)(pd.DataFrame({"topic": "t", "record_index": range(3), "ms": 0, "total_size": [60, 40, 10]}))
    assert bucket.granted.tolist() == [60, 40, 0]


def test_registry(spark, tmp_path):
    topics = TopicRegistry(spark, f"{tmp_path}/topics")
    assert topics.create("a-1") == 1 and topics.create("b", max_age_secs=60, max_bytes=0) == 2
    with pytest.raises(ValueError):
        topics.create("a-1")
    with pytest.raises(ValueError):
        topics.create("no_underscore")
    topics.set_retention("a-1", 0, 500)
    topics.delete("b")
    topics.create("a-1", topic_id=7)
    assert [(r.topic_id, r.name) for r in topics.list().collect()] == [(7, "a-1")] and topics.create("c") == 8
    with pytest.raises(KeyError):
        topics.delete("b")


def test_streams(spark, tmp_path):
    records = log.log_records(spark, "/root/testdata/sf0.001").withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    records.select("topic", "byte_offset", "total_size", "ts").repartition(3).write.parquet(f"{tmp_path}/log")
    schema = "topic string, byte_offset long, total_size long, ts timestamp"
    offsets = f"{tmp_path}/offsets"
    for _ in range(2):  # the second has nothing to do
        consume.drain(consume.read_log(spark, f"{tmp_path}/log", schema, 1), f"{tmp_path}/cp", consume.commit_offsets(offsets, "c"))
    assert spark.read.parquet(offsets).select("epoch").distinct().count() == 3
    counts = consume.windowed_counts(consume.read_log(spark, f"{tmp_path}/log", schema), "1 day")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == records.count()
    spark.createDataFrame([("k", 0, 60), ("k", 0, 40), ("k", 0, 10), ("k", 500, 99)], "key string, ms long, want long").coalesce(1).write.parquet(f"{tmp_path}/req")
    q = consume.rate_limited(spark.readStream.schema("key string, ms long, want long").parquet(f"{tmp_path}/req"), 100).writeStream.format("memory").queryName("granted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.granted for r in spark.table("granted").collect()] == [60, 40, 0, 50]


def test_consumer(spark, tmp_path):
    from tidemark.client import Consumer

    records = log.log_records(spark, "/root/testdata/sf0.001").cache()
    one = Consumer(records, "click", offsets=f"{tmp_path}/offsets")
    first = one.poll(600)
    at = one.position
    assert 0 < at <= 600 and first.agg(F.sum("total_size")).first()[0] == at
    one.commit()
    assert Consumer(records, "click", offsets=f"{tmp_path}/offsets").position == at and one.lag() == one.end() - at
    assert one.poll(3).count() == 1 and one.position > at
    assert one.seek("end") == one.end() and one.poll().count() == 0
    assert one.seek("beginning") == 0 and one.seek(17) == 17


def test_shell(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    (tmp_path / "0_1.lnc").write_bytes(record(1, b"hello") + record(2, b""))
    main(["verify", str(tmp_path)])
    main(["create-topic", f"{tmp_path}/topics", "t-1", "--max-bytes", "5"])
    main(["get-topic", f"{tmp_path}/topics", "t-1"])
    out = capsys.readouterr().out
    assert "0_1.lnc" in out and "t-1" in out


def test_rewrites(spark):
    records = log.log_records(spark, "/root/testdata/sf0.001").select("topic", "record_index", "byte_offset", "total_size").cache()
    cut = log.truncate_to(records, 1000)
    assert cut.agg(F.max(F.col("byte_offset") + F.col("total_size"))).first()[0] <= 1000
    merged = log.compact(records, spark.createDataFrame([("click", 1), ("click", 2)], "topic string, seg long"), per=50)
    own = merged.where("topic = 'click'").groupBy("seg").count().collect()
    assert {r.seg: r["count"] for r in own}[1] == 100 and 2 not in {r.seg for r in own} and merged.count() == records.count()
    again = records.where("record_index < 30")
    assert log.replay(again.union(again), cut).count() == cut.count() + again.where("byte_offset + total_size > 1000").count()
    row = spark.range(1).select(scalars.human_ns(F.lit(1500)), scalars.json_field(F.lit('{"a": 3}'), "a")).first()
    assert tuple(row) == ("1.50 us", "3")


def test_drain_says_when_time_is_up(spark, tmp_path):
    import time

    for _ in range(3):
        spark.range(5).write.mode("append").parquet(f"{tmp_path}/log")
    log = consume.read_log(spark, f"{tmp_path}/log", "id long", 1)
    with pytest.raises(TimeoutError):
        consume.drain(log, f"{tmp_path}/cp", lambda batch, epoch: time.sleep(5), timeout=1)
    assert not spark.streams.active


def test_weighted_dequeue_as_a_loop(spark, tmp_path):
    from collections import deque

    from tidemark.plans.decision_queries import _weighted

    rows = [(i, "t", i * i % 5) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    queues, out = [deque(i for i, _, level in rows if level == k) for k in range(5)], []
    tokens = [16, 8, 4, 2, 1]
    while any(queues):
        ready = next((k for k in range(5) if queues[k] and tokens[k]), None)
        if ready is None:
            tokens = [16, 8, 4, 2, 1]
            continue
        tokens[ready] -= 1
        out.append(queues[ready].popleft())
    assert [r.event_id for r in _weighted(spark, str(tmp_path)).orderBy("place").collect()] == out


def test_sticky_as_a_loop(spark):
    from tidemark.plans.group_queries import _sticky

    for owners in ([0, 0, 0, 1, 3, 3], [], [6] * 20):
        rows = [(i, w) for i, w in enumerate(owners)] + [(100 + i, None) for i in range(23)]
        load = [owners.count(w) for w in range(7)]
        want = dict(enumerate(owners))
        for i in range(23):
            w = min(range(7), key=lambda k: (load[k], k))
            load[w] += 1
            want[100 + i] = w
        assert {r.topic_id: r.worker for r in _sticky(spark.createDataFrame(rows, "topic_id long, owner long")).collect()} == want


def test_damaged_packed_payloads(spark):
    rows = spark.createDataFrame([(b"", b"\x02\x00"), (b"", b"\x00\x02\x00\x00\x00hi"), (b"", b"\x02\xff\xff\xff\xff")], "payload binary, packed binary")
    assert [r.payload and bytes(r.payload) for r in tlv.decompressed(rows).collect()] == [None, b"hi", None]


def test_lookups_over_small_blocks(spark):
    import random

    draw = random.Random(7)
    entries = [(draw.choice("ab"), draw.choice([None, *range(-60, 60)])) for _ in range(80)] + [("a", 400), ("c", 3)]
    asked = sorted({(draw.choice("abd"), draw.randrange(-300, 500)) for _ in range(120)})
    index, wanted = spark.createDataFrame(entries, "topic string, ts_ns long"), spark.createDataFrame([*asked, ("a", None)], "topic string, t long")
    of = lambda topic: sorted(x for k, x in entries if k == topic and x is not None)
    for block in (7, 1000):
        got = {(r.topic, r.t): (r.rank, r.before, r.after) for r in scans.around(index, wanted.withColumn("kind", F.lit(1)), block).collect()}
        want = {(k, t): (sum(x <= t for x in of(k)), max((x for x in of(k) if x <= t), default=None), min((x for x in of(k) if x > t), default=None)) for k, t in asked}
        assert got == want | {("a", None): (0, None, None)}
    got = {(r.topic, r.t): tuple(r)[2:] for r in scans.point_in_time(index, wanted, 4).collect()}
    for k, t in asked:
        exact = t in of(k)
        outside = (None, None) if exact else (max((x for x in of(k) if x < t - 4), default=None), min((x for x in of(k) if x > t + 4), default=None))
        assert got[k, t] == (sum(t - 4 <= x <= t + 4 for x in of(k)), exact, *outside)
    assert got["a", None] == (0, False, None, None)
    ranks = {(r.topic, r.x): (r.rank, r.exact) for r in scans.search(index, wanted.where("t IS NOT NULL").withColumnRenamed("t", "x"), "ts_ns").collect()}
    assert ranks == {(k, t): (sum(x < t for x in of(k)), t in of(k)) for k, t in asked}


@pytest.mark.parametrize("name", ["nearest", "point_in_time", "sparse_search"])
def test_lookups_read_no_frame_to_its_end(spark, name):
    from tidemark.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()

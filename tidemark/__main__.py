"""python -m tidemark COMMAND: segment files and topics from the shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.registry import TopicRegistry
from .sources import tlv


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, what in (("scan", "records of segment files"), ("dump", "the first records"), ("verify", "well-formed records per file"), ("rebuild-index", "index entries"), ("manifest", "files with checksums")):
        p = sub.add_parser(name, help=what)
        p.add_argument("path")
        p.add_argument("-n", type=int, default=20)
    for name in ("list-topics", "create-topic", "get-topic", "delete-topic", "set-retention"):
        p = sub.add_parser(name)
        p.add_argument("registry")
        if name != "list-topics":
            p.add_argument("topic")
        if name in ("create-topic", "set-retention"):
            p.add_argument("--max-age-secs", type=int, default=0)
            p.add_argument("--max-bytes", type=int, default=0)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if a.command == "manifest":
        return tlv.manifest(spark, a.path).orderBy("path").show(a.n, truncate=False)
    if a.command in ("scan", "dump", "verify", "rebuild-index"):
        records = tlv.read(spark, a.path)
        shown = {"scan": lambda: records.drop("payload"), "dump": lambda: records.select("path", "offset", "total_size", "record_type", F.hex("payload").alias("payload")), "verify": lambda: tlv.recovery_scan(records), "rebuild-index": lambda: tlv.rebuild_index(records)}[a.command]()
        return shown.orderBy(*[c for c in ("path", "offset") if c in shown.columns]).show(a.n, truncate=60)
    topics = TopicRegistry(spark, a.registry)
    if a.command == "create-topic":
        topics.create(a.topic, max_age_secs=a.max_age_secs, max_bytes=a.max_bytes)
    elif a.command == "delete-topic":
        topics.delete(a.topic)
    elif a.command == "set-retention":
        topics.set_retention(a.topic, a.max_age_secs, a.max_bytes)
    found = topics.list().orderBy("topic_id")
    return found.where(F.col("name") == a.topic).show(truncate=False) if a.command == "get-topic" else found.show(1000, truncate=False)


if __name__ == "__main__":
    main()

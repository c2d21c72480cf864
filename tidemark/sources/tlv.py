"""Type-length-value segments: columns to bytes, bytes to rows, recovery and index rebuild.

Layout (fixed values): type u8, length u32 little-endian, payload; type 0xFF: then extended type u16 and length u32, 7 bytes in all.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PAYLOAD = 16 << 20
EXTENDED = 0xFF
# The two tables of type codes.
CLIENT_TYPES = {0x01: "Data", 0x02: "Tombstone", 0x03: "Transaction", 0x04: "Checkpoint", 0x05: "Schema", 0x10: "Compressed"}
CORE_TYPES = {0x00: "Data", 0x01: "Json", 0x02: "MsgPack", 0x03: "Protobuf", 0x04: "Avro", 0xFE: "Control", 0xFF: "Extended"}
COMPRESSION = {0: "none", 1: "lz4", 2: "zstd"}
SCHEMA = "path string, type_byte int, record_type string, extended_type int, length long, payload binary, offset long, total_size long, error string"


def little_endian(value: Column, size: int) -> Column:
    """An unsigned integer as `size` bytes, lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def read_little_endian(data: Column, at: int, size: int) -> Column:
    """The unsigned integer at a 1-based place of a binary column; size under 8 (or the value below 2^63)."""
    digits = F.hex(F.substring(data, at, size))
    return F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]), 16, 10).cast("long")


def encode(type_byte: Column, payload: Column, extended_type: Column | None = None) -> Column:
    """A record as bytes."""
    size = little_endian(F.octet_length(payload), 4)
    short = F.concat(little_endian(type_byte, 1), size, payload)
    if extended_type is None:
        return short
    return F.when(extended_type.isNull(), short).otherwise(F.concat(F.unhex(F.lit("FF")), little_endian(extended_type, 2), size, payload))


def decode_header(data: Column) -> Column:
    """struct(type_byte, extended_type, length, header_size) of a record that begins a binary column; null if it is too short."""
    ext = read_little_endian(data, 1, 1) == EXTENDED
    short = F.octet_length(data) < F.when(ext, 7).otherwise(5)
    return F.when(~short, F.struct(read_little_endian(data, 1, 1).cast("int").alias("type_byte"), F.when(ext, read_little_endian(data, 2, 2)).cast("int").alias("extended_type"), F.when(ext, read_little_endian(data, 4, 4)).otherwise(read_little_endian(data, 2, 4)).alias("length"), F.when(ext, 7).otherwise(5).alias("header_size")))


def type_name(code: int, types: dict[int, str]) -> str:
    return types.get(code) or ("Data" if types is CORE_TYPES else "UserDefined" if 0x80 <= code <= 0xFE else "Unknown")


def parse(data: bytes, most: int = MAX_PAYLOAD, extended: bool = True, types: dict[int, str] = CLIENT_TYPES) -> Iterator[tuple]:
    """(type_byte, record_type, extended_type, length, payload, offset, total_size, error); stops at the first error."""
    at = 0
    while at < len(data):
        code, long = data[at], extended and data[at] == EXTENDED
        head = 7 if long else 5
        if len(data) - at < head:
            yield code, None, None, None, None, at, len(data) - at, "short header"
            return
        ext = struct.unpack_from("<H", data, at + 1)[0] if long else None
        size = struct.unpack_from("<I", data, at + head - 4)[0]
        if size > most or len(data) - at - head < size:
            yield code, None, ext, size, None, at, len(data) - at, "too large" if size > most else "short payload"
            return
        yield code, type_name(code, types), ext, size, data[at + head : at + head + size], at, head + size, None
        at += head + size


def read(spark: SparkSession, path: str, mode: str = "PERMISSIVE", most: int = MAX_PAYLOAD, extended: bool = True, core_types: bool = False) -> DataFrame:
    """Records of all segment files under a path; PERMISSIVE keeps the error row, DROPMALFORMED drops it, FAILFAST raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return records_of(files, mode, most, extended, core_types)


def records_of(files: DataFrame, mode: str = "PERMISSIVE", most: int = MAX_PAYLOAD, extended: bool = True, core_types: bool = False) -> DataFrame:
    """Records of segments (path, content); a task holds one segment at a time, records leave it 10,000 at once."""
    types = CORE_TYPES if core_types else CLIENT_TYPES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for r in parse(bytes(data), most, extended, types):
                    if r[-1] and mode == "FAILFAST":
                        raise ValueError(f"{path_}: {r[-1]} at {r[5]}")
                    if not (r[-1] and mode == "DROPMALFORMED"):
                        rows.append((path_, *r))
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return files.mapInPandas(run, SCHEMA)


def truncated(files: DataFrame, most: int = MAX_PAYLOAD) -> DataFrame:
    """path, content up to where it is valid, and dirty: whether anything was cut."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [sum(r[6] for r in parse(bytes(data), most) if r[-1] is None) for data in batch["content"]]
            kept = [bytes(data)[:end] for data, end in zip(batch["content"], ends, strict=True)]
            yield pd.DataFrame({"path": batch["path"], "content": kept, "dirty": [len(data) > end for data, end in zip(batch["content"], ends, strict=True)]})

    return files.mapInPandas(run, "path string, content binary, dirty boolean")


def wal_records(files: DataFrame) -> DataFrame:
    """path, data: the complete frames of write-ahead logs (path, content)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, data in zip(batch["path"], batch["content"], strict=True):
                frames = list(wal_frames(bytes(data)))
                yield pd.DataFrame({"path": [path_] * len(frames), "data": frames})

    return files.mapInPandas(run, "path string, data binary")


def is_data(type_byte: Column) -> Column:
    return type_byte == 0x01


def is_tombstone(type_byte: Column) -> Column:
    return type_byte == 0x02


def valid_payload(payload: Column, crc: Column) -> Column:
    """Whether a payload has the checksum (IEEE) that came with it."""
    return F.crc32(payload) == crc


def compressed(rows: DataFrame, algorithm: str) -> DataFrame:
    """rows with `packed`: header and compressed payload, by the algorithm that the named column gives."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = {name: code for code, name in COMPRESSION.items()}
        for batch in batches:
            yield batch.assign(packed=[struct.pack("<BI", codes[how], len(data)) + _codec(how, bytes(data), None) for how, data in zip(batch[algorithm], batch["payload"], strict=True)])

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("packed", T.BinaryType())]))


def decompressed(rows: DataFrame, most: int = MAX_PAYLOAD) -> DataFrame:
    """rows with the payload that `packed` holds; null where the header is cut or tells of more than `most` bytes."""
    def one(data: bytes) -> bytes | None:
        if len(data) < 5:
            return None
        code, size = struct.unpack_from("<BI", data)
        return None if size > most or code not in COMPRESSION else _codec(COMPRESSION[code], data[5:], size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(payload=[one(bytes(data)) for data in batch["packed"]])

    return rows.mapInPandas(run, rows.schema)


def _codec(how: str, data: bytes, size: int | None) -> bytes:
    """Compress (size is None) or decompress to that size."""
    if how == "none":
        return data
    codec = pa.Codec({"lz4": "lz4_raw", "zstd": "zstd"}[how])
    return codec.compress(data, asbytes=True) if size is None else codec.decompress(data, size, asbytes=True) if size else b""


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
    return frame.astype({"type_byte": "Int32", "extended_type": "Int32", "length": "Int64", "offset": "Int64", "total_size": "Int64"})


def recovery_scan(records: DataFrame) -> DataFrame:
    """Of each file: valid records and bytes, bytes to truncate, where it is corrupt."""
    good = F.col("error").isNull()
    return records.groupBy("path").agg(F.count_if(good).alias("records"), F.coalesce(F.sum(F.when(good, F.col("total_size"))), F.lit(0)).alias("valid_bytes"), F.coalesce(F.sum(F.when(~good, F.col("total_size"))), F.lit(0)).alias("truncated_bytes"), F.min(F.when(~good, F.col("offset"))).alias("corrupted_at"))


def rebuild_index(records: DataFrame, interval: int = 4096, bucket_ns: int = 10_000_000) -> DataFrame:
    """Index entries of decoded records: the time is the payload's first 8 bytes, 0 if it is shorter; sparse and timed mark the kinds."""
    order = Window.partitionBy("path").orderBy("offset")
    ts = F.when(F.octet_length("payload") >= 8, read_little_endian(F.col("payload"), 1, 8)).otherwise(0)
    rows = records.where("error IS NULL").withColumns({"record_index": F.row_number().over(order) - 1, "ts_ns": ts})
    before = F.lag(F.expr(f"ts_ns div {bucket_ns}")).over(order)
    rows = rows.withColumns({"sparse": F.col("record_index") % interval == 0, "timed": before.isNull() | (before != F.expr(f"ts_ns div {bucket_ns}"))})
    return rows.where("sparse OR timed").select("path", "record_index", "ts_ns", "offset", "sparse", "timed")


def wal_frames(data: bytes) -> Iterator[bytes]:
    """The complete frames [length u32 little-endian][data] of a write-ahead log; a cut tail ends it."""
    at = 0
    while at + 4 <= len(data):
        size = struct.unpack_from("<I", data, at)[0]
        if at + 4 + size > len(data):
            return
        yield data[at + 4 : at + 4 + size]
        at += 4 + size


def compression_header(data: Column) -> Column:
    """struct(algorithm, original_size) of a payload with the 5-byte header."""
    code = read_little_endian(data, 1, 1)
    name = F.when(code == 0, "none").when(code == 1, "lz4").when(code == 2, "zstd")
    return F.when(F.octet_length(data) >= 5, F.struct(name.alias("algorithm"), read_little_endian(data, 2, 4).alias("original_size")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, crc32 (IEEE) and whether the name is that of a sealed segment."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.crc32("content").alias("crc32"), F.col("path").rlike(r"/\d+_\d+-\d+\.lnc$").alias("sealed"))


def write_segments(records: DataFrame, path: str, mode: str = "append") -> None:
    """Records as Parquet, a folder per topic, in offset order within files, so that offset ranges prune row groups."""
    records.repartitionByRange("topic", "byte_offset").sortWithinPartitions("topic", "byte_offset").write.mode(mode).partitionBy("topic").option("compression", "zstd").parquet(path)


def export_topic(records: DataFrame, topic: str, path: str) -> None:
    """A topic's records and, beside them, a manifest of counts and sizes."""
    own = records.where(F.col("topic") == topic)
    own.write.mode("errorifexists").parquet(f"{path}/data")
    own.agg(F.lit(topic).alias("topic"), F.count("*").alias("records"), F.sum("total_size").alias("bytes")).write.json(f"{path}/manifest")


def import_topic(spark: SparkSession, path: str) -> DataFrame:
    """What export_topic wrote; raises if the manifest's count does not hold."""
    data, want = spark.read.parquet(f"{path}/data"), spark.read.json(f"{path}/manifest").first()
    if data.count() != want.records:
        raise ValueError(f"{path}: the manifest tells of {want.records} records")
    return data

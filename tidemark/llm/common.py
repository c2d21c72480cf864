"""Small helpers the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_staged: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, one of our own on a local master (tests); elsewhere an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and no lost executor takes rows along.

    The table lives until drop_staged(), or else until the Python process ends, be the session stopped by then or not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    context = spark.sparkContext
    driver_gives_back(spark)
    _staged.append((context._jvm.org.apache.hadoop.fs.Path(path), context._jsc.hadoopConfiguration()))
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """A mark for drop_staged(since)."""
    return len(_staged)


def drop_staged(since: int = 0, keep: int = 0) -> None:
    """Delete the tables staged after a mark but for the last `keep`; no DataFrame built on one may be used afterwards."""
    gone = _staged[since : len(_staged) - keep]
    del _staged[since : len(_staged) - keep]
    for where, conf in gone:
        where.getFileSystem(conf).delete(where, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Py4JError, OSError):  # the Java process may be gone, with it the way to the folder
        drop_staged()


def give_back() -> None:
    """Memory that is free in this process returns to the system, as far as its allocators do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def driver_gives_back(spark: SparkSession) -> str:
    """As give_back(), for the driver's processes; what the Java one says (empty if it has no such command: HotSpot on Linux does).

    Planning and compiling a query with many threads leaves memory (172 MB measured) with its allocator, that no heap setting bounds.
    """
    give_back()
    context = spark.sparkContext
    jvm, said = context._jvm, ""
    with contextlib.suppress(Py4JError, PySparkException):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = context._gateway.new_array(jvm.java.lang.Object, 4)  # no arguments, no signature
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        said = str(invoke.invoke(server, args))
    return said


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives its memory back when it ends: Spark's workers live on from stage to stage."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def apart(docs: DataFrame, prefix: str = "__") -> DataFrame:
    """docs whose columns named like ours, which begin with `prefix`, are called as apart_names() says."""
    new = apart_names(docs.columns, prefix)
    return docs.toDF(*[new[c] for c in docs.columns]) if any(k != v for k, v in new.items()) else docs


def apart_names(columns: list[str], prefix: str = "__") -> dict[str, str]:
    """Column -> its name in the result: `in_` stands before names that begin with `prefix`, as often as they are taken."""
    taken = {c.lower() for c in columns}
    out = {}
    for c in columns:
        new = c
        while new.lower().startswith(prefix) or (new != c and new.lower() in taken):
            new = f"in_{new}"
        taken.add(new.lower())
        out[c] = new
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def whole(c: Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: what a lambda refers to would else be computed for each of its elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack_words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none: an empty array."""
    bare = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id is -1 and so is in no fold that is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1)).cast("int")


def parts(rows: int, per: int) -> int:
    return max(1, math.ceil(rows / per))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""Ordered folds: running state that windows cannot express, per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where a row's key differs from that of the row before; nulls are alike."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for key in keys:
        c = batch.column(key)
        null = c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    return np.flatnonzero(new).tolist()


def fold(df: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable[[pd.DataFrame, dict], pd.DataFrame]) -> DataFrame:
    """step(rows, state) over the rows of each key in order, a batch at a time; state is empty at a key's first rows.

    A key's rows pass through one task as a stream: Spark sorts them, on disk if they are many, Python holds one batch.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, {}
        for batch in batches:
            starts = _starts(batch, keys) if batch.num_rows else []
            for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                rows = batch.slice(at, end - at)
                key = tuple(rows.column(k)[0].as_py() for k in keys)
                if key != held:
                    held, state = key, {}
                yield pa.RecordBatch.from_pandas(step(rows.to_pandas(), state), arrow, preserve_index=False)

    return df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order]).mapInArrow(run, schema)

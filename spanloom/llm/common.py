"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: words are maximal runs of anything else. ``bytes.split()`` uses the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a Python function works on at once; a longer text is one slice by itself.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about SLICE_BYTES of ``name``, so that memory doesn't follow the batch."""
    if not batch.num_rows:
        return
    column = batch.column(name)
    measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    sizes = pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for low, high in zip(bounds, bounds[1:], strict=False):
        yield batch.slice(low, high - low)


#: Setting and value of the bytes in one Arrow batch, set where the session has Spark's own default; that suits narrow rows, not texts.
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def in_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches small enough for texts."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once in each task and returns the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, text) if text else [batch] * bool(batch.num_rows):
                yield f(part)

    return in_arrow(df, run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null read as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def fold(column: Column | str, n: int) -> Column:
    """The remainder of crc32 of an id as text, by which rows are held out; a null id counts as remainder 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def row_key(*names: str) -> Column:
    """64-bit key of a row by its own content, never null: rows with the same content share it."""
    parts = [p for n in names for p in (F.col(n), F.col(n).isNull())]
    return F.xxhash64(*parts)


def fresh(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores more as no column, in either case, has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name

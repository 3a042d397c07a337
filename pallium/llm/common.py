"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.session import ensure_checkpoint_dir

#: Files that operators read on the driver and ship to tasks may not exceed this.
MAX_SHIPPED_BYTES = 64 * 1024 * 1024


def read_shipped(path: str) -> bytes:
    """A bounded parameter file (vocabulary) for shipping to the tasks."""
    size = os.path.getsize(path)
    if size > MAX_SHIPPED_BYTES:
        raise ValueError(f"{path}: {size} bytes, over the {MAX_SHIPPED_BYTES} that are shipped to tasks")
    with open(path, "rb") as f:
        return f.read()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage: later jobs read the files, whichever executors are lost.
    The files are removed when the application ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/pallium-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Results are computed when they are wanted, so the files go with the application.
    if hasattr(spark, "_jvm"):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, null text as the empty one.

    Extra columns, whatever their names, are left behind here.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in smaller ones, for work that copies a batch's values."""
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def give_back() -> None:
    """Return a worker's free memory to the system: workers stay for later
    tasks, and their peaks would add up beside the JVM's heap."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def packed(values: np.ndarray, kind: str) -> bytes:
    """Little-endian bytes of an array, for a binary column."""
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def streamed_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in a partition sorted by ``keys``, one at a time.

    Many small groups share one Python task this way, and no more than one
    group and one batch are held in memory.
    """
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a].as_py() for c in columns)
            if current is not None and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if current is not None:
        yield current, pa.Table.from_batches(held)
    held = []
    give_back()


def fixed_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small declared table (rules, templates) as a DataFrame."""
    return spark.createDataFrame(rows, schema)

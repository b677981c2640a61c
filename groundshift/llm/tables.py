"""Helpers shared by the operators: shared storage, worker state, batches of text."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.session import ensure_checkpoint_dir

# A lookup table goes to every executor only up to this many counted rows; beyond it is joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to shared storage and read it back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The table with a (file, row) column that tells its rows apart, written once so that later jobs read the same numbers."""
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return stored(df.withColumn(name, number), "numbered")


def file_rows(df: DataFrame, name: str) -> DataFrame:
    """As `numbered`, without writing, for a table as read from files or a filter or projection of one; others are written.

    File (64 bits of its path) and row within it do not depend on how files are cut and packed into tasks, as numbers from
    monotonically_increasing_id do, which is why these may not be computed twice over a table. Do not pass a join of files.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.withColumn(name, place)
    except AnalysisException:  # not read from files
        return numbered(df, name)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the table, counted, has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def worker_state(key: str, make: Callable):
    """An object that a reused Python worker keeps from task to task, such as a loaded vocabulary.

    A worker keeps one such object at a time, so operators that follow each other do not add up in memory.
    """
    home = sys.modules.setdefault("_groundshift_worker_state", types.ModuleType("_groundshift_worker_state"))
    kept = vars(home).setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def release_worker_state() -> None:
    """Let a reused Python worker forget what an earlier operator kept; for operators that keep nothing."""
    home = sys.modules.get("_groundshift_worker_state")
    if home is not None:
        vars(home).get("kept", {}).clear()


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `limit` bytes of the text column, whole rows always."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *cuts.tolist(), len(batch)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)

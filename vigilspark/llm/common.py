"""Shared plumbing of the training-data operators: checkpoints, Arrow batch limits, table access."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised kernel looks at in one go; its scratch arrays are some 30 times that.
SLICE_BYTES = 2 << 20
#: Bytes and rows that the JVM puts into one Arrow batch.
BATCH_BYTES, BATCH_ROWS = "16m", "4000"
#: A key of fewer rows is never dealt over several tasks.
LEAST_HOT = 1000
#: Collections of garbage, and the seconds that the JVM's cleaner gets after each, until shuffle files are gone; two in a row left them.
ROUNDS, PAUSE = 5, 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes as well as rows, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names; one of our own only if it names none (tests)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Shuffle files and checkpoints of earlier rounds go once nothing refers to them and both sides have collected their garbage; a long loop would pile them up."""
    for _ in range(ROUNDS):  # the JVM hears which of Python's references are gone; its cleaner then lets go of what refers to a shuffle
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(PAUSE)


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """counts (key, n) of `total` rows -> (__key, __salts) of the keys that have more rows than an average shuffle partition, None if there are none.

    There can't be more of them than shuffle partitions, so the driver may hold and broadcast them.
    """
    most = max(LEAST_HOT, total // int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1)
    hot = counts.where(F.col("n") > most).select(F.col(key).alias("__key"), F.ceil(F.col("n") / most).cast("int").alias("__salts"))
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def join_dealt(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined (inner, left or left_semi) to `one`, which has a row for each key; the rows of a hot key are dealt over several tasks, with a copy of its row of `one` for each."""
    if hot is None:
        return rows.join(one, key, how)
    salts = F.coalesce("__salts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("__key", "__salts")
    copies = one.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__key", "__salts")
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the offsets of its rows in them; no copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        raise TypeError(f"not a text column: {column.type}")
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of at most `limit` bytes of text (one row at least), each with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = binary_buffers(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def map_slices(df: DataFrame, kernel: Callable[..., pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over slices(): kernel(batch, bytes, offsets) -> batch or None."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            if (out := kernel(*part)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def batch_of(batch: pa.RecordBatch, keep: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """The named columns of a batch, then new ones."""
    have = {c: batch.column(batch.schema.get_field_index(c)) for c in keep} | columns
    return pa.RecordBatch.from_arrays(list(have.values()), names=list(have))

"""Helpers that several operators share: shared scratch tables, Arrow chunks, bounded filters."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step works on at once; a longer text is one chunk by itself.
CHUNK_BYTES = 1 << 20
#: Bytes of text after which a worker gives free memory back.
TRIM_BYTES = 4 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Give what the worker has freed back to the machine: workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session, ``spark.checkpoint.dir``.

    Where none is set, a local session (as in tests) gets a folder of its own; on a cluster that is
    an error, for executors don't share a machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-siembra-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs a re-read of the table instead of another run of what made it,
    and later readers see the same rows in the same order and partitions. ``discard`` deletes
    the table once all that reads it is itself written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise``; call it only when everything that reads them is written."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            jvm, spark = table.sparkSession._jvm, table.sparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Bytes of an Arrow batch between Spark and a Python worker; a longer row is a batch by itself.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, so that long texts don't fill an executor's memory.

    Only Spark's own default (64 MB) is lowered; a limit that the user chose stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def named(column: str) -> F.Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_of(column: str) -> F.Column:
    """The whole text; null counts as empty."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets (rows + 1) of a string array without nulls."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    _, where, data = strings.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches with at most ``limit`` bytes of text, each with its bytes and offsets."""
    seen, data = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffers(batch.column(column))
        seen += len(data)
        if seen > TRIM_BYTES:
            seen = 0
            give_back()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    batch = data = None
    give_back()


def bit_filter(keys: DataFrame, key: str, words: int = 1 << 17) -> DataFrame:
    """One row, one column ``bits``: a filter of 64 * ``words`` bits that holds every key.

    Its size is fixed by ``words`` (1 MB by default), whatever the input; with more keys more
    other values pass, none of the keys ever fails. Use it through ``may_hold`` only to
    keep rows from a shuffle, before an exact join or grouping.
    """
    spark = keys.sparkSession
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(64 * words))
    set_bits = keys.select(F.shiftright(bit, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    dense = spark.range(words).withColumnRenamed("id", "word").join(set_bits, "word", "left").select("word", F.coalesce("mask", F.lit(0)).alias("mask"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("bits"))


def may_hold(bits: DataFrame, key: F.Column, words: int = 1 << 17) -> F.Column:
    """Whether the filter of ``bit_filter`` may hold ``key``; false only if it doesn't."""
    bit = F.pmod(F.xxhash64(key), F.lit(64 * words))
    word = F.get(bits.scalar(), F.shiftright(bit, 6).cast("int"))
    return F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

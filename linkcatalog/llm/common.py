"""Shared helpers of the training-data operators: tables, shared storage, hot-safe ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcatalog.operators.ranks import global_rank  # noqa: F401
from linkcatalog.storage import new_path

SEP_CLASS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage for good."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of the hashes by which rows are shuffled: fifteen hex digits of an md5, which SQL has as well.
HASH_BITS = 60


def shuffle_hash(seed: int, *parts):
    """0 to 2**60 - 1, by the md5 of the parts between colons; null parts are blank."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed)))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("long")


def hash_bucket(h, n_buckets: int):
    """Order-preserving bucket from 0 on of a HASH_BITS hash column, ``n_buckets`` at most."""
    return F.call_function("div", h, F.lit(-(-(1 << HASH_BITS) // n_buckets)))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def byte_chunks(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` text bytes each; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    _, offs = utf8_parts(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to

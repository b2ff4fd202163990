"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share: the one that the cluster names in ``spark.checkpoint.dir``.

    Only where driver and executors are one process (tests) may that be unset; a local folder serves there. On a cluster
    other machines could not read it, so that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "rarebucket-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Folders of intermediate tables that are still there.
_kept: list[str] = []


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back. ``forget`` or ``tidy`` removes the files."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if path := folder_of(out):
        _kept.append(path)
    return out


def folder_of(df: DataFrame) -> str | None:
    """Where the rows of a table made by ``reliable`` lie."""
    plan = df._jdf.queryExecution().logical()
    found = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    return found.get() if found is not None and found.isDefined() else None


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables made by ``reliable`` that nothing reads any more."""
    for df in tables:
        if (path := folder_of(df)) in _kept:
            _kept.remove(path)
            removed(df.sparkSession, path)


def tidy(spark: SparkSession, since: int = 0, but: Sequence[DataFrame] = ()) -> None:
    """Remove all intermediate tables made after the first ``since`` ``but`` these; what still reads them must have been written."""
    stay = {folder_of(df) for df in but}
    for path in [p for p in _kept[since:] if p not in stay]:
        _kept.remove(path)
        removed(spark, path)


def kept_tables() -> int:
    return len(_kept)


def pieces(batches: Iterable[pa.RecordBatch], column: int, most: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text (or one row) and ``rows`` rows each.

    Spark bounds an Arrow batch in bytes (``spark.sql.execution.arrow.maxBytesPerBatch``); array work takes
    many times a text's size, so operators go on in slices, which copy nothing.
    """
    for batch in batches:
        ends = utf8(batch.column(column))[1]
        a = 0
        while a < len(batch):
            b = min(a + rows, max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1))
            yield batch.slice(a, b - a)
            a = b


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def numbered(rows: DataFrame, many: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Each row ``many`` times, with ``name`` from 0; in blocks, so that no array is long however often a row occurs."""
    out = rows.withColumn(f"{name}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(many) - 1) / block).cast("long"))))
    first = F.col(f"{name}_block") * block
    return out.withColumn(name, F.explode(F.sequence(first, F.least(F.col(many), first + block) - 1))).drop(f"{name}_block")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column on end, and the n + 1 offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, (_, where, data) = len(column), column.buffers()
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (three xor-shifts and two odd multipliers), in wrap-around arithmetic."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))

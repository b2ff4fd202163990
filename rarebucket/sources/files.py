"""Files by path, on local disks and in any store that Arrow knows, and their checksums."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def opened(path: str, stream: bool = False):
    """A file for reading; ``stream`` unpacks it by its extension (gz, bz2, zst) and can't seek."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))
    return store.open_input_stream(name) if stream else store.open_input_file(name)


def listed(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files that a path, folder, pattern or list of them names, empty ones included; FileNotFoundError if one names none."""
    out = []
    for one in [path] if isinstance(path, str) else path:
        where = spark._jvm.org.apache.hadoop.fs.Path(one)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = store.globStatus(where)
        if not found:
            raise FileNotFoundError(f"no such path: {one}")
        for status in found:
            if status.isFile():
                out.append(status.getPath().toString())
                continue
            inside = store.listFiles(status.getPath(), True)
            while inside.hasNext():
                name = inside.next().getPath()
                if name.getName()[0] not in "._":
                    out.append(name.toString())
    return sorted(set(out))


def checksums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, sha256) of files of any size, each read in pieces by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with opened(name) as f:
                    while piece := f.read(4 << 20):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "sha256"])

    names = listed(spark, path)
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names))).mapInArrow(run, "path string, sha256 string")

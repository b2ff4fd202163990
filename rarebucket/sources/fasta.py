"""FASTA and FASTQ text. Header lines are left out; the records of a file follow each other as one sequence.

Plain FASTA is read in byte ranges apart from each other. Packed files (gz, bz2, zst) and FASTQ, whose records can only be told apart
from the start, are one task's work each, read in pieces of the same size. FASTQ records have four lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rarebucket.functions.registers import checked_k
from rarebucket.functions.sequences import exploded, kmers, statistics
from rarebucket.sources.files import listed, opened

PACKED = (".gz", ".bz2", ".zst")


def sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, sequence): a row per file, for files that fit a row. A missing path raises AnalysisException."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    fastq = F.array_join(F.filter(F.split("value", "\n"), lambda _, i: i % 4 == 1), "\n")
    return rows.select("path", F.when(F.col("value").startswith("@"), fastq).otherwise(F.regexp_replace("value", r"(?md)^>.*$", "")).alias("sequence"))


def parsed(spark: SparkSession, path: str | list[str], k: int) -> DataFrame:
    """(path, kmers, bases, valid_kmers, invalid_windows) per file."""
    rows, text = sequences(spark, path), F.col("sequence")
    return rows.select("path", kmers(text, k).alias("kmers"), *[c.alias(n) for n, c in statistics(text, k).items()])


class FastaRange(InputPartition):
    """Bytes ``start`` to ``end`` of a file; ``end`` None: the whole file, in order."""

    def __init__(self, path: str, start: int, end: int | None) -> None:
        self.path, self.start, self.end = path, start, end


def characters(data: bytes) -> bytes:
    return data.translate(None, b" \t\r\n")


class FastaReader(DataSourceReader):
    """Each range gets the k sequence characters before it as its head."""

    def __init__(self, options: dict) -> None:
        self.files = json.loads(options["files"]) if "files" in options else [options["path"]]
        self.k, self.size = checked_k(int(options.get("k", 25))), int(options.get("chunk_bytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files:
            if path.endswith(PACKED):
                out.append(FastaRange(path, 0, None))
                continue
            with opened(path) as f:
                n, fastq = f.size(), f.read(1) == b"@"
            out += [FastaRange(path, 0, None)] if fastq else [FastaRange(path, a, min(n, a + self.size)) for a in range(0, max(n, 1), self.size)]
        return out or [FastaRange("", 0, 0)]  # Spark reads a source without partitions by one that is None

    @staticmethod
    def body(data: bytes, inside: bool, fresh: bool) -> bytes:
        """The sequence characters of a range. ``inside``: it starts within a header line; ``fresh``: with a line's first byte.

        A > is a header only as a line's first byte, so one that merely comes first in the range is a character like others.
        """
        first, *lines = data.split(b"\n")
        kept = [b"" if inside or fresh and first.startswith(b">") else first, *(line for line in lines if not line.startswith(b">"))]
        return characters(b"".join(kept))

    @staticmethod
    def line_of(f, at: int) -> tuple[bool, bool]:
        """Whether the byte at ``at`` lies in a header line that starts before it, and whether it is a line's first."""
        end = at
        while end:
            start = max(0, end - (1 << 16))
            f.seek(start)
            cut = f.read(end - start).rfind(b"\n")
            if cut >= 0:
                f.seek(start + cut + 1)
                fresh = start + cut + 1 == at
                return not fresh and f.read(1) == b">", fresh
            end = start
        f.seek(0)
        return at > 0 and f.read(1) == b">", at == 0

    def part(self, f, start: int, end: int) -> bytes:
        inside, fresh = self.line_of(f, start)
        f.seek(start)
        return self.body(f.read(end - start), inside, fresh)

    def read(self, partition: FastaRange) -> Iterator[tuple]:
        if not partition.path:
            return
        if partition.end is None:
            yield from self.in_order(partition.path)
            return
        with opened(partition.path) as f:
            head, begin = b"", partition.start
            while begin and len(head) < self.k:
                start = max(0, begin - (1 << 16))
                head, begin = self.part(f, start, begin) + head, start
            body = self.part(f, partition.start, partition.end)
        yield partition.path, partition.start, head[-self.k :].decode("latin-1"), body.decode("latin-1")

    def in_order(self, path: str) -> Iterator[tuple]:
        """The pieces of a file that is read from its start. A line may be cut by the end of a piece."""
        head, offset, line, header, fresh, fastq = b"", 0, 0, False, True, False
        with opened(path, stream=True) as f:
            while data := f.read(self.size):
                if not offset:
                    fastq = data.startswith(b"@")
                kept = []
                for i, text in enumerate(data.split(b"\n")):
                    if i:
                        line, fresh = line + 1, True
                    if fresh and text:
                        header = line % 4 != 1 if fastq else text.startswith(b">")
                        fresh = False
                    if not header:
                        kept.append(text)
                body = characters(b"".join(kept))
                yield path, offset, head.decode("latin-1"), body.decode("latin-1")
                head, offset = (head + body)[-self.k :], offset + len(data)
        if not offset:
            yield path, 0, "", ""


class FastaSource(DataSource):
    """``spark.read.format("fasta")`` with options path (or files, a JSON list), k and chunk_bytes: rows of (path, offset, head, body)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "path string, offset long, head string, body string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


def ranges(spark: SparkSession, path: str | list[str], k: int, chunk_bytes: int = 32 << 20) -> DataFrame:
    """Ranges of the files that a path, folder, pattern or list of them names."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").options(files=json.dumps(listed(spark, path)), k=str(k), chunk_bytes=str(chunk_bytes)).load()


def range_kmers(rows: DataFrame, k: int) -> DataFrame:
    """(path, kmer): a row per k-mer that ends in the range."""
    return exploded(rows.select("path", F.concat(F.right("head", F.lit(k - 1)), "body").alias("sequence")), "sequence", k, "path")


def range_statistics(rows: DataFrame, k: int) -> DataFrame:
    """(path, bases, valid_kmers, invalid_windows) of whole files, summed over their ranges."""
    both, head = statistics(F.concat("head", "body"), k), statistics(F.col("head"), k)
    return rows.groupBy("path").agg(*[F.sum(both[n] - head[n]).alias(n) for n in both])

"""k-mers of DNA text: canonical, two bits a base, in at most 62 bits.

White space is skipped, letter case doesn't matter, and every other character that isn't A, C, G or T ends a run. Windows
of length k lie within a run. Records of a file follow each other as one sequence.

``kmers`` gives a sequence's k-mers as an array, with SQL functions alone. ``exploded`` gives a row per k-mer and packs all windows of
an Arrow batch by k shifts of whole arrays, many times as fast on genomes; both give the same k-mers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebucket.functions.registers import checked_k

BASES, CODES, COMPLEMENTS = "ACTG", "0123", "2301"


def cleaned(sequence: Column) -> Column:
    return F.upper(F.regexp_replace(sequence, "[ \\t\\r\\n]", ""))


def runs(sequence: Column) -> Column:
    """The maximal stretches between invalid characters, empty ones included."""
    return F.split(cleaned(sequence), "[^ACGT]", -1)


def digits(bases: Column) -> Column:
    return F.translate(bases, BASES, CODES)


def packed(base4: Column) -> Column:
    return F.conv(base4, 4, 10).cast("long")


def forward(bases: Column) -> Column:
    return packed(digits(bases))


def reverse_complement(bases: Column) -> Column:
    return packed(F.translate(F.reverse(digits(bases)), CODES, COMPLEMENTS))


def reverse_complement_packed(value: Column, k: int) -> Column:
    """The same on a packed k-mer: pairs of bits in reverse order, the upper bit of each flipped."""
    k = checked_k(k)
    step = lambda acc, i: F.shiftleft(acc, 2).bitwiseOR(F.call_function("shiftright", value, (i * 2).cast("int")).bitwiseAND(F.lit(3).cast("long")).bitwiseXOR(F.lit(2).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0).cast("long"), step)


def canonical(bases: Column) -> Column:
    return F.greatest(forward(bases), reverse_complement(bases))


def kmers(sequence: Column, k: int) -> Column:
    """All canonical k-mers of a sequence in order."""
    k = checked_k(k)
    windows = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - k + 1), lambda i: canonical(F.substr(run, i, F.lit(k))))
    return F.flatten(F.transform(long_runs(sequence, k), windows))


def long_runs(sequence: Column, k: int) -> Column:
    return F.regexp_extract_all(cleaned(sequence), F.lit(f"[ACGT]{{{k},}}"), F.lit(0))


def statistics(sequence: Column, k: int) -> dict[str, Column]:
    """bases, valid_kmers and invalid_windows. A window is invalid if an invalid character cuts it short; what the end cuts isn't."""
    k, text = checked_k(k), cleaned(sequence)
    total = F.aggregate(long_runs(sequence, k), F.lit(0).cast("long"), lambda acc, x: acc + F.length(x) - k + 1)
    short = F.regexp_count(text, F.lit(f"(?<![ACGT])[ACGT]{{1,{k - 1}}}(?=[^ACGT])")) if k > 1 else F.when(text.isNotNull(), F.lit(0))
    return {"bases": F.length(F.regexp_replace(text, "[^ACGT]", "")).cast("long"), "valid_kmers": total, "invalid_windows": short.cast("long")}


#: Codes of bytes: 0-3 for bases of either case, SKIP for white space, else STOP.
SKIP, STOP = 254, 255
BYTE_CODES = np.full(256, STOP, np.uint8)
BYTE_CODES[[9, 10, 13, 32]] = SKIP
for _code, _base in enumerate(BASES):
    BYTE_CODES[[ord(_base), ord(_base.lower())]] = _code
#: Windows that are packed at once.
SLICE = 1 << 20


def packed_windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, canonical k-mer) of all windows of codes without a STOP."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stops = np.concatenate([[0], np.cumsum(codes == STOP)])
    start = np.flatnonzero(stops[k:] == stops[:-k])
    wide, one, other = codes.astype(np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(k):
        one = one << 2 | wide[i : i + n] & 3
        other |= (wide[i : i + n] & 3 ^ 2) << 2 * i
    return start, np.maximum(one, other)[start]


def exploded(df: DataFrame, sequence: str, k: int, *keep: str) -> DataFrame:
    """A row per k-mer: the kept columns and the k-mer. Null sequences have none."""
    k = checked_k(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(b or b"") for b in batch.column(0).cast(pa.binary()).to_pylist()]
            flat = np.frombuffer(b"\0".join(texts), np.uint8)  # the joints are stops, so no window crosses them
            ends = np.cumsum([len(t) + 1 for t in texts])
            codes, row = np.zeros(0, np.uint8), np.zeros(0, np.int64)
            for a in range(0, len(flat), SLICE):  # only a slice at a time is widened
                piece = BYTE_CODES[flat[a : a + SLICE]]
                used = np.flatnonzero(piece != SKIP)
                codes, row = np.concatenate([codes, piece[used]]), np.concatenate([row, np.searchsorted(ends, a + used, "right")])
                start, kmer = packed_windows(codes, k)
                at = pa.array(row[start])
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), pa.array(kmer)], names=[*batch.schema.names[1:], "kmer"])
                codes, row = codes[len(codes) - min(k - 1, len(codes)) :], row[len(row) - min(k - 1, len(row)) :]

    rows = df.select(F.col(sequence).cast("string").alias("sequence"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, kmer long" if keep else "kmer long")

"""Media columns: byte payloads kept as lossless WebP images, read back as pixel arrays, with features of the pixels.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, are the samples of an image of 144 ARGB
pixels a row. An image holds 16,384 rows at most, so a payload of over 9.4 MB is several files on end. Transforms and
colour cache are chosen for each image by its own samples. Everything that is
reported about the payload comes from decoding the stored bytes: prefix codes, back-references and cache, then the inverse transforms.

Null and empty texts are one row of bytes 255. Equal texts have equal files, whatever they are stored next to.
Repeated rows give repeated results, an empty table an empty one; other columns are not read, whatever their names. A long text is
never cut: its images are written and read one after the other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebucket.llm.common import pieces, utf8
from rarebucket.llm.webp import ROW, SIDE, decode, encode_payloads, samples_of

#: Payload bytes that are written by one set of array operations.
PART = 1 << 20


def padded(body: bytes) -> bytes:
    return body + b"\xff" * (max(ROW, -(-len(body) // ROW) * ROW) - len(body))


def store(bodies: list[bytes]) -> list[bytes]:
    """The stored form of each payload: one file, or several on end."""
    out, held, files = [], [], []

    def write() -> None:
        files.extend(encode_payloads(np.frombuffer(b"".join(held), np.uint8), [len(h) // ROW for h in held]))
        held.clear()

    counts = []
    for payload in map(padded, bodies):
        tiles = [payload[a : a + SIDE * ROW] for a in range(0, len(payload), SIDE * ROW)]
        counts.append(len(tiles))
        for tile in tiles:
            held.append(tile)
            if sum(map(len, held)) > PART:
                write()
    if held:
        write()
    at = 0
    for n in counts:
        out.append(b"".join(files[at : at + n]))
        at += n
    return out


def load(stored: bytes) -> list[np.ndarray]:
    """The pixel arrays of a stored form."""
    images, at = [], 0
    while at < len(stored):
        image, size = decode(stored[at:] if at else stored)
        images.append(image)
        at += size
    return images


def feature(samples: np.ndarray, rows: int) -> str:
    """Size, mean and standard deviation of the samples, their entropy in bits, and the mean sample of each eighth of the payload."""
    counts = np.bincount(samples, minlength=256)
    n, value = len(samples), np.arange(256)
    mean = float(counts @ value) / n
    deviation = max(0.0, float(counts @ (value * value)) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    eighths = samples.reshape(8, -1).mean(1)
    return f"{ROW // 4}x{rows};mean={mean:.3f};sd={deviation:.3f};entropy={abs(float(-(share * np.log2(share)).sum())):.3f};profile={'-'.join(f'{x:.0f}' for x in eighths)}"


def media_column(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the stored form of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            body, ends = utf8(batch.column(1))
            bodies = [body[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(store(bodies), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, pixels): the ARGB pixels of each image; images of one payload are stacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            images = [np.concatenate(load(m)) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.shape[0] for i in images], pa.int32()), pa.array([i.shape[1] for i in images], pa.int32()), pa.array([i.ravel().astype(np.int64) for i in images], pa.list_(pa.int64()))],
                names=["doc_id", "height", "width", "pixels"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, height int, width int, pixels array<long>")


def inspected(media: DataFrame) -> DataFrame:
    """What the stored bytes give back: size and digests of the payload, of the stored form, and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            rows = []
            for stored in batch.column(2).to_pylist():
                images = load(stored)
                payload = b"".join(map(samples_of, images))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(payload, np.uint8), sum(len(i) for i in images))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

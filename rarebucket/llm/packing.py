"""Best-fit packing by sums of squares: whole documents into token sequences.

Documents become tokens in one pass; of a document longer than a sequence only the first piece
can be shorter than a sequence. Pieces are packed in groups of about ``group_docs`` documents,
dealt by a hash of all that is known of a piece and, for equal pieces, their number. So groups are alike whatever the sources,
and no source, id (null ones included) or run of copies meets in one task. Within a group each piece goes where
the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of open sequences that
have g free places. Pieces come by falling length, and one that fits an open sequence opens no new one.

Null or empty texts are the end token alone. Repeated rows (equal ids included) are packed each on
its own, in groups dealt apart. An empty table gives an empty result. Columns other than the id and the text are not read.
Bytes that aren't UTF-8 count as U+FFFD. Strings of added tokens, such as ``<|endoftext|>``, become their ids if ``added`` is
set, as in the registered queries; otherwise they are ordinary text.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebucket.llm.common import numbered, pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def load_encoder(ranks_path: str | None = None, added: bool = False):
    """Encoder of the byte-level vocabulary of 50,257 entries.

    The rank file holds the vocabulary of ``byte_bpe_50k.json``; this encoder gives the ids of
    ``tokenizers`` about four times as fast, and the tests compare the two. With ``added`` the added tokens
    of that file are found in texts, as ``tokenizers`` does unless ``encode_special_tokens`` is set.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    special: dict[str, int] = {}
    if added:
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as whole:
            tokens = json.load(whole)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
            raise ValueError("added tokens that take in spaces or need whole words are not supported")
        special = {t["content"]: t["id"] for t in tokens}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all are of ``capacity`` but the first, which has what is over."""
    first = len(ids) % capacity or min(capacity, len(ids))
    starts = [0, *range(first, len(ids), capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


def tokenized(docs: DataFrame, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None, added: bool = False) -> DataFrame:
    """One row per piece, with a checksum of its ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in pieces(batches, 1):
            encoder = encoder or load_encoder(ranks_path, added)
            rows: list[tuple] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = np.array([*encoder.encode((body or b"").decode("utf-8", "replace"), allowed_special="all"), end_id], "<u4")
                rows += [(key, k, a, n, zlib.crc32(ids[a : a + n])) for k, (a, n) in enumerate(cut(ids, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: list[int], capacity: int, fill: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item, taken in the order given; among equal choices the fuller sequence.

    With ``fill`` a new sequence opens only for an item that fits no open one, which suits items by falling length;
    without, opening one is a choice like the others, which suits endless streams.
    """
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    places, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths):
        gaps = n + np.flatnonzero(count[n:capacity])
        best, change = capacity, 2 * count[capacity - n] + 1 if n < capacity else 0
        if len(gaps):
            after = gaps - n
            each = 1 - 2 * count[gaps] + np.where(after > 0, 2 * count[after] + 1, 0)
            k = int(each.argmin())
            if fill or each[k] <= change:
                best = int(gaps[k])
        if best == capacity:
            where, made = made, made + 1
        else:
            where = open_by_gap[best].pop()
            count[best] -= 1
        places[i], offsets[i] = where, capacity - best
        if best > n:
            open_by_gap[best - n].append(where)
            count[best - n] += 1
    return places, offsets


def pack(pieces: DataFrame, groups: int, capacity: int = 1024) -> DataFrame:
    """Sequence and offset of each piece; groups of pieces are packed apart from each other."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "deal", "doc_id", "piece", "ids_crc32", "start"], ascending=[False, True, True, True, True, True], ignore_index=True)
        places, offsets = sum_of_squares(rows["length"].tolist(), capacity)
        rows["sequence_id"] = (rows["group"] * (1 << 32)) + places
        rows["offset"] = offsets
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    known = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # equal pieces are counted, which the tasks do for what they read, and then numbered; which is which doesn't matter
    dealt = numbered(pieces.groupBy(*known).agg(F.count("*").alias("equal")), "equal", "nth")
    dealt = dealt.withColumn("deal", F.xxhash64(*known, "nth")).withColumn("group", F.pmod("deal", F.lit(groups))).drop("equal", "nth")
    return dealt.groupBy("group").applyInPandas(run, PACKED)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, group_docs: int = 32768, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    groups = max(1, -(-docs.count() // group_docs))
    return pack(tokenized(docs, capacity, end_id, doc_id, text, added=added), groups, capacity)

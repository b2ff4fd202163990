"""Language-model scoring by stupid backoff, against n-gram counts of the whole corpus.

A word that follows two others scores f(abc) / f(ab) if the trigram occurs at least ``LEAST`` times, else 0.4 f(bc) / f(b) if the bigram
does, else 0.4 * 0.4 f(c) / N; the first words of a text start at the order that they have. A document's score is the
sum of the logarithms.

1. Every ``CHUNK`` bytes of what a task reads are a chunk, bundled and compressed. A chunk explodes its texts into n-grams
   and collapses equal ones, so a frequent n-gram moves once per chunk, however many documents have it.
2. The count tables are partitioned by n-gram hash: the relation (n, hash, count) is dealt by ranges of the hash, in rows that hold
   all of a chunk's n-grams of one order and partition, and a partition adds up equal hashes. ``count_table`` gives it with a row per n-gram.
3. The join with the exploded n-grams is on (partition, hash) too: the partition gives each chunk the totals of the n-grams
   that it has, in their order, and the chunk sums them per document.

With a row per n-gram the join alone would move 14 bytes for each of 2.3 distinct n-grams a word and chunk, twice; rows of
n-grams in order need 6, since sorted hashes are stored as differences.

Words are lower-cased (A-Z) runs without white space. N-grams are hashed to 64 bits, whatever the corpus.
Null texts and texts without words score 0 over 0 words. Repeated rows count, and are scored, as often as they occur. Ties don't
matter, since nothing is ranked. An empty table gives an empty result. Other columns
are not read, whatever their names. A chunk holds whole documents, so its memory is bounded by ``CHUNK`` or the longest document.
Chunks are cut from what tasks read, so an input whose rows come out of a shuffle, and could come in another order if an executor
is lost, is written to the shared folder first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebucket.llm.common import WORD, mixed, reliable, utf8
from rarebucket.llm.shingles import words

CHUNK, PART = 9 << 20, 3_000_000
BACKOFF, LEAST, ORDER = 0.4, 2, 3
#: Bytes of a chunk that are hashed at once.
PIECE = 1 << 20


def squeezed(data: bytes, level: int = 1) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def released(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Small numbers byte by byte: all first bytes, then all second bytes, compressed."""
    return squeezed(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(released(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def steps(x: np.ndarray) -> bytes:
    """Ascending numbers as their differences."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


BUNDLE = "chunk long, ids array<long>, sizes array<long>, texts binary"


def chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, list, np.ndarray, bytes]]:
    """(chunk, ids, sizes of the texts, texts on end) of a partition of rows (doc_id, text); the same rows give the same chunks."""
    chunk, held, size = TaskContext.get().partitionId() << 24, [], 0

    def out() -> tuple[int, list, np.ndarray, bytes]:
        made = chunk, [x for k, _, _ in held for x in k], np.concatenate([n for _, n, _ in held]), b"".join(b for _, _, b in held)
        held.clear()
        return made

    for batch in batches:
        keys, (body, ends) = batch.column(0).to_pylist(), utf8(batch.column(1))
        a = 0
        while a < len(keys):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + chunk_bytes - size, "right")) - 1)
            held.append((keys[a:b], np.diff(ends[a : b + 1]), body[ends[a] : ends[b]].tobytes()))
            size += int(ends[b] - ends[a])
            a = b
            if size >= chunk_bytes or a < len(keys):
                yield out()
                size, chunk = 0, chunk + 1
    if held:
        yield out()


def bundled(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """A row per chunk of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, sizes, body in chunks(batches, chunk_bytes):
            columns = pa.array([chunk]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([squeezed(body, 6)], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns), names=["chunk", "ids", "sizes", "texts"])

    return docs.mapInArrow(run, BUNDLE)


def on_end(sizes: np.ndarray, body: bytes) -> pa.Array:
    """Texts that follow each other in ``body``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])


def texts_of(rows: pa.Table) -> tuple[list, pa.Array]:
    """The ids and texts of a chunk's only row."""
    return rows["ids"][0].values, on_end(np.array(rows["sizes"][0].values.to_numpy(), np.int64), released(rows["texts"][0].as_py()))


def ngrams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order the hash of the n-gram that ends at each word, the row of each word, and how many words of its text stand before it."""
    ends = utf8(texts)[1]
    found, a = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    while a < len(texts):  # hashing takes many times a text's size, so some texts at a time
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + PIECE, "right")) - 1)
        word, row = words(texts.slice(a, b - a))
        found.append((word, row + a))
        a = b
    word, row = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    at = np.arange(len(word)) - np.searchsorted(row, row)
    out = [word]
    for n in range(2, ORDER + 1):
        longer = np.zeros(len(word), np.uint64)
        longer[1:] = mixed(out[-1][:-1] * np.uint64(0x9FB21C651E98DF25) + word[1:] * np.uint64(2 * n + 1))
        out.append(longer)
    return out, row, at


def asked(grams: list[np.ndarray], at: np.ndarray, parts: int) -> Iterator[tuple]:
    """Per order: the distinct n-grams in order, how often each occurs, where each partition's begin, and each word's place among them (-1: too few words)."""
    width = np.uint64(-(-(1 << 64) // parts))
    for n, gram in enumerate(grams, 1):
        whole = at >= n - 1
        found, place, count = np.unique(gram[whole], return_inverse=True, return_counts=True)
        bounds = np.searchsorted(found // width, np.arange(parts + 1).astype(np.uint64))
        where = np.full(len(gram), -1, np.int32)
        where[whole] = place
        yield found, count, bounds, where


QUESTION = "chunk long, n int, part int, grams binary, counts binary"
ANSWER = "chunk long, n int, part int, counts binary"


def settled(docs: DataFrame) -> DataFrame:
    """``docs`` as it is if its rows come straight from a scan, else written to the shared folder."""
    return reliable(docs) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def exploded(docs: DataFrame, chunk_bytes: int, parts: int) -> DataFrame:
    """Rows of QUESTION: a chunk's n-grams of one order and partition, with how often each occurs in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, sizes, body in chunks(batches, chunk_bytes):
            grams, _, at = ngrams(on_end(sizes, body))
            for n, (found, count, bounds, _) in enumerate(asked(grams, at, parts), 1):
                which = np.flatnonzero(np.diff(bounds)).tolist()
                slices = [(bounds[p], bounds[p + 1]) for p in which]
                columns = (pa.array([chunk] * len(which), pa.int64()), pa.array([n] * len(which), pa.int32()), pa.array(which, pa.int32()), pa.array([steps(found[a:b]) for a, b in slices], pa.binary()), pa.array([planes(count[a:b]) for a, b in slices], pa.binary()))
                yield pa.RecordBatch.from_arrays(list(columns), names=["chunk", "n", "part", "grams", "counts"])

    return docs.mapInArrow(run, QUESTION)


def added(rows: pa.Table) -> Iterator[tuple[int, list[int], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Per order of a partition: (n, its rows, their lengths, all n-grams in order, their totals, the place of each asked among them)."""
    orders = rows["n"].to_numpy()
    grams, counts = rows["grams"], rows["counts"]
    for n in np.unique(orders).tolist():
        of = np.flatnonzero(orders == n).tolist()
        hashes = [from_steps(grams[i].as_py()) for i in of]
        found, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(place, np.concatenate([from_planes(counts[i].as_py()) for i in of]).astype(np.float64)).astype(np.int64)
        yield n, of, [len(h) for h in hashes], found, sums, place


def counted(docs: DataFrame, doc_id: str, text: str, part_grams: int) -> tuple[DataFrame, int, int]:
    """(rows of doc_id and text, words of the corpus, partitions of the count tables)."""
    own = settled(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    total = own.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    return own, total, max(2, -(-total * ORDER // part_grams))


def count_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1, chunk_bytes: int = CHUNK, part_grams: int = PART) -> DataFrame:
    """(n, gram, count): the n-grams that occur ``least`` times or more, by their hash."""
    own, _, parts = counted(docs, doc_id, text, part_grams)

    def add(rows: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([n] * int((sums >= least).sum()), pa.int32()), pa.array(found[sums >= least].view(np.int64)), pa.array(sums[sums >= least])], ["n", "gram", "count"]) for n, _, _, found, sums, _ in added(rows)]
        return pa.concat_tables(out)

    return exploded(own, chunk_bytes, parts).groupBy("part").applyInArrow(add, "n int, gram long, count long")


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK, part_grams: int = PART) -> DataFrame:
    """(doc_id, n_words, log_score) per row of ``docs``."""
    own, total, parts = counted(docs, doc_id, text, part_grams)

    def add(rows: pa.Table) -> pa.Table:
        answers: list = [None] * len(rows)
        for _, of, sizes, _, sums, place in added(rows):
            for i, part in zip(of, np.split(sums[place], np.cumsum(sizes)[:-1]), strict=True):
                answers[i] = planes(part)
        return pa.table([rows["chunk"], rows["n"], rows["part"], pa.array(answers, pa.binary())], ["chunk", "n", "part", "counts"])

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = texts_of(rows)
        grams, row, at = ngrams(texts)
        order, part, counts = answers["n"].to_numpy(), answers["part"].to_numpy(), answers["counts"]
        f = []
        for n, (found, _, _, where) in enumerate(asked(grams, at, parts), 1):
            of = np.flatnonzero(order == n)
            sums = np.concatenate([np.zeros(0, np.uint64), *(from_planes(counts[i].as_py()) for i in of[np.argsort(part[of], kind="stable")].tolist())])
            if len(sums) != len(found):
                raise RuntimeError("a chunk got other counts than it has n-grams")
            f.append(np.where(where >= 0, sums.astype(np.float64)[where], 0) if len(found) else np.zeros(len(row)))
            grams[n - 1] = where = None
        value = np.full(len(row), np.nan)
        back = np.zeros(len(row))  # how often the word has backed off
        for n in range(ORDER, 1, -1):
            can = np.isnan(value) & (at >= n - 1)
            here = can & (f[n - 1] >= LEAST)
            before = np.zeros(len(row))
            before[1:] = f[n - 2][:-1]
            value[here] = np.log(f[n - 1][here] / before[here])
            value[here] += back[here] * np.log(BACKOFF)
            back[can & ~here] += 1
        last = np.isnan(value)
        value[last] = np.log(f[0][last] / total) + back[last] * np.log(BACKOFF)
        n_words = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
        sums = np.bincount(row, value, minlength=len(texts)) if len(row) else np.zeros(len(texts))
        return pa.table([ids, pa.array(n_words.astype(np.int64)), pa.array(sums.astype(np.float64))], ["doc_id", "n_words", "log_score"])

    totals = exploded(own, chunk_bytes, parts).groupBy("part").applyInArrow(add, ANSWER)
    return bundled(own, chunk_bytes).groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, log_score double")

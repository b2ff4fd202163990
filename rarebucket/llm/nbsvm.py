"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

Words become shapes (runs of capitals, small letters and digits are one sign each, other signs stand for themselves,
and a word equal to the one before it is marked), so that unseen vocabulary doesn't matter.
The indicators of a text are its shape 1-grams and 2-grams, each at several levels: it occurs, or makes up
2, 10, 30 per cent of the words or more. With p and q the smoothed counts of an indicator in the classes, it is scaled
by log((p / |p|) / (q / |q|)); dual coordinate descent then fits the hinge loss, and a logistic curve through the
margins of the training rows turns margins into scores.

The model is fitted on the driver to about ``SAMPLE`` labelled rows (all, if there are fewer), drawn by a hash of the id.
Scores are computed for all rows from whole texts.

Null and empty texts have no indicator and get the score of the bias. With labels of one class only, all scores are
that class; with none, 0.5. Of rows with equal ids one takes part in training, and of conflicting labels the smaller
counts. Repeated rows get equal scores, each its own; a score of exactly the threshold passes. An empty table gives an empty
result. Extra columns, whatever their names, stay out of the score, and long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebucket.llm.common import fold_of, mixed, pieces, utf8
from rarebucket.llm.shingles import BASE, INVERSE, SPACE, powers, words

#: Labelled rows that a model is fitted to, about.
SAMPLE = 20_000
BITS = 18
LEVELS = (0.0, 0.02, 0.1, 0.3)


def classes(body: np.ndarray) -> np.ndarray:
    """A sign per byte: 1 capital, 2 other letter, 3 digit, else the byte itself. Latin-1 capitals in UTF-8 are capitals."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91], table[97:123], table[128:], table[48:58] = 1, 2, 2, 3
    out = table[body]
    second = np.flatnonzero((body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[:-1] == 0xC3)) + 1
    out[second] = out[second - 1] = 1
    return out


def shapes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word's shape and the row it is in."""
    word, row = words(column)
    if not len(word):
        return word, row
    body, offsets = utf8(column)
    sign = classes(body)
    inside = ~SPACE[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(body)]] = True
    first &= inside
    keep = inside.copy()
    keep[1:] &= (sign[1:] != sign[:-1]) | first[1:]
    at = np.flatnonzero(keep)
    sums = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(mixed(sign[at].astype(np.uint64) + np.uint64(977)) * powers(BASE, len(at)), out=sums[1:])
    starts = np.searchsorted(at, np.flatnonzero(first))
    ends = np.append(starts[1:], len(at))
    shape = (sums[ends] - sums[starts]) * powers(INVERSE, len(at) + 1)[starts]
    again = np.zeros(len(word), np.uint64)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    return mixed(shape + again * np.uint64(0xA24BAED4963EE407)), row


def indicators(column: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    """Per row the sorted numbers of its indicators."""
    shape, row = shapes(column)
    pair = mixed(shape[:-1] * np.uint64(3) + shape[1:] * np.uint64(5))
    bounds = np.searchsorted(row, np.arange(len(column) + 1)).tolist()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            out.append(np.zeros(0, np.int32))
            continue
        gram, n = np.unique(np.concatenate([shape[a:b], pair[a : b - 1]]), return_counts=True)
        part = n / (b - a)
        found = [mixed(gram[part >= level] + np.uint64(k + 1)) >> np.uint64(64 - bits) for k, level in enumerate(LEVELS)]
        out.append(np.unique(np.concatenate(found)).astype(np.int32))
    return out


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 10, blend: float = 0.25) -> tuple[np.ndarray, float]:
    """(weights of the unscaled indicators, bias) by dual coordinate descent; the last indicator is a constant 1."""
    w, bias, dual = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norms = [float(v @ v) + 1.0 for v in values]
    random = np.random.default_rng(7)
    for _ in range(rounds):
        for i in random.permutation(len(rows)).tolist():
            r, v = rows[i], values[i]
            grad = y[i] * (float(w[r] @ v) + bias) - 1.0
            new = min(max(dual[i] - grad / norms[i], 0.0), cost)
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                dual[i] = new
                w[r] += step * v
                bias += step
    used = np.abs(w[scale != 0])
    level = float(used.mean()) if len(used) else 0.0
    return ((1 - blend) * level + blend * w) * scale, bias * blend


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))), fitted with smoothed targets by Newton's method."""
    high, low = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (high + 1) / (high + 2), 1 / (low + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    loss = lambda b: float(np.logaddexp(0, x @ b).sum() - target @ (x @ b))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), x.T @ (target - p))
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, smoothing: float = 1.0) -> tuple[np.ndarray, float]:
    """(weight per indicator, offset): the score of a row is the logistic function of the sum."""
    weights = np.zeros(1 << bits)
    if not len(rows) or len(set(labels.tolist())) < 2:
        return weights, (0.0 if not len(rows) else 30.0 if labels[0] else -30.0)
    counts = [smoothing + np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == c]), minlength=1 << bits) for c in (1, 0)]
    seen = counts[0] + counts[1] > 2 * smoothing
    ratio = np.where(seen, np.log((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum())), 0.0)
    y = np.where(labels > 0, 1.0, -1.0)
    weights, bias = descend(rows, y, ratio)
    margin = np.array([weights[r].sum() for r in rows]) + bias
    a, b = logistic(margin, y)
    return weights * a, a * bias + b


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    usable = usable.groupBy("doc_id").agg(F.min(label).alias("y"))
    n = usable.count()
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < sample).select(F.col("doc_id").alias("label_id"), F.col("y").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tolist() for r in indicators(batch.column(2))], pa.list_(pa.int32()))], names=["doc_id", "y", "found"])

    # the sample has a row per id, so its size is bounded by ``sample``
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select(F.col("doc_id").cast("long"), "y", "text")
    rows = chosen.mapInArrow(run, "doc_id long, y int, found array<int>").groupBy("doc_id").agg(F.min(F.struct("y", "found")).alias("x")).select("doc_id", "x.y", "x.found").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    flat, ends = (rows["found"].combine_chunks(), None) if len(rows) else (None, None)
    if flat is None:
        return fit([], np.zeros(0))
    ends = flat.offsets.to_numpy()
    values = flat.values.to_numpy()
    return fit([values[ends[i] : ends[i + 1]] for i in order.tolist()], rows["y"].to_numpy()[order])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with a score after its own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = shared.value
        for batch in pieces(batches, at):
            margin = np.array([weights[r].sum() for r in indicators(batch.column(at))]) + offset
            score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double")


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    model = train(docs, labels, folds=folds, held_out=held_out)
    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return scored(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score below ``least``; the columns stay as they are."""
    model = train(docs, labels)
    named = docs.select(*[F.col(c).alias(f"own_{c}") for c in docs.columns])
    return scored(named, model, "own_text").filter(F.col("score") >= least).select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])

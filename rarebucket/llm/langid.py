"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point, so no table of letters is kept.
A letter trigram binds (multiplies) its letters' vectors, rotated by 2, 1 and 0 places; a text bundles (adds) its
trigrams, and a language's prototype bundles the unit vectors of its training texts. The predicted language is
that of the prototype with the largest cosine.

Prototypes come from all training rows: each task adds up vectors rounded to integers, and a relational sum by
(language, dimension) follows, so the result is the same however rows are dealt, and a hot language or
source is added up where it lies. What reaches the driver is ``DIMENSIONS`` numbers per language.

Null texts and texts without a letter are ``und`` with score 0, as is everything if there is no training row.
Equal cosines go to the smaller code in code point order. Repeated rows count as often as they occur. Bytes that
aren't UTF-8 are no letters. Columns other than id, text and language are not read, whatever their names. An empty table gives an
empty result; long texts are read whole. More than ``LANGUAGES`` different values of the language column are an error, since
each text is compared with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebucket.llm.common import fold_of, mixed, pieces

DIMENSIONS = 1024
#: Vectors of training texts have this length when they are rounded.
UNIT = 1024
UNKNOWN = "und"
#: Least cosines of a text with a known language, below and from LONG characters. The cosine of unrelated bundles has a
#: standard deviation of 1 / sqrt(DIMENSIONS) = 0.031, four of which are LEAST; in long texts letter noise in a learned
#: alphabet comes near 0.2, and of held-out texts of sf0.1 one in a thousand lies below 0.176.
LEAST, LEAST_LONG, LONG = 0.125, 0.22, 200
#: Languages at most.
LANGUAGES = 2000
#: Symbols of a batch up to which trigrams are numbered by a table; beyond, by sorting.
TABLE = 128


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Rows of +1 and -1, one per code point; 0 stands for what is between words."""
    blocks = np.arange(dimensions // 64, dtype=np.uint64)
    bits = mixed((points.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + mixed(blocks + np.uint64(17))[None, :])
    return (2 * np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) - 1).astype(np.int8)


def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts on end, with one 0 before, between and after words, and the text of each."""
    lowered = [f"\n{t.lower()}\n" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = is_letter[points]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    # of a run of two or more non-letters the first and the last are kept; the last goes if it follows the first
    doubled = np.zeros(len(points), bool)
    doubled[1:] = keep[1:] & ~letter[1:] & (row[1:] == row[:-1])
    where = np.flatnonzero(keep)
    points, row, letter, doubled = np.where(letter, points, 0)[where], row[where], letter[where], doubled[where]
    again = np.zeros(len(where), bool)
    again[1:] = doubled[1:] & ~letter[:-1] & (row[1:] == row[:-1])
    return points[~again], row[~again]


def text_vectors(texts: list[str], is_letter: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundle of each text's trigrams; zero if the text has no letter."""
    points, row = symbols(texts, is_letter)
    out = np.zeros((len(texts), dimensions), np.float32)
    if len(points) < 3:
        return out
    alphabet, code = np.unique(points, return_inverse=True)
    k = len(alphabet)
    gram = (code[:-2] * k + code[1:-1]) * k + code[2:]
    same = row[:-2] == row[2:]
    gram, row = gram[same], row[:-2][same]
    if k <= TABLE:
        seen = np.bincount(gram, minlength=k**3) > 0
        found = np.flatnonzero(seen)
        index = (np.cumsum(seen) - 1)[gram]
    else:
        found, index = np.unique(gram, return_inverse=True)
    vectors = letter_vectors(alphabet, dimensions)
    for a in range(0, len(found), 8192):  # bounded memory whatever the alphabet
        part = found[a : a + 8192]
        bound = np.roll(vectors, 2, 1)[part // (k * k)] * np.roll(vectors, 1, 1)[part // k % k] * vectors[part % k]
        here = (index >= a) & (index < a + 8192)
        counts = np.bincount(row[here] * len(part) + index[here] - a, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def as_texts(column: pa.Array) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def prototypes(training: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their unit prototypes, from rows of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, sums = None, {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*sums], pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])

        for batch in pieces(batches, 0):
            is_letter = letters() if is_letter is None else is_letter
            vectors = text_vectors(as_texts(batch.column(0)), is_letter, dimensions)
            length = np.linalg.norm(vectors, axis=1)
            units = np.rint(vectors * (UNIT / np.maximum(length, 1))[:, None]).astype(np.int64)
            langs, at = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            for i, lang in enumerate(langs):
                sums[lang] = sums.get(lang, 0) + units[at == i].sum(0)
            if len(sums) > 1000:
                yield out()
                sums.clear()
        if sums:
            yield out()

    parts = training.mapInArrow(run, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("i", "v"))
    rows = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).limit(LANGUAGES * dimensions + 1).toArrow()
    if len(rows) > LANGUAGES * dimensions:
        raise ValueError(f"the language column has more than {LANGUAGES} different values")
    names = sorted(set(rows["lang"].to_pylist()))
    out = np.zeros((len(names), dimensions))
    number = {n: k for k, n in enumerate(names)}
    out[[number[x] for x in rows["lang"].to_pylist()], rows["i"].to_numpy()] = rows["v"].to_numpy()
    return names, out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, at least 0) after its own columns."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dimensions = model[1].shape[1] if len(model[0]) else DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, (names, profile) = None, shared.value
        for batch in pieces(batches, at):
            is_letter = letters() if is_letter is None else is_letter
            lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            if names and len(batch):
                vectors = text_vectors(as_texts(batch.column(at)), is_letter, dimensions).astype(np.float64)
                length = np.linalg.norm(vectors, axis=1)
                cosine = vectors @ profile.T / np.maximum(length, 1e-9)[:, None]
                best = cosine.argmax(1)
                score = np.where(length > 0, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                lang = [names[k] if n > 0 else UNKNOWN for k, n in zip(best.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = docs.schema.fieldNames()
    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs``; the rows of one fold take no part in training."""
    fold = fold_of(F.col("doc_id"), folds)
    model = prototypes(docs.filter(F.col("lang").isNotNull() & (fold != held_out)).select("text", "lang"))
    return predicted(docs.select("doc_id", (fold == held_out).alias("held_out"), "text"), model).drop("text")


def with_language(docs: DataFrame, least: float = LEAST, least_long: float = LEAST_LONG, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``docs`` without rows that have no letter or are like no prototype; the columns stay as they are.

    A text of a few words can have a cosine as low as that of noise, and then goes too.
    """
    fold = fold_of(F.col("doc_id"), folds)
    model = prototypes(docs.filter(F.col("lang").isNotNull() & (fold != held_out)).select("text", "lang"))
    named = docs.select(*[F.col(c).alias(f"own_{c}") for c in docs.columns])
    needed = F.when(F.length("own_text") < LONG, F.lit(least)).otherwise(F.lit(least_long))
    found = predicted(named, model, "own_text").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= needed))
    return found.select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])

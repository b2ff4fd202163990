"""URL filter: rules first, then a ratio of two character language models.

The model knows URLs as strings over ``SYMBOLS`` (letters, digits as one sign, some marks, one sign for all else). One
variable-order Markov model is counted over the accepted and one over the rejected URLs: the chance of a character
after the three before it blends orders 3 to 0, each by the weight that its context has earned (Witten-Bell: the
more often seen and the fewer continuations, the more), and a uniform order below. A URL's score is the difference of
its log-likelihoods divided by its length. The threshold is the one with the best balanced accuracy on the fold of
labelled URLs that counting left out; the model is then counted over all of them.

Counts are aggregated by (class, four signs) before they move. A table of all four-sign differences, of fixed
size (``SIGNS`` ^ 4 numbers of 4 bytes, 10 MB), is what executors get, however many URLs there are.

Labels are the verdicts of the rules. URLs that are null or without ``://`` have an empty host and path, match
no rule and are judged by the model as they stand (null: as an empty string, score 0). Without labels of both classes every
URL that no rule matches is allowed. Repeated rows count as often as they occur; an empty table gives an empty result.
Scores equal to the threshold allow; of thresholds that do equally well the middle one is taken. URLs of any length are read
whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebucket.llm.common import fold_of, pieces, utf8

#: What a URL is made of for the model; 0 is the border of the string and 1 any other byte.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%+~"
SIGNS = len(SYMBOLS) + 2
ORDER = 3
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Bins of the scores from which the threshold is chosen, over -RANGE..RANGE.
BINS, RANGE = 2001, 5.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and rule_verdict; the longest rule that fits wins, then the first given."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def sign_table() -> np.ndarray:
    out = np.ones(256, np.int64)
    for k, c in enumerate(SYMBOLS):
        out[ord(c)] = k + 2
        out[ord(c.upper())] = k + 2
    out[48:58] = SYMBOLS.index("0") + 2
    return out


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs of four signs of each URL, borders included, and the row of each."""
    body, offsets = utf8(column)
    n = len(column)
    # each URL gets three borders before and one after it
    where = np.arange(len(body)) + 4 * np.repeat(np.arange(n), np.diff(offsets)) + 3
    signs = np.zeros(len(body) + 4 * n, np.int64)
    signs[where] = sign_table()[body]
    row = np.repeat(np.arange(n), np.diff(offsets) + 4)
    run = signs[:-3] * SIGNS**3 + signs[1:-2] * SIGNS**2 + signs[2:-1] * SIGNS + signs[3:]
    whole = row[:-3] == row[3:]
    return run[whole], row[:-3][whole]


def counted(urls: DataFrame) -> DataFrame:
    """(label, gram) counts of rows of (label, url); tasks add up what they read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIGNS ** (ORDER + 1)), np.int64)
        for batch in pieces(batches, 1):
            gram, row = grams(batch.column(1))
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums += np.bincount(label[row] * sums.shape[1] + gram, minlength=sums.size).reshape(sums.shape)
        label, gram = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(gram), pa.array(sums[label, gram])], names=["label", "gram", "n"])

    return urls.mapInArrow(run, "label long, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def chances(counts: np.ndarray) -> np.ndarray:
    """Blended log-chance of every sign after every three signs."""
    below = np.full(SIGNS, 1.0 / SIGNS)
    for order in range(ORDER + 1):
        seen = counts.reshape(-1, SIGNS**order, SIGNS).sum(0) if order < ORDER else counts.reshape(-1, SIGNS)
        total, kinds = seen.sum(-1, keepdims=True), (seen > 0).sum(-1, keepdims=True)
        prior = np.tile(below.reshape(-1, SIGNS), (SIGNS, 1)) if order else below[None, :]
        below = np.where(total > 0, (seen + kinds * prior) / np.maximum(total + kinds, 1), prior)
    return np.log(below).ravel()


def difference(counts: DataFrame) -> np.ndarray | None:
    """Accepted less rejected log-chance per gram; None if a class is missing. At most 2 * SIGNS^4 counts are read."""
    rows = counts.toArrow()
    label, gram, n = (rows[c].to_numpy() for c in ("label", "gram", "n"))
    if len(set(label.tolist())) < 2:
        return None
    sums = np.zeros((2, SIGNS ** (ORDER + 1)))
    sums[label, gram] = n
    return (chances(sums[1]) - chances(sums[0])).astype(np.float32)


def with_score(pages: DataFrame, table: np.ndarray, url: str = "url") -> DataFrame:
    """``pages`` with lm_score: the length-normalised difference of log-likelihoods."""
    at, shared = pages.columns.index(url), pages.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            gram, row = grams(batch.column(at))
            sums, n = np.bincount(row, shared.value[gram].astype(np.float64), minlength=len(batch)), np.bincount(row, minlength=len(batch))
            score = np.where(np.diff(utf8(batch.column(at))[1]) > 0, sums / np.maximum(n, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "lm_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, lm_score double")


def threshold(scored: DataFrame) -> float:
    """The score with the best balanced accuracy over rows of (label, lm_score), from a histogram of fixed size."""
    step = 2 * RANGE / (BINS - 1)
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("lm_score") + RANGE) / step))).cast("int")
    sums = np.zeros((2, BINS))
    for r in scored.groupBy("label", bin_.alias("bin")).count().collect():
        sums[r["label"], r["bin"]] = r["count"]
    low, high = np.cumsum(sums[0]), sums[1].sum() - np.cumsum(sums[1])
    if not sums[0].sum() or not sums[1].sum():
        return 0.0
    right = low / sums[0].sum() + high / sums[1].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[(len(best) - 1) // 2] + 1) * step - RANGE)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, folds: int = 5, held_out: int = 0) -> DataFrame:
    """page_id, host, path, rule, verdict, lm_score per row of ``pages``."""
    known = ruled(pages.select("page_id", "url"), rules)
    labelled = known.filter("rule_verdict IS NOT NULL").select((F.col("rule_verdict") == "allow").cast("long").alias("label"), "url", (fold_of(F.col("page_id"), folds) == held_out).alias("held"))
    table, cut = difference(counted(labelled.filter("NOT held").select("label", "url"))), 0.0
    if table is not None:
        cut = threshold(with_score(labelled.filter("held").select("label", "url"), table))
    whole = difference(counted(labelled.select("label", "url")))
    if whole is None:
        out, cut = known.withColumn("lm_score", F.lit(0.0)), 0.0
    else:
        out = with_score(known, whole)
    verdict = F.coalesce("rule_verdict", F.when(F.col("lm_score") >= cut, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "lm_score")

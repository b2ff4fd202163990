"""Reproducible keys, seeds and genomes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarebucket.functions.hashing import GOLDEN, mix, signed, splitmix64, wrap_add, wrap_multiply

MASK = (1 << 50) - 1
WHOLE = (1 << 64) - 1


def settled(rows: DataFrame) -> DataFrame:
    """(i, key) with the key cut to 50 bits. A generator hands it on, so that later filters on the key aren't pushed into its formula,
    which would multiply its size."""
    return rows.select("i", F.explode(F.array(F.col("key").bitwiseAND(F.lit(MASK)))).alias("key"))


def keys(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, key): mixed counters of 50 bits."""
    rows = wrap_add(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("key")), "key", F.lit(signed(seed)))
    return settled(splitmix64(rows, "key"))


def trial_keys(spark: SparkSession, n: int, trial: int) -> DataFrame:
    """The same, far apart for each trial."""
    return keys(spark, n, 42 + trial * GOLDEN)


def distinct_keys(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, key): keys that all differ, since an odd factor is invertible modulo 2^50."""
    rows = wrap_multiply(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("key")), "key", mix(seed) | 1)
    return settled(wrap_add(rows, "key", F.lit(signed(seed))))


def trial_seed(root: int, power: int, trial: int) -> int:
    return mix(root ^ power << 32 ^ trial)


def derived_seed(root: int, tag: int, parameters: tuple[int, ...], replicate: int) -> int:
    """Mixed in turn with a tag, all parameters and the replicate."""
    return reduce(lambda state, value: mix(state ^ value & WHOLE), (*parameters, replicate), mix(root ^ tag))


def stream(seed: int, n: int) -> np.ndarray:
    """The ``n`` numbers that follow the seed, each mixed from the one before."""
    return np.fromiter(islice(accumulate(repeat(seed), lambda state, _: mix(state)), 1, n + 1), np.uint64, n)


LETTERS = np.frombuffer(b"ACGT", np.uint8)
#: Per base the three others.
OTHERS = np.array([[c for c in range(4) if c != b] for b in range(4)])


def decisions(low: np.ndarray) -> np.ndarray:
    """Where a base is decided on, if a low number that decides makes the next one a choice of base.

    In a run of low numbers that is every second one, from the first on, whatever came before the run.
    """
    at = np.arange(len(low))
    begins = low & ~np.concatenate([[False], low[:-1]])
    chosen = low & ((at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0)
    return ~np.concatenate([[False], chosen[:-1]])


def genome_pair(seed: int, bases: int, identity: float) -> tuple[str, str]:
    """A random genome, and a copy in which a base stays with chance ``identity``."""
    change = math.ceil((1 - identity) * 2.0**64)
    room = 2 * bases + 2  # each base takes one number, and one more if it changes
    numbers = stream(seed, bases + (room if change >= 1 << 62 else bases + int(2 * bases * change / 2**64) + 1000))
    first, rest = (numbers[:bases] & np.uint64(3)).astype(np.int64), numbers[bases:]
    low = rest < np.uint64(change) if change < 1 << 64 else np.ones(len(rest), bool)
    at = np.flatnonzero(decisions(low)[:-1])[:bases]
    second = np.where(low[at], OTHERS[first, (rest[at + 1] % np.uint64(3)).astype(np.int64)], first)
    return LETTERS[first].tobytes().decode(), LETTERS[second].tobytes().decode()


def genomes(spark: SparkSession, identities: list[float], replicates: int, bases: int, k: int = 25, buckets: int = 2048, root: int = 42, tag: int = 0x534B4554434830) -> DataFrame:
    """(identity, replicate, reference, query). The numbers of a replicate are a chain, so each replicate is one task's work."""
    points = spark.createDataFrame([(float(a), r) for a in identities for r in range(replicates)], "identity double, replicate int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [genome_pair(derived_seed(root, tag, (k, buckets, round(a * 10)), r), bases, a / 100) for a, r in zip(batch["identity"].tolist(), batch["replicate"].tolist(), strict=True)]
            yield batch.assign(reference=pd.Series([p[0] for p in pairs], dtype=object), query=pd.Series([p[1] for p in pairs], dtype=object))

    return points.repartition(len(identities) * replicates).mapInPandas(run, "identity double, replicate int, reference string, query string")

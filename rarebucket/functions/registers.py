"""Scores, registers and the metrics of compared sketches, as column expressions.

A hash's score is 1024 times its leading zeros (53 at most) plus its next ten bits inverted: the rarer the hash, the
larger. Score 0 means an empty register, so a raw 0 becomes 1. Scores fit 16 bits unsigned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANTISSA, MOST_ZEROS, MOST_COUNT = 10, 53, 65535
LEAST_BUCKETS, MOST_BUCKETS = 1 << 11, 1 << 17


def checked_buckets(buckets: int) -> int:
    if buckets & (buckets - 1) or not LEAST_BUCKETS <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be a power of two from {LEAST_BUCKETS} to {MOST_BUCKETS}: {buckets}")
    return buckets


def checked_k(k: int) -> int:
    if not 1 <= k <= 31:
        raise ValueError(f"k must be from 1 to 31: {k}")
    return k


def bucket_of(hash_: Column, buckets: int) -> Column:
    return hash_.bitwiseAND(F.lit(checked_buckets(buckets) - 1).cast("long")).cast("int")


def zeros_of(hash_: Column) -> Column:
    return F.least(F.lit(64) - F.length(F.bin(hash_.bitwiseOR(F.lit(1).cast("long")))), F.lit(MOST_ZEROS))


def score(hash_: Column) -> Column:
    zeros = zeros_of(hash_)
    mantissa = F.call_function("shiftrightunsigned", hash_, F.lit(MOST_ZEROS) - zeros).bitwiseAND(1023).cast("int")
    return F.greatest(F.lit(1), zeros * 1024 + (F.lit(1023) - mantissa)).cast("int")


def pack(winner: Column, count: Column) -> Column:
    return F.shiftleft(winner.cast("long"), 16).bitwiseOR(count.cast("long"))


def winner_of(register: Column) -> Column:
    return F.shiftright(register, 16).cast("int")


def count_of(register: Column) -> Column:
    return register.bitwiseAND(MOST_COUNT).cast("int")


def saturated_add(a: Column, b: Column) -> Column:
    """Sum of two winner counts as a register keeps it; counts may be larger than a register's most."""
    return F.least(a + b, F.lit(MOST_COUNT))


def merge_registers(a: Column, b: Column) -> Column:
    """Of two packed registers that with the larger winner; equal winners add their counts."""
    both = pack(winner_of(a), saturated_add(count_of(a), count_of(b)))
    return F.when(winner_of(a) > winner_of(b), a).when(winner_of(a) < winner_of(b), b).otherwise(both)


def restore(score_: Column) -> Column:
    """The magnitude that a score stands for, as an exact decimal (up to 2^64)."""
    mantissa = (F.lit(2047) - score_.bitwiseAND(1023)).cast("decimal(5,0)")
    return mantissa * F.pow(F.lit(2.0), F.lit(MOST_ZEROS) - F.shiftright(score_, MANTISSA)).cast("decimal(17,0)")


def wkid(lower: Column, equal: Column, higher: Column) -> Column:
    """Weighted k-mer identity; small divisors count as 6, a zero divisor gives null."""
    divisor = equal + F.least(lower, higher)
    return F.when(divisor > 0, equal.cast("double") / F.greatest(divisor, F.lit(6)))


def ani(identity: Column, k: int) -> Column:
    """Average nucleotide identity from the k-mer identity."""
    return F.pow(identity, F.lit(1.0 / checked_k(k)))


def containment(equal: Column, higher: Column) -> Column:
    return F.when(equal + higher > 0, equal.cast("double") / (equal + higher))


def completeness(lower: Column, equal: Column, higher: Column) -> Column:
    return F.when(equal + lower > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (equal + higher).cast("double") / (equal + lower))))


def signed_error(estimate: Column, exact: Column) -> Column:
    return (estimate - exact) / exact


#: Scales of the report tables.
def billions(x: Column) -> Column:
    return x / 1e9


def micros(seconds: Column) -> Column:
    return seconds * 1e6


def percent(x: Column) -> Column:
    return x * 100.0

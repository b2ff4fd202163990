"""64-bit mixing in plain column arithmetic.

Products wrap at 2^64. Spark's ANSI mode raises on overflow, so a product is taken in limbs of 22, 22 and
20 bits, none of which can overflow; that holds under any session setting and stays in generated code. Each step is a projection of
its own, since a limb occurs several times in the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the hash.
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHIFTS = (30, 27, 31)
KEY_SEED = 42
GOLDEN = 0x9E3779B97F4A7C15

LOW22, LOW20 = (1 << 22) - 1, (1 << 20) - 1
SIGN = -(1 << 63)


def signed(value: int) -> int:
    """The signed 64-bit number with the same bits."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def wrap_multiply(df: DataFrame, column: str, factor: int) -> DataFrame:
    """``df`` with ``column`` times ``factor`` modulo 2^64."""
    factor &= (1 << 64) - 1
    b0, b1, b2 = (F.lit(x) for x in (factor & LOW22, factor >> 22 & LOW22, factor >> 44))
    x = F.col(column)
    a0, a1, a2 = x.bitwiseAND(LOW22), F.shiftrightunsigned(x, 22).bitwiseAND(LOW22), F.shiftrightunsigned(x, 44)
    p, q, r = (f"{column}__{k}" for k in "pqr")
    df = df.withColumns({p: a0 * b0, q: a0 * b1 + a1 * b0, r: a0 * b2 + a1 * b1 + a2 * b0})
    df = df.withColumn(q, F.col(q) + F.shiftright(p, 22)).withColumn(r, F.col(r) + F.shiftright(q, 22))
    whole = F.col(p).bitwiseAND(LOW22).bitwiseOR(F.shiftleft(F.col(q).bitwiseAND(LOW22), 22)).bitwiseOR(F.shiftleft(F.col(r).bitwiseAND(LOW20), 44))
    return df.withColumn(column, whole).drop(p, q, r)


def wrap_add(df: DataFrame, column: str, term: Column) -> DataFrame:
    """``df`` with ``column`` plus ``term`` modulo 2^64, in halves of 32 bits."""
    low, x, term = (1 << 32) - 1, F.col(column), term.cast("long")
    a, b = f"{column}__a", f"{column}__b"
    df = df.withColumns({a: x.bitwiseAND(low) + term.bitwiseAND(low), b: F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(term, 32)})
    high = F.col(b) + F.shiftright(a, 32)
    return df.withColumn(column, F.col(a).bitwiseAND(low).bitwiseOR(F.shiftleft(high, 32))).drop(a, b)


def splitmix64(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` mixed: the finalizer alone, without an increment, so 0 stays 0."""
    fold = lambda d, n: d.withColumn(column, F.col(column).bitwiseXOR(F.shiftrightunsigned(column, n)))
    for shift, factor in zip(SHIFTS, MULTIPLIERS, strict=False):
        df = wrap_multiply(fold(df, shift), column, factor)
    return fold(df, SHIFTS[2])


def hash_key(df: DataFrame, key: str, out: str = "hash") -> DataFrame:
    """``df`` with ``out``: the hash of a 64-bit key. Key 42 hashes to 0."""
    return splitmix64(df.withColumn(out, F.col(key).cast("long").bitwiseXOR(F.lit(KEY_SEED).cast("long"))), out)


def unsigned_order(hash_: Column) -> Column:
    """Signed numbers in the order of the unsigned ones; the same function turns them back."""
    return hash_.bitwiseXOR(F.lit(SIGN))


def mix(value: int) -> int:
    """The same mixing of one number on the driver."""
    value &= (1 << 64) - 1
    for shift, factor in zip(SHIFTS, MULTIPLIERS, strict=False):
        value = (value ^ value >> shift) * factor & (1 << 64) - 1
    return value ^ value >> SHIFTS[2]

"""Exact medians of large groups: no task reads the values of a group together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per power of e in the first pass.
STEPS = 400
#: Buckets of an interval in later passes.
WIDTH = 1 << 14


def magnitude(value: Column) -> Column:
    """A bucket that never falls as the value grows, about a million in all. Zero, infinities and NaN have buckets of their own."""
    size = F.floor(F.least(F.log(F.abs(value)), F.lit(750.0)) * STEPS) + 750 * STEPS
    return F.when(F.isnan(value), F.lit(1 << 20)).otherwise(F.coalesce(F.signum(value) * size, F.lit(0.0)).cast("long"))


def _counted(rows: DataFrame, place: Column, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, place.alias("_place")).agg(F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))


def _picked(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of each group the interval from ``_a`` to ``_b`` that holds the ranks ``_left`` and ``_right``, both from 0, and the ranks within it.

    Ranks that two buckets hold are the greatest value of one and the smallest of the other. The interval is open if other values may lie in it.
    """
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    at = lambda rank, c: F.max(F.when((F.col("_before") <= F.col(rank)) & (F.col(rank) < F.col("_upto")), F.col(c)))
    found = rows.groupBy(*by).agg(
        at("_left", "_place").alias("_p"), at("_right", "_place").alias("_q"), at("_left", "_low").alias("_least"), at("_left", "_high").alias("_most"), at("_right", "_low").alias("_next"),
        at("_left", "_before").alias("_base"), F.max("_left").alias("_left"), F.max("_right").alias("_right"))
    one = F.col("_p") == F.col("_q")
    return found.select(
        *by, F.when(one, F.col("_least")).otherwise(F.col("_most")).alias("_a"), F.when(one, F.col("_most")).otherwise(F.col("_next")).alias("_b"),
        (F.col("_left") - F.col("_base")).alias("_left"), (F.col("_right") - F.col("_base")).alias("_right"), F.coalesce(one & (F.col("_least") < F.col("_most")), F.lit(False)).alias("_open"))


def medians(df: DataFrame, value: str, *by: str, name: str = "median") -> DataFrame:
    """(by, median) as ``median`` gives it: values are doubles, nulls don't count, NaN is greatest, a group without values has null.

    Counts by bucket find the bucket with the middle ranks, and the next pass reads only that bucket's values: first a 400th of their
    size, then a 16,384th of that, twice, then single values, of which fewer than 2^17 are left. So a task hands on no more than a row
    per bucket of a group, whatever the values are. Under adaptive execution passes that no group needs read nothing; most data needs two.
    The middle of groups that are still open is broadcast to the next pass.

    ``df`` is read once a pass: persist it if its rows are costly or not the same each time.
    """
    if not by:
        raise ValueError("medians need a column to group by")
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    total = F.sum("_n").over(Window.partitionBy(*by))
    counts = _counted(rows, magnitude(v), *by).withColumn("_left", F.shiftright(total - 1, 1)).withColumn("_right", F.shiftright(total, 1))
    found, out = _picked(counts, by), []
    for place in (F.floor((v - a) / (b - a) * WIDTH), F.floor((v - a) / (b - a) * WIDTH), v, None):
        out.append(found.filter(~F.col("_open")).select(*by, F.when(a == b, a).otherwise(0.5 * a + 0.5 * b).alias(name)))
        if place is not None:
            kept = found.filter("_open").select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_a", "_b", "_left", "_right")
            same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
            inside = rows.join(F.broadcast(kept), reduce(Column.__and__, [*same, v.between(a, b)]))
            found = _picked(_counted(inside, place, *by, "_left", "_right"), by)
    return reduce(DataFrame.unionAll, out)

"""Bucket by bucket comparison of sketches.

An inner join on the bucket sees only buckets that both have filled. A bucket that one alone has filled is lower or higher
too, and follows from the numbers of filled buckets, so no dense join is needed, and one join on the bucket serves any
number of pairs: those given (``compare``), those that have equal registers (``alike_pairs``) or all (``all_pairs``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebucket.functions import registers as R
from rarebucket.operators.estimate import cardinality


def _counted(met: DataFrame) -> DataFrame:
    """(left_id, right_id, lt, eq, gt) of rows of (left_id, right_id, a, b) for the buckets that both have filled."""
    return met.groupBy("left_id", "right_id").agg(F.count_if(F.col("a") < F.col("b")).alias("lt"), F.count_if(F.col("a") == F.col("b")).alias("eq"), F.count_if(F.col("a") > F.col("b")).alias("gt"))


def _completed(pairs: DataFrame, counts: DataFrame, rows: DataFrame, buckets: int, include_cardinality: bool) -> DataFrame:
    """All counts of the pairs, from those of the buckets that both have filled."""
    filled = rows.groupBy("sketch_id").agg(F.count("*").alias("n"))
    out = pairs.join(counts, ["left_id", "right_id"], "left")
    for side in ("left", "right"):
        out = out.join(filled.select(F.col("sketch_id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n")), f"{side}_id", "left")
    lt, eq, gt, a, b = (F.coalesce(c, F.lit(0)) for c in ("lt", "eq", "gt", "left_n", "right_n"))
    shared = lt + eq + gt
    out = out.select("left_id", "right_id", (lt + b - shared).alias("lower"), eq.alias("equal"), (gt + a - shared).alias("higher"), (F.lit(buckets) - a - b + shared).alias("both_empty"))
    if include_cardinality:
        size = cardinality(rows, buckets).select(F.col("sketch_id").alias("left_id"), "cardinality")
        out = out.join(size, "left_id", "left").withColumn("cardinality", F.coalesce("cardinality", F.lit(0.0)))
    return out.select("left_id", "right_id", "lower", "equal", "higher", "both_empty", *(["cardinality"] if include_cardinality else []))


def compare(rows: DataFrame, pairs: DataFrame, buckets: int, include_cardinality: bool = False) -> DataFrame:
    """(left_id, right_id, lower, equal, higher, both_empty[, cardinality]) for the (left_id, right_id) of ``pairs``.

    Lower means that the left register is lower. Cardinality is the left sketch's.
    """
    R.checked_buckets(buckets)
    pairs = pairs.select("left_id", "right_id").distinct()
    own = rows.select("sketch_id", "bucket", "winner")
    left = pairs.join(own.select(F.col("sketch_id").alias("left_id"), "bucket", F.col("winner").alias("a")), "left_id")
    met = left.join(own.select(F.col("sketch_id").alias("right_id"), "bucket", F.col("winner").alias("b")), ["right_id", "bucket"])
    return _completed(pairs, _counted(met), rows, buckets, include_cardinality)


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(F.col("sketch_id").alias(f"{side}_id"), "bucket", F.col("winner").alias(value)) for side, value in (("left", "a"), ("right", "b")))


def alike_pairs(rows: DataFrame, buckets: int, least: int = 1, include_cardinality: bool = False) -> DataFrame:
    """Pairs with ``least`` equal registers or more, the smaller id on the left.

    One join on (bucket, winner) finds them, so sketches that share nothing never meet: the way for many sketches.
    """
    left, right = _sides(rows)
    met = left.join(right.withColumnRenamed("b", "a"), ["bucket", "a"]).filter(F.col("left_id") < F.col("right_id"))
    pairs = met.groupBy("left_id", "right_id").agg(F.count("*").alias("same")).filter(F.col("same") >= least)
    return compare(rows, pairs, buckets, include_cardinality)


#: Blocks that the right ids of all pairs are dealt to.
BLOCKS = 16


def all_pairs(rows: DataFrame, buckets: int, include_cardinality: bool = False) -> DataFrame:
    """Every pair of sketches once, the smaller id on the left; pairs without a common filled bucket included.

    The result has n^2 / 2 rows for n sketches. Registers meet by one join on the bucket, and pairs of ids by one on
    the left id's block, so both are dealt by hash; ``alike_pairs`` is for more sketches than that allows.
    """
    R.checked_buckets(buckets)
    left, right = _sides(rows)
    met = left.join(right, "bucket").filter(F.col("left_id") < F.col("right_id"))
    ids = rows.select("sketch_id").distinct()
    one = ids.select(F.col("sketch_id").alias("left_id"), F.pmod(F.xxhash64("sketch_id"), F.lit(BLOCKS)).cast("int").alias("block"))
    other = ids.select(F.col("sketch_id").alias("right_id"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    pairs = one.join(other, "block").filter(F.col("left_id") < F.col("right_id")).select("left_id", "right_id")
    return _completed(pairs, _counted(met), rows, buckets, include_cardinality)


def with_metrics(counts: DataFrame, k: int) -> DataFrame:
    lower, equal, higher = F.col("lower"), F.col("equal"), F.col("higher")
    out = counts.withColumn("wkid", R.wkid(lower, equal, higher)).withColumn("ani", R.ani(F.col("wkid"), k))
    return out.withColumn("containment", R.containment(equal, higher)).withColumn("completeness", R.completeness(lower, equal, higher))


def total_counts(counts: DataFrame, *by: str) -> DataFrame:
    """Field-wise sums: pairwise counts are additive."""
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("lower", "equal", "higher", "both_empty")])

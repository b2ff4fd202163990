"""HyperLogLog counterparts, by Spark's built-in sketches of 2^11 registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 11


def sketches(df: DataFrame, key: str, by: str) -> DataFrame:
    return df.groupBy(F.col(by).cast("string").alias("sketch_id")).agg(F.hll_sketch_agg(F.col(key), F.lit(PRECISION)).alias("hll"))


def estimates(found: DataFrame) -> DataFrame:
    return found.select("sketch_id", F.hll_sketch_estimate("hll").alias("estimate"))


def merged(found: DataFrame) -> DataFrame:
    return found.agg(F.hll_union_agg("hll").alias("hll"))


def similarity(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(|A| + |B| - |A or B|) / |A| per (left_id, right_id)."""
    a = found.select(F.col("sketch_id").alias("left_id"), F.col("hll").alias("a"))
    b = found.select(F.col("sketch_id").alias("right_id"), F.col("hll").alias("b"))
    size = F.hll_sketch_estimate
    both = pairs.join(a, "left_id").join(b, "right_id")
    return both.select("left_id", "right_id", F.when(size("a") > 0, (size("a") + size("b") - size(F.hll_union("a", "b"))) / size("a")).alias("similarity"))

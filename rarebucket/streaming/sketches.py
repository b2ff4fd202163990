"""Sketches over streams: the winner per window, group and bucket.

The minimum of hashes is idempotent, so replayed rows don't change a winner; state is a number per window, group and filled
bucket. Counts of winners would not be idempotent and are left to batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebucket.functions.hashing import hash_key, unsigned_order
from rarebucket.functions.registers import bucket_of, score
from rarebucket.operators.sketch import BUCKETS


def windowed_winners(events: DataFrame, key: str, by: str, time: str = "ts", window: str = "1 hour", late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(window_start, sketch_id, bucket, winner) for batch or streaming ``events``."""
    rows = events.filter(F.col(key).isNotNull()).withWatermark(time, late).select(F.col(time).alias("ts"), F.col(by).cast("string").alias("sketch_id"), F.col(key).cast("long").alias("key"))
    hashed = hash_key(rows, "key").select("ts", "sketch_id", bucket_of(F.col("hash"), buckets).alias("bucket"), unsigned_order(F.col("hash")).alias("order"))
    least = hashed.groupBy(F.window("ts", window).alias("w"), "sketch_id", "bucket").agg(F.min("order").alias("order"))
    return least.select(F.col("w.start").alias("window_start"), "sketch_id", "bucket", score(unsigned_order(F.col("order"))).alias("winner"))

"""Rarest-hash sketches: per group and bucket the largest score, and how often it occurred.

Sketches live in long form, a row per filled bucket: (sketch_id, bucket, winner, n) with n not capped, so that merging
is exact. Winners alone need one aggregation: within a bucket the largest score is that of the smallest hash, so
a partial minimum of a number reduces the input to ``buckets`` rows per sketch and task before the shuffle, and scores are
computed for those rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebucket.functions import registers as R
from rarebucket.functions.hashing import hash_key, unsigned_order

BUCKETS, K = 2048, 25
#: Registers (sketches times filled buckets) that are broadcast at most.
SMALL = 1_000_000
#: Bytes of an input from which reading it twice is cheaper than moving its (bucket, score) combinations.
LARGE = 4 << 30


def _keyed(df: DataFrame, key: str | Column, by: str | Column | None) -> DataFrame:
    """(sketch_id, key) without null keys. Both are known not to be null, else joins on the bucket would push a null test of the
    whole hash expression down, which is too large for one generated method."""
    ident = F.lit("all") if by is None else F.col(by) if isinstance(by, str) else by
    rows = df.select(F.coalesce(ident.cast("string"), F.lit("")).alias("sketch_id"), (F.col(key) if isinstance(key, str) else key).cast("long").alias("key")).filter("key IS NOT NULL")
    return rows.withColumn("key", F.coalesce("key", F.lit(0).cast("long")))


def winners(df: DataFrame, key: str | Column, by: str | Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(sketch_id, bucket, winner): the fast path for cardinality and comparison."""
    hashed = hash_key(_keyed(df, key, by), "key").select("sketch_id", R.bucket_of(F.col("hash"), buckets).alias("bucket"), unsigned_order(F.col("hash")).alias("order"))
    least = hashed.groupBy("sketch_id", "bucket").agg(F.min("order").alias("order"))
    return least.select("sketch_id", "bucket", unsigned_order(F.col("order")).alias("hash")).select("sketch_id", "bucket", R.score(F.col("hash")).alias("winner"))


def registers(df: DataFrame, key: str | Column, by: str | Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(sketch_id, bucket, winner, n): also how many keys had the winning score."""
    hashed = hash_key(_keyed(df, key, by), "key").select("sketch_id", R.bucket_of(F.col("hash"), buckets).alias("bucket"), R.score(F.col("hash")).alias("score"))
    return best(hashed.groupBy("sketch_id", "bucket", "score").agg(F.count("*").alias("n")))


def registers_in_two_passes(df: DataFrame, key: str | Column, by: str | Column | None = None, buckets: int = BUCKETS, most: int = SMALL) -> DataFrame:
    """The same as ``registers`` for inputs much larger than their sketches.

    ``registers`` shuffles every (bucket, score) that a task meets, which for many keys a bucket is not much less than the keys.
    Here a first pass finds the winners; if these are ``most`` rows at most, they are broadcast, the second pass counts
    only keys that reach them, and both passes shuffle a row per task and bucket. Beyond, it is ``registers``.
    """
    top = winners(df, key, by, buckets).limit(most + 1).toArrow()
    if len(top) > most:
        return registers(df, key, by, buckets)
    top = F.broadcast(df.sparkSession.createDataFrame(top))
    hashed = hash_key(_keyed(df, key, by), "key").select("sketch_id", R.bucket_of(F.col("hash"), buckets).alias("bucket"), R.score(F.col("hash")).alias("winner"))
    return hashed.join(top, ["sketch_id", "bucket", "winner"]).groupBy("sketch_id", "bucket", "winner").agg(F.count("*").alias("n"))


def best(counted: DataFrame) -> DataFrame:
    """The largest score per bucket of (sketch_id, bucket, score, n) rows; n of equal scores must be summed before."""
    top = counted.groupBy("sketch_id", "bucket").agg(F.max(F.struct("score", "n")).alias("x"))
    return top.select("sketch_id", "bucket", F.col("x.score").alias("winner"), F.col("x.n").alias("n"))


def merged(*frames: DataFrame) -> DataFrame:
    """Union of sketches by id: the larger winner wins, equal winners add their counts."""
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other)
    return best(rows.groupBy("sketch_id", "bucket", F.col("winner").alias("score")).agg(F.sum("n").alias("n")))


def merge_dense(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union by id of dense sketches, rows of (sketch_id, bucket, register); a sketch that one side lacks is the other's."""
    other = right.select("sketch_id", "bucket", F.col("register").alias("other"))
    own, other_ = F.coalesce("register", F.lit(0).cast("long")), F.coalesce("other", F.lit(0).cast("long"))
    return left.join(other, ["sketch_id", "bucket"], "full").select("sketch_id", "bucket", R.merge_registers(own, other_).alias("register"))


@dataclass(frozen=True)
class Sketch:
    """Sketches of one width, a row per filled bucket in ``rows``. ``ids`` lists the sketches if empty ones are to be kept."""

    rows: DataFrame
    ids: DataFrame | None = None
    buckets: int = BUCKETS
    k: int = K

    @staticmethod
    def build(df: DataFrame, key: str | Column, by: str | Column | None = None, buckets: int = BUCKETS, k: int = K, ids: DataFrame | None = None, passes: int | None = None) -> Sketch:
        """``passes=2`` reads the input twice and moves far less of it; None chooses it for inputs that the optimizer takes for LARGE."""
        R.checked_buckets(buckets)
        R.checked_k(k)
        if passes is None:
            passes = 2 if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= LARGE else 1
        rows = (registers_in_two_passes if passes == 2 else registers)(df, key, by, buckets)
        return Sketch(rows, None if ids is None else ids.select("sketch_id"), buckets, k)

    def names(self) -> DataFrame:
        """(sketch_id) of all sketches; without a list those that have rows, so that results per sketch need no second look at them."""
        return self.rows.select("sketch_id").distinct() if self.ids is None else self.ids

    def _listed(self, more: DataFrame) -> DataFrame | None:
        return None if self.ids is None else self.ids.union(more.select("sketch_id")).distinct()

    def add(self, df: DataFrame, key: str | Column, by: str | Column | None = None) -> Sketch:
        """The sketch after more keys; as if all had come at once."""
        more = registers(df, key, by, self.buckets)
        return Sketch(merged(self.rows, more), self._listed(more), self.buckets, self.k)

    def merge(self, other: Sketch) -> Sketch:
        if other.buckets != self.buckets:
            raise ValueError(f"sketches of {self.buckets} and {other.buckets} buckets can't be merged")
        ids = None if self.ids is None and other.ids is None else self.names().union(other.names()).distinct()
        return Sketch(merged(self.rows, other.rows), ids, self.buckets, self.k)

    def clear(self) -> Sketch:
        return Sketch(self.rows.limit(0), self.names(), self.buckets, self.k)

    def winner_counts(self) -> DataFrame:
        """(sketch_id, bucket, count), counts capped at 65,535, filled buckets only."""
        return self.rows.select("sketch_id", "bucket", F.least("n", F.lit(R.MOST_COUNT)).cast("int").alias("count"))

    def saturation(self) -> DataFrame:
        """(sketch_id, saturated): whether a final winner occurred more often than a register can count."""
        over = self.rows.groupBy("sketch_id").agg(F.max("n").alias("most"))
        known = over if self.ids is None else self.ids.join(over, "sketch_id", "left")
        return known.select("sketch_id", (F.coalesce("most", F.lit(0)) > R.MOST_COUNT).alias("saturated"))

    def dense(self) -> DataFrame:
        """(sketch_id, bucket, register) for every bucket, packed as winner * 65536 + count, 0 if empty."""
        every = self.names().select("sketch_id", F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1))).alias("bucket"))
        packed = self.rows.select("sketch_id", "bucket", R.pack(F.col("winner"), F.least("n", F.lit(R.MOST_COUNT))).alias("register"))
        return every.join(packed, ["sketch_id", "bucket"], "left").select("sketch_id", "bucket", F.coalesce("register", F.lit(0)).alias("register"))

    def cardinality(self) -> DataFrame:
        from rarebucket.operators.estimate import cardinality

        return cardinality(self.rows, self.buckets, self.ids)

    def hybrid_cardinality(self) -> DataFrame:
        from rarebucket.operators.estimate import hybrid

        return hybrid(self.rows, self.buckets, self.ids)

    def compare(self, left: str, right: str, include_cardinality: bool = False) -> DataFrame:
        from rarebucket.operators.compare import compare

        return compare(self.rows, self.rows.sparkSession.createDataFrame([(left, right)], "left_id string, right_id string"), self.buckets, include_cardinality)

    def metrics(self, left: str, right: str) -> DataFrame:
        from rarebucket.operators.compare import with_metrics

        return with_metrics(self.compare(left, right), self.k)

"""Distinct counts from sketches.

``minimum_mle`` is the estimator in use; the others are for experiments: ``mean_m``, linear counting over the lowest tier with a free
bucket (``lc``), the error-weighted mean of linear counting over tiers (``dlc``), the occupancy-corrected mean
(``mean_m_raw``), and two blends of ``lc`` with the corrected mean, placed by ``lc`` (``lc_hybrid``) or by
``dlc`` (``dlc_hybrid``). Sums of restored hashes are exact decimals, so they don't depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebucket.functions import registers as R

RANGE = float(1 << 64)
TIERS = 65

# Fixed values of the estimators.
DLC_BLEND_LOW, DLC_BLEND_HIGH, DLC_MIN_FRACTION, DLC_POWER = 0.088, 0.952, 0.002, 4.5
HYBRID_LOW, HYBRID_HIGH = 0.2, 5.0
#: Correction of the raw mean at estimates 2^8 .. 2^20, in single precision.
CORRECTION_FROM = 8
CORRECTIONS = (
    0.92533006, 0.887325502, 0.833883596, 0.810002197, 0.850952315, 0.948926187, 0.998481533,
    0.999045759, 0.996665452, 1.00076597, 0.999102624, 0.99457023, 1.00041684,
)


def _single(x: float) -> float:
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def minimum_mle(buckets: Column, filled: Column, restored: Column) -> Column:
    return F.when(filled > 0, buckets * filled / (buckets - filled + restored / RANGE)).otherwise(0.0)


def mean_m(buckets: Column, filled: Column, restored: Column) -> Column:
    return F.when((filled > 0) & (restored > 0), buckets * filled * RANGE / restored).otherwise(0.0)


def _listed(found: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of ``found`` per sketch, with a row per id if ids are given. Without, ``found`` is all there is and needs no second look at the registers."""
    return found if ids is None else ids.select("sketch_id").join(found, "sketch_id", "left")


def sums(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(sketch_id, filled, restored); with ids a row per id, empty sketches included."""
    found = rows.groupBy("sketch_id").agg(F.count("*").alias("f"), F.sum(R.restore(F.col("winner"))).alias("r"))
    return _listed(found, ids).select("sketch_id", F.coalesce("f", F.lit(0)).alias("filled"), F.coalesce(F.col("r").cast("double"), F.lit(0.0)).alias("restored"))


def cardinality(rows: DataFrame, buckets: int, ids: DataFrame | None = None) -> DataFrame:
    """(sketch_id, empty, cardinality, mean_m)."""
    b, f = F.lit(float(R.checked_buckets(buckets))), F.col("filled").cast("double")
    return sums(rows, ids).select("sketch_id", (F.lit(buckets) - F.col("filled")).alias("empty"), minimum_mle(b, f, F.col("restored")).alias("cardinality"), mean_m(b, f, F.col("restored")).alias("mean_m"))


def zeros_histogram(rows: DataFrame) -> DataFrame:
    """(sketch_id, zeros, n): filled buckets by the leading zeros of the winner."""
    return rows.groupBy("sketch_id", F.shiftright("winner", R.MANTISSA).alias("zeros")).agg(F.count("*").alias("n"))


def tiers(rows: DataFrame, buckets: int, ids: DataFrame | None = None) -> DataFrame:
    """(sketch_id, filled, restored, tier, free): at tier t the buckets that would be free if only hashes of t or more zeros counted.

    The registers are read once: all follows from their numbers and sums by leading zeros, 54 rows a sketch at most.
    """
    by = rows.groupBy("sketch_id", F.shiftright("winner", R.MANTISSA).alias("zeros")).agg(F.count("*").alias("n"), F.sum(R.restore(F.col("winner"))).alias("r"))
    found = by.groupBy("sketch_id").agg(F.sum("n").alias("f"), F.sum("r").alias("r"), F.collect_list(F.struct("zeros", "n")).alias("levels"))
    every = _listed(found, ids).select(
        "sketch_id", F.coalesce("f", F.lit(0)).alias("filled"), F.coalesce(F.col("r").cast("double"), F.lit(0.0)).alias("restored"), "levels", F.explode(F.sequence(F.lit(0), F.lit(TIERS - 1))).alias("tier"))
    below = F.aggregate(F.filter("levels", lambda x: x["zeros"] < F.col("tier")), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return every.select("sketch_id", "filled", "restored", "tier", (F.lit(buckets) - F.col("filled") + F.coalesce(below, F.lit(0))).alias("free"))


def correction(estimate: Column) -> Column:
    """The correction of the raw mean, linear between its knots and constant beyond."""
    knots = [(float(1 << CORRECTION_FROM + k), _single(v)) for k, v in enumerate(CORRECTIONS)]
    out = F.lit(knots[-1][1])
    for (a, v), (b, w) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(estimate < b, F.lit(v) + (estimate - a) / (b - a) * F.lit(_single(w - v))).otherwise(out)
    return F.when(estimate <= knots[0][0], F.lit(knots[0][1])).otherwise(out)


def _blend(low: Column, zone: Column, high: Column, buckets: int) -> Column:
    a, b = HYBRID_LOW * buckets, HYBRID_HIGH * buckets
    t = F.ln(zone / a) / math.log(b / a)
    return F.when(zone <= a, low).when(zone >= b, high).otherwise((1 - t) * low + t * high)


def hybrid(rows: DataFrame, buckets: int, ids: DataFrame | None = None) -> DataFrame:
    """(sketch_id, lc_hybrid, dlc_hybrid, lc, dlc, mean_m_raw)."""
    b = float(R.checked_buckets(buckets))
    least = max(1.0, b * DLC_MIN_FRACTION)
    free, usable = F.col("free").cast("double"), F.col("free").between(least, b - least)
    level = F.ln(F.lit(b) / free)
    guess = F.pow(F.lit(2.0), F.col("tier")) * b * level
    error = math.sqrt(2 / math.pi) * F.sqrt((b - free) / (b * free)) / level
    weight = F.when(usable, F.pow(1 / error, F.lit(DLC_POWER)))
    per = tiers(rows, buckets, ids).groupBy("sketch_id").agg(
        F.max("filled").alias("filled"), F.max("restored").alias("restored"), (F.lit(b) - F.max("filled")).alias("empty"),
        F.min(F.when(F.col("free") > 0, F.struct("tier", guess.alias("v")))).alias("first"),
        F.sum(weight).alias("w"), F.sum(weight * F.when(usable, F.ln(guess))).alias("wl"))
    lc = F.coalesce(F.col("first.v"), F.lit(0.0))
    pure = F.exp(F.col("wl") / F.col("w"))
    t = (F.col("empty") - DLC_BLEND_LOW * b) / ((DLC_BLEND_HIGH - DLC_BLEND_LOW) * b)
    dlc = F.when(F.col("w").isNull() | (F.col("w") == 0) | (F.col("empty") >= DLC_BLEND_HIGH * b), F.col("lc")).when(F.col("empty") > DLC_BLEND_LOW * b, t * F.col("lc") + (1 - t) * pure).otherwise(pure)
    found = per.withColumn("lc", lc).withColumn("dlc", dlc)
    f, s = F.col("filled").cast("double"), F.col("restored")
    raw = F.when((f > 0) & (s > 0), RANGE / (s / f) * f * ((f + b) / (2 * b))).otherwise(0.0)
    found = found.withColumn("mean_m_raw", raw).withColumn("corrected", F.col("mean_m_raw") * correction(F.col("dlc")))
    return found.select("sketch_id", _blend(F.col("lc"), F.col("lc"), F.col("corrected"), buckets).alias("lc_hybrid"), _blend(F.col("lc"), F.col("dlc"), F.col("corrected"), buckets).alias("dlc_hybrid"), "lc", "dlc", "mean_m_raw")

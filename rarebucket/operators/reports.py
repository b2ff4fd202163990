"""Tables of experiments: errors, throughput by group, speed-ups, acceptance gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebucket.functions.registers import billions, micros, percent, signed_error
from rarebucket.operators.medians import medians


def with_errors(df: DataFrame, estimate: str = "estimate", exact: str = "exact") -> DataFrame:
    error = signed_error(F.col(estimate), F.col(exact))
    return df.withColumn("signed_error", error).withColumn("absolute_error", F.abs(error))


def accuracy_summary(df: DataFrame, *by: str) -> DataFrame:
    """Mean absolute error in per cent and mean estimate by group, and the exact count."""
    return df.groupBy(*by).agg(percent(F.avg("absolute_error")).alias("mean_absolute_percent"), F.avg("estimate").alias("mean_estimate"), F.min("exact").alias("exact"))


def median_throughput(df: DataFrame) -> DataFrame:
    return medians(df, "adds_per_second", "implementation", "count", name="median_adds")


def speedup(medians: DataFrame, of: str, over: str) -> DataFrame:
    """(count, speedup) where both implementations have a median."""
    mine = lambda name: F.col("count").isNotNull() & (F.col("implementation") == name)
    wide = medians.groupBy("count").agg(
        F.max(F.when(mine(of), F.col("median_adds"))).alias("a"), F.max(F.when(mine(over), F.col("median_adds"))).alias("b"), (F.bool_or(mine(of)) & F.bool_or(mine(over))).alias("both"))
    return wide.filter("both").select("count", (F.col("a") / F.col("b")).alias("speedup"))


def benchmark_base(name: Column) -> Column:
    """The name without a fixture suffix and its number."""
    base = F.regexp_extract(name, r"^(.+?)Fixture\d*$", 1)
    return F.when(base != "", base).otherwise(name)


def subject(name: Column) -> Column:
    """What a benchmark is of, from names like ``Some_5/insert/1024``: the first part up to an underscore, in small letters, without fixture."""
    return F.regexp_replace(F.lower(F.substring_index(F.substring_index(name, "/", 1), "_", 1)), "fixture$", "")


def fixture_parts(name: Column) -> Column:
    """(base, operation, size) of names like ``SomeFixture2/insert/1024/...``; size 0 if the third part isn't digits. Other names give null."""
    parts = F.split(name, "/")
    first = F.regexp_replace(parts[0], '^"+|"+$', "")
    base = F.regexp_extract(first, r"^(.+?)Fixture\d*$", 1)
    third = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(""))
    size = F.when(third.rlike("^[0-9]+$"), third.cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when((F.size(parts) >= 2) & (base != ""), F.struct(F.lower(base).alias("base"), F.try_element_at(parts, F.lit(2)).alias("operation"), size.alias("size")))


def series(df: DataFrame, kind: str, estimators: Sequence[str] | None = None, name: str = "Estimator") -> DataFrame:
    """Rows whose name ends with ``_kind``, with ``series`` (the name without it); of the estimators asked for, those without rows are absent."""
    rows = df.filter(F.col(name).endswith(f"_{kind}")).withColumn("series", F.regexp_replace(name, f"_{kind}$", ""))
    return rows if estimators is None else rows.filter(F.col("series").isin(*estimators))


def construction_series(df: DataFrame, estimators: Sequence[str] | None = None) -> DataFrame:
    """(series, Items, giga): median throughput in 1e9 elements a second."""
    return series(df, "construction", estimators).select("series", "Items", billions(F.col("throughput")).alias("giga"))


def latency_series(df: DataFrame, estimators: Sequence[str] | None = None) -> DataFrame:
    """(series, Items, micros): median time of an estimate in microseconds."""
    return series(df, "cardinality", estimators).select("series", "Items", micros(F.col("seconds")).alias("micros"))


def measured(df: DataFrame) -> DataFrame:
    return df.filter(F.col("phase") == "measured")


def go_gate(df: DataFrame, fast: str, slow: str) -> DataFrame:
    """Medians of two backends over measured runs, and whether the fast one is faster in both and all its runs are ok."""
    rows = measured(df)
    out = rows.agg(F.bool_and(F.when(F.col("backend") == fast, F.col("status") == "ok").otherwise(True)).alias("all_ok"))
    for column, name in (("construction_ms", "construction"), ("total_ms", "total")):
        found = medians(rows.filter(F.col("backend").isin(fast, slow)), column, "backend")
        of = lambda backend: F.max(F.when(F.col("backend") == backend, F.col("median")))
        out = found.agg(of(fast).alias(f"fast_{name}"), of(slow).alias(f"slow_{name}")).crossJoin(out)
    go = (F.col("fast_total") < F.col("slow_total")) & (F.col("fast_construction") < F.col("slow_construction")) & F.col("all_ok")
    return out.withColumn("speedup", F.col("slow_total") / F.col("fast_total")).withColumn("go", F.coalesce(go, F.lit(False)))


def acceptance(df: DataFrame, k: int = 25) -> DataFrame:
    """Gates per true identity over rows of (identity, system, ani, wkid): ``own`` against ``baseline``.

    Errors are in percentage points. A missing or NaN metric makes a row invalid. Without valid rows of a system the point fails.
    """
    truth = F.col("identity") / 100
    bad = F.col("ani").isNull() | F.col("wkid").isNull() | F.isnan("ani") | F.isnan("wkid")
    rows = df.withColumn("bad", bad).withColumn("e", F.when(~F.col("bad"), percent(F.col("ani") - truth))).withColumn("w", F.when(~F.col("bad"), percent(F.col("wkid") - F.pow(truth, F.lit(k)))))
    columns = []
    for s in ("own", "baseline"):
        mine = lambda c: F.when(F.col("system") == s, F.col(c))  # noqa: E731, B023
        columns += [F.avg(F.abs(mine("e"))).alias(f"{s}_mae"), F.avg(F.abs(mine("w"))).alias(f"{s}_wkid_mae"), F.coalesce(F.stddev_samp(mine("e")), F.lit(0.0)).alias(f"{s}_sd"), F.coalesce(F.stddev_samp(mine("w")), F.lit(0.0)).alias(f"{s}_wkid_sd"),
                    F.avg(mine("bad").cast("int")).alias(f"{s}_invalid")]
    out = rows.groupBy("identity").agg(*columns)
    bound = percent(F.pow(truth, F.lit(k)) - F.pow(F.greatest(F.lit(0.0), truth - 0.001), F.lit(k)))
    own, base = (lambda c: F.col(f"own_{c}")), (lambda c: F.col(f"baseline_{c}"))
    gates = {
        "mae_ok": own("mae") - base("mae") <= 0.1, "wkid_ok": own("wkid_mae") - base("wkid_mae") <= F.col("wkid_bound"),
        "sd_ok": own("sd") <= 1.2 * base("sd") + 0.05, "wkid_sd_ok": own("wkid_sd") <= 1.2 * base("wkid_sd") + 0.05, "invalid_ok": own("invalid") - base("invalid") <= 0.02,
    }
    out = out.withColumn("wkid_bound", bound).withColumns({n: F.coalesce(g, F.lit(False)) for n, g in gates.items()})
    return out.withColumn("pass", F.expr(" AND ".join(gates)))

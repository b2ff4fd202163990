"""Command-line jobs: ``python -m rarebucket.plans.jobs fasta|accuracy|throughput|profile|synthetic|acceptance|gate ...``.

Each prints or writes a table. Bad parameters end with status 2; a gate or an acceptance that fails, and a file comparison that fails, with 1.
"""

from __future__ import annotations

import argparse
import datetime
import os
import platform
import socket
import sys
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarebucket.functions.hashing import mix
from rarebucket.functions.registers import percent
from rarebucket.operators import compare as C
from rarebucket.operators import estimate as E
from rarebucket.operators import reports as P
from rarebucket.operators import sketch as S
from rarebucket.sources import fasta, files, reports, synthetic

LEVELS = (85.0, 87.0, 90.0, 95.0, 97.0, 99.0, 99.9, 100.0)


def read_files(spark: SparkSession, reference: str, query: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, kmer) of both sides, and their sequence statistics together (one row). A side may be several files."""
    rows, stats = None, None
    for name, path in (("query", query), ("reference", reference)):
        ranges = fasta.ranges(spark, path, k)
        one, own = fasta.range_kmers(ranges, k).select(F.lit(name).alias("id"), "kmer"), fasta.range_statistics(ranges, k)
        rows, stats = (one, own) if rows is None else (rows.union(one), stats.union(own))
    return rows, stats.agg(*[F.sum(c).alias(c) for c in ("bases", "valid_kmers", "invalid_windows")])


def pair(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("query", "reference")], "left_id string, right_id string")


def compare_files(spark: SparkSession, reference: str, query: str, k: int = S.K, buckets: int = S.BUCKETS) -> DataFrame:
    """One row: sequence statistics of both sides together, the counts of the query against the reference, and the metrics."""
    rows, stats = read_files(spark, reference, query, k)
    found = C.with_metrics(C.compare(S.winners(rows, "kmer", "id", buckets), pair(spark), buckets), k)
    return found.join(stats.withColumnRenamed("bases", "sequence_bases"))


def timed_run(spark: SparkSession, reference: str, query: str, k: int, buckets: int) -> dict:
    """The columns of a run table that a comparison fills, phase by phase.

    Preprocessing reads the files for their statistics, construction reads them for the sketches, which are
    materialised, comparison counts registers, and metrics are of those counts.
    """
    clock = [time.perf_counter()]
    lap = lambda: clock.append(time.perf_counter()) or 1000 * (clock[-1] - clock[-2])
    out: dict = {}
    rows, stats = read_files(spark, reference, query, k)
    first = stats.first()
    out |= {"sequence_bases": first.bases or 0, "valid_kmers": first.valid_kmers or 0, "invalid_windows": first.invalid_windows or 0, "preprocess_ms": lap()}
    sketches = S.winners(rows, "kmer", "id", buckets).persist()
    try:
        sketches.count()
        out["construction_ms"] = lap()
        counts = C.compare(sketches, pair(spark), buckets).toPandas()
        out["comparison_ms"] = lap()
        found = C.with_metrics(spark.createDataFrame(counts), k).first()
        out |= {c: found[c] for c in ("lower", "equal", "higher", "wkid", "ani")} | {"metric_ms": lap()}
    finally:
        sketches.unpersist()
    return out | {"total_ms": 1000 * (clock[-1] - clock[0])}


def fasta_runs(spark: SparkSession, reference: str, query: str, k: int, buckets: int, runs: int, warmup: int, backend: str = "spark", dataset: str = "") -> DataFrame:
    """A run table with a row per run, warm-ups first. A run that fails is a row with its error."""
    S.R.checked_buckets(buckets)
    S.R.checked_k(k)
    digest = lambda path: ",".join(r.sha256 for r in files.checksums(spark, path).orderBy("path").collect())
    known = {"schema_version": "1", "dataset": dataset, "reference_path": reference, "query_path": query, "reference_sha256": digest(reference), "query_sha256": digest(query), "backend": backend, "k": k, "buckets": buckets, "root_seed": 42,
             "hostname": socket.gethostname(), "cpu_model": platform.processor() or platform.machine(), "cpu_logical_count": str(os.cpu_count()), "os": platform.platform(), "kernel": platform.release(), "driver_version": f"spark {spark.version}"}
    name, rows = uuid.uuid4().hex[:12], []
    for i in range(warmup + runs):
        row = known | {"run_id": f"{name}-{i}", "timestamp_utc": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "phase": "warmup" if i < warmup else "measured", "warmup": int(i < warmup), "run_index": i if i < warmup else i - warmup}
        try:
            row |= timed_run(spark, reference, query, k, buckets) | {"status": "ok"}
        except Exception as error:  # noqa: BLE001  (a failed run is part of the table)
            row |= {"status": "failed", "error": f"{type(error).__name__}: {error}".splitlines()[0]}
        rows.append(row)
    schema = spark.createDataFrame([], reports.RUN_SCHEMA).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def trial_rows(spark: SparkSession, powers: Sequence[int], trials: int, seed: int) -> DataFrame:
    """(id, key): 2^power distinct keys for each (power, trial), by one plan, however many there are.

    Points are cut into blocks of counters, so a large point spreads over tasks. Keys are i * factor + seed modulo 2^50, with
    the factor in halves of 25 bits; i stays under 2^24, so no product overflows.
    """
    if max(powers, default=0) > 24:
        raise ValueError("powers go up to 24")
    half, block = (1 << 25) - 1, 1 << 14
    points = []
    for p in powers:
        for t in range(trials):
            own = synthetic.trial_seed(seed, p, t)
            factor = mix(own) | 1
            points.append((f"{p}-{t}", 1 << p, own & synthetic.MASK, factor & half, factor >> 25 & half))
    rows = spark.createDataFrame(points, "id string, n long, seed long, low long, high long")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block).cast("long"))))
    if len(points) > 1:
        rows = rows.repartition("id", "block")
    rows = rows.withColumn("i", F.explode(F.sequence(F.col("block") * block, F.least("n", (F.col("block") + 1) * block) - 1)))
    product = F.col("i") * F.col("low") + F.shiftleft((F.col("i") * F.col("high")).bitwiseAND(half), 25)
    return rows.select("id", (product + F.col("seed")).bitwiseAND(synthetic.MASK).alias("key"))


def accuracy(spark: SparkSession, powers: Sequence[int], trials: int, seed: int) -> DataFrame:
    """Estimator, Items, Trial, Exact, Estimate and errors for distinct keys: one sketch per (power, trial), all estimators."""
    rows = trial_rows(spark, powers, trials, seed)
    found = S.winners(rows, "key", "id")
    hll = rows.groupBy(F.col("id").alias("sketch_id")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("key", F.lit(11))).cast("double").alias("hll"))
    wide = E.cardinality(found, S.BUCKETS).select("sketch_id", F.col("cardinality").alias("mle")).join(E.hybrid(found, S.BUCKETS).select("sketch_id", "lc_hybrid", "dlc_hybrid"), "sketch_id").join(hll, "sketch_id")
    long = wide.unpivot("sketch_id", ["mle", "lc_hybrid", "dlc_hybrid", "hll"], "Estimator", "estimate")
    part = F.split("sketch_id", "-")
    long = P.with_errors(long.withColumn("Items", F.pow(F.lit(2.0), part[0].cast("int")).cast("long")).withColumn("exact", F.col("Items")))
    return long.select("Estimator", "Items", part[1].cast("int").alias("Trial"), F.col("exact").alias("Exact"), F.col("estimate").alias("Estimate"), F.col("signed_error").alias("Signed Error"), F.col("absolute_error").alias("Absolute Error"))


def throughput(spark: SparkSession, counts: Sequence[int], runs: int, warmup: int) -> DataFrame:
    rows = []
    for n in counts:
        for trial in range(warmup + runs):
            began = time.perf_counter()
            estimate = E.cardinality(S.winners(synthetic.trial_keys(spark, n, trial), "key"), S.BUCKETS).first()["cardinality"]
            seconds = time.perf_counter() - began
            if trial >= warmup:
                rows.append(("spark", n, S.BUCKETS, trial - warmup, seconds, n / seconds, estimate))
    return spark.createDataFrame(rows, reports.THROUGHPUT_SCHEMA)


def profile(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """Every operation once: two overlapping sketches, their comparison both ways, cardinality and counts."""
    keys = synthetic.keys(spark, count + count // 2, seed)
    left = keys.filter(F.col("i") < count).select(F.lit("left").alias("id"), "key")
    right = keys.filter((F.col("i") < count // 2) | (F.col("i") >= count)).select(F.lit("right").alias("id"), "key")
    sketch = S.Sketch.build(left.union(right), "key", "id")
    pairs = spark.createDataFrame([("left", "right"), ("right", "left")], "left_id string, right_id string")
    return C.with_metrics(C.compare(sketch.rows, pairs, sketch.buckets, include_cardinality=True), sketch.k)


def synthetic_metrics(spark: SparkSession, replicates: int, bases: int) -> DataFrame:
    """(identity, replicate, system, ani, wkid) of genomes made with a known identity."""
    from rarebucket.functions.sequences import exploded

    point = F.concat_ws("/", F.col("identity").cast("string"), F.col("replicate").cast("string"))
    # both genomes of a pair come from one chain of numbers, so that each chain is made once
    sides = F.array(F.struct(F.concat(point, F.lit("/r")).alias("id"), F.col("reference").alias("s")), F.struct(F.concat(point, F.lit("/q")).alias("id"), F.col("query").alias("s")))
    both = synthetic.genomes(spark, list(LEVELS), replicates, bases).select(F.explode(sides).alias("x")).select("x.id", "x.s")
    names = [f"{level}/{r}" for level in LEVELS for r in range(replicates)]
    wanted = spark.createDataFrame([(f"{n}/q", f"{n}/r") for n in names], "left_id string, right_id string")
    found = C.with_metrics(C.compare(S.winners(exploded(both, "s", S.K, "id"), "kmer", "id"), wanted, S.BUCKETS), S.K)
    part = F.split("left_id", "/")
    return found.select(part[0].cast("double").alias("identity"), part[1].cast("int").alias("replicate"), F.lit("own").alias("system"), "ani", "wkid")


def synthetic_errors(spark: SparkSession, replicates: int, bases: int) -> DataFrame:
    """Errors in percentage points per true identity, own system, against the identity that made the genomes."""
    error = percent(F.col("ani") - F.col("identity") / 100)
    found = synthetic_metrics(spark, replicates, bases)
    return found.groupBy("identity").agg(F.avg(F.abs(error)).alias("mae"), F.coalesce(F.stddev_samp(error), F.lit(0.0)).alias("sd"), F.avg(F.col("ani").isNull().cast("int")).alias("invalid_rate"))


METRIC_SCHEMA = "identity double, replicate int, ani double, wkid double"


def accepted(spark: SparkSession, own: DataFrame, baseline: str) -> DataFrame:
    """The gates per identity of own metrics against those in a baseline's CSV (identity, replicate, ani, wkid)."""
    other = reports.load_csv(spark, baseline, METRIC_SCHEMA).withColumn("system", F.lit("baseline"))
    return P.acceptance(own.select("identity", "replicate", F.lit("own").alias("system"), "ani", "wkid").unionByName(other)).orderBy("identity")


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rarebucket", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("fasta")
    for name in ("--reference", "--query"):
        job.add_argument(name, required=True)
    for name, value in (("--k", S.K), ("--buckets", S.BUCKETS), ("--runs", 5), ("--warmup", 1)):
        job.add_argument(name, type=int, default=value)
    for name, value in (("--backend", "spark"), ("--dataset", "")):
        job.add_argument(name, default=value)
    job = jobs.add_parser("accuracy")
    for name, value in (("--trials", 32), ("--min-power", 8), ("--max-power", 24), ("--seed", 42)):
        job.add_argument(name, type=int, default=value)
    job = jobs.add_parser("throughput")
    for name, value in (("--count", 1 << 20), ("--warmup", 3), ("--runs", 10)):
        job.add_argument(name, type=int, default=value)
    job = jobs.add_parser("profile")
    for name, value in (("--count", 1 << 27), ("--seed", 42)):
        job.add_argument(name, type=int, default=value)
    job = jobs.add_parser("synthetic", help="metrics of synthetic genomes; with --baseline, their acceptance")
    for name, value in (("--replicates", 5), ("--bases", 1 << 20)):
        job.add_argument(name, type=int, default=value)
    job.add_argument("--baseline")
    job = jobs.add_parser("acceptance", help="metrics in one CSV against a baseline's in another")
    for name in ("--own", "--baseline"):
        job.add_argument(name, required=True)
    job = jobs.add_parser("gate")
    job.add_argument("--runs-csv", required=True, nargs="+")
    for name in ("--fast", "--slow"):
        job.add_argument(name, required=True)
    for job in jobs.choices.values():
        job.add_argument("--csv")
        job.add_argument("--json")
    a = parser.parse_args(arguments)
    spark, fine = SparkSession.builder.getOrCreate(), None
    try:
        if a.job == "fasta":
            out = fasta_runs(spark, a.reference, a.query, a.k, a.buckets, a.runs, a.warmup, a.backend, a.dataset)
            fine = "status = 'ok'"
        elif a.job == "accuracy":
            out = accuracy(spark, range(a.min_power, a.max_power + 1), a.trials, a.seed)
        elif a.job == "throughput":
            out = throughput(spark, [a.count], a.runs, a.warmup)
        elif a.job == "profile":
            out = profile(spark, a.count, a.seed)
        elif a.job == "synthetic" and not a.baseline:
            out = synthetic_metrics(spark, a.replicates, a.bases) if a.csv else synthetic_errors(spark, a.replicates, a.bases)
        elif a.job in ("synthetic", "acceptance"):
            own = synthetic_metrics(spark, a.replicates, a.bases) if a.job == "synthetic" else reports.load_csv(spark, a.own, METRIC_SCHEMA)
            out, fine = accepted(spark, own, a.baseline), "pass"
        else:
            out, fine = P.go_gate(reports.union_csv(spark, a.runs_csv, reports.RUN_SCHEMA), a.fast, a.slow), "go"
    except ValueError as error:
        parser.error(str(error))
    out = out.persist()
    for path, write in ((a.csv, reports.write_csv), (a.json, reports.write_json)):
        if path:
            write(out, path)
    if not a.csv and not a.json:
        out.show(100, truncate=False)
    return int(fine is not None and out.filter(f"NOT coalesce({fine}, false)").limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())

"""Result tables: CSV sinks and loads, unions of CSV files, and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The header of a file of runs, in its order. Blank where nothing is known.
RUN_HEADER = (
    "schema_version,run_id,timestamp_utc,phase,dataset,reference_path,reference_sha256,query_path,query_sha256,backend,k,buckets,root_seed,derived_seed,"
    "warmup,run_index,status,sequence_bases,valid_kmers,invalid_windows,preprocess_ms,allocation_ms,h2d_ms,construction_ms,comparison_ms,d2h_ms,metric_ms,"
    "total_ms,lower,equal,higher,wkid,ani,error,git_commit,manifest_sha256,bbtools_revision,cuda_version,driver_version,compiler_version,nvbench_revision,"
    "cccl_revision,cuco_revision,hostname,gpu_name,gpu_uuid,compute_capability,gpu_memory_bytes,free_gpu_memory_bytes,power_limit_w,persistence_mode,"
    "application_clocks,gpu_temperature_c,other_gpu_processes,cpu_model,cpu_logical_count,cpu_affinity,host_memory_bytes,os,kernel"
)
COUNTED = {"k", "buckets", "root_seed", "warmup", "run_index", "sequence_bases", "valid_kmers", "invalid_windows", "lower", "equal", "higher"}


def run_type(name: str) -> str:
    return "long" if name in COUNTED else "double" if name.endswith("_ms") or name in ("wkid", "ani") else "string"


RUN_SCHEMA = ", ".join(f"{name} {run_type(name)}" for name in RUN_HEADER.split(","))
ACCURACY_SCHEMA = "Estimator string, Items long, Trial int, Exact long, Estimate double, `Signed Error` double, `Absolute Error` double"
THROUGHPUT_SCHEMA = "implementation string, count long, buckets int, trial int, seconds double, adds_per_second double, estimate double"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def run_table(df: DataFrame) -> DataFrame:
    """All columns of a run table; what ``df`` doesn't have is null."""
    wanted = df.sparkSession.createDataFrame([], RUN_SCHEMA).schema
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def load_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The declared columns, found by name; other columns of the files are ignored, missing ones are null."""
    found = spark.read.option("header", True).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return found.select(*[(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def union_csv(spark: SparkSession, paths: list[str], schema: str, change: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Rows of all files; each file's header is left out of the data. ``change`` is applied to each file's rows with its path."""
    out = None
    for path in paths:
        rows = load_csv(spark, path, schema)
        rows = change(rows, path) if change else rows
        out = rows if out is None else out.unionByName(rows)
    return out


def first_reference(text: Column) -> Column:
    """Of the first JSON object in a text, the value of the first key that starts with ref and holds an object."""
    fields = F.from_json(F.regexp_extract(text, r"(?s)\{.*", 0), "map<string,string>")
    held = F.filter(F.map_entries(fields), lambda e: e["key"].startswith("ref") & e["value"].startswith("{"))
    return F.try_element_at(held, F.lit(1))["value"]


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

"""Medians by passes over buckets against Spark's own, and what their tasks read."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rarebucket.operators import reports as P
from rarebucket.operators.medians import magnitude, medians

RUN = "phase string, backend string, total_ms double, construction_ms double, status string"


def ulps(start: float, *steps: int) -> list[float]:
    first = struct.unpack("<q", struct.pack("<d", start))[0]
    return [struct.unpack("<d", struct.pack("<q", first + s))[0] for s in steps]


def odd_groups() -> dict:
    random.seed(3)
    inf, nan, tiny, huge = math.inf, math.nan, 5e-324, 1.7976931348623157e308
    near = random.sample(range(1 << 20), 501)
    groups = {
        "null": [None, None], "one": [7.5], "two": [1.0, 2.0], "some null": [None, 3.0, None, 5.0, 4.0], "same": [2.5] * 9, "zero": [-0.0, 0.0, 0.0], "signs": [-3.0, -1.0, 2.0, 9.0], "around zero": [-tiny, tiny, -1.0, 1.0],
        "nan": [nan, nan, 1.0], "half nan": [1.0, nan], "inf": [inf, inf, 1.0], "both inf": [-inf, inf], "huge": [huge, huge, 1.0, -huge], "tiny": [tiny, 2 * tiny, 3 * tiny, 0.0, tiny], "wide": [1e-300, 1.0, 1e300, 1e301],
        "ulps": ulps(1.0, *range(41)), "even ulps": ulps(1.0, *range(40)), "near": ulps(1234.5, *near), "below": [-v for v in ulps(1234.5, *near)], "apart": [*ulps(1.0, *range(20)), *ulps(1.001, *range(20))],
        "step": ulps(2.0, *range(-20, 21)), "spread": ulps(1e9, *[s << 33 for s in range(300)], *range(300)), None: [4.0, 6.0],
    }
    for size in (2, 3, 100, 1001):
        groups[f"random {size}"] = [random.choice((-1, 1)) * 10 ** random.uniform(-30, 30) for _ in range(size)]
        groups[f"prices {size}"] = [random.randint(900, 105000) / 100 for _ in range(size)]
        groups[f"bits {size}"] = [struct.unpack("<d", random.randbytes(8))[0] for _ in range(size)]
    return groups


def test_medians_are_those_of_spark(spark):
    rows = [(k, v) for k, values in odd_groups().items() for v in values]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    plain = lambda found: {r.k: repr(r.m) for r in found.collect()}
    want = plain(df.groupBy("k").agg(F.median("v").alias("m")))
    got = plain(medians(df, "v", "k", name="m"))
    assert {k: m.replace("-0.0", "0.0") if m == "-0.0" else m for k, m in got.items()} == {k: "0.0" if m == "-0.0" else m for k, m in want.items()}
    assert medians(df.filter("false"), "v", "k").collect() == []


def test_medians_of_whole_numbers_and_several_keys(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"), (F.col("id") * 7919 % 5000).cast("int").alias("v"), (F.col("id") * F.lit(3)).cast("decimal(12,2)").alias("d"))
    for column in ("v", "d"):
        want = df.groupBy("a", "b").agg(F.median(column).alias("median"))
        assert sorted(map(repr, medians(df, column, "a", "b").collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError):
        medians(df, "v")


def test_buckets_never_fall(spark):
    random.seed(9)
    values = [v for v in (struct.unpack("<d", random.randbytes(8))[0] for _ in range(20000)) if v == v]
    values += [s * w for p in range(-1074, 1024) for w in ulps(2.0**p, -1, 0, 1) for s in (-1, 1)] + [0.0, math.inf, -math.inf, math.nan]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", magnitude(F.col("v")).alias("p")).orderBy("v", "p").collect()
    assert all(x.p <= y.p for x, y in zip(rows, rows[1:], strict=False))
    special = {r.p for r in rows if r.v in (0.0, math.inf, -math.inf) or r.v != r.v}
    assert len(special) == 4 and not special & {r.p for r in rows if r.v == r.v and r.v not in (0.0, math.inf, -math.inf)}


def read_by_shuffles(spark, job) -> int:
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    none = gateway.new_array(gateway.jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleReadBytes() for s in (lambda seq: [seq.apply(i) for i in range(seq.size())])(store.stageList(None, False, False, none, gateway.jvm.java.util.ArrayList()))}
    before = set(stages())
    job()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30000)
    return sum(v for k, v in stages().items() if k not in before)


def test_medians_do_not_move_the_values(spark):
    """Ten times the distinct values: what tasks read from shuffles was in proportion, and one task read all. Now it grows with a 400th of them."""
    def moved(n: int, gate: bool) -> int:
        noise = (F.col("id") * 2654435761 % 1000003) / 1000003.0
        runs = spark.range(0, n, 1, 4).select(F.lit("measured").alias("phase"), F.when(F.col("id") % 2 == 0, "f").otherwise("s").alias("backend"), (1000 + 1000 * noise).alias("total_ms"), (1500 + 1000 * noise).alias("construction_ms"), F.lit("ok").alias("status"))
        if gate:
            return read_by_shuffles(spark, lambda: P.go_gate(runs, "f", "s").collect())
        return read_by_shuffles(spark, lambda: P.median_throughput(runs.select(F.col("backend").alias("implementation"), F.lit(1).alias("count"), F.col("total_ms").alias("adds_per_second"))).collect())

    for gate in (True, False):
        few, many = moved(40_000, gate), moved(400_000, gate)
        assert 0 < many < 4 * few and many < 1_000_000, (few, many)


def test_go_gate_of_no_runs_and_one_backend(spark):
    none = P.go_gate(spark.createDataFrame([], RUN), "f", "s").collect()
    assert len(none) == 1 and none[0].fast_total is None and none[0].go is False
    row = P.go_gate(spark.createDataFrame([("measured", "f", 1.0, 3.0, "ok"), ("measured", "f", 2.0, None, "bad"), ("measured", None, 9.0, 9.0, "bad")], RUN), "f", "s").first()
    assert (row.fast_total, row.slow_total, row.fast_construction, row.all_ok, row.go) == (1.5, None, 3.0, False, False)


def test_speedup_needs_both(spark):
    rows = [("a", 1, 6.0), ("b", 1, 3.0), ("a", 2, 5.0), ("b", 3, 5.0), ("a", None, 1.0), ("b", None, 1.0), (None, 2, 1.0), ("a", 4, None), ("b", 4, 1.0)]
    got = P.speedup(spark.createDataFrame(rows, "implementation string, count long, median_adds double"), "a", "b").collect()
    assert sorted(map(tuple, got)) == [(1, 2.0), (4, None)]

"""Sketches against a plain Python loop and known values."""

import math

import pytest
from pyspark.sql import functions as F

from rarebucket.functions import registers as R
from rarebucket.functions.hashing import MULTIPLIERS, hash_key, mix, signed
from rarebucket.operators import compare as C
from rarebucket.operators import estimate as E
from rarebucket.operators import sketch as S
from rarebucket.sources import synthetic

M = (1 << 64) - 1


def plain_score(h):
    zeros = min(64 - max(1, (h | 1).bit_length()), 53)
    return max(1, zeros << 10 | (~(h >> (53 - zeros)) & 1023))


def plain_sketch(keys, buckets=2048):
    out = {}
    for key in keys:
        h = mix(key ^ 42)
        b, s = h & buckets - 1, plain_score(h)
        w, n = out.get(b, (0, 0))
        out[b] = (s, 1) if s > w else (w, n + (s == w))
    return out


def plain_keys(n, seed):
    return [mix(seed + i & M) & (1 << 50) - 1 for i in range(n)]


@pytest.mark.parametrize(("key", "hash_", "bucket", "score"), [(0, 0xA759EA27D4727622, 1570, 709), (1, 0x4F0A61D9C798D8CA, 202, 1807), (42, 0, 0, 55295), (255, 0xFE501EB5BADDAD2C, 1324, 13), (95075992133360, 0x49CF44CB7B4110C0, 192, 1891)])
def test_known_hashes(spark, key, hash_, bucket, score):
    row = hash_key(spark.createDataFrame([(key,)], "key long"), "key").select("hash", R.bucket_of(F.col("hash"), 2048), R.score(F.col("hash"))).first()
    assert tuple(row) == (signed(hash_), bucket, score)


@pytest.mark.parametrize(("hash_", "score", "restored"), [(0, 55295, 0x400), (1, 55294, 0x401), (0x3FF, 54272, 0x7FF), (0x400, 55295, 0x400), (0x7FF, 54272, 0x7FF), (0x800, 54271, 0x800), (1 << 63, 1023, 1 << 63), (0xFFE0000000000000, 1, 0xFFC0000000000000), (M, 1, 0xFFC0000000000000)])
def test_known_scores(spark, hash_, score, restored):
    row = spark.createDataFrame([(signed(hash_),)], "h long").select(R.score(F.col("h")).alias("s")).select("s", R.restore(F.col("s"))).first()
    assert (row[0], int(row[1])) == (score, restored)


def test_multipliers_are_odd():
    assert all(m % 2 for m in MULTIPLIERS)


def test_registers_match_a_loop(spark):
    keys = synthetic.keys(spark, 50_000, 0x123456789ABCDEF0)
    got = {r.bucket: (r.winner, r.n) for r in S.registers(keys, "key").collect()}
    assert got == plain_sketch(plain_keys(50_000, 0x123456789ABCDEF0))
    assert (sum(w for w, _ in got.values()), sum(n for _, n in got.values()), max(got.values())[0]) == (11465940, 2049, 16120)
    assert {r.bucket: r.winner for r in S.winners(keys, "key").collect()} == {b: w for b, (w, _) in got.items()}


@pytest.mark.parametrize(("n", "seed", "want"), [(0, 0, 0.0), (1, 0x3333333333333334, 1.000280578160335), (512, 0x3333333333333333 + 512, 509.85383355475636), (4096, 0x3333333333333333 + 4096, 4033.813309428548), (1 << 16, 0x7777777777777777 + (1 << 16), 66429.4092089164)])
def test_cardinality(spark, n, seed, want):
    ids = spark.createDataFrame([("all",)], "sketch_id string")
    row = E.cardinality(S.winners(synthetic.keys(spark, n, seed), "key"), 2048, ids).first()
    assert math.isclose(row.cardinality, want, rel_tol=1e-6, abs_tol=1e-12)


@pytest.mark.parametrize(("power", "want"), [(0, (1.0002, 1.0002, 1.0002, 1.0002, 0.7875)), (9, (508.1219, 508.1408, 506.8498, 508.4611, 592.5205)), (12, (4163.6985, 4164.6914, 4060.5940, 4151.2957, 4934.1745)), (16, (65080.0055, 65080.0055, 64897.9635, 64917.5623, 65294.7993))])
def test_hybrid(spark, power, want):
    row = E.hybrid(S.winners(synthetic.keys(spark, 1 << power, 42), "key"), 2048).first()
    assert all(math.isclose(a, b, abs_tol=6e-5 * max(1, b / 1000)) for a, b in zip(row[1:], want, strict=True)), row


def test_hybrid_of_nothing(spark):
    ids = spark.createDataFrame([("x",)], "sketch_id string")
    assert tuple(E.hybrid(S.winners(spark.range(0), "id"), 2048, ids).first()) == ("x", 0.0, 0.0, 0.0, 0.0, 0.0)


def test_saturation(spark):
    for n, full in ((65535, False), (65536, True)):
        one = S.Sketch.build(spark.range(n), F.lit(7))
        assert [r["count"] for r in one.winner_counts().collect()] == [65535]
        assert [r.saturated for r in one.saturation().collect()] == [full]
    assert one.clear().saturation().first().saturated is False


def test_comparison(spark):
    a, b = synthetic.keys(spark, 40_000, 0x1111111111111111), synthetic.keys(spark, 30_000, 0x2222222222222222)
    rows = a.select(F.lit("a").alias("id"), "key").union(a.filter("i < 20000").select(F.lit("b"), "key")).union(b.select(F.lit("b"), "key"))
    sketch = S.Sketch.build(rows, "key", "id")
    row = sketch.metrics("a", "b").first()
    assert (row["lower"], row["equal"], row["higher"], row["both_empty"]) == (884, 604, 560, 0)
    assert [round(row[c], 12) for c in ("wkid", "ani", "containment", "completeness")] == [0.518900343643, 0.974099585025, 0.518900343643, 0.782258064516]
    same = sketch.compare("a", "a", include_cardinality=True).first()
    assert (same["lower"], same["equal"], same["higher"]) == (0, 2048, 0)
    assert same["cardinality"] > 0
    none = C.compare(sketch.rows, spark.createDataFrame([("a", "zz")], "left_id string, right_id string"), 2048).first()
    assert (none["lower"], none["equal"], none["higher"], none["both_empty"]) == (0, 0, 2048, 0)


def test_merge_is_exact(spark):
    rows = spark.range(20_000).select(F.pmod("id", F.lit(3000)).alias("key"), (F.col("id") % 3).alias("part"))
    parts = [S.Sketch.build(rows.filter(F.col("part") == p), "key") for p in range(3)]
    merged = parts[0].merge(parts[1]).merge(parts[2])
    order = lambda s: sorted(map(tuple, s.rows.collect()))
    assert order(merged) == order(S.Sketch.build(rows, "key"))
    assert order(parts[0].add(rows.filter("part > 0"), "key")) == order(merged)
    with pytest.raises(ValueError):
        parts[0].merge(S.Sketch.build(rows, "key", buckets=4096))


@pytest.mark.parametrize(("k", "buckets"), [(0, 2048), (32, 2048), (25, 1000), (25, 1024), (25, 1 << 18)])
def test_bad_parameters(spark, k, buckets):
    with pytest.raises(ValueError):
        S.Sketch.build(spark.range(1), "id", k=k, buckets=buckets)


@pytest.mark.parametrize("most", [10, 10**6])
def test_two_passes(spark, most):
    rows = spark.range(30_000).select(F.pmod("id", F.lit(700)).alias("key"), (F.col("id") % 3).alias("part"))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(S.registers_in_two_passes(rows, "key", "part", most=most)) == order(S.registers(rows, "key", "part"))
    assert S.Sketch.build(rows.limit(0), "key", passes=2).rows.count() == 0


def test_passes_follow_the_size(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(S, "registers_in_two_passes", lambda *a, f=S.registers_in_two_passes: asked.append(1) or f(*a))
    rows = spark.range(5000)
    one = sorted(map(tuple, S.Sketch.build(rows, "id").rows.collect()))
    assert not asked
    monkeypatch.setattr(S, "LARGE", 1000)
    assert sorted(map(tuple, S.Sketch.build(rows, "id").rows.collect())) == one and asked == [1]


def test_packed_registers(spark):
    rows = [(R_, n, w, m) for R_, n, w, m in ((0, 0, 0, 0), (5, 3, 5, 4), (5, 65535, 5, 1), (7, 1, 6, 9), (6, 9, 7, 1), (0, 0, 55295, 65535))]
    table = spark.createDataFrame(rows, "a int, n int, b int, m int").select("*", R.merge_registers(R.pack(F.col("a"), F.col("n")), R.pack(F.col("b"), F.col("m"))).alias("x"))
    for r in table.select("*", R.winner_of(F.col("x")).alias("w"), R.count_of(F.col("x")).alias("c")).collect():
        assert (r.w, r.c) == (max(r.a, r.b), min(65535, r.n * (r.a >= r.b) + r.m * (r.b >= r.a)))


def test_hyperloglog(spark):
    """Counts, merges and similarity within four standard errors of exact values."""
    from rarebucket.operators import hll

    bound = 4 * 1.04 / 2 ** (hll.PRECISION / 2)
    rows = spark.range(60_000).select("id", F.when(F.col("id") < 30_000, "a").otherwise("b").alias("part")).union(spark.range(15_000).select("id", F.lit("b")))
    found = hll.sketches(rows, "id", "part")
    got = {r.sketch_id: r.estimate for r in hll.estimates(found).collect()}
    assert abs(got["a"] / 30_000 - 1) < bound and abs(got["b"] / 45_000 - 1) < bound
    merged = hll.estimates(hll.merged(found).select(F.lit("all").alias("sketch_id"), "hll")).first().estimate
    assert abs(merged / 60_000 - 1) < bound
    alike = hll.similarity(found, spark.createDataFrame([("a", "b"), ("a", "a")], "left_id string, right_id string")).collect()
    assert {r.right_id: abs(r.similarity - (0.5 if r.right_id == "b" else 1.0)) < 6 * bound for r in alike} == {"a": True, "b": True}
    assert hll.estimates(hll.sketches(rows.limit(0), "id", "part")).count() == 0


def test_all_and_alike_pairs(spark):
    """All pairs against pairs compared one by one, among them sketches without a common bucket; no nested loop in the plan."""
    rows = spark.createDataFrame([(i, k) for i, ks in enumerate([range(300), range(150, 450), [7], [8], range(5000, 5400)]) for k in ks], "id int, key long")
    sketches = S.winners(rows, "key", "id")
    ids = [str(i) for i in range(5)]
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "left_id string, right_id string")
    order = lambda df: sorted(map(tuple, df.collect()))
    want = order(C.compare(sketches, pairs, 2048))
    every = C.all_pairs(sketches, 2048)
    assert order(every) == want and len(want) == 10
    assert "NestedLoop" not in every._jdf.queryExecution().executedPlan().toString()
    assert order(C.alike_pairs(sketches, 2048)) == [w for w in want if w[3] > 0]
    assert order(C.alike_pairs(sketches, 2048, least=100)) == [w for w in want if w[3] >= 100]


def test_null_keys_are_left_out(spark):
    rows = spark.createDataFrame([(None,), (5,)], "key long")
    assert S.registers(rows, "key").count() == 1


def test_streaming_winners(spark, tmp_path):
    from rarebucket.streaming.sketches import windowed_winners

    rows = spark.range(2000).select((F.col("id") % 90).alias("user"), F.lit("e").alias("kind"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_winners(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user", "kind")
    q = stream.writeStream.format("memory").queryName("winners").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(spark.table("winners")) == order(windowed_winners(rows, "user", "kind"))

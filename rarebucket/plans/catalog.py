"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarebucket.functions import registers as R
from rarebucket.functions import sequences as Q
from rarebucket.functions.hashing import hash_key
from rarebucket.operators import compare as C
from rarebucket.operators import estimate as E
from rarebucket.operators import hll, reports
from rarebucket.operators import sketch as S
from rarebucket.plans import sql
from rarebucket.sources import reports as sinks
from rarebucket.sources import synthetic
from rarebucket.streaming.sketches import windowed_winners

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable:
    """Register a function under its name, with SQL if there is any."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.winners(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


PARTS, ORDERS = sql.registers("lineitem", "l_partkey", "l_returnflag"), sql.registers("lineitem", "l_orderkey", "l_returnflag")


# --- hash, score, registers -----------------------------------------------------------------------------------------


@query(f"WITH {sql.hashed('orders', 'o_orderkey', 'o_orderkey')} SELECT o_orderkey, {sql.SIGNED} AS hash FROM m")
def hash_keys(spark, sf_dir):
    return hash_key(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"""WITH {sql.hashed('part', 'p_partkey', 'p_partkey')}, s AS (SELECT p_partkey, (h & 2047::UBIGINT)::INT AS bucket, {sql.SCORE} AS winner FROM m)
SELECT p_partkey, bucket, winner AS score, winner::BIGINT * 65536 + 7 AS packed, winner AS unpacked_winner, 7 AS unpacked_count, {sql.RESTORED}::DOUBLE AS restored FROM s""")
def bucket_score_restore(spark, sf_dir):
    rows = hash_key(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", R.bucket_of(F.col("hash"), 2048).alias("bucket"), R.score(F.col("hash")).alias("score"))
    rows = rows.withColumn("packed", R.pack(F.col("score"), F.lit(7)))
    return rows.select("p_partkey", "bucket", "score", "packed", R.winner_of(F.col("packed")).alias("unpacked_winner"), R.count_of(F.col("packed")).alias("unpacked_count"), R.restore(F.col("score")).cast("double").alias("restored"))


@query(f"WITH {PARTS} SELECT sketch_id, bucket, winner, n FROM r")
def sketch_registers(spark, sf_dir):
    return S.registers(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@query(f"WITH {PARTS} SELECT sketch_id, bucket, winner, n FROM r")
def sketch_registers_two_passes(spark, sf_dir):
    return S.registers_in_two_passes(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@query(f"WITH {PARTS} SELECT sketch_id, bucket, winner FROM r")
def sketch_winners(spark, sf_dir):
    return parts(spark, sf_dir)


@query(f"WITH {PARTS} SELECT sketch_id, bucket, least(n, 65535)::INT AS count FROM r")
def winner_counts(spark, sf_dir):
    return S.Sketch.build(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag").winner_counts()


@query(f"""WITH t AS (SELECT l_orderkey, unnest([1, 2]) AS copy FROM lineitem), {sql.registers("t", "7 * copy", "'c' || copy")},
f AS (SELECT l_orderkey AS x FROM lineitem)
SELECT sketch_id, bool_or(n > 65535) AS saturated, max(least(n, 65535))::BIGINT AS most FROM (SELECT sketch_id, n FROM r UNION ALL SELECT 'both', 2 * count(*) FROM f) GROUP BY sketch_id""")
def saturation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    one = S.Sketch.build(rows, F.col("copy") * 7, F.concat(F.lit("c"), F.col("copy")))
    both = S.Sketch.build(rows, F.lit(7), F.lit("both"))
    found = one.merge(both)
    most = found.winner_counts().groupBy("sketch_id").agg(F.max("count").cast("long").alias("most"))
    return found.saturation().join(most, "sketch_id")


@query(f"""WITH {PARTS}, i AS (SELECT DISTINCT sketch_id FROM r), q AS (SELECT sketch_id, unnest(range(2048))::INT AS bucket FROM i)
SELECT q.sketch_id, q.bucket, coalesce(winner::BIGINT * 65536 + least(n, 65535), 0)::BIGINT AS register FROM q LEFT JOIN r USING (sketch_id, bucket)""")
def dense_registers(spark, sf_dir):
    return S.Sketch.build(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag").dense()


# --- distinct counts ------------------------------------------------------------------------------------------------


@query(f"WITH {PARTS}, {sql.sums()} SELECT sketch_id, (2048 - filled)::BIGINT AS empty, round({sql.MLE}, 6) AS cardinality, round(b * filled * 18446744073709551616.0::DOUBLE / restored, 6) AS mean_m FROM z")
def cardinality_mle(spark, sf_dir):
    return rounded(E.cardinality(parts(spark, sf_dir), 2048), 6, "cardinality", "mean_m")


@query("SELECT unnest(['A', 'N']) AS sketch_id, 2048::BIGINT AS empty, 0.0::DOUBLE AS cardinality, 0.0::DOUBLE AS mean_m")
def cardinality_empty(spark, sf_dir):
    ids = spark.createDataFrame([("A",), ("N",)], "sketch_id string")
    nothing = table(spark, sf_dir, "lineitem").filter("l_partkey < 0")
    return E.cardinality(S.winners(nothing, "l_partkey", "l_returnflag"), 2048, ids)


def _widths() -> str:
    return " UNION ALL ".join(f"(WITH {sql.registers('orders', 'o_custkey', chr(39) + str(b) + chr(39), b)}, {sql.sums(b)} SELECT sketch_id AS buckets, ({b} - filled)::BIGINT AS empty, round({sql.MLE}, 6) AS cardinality FROM z)" for b in (2048, 4096, 131072))


@query(_widths())
def cardinality_buckets(spark, sf_dir):
    orders, out = table(spark, sf_dir, "orders"), None
    for b in (2048, 4096, 131072):
        one = rounded(E.cardinality(S.winners(orders, "o_custkey", F.lit(str(b)), b), b), 6, "cardinality").select(F.col("sketch_id").alias("buckets"), "empty", "cardinality")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {PARTS} SELECT sketch_id, winner >> 10 AS zeros, count(*)::BIGINT AS n FROM r GROUP BY ALL")
def nlz_histogram(spark, sf_dir):
    return E.zeros_histogram(parts(spark, sf_dir))


HYBRID = f"WITH {{}}, {sql.sums()}, {sql.hybrid()} SELECT sketch_id, {{}} FROM y"
FIVE = ("lc_hybrid", "dlc_hybrid", "lc", "dlc", "mean_m_raw")
FOUR_PLACES = ", ".join(f"round({c}, 4) AS {c}" for c in FIVE)


@query(HYBRID.format(PARTS, "round(lc, 4) AS lc"))
def linear_counting(spark, sf_dir):
    return rounded(E.hybrid(parts(spark, sf_dir), 2048), 4, "lc").select("sketch_id", "lc")


@query(HYBRID.format(PARTS, "round(dlc, 4) AS dlc"))
def tiered_counting(spark, sf_dir):
    return rounded(E.hybrid(parts(spark, sf_dir), 2048), 4, "dlc").select("sketch_id", "dlc")


@query(HYBRID.format(PARTS, FOUR_PLACES))
def hybrid_estimates(spark, sf_dir):
    return rounded(E.hybrid(parts(spark, sf_dir), 2048), 4, *FIVE)


@query(HYBRID.format(sql.registers("events", "user_id", "event_type"), FOUR_PLACES))
def hybrid_estimates_events(spark, sf_dir):
    return rounded(E.hybrid(S.winners(table(spark, sf_dir, "events"), "user_id", "event_type"), 2048), 4, *FIVE)


@query(f"SELECT e, round({sql.correction('e')}, 9) AS correction FROM (SELECT (100 + 1777.0::DOUBLE * x) AS e FROM (SELECT unnest(range(700)) AS x))")
def cf_interpolate(spark, sf_dir):
    return spark.range(700).select((F.lit(100.0) + F.lit(1777.0) * F.col("id")).alias("e")).select("e", F.round(E.correction(F.col("e")), 9).alias("correction"))


# --- comparison -----------------------------------------------------------------------------------------------------


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.winners(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query(f"WITH {ORDERS}, {sql.counts()} SELECT * FROM v")
def pairwise_counts(spark, sf_dir):
    return C.all_pairs(flags(spark, sf_dir), 2048)


@query(f"WITH {ORDERS}, {sql.counts()}, {sql.sums()} SELECT v.*, round({sql.MLE}, 6) AS cardinality FROM v JOIN z ON z.sketch_id = v.left_id")
def summary_with_cardinality(spark, sf_dir):
    return rounded(C.all_pairs(flags(spark, sf_dir), 2048, include_cardinality=True), 6, "cardinality")


@query(f"WITH {ORDERS}, {sql.counts()} SELECT * FROM v WHERE equal > 0")
def alike_counts(spark, sf_dir):
    return C.alike_pairs(flags(spark, sf_dir), 2048)


METRICS = ("wkid", "ani", "containment", "completeness")


@query(f"WITH {ORDERS}, {sql.counts()} SELECT left_id, right_id, {sql.metrics()} FROM v")
def wkid_ani(spark, sf_dir):
    return rounded(C.with_metrics(C.all_pairs(flags(spark, sf_dir), 2048), 25), 6, *METRICS).select("left_id", "right_id", *METRICS)


@query(f"""WITH v(left_id, right_id, lower, equal, higher, both_empty) AS (VALUES ('a', 'b', 2, 1, 4, 2041), ('c', 'd', 0, 0, 0, 2048), ('e', 'f', 0, 3, 0, 2045), ('g', 'h', 9, 0, 5, 2034), ('i', 'j', 0, 0, 7, 2041))
SELECT left_id, right_id, {sql.metrics()} FROM v""")
def wkid_sparse(spark, sf_dir):
    rows = [("a", "b", 2, 1, 4, 2041), ("c", "d", 0, 0, 0, 2048), ("e", "f", 0, 3, 0, 2045), ("g", "h", 9, 0, 5, 2034), ("i", "j", 0, 0, 7, 2041)]
    counts = spark.createDataFrame(rows, "left_id string, right_id string, lower long, equal long, higher long, both_empty long")
    return rounded(C.with_metrics(counts, 25), 6, *METRICS).select("left_id", "right_id", *METRICS)


@query(f"""WITH {ORDERS}, {sql.counts()} SELECT sum(lower)::BIGINT AS lower, sum(equal)::BIGINT AS equal, sum(higher)::BIGINT AS higher, sum(both_empty)::BIGINT AS both_empty FROM v""")
def pairwise_totals(spark, sf_dir):
    return C.total_counts(C.all_pairs(flags(spark, sf_dir), 2048))


@query(f"WITH {sql.registers('lineitem', 'l_partkey', chr(39) + 'all' + chr(39))} SELECT sketch_id, bucket, winner, n FROM r")
def sketch_merge(spark, sf_dir):
    lines = S.registers(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber")
    return S.merged(lines.withColumn("sketch_id", F.lit("all")))


@query(f"WITH {PARTS} SELECT sketch_id, bucket, winner, n FROM r")
def incremental_add(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    first, rest = rows.filter("l_linenumber <= 2"), rows.filter("l_linenumber > 2")
    return S.Sketch.build(first, "l_partkey", "l_returnflag").add(rest, "l_partkey", "l_returnflag").rows


# --- sequences ------------------------------------------------------------------------------------------------------

FWD, REV = sql.PACK.format(x="translate(s, 'ACTG', '0123')"), sql.PACK.format(x="translate(reverse(s), 'ACTG', '2301')")


@query(f"""WITH d AS (SELECT doc_id, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS whole, unnest([1, 2]) AS place FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, place, substr(whole, place, 31) AS s FROM d)
SELECT doc_id, place, {FWD} AS forward, {REV} AS reverse_complement, {REV} AS by_bits, greatest({FWD}, {REV}) AS canonical FROM b""")
def encode_revcomp(spark, sf_dir):
    """Both windows of the longest k in a sequence of 32 bases, the text's digest."""
    whole = F.translate(F.md5("text"), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", whole.alias("whole"), F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
    rows = rows.select("doc_id", "place", F.substr("whole", F.col("place"), F.lit(31)).alias("s"))
    rows = rows.select("doc_id", "place", Q.forward(F.col("s")).alias("forward"), Q.reverse_complement(F.col("s")).alias("reverse_complement"), Q.canonical(F.col("s")).alias("canonical"))
    return rows.withColumn("by_bits", Q.reverse_complement_packed(F.col("forward"), 31))


@query(f"WITH {sql.windows(3, 'documents', 'doc_id', 'text')} SELECT doc_id, kmer, count(*)::BIGINT AS n FROM w GROUP BY ALL")
def kmer_extract(spark, sf_dir):
    return Q.exploded(table(spark, sf_dir, "documents"), "text", 3, "doc_id").groupBy("doc_id", "kmer").agg(F.count("*").alias("n"))


@query(r"""WITH q AS (SELECT doc_id, string_split_regex(upper(regexp_replace(text, '[ \t\r\n]', '', 'g')), '[^ACGT]') AS runs FROM documents)
SELECT doc_id, coalesce(list_sum(list_transform(runs, lambda r: length(r))), 0)::BIGINT AS bases,
  coalesce(list_sum(list_transform(runs, lambda r: greatest(length(r) - 2, 0))), 0)::BIGINT AS valid_kmers,
  coalesce(list_sum(list_transform(runs[:len(runs) - 1], lambda r: CASE WHEN length(r) BETWEEN 1 AND 2 THEN 1 ELSE 0 END)), 0)::BIGINT AS invalid_windows FROM q""")
def sequence_stats(spark, sf_dir):
    found = Q.statistics(F.col("text"), 3)
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in found.items()])


#: Windows of the digests' 32 bases: 20 of each, among 4^13 / 2 canonical ones.
DIGEST_K = 13


def dna_kmers(spark: SparkSession, sf_dir: str, by: str, k: int) -> DataFrame:
    """k-mers of each group's documents, each a record of its own: no window crosses two, so no order is needed."""
    own = F.translate(F.md5("text"), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.coalesce(F.col(by), F.lit("")).alias("sketch_id"), own.alias("s"))
    return Q.exploded(rows, "s", k, "sketch_id")


def _dna(by: str, k: int) -> str:
    return f"{sql.dna('documents', f'coalesce({by}, {chr(39) * 2})')}, {sql.windows(k, 'dna', 'sketch_id', 'sequence')}, {sql.registers('w', 'kmer', 'sketch_id')}"


@query(f"WITH {_dna('source', DIGEST_K)}, {sql.sums()} SELECT sketch_id, (2048 - filled)::BIGINT AS empty, round({sql.MLE}, 6) AS cardinality FROM z")
def dna_cardinality(spark, sf_dir):
    rows = S.winners(dna_kmers(spark, sf_dir, "source", DIGEST_K), "kmer", "sketch_id")
    return rounded(E.cardinality(rows, 2048), 6, "cardinality").select("sketch_id", "empty", "cardinality")


@query(f"WITH {_dna('lang', DIGEST_K)}, {sql.counts()} SELECT v.*, {sql.metrics(DIGEST_K)} FROM v")
def dna_similarity(spark, sf_dir):
    rows = S.winners(dna_kmers(spark, sf_dir, "lang", DIGEST_K), "kmer", "sketch_id")
    return rounded(C.with_metrics(C.all_pairs(rows, 2048), DIGEST_K), 6, *METRICS)


@query()
def genome_identity(spark, sf_dir):
    """Whole genomes at k = 25, with the replicates and bases of the synthetic job; the numbers of a genome are a chain, so there is no SQL."""
    from rarebucket.plans.jobs import synthetic_errors

    return synthetic_errors(spark, 5, 1 << 20)


# --- synthetic keys, experiments ------------------------------------------------------------------------------------

MASK = f"{synthetic.MASK}::UBIGINT"
RANGE = "(SELECT unnest(range({})) AS i)"


def _counter(n: int, seed: int) -> str:
    return f"WITH {sql.mixed(RANGE.format(n), f'((i::UHUGEINT + {seed % (1 << 64)}::UHUGEINT) % {sql.WRAP})::UBIGINT', 'i')} SELECT i, (h & {MASK})::BIGINT AS key FROM m"


@query(_counter(5000, 0x123456789ABCDEF0))
def synthetic_keys_a(spark, sf_dir):
    return synthetic.keys(spark, 5000, 0x123456789ABCDEF0)


@query(_counter(5000, 42 + 3 * 0x9E3779B97F4A7C15))
def synthetic_keys_b(spark, sf_dir):
    return synthetic.trial_keys(spark, 5000, 3)


@query(f"""WITH {sql.mixed("(SELECT 1)", "77", "")}, f AS (SELECT h | 1::UBIGINT AS f FROM m)
SELECT i, (((i::UHUGEINT * f::UHUGEINT + 77::UHUGEINT) % {sql.WRAP})::UBIGINT & {MASK})::BIGINT AS key FROM {RANGE.format(5000)}, f""")
def synthetic_keys_c(spark, sf_dir):
    return synthetic.distinct_keys(spark, 5000, 77)


@query(f"""WITH p AS (SELECT power, trial FROM (SELECT unnest(range(8, 25)) AS power), (SELECT unnest(range(4)) AS trial)), {sql.mixed("p", "xor(42::UBIGINT, xor(power::UBIGINT << 32, trial::UBIGINT))", "power, trial")}
SELECT power, trial, {sql.SIGNED} AS seed FROM m""")
def seed_derive(spark, sf_dir):
    from rarebucket.functions.hashing import splitmix64

    rows = spark.range(8, 25).select(F.col("id").alias("power")).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("trial", F.col("trial").cast("long"))
    return splitmix64(rows.withColumn("seed", F.shiftleft("power", 32).bitwiseXOR(F.col("trial")).bitwiseXOR(F.lit(42).cast("long"))), "seed")


POWERS = (8, 10, 12, 14, 16)
TRIALS = [(p, t) for p in POWERS for t in range(3)]


def _trial_rows() -> str:
    from rarebucket.functions.hashing import mix

    points = ", ".join(f"({p}, {t}, {synthetic.trial_seed(42, p, t)}::UBIGINT, {mix(synthetic.trial_seed(42, p, t)) | 1}::UBIGINT)" for p, t in TRIALS)
    keyed = f"a AS (SELECT power || '-' || trial AS id, ((((i::UHUGEINT * f::UHUGEINT) % {sql.WRAP}) + seed::UHUGEINT) % {sql.WRAP})::UBIGINT & {MASK} AS key FROM (VALUES {points}) p(power, trial, seed, f), LATERAL (SELECT unnest(range(1 << power)) AS i))"
    return f"""{keyed}, {sql.registers("a", "key", "id")}, {sql.sums()},
o AS (SELECT split_part(sketch_id, '-', 1)::INT AS power, split_part(sketch_id, '-', 2)::INT AS trial, {sql.MLE} AS estimate FROM z)"""


@query(f"WITH {_trial_rows()} SELECT power, trial, round(estimate, 6) AS estimate, (1 << power)::BIGINT AS exact, round((estimate - (1 << power)) / (1 << power), 9) AS signed_error, round(abs((estimate - (1 << power)) / (1 << power)), 9) AS absolute_error FROM o")
def accuracy_trials(spark, sf_dir):
    return rounded(_trials(spark), 9, "signed_error", "absolute_error").withColumn("estimate", F.round("estimate", 6))


def _trials(spark: SparkSession) -> DataFrame:
    from rarebucket.plans.jobs import trial_rows

    rows = trial_rows(spark, POWERS, 3, 42)
    found = E.cardinality(S.winners(rows, "key", "id"), 2048)
    part = F.split("sketch_id", "-")
    found = found.select(part[0].cast("int").alias("power"), part[1].cast("int").alias("trial"), F.col("cardinality").alias("estimate"))
    return reports.with_errors(found.withColumn("exact", F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), "power").cast("long")))


@query(f"""WITH {_trial_rows()} SELECT power, round(avg(abs((estimate - (1 << power)) / (1 << power))) * 100, 6) AS mean_absolute_percent, round(avg(estimate), 6) AS mean_estimate, (1 << power)::BIGINT AS exact FROM o GROUP BY power""")
def accuracy_summary(spark, sf_dir):
    return rounded(reports.accuracy_summary(_trials(spark), "power"), 6, "mean_absolute_percent", "mean_estimate")


#: A table of runs that follows from the line items, so that it is the same everywhere.
RUNS = "SELECT CASE l_linenumber % 2 WHEN 0 THEN 'own' ELSE 'baseline' END AS implementation, (1 << (8 + l_suppkey % 5))::BIGINT AS count, l_extendedprice * (1 + l_linenumber) AS adds_per_second FROM lineitem"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_linenumber") % 2 == 0, "own").otherwise("baseline")
    return rows.select(name.alias("implementation"), F.pow(F.lit(2.0), 8 + F.col("l_suppkey") % 5).cast("long").alias("count"), (F.col("l_extendedprice") * (1 + F.col("l_linenumber"))).alias("adds_per_second"))


@query(f"SELECT implementation, count, round(median(adds_per_second), 6) AS median_adds FROM ({RUNS}) GROUP BY ALL")
def throughput_medians(spark, sf_dir):
    return rounded(reports.median_throughput(_runs(spark, sf_dir)), 6, "median_adds")


@query(f"WITH m AS (SELECT implementation, count, median(adds_per_second) AS m FROM ({RUNS}) GROUP BY ALL) SELECT a.count, round(a.m / b.m, 9) AS speedup FROM m a JOIN m b ON a.count = b.count AND a.implementation = 'own' AND b.implementation = 'baseline'")
def throughput_speedup(spark, sf_dir):
    return rounded(reports.speedup(reports.median_throughput(_runs(spark, sf_dir)), "own", "baseline"), 9, "speedup")


GATE_ROWS = "SELECT 85 + 5 * (l_suppkey % 4)::DOUBLE AS identity, CASE l_linenumber % 2 WHEN 0 THEN 'own' ELSE 'baseline' END AS system, CASE WHEN l_orderkey % 97 <> 5 THEN (85 + 5 * (l_suppkey % 4) + (l_quantity - 25) / 100) / 100 END AS ani, CASE WHEN l_orderkey % 89 <> 5 THEN 0.5 + l_discount END AS wkid FROM lineitem"


@query(f"""WITH g AS ({GATE_ROWS}), e AS (SELECT identity, system, ani IS NULL OR wkid IS NULL AS bad, (ani - identity / 100) * 100 AS e, (wkid - pow(identity / 100, 25)) * 100 AS w FROM g),
a AS (SELECT identity, system, avg(abs(e)) FILTER (NOT bad) AS mae, avg(abs(w)) FILTER (NOT bad) AS wmae, coalesce(stddev_samp(e) FILTER (NOT bad), 0) AS sd, coalesce(stddev_samp(w) FILTER (NOT bad), 0) AS wsd, avg(bad::INT) AS inv FROM e GROUP BY ALL)
SELECT o.identity, round(o.mae, 6) AS own_mae, round(b.mae, 6) AS baseline_mae, o.mae - b.mae <= 0.1 AS mae_ok,
  o.wmae - b.wmae <= 100 * (pow(o.identity / 100, 25) - pow(greatest(0, o.identity / 100 - 0.001), 25)) AS wkid_ok, o.sd <= 1.2 * b.sd + 0.05 AS sd_ok, o.wsd <= 1.2 * b.wsd + 0.05 AS wkid_sd_ok, o.inv - b.inv <= 0.02 AS invalid_ok
FROM a o JOIN a b ON o.identity = b.identity AND o.system = 'own' AND b.system = 'baseline'""")
def gate_statistics(spark, sf_dir):
    q = F.col("l_suppkey") % 4
    name = F.when(F.col("l_linenumber") % 2 == 0, "own").otherwise("baseline")
    rows = table(spark, sf_dir, "lineitem").select(
        (85 + 5 * q).cast("double").alias("identity"), name.alias("system"), F.when(F.col("l_orderkey") % 97 != 5, (85 + 5 * q + (F.col("l_quantity") - 25) / 100) / 100).alias("ani"), F.when(F.col("l_orderkey") % 89 != 5, 0.5 + F.col("l_discount")).alias("wkid"))
    return rounded(reports.acceptance(rows), 6, "own_mae", "baseline_mae").select("identity", "own_mae", "baseline_mae", "mae_ok", "wkid_ok", "sd_ok", "wkid_sd_ok", "invalid_ok")


@query("""WITH t AS (SELECT l_linenumber % 2 AS p, l_extendedprice AS total, l_quantity AS con FROM lineitem WHERE l_linenumber > 1)
SELECT round(median(total) FILTER (p = 0), 6) AS fast_total, round(median(total) FILTER (p = 1), 6) AS slow_total, round(median(con) FILTER (p = 0), 6) AS fast_construction, round(median(con) FILTER (p = 1), 6) AS slow_construction, true AS all_ok,
  (median(total) FILTER (p = 0) < median(total) FILTER (p = 1)) AND (median(con) FILTER (p = 0) < median(con) FILTER (p = 1)) AS go FROM t""")
def go_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") > 1, "measured").otherwise("warmup").alias("phase"), F.when(F.col("l_linenumber") % 2 == 0, "fast").otherwise("slow").alias("backend"),
        F.col("l_extendedprice").alias("total_ms"), F.col("l_quantity").alias("construction_ms"), F.lit("ok").alias("status"))
    return rounded(reports.go_gate(rows, "fast", "slow"), 6, "fast_total", "slow_total", "fast_construction", "slow_construction").drop("speedup")


@query("SELECT unnest(['CardinalityFixture12', 'add', 'XFixture', 'Fixture9']) AS name, unnest(['Cardinality', 'add', 'X', 'Fixture9']) AS base")
def benchmark_names(spark, sf_dir):
    rows = spark.createDataFrame([("CardinalityFixture12",), ("add",), ("XFixture",), ("Fixture9",)], "name string")
    return rows.select("name", reports.benchmark_base(F.col("name")).alias("base"))


@query()
def hll_count(spark, sf_dir):
    return hll.estimates(hll.sketches(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag"))


@query()
def hll_union_similarity(spark, sf_dir):
    found = hll.sketches(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")
    pairs = spark.createDataFrame([("A", "N"), ("A", "R"), ("N", "R")], "left_id string, right_id string")
    return hll.similarity(found, pairs)


@query("""SELECT DISTINCT l_returnflag AS sketch_id, count(DISTINCT l_partkey)::BIGINT AS exact, true AS within FROM lineitem GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT l_partkey)::BIGINT, true FROM lineitem""")
def hll_bounds(spark, sf_dir):
    """Estimates of the flags and of their merged sketches lie within four standard errors of exact counts."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("sketch_id"))
    found = hll.sketches(rows, "l_partkey", "sketch_id")
    guess = hll.estimates(found).union(hll.estimates(hll.merged(found).select(F.lit("all").alias("sketch_id"), "hll")))
    exact = rows.groupBy("sketch_id").agg(F.countDistinct("l_partkey").alias("exact")).union(rows.select(F.lit("all").alias("sketch_id"), F.countDistinct("l_partkey").alias("exact")))
    error = F.abs(F.col("estimate") / F.col("exact") - 1)
    return exact.join(guess, "sketch_id").select("sketch_id", "exact", (error <= 4 * 1.04 / 2 ** (hll.PRECISION / 2)).alias("within"))


@query(f"""WITH {PARTS}, i AS (SELECT DISTINCT sketch_id FROM r), q AS (SELECT sketch_id, unnest(range(2048))::INT AS bucket FROM i)
SELECT q.sketch_id, q.bucket, coalesce(winner::BIGINT * 65536 + least(n, 65535), 0)::BIGINT AS register FROM q LEFT JOIN r USING (sketch_id, bucket)""")
def dense_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    first, rest = (S.Sketch.build(rows.filter(f"l_linenumber {c} 2"), "l_partkey", "l_returnflag").dense() for c in ("<=", ">"))
    return S.merge_dense(first, rest)


#: A table of benchmarks that follows from the line items.
BENCHMARKS = "SELECT CASE l_linenumber % 4 WHEN 0 THEN 'own_construction' WHEN 1 THEN 'hll_construction' WHEN 2 THEN 'own_cardinality' ELSE 'hll_cardinality' END AS Estimator, l_orderkey AS Items, l_extendedprice * 1e6 AS throughput, l_discount / 1e4 AS seconds FROM lineitem"


def _benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("own_construction", "hll_construction", "own_cardinality", "hll_cardinality")])
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("Estimator"), F.col("l_orderkey").alias("Items"), (F.col("l_extendedprice") * 1e6).alias("throughput"), (F.col("l_discount") / 1e4).alias("seconds"))


@query(f"SELECT 'construction' AS kind, replace(Estimator, '_construction', '') AS series, count(*)::BIGINT AS n, round(max(throughput / 1e9), 6) AS most FROM ({BENCHMARKS}) WHERE Estimator LIKE '%_construction' GROUP BY ALL UNION ALL SELECT 'cardinality', 'own', count(*)::BIGINT, round(max(seconds * 1e6), 6) FROM ({BENCHMARKS}) WHERE Estimator = 'own_cardinality'")
def benchmark_series(spark, sf_dir):
    rows = _benchmarks(spark, sf_dir)
    giga = reports.construction_series(rows).groupBy("series").agg(F.count("*").alias("n"), F.max("giga").alias("most")).withColumn("kind", F.lit("construction"))
    micros = reports.latency_series(rows, ["own", "absent"]).groupBy("series").agg(F.count("*").alias("n"), F.max("micros").alias("most")).withColumn("kind", F.lit("cardinality"))
    return rounded(giga.unionByName(micros), 6, "most").select("kind", "series", "n", "most")


@query(r"""WITH n AS (SELECT DISTINCT CASE l_linenumber % 5 WHEN 0 THEN 'BloomFixture' || l_suppkey || '/Insert/' || l_quantity::INT || '/x' WHEN 1 THEN '"SetFixture/Query/iterations:10"' WHEN 2 THEN 'Own_' || l_suppkey || '/Insert/64' WHEN 3 THEN 'Fixture3/Insert' ELSE 'plain' END AS name FROM lineitem),
p AS (SELECT name, string_split(name, '/') AS parts, regexp_extract(trim(split_part(name, '/', 1), '"'), '^(.+?)Fixture\d*$', 1) AS base FROM n)
SELECT name, regexp_replace(lower(split_part(split_part(name, '/', 1), '_', 1)), 'fixture$', '') AS subject, CASE WHEN len(parts) > 1 AND base <> '' THEN lower(base) END AS base, CASE WHEN len(parts) > 1 AND base <> '' THEN parts[2] END AS operation,
  CASE WHEN len(parts) > 1 AND base <> '' THEN CASE WHEN regexp_full_match(coalesce(parts[3], ''), '[0-9]+') THEN parts[3]::BIGINT ELSE 0 END ELSE -1 END AS size FROM p""")
def benchmark_parts(spark, sf_dir):
    kind, supplier = F.col("l_linenumber") % 5, F.col("l_suppkey").cast("string")
    name = F.when(kind == 0, F.concat(F.lit("BloomFixture"), supplier, F.lit("/Insert/"), F.col("l_quantity").cast("int").cast("string"), F.lit("/x"))).when(kind == 1, F.lit('"SetFixture/Query/iterations:10"'))
    name = name.when(kind == 2, F.concat(F.lit("Own_"), supplier, F.lit("/Insert/64"))).when(kind == 3, F.lit("Fixture3/Insert")).otherwise(F.lit("plain"))
    rows = table(spark, sf_dir, "lineitem").select(name.alias("name")).distinct().withColumn("parts", reports.fixture_parts(F.col("name")))
    return rows.select("name", reports.subject(F.col("name")).alias("subject"), "parts.base", "parts.operation", F.coalesce("parts.size", F.lit(-1).cast("long")).alias("size"))


@query("""SELECT i, ani, wkid FROM (VALUES (1, '99.5', '0.88'), (2, NULL, NULL), (3, '90', '0.1'), (4, NULL, NULL)) t(i, ani, wkid)""")
def json_ref_extract(spark, sf_dir):
    texts = [(1, 'log line {"query":"q","ref_1":{"ANI":99.5,"WKID":0.88}} tail'), (2, "nothing here"), (3, '{"ref_a":5,"ref_b":{"ANI":90,"WKID":0.1},"ref_c":{"ANI":1,"WKID":2}}'), (4, '{"other":{"ANI":1}}')]
    rows = spark.createDataFrame(texts, "i int, text string")
    value = sinks.first_reference(F.col("text"))
    return rows.select("i", F.get_json_object(value, "$.ANI").alias("ani"), F.get_json_object(value, "$.WKID").alias("wkid"))


@query("SELECT r_name, sha256(r_name) AS sha256 FROM region")
def checksum_names(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_name", F.sha2("r_name", 256).alias("sha256"))


HOURS = "(SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS sketch_id, user_id FROM events)"


@query(f"""WITH {sql.hashed(HOURS, "user_id", "window_start, sketch_id")},
s AS (SELECT window_start, sketch_id, (h & 2047::UBIGINT)::INT AS bucket, {sql.SCORE} AS score FROM m)
SELECT window_start, sketch_id, bucket, max(score) AS winner FROM s GROUP BY ALL""")
def windowed_sketch(spark, sf_dir):
    rows = windowed_winners(table(spark, sf_dir, "events"), "user_id", "event_type")
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct parts by return flag."""
    return E.cardinality(parts(spark, sf_dir), 2048)


__all__ = ["QUERIES", "SQL", "Column", "flagship"]

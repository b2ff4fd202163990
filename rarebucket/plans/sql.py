"""SQL for the registered queries, independent of the DataFrame code, in DuckDB's dialect."""

from __future__ import annotations

WRAP = "18446744073709551616::UHUGEINT"


def mixed(source: str, value: str, keep: str, name: str = "m") -> str:
    """CTEs that end in ``{name}``: the kept columns and ``h``, the mixed 64-bit value."""
    times = lambda factor: f"((h::UHUGEINT * {factor}::UHUGEINT) % {WRAP})::UBIGINT"
    steps = ["xor(h, h >> 30)", times(0xBF58476D1CE4E5B9), "xor(h, h >> 27)", times(0x94D049BB133111EB), "xor(h, h >> 31)"]
    comma = f"{keep}, " if keep else ""
    out = [f"{name}0 AS (SELECT {comma}({value})::UBIGINT AS h FROM {source})"]
    out += [f"{name}{i + 1 if i < len(steps) - 1 else ''} AS (SELECT {comma}{step} AS h FROM {name}{i})" for i, step in enumerate(steps)]
    return ",\n".join(out)


def hashed(source: str, key: str, keep: str, name: str = "m") -> str:
    return mixed(source, f"xor(({key})::UBIGINT, 42::UBIGINT)", keep, name)


SCORE = "greatest(1, least(64 - length(bin(h | 1::UBIGINT)), 53) * 1024 + 1023 - ((h >> (53 - least(64 - length(bin(h | 1::UBIGINT)), 53))::UBIGINT) & 1023::UBIGINT)::BIGINT)::INT"
RESTORED = "((2047 - (winner & 1023))::HUGEINT * pow(2, 53 - (winner >> 10))::HUGEINT)"
SIGNED = "(CASE WHEN h >= 9223372036854775808::UBIGINT THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END)"


def registers(source: str, key: str, ident: str, buckets: int = 2048) -> str:
    """CTEs that end in ``r``: (sketch_id, bucket, winner, n)."""
    return f"""k AS (SELECT {ident} AS sketch_id, ({key}) AS key FROM {source} WHERE ({key}) IS NOT NULL),
{hashed("k", "key", "sketch_id")},
s AS (SELECT sketch_id, (h & {buckets - 1}::UBIGINT)::INT AS bucket, {SCORE} AS score FROM m),
c AS (SELECT sketch_id, bucket, score, count(*)::BIGINT AS n FROM s GROUP BY ALL),
r AS (SELECT sketch_id, bucket, max(score) AS winner, arg_max(n, score) AS n FROM c GROUP BY ALL)"""


def sums(buckets: int = 2048) -> str:
    """CTE ``z``: (sketch_id, filled, restored), after registers."""
    return f"z AS (SELECT sketch_id, count(*)::BIGINT AS filled, sum({RESTORED})::DOUBLE AS restored, {buckets}::DOUBLE AS b FROM r GROUP BY sketch_id)"


MLE = "CASE WHEN filled > 0 THEN b * filled / (b - filled + restored / 18446744073709551616.0::DOUBLE) ELSE 0.0 END"

KNOTS = (0.92533006, 0.887325502, 0.833883596, 0.810002197, 0.850952315, 0.948926187, 0.998481533, 0.999045759, 0.996665452, 1.00076597, 0.999102624, 0.99457023, 1.00041684)


def correction(x: str) -> str:
    single = lambda v: f"{v}::FLOAT::DOUBLE"
    cases = [f"WHEN {x} <= 256 THEN {single(KNOTS[0])}"]
    for k, (v, w) in enumerate(zip(KNOTS, KNOTS[1:], strict=False)):
        a, b = 1 << 8 + k, 1 << 9 + k
        cases.append(f"WHEN {x} < {b} THEN {single(v)} + ({x} - {a}) / ({b} - {a})::DOUBLE * ({w}::FLOAT - {v}::FLOAT)::FLOAT::DOUBLE")
    return "CASE " + " ".join(cases) + f" ELSE {single(KNOTS[-1])} END"


def hybrid(buckets: int = 2048) -> str:
    """CTEs that end in ``y``: (sketch_id, lc_hybrid, dlc_hybrid, lc, dlc, mean_m_raw), after ``z``."""
    b = float(buckets)
    least = max(1.0, b * 0.002)
    blend = lambda zone: f"CASE WHEN {zone} <= {0.2 * b} THEN lc WHEN {zone} >= {5 * b} THEN cm ELSE (1 - ln({zone} / {0.2 * b}::DOUBLE) / ln(25::DOUBLE)) * lc + ln({zone} / {0.2 * b}::DOUBLE) / ln(25::DOUBLE) * cm END"
    return f"""n AS (SELECT sketch_id, winner >> 10 AS tier, count(*)::BIGINT AS n FROM r GROUP BY ALL),
t AS (SELECT z.sketch_id, q.tier, {buckets} - filled AS empty, {buckets} - filled + coalesce(sum(coalesce(n.n, 0)) OVER (PARTITION BY z.sketch_id ORDER BY q.tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
      FROM z CROSS JOIN (SELECT unnest(range(65)) AS tier) q LEFT JOIN n ON n.sketch_id = z.sketch_id AND n.tier = q.tier),
g AS (SELECT *, CASE WHEN free > 0 THEN pow(2::DOUBLE, tier) * {b} * ln({b}::DOUBLE / free) END AS guess,
             CASE WHEN free BETWEEN {least} AND {b - least} THEN pow(1 / (sqrt(2 / pi()) * sqrt(({b} - free) / ({b} * free)) / ln({b}::DOUBLE / free)), 4.5) END AS w FROM t),
p AS (SELECT sketch_id, max(empty)::DOUBLE AS empty, coalesce(arg_min(guess, tier) FILTER (free > 0), 0) AS lc, sum(w) AS w, sum(CASE WHEN w IS NOT NULL THEN w * ln(guess) END) AS wl FROM g GROUP BY sketch_id),
d AS (SELECT *, CASE WHEN w IS NULL OR w = 0 OR empty >= {0.952 * b} THEN lc
                     WHEN empty > {0.088 * b} THEN (empty - {0.088 * b}) / {(0.952 - 0.088) * b}::DOUBLE * lc + (1 - (empty - {0.088 * b}) / {(0.952 - 0.088) * b}::DOUBLE) * exp(wl / w)
                     ELSE exp(wl / w) END AS dlc FROM p),
e AS (SELECT d.*, 18446744073709551616.0::DOUBLE / (restored / filled) * filled * ((filled + {b}) / {2 * b}::DOUBLE) AS mean_m_raw FROM d JOIN z USING (sketch_id)),
x AS (SELECT *, mean_m_raw * ({correction("dlc")}) AS cm FROM e),
y AS (SELECT sketch_id, {blend("lc")} AS lc_hybrid, {blend("dlc")} AS dlc_hybrid, lc, dlc, mean_m_raw FROM x)"""


def counts(buckets: int = 2048) -> str:
    """CTE ``v``: dense pairwise counts of all pairs of ids, after registers."""
    return f"""i AS (SELECT DISTINCT sketch_id FROM r),
u AS (SELECT i.sketch_id AS left_id, j.sketch_id AS right_id, q.bucket FROM i JOIN i j ON i.sketch_id < j.sketch_id CROSS JOIN (SELECT unnest(range({buckets})) AS bucket) q),
v AS (SELECT u.left_id, u.right_id,
        count(*) FILTER (coalesce(a.winner, 0) < coalesce(b.winner, 0))::BIGINT AS lower,
        count(*) FILTER (coalesce(a.winner, 0) = coalesce(b.winner, 0) AND a.winner IS NOT NULL)::BIGINT AS equal,
        count(*) FILTER (coalesce(a.winner, 0) > coalesce(b.winner, 0))::BIGINT AS higher,
        count(*) FILTER (a.winner IS NULL AND b.winner IS NULL)::BIGINT AS both_empty
      FROM u LEFT JOIN r a ON a.sketch_id = u.left_id AND a.bucket = u.bucket LEFT JOIN r b ON b.sketch_id = u.right_id AND b.bucket = u.bucket GROUP BY ALL)"""


def metrics(k: int = 25) -> str:
    return f"""CASE WHEN equal + least(lower, higher) > 0 THEN round(equal / greatest(equal + least(lower, higher), 6), 6) END AS wkid,
CASE WHEN equal + least(lower, higher) > 0 THEN round(pow(equal / greatest(equal + least(lower, higher), 6), {1 / k!r}), 6) END AS ani,
CASE WHEN equal + higher > 0 THEN round(equal / (equal + higher), 6) END AS containment,
CASE WHEN equal + lower > 0 THEN round(least(1.0, greatest(0.0, (equal + higher) / (equal + lower))), 6) END AS completeness"""


def dna(source: str, ident: str) -> str:
    """CTE ``dna``: (sketch_id, sequence) of a table with text, a row per text."""
    return f"dna AS (SELECT {ident} AS sketch_id, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM {source} WHERE text IS NOT NULL)"


PACK = "list_reduce(list_transform(string_split({x}, ''), lambda z: z::BIGINT), lambda p, q: p * 4 + q)"


def windows(k: int, source: str, keep: str, text: str) -> str:
    """CTE ``w``: the kept columns and canonical k-mers of ``text``."""
    fwd = PACK.format(x="translate(s, 'ACTG', '0123')")
    rev = PACK.format(x="translate(reverse(s), 'ACTG', '2301')")
    return f"""q0 AS (SELECT {keep}, unnest(string_split_regex(upper(regexp_replace({text}, '[ \\t\\r\\n]', '', 'g')), '[^ACGT]')) AS run FROM {source}),
q1 AS (SELECT {keep}, unnest(list_transform(range(1, length(run) - {k} + 2), lambda i: substr(run, i, {k}))) AS s FROM q0 WHERE length(run) >= {k}),
w AS (SELECT {keep}, greatest({fwd}, {rev}) AS kmer FROM q1)"""

"""Connected components of a table of links, by alternating star operations.

Partitions first shrink their links to a spanning forest each. Then, until nothing changes,
large stars (each node hands its larger neighbours to its smallest) and small stars (each node hands its smaller
neighbours to its smallest) shorten all paths; a logarithmic number of rounds suffices in practice. Minima are
aggregated before the shuffle, and with ``salts`` a hub's links meet its smallest neighbour in so many tasks, dealt by their other end;
without, adaptive execution splits a long list of links.
Links of a node to itself and repeated links change nothing; no links give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebucket.llm.common import forget, reliable


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up] if up in root else up
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 1_000_000:  # bounded memory: what is known so far goes out as links
            yield out()
            root.clear()
    yield out()


def _with_least(links: DataFrame, salts: int) -> DataFrame:
    """(u, v, m) per (u, v): m is the smallest v of u."""
    low = links.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    if salts < 2:
        return links.join(low, F.col("u") == F.col("w")).select("u", "v", "m")
    low = low.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    return salted.join(low.hint("merge"), (F.col("u") == F.col("w")) & (F.col("salt") == F.col("of"))).select("u", "v", "m")


def components(links: DataFrame, salts: int = 1) -> DataFrame:
    """(u, v) rows to (node, component): the smallest node reachable, for each node that has a link to another."""
    links = links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    links = start = reliable(links.mapInArrow(_forest, "u long, v long"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = None
    while True:
        both = _with_least(links.union(links.select("v", "u")), salts)
        links = both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        down = _with_least(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), salts)
        ends = F.array(*[F.struct(F.col(end).alias("u"), F.col("m").alias("v")) for end in ("v", "u")])
        links = reliable(down.select(F.explode(ends).alias("x")).select("x.u", "x.v").filter("u <> v").distinct())
        forget(start)
        start = links
        now = state(links)
        if now == was:
            break
        was = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

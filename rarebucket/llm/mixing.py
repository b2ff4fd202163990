"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the mix (its target, in words) and a curve of weight over training time
0..1. The integral of the curve, scaled to the target, is the cumulative demand D(t) of the source.
Its documents, in a fixed shuffled order and as often as the target asks, offer cumulative
supply; a copy that starts after u words gets the position D^-1(u). The mix is the table
range-sorted by position.

A running sum over a source would put a hot source into one task, so sums run over
(source, bucket), with buckets cut from the shuffled order, and a second sum runs over the totals of
the buckets. Both bucket number and bucket size grow with the square root of the rows. The shuffled order is that of a
digest of id and text, so rows without an id and rows of one id spread too; rows that are equal throughout are
counted, take one place in the sums and are told apart again after them. The table of sources alone is summed in one
task, a row per source.

Null texts have size 0, a null source is a source of its own (ordered last), a null id shuffles as empty
text. Rows of equal id and text are interchangeable, and each has its own words. Sources of size 0 get target 0 and
their documents take 0 words. An empty table gives an empty result. Other columns are left alone, whatever their names;
texts of any length are only counted, digested and, at the end of a source, cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarebucket.llm.common import WORD, numbered, reliable

#: Tasks that the lines of one set of equal rows are dealt to, at most.
SALTS = 32
#: Weight curves as (time, weight) knots, dealt to the sources in turn: early, late, then flat with a late rise.
CURVES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.7, 1.0), (1.0, 2.0)))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the piecewise linear curve reaches ``share`` (0..1) of its total."""
    areas = [0.0]
    for (a, v), (b, w) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (b - a) * (v + w) / 2)
    area = share * F.lit(areas[-1])
    out = F.lit(float(knots[-1][0]))
    for k in range(len(knots) - 2, -1, -1):
        (a, v), (b, w) = knots[k], knots[k + 1]
        rest, slope = area - F.lit(areas[k]), (w - v) / (b - a)
        # a + 2r / (v + sqrt(v^2 + 2 slope r)) solves v x + slope x^2 / 2 = r and holds for slope 0 too
        step = F.lit(2.0) * rest / (F.lit(v) + F.sqrt(F.lit(v * v) + F.lit(2 * slope) * rest))
        out = F.when(area < F.lit(areas[k + 1]), F.lit(a) + F.when(rest <= 0, F.lit(0.0)).otherwise(step)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, target), a row per source.

    Sharing by weight with excess dealt anew until none is over its cap is the same as min(cap, level * weight)
    for the one level that uses up the total: sources sorted by cap / weight fill up in this order. One row per
    source reaches the windows here, never one per document.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumns({
        "all": F.sum("source_size").over(everything),
        "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    over = F.lit(cap) * F.col("source_size") * F.col("left") <= F.col("weight") * (F.lit(total) * F.col("all") - F.lit(cap) * F.col("full"))
    ranked = ranked.withColumn("over", over)
    # the sources that fill up come first; the others share what those leave
    first = F.min(F.when(~F.col("over"), F.struct(F.col("source_size") / F.col("weight"), "rank", "full", "left"))).over(everything)
    ranked = ranked.withColumn("first", first)
    level = (F.lit(total) * F.col("all") - F.lit(cap) * F.col("first.full")) * F.col("weight") / F.col("first.left")
    target = F.when(F.col("over"), F.lit(cap) * F.col("source_size")).otherwise(level)
    return ranked.select("source", "source_size", "rank", target.cast("double").alias("target"))


def mixed_words(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, curves: Sequence = CURVES, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """A row per document: size, its source's size and target, ``offset`` (the words before it in its source), ``taken``, ``position``.

    ``taken`` counts words of both copies; the position is the first copy's. ``keep`` names further columns to carry.
    """
    ident = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), ident.alias("deal"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    base = reliable(base.groupBy(*base.columns).agg(F.count("*").alias("equal")))  # narrow rows; the texts are read once
    buckets = 4 * math.isqrt(base.count()) + 1
    base = base.withColumn("all_size", F.col("size") * F.col("equal"))
    bucket = F.floor(F.conv(F.substring("deal", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(float(1 << 32))).cast("int")
    base = base.withColumn("bucket", bucket)
    sums = base.groupBy("source", "bucket").agg(F.sum("all_size").alias("bucket_size"))
    prior = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(prior), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, total, cap)
    sums = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "bucket", "before", "source_size", "rank", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("deal", "doc_id", "size", *[f"kept_{c}" for c in keep]).rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("inside", F.coalesce(F.sum("all_size").over(inside), F.lit(0)))
    placed = placed.alias("d").join(sums.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")))
    placed = numbered(placed, "equal", "nth")
    offset = (F.col("before") + F.col("inside") + F.col("nth") * F.col("size")).alias("offset")
    placed = placed.select("doc_id", "size", "d.source", "source_size", "rank", "target", offset, "deal", "equal", "nth", *[f"kept_{c}" for c in keep])
    words = F.floor("target")
    taken = F.lit(0).cast("long")
    for copy in range(math.ceil(cap)):
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), words - copy * F.col("source_size") - F.col("offset")))
    placed = placed.withColumn("taken", taken.cast("long"))
    position = start_position(F.col("offset"), F.col("target"), F.col("rank"), curves)
    return placed.withColumn("position", F.when(F.col("taken") > 0, position))


def start_position(offset: Column, target: Column, rank: Column, curves: Sequence = CURVES) -> Column:
    share = offset / target
    out = inverse_demand(share, curves[-1])
    for k in range(len(curves) - 1):
        out = F.when(rank % len(curves) == k, inverse_demand(share, curves[k])).otherwise(out)
    return out


def by_position(mix: DataFrame, *ties: str) -> DataFrame:
    """Range-sorted by position. The ties are part of the range key, so equal (or null) positions don't meet in one task."""
    return mix.repartitionByRange(F.col("position").asc_nulls_last(), *ties).sortWithinPartitions(F.col("position").asc_nulls_last(), *ties)


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word and the white space after it."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.array_join(F.slice(parts, F.lit(1), (n + lead).cast("int")), "")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, curves: Sequence = CURVES) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per copy, in order of position.

    The copy at which a source reaches its target is cut after the words still wanted. ``n_chars``, if there is
    such a column, follows the cut. Documents without words take no part. Rows that are equal in all columns (none may be a map) are
    told apart by number, so each has its own copies.
    """
    columns = docs.columns
    mark = F.xxhash64(*[F.col(c) for c in columns])
    plan = mixed_words(docs.withColumn("own_mark", mark), weights, total, cap, curves, keep=("own_mark",))
    words = F.floor("target")
    copies = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1)))
    plan = plan.filter("taken > 0").withColumn("copy", copies).withColumn("offset", F.col("offset") + F.col("copy") * F.col("source_size"))
    plan = plan.withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("offset")))).filter("words > 0")
    plan = plan.withColumn("position", start_position(F.col("offset"), F.col("target"), F.col("rank"), curves))
    plan = reliable(plan.select(F.col("doc_id").alias("plan_id"), F.col("kept_own_mark").alias("plan_mark"), "copy", "position", "words", "size", "deal", "equal", F.pmod(F.xxhash64("nth", "copy"), F.least("equal", F.lit(SALTS))).cast("int").alias("salt")))
    rows = docs.select(*[F.col(c).alias(f"own_{c}") for c in columns], mark.alias("mark"))
    on = F.col("own_doc_id").eqNullSafe(F.col("plan_id")) & (F.col("mark") == F.col("plan_mark"))
    out = rows.join(plan.filter("equal = 1"), on)
    repeated = plan.filter("equal > 1")
    if repeated.limit(1).count():  # one of the equal rows meets the lines of all of them, in several tasks if there are many
        again = repeated.select("plan_id", "plan_mark", "equal").distinct()
        once = rows.join(again, on).drop("plan_id", "plan_mark").dropDuplicates(["own_doc_id", "mark"])
        once = once.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.least("equal", F.lit(SALTS)).cast("int") - 1))).drop("equal")
        out = out.unionByName(once.join(repeated, on & (F.col("own_salt") == F.col("salt"))).drop("own_salt"))
    out = by_position(out, "deal", "copy")
    cut = F.col("words") < F.col("size")
    text = F.when(cut, first_words(F.col("own_text"), F.col("words"))).otherwise(F.col("own_text"))
    shown = {c: F.col(f"own_{c}") for c in columns} | {"text": text}
    if "n_chars" in columns:
        shown["n_chars"] = F.when(cut, F.length(text).cast("long")).otherwise(F.col("own_n_chars"))
    return out.select(*[shown[c].alias(c) for c in columns])

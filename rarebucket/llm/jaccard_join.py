"""Set similarity join on word shingles: near copies and the groups they form.

Documents become sets of hashed five-word shingles. Two sets of Jaccard similarity 0.8 or more share a
shingle among the first floor(0.2 n) + 1 of each, in any one order of all shingles (prefix filter). The order
here puts shingles that many documents share last, so that common passages seldom reach a
prefix; how often a shingle occurs is counted over all documents.

1. Equal sets collapse into a class, classes of equal size and prefix into a group; only groups are indexed.
2. Each posting list and each group has a centre: the member with the largest share of common shingles, as the source of many
   edited copies has. Pairs of a centre and a member that meet in a fair part of their lists are verified. The
   components of what holds are most of the result, and links inside them need no look any more.
3. In lists and groups that still hold several components, all pairs across components that pass the
   size filter and share enough of their prefixes are expanded to members and verified. So no pair within a component is
   made, and no pair that could join two components is left out.

Null texts and texts without words have an empty set and link with nothing. Texts of under five words are one
shingle. Rows with equal ids are rows of their own; a null id is ignored when a component takes its smallest
id. An empty table gives an empty result. Other columns are not read. Texts are never cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarebucket.llm.common import forget, kept_tables, mixed, pieces, reliable, tidy
from rarebucket.llm.components import components
from rarebucket.llm.shingles import shingle_sets

#: Shingles counted at once in a task, and the entries of the broadcast table of common shingles (9 bytes each).
CHUNK, COMMON = 4_000_000, 1 << 20
#: Rows up to which the keys of wanted texts are broadcast; beyond, the join shuffles.
SMALL_SIDE = 1_000_000
#: Tasks that the pairs of one node are dealt to, at most; a class of sizes holds those up to this many times its least (over 1.25).
SALTS, CLASS = 32, 1.26


def common_shingles(texts: DataFrame, size: int, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, class) of shingles that occur in many documents; the class is 1 + log2 of how many.

    Every task counts all its shingles and hands on those that it meets three times. A shingle that is rare
    in all tasks may be missed, which costs candidates, never results: any order serves the prefix filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[n > 2].view(np.int64)), pa.array(n[n > 2].astype(np.int64))], names=["shingle", "n"])

        for batch in pieces(batches, 0):
            held += shingle_sets(batch.column(0), size)
            if sum(map(len, held)) > CHUNK:
                yield out()
        if held:
            yield out()

    counted = texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    counted = reliable(counted.select("shingle", (F.floor(F.log2("n")) + 1).cast("int").alias("class")))
    sizes = {r["class"]: r["count"] for r in counted.groupBy("class").count().collect()}  # 63 classes at most
    lowest, total = 63, 0
    while lowest > 1 and total + sizes.get(lowest - 1, 0) <= COMMON:
        lowest -= 1
        total += sizes.get(lowest, 0)
    rows = counted.filter(F.col("class") >= lowest).toArrow()
    found = rows["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], rows["class"].to_numpy().astype(np.uint8)[order]


def prefixes(docs: DataFrame, size: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row of (doc_id, mark, text): number of shingles, two fingerprints of the set, one of the prefix, how common
    its shingles are (thousandths of a class), and the prefix in order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = shared.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in pieces(batches, 2):
            rows, tokens, ends = [], [], [0]
            for s in shingle_sets(batch.column(2), size):
                n = len(s)
                level = np.zeros(n, np.uint8)
                look = np.flatnonzero(maybe[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
                if len(look):
                    at = np.minimum(np.searchsorted(known, s[look]), len(known) - 1)
                    level[look] = np.where(known[at] == s[look], classes[at], 0)
                first = n // 5 + 1 if n else 0
                order = np.argsort(level, kind="stable")[:first] if len(look) else np.arange(first)
                prefix = s[order]
                rows.append((n, *(int(mixed(x).sum()) if n else 0 for x in (s ^ np.uint64(0x51ED270B), s + np.uint64(0xB492B66F), prefix ^ np.uint64(0x2545F491))), int(1000 * level.mean()) if n else 0))
                tokens.append(prefix)
                ends.append(ends[-1] + first)
            n, *prints = (np.array(x, np.uint64).view(np.int64) for x in zip(*rows, strict=True))
            flat = pa.array(np.concatenate(tokens).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *map(pa.array, prints), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "mark", "n", "set_a", "set_b", "lead", "weight", "prefix"])

    return docs.mapInArrow(run, "doc_id long, mark long, n long, set_a long, set_b long, lead long, weight long, prefix array<long>")


def similar_size(n: Column, m: Column) -> Column:
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def in_reach(n: Column, m: Column, at: Column, to: Column) -> Column:
    """0.8 is out of reach if the first shared shingle stands at ``at`` and ``to`` and too few follow in one of the sets."""
    return (F.lit(1) + F.least(n - at - 1, m - to - 1)) * 9 >= (n + m) * 4


def first_of(n: Column) -> Column:
    """The length of a prefix."""
    return F.floor(n / 5) + 1


def enough_shared(n: Column, m: Column, shared: Column) -> Column:
    """If the prefixes share ``shared`` shingles, the sets share that and what follows one of the prefixes at most."""
    return (shared + F.greatest(n - first_of(n), m - first_of(m))) * 9 >= (n + m) * 4


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough, found from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, 2), 3):
            keep = []
            sides = []
            for k in (0, 1):  # a text that occurs in several pairs is shingled once
                _, first, at = np.unique(batch.column(k).to_numpy(), return_index=True, return_inverse=True)
                sets = shingle_sets(batch.column(k + 2).take(pa.array(first)), size)
                sides.append([sets[i] for i in at.tolist()])
            for x, y in zip(*sides, strict=True):
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(bool(100 * shared >= 80 * (len(x) + len(y) - shared)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["u", "v"])

    # the pairs of a hub meet its text in up to SALTS tasks, dealt by the other end
    salted = pairs.select("a", "b", *[F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int").alias(f"salt_{k}") for k, other in ("ab", "ba")])
    ends = salted.select(F.explode(F.array(*[F.struct(F.col(k).alias("node"), F.col(f"salt_{k}").alias("salt")) for k in "ab"])).alias("x"))
    wanted = ends.groupBy("x.node").agg(F.collect_set("x.salt").alias("salts"))
    wanted = reliable(wanted.join(nodes.select("node", "doc_id", "mark"), "node"))
    texts = docs.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "text")
    side = F.broadcast(wanted) if wanted.count() <= SMALL_SIDE else wanted
    texts = texts.join(side, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark"))).groupBy("node").agg(F.first("text").alias("text"), F.first("salts").alias("salts"))
    texts = texts.select("node", F.explode("salts").alias("salt"), "text")
    # merged, since even a small table of texts is better not sent through the driver
    left, right = (texts.select(F.col("node").alias(f"node_{k}"), F.col("salt").alias(f"of_{k}"), F.col("text").alias(f"text_{k}")).hint("merge") for k in "ab")
    both = salted.join(left, (F.col("a") == F.col("node_a")) & (F.col("salt_a") == F.col("of_a"))).join(right, (F.col("b") == F.col("node_b")) & (F.col("salt_b") == F.col("of_b")))
    out = reliable(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "u long, v long"))
    forget(wanted)
    return out


def near_copies(docs: DataFrame, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, mark (hash of the text), n_shingles, component_id, ``first`` (one row of each component)."""
    spark, already = docs.sparkSession, kept_tables()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("mark"), F.col(text).cast("string").alias("text"))
    common = common_shingles(docs.select("text"), size)
    rows = reliable(prefixes(docs, size, common).withColumn("row", F.monotonically_increasing_id()))
    full = rows.filter("n > 0")
    classes = full.groupBy("n", "set_a", "set_b").agg(F.min("row").alias("node"), F.min("lead").alias("lead"), F.min("weight").alias("weight"))
    groups = classes.groupBy("n", "lead").agg(F.min(F.struct(-F.col("weight"), "node")).alias("x")).select("n", "lead", F.col("x.node").alias("group"))
    members = reliable(classes.join(groups, ["n", "lead"]).select("node", "group", "n", "set_a", "set_b"))
    nodes = members.select("node").join(full.select(F.col("row").alias("node"), "doc_id", "mark"), "node")
    # only groups' first members are indexed, and of their shingles those that others have too
    others = reliable(full.select("row").join(members.filter("node = group").select(F.col("node").alias("row")), "row", "left_anti"))
    side = F.broadcast(others) if others.count() <= SMALL_SIDE else others
    lists = full.join(side, "row", "left_anti").select(F.col("row").alias("group"), F.posexplode("prefix").alias("at", "token"))
    again = lists.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1").select("token")
    # most tokens are in one list of one, so what else is known of a group is joined to the rest only
    lists = lists.join(again, "token", "left_semi")
    sizes = full.select(F.col("row").alias("of"), F.col("n").cast("int").alias("n"), F.col("weight").cast("int").alias("weight"))
    lists = reliable(lists.join(sizes, F.col("group") == F.col("of")).select("token", "group", "n", "weight", "at"))

    # each list's centre with its others; a minimum is found where rows lie, so a long list needs no task of its own
    centres = lists.groupBy("token").agg(F.min(F.struct(-F.col("weight"), "n", "group")).alias("x")).select("token", F.struct("x.group", "x.n").alias("centre"))
    star = lists.join(centres, "token").filter(F.col("group") != F.col("centre.group"))
    star = star.filter(similar_size(F.col("centre.n"), F.col("n"))).groupBy(F.col("centre.group").alias("b"), F.col("group").alias("a")).agg(F.count("*").alias("met"), F.max("n").alias("n"))
    star = star.filter(F.col("met") * 4 >= first_of(F.col("n"))).select("a", "b")
    tried = reliable(star.union(members.filter("node <> group").select("node", "group")))
    links = verified(tried, nodes, docs, size)
    label = components(links)

    # what may join two components
    member = members.join(label, "node", "left").select("node", "group", "n", F.coalesce("component", "node").alias("label"))
    member = reliable(member)
    state = member.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    marked = lists.join(state.withColumnRenamed("group", "of"), F.col("group") == F.col("of")).select("token", "group", "n", "at", "low", "high")
    apart = marked.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("token")
    # a list is paired by classes of size, of which only equal and next ones can hold similar sizes
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(CLASS)).cast("int")
    left_over = reliable(marked.join(apart, "token").withColumn("kind", kind))
    x, y = left_over.alias("x"), left_over.withColumn("kind", F.explode(F.array(F.col("kind"), F.col("kind") - 1))).alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.group") < F.col("y.group")))
    across = (F.col("x.low") != F.col("y.low")) | (F.col("x.high") != F.col("y.high")) | (F.col("x.low") != F.col("x.high"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.kind") == F.col("y.kind")) & ordered & across & similar_size(F.col("x.n"), F.col("y.n")) & in_reach(F.col("x.n"), F.col("y.n"), F.col("x.at"), F.col("y.at")))
    pairs = reliable(pairs.select(F.col("x.group").alias("g"), F.col("y.group").alias("h")).distinct())
    heads = [full.select(F.col("row").alias(r), F.col("n").alias(n), F.col("prefix").alias(p)) for r, n, p in (("gr", "n", "gp"), ("hr", "m", "hp"))]
    pairs = pairs.join(heads[0], F.col("g") == F.col("gr")).join(heads[1], F.col("h") == F.col("hr"))
    pairs = pairs.filter(enough_shared(F.col("n"), F.col("m"), F.size(F.array_intersect("gp", "hp")))).select("g", "h")
    left, right = (member.select(F.col("node").alias(a), F.col("group").alias(g), F.col("label").alias(lab)) for a, g, lab in (("a", "p", "k"), ("b", "q", "l")))
    expanded = pairs.join(left, F.col("g") == F.col("p")).join(right, (F.col("h") == F.col("q")) & (F.col("k") != F.col("l"))).select("a", "b")
    mixed_groups = state.filter("low <> high").select(F.col("group").alias("g"))
    inside = mixed_groups.join(left, F.col("g") == F.col("p")).join(right, (F.col("g") == F.col("q")) & (F.col("k") != F.col("l")) & (F.col("a") < F.col("b"))).select("a", "b")
    more = expanded.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = reliable(more.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    joined = components(links.union(verified(more, nodes, docs, size)))

    of = members.join(joined, "node", "left").select("n", "set_a", "set_b", F.coalesce("component", "node").alias("c"))
    placed = rows.select("row", "doc_id", "mark", "n", "set_a", "set_b").join(of, ["n", "set_a", "set_b"], "left").select("row", "doc_id", "mark", "n", F.when(F.col("n") > 0, F.col("c")).otherwise(-F.col("row") - 1).alias("c"))
    placed = reliable(placed)
    tidy(spark, already, (placed,))
    # a row without partners needs no look at its component, and the others' heads are few unless the corpus is large
    heads = placed.groupBy("c").agg(F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head"))
    heads = reliable(heads.filter("rows > 1").select(F.col("c").alias("of"), "low", F.col("head.row").alias("chief")))
    side = F.broadcast(heads) if heads.count() <= SMALL_SIDE else heads
    out = placed.join(side, F.col("c") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("of").isNull() | (F.col("row") == F.col("chief"))).alias("first"))


def without_near_copies(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id. Rows without words all stay."""
    columns = docs.columns
    found = near_copies(docs, size)
    state = found.groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("stay"))
    state = reliable(state.filter("stay < n").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "stay"))
    side = F.broadcast(state) if state.count() <= SMALL_SIDE else state
    own = docs.select(*[F.col(c).alias(f"own_{c}") for c in columns]).withColumn("own_key", F.col("own_doc_id").cast("long")).withColumn("own_mark", F.coalesce(F.xxhash64("own_text"), F.lit(0)))
    out = own.join(side, F.col("own_key").eqNullSafe(F.col("gone_id")) & (F.col("own_mark") == F.col("gone_mark")), "left")
    whole = out.filter("stay IS NULL")
    # repeated rows: equal id and text, of which some stay
    again = out.filter("stay > 0").withColumn("nth", F.row_number().over(Window.partitionBy("own_key", "own_mark").orderBy(F.lit(0)))).filter("nth <= stay")
    shown = [F.col(f"own_{c}").alias(c) for c in columns]
    return whole.select(*shown).union(again.select(*shown))

"""Near copies among embeddings by search over a robust-pruned flat graph.

1. Vectors of equal label and dimension are comparable. Equal vectors collapse into one node that counts for several.
2. Nodes are dealt to overlapping cluster shards of at most ``SHARD``: an oversized shard is split by k-means over a bounded
   sample of it, and a node also goes (as a guest) to further clusters if it lies within the reach of a link of their
   border, up to ``GUESTS``. The links of some queries of the shard, found among all its nodes, tell whether a split parts
   links. Where it does, as in a dense ball, the shard becomes groups dealt by hash and a shard for each pair of
   groups, which loses nothing.
3. In each shard every node gets the neighbours that robust pruning leaves of its nearest, and reverse links;
   the adjacency lists of all cluster shards are united by node. (Shards of groups keep theirs: there a node has as many lists as
   there are groups.) The nearest of a node come from products of blocks: at ``SHARD`` nodes they cost no more than one
   search, which takes about 40 steps over 48 neighbours.
4. In each shard, with the united lists, every node at home there is searched for greedily from the medoid, and
   from what the search meets within the cosine bound the search expands over all nodes in range or nearly so. Each link found is verified in
   double precision.
5. Links between nodes at home in one shard are only counted and reduced to a spanning forest there; others are
   united as pairs.
6. A bounded number of queries is held against all vectors by brute force; a recall under ``RECALL`` is an error.

Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing.
Rows of equal vec_id are rows of their own; equal vectors and ties at the bound all link. An empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebucket.llm.common import forget, kept_tables, reliable, tidy
from rarebucket.llm.components import components

#: Nodes of a shard, vectors of a sample per split, clusters of a split, clusters that a node visits besides its own.
SHARD, SAMPLE, FANOUT, GUESTS = 2048, 2000, 32, 2
#: Rows of a shard that are dealt in one task; queries that a split is judged by, and queries of the audit.
DEALT, JUDGES, AUDITED, RECALL = 8192, 64, 200, 0.9
#: Candidates and neighbours per node, slack of the pruning, width of the greedy search.
NEAREST, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 24
#: How far below the bound a node may be for the search to go on from it.
SLACK = 0.01
#: Tasks that the links of one node are dealt to.
SALTS = 8
#: Splits in a row before the rest is dealt by hash.
LEVELS = 16
#: The share of the judging queries' links that a split may part.
TORN = 0.01

MEMBER = "shard string, side int, home boolean, node long, many long, vector array<double>"


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(column: pa.ListArray) -> pa.ListArray:
    """Vectors of any dimensions, none empty or zero, scaled to length 1."""
    if not len(column):
        return column
    flat, n = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()
    ends = np.concatenate([[0], np.cumsum(n)])
    x = flat / np.repeat(np.maximum.reduceat(np.abs(flat), ends[:-1]), n)  # no overflow in the squares
    x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, ends[:-1])), n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))


def means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from spread-out starting points, the same in every run."""
    start = [int(np.argmax(x @ x.mean(0)))]
    gap = ((x - x[start[0]]) ** 2).sum(1)
    while len(start) < k:
        start.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[start[-1]]) ** 2).sum(1))
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
    return c


def stays(x: np.ndarray, c: np.ndarray, reach: float, guests: int) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, whether it goes there) per vector: its own first, then the nearest borders, those within reach."""
    far = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))
    own = far.argmin(1)
    apart = 2 * np.sqrt(((c[:, None, :] - c[None]) ** 2).sum(2))[own]
    border = np.where(apart > 0, (far - far[np.arange(len(x)), own][:, None]) / np.maximum(apart, 1e-12), np.inf)
    border[np.arange(len(x)), own] = -1
    order = np.argsort(border, axis=1, kind="stable")[:, : 1 + guests]
    return order, np.take_along_axis(border, order, 1) <= reach


def parted(x: np.ndarray, node: np.ndarray, q: np.ndarray, query: np.ndarray, c: np.ndarray, reach: float) -> tuple[int, int]:
    """The links between rows and queries, and of how many neither end visits the other's cluster."""
    u, v = np.nonzero((x @ q.T >= 1 - reach * reach / 2) & (node[:, None] != query))
    (at, goes), (at_q, goes_q) = stays(x, c, reach, GUESTS), stays(q, c, reach, GUESTS)
    there = ((at[u] == at_q[v][:, :1]) & goes[u]).any(1) | ((at_q[v] == at[u][:, :1]) & goes_q[v]).any(1)
    return len(u), int((~there).sum())


def split(members: DataFrame, large: DataFrame, reach: float, shard: int) -> tuple[DataFrame, DataFrame]:
    """Members of the shards in ``large`` (shard, n) dealt to clusters of them, and the shards (shard, n) that k-means would tear."""

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        x = np.stack(rows["vector"].tolist())
        k = int(min(FANOUT, len(x), -(-2 * (1 + GUESTS) * rows["n"].iloc[0] // shard)))  # room for guests
        return pd.DataFrame({"shard": pd.Series([rows["shard"].iloc[0]], dtype=object), "n": [rows["n"].iloc[0]], "centres": [means(x, k).ravel().tolist()], "query": [rows["node"].tolist()[:JUDGES]], "queries": [x[:JUDGES].ravel().tolist()]})

    def deal(rows: pa.Table, models: pa.Table) -> pa.Table:
        if not len(rows) or not len(models):
            return DEALT_ARROW.empty_table()
        x, node, home = matrix(rows["vector"]), rows["node"].to_numpy(), rows["home"].to_numpy()
        c, q = (np.array(models[n][0].values.to_numpy()).reshape(-1, x.shape[1]) for n in ("centres", "queries"))
        query = np.array(models["query"][0].values.to_numpy())
        links, torn = parted(x, node, q, query, c, reach) if len(c) > 1 else (1, 1)  # one cluster would be no split
        at, goes = stays(x, c, reach, GUESTS)
        goes[:, 1:] &= home[:, None]  # a guest brings no guests
        row, place = np.nonzero(goes)
        name = rows["shard"][0].as_py()
        out = rows.take(pa.array(row))
        columns = {n: out[n].combine_chunks() for n in ("side", "node", "many", "vector")}
        columns |= {"shard": pa.array([f"{name}/{i}" for i in at[row, place].tolist()], pa.string()), "home": pa.array(home[row] & (place == 0)), "was": pa.array([name] * len(row), pa.string())}
        columns |= {n: pa.nulls(len(row), pa.int64()) for n in ("links", "torn")}
        found = pa.table({n: columns[n] for n in DEALT_ARROW.names}, schema=DEALT_ARROW)
        judged = {"was": pa.array([name]), "links": pa.array([links]), "torn": pa.array([torn])}
        return pa.concat_tables([found, pa.table([judged.get(f.name, pa.nulls(1, f.type)) for f in DEALT_ARROW], schema=DEALT_ARROW)])

    rows = members.join(F.broadcast(large) if large.count() <= SMALL_SIDE else large, "shard")
    drawn = rows.filter(F.pmod(F.xxhash64("node"), "n") < SAMPLE).select("shard", "node", "n", "vector")
    models = reliable(drawn.groupBy("shard").applyInPandas(model, "shard string, n long, centres array<double>, query array<long>, queries array<double>"))
    salts = F.ceil(F.col("n") / DEALT).cast("int")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(9)), salts).cast("int")).drop("n")
    right = models.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    dealt = reliable(left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(deal, f"{MEMBER}, was string, links long, torn long"))
    judged = dealt.filter("node IS NULL").groupBy("was").agg(F.sum("links").alias("links"), F.sum("torn").alias("torn"))
    judged = reliable(judged.filter(F.col("torn") > TORN * F.col("links")).select(F.col("was").alias("shard")))
    kept = dealt.filter("node IS NOT NULL").join(judged, F.col("was") == judged["shard"], "left_anti").select("shard", "side", "home", "node", "many", "vector")
    return kept, large.join(judged, "shard", "left_semi")


MEMBER_ARROW = pa.schema([("shard", pa.string()), ("side", pa.int32()), ("home", pa.bool_()), ("node", pa.int64()), ("many", pa.int64()), ("vector", pa.list_(pa.float64()))])
DEALT_ARROW = pa.schema([*MEMBER_ARROW, ("was", pa.string()), ("links", pa.int64()), ("torn", pa.int64())])
#: Rows up to which the names of large shards are broadcast.
SMALL_SIDE = 100_000


def by_groups(members: DataFrame, large: DataFrame, shard: int) -> DataFrame:
    """Members of the shards in ``large`` dealt to groups, and a shard for each pair of groups. The sides of a pair are 1 and 2."""
    rows = members.join(F.broadcast(large) if large.count() <= SMALL_SIDE else large, "shard").withColumn("groups", F.ceil(F.col("n") * 2 / shard).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), "groups").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    return rows.select(F.concat_ws("/", "shard", F.concat(F.lit("g"), low, F.lit("-"), high)).alias("shard"), side.alias("side"), "home", "node", "many", "vector")


def shards(nodes: DataFrame, reach: float, shard: int) -> DataFrame:
    """Rows of MEMBER for all (place, node, many, vector)."""
    members = nodes.select(F.col("place").alias("shard"), F.lit(0).alias("side"), F.lit(True).alias("home"), "node", "many", "vector")
    done = None
    for level in range(LEVELS):  # members are as written by the level before, or nodes
        sizes = reliable(members.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("at_home")))
        large = sizes.filter(F.col("n") > shard).select("shard", "n")
        fits = members.join(sizes.filter((F.col("n") <= shard) & (F.col("at_home") > 0)).select("shard"), "shard", "left_semi")
        done = fits if done is None else done.union(fits)
        if not large.limit(1).count():
            return done
        if level == LEVELS - 1:
            return done.union(by_groups(members, large, shard))
        dealt, torn = split(members, large, reach, shard)
        done = done.union(by_groups(members, torn, shard))
        members = dealt
    return done


def pruned(x: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Out-neighbours of each row: of its nearest, those that no closer chosen one covers, filled up with the nearest to half
    the degree, since in a ball one centre may cover all; then reverse links up to twice the degree, and one to each row that has none."""
    n, k = len(x), min(NEAREST, len(x) - 1)
    x = x.astype(np.float32)
    chosen: list[np.ndarray] = []
    for a in range(0, n, 256):
        near = x[a : a + 256] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(near, top, 1)))
        between = np.sqrt(np.maximum(0, 2 - 2 * x[top] @ x[top].transpose(0, 2, 1)))
        alive, keep = np.ones(top.shape, bool), np.zeros(top.shape, bool)
        rows = np.arange(len(top))
        for _ in range(degree):
            pick = alive.argmax(1)
            left = alive[rows, pick]
            if not left.any():
                break
            keep[rows[left], pick[left]] = True
            alive &= alpha * between[rows, pick] > far
            alive[rows, pick] = False
        keep |= ~keep & (np.cumsum(~keep, 1) <= np.maximum(0, degree // 2 - keep.sum(1))[:, None])
        chosen += [t[m] for t, m in zip(top, keep, strict=True)]
    out = [set(c.tolist()) for c in chosen]
    for i, c in enumerate(chosen):
        for j in c.tolist():
            if len(out[j]) < 2 * degree:
                out[j].add(i)
    met = np.zeros(n, bool)
    for o in out:
        met[list(o)] = True
    for i in np.flatnonzero(~met).tolist():
        out[int(chosen[i][0])].add(i)
    return [np.array(sorted(o), np.int64) for o in out]


def table_of(lists: list[np.ndarray]) -> np.ndarray:
    """Adjacency as a rectangle; a row is filled up with its own number."""
    out = np.repeat(np.arange(len(lists))[:, None], max(1, max(map(len, lists))), 1)
    for i, one in enumerate(lists):
        out[i, : len(one)] = one
    return out


def greedy(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: int, beam: int) -> np.ndarray:
    """The ``beam`` best nodes met per query, all queries advancing together; -1 where there are fewer."""
    q, rows, x = len(queries), np.arange(len(queries)), x.astype(np.float32)
    best, score = np.full((q, beam), -1), np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    best[:, 0], score[:, 0], done[:, 0] = start, x[queries] @ x[start], False
    while not done.all():
        ahead = np.where(done, -np.inf, score)
        pick = ahead.argmax(1)
        live = ~done[rows, pick]
        done[rows, pick] = True
        r = rows[live]
        new = links[best[r, pick[live]]]
        fresh = ~(new[:, :, None] == best[r][:, None, :]).any(2)
        ordered = np.sort(new, 1)
        first = np.ones_like(fresh)
        first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        new, fresh = ordered, np.take_along_axis(fresh, np.argsort(new, 1, kind="stable"), 1) & first
        value = np.where(fresh, (x[new] @ x[queries[r]][:, :, None])[:, :, 0], np.float32(-np.inf))
        all_score = np.concatenate([score[r], value], 1)
        order = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        best[r] = np.take_along_axis(np.concatenate([best[r], new], 1), order, 1)
        done[r] = np.take_along_axis(np.concatenate([done[r], np.zeros_like(fresh)], 1), order, 1)
        score[r] = np.take_along_axis(all_score, order, 1)
        best[r] = np.where(np.isfinite(score[r]), best[r], -1)
        done[r] |= best[r] < 0
    return best


def expanded(x: np.ndarray, links: np.ndarray, queries: np.ndarray, found: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(query position, node) of all nodes in range that are reachable over nodes in range or nearly so, the query itself included."""
    n = len(x)
    seen = np.zeros((len(queries), n), bool)
    at = np.concatenate([np.repeat(np.arange(len(queries)), found.shape[1])[(found >= 0).ravel()], np.arange(len(queries))])
    node = np.concatenate([found[found >= 0], queries])
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        key = np.unique(at * n + node)
        at, node = key // n, key % n
        new = ~seen[at, node]
        at, node = at[new], node[new]
        seen[at, node] = True
        value = np.concatenate([np.zeros(0), *(np.einsum("id,id->i", x[queries[at[a : a + 65536]]], x[node[a : a + 65536]]) for a in range(0, len(at), 65536))])
        hits.append((at[value >= bound], node[value >= bound]))
        near = value >= bound - SLACK
        at, node = at[near], node[near]
        at, node = np.repeat(at, links.shape[1]), links[node].ravel()
        new = ~seen[at, node]
        at, node = at[new], node[new]
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if np.array_equal(was, label):
            return label


def adjacency(members: DataFrame) -> DataFrame:
    """(shard, node, links): a node's neighbours in all cluster shards together, or in its one shard of groups."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        node = rows["node"].to_numpy()
        lists = pruned(np.stack(rows["vector"].tolist()), DEGREE, ALPHA) if len(node) > 1 else [np.zeros(0, np.int64)]
        return pd.DataFrame({"shard": rows["shard"], "node": node, "links": [node[one].tolist() for one in lists]})

    local = reliable(members.groupBy("shard").applyInPandas(run, "shard string, node long, links array<long>"))
    grouped = F.col("shard").rlike("/g[0-9]+-[0-9]+$")
    clusters = local.filter(~grouped)
    united = clusters.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    return clusters.select("shard", "node").join(united, "node").select("shard", "node", "links").union(local.filter(grouped))


FOUND = "kind long, u long, v long, n long, m long"
COUNT, TREE, PAIR = 0, 1, 2


def searched(members: DataFrame, lists: DataFrame, bound: float) -> DataFrame:
    """Rows of FOUND: COUNT (node, -, links found at home), TREE (u, v) and PAIR (u < v, how many rows u and v stand for)."""

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows, found = rows.sort_values("node", ignore_index=True), found.sort_values("node", ignore_index=True)
        x, node, many = np.stack(rows["vector"].tolist()), rows["node"].to_numpy(), rows["many"].to_numpy()
        home, side = rows["home"].to_numpy(), rows["side"].to_numpy()
        number = {v: i for i, v in enumerate(node.tolist())}
        links = table_of([np.array([number[v] for v in one if v in number], np.int64) for one in found["links"]])
        medoid = int((x @ x.mean(0)).argmax())
        at_home = np.flatnonzero(home)
        us, vs = [], []
        for a in range(0, len(at_home), 512):
            queries = at_home[a : a + 512]
            q, v = expanded(x, links, queries, greedy(x, links, queries, medoid, BEAM), bound)
            us.append(queries[q])
            vs.append(v)
        u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
        keep = (u != v) & ((side[u] == 0) | (side[u] != side[v]))
        u, v = u[keep], v[keep]
        both = home[v]
        # a link that only one end has found holds for both
        key = np.unique(np.concatenate([u[both] * len(node) + v[both], v[both] * len(node) + u[both]]))
        hu, hv = key // len(node), key % len(node)
        count = np.bincount(hu, many[hv], minlength=len(node)).astype(np.int64)
        label = roots(len(node), hu, hv)
        inner, far = np.flatnonzero(label != np.arange(len(node))), ~both
        gu, gv = u[far], v[far]
        low = node[gu] < node[gv]
        one, two = np.where(low, gu, gv), np.where(low, gv, gu)
        linked = np.flatnonzero(count)
        return pd.DataFrame({
            "kind": np.repeat([COUNT, TREE, PAIR], [len(linked), len(inner), len(one)]),
            "u": np.concatenate([node[linked], node[inner], node[one]]), "v": np.concatenate([node[linked], node[label[inner]], node[two]]),
            "n": np.concatenate([count[linked], 0 * inner, many[one]]), "m": np.concatenate([0 * linked, 0 * inner, many[two]])})

    return members.groupBy("shard").cogroup(lists.groupBy("shard")).applyInPandas(run, FOUND)


def usable(embeddings: DataFrame) -> DataFrame:
    vector = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0)
    return embeddings.select("row", "label", vector.alias("vector")).filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(F.coalesce(fine, F.lit(False)))


def near_vectors(embeddings: DataFrame, bound: float = 0.98, shard: int = SHARD, audited: int = AUDITED) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of (vec_id, embedding, label).

    RuntimeError if less than ``RECALL`` of the links of about ``audited`` nodes have been found (0: no audit).
    """
    spark, already = embeddings.sparkSession, kept_tables()
    rows = reliable(embeddings.select("vec_id", "embedding", "label").withColumn("row", F.monotonically_increasing_id()))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), unit(batch.column(2))], names=["row", "place", "vector"])

    place = F.concat_ws(":", F.col("label").cast("string"), F.size("vector").cast("string"))
    clean = usable(rows).select("row", place.alias("place"), "vector").mapInArrow(scaled, "row long, place string, vector array<double>")
    clean = reliable(clean)
    nodes = reliable(clean.groupBy("place", "vector").agg(F.min("row").alias("node"), F.count("*").alias("many")))
    reach = float(np.sqrt(2 - 2 * bound))
    members = reliable(shards(nodes, reach, shard))
    lists = reliable(adjacency(members))
    found = reliable(searched(members, lists, bound))
    forget(members, lists)
    pairs = found.filter(F.col("kind") == PAIR).select("u", "v", "n", "m").distinct()
    counts = found.filter(F.col("kind") == COUNT).select(F.col("u").alias("node"), "n")
    counts = reliable(counts.union(pairs.select("u", "m")).union(pairs.select("v", "n")).groupBy("node").agg(F.sum("n").alias("n")))
    if audited and (share := recall(nodes, counts, bound, audited)) < RECALL:
        raise RuntimeError(f"only {share:.3f} of the links of audited vectors were found")
    linked = components(found.filter(F.col("kind") != COUNT).select("u", "v"), SALTS)
    per_node = nodes.join(counts, "node", "left").join(linked, "node", "left").select("place", "vector", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    per_row = clean.join(per_node, ["place", "vector"]).select("row", "n_links", "c")
    out = reliable(rows.select("row", "vec_id").join(per_row, "row", "left").select("row", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("c", -F.col("row") - 1).alias("c")))
    tidy(spark, already, (out,))
    heads = out.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    return out.join(heads, "c").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def recall(nodes: DataFrame, counts: DataFrame, bound: float, queries: int = AUDITED) -> float:
    """Share of the links of about ``queries`` nodes, known by brute force over all, that ``counts`` (node, n) has.

    Only the queries, a bounded number, are broadcast; every node is held against those of its label and dimension.
    """
    n = max(1, nodes.count())
    drawn = nodes.filter(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(n)) < queries).select("place", "node", "vector").toArrow()
    asked: dict[str, list[tuple]] = {}
    for place, node, vector in zip(*(drawn[c].to_pylist() for c in ("place", "node", "vector")), strict=True):
        asked.setdefault(place, []).append((node, vector))
    held = nodes.sparkSession.sparkContext.broadcast({p: (np.array([k for k, _ in rows]), np.array([v for _, v in rows])) for p, rows in asked.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, int] = {}
            places = np.array(batch.column(0).to_pylist(), object)
            for place, (query, q) in held.value.items():
                here = pa.array(np.flatnonzero(places == place))
                if len(here):
                    own = batch.take(here)
                    node, many = own.column(1).to_numpy(), own.column(2).to_numpy()
                    near = (q @ matrix(own.column(3)).T >= bound) & (query[:, None] != node)
                    for k, links in zip(query.tolist(), (near @ many).tolist(), strict=True):
                        found[k] = found.get(k, 0) + links
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int64()), pa.array([*found.values()], pa.int64())], names=["query", "links"])

    truth = nodes.select("place", "node", "many", "vector").mapInArrow(run, "query long, links long").groupBy("query").agg(F.sum("links").alias("links"))
    got = truth.join(counts, F.col("query") == F.col("node"), "left").agg(F.sum(F.least("links", F.coalesce("n", F.lit(0)))), F.sum("links")).first()
    return 1.0 if not got[1] else got[0] / got[1]

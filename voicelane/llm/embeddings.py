"""Near-duplicate embeddings by search in a robust-pruned flat graph.

Vectors of a label are cut into overlapping shards: k-means on a bounded sample, every vector goes to
its nearest clusters. In each shard a graph is built: candidates are a vector's nearest ones and some
random ones, and robust pruning keeps those that no kept one replaces, so edges lead in all directions.
Adjacency lists of a vector from its shards are united. Then every vector is searched for in its
shards: greedily from the medoid, and from there on to all neighbours of whatever lies within the range
(and a little beyond). Pairs that are found are verified in double precision. An audit compares a
sample with all vectors; if too little was found, the graph is built again with more overlap and edges.

Equal vectors are one node from the start. A shard passes on only counts and a spanning forest, not
pairs, so its output grows with its vectors. A cluster too large for a task is cut into slices by hash,
and every two slices form a shard, so each pair still meets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelane.llm import common

#: Vectors of a cluster to aim for, and at most in a slice.
CLUSTER, SLICE = 1_500, 3_000
#: Vectors of a label that k-means sees on average, clusters of all labels together, k-means rounds.
SAMPLE, CLUSTERS, ROUNDS = 4_096, 32_768, 8
#: Nearest and random candidates of a vector, edges kept, pruning factor.
NEAREST, RANDOM, EDGES, ALPHA = 48, 32, 24, 1.2
#: Steps of the greedy search, and how far beyond the range (in cosine) it still expands.
STEPS, MARGIN = 24, 0.04
#: Vectors of the audit; recall to reach; clusters per vector at first, and attempts.
AUDITED, RECALL, OVERLAP, ATTEMPTS = 256, 0.97, 2, 3


# -- inside a shard -------------------------------------------------------------------------------


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)  # no overflow in the norm
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def pruned_graph(vectors: np.ndarray, edges: int, seed: int) -> np.ndarray:
    """Neighbours of each of the unit vectors (rows of places, -1 where there are fewer)."""
    n = len(vectors)
    if n < 2:
        return np.full((n, 1), -1, dtype=np.int64)
    low = vectors.astype(np.float32)
    cosine = low @ low.T
    np.fill_diagonal(cosine, -2)
    near = min(NEAREST * edges // EDGES, n - 1)
    drawn = np.random.default_rng(seed).integers(0, n, (n, min(RANDOM, n)))
    pool = np.hstack([np.argpartition(-cosine, near - 1, axis=1)[:, :near], drawn])
    pool.sort(axis=1)
    own = np.arange(n)[:, None]
    value = np.where(np.hstack([np.ones((n, 1), bool), pool[:, 1:] != pool[:, :-1]]), cosine[own, pool], -2)
    order = np.argsort(-value, axis=1, kind="stable")
    pool, value = np.take_along_axis(pool, order, 1), np.take_along_axis(value, order, 1)
    far = np.sqrt(np.maximum(2 - 2 * value, 0))
    alive = value > -1.5
    chosen = np.full((n, edges), -1, dtype=np.int64)
    for k in range(edges):
        first = alive.argmax(axis=1)
        some = alive[np.arange(n), first]
        if not some.any():
            break
        pick = pool[np.arange(n), first]
        chosen[some, k] = pick[some]
        between = np.sqrt(np.maximum(2 - 2 * cosine[pick[:, None], pool], 0))
        alive &= ~(ALPHA * between <= far)
        alive[np.arange(n), first] = False
    return chosen


def searched(vectors: np.ndarray, lists: list[np.ndarray], least: float, steps: int) -> np.ndarray:
    """Which vectors (columns) a range-expanding greedy search from the medoid finds for each (row)."""
    n = len(vectors)
    width = max([1, *map(len, lists)])
    table = np.full((n, width), -1, dtype=np.int64)
    for i, own in enumerate(lists):
        table[i, : len(own)] = own
    low = vectors.astype(np.float32)
    medoid = int((low @ low.mean(axis=0)).argmax())
    found = np.zeros((n, n), dtype=bool)
    for start in range(0, n, 512):
        asks = low[start : start + 512]
        rows = np.arange(len(asks))
        open_ = np.full((len(asks), n), -3, dtype=np.float32)  # cosine of what is seen, not expanded
        seen = np.zeros((len(asks), n), dtype=bool)
        open_[:, medoid], seen[:, medoid] = asks @ low[medoid], True
        active, step = rows, 0
        while len(active):
            at = open_[active].argmax(axis=1)
            best = open_[active, at]
            going = (best > -2.5) & ((best >= least - MARGIN) | (step < steps))
            active, at = active[going], at[going]
            open_[active, at] = -3
            near = table[at]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            r, c = np.nonzero(fresh)
            who, what = active[r], near[r, c]
            seen[who, what] = True
            open_[who, what] = np.einsum("ij,ij->i", asks[who], low[what])
            step += 1
        found[start : start + len(asks)] = seen
    return found | found.T


def _verified(vectors: np.ndarray, found: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that were found and reach the cosine in double precision."""
    low = vectors.astype(np.float32)
    a, b = np.nonzero(np.triu(found & (low @ low.T >= least - 1e-4), 1))
    keep = np.empty(len(a), dtype=bool)
    for s in range(0, len(a), 1 << 16):
        keep[s : s + (1 << 16)] = np.einsum("ij,ij->i", vectors[a[s : s + (1 << 16)]], vectors[b[s : s + (1 << 16)]]) >= least
    return a[keep], b[keep]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each place is connected to."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            break
    return root


# -- operators ------------------------------------------------------------------------------------


def usable(vectors: DataFrame, vector: str = "embedding", label: str = "label"):
    """Whether a vector can link: with label, not null, only finite components, not all zero."""
    return F.expr(
        f"coalesce(`{label}` IS NOT NULL AND size(`{vector}`) > 0 AND forall(`{vector}`, x -> x IS NOT NULL "
        f"AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(`{vector}`, x -> x <> 0), false)"
    )


def _centres(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Centres per group that is too large for one cluster: at most ``CLUSTERS`` in all."""
    counts = nodes.groupBy("group").agg(F.count("*").alias("n"))
    total = nodes.count()
    share = F.least(F.ceil(F.col("n") / CLUSTER), F.floor(F.lit(CLUSTERS) * F.col("n") / max(total, 1)))
    large = counts.withColumn("k", share.cast("int")).filter("k > 1")
    chance = F.lit(float(SAMPLE)) / F.col("n")
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < chance * (1 << 20)
    sample = nodes.join(large, "group").filter(drawn).select("group", "k", "vector", "node")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        own = unit(np.stack(rows["vector"].to_numpy())).astype(np.float32)
        k = min(int(rows["k"].iloc[0]), len(own))
        centres = own[np.random.default_rng(7).choice(len(own), k, replace=False)]
        for _ in range(ROUNDS):
            to = (own @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, to, own)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), centres)
        return pd.DataFrame({"group": rows["group"].iloc[0], "centre": list(centres)})

    found = sample.groupBy("group").applyInPandas(fit, "group string, centre array<float>")
    centres: dict[str, list] = {}
    for row in found.toLocalIterator():
        centres.setdefault(row["group"], []).append(row["centre"])
    return {group: np.array(rows, dtype=np.float32) for group, rows in centres.items()}


def _placed(nodes: DataFrame, overlap: int) -> DataFrame:
    """``nodes`` with ``clusters``, the nearest first."""
    shared = nodes.sparkSession.sparkContext.broadcast(_centres(nodes))

    def run(batches):
        for batch in batches:
            groups = np.array(batch.column("group").to_pylist(), dtype=object)
            vectors = batch.column("vector").to_pylist()
            clusters: list = [[0]] * len(groups)
            for group in set(groups.tolist()) & shared.value.keys():
                at = np.flatnonzero(groups == group)
                cosine = unit(np.array([vectors[i] for i in at])) @ shared.value[group].T
                for i, row in zip(at.tolist(), np.argsort(-cosine, axis=1)[:, :overlap].tolist(), strict=True):
                    clusters[i] = row
            columns = [batch.column(n) for n in ("node", "group", "vector", "copies")]
            columns.append(pa.array(clusters, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["node", "group", "vector", "copies", "clusters"])

    schema = "node bigint, group string, vector array<float>, copies bigint, clusters array<int>"
    return nodes.select("node", "group", "vector", "copies").mapInArrow(run, schema)


def _shards(placed: DataFrame) -> DataFrame:
    """A row per vector and shard: ``group``, ``cluster``, ``low`` and ``high`` slice, ``slice``."""
    rows = placed.withColumn("cluster", F.explode("clusters"))
    sizes = rows.groupBy("group", "cluster").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("_cut"))
    rows = rows.join(sizes.filter("_cut > 1"), ["group", "cluster"], "left").fillna(1, ["_cut"])
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("_cut")).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1)))
    return rows.select(
        "group",
        "cluster",
        F.least("slice", "_with").alias("low"),
        F.greatest("slice", "_with").alias("high"),
        "slice",
        "node",
        "vector",
        "copies",
        "clusters",
    )


SHARD = ["group", "cluster", "low", "high"]


def _found(nodes: DataFrame, least: float, overlap: int, edges: int, steps: int) -> DataFrame:
    """``node``, ``root`` (in a shard) and ``n_links`` (with copies) from all shards."""
    shards = common.written(_shards(_placed(nodes, overlap)), "shards")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        ids = rows["node"].to_numpy()
        graph = pruned_graph(unit(np.stack(rows["vector"].to_numpy())), edges, seed=len(ids))
        near = [ids[own[own >= 0]] for own in graph]
        return pd.DataFrame({"node": ids, "near": near})

    lists = shards.groupBy(*SHARD).applyInPandas(build, "node bigint, near array<bigint>")
    # At most `edges` from each of the few shards of a vector.
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        ids = rows["node"].to_numpy()
        vectors = unit(np.stack(rows["vector"].to_numpy()))
        lists = []
        for own in rows["near"]:
            at = np.searchsorted(ids, own)
            at[at == len(ids)] = 0
            lists.append(at[ids[at] == own])
        a, b = _verified(vectors, searched(vectors, lists, least, steps), least)
        # A pair that meets in several shards counts in one: of two slices where they differ, of the
        # smallest cluster that both are in.
        low, high, cluster = (int(rows[c].iloc[0]) for c in ("low", "high", "cluster"))
        slices = rows["slice"].to_numpy()
        other = [frozenset(c) for c in rows["clusters"]]
        counts = (slices[a] != slices[b]) | (low == high)
        counts &= np.array([min(other[i] & other[j]) == cluster for i, j in zip(a, b, strict=True)], dtype=bool)
        root = _forest(len(ids), a, b)
        copies, links = rows["copies"].to_numpy(), np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, a[counts], copies[b[counts]])
        np.add.at(links, b[counts], copies[a[counts]])
        some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pd.DataFrame({"node": ids[some], "root": ids[root[some]], "n_links": links[some]})

    both = shards.join(united, "node")
    return both.groupBy(*SHARD).applyInPandas(search, "node bigint, root bigint, n_links bigint")


def audit(nodes: DataFrame, counted: DataFrame, least: float, sample: int = AUDITED) -> float:
    """Share of the true links of a bounded sample of vectors that were found; 1 if there are none.

    ``nodes``: ``node``, ``group``, ``vector``, ``copies``; ``counted``: ``node``, ``n_links``. The
    sample (the vectors of smallest hash) is compared with all vectors, batch by batch.
    """
    drawn = nodes.select("node", "group", "vector").orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    if not drawn:
        return 1.0
    asks: dict[str, list] = {}
    for row in drawn:
        asks.setdefault(row["group"], []).append((row["node"], row["vector"]))

    def compare(batches):
        for batch in batches:
            groups = np.array(batch.column("group").to_pylist(), dtype=object)
            ids, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            vectors = batch.column("vector").to_pylist()
            for group in set(groups.tolist()) & asks.keys():
                at = np.flatnonzero(groups == group)
                own = np.array([n for n, _ in asks[group]])
                cosine = unit(np.array([v for _, v in asks[group]])) @ unit(np.array([vectors[i] for i in at])).T
                links = (cosine >= least) & (own[:, None] != ids[at])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(links @ copies[at])], names=["node", "n"])

    true = nodes.select("node", "group", "vector", "copies").mapInArrow(compare, "node bigint, n bigint")
    true = true.groupBy("node").agg(F.sum("n").alias("n")).join(counted, "node", "left")
    row = true.agg(F.sum("n"), F.sum(F.least(F.coalesce("n_links", F.lit(0)), F.col("n")))).first()
    return row[1] / row[0] if row[0] else 1.0


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.98,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label and length link from cosine ``least`` on. A vector that cannot link (see
    :func:`usable`) has no links and its own component. No vectors give no rows.
    """
    rows = vectors.select(
        F.col(f"`{vec_id}`").alias("vec_id"),
        F.when(
            usable(vectors, vector, label), F.concat_ws(":", F.col(f"`{label}`").cast("string"), F.size(f"`{vector}`"))
        ).alias("group"),
        F.col(f"`{vector}`").cast("array<float>").alias("vector"),
    )
    rows = common.written(rows, "vectors")
    nodes = rows.filter("group IS NOT NULL").groupBy("group", "vector")
    nodes = nodes.agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    for attempt in range(ATTEMPTS):
        found = common.written(
            _found(nodes, least, OVERLAP + attempt, EDGES << attempt, STEPS << attempt), "found-links"
        )
        counted = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
        if audit(nodes, counted, least) >= RECALL:
            break
    edges = found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = common.components(edges)
    of_node = nodes.join(roots, "node", "left").join(counted, "node", "left")
    of_node = of_node.withColumn("root", F.coalesce("root", "node"))
    least_of = of_node.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = of_node.join(least_of, "root").select(
        "group",
        "vector",
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    joined = rows.filter("group IS NOT NULL").join(of_node, ["group", "vector"])
    linked = joined.select("vec_id", "n_links", "component_id")
    alone = rows.filter("group IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Density clusters (HDBSCAN) of any number of vectors, as Spark jobs.

1. Equal vectors become one point with a weight.
2. Points are ordered by the signs of random projections, in several trees, and each order
   is cut into leaves of at most `leaf` points; neighbours are looked for within leaves
   (exact if one leaf holds all points).  Core distances come from the neighbours of all trees.
3. Each leaf gives the minimum spanning tree of its mutual reachabilities: an edge that a
   leaf's tree lacks is in no tree of all points, so the union of these trees is all that
   single linkage needs.
4. Components below the least cluster size are contracted by joins: a component and its
   nearest neighbour merge if each is the other's nearest, and one whose nearest neighbours
   lead to a large component falls into it.  Large components wait.
5. What is left, one edge for each pair of components, is a small graph; its dendrogram is
   made on the driver once it has DRIVER_EDGES edges or fewer, or only large components.
6. Points climb from where they fell to the cluster that held them then, stabilities are
   sums over points, and the excess of mass picks the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.sampling import numbered
from textmill.operators.tables import checkpointed

NOISE = -1
#: Edges (40 bytes each) of a contracted graph whose dendrogram the driver makes.
DRIVER_EDGES = 1 << 20
#: Large components that may be left: there is one for `min_cluster_size` points at most.
DRIVER_CLUSTERS = 1 << 24
#: Distances below this count as it where they are inverted.
NEAREST = 1e-12


@dataclass(frozen=True)
class Density:
    """min_samples (by default min_cluster_size) is the rank of the neighbour that gives the core distance."""

    min_cluster_size: int = 25
    min_samples: int | None = None
    leaf: int = 1024
    trees: int = 4
    planes: int = 30
    seed: int = 42

    def __post_init__(self) -> None:
        if self.min_cluster_size < 2 or (self.min_samples or 1) < 1 or self.leaf < 2 or self.trees < 1 or not 1 <= self.planes <= 60:
            raise ValueError("clusters have 2 points or more, leaves too; 1 to 60 planes")

    @property
    def samples(self) -> int:
        return self.min_samples or self.min_cluster_size


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def points_of(vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(points: pid, weight, embedding; members: key, pid) of distinct vectors; null vectors are no points.

    pid is a vector's place by its hashes, so that ties are broken alike however the rows lie.
    """
    named = vectors.where("embedding is not null").select(key, F.xxhash64("embedding").alias("h1"), F.xxhash64("embedding", F.lit(1)).alias("h2"), "embedding")
    found = named.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    points = numbered(found.withColumn("all", F.lit(0)), "all", "h1", "pid", ties=("h2",))
    return points.select("pid", "weight", "embedding"), named.drop("embedding").join(points.select("h1", "h2", "pid"), ["h1", "h2"]).select(key, "pid")


def leaves(points: DataFrame, params: Density) -> DataFrame:
    """points with tree and leaf: in each tree, runs of at most params.leaf points in the order of signed projections."""
    n = points.count()
    most = -(-n // max(1, -(-n // params.leaf))) if n else 1
    if n <= params.leaf:
        return points.withColumns({"tree": F.lit(0), "leaf": F.lit(0).cast("long")})
    width = len(points.select("embedding").first()[0])
    planes = np.random.default_rng(params.seed).normal(size=(width, params.trees * params.planes))
    middle = np.array([r[1] for r in points.select(F.posexplode("embedding")).groupBy("pos").agg(F.avg("col")).orderBy("pos").collect()])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.int64(1) << np.arange(params.planes - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = ((matrix(batch.column("embedding")) - middle) @ planes > 0).reshape(batch.num_rows, params.trees, params.planes)
            code = (sign * places).sum(axis=2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("pid").to_numpy(), params.trees)), pa.array(np.tile(np.arange(params.trees, dtype=np.int32), batch.num_rows)), pa.array(code.ravel())], names=["pid", "tree", "code"])

    coded = points.select("pid", "embedding").mapInArrow(codes, "pid long, tree int, code long")
    placed = numbered(coded, "tree", "code", "place", ties=("pid",)).select("pid", "tree", F.expr(f"(place - 1) div {most}").alias("leaf"))
    return placed.join(points, "pid")


def _distances(x: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0.0))


def _exact(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows; the same for a pair in whatever leaf it lies."""
    out = np.zeros(len(a))
    for k in range(0, len(a), 4096):
        out[k : k + 4096] = np.sqrt(((x[a[k : k + 4096]] - x[b[k : k + 4096]]) ** 2).sum(axis=1))
    return out


def core_distances(leafed: DataFrame, params: Density) -> DataFrame:
    """pid and core: the distance at which a point has `samples` others, its copies included; the largest known distance if there are fewer."""
    k = params.samples

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pid")
        x, pid, weight = np.stack(part["embedding"]), part["pid"].to_numpy(), part["weight"].to_numpy()
        m = min(k, len(x) - 1)
        if not m:
            return pd.DataFrame({"pid": pid, "near": [[] for _ in pid]})
        d = _distances(x)
        np.fill_diagonal(d, np.inf)
        at = np.argpartition(d, m - 1, axis=1)[:, :m]
        own = np.repeat(np.arange(len(x)), m)
        far = _exact(x, own, at.ravel()).reshape(at.shape)
        return pd.DataFrame({"pid": pid, "near": [[{"d": float(e), "id": int(pid[j]), "w": int(weight[j])} for e, j in zip(ds, js, strict=True)] for ds, js in zip(far, at, strict=True)]})

    found = leafed.groupBy("tree", "leaf").applyInPandas(nearest, "pid long, near array<struct<d:double,id:long,w:long>>")
    near = found.groupBy("pid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    start = F.struct((F.lit(k) - F.col("weight") + 1).cast("long").alias("open"), F.lit(0.0).alias("d"))
    walk = F.aggregate("near", start, lambda acc, x: F.when(acc["open"] > 0, F.struct((acc["open"] - x["w"]).alias("open"), x["d"].alias("d"))).otherwise(acc))
    weights = leafed.where("tree = 0").select("pid", "weight")
    return near.join(weights, "pid").select("pid", walk["d"].alias("core"))


def leaf_edges(leafed: DataFrame, cores: DataFrame) -> DataFrame:
    """(u, v, w), u below v: edges of the spanning trees of all leaves under mutual reachability."""

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pid")
        x, pid, core = np.stack(part["embedding"]), part["pid"].to_numpy(), part["core"].to_numpy()
        reach = np.maximum(np.maximum(_distances(x), core[:, None]), core[None, :])
        near, best = np.zeros(len(x), dtype=int), reach[0].copy()
        best[0] = np.inf
        inside = np.zeros(len(x), dtype=bool)
        inside[0] = True
        a, b = [], []
        for _ in range(len(x) - 1):
            j = int(best.argmin())
            a.append(near[j])
            b.append(j)
            inside[j] = True
            closer = ~inside & (reach[j] < best)
            best[closer], near[closer] = reach[j][closer], j
            best[j] = np.inf
        a, b = np.array(a, dtype=int), np.array(b, dtype=int)
        w = np.maximum(np.maximum(_exact(x, a, b), core[a]), core[b])
        return pd.DataFrame({"u": np.minimum(pid[a], pid[b]), "v": np.maximum(pid[a], pid[b]), "w": w})

    made = leafed.join(cores, "pid").groupBy("tree", "leaf").applyInPandas(tree, "u long, v long, w double")
    return made.groupBy("u", "v").agg(F.min("w").alias("w"))


@dataclass
class Graph:
    """Components (c, size, born: the weight at which a large one formed), edges between them (a, b, m: w, u, v), and points (pid, weight, c, w: where it joined a large one)."""

    comps: DataFrame
    edges: DataFrame
    points: DataFrame


def _linked(edges: DataFrame) -> DataFrame:
    """One edge, the least, for each pair of components."""
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "m").groupBy("a", "b").agg(F.min("m").alias("m"))


def contracted(g: Graph, least: int) -> Graph | None:
    """g after one round of merges of small components, or None if none has a neighbour."""
    small = g.comps.where("born is null").select("c")
    both = g.edges.select(F.col("a").alias("c"), F.col("b").alias("to"), "m").unionByName(g.edges.select(F.col("b").alias("c"), F.col("a").alias("to"), "m"))
    first = checkpointed(both.join(small, "c", "left_semi").groupBy("c").agg(F.min(F.struct("m", "to")).alias("f")).select("c", "f.to", "f.m"), "density-nearest")
    if first.isEmpty():
        return None
    back = first.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
    # of a mutual pair both name the same edge, as it is the least of either
    pointed = first.join(back, ["c", "to"], "left").withColumn("root", F.when(F.col("mutual"), F.least("c", "to")).otherwise(F.col("to")))
    state = checkpointed(pointed.select("c", "to", "m", "root", F.coalesce("mutual", F.lit(False)).alias("mutual")), "density-pointers")
    merged = state.where("mutual").select("c", "root", F.col("m.w").alias("w"))
    # the others follow their pointers to a large component or to a pair; those of a pair wait
    chase = state.where("not mutual").select("c", "root", F.col("m.w").alias("w"))
    while True:
        on = chase.select(F.col("c").alias("root"), F.col("root").alias("further"))
        step = checkpointed(chase.join(on, "root", "left").select("c", F.coalesce("further", "root").alias("root"), "w", F.col("further").isNotNull().alias("moved")), "density-chase")
        chase = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    large = g.comps.where("born is not null").select(F.col("c").alias("root"))
    fallen = chase.join(large, "root", "left_semi").withColumn("fell", F.lit(True))
    moves = checkpointed(fallen.unionByName(merged.withColumn("fell", F.lit(False))), "density-moves")
    sizes = g.comps.join(moves, "c", "left").groupBy(F.coalesce("root", "c").alias("c")).agg(F.sum("size").alias("size"), F.max("born").alias("born"), F.max(F.when(~F.col("fell"), F.col("w"))).alias("w"))
    comps = checkpointed(sizes.select("c", "size", F.coalesce("born", F.when((F.col("size") >= least) & F.col("w").isNotNull(), F.col("w"))).alias("born")), "density-comps")
    grown = comps.where("born is not null").select(F.col("c").alias("root"), F.lit(True).alias("large"))
    moved = moves.join(grown, "root", "left").select("c", "root", F.when(F.col("large"), F.col("w")).alias("at"))
    points = g.points.join(moved, "c", "left").select("pid", "weight", F.coalesce("root", "c").alias("c"), F.coalesce("w", "at").alias("w"))
    to = moves.select("c", "root")
    edges = g.edges.join(to.withColumnsRenamed({"c": "a", "root": "ra"}), "a", "left").join(to.withColumnsRenamed({"c": "b", "root": "rb"}), "b", "left")
    edges = _linked(edges.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "m"))
    return Graph(comps, checkpointed(edges, "density-edges"), checkpointed(points, "density-placed"))


@dataclass
class Tree:
    """Condensed tree: parent and forming weight of each node, and the node and weight at which each component joined."""

    parent: list[int] = field(default_factory=list)
    form: list[float] = field(default_factory=list)
    joined: dict[int, tuple[int, float]] = field(default_factory=dict)

    def node(self, weight: float, *children: int) -> int:
        self.parent.append(-1)
        self.form.append(weight)
        for c in children:
            self.parent[c] = len(self.form) - 1
        return len(self.form) - 1


def condensed(comps: list[tuple], edges: list[tuple], least: int) -> Tree:
    """The condensed tree over components (c, size, born) and edges (w, u, v, a, b); trees that nothing links become children of one root at infinite distance."""
    tree, head = Tree(), {c: c for c, _, _ in comps}
    size, node, small = {}, {}, {}
    for c, n, born in comps:
        size[c], node[c], small[c] = n, None, [c]
        if born is not None:
            node[c], small[c] = tree.node(born), []
            tree.joined[c] = (node[c], born)

    def find(c: int) -> int:
        while head[c] != c:
            head[c] = c = head[head[c]]
        return c

    for w, _, _, a, b in sorted(edges):
        x, y = find(a), find(b)
        if x == y:
            continue
        if len(small[x]) < len(small[y]):
            x, y = y, x
        head[y] = x
        size[x] += size.pop(y)
        small[x] += small.pop(y)
        p, q = node[x], node.pop(y)
        if p is not None and q is not None:
            node[x] = tree.node(w, p, q)
        elif p is not None or q is not None or size[x] >= least:
            node[x] = p if p is not None else q if q is not None else tree.node(w)
            for c in small[x]:
                tree.joined[c] = (node[x], w)
            small[x] = []
    roots = [i for i, p in enumerate(tree.parent) if p < 0]
    if len(roots) > 1:
        tree.node(np.inf, *roots)
    return tree


def excess_of_mass(tree: Tree, mass: dict[int, tuple[int, float]]) -> list[int]:
    """For each node the selected cluster that it is in, or NOISE; mass is (points, sum of 1 / weight) of those that join at a node."""
    n = len(tree.form)
    inverse = lambda w: 0.0 if np.isinf(w) else 1.0 / max(w, NEAREST)
    size, stability, below = np.zeros(n), np.zeros(n), np.zeros(n)
    children: list[list[int]] = [[] for _ in range(n)]
    chosen = np.zeros(n, dtype=bool)
    for i in range(n):  # children come before their parents
        birth = inverse(tree.form[tree.parent[i]]) if tree.parent[i] >= 0 else 0.0
        own, total = mass.get(i, (0, 0.0))
        held = sum(size[c] for c in children[i])
        size[i] = own + held
        stability[i] = total - own * birth + held * (inverse(tree.form[i]) - birth)
        below[i] = sum(max(stability[c], below[c]) if children[c] else stability[c] for c in children[i])
        chosen[i] = tree.parent[i] >= 0 and stability[i] >= below[i]
        if tree.parent[i] >= 0:
            children[tree.parent[i]].append(i)
    found = [NOISE] * n
    for i in range(n - 1, -1, -1):
        above = found[tree.parent[i]] if tree.parent[i] >= 0 else NOISE
        found[i] = above if above != NOISE else i if chosen[i] else NOISE
    return found


def climbed(points: DataFrame, tree: Tree) -> DataFrame:
    """points (pid, weight, node, w) with node moved up to the cluster that held the point at weight w; a point that joins where clusters merge is of the one that it joined."""
    parent, form = np.array(tree.parent, dtype=np.int64), np.array(tree.form)
    # ancestors at distances 1, 2, 4, ...; a root is its own
    up = [np.where(parent < 0, np.arange(len(parent)), parent)]
    for _ in range(max(1, len(parent)).bit_length()):
        up.append(up[-1][up[-1]])
    shared = points.sparkSession.sparkContext.broadcast((up, form))

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, form = shared.value
        for batch in batches:
            node, w = batch.column("node").to_numpy().copy(), batch.column("w").to_numpy()
            for step in reversed(up):
                node = np.where(form[step[node]] < w, step[node], node)
            yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("weight"), pa.array(node), batch.column("w")], names=["pid", "weight", "node", "w"])

    return points.select("pid", "weight", "node", "w").mapInArrow(climb, "pid long, weight long, node long, w double")


def hdbscan(vectors: DataFrame, params: Density = Density(), key: str = "sample_id", driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """key and cluster of every vector: 0 for the largest cluster, and so on (equal sizes by least key); NOISE for outliers.

    vectors holds key and embedding (arrays of one length).  Euclidean distance.  With at
    most params.leaf distinct vectors the result is exact; beyond that neighbours that no
    tree has in one leaf are missed, so core distances may be too large, and parts that no
    leaf joins are clusters of their own.  Null vectors are noise; equal vectors have one
    label; a repeated key has as many rows as it has vectors; fewer vectors than
    min_cluster_size, or none, are all noise.  The whole set is no cluster.  Cost: trees *
    n * leaf distances, then joins over trees * n edges that shrink by round.
    """
    least = params.min_cluster_size
    points, members = points_of(vectors, key)
    leafed = checkpointed(leaves(points, params), "density-leaves")
    cores = checkpointed(core_distances(leafed, params), "density-cores")
    linked = leaf_edges(leafed, cores).select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("m"))
    # copies of one vector merge at its core distance
    placed = points.select("pid", "weight").join(cores, "pid").select("pid", "weight", F.col("pid").alias("c"), F.when(F.col("weight") >= least, F.col("core")).alias("w"))
    placed = checkpointed(placed, "density-placed")
    g = Graph(checkpointed(placed.select("c", F.col("weight").alias("size"), F.col("w").alias("born")), "density-comps"), checkpointed(linked, "density-edges"), placed)
    while g.edges.count() > driver_edges and (further := contracted(g, least)) is not None:
        g = further
    touched = g.edges.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(g.comps, "c").unionByName(g.comps.where("born is not null")).distinct()
    if (left := touched.count()) > DRIVER_CLUSTERS:
        raise ValueError(f"{left} clusters of {least} points are too many for one tree: take a larger min_cluster_size")
    edges = [tuple(r) for r in g.edges.select("m.w", "m.u", "m.v", "a", "b").toPandas().itertuples(index=False)]
    comps = [(int(c), int(n), None if np.isnan(b) else float(b)) for c, n, b in touched.select("c", "size", F.coalesce("born", F.lit(float("nan"))).alias("born")).toPandas().itertuples(index=False)]
    tree = condensed(comps, edges, least)
    if not tree.form:
        return vectors.select(key, F.lit(NOISE).alias("cluster"))
    spark = vectors.sparkSession
    joined = spark.createDataFrame(pd.DataFrame([(c, n, w) for c, (n, w) in tree.joined.items()], columns=["c", "node", "at"]).astype({"c": "int64", "node": "int64"}))
    at = g.points.join(joined, "c").select("pid", "weight", "node", F.coalesce("w", "at").alias("w"))
    nodes = checkpointed(climbed(at, tree), "density-nodes")
    sums = nodes.groupBy("node").agg(F.sum("weight"), F.sum(F.col("weight") / F.greatest("w", F.lit(NEAREST)))).collect()
    chosen = excess_of_mass(tree, {r[0]: (r[1], r[2]) for r in sums})
    names = spark.createDataFrame(pd.DataFrame({"node": range(len(chosen)), "chosen": chosen}).astype("int64")).where(f"chosen != {NOISE}")
    labelled = checkpointed(members.join(nodes.select("pid", "node").join(names, "node"), "pid").select(key, "pid", "chosen"), "density-labelled")
    order = labelled.groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).orderBy(F.desc("n"), "first").select("chosen").toPandas()
    order["cluster"] = range(len(order))
    numbers = spark.createDataFrame(order.astype("int64")) if len(order) else spark.createDataFrame([], "chosen long, cluster long")
    rows = members.join(labelled.select("pid", "chosen").distinct().join(numbers, "chosen"), "pid", "left").select(key, F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"))
    return rows.unionByName(vectors.where("embedding is null").select(key, F.lit(NOISE).alias("cluster")))

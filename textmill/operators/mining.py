"""Scoring of pools with an injected model, mining of confident errors, and their clusters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.audits import require_disjoint
from textmill.operators.density import NOISE, matrix
from textmill.operators.tables import checkpointed

DIMENSIONS, GRAM = 256, 4
# What a trustworthy set of clusters has, and embedders that see surface forms alone.
MIN_SILHOUETTE, MAX_SHARE = 0.4, 0.5
SURFACE_EMBEDDERS = ("hashing_v1",)

#: A factory that a worker calls once; what it returns scores a list of texts.
Scorer = Callable[[], Callable[[list[str]], list[float]]]


def scored(docs: DataFrame, scorer: Scorer, batch: int = 64) -> DataFrame:
    """docs with s, the score of the text; blank and null texts have 0.  The model is made once in each task."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer()
        for part in parts:
            out = np.zeros(len(part))
            real = [k for k, t in enumerate(part) if t is not None and t.strip()]
            for begin in range(0, len(real), batch):
                at = real[begin : begin + batch]
                out[at] = model([part.iloc[k] for k in at])
            yield pd.Series(out)

    return docs.withColumn("s", score("text"))


def false_positives(pool: DataFrame, threshold: float, min_confidence: float = 0.9, ledger: DataFrame | None = None, training_groups: DataFrame | None = None) -> DataFrame:
    """Human documents of a scored pool at or above threshold and confidence, that no earlier round has mined."""
    if training_groups is not None:
        require_disjoint(pool, training_groups)
    found = pool.where((F.col("s") >= threshold) & (F.col("s") >= min_confidence))
    if ledger is not None:
        found = found.join(ledger.select(F.col("sample_id").alias("doc_id")), "doc_id", "left_anti")
    return found.select(F.col("doc_id").alias("sample_id"), F.lit("false_positive").alias("failure_type"), F.col("s").alias("confidence"), "text", "domain", "source", "register")


def false_negatives(pool: DataFrame, threshold: float, max_confidence: float = 0.1) -> DataFrame:
    """Generated documents under the threshold and at or under max_confidence."""
    found = pool.where((F.col("s") < threshold) & (F.col("s") <= max_confidence))
    return found.select(F.col("doc_id").alias("sample_id"), F.lit("false_negative").alias("failure_type"), (1 - F.col("s")).alias("confidence"), "text", "domain", "source", "register")


def scan_counts(pool: DataFrame, threshold: float) -> DataFrame:
    over = F.count(F.when(F.col("s") >= threshold, 1))
    return pool.agg(F.count(F.lit(1)).alias("scanned"), over.alias("over"), (over / F.count(F.lit(1))).alias("rate"))


def append_ledger(mined: DataFrame, path: str) -> None:
    mined.select("sample_id").distinct().write.mode("append").parquet(path)


def embed(docs: DataFrame, key: str = "sample_id", dimensions: int = DIMENSIONS) -> DataFrame:
    """key and embedding: signed hashes of character 4-grams, at length 1 (all zeros for none); each distinct gram of a batch is hashed once."""

    def place(gram: str) -> int:
        h = int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        return 2 * (h % dimensions) + ((h >> 32) & 1)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            known: dict[str, int] = {}
            out = []
            for text in part["text"]:
                t = (text or "").lower()
                grams = [t[k : k + GRAM] for k in range(len(t) - GRAM + 1)]
                for g in set(grams) - known.keys():
                    known[g] = place(g)
                counts = np.bincount([known[g] for g in grams], minlength=2 * dimensions).reshape(dimensions, 2) if grams else np.zeros((dimensions, 2))
                v = (counts[:, 1] - counts[:, 0]).astype(np.float64)
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            yield pd.DataFrame({"key": part["key"], "embedding": out})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInPandas(rows, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)


@dataclass(frozen=True)
class Clusters:
    """labels: key and cluster; centres; whether the rounds came to rest, their number, and the sum of squared distances in the last one."""

    labels: DataFrame
    centres: np.ndarray
    converged: bool
    rounds: int
    cost: float


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T), 0.0)


def _with_centres(vectors: DataFrame, centres: np.ndarray, each: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], ddl: str) -> DataFrame:
    """each(batch, squared distances to the centres); centres go to the tasks as a broadcast of k vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch, _squares(matrix(batch.column("embedding")), shared.value))

    return vectors.mapInArrow(rows, ddl)


def _seeded(vectors: DataFrame, k: int, key: str, seed: int, passes: int = 5) -> np.ndarray:
    """k first centres, drawn far from each other: in each of a few passes about 2 k vectors are drawn in proportion to their squared distance from those drawn before; of these, weighted by the vectors nearest to them, k are drawn one by one."""
    kind = vectors.schema[key].dataType.simpleString()
    drawn = matrix(vectors.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(1).select("embedding").toArrow().column(0))
    for turn in range(passes):
        least = lambda batch, d: pa.RecordBatch.from_arrays([batch.column("key"), batch.column("embedding"), pa.array(d.min(axis=1))], names=["key", "embedding", "d"])
        far = _with_centres(vectors.select(F.col(key).alias("key"), "embedding"), drawn, least, f"key {kind}, embedding array<double>, d double")
        total = far.agg(F.sum("d")).first()[0]
        if not total:
            break
        # a uniform number for each key and pass: the same in whatever order rows are read
        u = F.pmod(F.xxhash64("key", F.lit(seed + 1 + turn)), F.lit(1 << 53)) / float(1 << 53)
        more = matrix(far.where(u < F.lit(2.0 * k / total) * F.col("d")).orderBy("key").select("embedding").toArrow().column(0))
        if len(more):
            drawn = np.concatenate([drawn, more])
    drawn = np.unique(drawn, axis=0)
    near = lambda batch, d: pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1).astype(np.int32))], names=["c"])
    weight = np.zeros(len(drawn))
    for c, n in _with_centres(vectors.select("embedding"), drawn, near, "c int").groupBy("c").count().collect():
        weight[c] = n
    rng, at = np.random.default_rng(seed), [int(weight.argmax())]
    d = _squares(drawn, drawn[at])[:, 0]
    while len(at) < min(k, len(drawn)):
        p = weight * d
        at.append(int(rng.choice(len(drawn), p=p / p.sum())) if p.sum() > 0 else next(j for j in range(len(drawn)) if j not in at))
        d = np.minimum(d, _squares(drawn, drawn[at[-1:]])[:, 0])
    return drawn[at]


def kmeans(vectors: DataFrame, k: int, rounds: int = 100, key: str = "sample_id", seed: int = 42) -> Clusters:
    """Clusters 0 to k - 1 (fewer if there are fewer distinct vectors) by Lloyd's rounds over all vectors.

    Each task sums its vectors by cluster, and these partial sums are added by Spark; the
    driver holds k centres.  A cluster that no vector is nearest to keeps its centre.  Rows
    without a vector have no label; of equal distances the lower cluster counts; no
    vectors give no labels.  Converged: no centre moved in the last round.
    """
    real = checkpointed(vectors.where("embedding is not null").select(key, F.col("embedding").cast("array<double>").alias("embedding")), "kmeans-vectors")
    kind = real.schema[key].dataType.simpleString()
    if k < 1 or rounds < 1:
        raise ValueError("k and rounds are 1 or more")
    if real.isEmpty():
        return Clusters(real.select(key, F.lit(0).alias("cluster")), np.zeros((0, 0)), True, 0, 0.0)
    centres = _seeded(real, k, key, seed)

    def partial(shared):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = shared.value
            total, count, cost = np.zeros(at.shape), np.zeros(len(at), dtype=np.int64), np.zeros(len(at))
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("embedding"))
                    d = _squares(x, at)
                    near = d.argmin(axis=1)
                    np.add.at(total, near, x)
                    count += np.bincount(near, minlength=len(at))
                    cost += np.bincount(near, weights=d[np.arange(len(x)), near], minlength=len(at))
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(cost[held]), pa.array(total[held].tolist(), pa.list_(pa.float64()))], names=["c", "n", "cost", "x"])

        return sums

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": part["c"].iloc[:1], "n": [part["n"].sum()], "cost": [part["cost"].sum()], "x": [np.sum(np.stack(part["x"]), axis=0)]})

    done, turn, cost = False, 0, 0.0
    while not done and turn < rounds:
        shared, turn = real.sparkSession.sparkContext.broadcast(centres), turn + 1
        found = real.select("embedding").mapInArrow(partial(shared), "c long, n long, cost double, x array<double>").groupBy("c").applyInPandas(added, "c long, n long, cost double, x array<double>").collect()
        after = centres.copy()
        for r in found:
            after[r["c"]] = np.array(r["x"]) / r["n"]
        cost, done, centres = sum(r["cost"] for r in found), bool(np.abs(after - centres).max() < 1e-9), after
    named = lambda batch, d: pa.RecordBatch.from_arrays([batch.column("key"), pa.array(d.argmin(axis=1).astype(np.int32))], names=["key", "cluster"])
    labels = _with_centres(real.select(F.col(key).alias("key"), "embedding"), centres, named, f"key {kind}, cluster int")
    return Clusters(checkpointed(labels.withColumnRenamed("key", key), "kmeans"), centres, done, turn, cost)


def silhouette(labelled: DataFrame, sample: int = 2000, key: str = "sample_id", seed: int = 0) -> float:
    """Mean silhouette, by Euclidean distance, of `sample` rows (those of least hash) of labelled (key, embedding, cluster) against all rows.

    Noise (-1) and rows without vector or cluster are left out; a row that is alone in its
    cluster counts for nothing; NaN with fewer than two clusters.  Each task adds up the
    distances of its rows to the sample by cluster; the sample, of a fixed bound, is what
    tasks share.
    """
    rows = labelled.where(f"embedding is not null and cluster is not null and cluster != {NOISE}").select(key, F.col("embedding").cast("array<double>").alias("embedding"), "cluster")
    clusters = {c: k for k, c in enumerate(sorted(r[0] for r in rows.select("cluster").distinct().collect()))}
    if len(clusters) < 2:
        return float("nan")
    asked = rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select("embedding", "cluster").toArrow()
    x, own = matrix(asked.column("embedding")), np.array([clusters[c] for c in asked.column("cluster").to_pylist()])
    shared = rows.sparkSession.sparkContext.broadcast((x, clusters))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, place = shared.value
        total, count = np.zeros((len(x), len(place))), np.zeros(len(place), dtype=np.int64)
        for batch in batches:
            of = np.array([place[c] for c in batch.column("cluster").to_pylist()], dtype=np.int64)
            y = matrix(batch.column("embedding"))
            for c in np.unique(of):
                part = y[of == c]
                for k in range(0, len(part), 1024):
                    total[:, c] += np.sqrt(_squares(x, part[k : k + 1024])).sum(axis=1)
                count[c] += len(part)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(total[:, held].T.tolist(), pa.list_(pa.float64()))], names=["c", "n", "d"])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": part["c"].iloc[:1], "n": [part["n"].sum()], "d": [np.sum(np.stack(part["d"]), axis=0)]})

    total, count = np.zeros((len(x), len(clusters))), np.zeros(len(clusters))
    for r in rows.mapInArrow(sums, "c long, n long, d array<double>").groupBy("c").applyInPandas(added, "c long, n long, d array<double>").toLocalIterator():
        total[:, r["c"]], count[r["c"]] = r["d"], r["n"]
    at, others = np.arange(len(x)), count[own] > 1
    inner = total[at, own] / np.maximum(count[own] - 1, 1)
    outer = total / count
    outer[at, own] = np.inf
    nearest = outer.min(axis=1)
    widest = np.maximum(inner, nearest)
    scores = np.divide(nearest - inner, widest, out=np.zeros(len(x)), where=widest > 0)[others]
    return float(scores.mean()) if len(scores) else float("nan")


def quality_warnings(summary: DataFrame, score: float, embedder: str) -> DataFrame:
    """kind, subject and value of each reason not to trust the clusters of cluster_summary(): low_silhouette, dominant_cluster, surface_embedder, shared_label.

    An unmeasured (NaN) silhouette gives no warning.  Only the largest cluster can dominate; of equal ones that of the smaller number is told.
    """
    spark = summary.sparkSession
    flat = [("low_silhouette", None, score)] if score < MIN_SILHOUETTE else []
    flat += [("surface_embedder", embedder, None)] if embedder in SURFACE_EMBEDDERS else []
    known = spark.createDataFrame(flat, "kind string, subject string, value double")
    largest = summary.orderBy(F.desc("size"), "cluster").limit(1).where(F.col("share") > MAX_SHARE)
    dominant = largest.select(F.lit("dominant_cluster").alias("kind"), F.col("cluster").cast("string").alias("subject"), F.col("share").cast("double").alias("value"))
    shared = summary.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("shared_label").alias("kind"), F.col("label").alias("subject"), F.col("n").cast("double").alias("value"))
    return known.unionByName(dominant).unionByName(shared)


def cluster_summary(failures: DataFrame, top: int = 3, exemplars: int = 5) -> DataFrame:
    """cluster, size, share of what is no noise, mean confidence, its commonest domains, sources and registers, and exemplars."""
    real = failures.where("cluster != -1")
    total = real.agg(F.count(F.lit(1)).alias("all"))
    base = real.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("confidence").alias("mean_confidence"))
    found = base.crossJoin(F.broadcast(total)).withColumn("share", F.col("size") / F.col("all")).drop("all")
    for column in ("domain", "source", "register"):
        counts = real.groupBy("cluster", column).agg(F.count(F.lit(1)).alias("n"))
        ranked = counts.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("value")))), 1, top).alias("t"))
        found = found.join(ranked.select("cluster", F.col("t.value").alias(f"{column}s")), "cluster", "left")
    from textmill.operators.sampling import numbered

    best = numbered(real.withColumn("__turn", -F.col("confidence")), "cluster", "__turn", "place", ties=("sample_id",)).where(F.col("place") <= exemplars)
    named = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sample_id"))), lambda x: x["sample_id"]).alias("exemplars"))
    label = F.concat_ws(" / ", F.get("registers", F.lit(0)), F.get("domains", F.lit(0)), F.concat(F.lit("via "), F.get("sources", F.lit(0))))
    return found.join(named, "cluster", "left").withColumn("label", label)

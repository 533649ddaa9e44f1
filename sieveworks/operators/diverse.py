"""Diverse samples: TF-IDF of character n-grams, k-means, and the row nearest to each centre."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveworks.functions.text import strip
from sieveworks.operators.splits import order_key, sample_exact
from sieveworks.runtime import cut_lineage

_SPACES = re.compile(r"\s\s+")


def ngrams(text: str | None, sizes: Sequence[int] = (2, 3, 4)) -> Counter[str]:
    """How often each run of each size occurs in the lower-case text, runs of white space as one space; none of null."""
    t = _SPACES.sub(" ", (text or "").lower())
    return Counter(t[i : i + n] for n in sizes for i in range(len(t) - n + 1))


@dataclass(frozen=True)
class Grams:
    """The commonest n-grams of a corpus and their idf, ln((1 + n) / (1 + df)) + 1: at most as many as were asked for."""

    index: dict[str, int]
    idf: np.ndarray
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, df: DataFrame, text: str, features: int = 50_000, min_df: int = 2, max_df: float = 0.98, sizes: Sequence[int] = (2, 3, 4)) -> Grams:
        """The ``features`` most frequent of those that ``min_df`` rows have at least and a share ``max_df`` of them at most; counted in batches before anything is shuffled."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                tf: Counter[str] = Counter()
                rows: Counter[str] = Counter()
                for t in b["t"]:
                    own = ngrams(t, sizes)
                    tf.update(own)
                    rows.update(own.keys())
                yield pd.DataFrame({"gram": list(tf), "tf": list(tf.values()), "df": [rows[g] for g in tf]})

        n = df.count()
        counts = df.select(F.col(text).alias("t")).mapInPandas(run, "gram string, tf long, df long").groupBy("gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        top = counts.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n))).orderBy(F.desc("tf"), "gram").limit(features).collect()
        return cls({r["gram"]: i for i, r in enumerate(top)}, np.log((1.0 + n) / (1.0 + np.array([r["df"] for r in top], float))) + 1.0, tuple(sizes))

    def weights(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights): 1 + ln(tf), times idf, to length 1."""
        found = [(self.index[g], n) for g, n in ngrams(text, self.sizes).items() if g in self.index]
        terms = np.array([i for i, _ in found], np.int64)
        w = (1.0 + np.log([n for _, n in found])) * self.idf[terms] if found else np.empty(0)
        norm = float(np.sqrt((w * w).sum()))
        return terms, w / norm if norm else w


#: Dimensions to which the terms are projected.
DIMENSIONS = 256


def projection(terms: int, dims: int, seed: int) -> np.ndarray:
    """A random sign for each term and dimension, scaled so that lengths are kept on average."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (terms, dims)) / np.float32(dims**0.5)


def projected(df: DataFrame, key: str, text: str, grams: Grams, dims: int = DIMENSIONS, seed: int = 42) -> DataFrame:
    """(key, vector): TF-IDF rows projected to ``dims``; distances between rows are kept up to a few per cent."""
    held = df.sparkSession.sparkContext.broadcast(grams)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = projection(len(held.value.index), dims, seed)
        for b in batches:
            vectors = []
            for t in b["text"]:
                terms, w = held.value.weights(t)
                vectors.append(w.astype(np.float32) @ signs[terms])
            yield pd.DataFrame({"key": b["key"], "vector": vectors})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, vector array<float>").withColumnRenamed("key", key)


def to_vector(c: Column) -> Column:
    return array_to_vector(c.cast("array<double>"))


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Per cluster the mean of an array column, dimension by dimension."""
    return (
        df.select(cluster, F.posexplode(vector).alias("dim", "x"))
        .groupBy(cluster, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("center"))  # as many as there are dimensions
    )


def nearest_to_center(df: DataFrame, cluster: str, key: str, distance: Column) -> DataFrame:
    """One row per cluster: that with the least distance, ties by key. A minimum, not a sort of the cluster."""
    return df.groupBy(cluster).agg(F.min(F.struct(distance.alias("dist"), F.col(key))).alias("m")).select(cluster, f"m.{key}", "m.dist")


def exact_size(picked: DataFrame, pool: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` keys: those picked, in key order, cut or filled up from the pool by hash; all of the pool if it has fewer."""
    head = picked.select(key).distinct().orderBy(key).limit(size)
    rest = pool.select(key).distinct().join(head, key, "left_anti")
    missing = max(0, size - head.count())
    return head.unionByName(rest.orderBy(order_key(seed, F.col(key)), key).limit(missing))


def _squared(x: np.ndarray, norms: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c."""
    return np.maximum(norms[:, None] + np.einsum("ij,ij->i", c, c) - 2.0 * (x @ c.T), 0.0)


def spread_rows(x: np.ndarray, k: int, rng: np.random.Generator, block: int = 64) -> np.ndarray:
    """At most k rows, drawn by their squared distance to those before, a block at a time; fewer where there are fewer different rows."""
    norms = np.einsum("ij,ij->i", x, x)
    chosen = [int(rng.integers(len(x)))]
    left = _squared(x, norms, x[chosen])[:, 0]
    while len(chosen) < k:
        left[left < 1e-5] = 0.0  # equal to a chosen one, but for rounding
        left[chosen] = 0.0
        open_ = int(np.count_nonzero(left))
        if not open_:
            break
        drawn = rng.choice(len(x), min(block, k - len(chosen), open_), replace=False, p=left / left.sum(dtype=np.float64))
        chosen += drawn.tolist()
        left = np.minimum(left, _squared(x, norms, x[drawn]).min(axis=1))
    return np.array(chosen)


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of each row."""
    label, cost = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), block):
        part = x[at : at + block]
        d = _squared(part, np.einsum("ij,ij->i", part, part), centres)
        label[at : at + block] = d.argmin(axis=1)
        cost[at : at + block] = d.min(axis=1)
    return label, cost


def mini_batch_kmeans(x: np.ndarray, k: int, seed: int, epochs: int = 100, inits: int = 10, batch: int = 2048, patience: int = 10, ratio: float = 0.01) -> np.ndarray:
    """At most k centres: the best of ``inits`` starts over 3 k rows, then batches until ``epochs`` passes are over or ``patience``
    batches brought no better smoothed cost. Centres with less than ``ratio`` of what the largest has taken start anew from rows of the batch."""
    rng = np.random.default_rng(seed)
    head, judges = x[: 3 * max(k, batch)], x[: 3 * batch]
    starts = [head[spread_rows(head, k, rng)] for _ in range(inits)]
    centres = min(starts, key=lambda c: float(nearest(judges, c)[1].sum())).copy()
    taken = np.zeros(len(centres))
    smooth = least = None
    idle = since = 0
    for step in range(epochs * -(-len(x) // batch)):
        rows = x[rng.integers(len(x), size=min(batch, len(x)))]
        label, cost = nearest(rows, centres)
        order = np.argsort(label, kind="stable")
        touched, first, n = np.unique(label[order], return_index=True, return_counts=True)
        before = taken[touched].copy()
        taken[touched] += n
        sums = np.add.reduceat(rows[order], first)
        centres[touched] = centres[touched] * (before / taken[touched]).astype(np.float32)[:, None] + sums / taken[touched].astype(np.float32)[:, None]
        since += len(rows)
        if since >= 10 * len(centres):
            since = 0
            poor = np.flatnonzero(taken < ratio * taken.max())
            poor = poor[np.argsort(taken[poor], kind="stable")][: len(rows) // 2]
            if len(poor):
                centres[poor] = rows[rng.choice(len(rows), len(poor), replace=False)]
                taken[poor] = np.delete(taken, poor).min()
        if step == 0:
            continue  # the first cost is that of the start
        weight = min(1.0, 2.0 * len(rows) / (len(x) + 1))
        smooth = cost.mean() if smooth is None else smooth * (1 - weight) + cost.mean() * weight
        least, idle = (smooth, 0) if least is None or smooth < least else (least, idle + 1)
        if idle >= patience:
            break
    return centres


def nearest_rows(vectors: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    """(cluster, key, dist): the row nearest to each centre that has rows; batches send one row a cluster."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)  # k times the dimensions
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                label, cost = nearest(np.stack(b["vector"]).astype(np.float32), held.value)
                near = pd.DataFrame({"cluster": label, "key": b["key"], "dist": cost}).sort_values(["dist", "key"], kind="stable")
                yield near.drop_duplicates("cluster")

    assigned = vectors.select(F.col(key).alias("key"), "vector").mapInPandas(run, f"cluster long, key {kind}, dist double")
    return nearest_to_center(assigned, "cluster", "key", F.col("dist")).withColumnRenamed("key", key)


#: Rows to which the centres are fitted: they are held on the driver, 1 KB each.
FITTED = 100_000


def diverse_sample(
    df: DataFrame, key: str, text: str, k: int = 5000, features: int = 50_000, seed: int = 42, pool: int = 100_000, epochs: int = 100, inits: int = 10
) -> DataFrame:
    """Keys of a pool of ``df`` (0: all) with ``_sampled``: 'selected' for the row nearest to each of k centres, brought to k rows, 'remaining' for the others.

    The centres are fitted on the driver to at most FITTED rows of the pool; all rows of the pool are then compared with them where they are.
    """
    some = df.filter(F.coalesce(strip(F.col(text)), F.lit("")) != "").select(key, text)
    rows = cut_lineage(reservoir(some, [key], pool).repartition(64, key))
    if rows.count() <= k:  # each is a centre
        return rows.select(key, F.lit("selected").alias("_sampled"))
    vectors = cut_lineage(projected(rows, key, text, Grams.of(rows, text, features), seed=seed))
    fitted = reservoir(vectors, [key], FITTED).orderBy(order_key(seed, F.col(key)), key).select("vector").toPandas()
    centres = mini_batch_kmeans(np.stack(fitted["vector"]).astype(np.float32), k, seed, epochs, inits)
    chosen = exact_size(nearest_rows(vectors, key, centres), vectors, key, k, seed).withColumn("_sampled", F.lit("selected"))
    return vectors.select(key).join(chosen, key, "left").withColumn("_sampled", F.coalesce("_sampled", F.lit("remaining")))


def reservoir(df: DataFrame, key: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of the same chance each, by hash; all rows for 0 or less."""
    return df if size <= 0 else sample_exact(df, key, size, seed)


def rank_in_cluster(df: DataFrame, cluster: str, key: str, k: int) -> DataFrame:
    """The k nearest rows of each cluster; expects ``dist``."""
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy("dist", key))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)

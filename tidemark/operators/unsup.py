"""Null-pattern groups, group-wise PCA, k-means features and their stability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.encode import impute, medians, population_scales, standardise


def null_mask_groups(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """column, group: columns with the same null rows share a group; groups are numbered by their first column.

    One pass: per column the number of null rows and the xor of their hashed ids.
    """
    mark = lambda c: F.when(F.col(c).isNull(), F.xxhash64(row_id))
    one = df.agg(*(F.struct(F.count_if(F.col(c).isNull()).alias("n"), F.coalesce(F.bit_xor(mark(c)), F.lit(0).cast("long")).alias("x")).alias(c) for c in columns))
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(c).alias("mask")) for i, c in enumerate(columns)))))
    first = rows.groupBy("mask").agg(F.min("place").alias("first"))
    numbered = first.withColumn("group", F.row_number().over(Window.orderBy("first")) - 1)  # as many rows as columns
    return rows.join(numbered, "mask").select("column", "group")


def cluster_alignment(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """n, rate and lift over the overall rate by cluster, highest first."""
    overall = df.agg(F.avg(F.col(label).cast("double")).alias("overall"))
    by = df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    return by.join(F.broadcast(overall)).select(cluster, "n", "rate", (F.col("rate") / F.nullif("overall", F.lit(0.0))).alias("lift")).orderBy(F.desc("rate"))


def adjusted_rand(df: DataFrame, one: str, two: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency counts."""
    pairs = lambda n: n * (n - 1) / 2
    both = df.groupBy(one, two).agg(F.count("*").cast("double").alias("n"))
    a = both.groupBy(one).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    b = both.groupBy(two).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    ab = both.agg(F.sum(pairs(F.col("n"))).alias("sab"), F.sum("n").alias("total"))
    chance = F.col("sa") * F.col("sb") / F.nullif(pairs(F.col("total")), F.lit(0.0))
    return ab.join(a).join(b).select(((F.col("sab") - chance) / F.nullif((F.col("sa") + F.col("sb")) / 2 - chance, F.lit(0.0))).alias("ari"))  # one row each


class GroupCompressor:
    """Median imputation, population scaling and PCA of each column group, then k-means on all components."""

    def __init__(self, groups: dict[int, list[str]], target: float = 0.95, cap: int = 12, k: int = 6, starts: int = 10, seed: int = 42):
        self.groups, self.target, self.cap, self.k, self.starts, self.seed = groups, target, cap, k, starts, seed
        self.fitted = False

    def fit_scales(self, train: DataFrame) -> GroupCompressor:
        """Medians (0 for a column without values) and population deviations (1 for a constant column)."""
        columns = [c for g in self.groups.values() for c in g]
        self.medians = medians(train, columns)
        self.scales = population_scales(impute(train, self.medians), columns)
        return self

    def prepared(self, df: DataFrame) -> DataFrame:
        return standardise(impute(df, self.medians), self.scales)

    def fit(self, train: DataFrame) -> GroupCompressor:
        ready = self.fit_scales(train).prepared(train).cache()
        self.pca, self.names = {}, []
        for g, held in self.groups.items():
            vectors = ready.select(array_to_vector(F.array(*(F.col(c).cast("double") for c in held))).alias("v"))
            full = PCA(k=min(len(held), self.cap), inputCol="v", outputCol="p").fit(vectors)
            reached = np.cumsum(full.explainedVariance.toArray())
            k = int(min(np.searchsorted(reached, self.target) + 1, len(reached)))
            self.pca[g] = full.pc.toArray()[:, :k]
            self.names += [f"vpca_g{g:02d}_{j}" for j in range(k)]
        scored = self._components(ready).select(array_to_vector(F.array(*self.names)).alias("features")).cache()
        models = [KMeans(k=self.k, seed=self.seed + s, maxIter=50).fit(scored) for s in range(self.starts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        self.centers = np.array(best.clusterCenters())
        scored.unpersist()
        ready.unpersist()
        self.fitted = True
        return self

    def _components(self, prepared: DataFrame) -> DataFrame:
        """Adds each component as a sum of products, inside generated code."""
        out = {}
        for g, held in self.groups.items():
            for j, weights in enumerate(self.pca[g].T):
                terms = F.array(*(F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(held, weights)))
                out[f"vpca_g{g:02d}_{j}"] = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
        return prepared.withColumns(out)

    def transform(self, df: DataFrame, row_id: str) -> DataFrame:
        """row_id, components, v_cluster, v_cluster_dist and v_cluster_margin."""
        if not self.fitted:
            raise RuntimeError("fit before transform")
        parts = self._components(self.prepared(df)).select(row_id, *self.names)
        return with_nearest(parts, self.names, self.centers)


def with_nearest(df: DataFrame, columns: list[str], centers: np.ndarray) -> DataFrame:
    """Adds the nearest center, the Euclidean distance to it and the margin to the second nearest."""
    point = F.array(*(F.col(c).cast("double") for c in columns))
    distance = lambda center: F.sqrt(F.aggregate(F.zip_with(point, F.array(*(F.lit(float(x)) for x in center)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    held = df.withColumn("__d", F.array(*(distance(c) for c in centers)))
    ordered = F.array_sort("__d")
    cluster = (F.array_position("__d", F.array_min("__d")) - 1).cast("int")
    margin = ordered[1] - ordered[0] if len(centers) > 1 else F.lit(0.0)
    return held.withColumns({"v_cluster": cluster, "v_cluster_dist": ordered[0], "v_cluster_margin": margin}).drop("__d")


def stability_sweep(df: DataFrame, vector: str, ks: tuple[int, ...] = (4, 6, 8, 10, 12, 16), seeds: int = 5, starts: int = 10, sample: int = 60_000, silhouette_rows: int = 15_000) -> DataFrame:
    """Per k: mean and least adjusted Rand index over pairs of seeds, exact silhouette and inertia of the first seed.

    The sample of ``sample`` rows is part of the method and goes to every task once; a task fits one k and seed, the
    best of ``starts`` starts. Labels of the sample come back, one byte each; k is at most 256.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(sample)
    points = np.array([r[0] for r in rows.collect()])  # ``sample`` rows at most
    held = spark.sparkContext.broadcast(points)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, seed in zip(batch.column("k").to_pylist(), batch.column("seed").to_pylist()):
                x = held.value
                labels, inertia = kmeans(x, k, seed, starts)
                silhouette = _silhouette(x[:silhouette_rows], labels[:silhouette_rows]) if seed == 0 else None
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seed], pa.int32()), pa.array([inertia]), pa.array([silhouette], pa.float64()), pa.array([labels.astype(np.uint8).tobytes()])], ["k", "seed", "inertia", "silhouette", "labels"])

    grid = spark.createDataFrame([(k, s) for k in ks for s in range(seeds)], "k int, seed int").repartition(len(ks) * seeds)
    found = {(r["k"], r["seed"]): r for r in grid.mapInArrow(fit, "k int, seed int, inertia double, silhouette double, labels binary").collect()}
    out = []
    for k in ks:
        named = [np.frombuffer(found[k, s]["labels"], np.uint8) for s in range(seeds)]
        ari = [_ari(named[i], named[j]) for i in range(seeds) for j in range(i)] or [1.0]
        out.append((k, float(np.mean(ari)), float(np.min(ari)), found[k, 0]["silhouette"], found[k, 0]["inertia"]))
    return spark.createDataFrame(out, "k int, ari_mean double, ari_min double, silhouette double, inertia double")


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of several k-means runs, each from centers drawn by their squared distance."""
    best: tuple[np.ndarray, float] = (np.zeros(len(x), int), 0.0 if not len(x) else np.inf)
    k, squares = min(k, len(x)), (x**2).sum(1) if len(x) else None
    for start in range(starts if k else 0):
        rng = np.random.default_rng([seed, start])
        centers = x[rng.integers(len(x), size=1)]
        far = ((x - centers[0]) ** 2).sum(1)
        while len(centers) < k:
            at = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))
            centers = np.concatenate([centers, x[at : at + 1]])
            far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
        labels = None
        for _ in range(rounds):
            distance = squares[:, None] - 2 * x @ centers.T + (centers**2).sum(1)
            new = distance.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            size = np.bincount(labels, minlength=k)
            sums = np.zeros_like(centers)
            np.add.at(sums, labels, x)
            centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centers)
        inertia = float(np.maximum(distance[np.arange(len(x)), labels], 0).sum())
        if inertia < best[1]:
            best = (labels, inertia)
    return best


def _ari(a: np.ndarray, b: np.ndarray) -> float:
    table = pd.crosstab(a, b).to_numpy().astype(float)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    sa, sb, sab, n = pairs(table.sum(1)), pairs(table.sum(0)), pairs(table), len(a)
    chance = sa * sb / (n * (n - 1) / 2)
    return float((sab - chance) / ((sa + sb) / 2 - chance)) if (sa + sb) / 2 != chance else 1.0


def _silhouette(points: np.ndarray, named: np.ndarray, step: int = 500) -> float:
    """Mean silhouette with Euclidean distances, in blocks of rows."""
    clusters = np.unique(named)
    if len(clusters) < 2:
        return 0.0
    one_hot = (named[:, None] == clusters).astype(float)
    size, out = one_hot.sum(0), []
    for i in range(0, len(points), step):
        block = points[i : i + step]
        d = np.sqrt(np.maximum((block**2).sum(1)[:, None] - 2 * block @ points.T + (points**2).sum(1), 0))
        sums = d @ one_hot
        own = np.searchsorted(clusters, named[i : i + step])
        rows = np.arange(len(block))
        a = sums[rows, own] / np.maximum(size[own] - 1, 1)
        other = sums / size
        other[rows, own] = np.inf
        b = other.min(1)
        out.append(np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0))
    return float(np.concatenate(out).mean())


def pca_profile(df: DataFrame, columns: list[str], fill: float = -1.0, cap: int = 40) -> DataFrame:
    """Exploratory PCA of a group on the whole frame: first component's share, components for 95 %, correlations."""
    from pyspark.ml.stat import Correlation

    filled = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c) for c in columns))
    row = filled.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    scaled = filled.select(array_to_vector(F.array(*((F.col(c) - row[f"m_{c}"]) / (row[f"s_{c}"] + 1e-9) for c in columns))).alias("v"))
    share = PCA(k=min(len(columns), cap), inputCol="v", outputCol="p").fit(scaled).explainedVariance.toArray()
    corr = np.abs(np.nan_to_num(Correlation.corr(scaled, "v").head()[0].toArray()))
    upper = corr[np.triu_indices(len(columns), 1)]
    n95 = int(min(np.searchsorted(np.cumsum(share), 0.95) + 1, len(share)))
    values = (len(columns), float(share[0]), n95, float(upper.mean()) if len(upper) else 0.0, float((upper > 0.9).mean()) if len(upper) else 0.0)
    return df.sparkSession.createDataFrame([values], "n_columns int, pc1_share double, n_pc95 int, mean_abs_corr double, share_above_09 double")

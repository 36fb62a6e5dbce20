"""Gradient-boosted trees on binned columns, stopped early on average precision.

Training rows are binned once, packed into blocks and kept with their margins; each level of a tree is one pass that
sums gradients by node and bin, a column in one task. The driver gets the best cut of each node and column only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite
from tidemark.models.base import CHUNKS, RankingModel, chunks, summed
from tidemark.operators import ordering

BINS = 32  # cuts of a column: its least value and exact quantiles of training rows
WIDTH = BINS + 2  # numbers of bins: 0 for a missing value, then values up to each cut, then those above
BLOCK_ROWS = 1 << 16
PART_BYTES = 64_000_000  # binned rows of a task
REPLAY = 10  # trees after which margins are added up anew from the blocks, so that lineage stays short
GRID = 2.0**20  # gradients are whole multiples of 1 / GRID: their sums are exact in any order
CELLS = 512  # of the margins of one number of trees, to cut validation rows into ranges of RANGE_ROWS or one cell
RANGE_ROWS = 1_000_000


class Tree:
    """A complete binary tree: a row goes right in a node if its bin of ``feature`` is above ``cut``."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature, self.cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.uint8)
        self.value = np.zeros(2**depth)

    def node(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Number of each row's node within the level."""
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for k in range(level):
            own = at + (2**k - 1)
            at = 2 * at + (bins[self.feature[own], rows] > self.cut[own])
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node(bins, self.depth)]


def _values(column: pa.Array, width: int) -> np.ndarray:
    """A row for each feature; NaN where a value is missing."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width).T


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for row, values, cuts in zip(out, x, edges):
        row[:] = np.where(np.isnan(values), 0, 1 + np.searchsorted(cuts, values))
    return out


def _block(item: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, bins, y, margin = item
    y = np.frombuffer(y, np.uint8)
    return np.frombuffer(bins, np.uint8).reshape(-1, len(y)), y, np.frombuffer(margin)


def _added(trees: list[Tree]):
    def add(item: tuple) -> tuple:
        bins, _, margin = _block(item)
        for tree in trees:
            margin = margin + tree.margins(bins)
        return (*item[:3], margin.tobytes())

    return add


def _best(sums: np.ndarray, l2: float, least: int) -> np.ndarray:
    """For each node of (n, g, h) by node and bin: gain, cut, and g and h of all rows and of those on the left."""
    n, g, h = sums.reshape(3, -1, WIDTH)
    left = [x.cumsum(axis=1)[:, :-1] for x in (n, g, h)]
    total = [x.sum(axis=1) for x in (n, g, h)]
    right = [t[:, None] - x for t, x in zip(total, left)]
    score = lambda a, b: a * a / (b + l2 + 1e-12)
    gain = score(left[1], left[2]) + score(right[1], right[2]) - score(total[1], total[2])[:, None]
    gain = np.where((left[0] >= least) & (right[0] >= least), gain, -np.inf)
    cut = gain.argmax(axis=1)
    at = np.arange(len(cut)), cut
    return np.array([gain[at], cut, total[1], total[2], left[1][at], left[2][at]])


class GbmModel(RankingModel):
    """Level-wise trees stand for leaf-wise ones; missing values are a bin below all others."""

    name = "gbm"

    def __init__(self, trees: int = 100, depth: int = 6, rate: float = 0.05, min_rows: int = 100, row_share: float = 0.8, column_share: float = 0.6, patience: int = 100, seed: int = 42, l2: float = 10.0):
        self.n_trees, self.depth, self.rate, self.min_rows, self.row_share, self.column_share, self.patience, self.seed, self.l2 = trees, depth, rate, min_rows, row_share, column_share, patience, seed, l2

    def _prepared(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__features", F.array(*(finite(F.col(c).cast("double")) for c in self.features)).cast("array<double>"))

    def fit(self, train, features, label, valid=None):
        self.features = list(features)
        ready = self._prepared(train).select("__features", F.col(label).cast("int").alias("__y")).persist()
        counts = ready.agg(F.count_if(F.col("__y") == 1).alias("p"), F.count_if(F.col("__y") == 0).alias("n")).first()
        weight = counts["n"] / max(counts["p"], 1)
        names = [f"f{i}" for i in range(len(self.features))]
        wide = ready.select(*(F.col("__features")[i].alias(c) for i, c in enumerate(names)))
        found = ordering.quantiles(wide, {c: F.col(c) for c in names}, [i / BINS for i in range(BINS)])
        self.edges = [np.unique(np.array(found[c] or [], float)) for c in names]
        self.gains = np.zeros(len(self.features))
        blocks = self._blocks(ready, counts["n"] + counts["p"])
        self._grow(blocks, weight)
        blocks.unpersist()
        ready.unpersist()
        self.kept, self.history = len(self.trees), []
        if valid is not None:
            self._stop_early(valid, label)
        return self

    def _blocks(self, ready: DataFrame, rows: int):
        """Blocks of rows with a label as (key, bins, labels, margins), dealt to tasks evenly."""
        edges, width = self.edges, len(self.features)
        context = ready.sparkSession.sparkContext
        parts = max(min(context.defaultParallelism, math.ceil(rows / 4096)), math.ceil(rows * (width + 9) / PART_BYTES), 1)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(k, BLOCK_ROWS)
                    bins, y = _binned(_values(part.column("__features"), width), edges), part.column("__y").to_numpy().astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["bins", "y"])

        def keyed(part: int, rows: Iterator) -> Iterator[tuple]:
            for k, r in enumerate(rows):
                yield (part, k), (bytes(r["bins"]), bytes(r["y"]))

        def begun(items: Iterator[tuple]) -> Iterator[tuple]:
            for key, (bins, y) in sorted(items):
                yield key, bins, y, bytes(8 * len(y))

        made = ready.where("__y in (0, 1)").mapInArrow(packed, "bins binary, y binary").rdd.mapPartitionsWithIndex(keyed)
        return made.partitionBy(parts, lambda key: key[0] * 7919 + key[1]).mapPartitions(begun).persist(StorageLevel.MEMORY_AND_DISK)

    def _grow(self, blocks, weight: float) -> None:
        """Tree after tree on margins that the first pass of each stores."""
        self.trees: list[Tree] = []
        chosen, n = np.random.default_rng(self.seed), len(self.features)
        state = before = blocks
        for t in range(self.n_trees):
            used = np.sort(chosen.permutation(n)[: max(1, math.ceil(self.column_share * n))])
            self.trees.append(self._tree(state, t, used, weight))
            if before is not blocks:
                before.unpersist()
            before = state
            base, new = (blocks, self.trees[:]) if (t + 1) % REPLAY == 0 else (state, self.trees[-1:])
            state = base.map(_added(new)).persist(StorageLevel.MEMORY_AND_DISK)
        for held in (before, state):
            held.unpersist()

    def _tree(self, state, t: int, used: np.ndarray, weight: float) -> Tree:
        tree, alive, held = Tree(self.depth), np.ones(1, bool), None
        for level in range(self.depth):
            found = self._cuts(state, tree, level, alive, t, used, weight)
            held = found[0, 2:4] if held is None else held  # g and h of each node
            best = np.where(alive, found[:, 0].argmax(axis=0), 0)
            gain, cut, _, _, *left = found[best, :, np.arange(len(alive))].T
            splits = alive & (gain > 0)
            at = np.flatnonzero(splits)
            tree.feature[2**level - 1 + at], tree.cut[2**level - 1 + at] = used[best[at]], cut[at]
            np.add.at(self.gains, used[best[at]], gain[at])
            left = np.where(splits, np.array(left), held)  # a node without a cut sends all its rows left
            held = np.stack([left, held - left], axis=2).reshape(2, -1)
            alive = np.repeat(splits, 2)
            if not splits.any():
                break
        g, h = held
        tree.value[:: 2**self.depth // len(g)] = self.rate * g / (h + self.l2 + 1e-12)
        return tree

    def _cuts(self, state, tree: Tree, level: int, alive: np.ndarray, t: int, used: np.ndarray, weight: float) -> np.ndarray:
        """``_best`` of each column of ``used``, from sums over the sampled rows of nodes that are alive."""
        size, seed, share, l2, least = 2**level * WIDTH, self.seed, self.row_share, self.l2, self.min_rows

        def sums(items: Iterator[tuple]) -> Iterator[tuple]:
            total = np.zeros((len(used), 3, size))
            for item in items:
                bins, y, margin = _block(item)
                node = tree.node(bins, level)
                rows = np.flatnonzero((np.random.default_rng([seed, t, *item[0]]).random(len(y)) < share) & alive[node])
                p, w, base = 0.5 * (1 + np.tanh(margin[rows] / 2)), np.where(y[rows] == 1, weight, 1.0), node[rows] * WIDTH
                g, h = (np.round(x * GRID) / GRID for x in (w * (y[rows] - p), w * p * (1 - p)))
                for own, f in zip(total, used):
                    at = base + bins[f][rows]
                    own[0] += np.bincount(at, minlength=size)
                    own[1] += np.bincount(at, g, size)
                    own[2] += np.bincount(at, h, size)
            yield from zip(used.tolist(), total)

        tasks = max(1, min(len(used), state.getNumPartitions() // 4))  # starting one costs more than its sums, if these are of few tasks
        found = dict(state.mapPartitions(sums).reduceByKey(np.add, tasks).mapValues(lambda x: _best(x, l2, least)).collect())
        return np.array([found[f] for f in used.tolist()])

    def _margins(self, features: pa.Array, k: int) -> np.ndarray:
        """Margins of each row after each of the first k trees."""
        bins = _binned(_values(features, len(self.edges)), self.edges)
        return np.cumsum(np.array([tree.margins(bins) for tree in self.trees[:k]]).reshape(k, -1).T, axis=1)

    def _stop_early(self, valid: DataFrame, label: str) -> None:
        """Average precision after every tree, from one evaluation of all trees; keeps the trees up to the best.

        As training with patience would, it stops looking ``patience`` trees after the best so far. Rows are dealt to
        ranges of their margin, a task for each range and number of trees, ties together.
        """
        k, margins = len(self.trees), self._margins
        low, high = (np.cumsum([end(tree.value) for tree in self.trees]) for end in (np.min, np.max))
        scale = CELLS / np.maximum(high - low, 1e-9)
        rows = self._prepared(valid).select("__features", F.coalesce(F.col(label) == 1, F.lit(False)).cast("int").alias("__y"))

        def cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            s = margins(batch.column("__features"), k)
            return s, np.clip(np.floor((s - low) * scale), 0, CELLS - 1).astype(np.int64), batch.column("__y").to_numpy()

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, k * CELLS))
            for batch in batches:
                _, cell, y = cells(batch)
                flat = cell + np.arange(k) * CELLS
                total[0] += np.bincount(flat.ravel(), minlength=k * CELLS)
                total[1] += np.bincount(flat[y == 1].ravel(), minlength=k * CELLS)
            yield from chunks(total.ravel())

        total = summed(rows.mapInArrow(counted, CHUNKS))
        n, tp = total.reshape(2, k, CELLS)[:, :, ::-1] if len(total) else np.zeros((2, k, CELLS))  # from the highest margins on
        above, tp_above = (x.cumsum(axis=1) - x for x in (n, tp))
        ranges = (above // RANGE_ROWS).astype(np.int64)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s, cell, y = cells(batch)
                found = []
                for i in range(k):
                    own = ranges[i][CELLS - 1 - cell[:, i]]
                    for r in np.unique(own):
                        mine = own == r
                        found.append((i, int(r), s[mine, i].tobytes(), y[mine].astype(np.uint8).tobytes()))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], ["k", "r", "s", "y"])

        def gained(key: tuple, table: pa.Table) -> pa.Table:
            i, r = (x.as_py() for x in key)
            s, y = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("s", float), ("y", np.uint8)))
            first = np.flatnonzero(ranges[i] == r)[0]
            order = np.argsort(-s)
            ends = np.flatnonzero(np.append(np.diff(s[order]) != 0, True))  # the last row of each margin
            hits = tp_above[i, first] + np.cumsum(y[order], dtype=np.int64)[ends]
            gain = (np.diff(hits, prepend=tp_above[i, first]) * hits / (above[i, first] + ends + 1)).sum()
            return pa.table({"k": pa.array([i], pa.int32()), "gained": [gain]})

        found = rows.mapInArrow(dealt, "k int, r long, s binary, y binary").groupBy("k", "r").applyInArrow(gained, "k int, gained double")
        best = -math.inf
        for i, gain in sorted(found.groupBy("k").agg(F.sum("gained")).collect()):  # a row for each tree
            ap = float(gain / tp[i].sum()) if tp[i].sum() else 0.0
            self.history.append({"trees": i + 1, "valid_pr_auc": ap})
            if ap > best:
                best, self.kept = ap, i + 1
            elif i + 1 - self.kept >= self.patience:
                break

    def _margin(self, df: DataFrame, k: int) -> DataFrame:
        """Sum of the first k trees' outputs."""
        margins = self._margins

        @F.arrow_udf("double")
        def last(x: pa.Array) -> pa.Array:
            return pa.array(margins(x, k)[:, -1])

        return df.withColumn("__margin", last("__features"))

    def score(self, df, name="score"):
        out = self._margin(self._prepared(df), self.kept)
        return out.withColumn(name, 1 / (1 + F.exp(-F.col("__margin")))).drop("__margin", "__features")

    def feature_importance(self):
        return sorted(zip(self.features, (self.gains / max(self.gains.sum(), 1e-300)).tolist()), key=lambda x: -x[1])

    def training_history(self):
        return self.history

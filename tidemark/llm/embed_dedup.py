"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors of one label make a cell. A cell of more than CELL_MOST vectors is dealt to overlapping smaller cells by
centers fitted on a bounded sample of it, again and again; centers as near as linked vectors stay in one cell, so a
group whose members all link is not torn. A task takes one cell: it clusters the cell into overlapping shards, builds
the adjacency lists of each shard (nearest candidates, robust-pruned, both directions) and unites them into one flat
graph. Every member is then searched in the united graph: greedily from the shards' medoids, and on through all
neighbours while they are near the threshold. Members of one shard walk together, so a step is one matrix product.
Links are cosines in double precision. A cell that can't be dealt to smaller ones, as its members are too near each
other, is compared exactly, chunk by chunk. Identical vectors are one node with a weight, and cells return counts and
one link to a local root per vector, so groups of copies never become lists of pairs. A pair that shares several
cells is counted in the first. ``with_recall`` audits the links of a bounded sample against all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory, shared

THRESHOLD = 0.93
CELL_MOST = 8_000  # members of a cell that one task searches
CELL_ROWS = 4_000  # members that cells are dealt to have, about
CELL_OVERLAP = 2  # cells of a dealt cell that a vector belongs to
CENTERS = 512  # cells that one cell is dealt to at once at most
LEVELS = 6  # times that cells are dealt at most; larger ones that are left are compared exactly
SAMPLE = 8_000  # bound of the sample of a cell that its centers are fitted on
SALT_ROWS = 50_000  # members of a large cell that one task deals
CHUNK = 8_000  # members of an undealt cell that one task compares with as many others
SHARD_ROWS, OVERLAP = 500, 2  # members of a shard, about, and shards of a cell that a vector belongs to
CANDIDATES, DEGREE, ALPHA = 32, 12, 1.2
DISTANT = 2  # random edges, so tight clumps larger than the degree are not cut off
SATURATED = 4  # nearest candidates that keep an edge though pruning would drop it, so dense groups stay connected
BEAM, SLACK, QUERIES = 8, 0.05, 256
AUDITED = 1_000  # bound of the vectors whose links are audited
FOUND = "node long, links long, root long"


def unit_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, unit): unit vectors in double precision as bytes; null where a vector can't link."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("v").to_pylist():
                v = np.array(x, np.float64) if x and None not in x else np.empty(0)
                v = v / np.abs(v).max() if len(v) and np.isfinite(v).all() and np.abs(v).max() > 0 else v[:0]  # keeps the norm from overflowing
                out.append((v / np.linalg.norm(v)).tobytes() if len(v) else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    kinds = dict(df.dtypes)
    return df.select("vec_id", "label", F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit centers of unit vectors by a few rounds of spherical k-means."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds if k > 1 else 1):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def _regions(centers: np.ndarray, threshold: float) -> np.ndarray:
    """Each center's cell: the smallest center that it reaches through centers as near as linked vectors.

    Centers of parts of a group whose members all link have a cosine of the threshold or more, as the mean of the
    members' cosines is, so such a group is one cell however many centers fall into it.
    """
    root, near = np.arange(len(centers)), [np.flatnonzero(c @ centers.T >= threshold) for c in centers]
    return _roots(len(root), np.repeat(root, [len(x) for x in near]), np.concatenate(near), root)


def _dealt(cells: DataFrame, large: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``cells`` that are in a ``large`` (cell, n) one, in overlapping smaller cells; ``whole`` where it can't be dealt."""
    big = cells.drop("whole").join(large, "cell")
    share = (F.xxhash64("node").cast("double") + 2.0**63) / 2.0**64 < SAMPLE / F.col("n")

    def fit(rows: pa.Table) -> pa.Table:
        memory.release()
        x, n = _matrix(rows.column("unit")), rows.column("n")[0].as_py()
        c = _means(x, max(1, min(CENTERS, -(-CELL_OVERLAP * n // CELL_ROWS), len(x))))
        return pa.table([rows.column("cell")[:1], rows.column("n")[:1], pa.array([c.tobytes()]), pa.array([_regions(c, threshold).tolist()], pa.list_(pa.int64()))], ["cell", "n", "centers", "regions"])

    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    fitted = big.where(share).groupBy("cell").applyInArrow(fit, "cell string, n long, centers binary, regions array<long>")
    fitted = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def assign(rows: pa.Table, fits: pa.Table) -> pa.Table:
        x = _matrix(rows.column("unit"))
        whole = not fits.num_rows  # no vector of it was in the sample, so it is a small one
        if not whole:
            c = np.frombuffer(fits.column("centers")[0].as_py(), np.float64).reshape(-1, x.shape[1])
            region = np.array(fits.column("regions")[0].as_py())
            order = np.argsort(region, kind="stable")
            names, first = np.unique(region[order], return_index=True)
            whole = len(names) == 1
        if whole:
            return rows.select(["cell", "node", "weight", "unit"]).append_column("whole", pa.array(np.ones(len(x), bool)))
        near = names[np.argsort(-np.maximum.reduceat(x @ c[order].T, first, axis=1), axis=1, kind="stable")[:, :CELL_OVERLAP]]
        row = np.repeat(np.arange(len(x)), near.shape[1])
        cell = rows.column("cell")[0].as_py()
        return pa.table([pa.array([f"{cell}/{k}" for k in near.ravel().tolist()]), *(rows.column(k).take(pa.array(row)) for k in ("node", "weight", "unit")), pa.array(np.zeros(len(row), bool))], ["cell", "node", "weight", "unit", "whole"])

    salted = big.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), salts).cast("int"))
    return salted.groupBy("cell", "salt").cogroup(fitted.groupBy("cell", "salt")).applyInArrow(assign, "cell string, node long, weight long, unit binary, whole boolean")


def _cells(nodes: DataFrame, threshold: float) -> DataFrame:
    """(cell, node, weight, unit, whole, cells): every vector in its cells, with the names of all of them."""
    cells = nodes.select(F.col("space").alias("cell"), "node", "weight", "unit", F.lit(False).alias("whole"))
    done, dealt = [], False
    for _ in range(LEVELS):
        large = shared.materialise(cells.where("not whole").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_MOST))
        if large.isEmpty():
            break
        dealt = True
        done.append(cells.join(large, "cell", "left_anti"))
        cells = shared.materialise(_dealt(cells.where("not whole"), large, threshold))
    for more in done:
        cells = cells.union(more.select(*cells.columns))
    if not dealt:
        return cells.withColumn("cells", F.array("cell"))
    names = cells.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("cells"))  # CELL_OVERLAP ** LEVELS names at most
    return shared.materialise(cells.join(names, "node").select("cell", "node", "weight", "unit", "whole", "cells"))


def _lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency of a shard as (from, to): nearest candidates under robust pruning."""
    n = len(x)
    pool = min(CANDIDATES, n - 1)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(0, n if pool else 0, 256):
        v = x[i : i + 256]
        s = v @ x.T
        rows = np.arange(len(v))
        s[rows, rows + i] = -2
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), 1, kind="stable"), 1)
        to_query = 2 - 2 * np.take_along_axis(s, near, 1)
        c = x[near]
        among = 2 - 2 * (c @ c.transpose(0, 2, 1))
        alive = np.ones(near.shape, bool)
        for _ in range(min(DEGREE, pool)):
            pick = alive.argmax(1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            a.append(rows[ok] + i)
            b.append(near[rows[ok], pick[ok]])
            alive &= ALPHA * np.maximum(among[rows, pick], 0) > np.maximum(to_query, 0)
            alive[rows, pick] = False
        kept = min(SATURATED, pool)
        a.append(np.repeat(rows + i, kept))
        b.append(near[:, :kept].ravel())
    return np.concatenate(a), np.concatenate(b)


def _graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The flat graph of a cell: where each node's edges begin, the edges, the shards' medoids, each node's nearest shard."""
    n = len(x)
    k = max(1, -(-OVERLAP * n // SHARD_ROWS)) if n > SHARD_ROWS else 1
    c = _means(x[np.random.default_rng(n).permutation(n)[: 64 * k]], k)
    score = x @ c.T
    near = np.argpartition(-score, OVERLAP - 1, axis=1)[:, :OVERLAP] if k > OVERLAP else np.tile(np.arange(k), (n, 1))
    random = np.random.default_rng(n + 1).integers(0, n, (n, DISTANT))
    a, b, medoids = [np.repeat(np.arange(n), DISTANT)], [random.ravel()], []
    for shard in range(k):
        members = np.flatnonzero((near == shard).any(1))
        if len(members):
            own = x[members]
            medoids.append(members[(own @ own.mean(0)).argmax()])
            p, q = _lists(own)
            a.append(members[p])
            b.append(members[q])
    a, b = np.concatenate(a), np.concatenate(b)
    code = np.unique(np.concatenate([a * n + b, b * n + a]))  # lists of a vector from all its shards, both directions
    a, b = code // n, code % n
    a, b = a[a != b], b[a != b]
    return np.searchsorted(a, np.arange(n + 1)), b, np.unique(medoids), score.argmax(1)


def _walked(x: np.ndarray, q: np.ndarray, start: np.ndarray, edges: np.ndarray, medoids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the queries with the nodes that their common walk has seen, and these nodes."""
    seen, opened = np.zeros(len(x), bool), np.zeros(len(x), bool)
    seen[medoids] = True
    nodes, score = medoids, q @ x[medoids].T
    beam = np.full((len(q), BEAM), -2.0)  # the best cosines of each query so far
    new = score
    while True:
        beam = np.partition(np.concatenate([beam, new], 1), new.shape[1], axis=1)[:, new.shape[1] :]
        closed = np.flatnonzero(~opened[nodes])
        open_ = nodes[closed[(score[:, closed] >= np.minimum(beam.min(1), threshold - SLACK)[:, None]).any(0)]]
        if not len(open_):
            return nodes, score
        opened[open_] = True
        count = start[open_ + 1] - start[open_]
        found = np.unique(edges[np.repeat(start[open_] - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        found = found[~seen[found]]
        seen[found] = True
        new = q @ x[found].T
        nodes, score = np.concatenate([nodes, found]), np.concatenate([score, new], 1)


def _roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Merge links into ``parent`` by repeated minima."""
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        if (parent == before).all():
            return parent


def _earlier(rows: pa.Table) -> np.ndarray:
    """Numbers of the cells of each row that come before the cell at hand; below 0 where there are none."""
    here, names = rows.column("cell")[0].as_py(), rows.column("cells").to_pylist()
    before = [[c for c in own if c < here] for own in names]
    number = {c: k for k, c in enumerate(sorted({c for own in before for c in own}))}
    out = np.full((len(names), max(map(len, before), default=0)), -1)
    for i, own in enumerate(before):
        out[i, : len(own)] = [number[c] for c in own]
    return out


def _first(near: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The pairs of ``near`` that share no earlier cell; those that do are counted there."""
    for j in range(one.shape[1]):
        for k in range(two.shape[1]):
            near &= (one[:, j][:, None] != two[:, k]) | (one[:, j] < 0)[:, None]
    return near


def _searched(rows: pa.Table, threshold: float) -> pa.Table:
    """(node, links, root) of a cell, by search in its graph."""
    memory.release()
    node, weight, x = rows.column("node").to_numpy(), rows.column("weight").to_numpy(), _matrix(rows.column("unit"))
    n, earlier, parent = len(node), _earlier(rows), np.arange(len(node))
    start, edges, medoids, shard = _graph(x)
    near = np.zeros((n, n), bool)
    order = np.argsort(shard, kind="stable")
    for i in range(0, n, QUERIES):
        at = order[i : i + QUERIES]
        nodes, score = _walked(x, x[at], start, edges, medoids, threshold)
        p, q = np.nonzero(score >= threshold)
        near[at[p], nodes[q]] = True
        near[nodes[q], at[p]] = True  # found from either end
    near &= node[:, None] != node  # repeated ids
    links = np.zeros(n, np.int64)
    for i in range(0, n, QUERIES):
        at = np.arange(i, min(i + QUERIES, n))
        a, b = np.nonzero(near[at] & (parent[at][:, None] != parent))
        parent = _roots(n, at[a], b, parent)
        links[at] = _first(near[at], earlier[at], earlier) @ weight
    return pa.table([pa.array(node), pa.array(links), pa.array(node[parent])], ["node", "links", "root"])


def _compared(rows: pa.Table, threshold: float) -> pa.Table:
    """(node, links, root) of two chunks of a cell, or of one with itself, by all cosines."""
    memory.release()
    one, two = (rows.column(c)[0].as_py() for c in ("one", "two"))
    node, weight, mine = (rows.column(c).to_numpy() for c in ("node", "weight", "mine"))
    x, earlier = _matrix(rows.column("unit")), _earlier(rows)
    left, right = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
    links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
    held = x[right]
    for i in range(0, len(left), QUERIES):
        at = left[i : i + QUERIES]
        near = (x[at] @ held.T >= threshold) & (node[at][:, None] != node[right])
        a, b = np.nonzero(near & (parent[at][:, None] != parent[right]))
        parent = _roots(len(node), at[a], right[b], parent)
        near = _first(near, earlier[at], earlier[right])
        links[at] += near @ weight[right]
        if one != two:
            links[right] += weight[at] @ near
    return pa.table([pa.array(node), pa.array(links), pa.array(node[parent])], ["node", "links", "root"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links between ``vectors`` (vec_id, embedding, label; other columns are ignored) of equal, non-null label.

    Null vectors and labels, zero vectors, and vectors with null or non-finite components link with nothing;
    vectors of different lengths never meet. A repeated row is a vector like any other and links with its copies;
    a null vec_id links with nothing. A cosine of exactly ``threshold`` links. An empty table gives none. Result, one
    row per input row: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id).
    """
    shared.integral(vectors, "vec_id")
    units = shared.materialise(unit_vectors(vectors))
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    space = F.concat_ws(":", F.col("label").cast("string"), F.length("unit"))
    placed = units.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), space.alias("space"), "unit", F.unhex(F.md5(F.concat(F.encode(space, "utf-8"), F.col("unit")))).alias("same"))
    # repeated ids make one node of several vectors
    nodes = shared.materialise(placed.groupBy("same").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("space").alias("space"), F.first("unit").alias("unit")))
    cells = _cells(nodes, threshold)
    large = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("whole").alias("any_whole")).where(F.col("any_whole") | (F.col("n") > CELL_MOST)).select("cell", "n")
    large = shared.materialise(large)
    found = cells.join(large, "cell", "left_anti").groupBy("cell").applyInArrow(lambda rows: _searched(rows, threshold), FOUND)
    if not large.isEmpty():
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        mine = cells.join(large, "cell").withColumn("mine", F.pmod(F.xxhash64("node", F.lit("chunk")), chunks).cast("int"))
        pairs = mine.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumns({"one": F.least("mine", "other"), "two": F.greatest("mine", "other")})
        found = found.union(pairs.groupBy("cell", "one", "two").applyInArrow(lambda rows: _compared(rows, threshold), FOUND))
    found = shared.materialise(found)
    component = shared.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(component, "node")
    named = nodes.select("same", "node", "weight").join(linked, "node")
    out = placed.select("vec_id", "same").join(named, "same").select("vec_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("component").alias("component_id"))
    rest = units.where(~usable | usable.isNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return out.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def audit_recall(vectors: DataFrame, found: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED) -> DataFrame:
    """One row: true and found links (n_true, n_found) of at most ``audited`` vectors, drawn by a hash of the id, against all rows."""
    units = unit_vectors(vectors).where("unit is not null and label is not null and vec_id is not null").select("vec_id", F.concat_ws(":", F.col("label").cast("string"), F.length("unit")).alias("space"), "unit")
    asked = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(audited).collect()  # ``audited`` rows at most
    spaces: dict[str, list] = {}
    for r in asked:
        spaces.setdefault(r["space"], []).append(r)
    queries = {k: (np.array([r["vec_id"] for r in v], np.int64), np.frombuffer(b"".join(bytes(r["unit"]) for r in v), np.float64).reshape(len(v), -1)) for k, v in spaces.items()}

    def count(batches):
        total = {k: np.zeros(len(ids), np.int64) for k, (ids, _) in queries.items()}
        for batch in batches:
            space, unit = np.array(batch.column("space").to_pylist(), object), batch.column("unit")
            for k in queries.keys() & set(space.tolist()):
                at = pa.array(np.flatnonzero(space == k))
                total[k] += (queries[k][1] @ _matrix(pa.chunked_array([unit.take(at)])).T >= threshold).sum(1)
        for k, (ids, _) in queries.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[k])], ["vec_id", "n"])

    true = units.mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n_true"))
    return true.join(found.groupBy("vec_id").agg(F.max("n_links").alias("n_links")), "vec_id").agg(F.coalesce(F.sum("n_true"), F.lit(0)).alias("n_true"), F.coalesce(F.sum(F.least("n_links", "n_true")), F.lit(0)).alias("n_found"))


def with_recall(vectors: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED) -> DataFrame:
    """``near_duplicates`` with the audited recall of its links (audit_recall) and their number (audit_links) in every row; with none, a recall of 1."""
    found = shared.materialise(near_duplicates(vectors, threshold))
    audit = audit_recall(vectors, found, threshold, audited).first()
    recall = audit["n_found"] / audit["n_true"] if audit["n_true"] else 1.0
    return found.withColumn("audit_recall", F.lit(float(recall))).withColumn("audit_links", F.lit(int(audit["n_true"])).cast("long"))

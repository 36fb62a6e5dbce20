"""Session-level helpers shared by the operators: the shared folder and label propagation over links."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


EDGES = 250_000  # edges that one task holds
_written: list[str] = []  # files of materialised frames


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets a folder; others must set it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")  # one machine only
    context.setCheckpointDir(folder)


def folder(spark: SparkSession) -> str:
    """The shared folder for tables that later steps read again."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if path := _file(out):
        _written.append(path)
    return out


def _file(df: DataFrame) -> str | None:
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        if path := _file(df):
            delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x != path]


def sweep(spark: SparkSession, kept: int) -> None:
    """Delete all but the first ``kept`` of the tables in ``written()``: those that a finished step has left."""
    for path in _written[kept:]:
        delete(spark, path)
    del _written[kept:]


def written() -> int:
    """How many materialised tables there are."""
    return len(_written)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of lineage that a checkpoint has cut; it does so when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def integral(df: DataFrame, column: str) -> None:
    """Ids must be whole numbers: a cast would turn others into null without a word."""
    kind = dict(df.dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must be an integer, not {kind}")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition, as edges to the smallest node that they lead to within it."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, where = np.unique(np.concatenate([np.concatenate(x) for x in zip(*parts)]), return_inverse=True)
    u, v = where[: len(where) // 2], where[len(where) // 2 :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[u], parent[v])
        before = parent.copy()
        np.minimum.at(parent, before[u], low)
        np.minimum.at(parent, before[v], low)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        if (parent == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[parent])], ["u", "v"])


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    spread = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, F.xxhash64("u", "v"))  # a hub's edges, too
    return spread.mapInArrow(_local_stars, "u long, v long").where("u != v")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links`` (a long, b long) as (node, component): the smallest reachable node.

    Links are dealt to tasks of at most about EDGES, by a hash of both ends, and each task keeps one edge for each of
    its nodes. While more than one task is needed, large-star and small-star steps follow, which only regroup edges by
    node, so no component is ever gathered in one task's memory; rounds grow with the logarithm of a component's size.
    Self links keep their node; null ends are ignored; an empty input gives an empty result.
    """
    plain = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    plain = materialise(plain)
    alone = plain.where("u = v")
    tasks = max(1, -(-plain.count() // EDGES))
    edges = materialise(_contracted(plain, tasks))
    before = None
    for _ in range(max_rounds if tasks > 1 else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        last, edges = edges, materialise(_contracted(small.distinct(), tasks))
        drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).union(alone.select(F.col("u").alias("node"), F.col("v").alias("component")))
    out = materialise(stars.union(roots).groupBy("node").agg(F.min("component").alias("component")))
    drop(plain, edges)
    return out

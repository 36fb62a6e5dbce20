"""Packed token-id output: best-fit-decreasing packing into rows of an id matrix.

Documents of a partition are gathered into groups of bounded size. Overlong documents are split into full rows
and a remainder, losslessly. A group's pieces go, longest first, into the row with the least sufficient room,
which a segment tree over capacities finds in logarithmic time. Each row of the result is a row of the id
matrix with its cumulative segment lengths and the places where positions start anew. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LENGTH = 2048
GROUP_TOKENS = 2_000_000  # tokens that a task holds and packs at once
SLICE_ROWS = 1_000
ROWS = "row_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"


class CapacityTree:
    """Counts of open rows by room left; finds the least room that is at least as large as asked."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, room: int) -> int | None:
        node = room + self.size
        while not self.count[node]:
            while node & 1:  # a right child: nothing larger under this parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Piece numbers by row; each piece is at most ``length`` long."""
    tree, rows, open_rows = CapacityTree(length), [], {}
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        room = tree.least(need)
        if room is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.change(room, -1)
        rows[row].append(piece)
        if room > need:
            open_rows.setdefault(room - need, []).append(row)
            tree.change(room - need, 1)
    return rows


def packed_rows(docs: DataFrame, encoder: Callable[[], Callable[[list], list[bytes]]], length: int = LENGTH, pad: int = 0, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed id matrix of ``docs`` (doc_id, text; other columns are ignored).

    ``encoder()`` runs once in each task and gives a function from texts (null: empty) to little-endian unsigned
    32-bit ids; documents without ids have no piece. Repeated rows and null ids are packed as they are; an empty
    table gives no rows. Texts of any length are split losslessly; of pieces of one length the earlier is placed first.
    doc_id must be an integer. Result: row_id, ids (``length`` numbers, padded with ``pad``), n_tokens (without
    padding), cu_seqlens (0 and the cumulative lengths of the row's segments), position_resets (offsets at which
    positions start at 0 again), doc_ids and starts (the document of each segment and its ids before it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_id, held, size = encoder(), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    for start in range(0, len(ids) // 4, length):
                        held.append((doc, start, ids[4 * start : 4 * (start + length)]))
                    size += len(ids) // 4
                    if size >= group_tokens:
                        yield _rows(held, length, pad, next_id)
                        next_id, held, size = next_id + len(held), [], 0
        yield _rows(held, length, pad, next_id)

    shared.integral(docs, "doc_id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, ROWS)


def _rows(pieces: list[tuple], length: int, pad: int, first_id: int) -> pa.RecordBatch:
    lengths = np.array([len(x[2]) // 4 for x in pieces], np.int64)
    rows = best_fit_decreasing(lengths, length)
    fill = int(pad).to_bytes(4, "little")
    ids, used, ends, resets, documents, starts = [], [], [], [], [], []
    for row in rows:
        cumulative = np.concatenate([[0], np.cumsum(lengths[row])]).tolist()
        ids.append(b"".join(pieces[p][2] for p in row) + fill * (length - cumulative[-1]))
        used.append(cumulative[-1])
        ends.append(cumulative)
        resets.append(cumulative[:-1])
        documents.append([pieces[p][0] for p in row])
        starts.append([pieces[p][1] for p in row])
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    columns = (range(first_id, first_id + len(rows)), ids, used, ends, resets, documents, starts)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds)], [x.split()[0] for x in ROWS.split(", ")])


def write(rows: DataFrame, path: str) -> None:
    """Write the matrix and its segment columns as Parquet files, through Spark's own committer."""
    rows.write.mode("overwrite").parquet(path)


def matrix(ids: list[bytes]) -> np.ndarray:
    """Rows of ids as one array of unsigned 32-bit numbers."""
    return np.frombuffer(b"".join(ids), "<u4").reshape(len(ids), -1)

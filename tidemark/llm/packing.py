"""Packing token sequences into windows of a fixed length, online and in bounded space.

Each partition keeps a fixed number of open windows. A document goes best-fit into the open window with the
least room that holds it whole; where none does, the fullest window is filled with its beginning, emitted, and
the rest goes on. At a partition's end the leftovers of all open windows are merged: they become full windows,
and the last rest, shorter than one, becomes windows whose lengths are powers of two, which need no padding.
Documents are cut only where a window ends, and every id lies in exactly one piece. Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LENGTH = 2048
OPEN_WINDOWS = 64
SLICE_ROWS = 1_000  # documents tokenized at a time
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Windows of one partition; pieces are (doc, start, ids, doc_tokens) with ids as 4-byte numbers."""

    def __init__(self, length: int, open_windows: int, first_id: int):
        self.length, self.most, self.next_id = length, open_windows, first_id
        self.windows: list[tuple[int, int]] = []  # (room, key), sorted: the fullest leads
        self.content: dict[int, list[tuple]] = {}
        self.keys = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes, start: int = 0, total: int | None = None) -> None:
        total = len(ids) // 4 if total is None else total
        view = memoryview(ids)
        while len(view) >= 4 * self.length:
            self.emit([(doc, start, bytes(view[: 4 * self.length]), total)])
            view, start = view[4 * self.length :], start + self.length
        while len(view):
            need = len(view) // 4
            k = bisect_left(self.windows, (need, -1))
            if k == len(self.windows) and len(self.windows) < self.most:
                self.keys += 1
                self.content[self.keys] = []
                k = bisect_left(self.windows, (self.length, self.keys))
                self.windows.insert(k, (self.length, self.keys))
            elif k == len(self.windows):
                k = 0
            room, key = self.windows.pop(k)
            part = min(room, need)
            self.content[key].append((doc, start, bytes(view[: 4 * part]), total))
            view, start = view[4 * part :], start + part
            if part == room:
                self.emit(self.content.pop(key))
            else:
                insort(self.windows, (room - part, key))

    def leftovers(self) -> list[tuple]:
        left = [piece for _, key in self.windows for piece in self.content[key]]
        self.windows, self.content = [], {}
        return left

    def fill(self, pieces: list[tuple]) -> list[tuple]:
        """Emit full windows from the pieces in their order; return what is left, shorter than a window."""
        held, size = [], 0
        for doc, start, ids, total in pieces:
            while ids:
                part = min(self.length - size, len(ids) // 4)
                held.append((doc, start, ids[: 4 * part], total))
                ids, start, size = ids[4 * part :], start + part, size + part
                if size == self.length:
                    self.emit(held)
                    held, size = [], 0
        return held

    def powers(self, pieces: list[tuple]) -> None:
        """Emit a last rest as windows whose lengths are powers of two."""
        pieces = list(pieces)
        size = sum(len(x[2]) // 4 for x in pieces)
        while size:
            take = want = 1 << (size.bit_length() - 1)
            held = []
            while take:
                doc, start, ids, total = pieces.pop(0)
                part = min(take, len(ids) // 4)
                held.append((doc, start, ids[: 4 * part], total))
                if 4 * part < len(ids):
                    pieces.insert(0, (doc, start + part, ids[4 * part :], total))
                take -= part
            self.emit(held)
            size -= want

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list], list[bytes]]], length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text; other columns are ignored) into windows.

    ``encoder()`` runs once in each task and gives a function from texts (null: empty) to little-endian unsigned
    32-bit ids; documents without ids give no piece. Repeated rows are packed as often as they occur, null ids
    too; an empty table gives no pieces. Texts of any length are cut into pieces, losslessly; of windows with the same
    room the oldest is taken. doc_id must be an integer. Result, one row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.
    """
    if open_windows < 1 or length < 1:
        raise ValueError("length and open_windows must be at least 1")

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer = Packer(length, open_windows, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    packer.add(doc, ids)
                if packer.rows:
                    yield packer.flush()
        packer.powers(packer.fill(packer.leftovers()))
        yield packer.flush()

    shared.integral(docs, "doc_id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(online, PIECES)

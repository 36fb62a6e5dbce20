"""Byte-level BPE by rank files, in numpy: encoding and decoding of whole texts.

Distinct pre-tokens lie as rows of token ids in padded matrices, one matrix per length bucket. Each round every
row merges its leftmost pair of least rank: ranks of pairs come from a hash table in numpy arrays, the row is
compacted by one column, and only the two pairs that changed are looked up again. Finished rows leave. A
pre-token of more than LONG bytes takes its merges in the same order from a heap, so its time stays near its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory
from .piece_cache import PieceCache

NONE = np.int32(2**31 - 1)
LONG = 2_048  # bytes of a row of a matrix at most; a round of merges costs time in a row's length, so longer ones use a heap
CELLS = 4_000_000  # cells of one padded matrix at most, unless one row is longer
SLICE_BYTES = 4_000_000  # text that is encoded at a time


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> rank of their concatenation, by open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            at = todo[free]
            self.keys[slot[at]] = key[at]  # of several keys for one slot the last stays
            mine = self.keys[slot[todo]] == key[todo]
            done = todo[mine]
            self.ranks[slot[done]] = rank[done]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair has none or an id is negative."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            held = self.keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            more = ~hit & (held >= 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.whole = {t: np.array([r], "<u4").tobytes() for t, r in ranks.items()}
        # \\s of the library's engine is the property White_Space
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.bytes_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*pairs))) if pairs else PairTable(*[np.empty(0, np.int64)] * 3)
        top = max(ranks.values()) + 1
        spelled = [b""] * top
        for t, r in ranks.items():
            spelled[r] = t
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.size = np.array([len(t) for t in spelled], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.longest = max(map(len, ranks))
        self.cache = PieceCache(self._encode)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        length = np.array([len(p) for p in pieces])
        bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        for row in np.flatnonzero(length > LONG).tolist():
            out[row] = self._long(pieces[row])
        bucket[length > LONG] = -1
        for b in np.unique(bucket[bucket >= 0]):
            rows = np.flatnonzero(bucket == b)
            rows = rows[np.argsort(length[rows], kind="stable")]
            step = max(1, CELLS >> int(b))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                for row, ids in zip(some.tolist(), self._matrix([pieces[i] for i in some.tolist()], length[some])):
                    out[row] = ids
        return out

    def _long(self, piece: bytes) -> bytes:
        """Ids of one long piece: the same merges, leftmost of least rank first, from a heap of pairs."""
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by place where a token begins; 0 in ``end``: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.rank_of(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two tokens has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := self.rank_of(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if before[i] >= 0 and (r := self.rank_of(piece[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.whole.get(piece[i : end[i]]) or int(self.bytes_id[piece[i]]).to_bytes(4, "little"))
            i = end[i]
        return b"".join(out)

    def rank_of(self, token: bytes) -> int | None:
        found = self.whole.get(token) if len(token) <= self.longest else None
        return None if found is None else int.from_bytes(found, "little")

    def _matrix(self, pieces: list[bytes], length: np.ndarray) -> list[bytes]:
        n, width = len(pieces), int(length.max())
        if not width:
            return [b""] * n
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.bytes_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        final, live, left = [b""] * n, np.arange(n), length.copy()
        while True:
            j = rank.argmin(1) if rank.shape[1] else np.zeros(len(live), np.int64)
            least = rank[np.arange(len(live)), j] if rank.shape[1] else np.full(len(live), NONE)
            done = least == NONE
            for row, own, size in zip(live[done].tolist(), ids[done], left[done].tolist()):
                final[row] = own[:size].astype("<u4").tobytes()
            if done.all():
                return final
            going = ~done
            live, left, ids, rank, j, least = live[going], left[going] - 1, ids[going], rank[going], j[going], least[going]
            row, column = np.arange(len(live)), np.arange(ids.shape[1] - 1)
            ids[row, j] = least
            moved = column + (column > j[:, None])
            ids = np.take_along_axis(ids, moved, 1)
            moved = column[:-1] + (column[:-1] >= j[:, None])
            rank = np.take_along_axis(rank, np.minimum(moved, rank.shape[1] - 1), 1)
            for at in (j - 1, j):
                ok = (at >= 0) & (at < rank.shape[1])
                rank[row[ok], at[ok]] = self.pairs.find(ids[row[ok], at[ok]], ids[row[ok], at[ok] + 1])
            keep = int(left.max())  # columns that any row still uses
            ids, rank = ids[:, :keep], rank[:, : max(keep - 1, 0)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t) if t else [] for t in texts]
        return self.cache.joined(split)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        spelled = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out = [self.whole.get(p, b"") for p in spelled]
        rest = [k for k, x in enumerate(out) if not x]
        for k, ids in zip(rest, self.merge([spelled[k] for k in rest])):
            out[k] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.spelling[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each file and worker process, so tasks share what is cached."""
    return Codec(read_ranks(ranks_path), pattern)


memory.on_release(codec.cache_clear)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text; other columns are ignored) and decode the ids again.

    A null text is empty and has no ids. Repeated rows and null ids come back as they are; an empty table gives
    none. The rank file is read where tasks run, once in each worker. A text is taken whole, however long.
    Result: doc_id, ids (array of int), decoded (binary).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode(part.column("text").to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([own.decode(x) for x in found], pa.binary())], ["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of the column, one row at least."""
    length = np.array([x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()], np.int64)
    part = np.cumsum(length) // size
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
        if j > i:
            yield batch.slice(i, j - i)

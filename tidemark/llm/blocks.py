"""Document blocks and the sharded exchange of keys and answers.

Documents are dealt to blocks of bounded text size. A block asks shards (ranges of a 64-bit key space) about
its distinct keys, and answers go back aligned with the question. Keys travel as packed, sorted deltas in one or
more hops. In a hop a sorted run of keys is cut into at most FAN slices, one for each part of its range; the slices
of FAN runs for one part are merged into one run, which is about as long as theirs were. After the last hop a range
holds what all blocks asked. So B blocks send at most B * FAN rows in a hop, one hop is enough for FAN blocks, two
for FAN ** 2, and no task holds more than FAN slices. Nothing reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory

BLOCK_BYTES = 8_000_000  # text bytes of a block
FLUSH_BYTES = 32_000_000  # rows that a map task holds before it emits packed blocks
FAN = 512  # slices that a run of keys is cut into, and runs that are merged, in one hop at most
PARTITIONS = 100_000  # partitions at most; more blocks than that share them
ASKED = "__range long, __group long, asker long, level int, keys binary, counts binary"
ANSWERED = "__range long, asker long, level int, parts array<binary>, stats binary"


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def pack(docs: DataFrame, blocks: int, *, by: tuple[str, ...]) -> DataFrame:
    """(__block, __data): rows of ``docs`` dealt to blocks by a hash of ``by``, as compressed Arrow streams."""
    keyed = docs.select(F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int").alias("__block"), *docs.columns)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield from _flush(held)
                held, size = [], 0
        if held:
            yield from _flush(held)

    return keyed.mapInArrow(deal, "__block int, __data binary").repartition(min(blocks, PARTITIONS), "__block")


def _flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    block = table.column("__block").to_numpy()
    if not len(block):
        return
    order = np.argsort(block, kind="stable")
    table, block = table.take(pa.array(order)).combine_chunks(), block[order]
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(block)]):
        part, sink = table.slice(i, j - i).drop_columns(["__block"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(part)
        yield pa.RecordBatch.from_arrays([pa.array([block[i]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["__block", "__data"])


def unpack(packed: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packed.column("__data").to_pylist()])


def texts_of(table: pa.Table, column: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in table.column(column).cast(pa.large_binary()).to_pylist()]


def planes(values: np.ndarray) -> bytes:
    """Fixed-width numbers with like bytes side by side, which the shuffle's compression then shortens."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes() if len(values) else b""


def from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel() if data else np.empty(0, kind)


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit mixing of two hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values by a sort; np.unique alone hashes them, which takes ten times as long."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def radices(blocks: int, fan: int) -> list[int]:
    """Slices of a run in each hop among so many blocks: as few hops as ``fan`` allows, all alike."""
    hops = 1
    while fan**hops < blocks:
        hops += 1
    radix = max(1, round(blocks ** (1 / hops)))
    while radix**hops < blocks:
        radix += 1
    return [radix] * hops


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; shards are equal ranges of the upper 32 bits."""
    return np.searchsorted((np.arange(shards, dtype=np.uint64) << np.uint64(32)) // np.uint64(shards), keys >> np.uint64(32), side="right") - 1


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(x, kinds[t]) for x, (_, t) in zip(columns, fields)], [name for name, _ in fields])


def _cut(keys: np.ndarray, counts: np.ndarray | None, parent: int, ranges: int, radix: int, asker: int, level: int) -> list[tuple]:
    """A run of keys of range ``parent``, in slices for each of its parts; ``ranges`` counts all parts of the key space."""
    part = np.arange(parent * radix, (parent + 1) * radix, dtype=np.uint64)
    cuts = [*np.searchsorted(keys >> np.uint64(32), (part << np.uint64(32)) // np.uint64(ranges)).tolist(), len(keys)]
    cuts[0] = 0
    return [(int(p), asker // radix, asker, level, pack_keys(keys[i:j]), b"" if counts is None else planes(counts[i:j])) for p, i, j in zip(part, cuts, cuts[1:])]


def _levels(rows: pa.Table) -> Iterator[tuple[int, pa.Table, list[np.ndarray]]]:
    levels = rows.column("level").to_numpy()
    for level in np.unique(levels).tolist():
        part = rows.filter(pa.array(levels == level))
        yield level, part, [unpack_keys(x) for x in part.column("keys").to_pylist()]


def _summed(part: pa.Table, where: np.ndarray, size: int) -> np.ndarray | None:
    counts = [from_planes(x, np.uint32) for x in part.column("counts").to_pylist()]
    return np.bincount(where, np.concatenate(counts), size).astype(np.int64) if sum(map(len, counts)) == len(where) and len(where) else None


class Exchange:
    """Questions of ``blocks`` packed blocks and the way of answers back to them.

    ``keys_of`` gives for the documents of a block and each level, from 1 on, the distinct sorted uint64 keys and,
    or None, uint32 counts. ``kinds`` are the number types of the parts of an answer.
    """

    def __init__(self, packed: DataFrame, blocks: int, keys_of: Callable[[pa.Table], list[tuple[np.ndarray, np.ndarray | None]]], kinds: tuple[type, ...], fan: int | None = None):
        self.radix, self.kinds = radices(blocks, fan or FAN), kinds
        self.shards = math.prod(self.radix)
        first = self.radix[0]

        def asked(block: pa.Table) -> pa.Table:
            memory.release()
            asker = block.column("__block")[0].as_py()
            return _rows(ASKED, [row for level, (keys, counts) in enumerate(keys_of(unpack(block)), 1) for row in _cut(keys, counts, 0, first, first, asker, level)])

        self.hops = [packed.groupBy("__block").applyInArrow(asked, ASKED)]
        for k, radix in enumerate(self.radix[1:], 2):
            self.hops.append(self.hops[-1].groupBy("__range", "__group").applyInArrow(_merge(math.prod(self.radix[:k]), radix), ASKED))

    @property
    def questions(self) -> DataFrame:
        """What each shard is asked, dealt to tasks by ``__range``, the shard's number."""
        return self.hops[-1].repartition(min(self.shards, PARTITIONS), "__range")

    def back(self, answers: DataFrame) -> DataFrame:
        """(__block, __range, level, parts, stats): answers of shards (see ANSWERED), handed back hop by hop."""
        for asked, radix in zip(self.hops[-2::-1], self.radix[:0:-1]):
            given = answers.select(F.expr(f"__range div {radix}").alias("__range"), F.col("asker").alias("__group"), F.col("__range").alias("part"), "level", "parts", "stats")
            answers = asked.groupBy("__range", "__group").cogroup(given.groupBy("__range", "__group")).applyInArrow(_hand_back(self.kinds), ANSWERED)
        return answers.select(F.col("asker").cast("int").alias("__block"), "__range", "level", "parts", "stats")


def _merge(ranges: int, radix: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        parent, group = (x.as_py() for x in key)
        out: list[tuple] = []
        for level, part, keys in _levels(rows):
            found, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = _summed(part, where, len(found))
            out += _cut(found, None if total is None else total.astype(np.uint32), parent, ranges, radix, group, level)
        return _rows(ASKED, out)

    return merged


def _hand_back(kinds: tuple[type, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def handed(asked: pa.Table, given: pa.Table) -> pa.Table:
        got, out = answers_by_level(given.rename_columns(["__range" if c == "part" else f"own{c}" if c == "__range" else c for c in given.schema.names]), kinds), []
        for level, part, keys in _levels(asked):
            found = distinct(np.concatenate(keys))
            values, stats = got[level]
            stats = None if stats is None else stats.tobytes()
            for own, asker, k in zip(part.column("__range").to_pylist(), part.column("asker").to_pylist(), keys):
                at = np.searchsorted(found, k)
                out.append((own, asker, level, [planes(x[at]) for x in values], stats))
        return _rows(ANSWERED, out)

    return handed


def counts(packed: DataFrame, blocks: int, keys_of: Callable[[pa.Table], list[tuple[np.ndarray, np.ndarray | None]]], fan: int | None = None) -> DataFrame:
    """Each block gets, aligned with what it asked, the key's count summed over all blocks.

    stats holds, per shard and level: total count, keys counted, keys counted once, keys counted twice.
    """
    exchange = Exchange(packed, blocks, keys_of, (np.uint64,), fan)

    def answered(key: tuple, rows: pa.Table) -> pa.Table:
        shard, out = key[0].as_py(), []
        for level, part, keys in _levels(rows):
            found, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = _summed(part, where, len(found))
            total = np.zeros(len(found), np.int64) if total is None else total
            stats = np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64).tobytes()
            at = 0
            for asker, k in zip(part.column("asker").to_pylist(), keys):
                out.append((shard, asker, level, [planes(total[where[at : at + len(k)]].astype(np.uint64))], stats))
                at += len(k)
        return _rows(ANSWERED, out)

    return exchange.back(exchange.questions.groupBy("__range").applyInArrow(answered, ANSWERED))


def answers_by_level(answers: pa.Table, kinds: tuple[type, ...]) -> dict[int, tuple[list[np.ndarray], np.ndarray | None]]:
    """Per level: the parts of the answers, aligned with the block's sorted keys, and the summed stats of all shards."""
    table = answers.sort_by([("level", "ascending"), ("__range", "ascending")])
    out: dict[int, tuple[list, list]] = {}
    for level, parts, stats in zip(*(table.column(c).to_pylist() for c in ("level", "parts", "stats"))):
        got = out.setdefault(level, ([], []))
        got[0].append(parts)
        if stats is not None:
            got[1].append(np.frombuffer(stats, np.int64))
    return {k: ([np.concatenate([from_planes(x[i], kind) for x in a]) for i, kind in enumerate(kinds)], np.sum(b, axis=0) if b else None) for k, (a, b) in out.items()}


def finish(packed: DataFrame, answers: DataFrame, last: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``last(documents of a block, answers for the block)``, block by block."""
    return packed.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(lambda left, right: last(unpack(left), right), schema)

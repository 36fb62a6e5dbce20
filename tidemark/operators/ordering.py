"""A total order over a whole table without moving it to one task.

Cuts and quantiles need a few order statistics only. These are found by narrowing intervals over the columns in
question, with no shuffle of rows: of numbers by counts in cells of the interval, all columns in one scan, of other
types by scans that count and estimate. Running totals deal rows to ranges of the full sort
key, ties included, add up inside each range in one pass, and shift by the sums of earlier ranges; the driver gets as
many numbers as ranges.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000  # of estimates: an interval shrinks by about this factor in each round
CELLS = 1_000_000  # values that the driver sorts at once
BINS = 1 << 18  # cells of all intervals in one scan
NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")
ROUNDS = 20
Ranks = Callable[[int], Sequence[int]]


def order_statistics(df: DataFrame, wanted: dict[str, tuple[Column, Ranks]]) -> dict[str, list]:
    """By name, the values of a column at the ranks, from 1, that a function of its number of non-NULL values gives.

    Small columns are sorted on the driver, and large columns of numbers are counted in cells (``_by_cells``). Otherwise
    an interval (lo, hi) is kept for each rank, with the rows at or below lo and those inside; its ends are values of
    the data, so a round always leaves fewer inside.
    """
    names = {f"x{i}": name for i, name in enumerate(wanted)}
    rows = df.select(*(c.alias(x) for x, (c, _) in zip(names, wanted.values())))
    sizes = rows.agg(F.count("*").alias("all"), *(F.count(x).alias(x) for x in names)).first()
    ranks = {x: list(wanted[name][1](sizes[x])) for x, name in names.items()}
    for x, held in ranks.items():
        if held and not 1 <= min(held) <= max(held) <= sizes[x]:
            raise ValueError(f"ranks {held} of {sizes[x]} values")
    if sizes["all"] * len(names) <= CELLS:
        table = rows.toArrow()  # CELLS values at most
        return {name: _at(table.column(x), ranks[x]) for x, name in names.items()}
    if all(kind in NUMBERS for _, kind in rows.dtypes):
        held = _by_cells(rows, ranks)
        return {name: [held[x, r] for r in ranks[x]] for x, name in names.items()}
    found: dict[tuple[str, int], object] = {}
    open_ = {(x, r): (None, None, 0, sizes[x]) for x, held in ranks.items() for r in held}
    for _ in range(ROUNDS):
        narrow = [k for k, v in open_.items() if v[3] > CELLS]
        if not narrow:
            break
        near = rows.agg(*(_estimate(x, r, *open_[x, r]).alias(f"e{i}") for i, (x, r) in enumerate(narrow))).first()
        ends = {k: sorted(near[i]) for i, k in enumerate(narrow)}
        counts = rows.agg(*(F.count_if(c).alias(f"c{i}_{j}") for i, k in enumerate(narrow) for j, c in enumerate(f(F.col(k[0]), F.lit(v)) for v in ends[k] for f in (operator.lt, operator.le)))).first()
        for i, k in enumerate(narrow):
            lo, hi, below, inside = open_.pop(k)
            (a, b), r = ends[k], k[1]
            under_a, upto_a, under_b, upto_b = counts[4 * i : 4 * i + 4]
            if under_a < r <= upto_a:
                found[k] = a
            elif under_b < r <= upto_b:
                found[k] = b
            elif r <= under_a:
                open_[k] = (lo, a, below, under_a - below)
            elif r > upto_b:
                open_[k] = (b, hi, upto_b, below + inside - upto_b)
            else:
                open_[k] = (a, b, upto_a, under_b - upto_a)
    for (x, r), (lo, hi, below, inside) in open_.items():
        values = rows.where(_inside(x, lo, hi)).select(x)
        # estimates of wide integers and text do not narrow for ever; a sort does without them
        found[x, r] = _at(values.toArrow().column(x), [r - below])[0] if inside <= CELLS else values.orderBy(x).offset(r - below - 1).first()[0]
    return {name: [found[x, r] for r in ranks[x]] for x, name in names.items()}


def _keys(values: pa.Array) -> np.ndarray:
    """Numbers as unsigned integers in Spark's order: NaN is the largest, and zero has no sign."""
    if pa.types.is_integer(values.type):
        return values.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: int, kind: str) -> int | float:
    if kind not in ("double", "float"):
        return key - (1 << 63)
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return np.array([bits], np.uint64).view(np.float64)[0].item()


def _by_cells(rows: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], int | float]:
    """By (column, rank), the values of columns of numbers at the ranks.

    Each scan deals the values of every open interval to cells of equal width, and takes each cell's count, least and
    largest value. The cell that holds the rank is the next interval, until its ends are equal. The driver gets BINS
    rows at most, or two for each interval if these are more.
    """
    kinds = dict(rows.dtypes)
    found: dict[tuple[str, int], int | float] = {}
    open_ = {(x, r): (0, (1 << 64) - 1, 0) for x, held in ranks.items() for r in held}  # ends and the rows below
    while open_:
        spans = sorted({(x, lo, hi) for (x, _), (lo, hi, _) in open_.items()})
        cells = max(2, BINS // len(spans))
        widths = [(hi - lo) // cells + 1 for _, lo, hi in spans]

        def dealt(batches: Iterator[pa.RecordBatch], spans=spans, cells=cells, widths=widths) -> Iterator[pa.RecordBatch]:
            n = np.zeros((len(spans), cells), np.int64)
            least, most = np.full(n.shape, np.uint64((1 << 64) - 1)), np.zeros(n.shape, np.uint64)
            for batch in batches:
                keys = {}
                for i, ((x, lo, hi), width) in enumerate(zip(spans, widths)):
                    if x not in keys:
                        keys = {x: _keys(pc.drop_null(batch.column(x)))}  # spans are sorted by column
                    k = keys[x]
                    if (lo, hi) != (0, (1 << 64) - 1):
                        k = k[(k >= np.uint64(lo)) & (k <= np.uint64(hi))]
                    at = ((k - np.uint64(lo)) // np.uint64(width)).astype(np.int64)
                    n[i] += np.bincount(at, minlength=cells)
                    np.minimum.at(least[i], at, k)
                    np.maximum.at(most[i], at, k)
            span, cell = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (span, cell, n[span, cell], least[span, cell].view(np.int64), most[span, cell].view(np.int64))], ["span", "cell", "n", "a", "b"])

        # unsigned ends travel as signed ones: they are ordered again by their upper bit
        top = F.lit(-(1 << 63)).cast("long")
        parts = rows.select(*dict.fromkeys(x for x, _, _ in spans)).mapInArrow(dealt, "span long, cell long, n long, a long, b long")
        table = parts.groupBy("span", "cell").agg(F.sum("n").alias("n"), F.min(F.col("a").bitwiseXOR(top)).alias("a"), F.max(F.col("b").bitwiseXOR(top)).alias("b")).toArrow().sort_by([("span", "ascending"), ("cell", "ascending")])
        span, n, a, b = (table.column(c).to_numpy() for c in ("span", "n", "a", "b"))
        index = {s: i for i, s in enumerate(spans)}
        for (x, r), (lo, hi, below) in list(open_.items()):
            first, end = np.searchsorted(span, [index[x, lo, hi], index[x, lo, hi] + 1])
            upto = below + np.cumsum(n[first:end])
            j = int(np.searchsorted(upto, r))
            low, high = (int(v[first + j]) + (1 << 63) for v in (a, b))
            if low == high:
                found[x, r] = _value(low, kinds[x])
                del open_[x, r]
            else:
                open_[x, r] = (low, high, int(upto[j] - n[first + j]))
    return found


def _at(values: pa.ChunkedArray, ranks: list[int]) -> list:
    values = pc.drop_null(values)
    ordered = values.take(pc.sort_indices(values)) if ranks else values
    return [ordered[r - 1].as_py() for r in ranks]


def _inside(x: str, lo, hi) -> Column:
    out = F.col(x).isNotNull()
    out = out if lo is None else out & (F.col(x) > F.lit(lo))
    return out if hi is None else out & (F.col(x) < F.lit(hi))


def _estimate(x: str, rank: int, lo, hi, below: int, inside: int) -> Column:
    p = (rank - below) / inside
    at = F.array(*(F.lit(min(1.0, max(0.0, p + d / ACCURACY))) for d in (-2, 2)))
    return F.percentile_approx(F.when(_inside(x, lo, hi), F.col(x)), at, ACCURACY)


def quantiles(df: DataFrame, columns: dict[str, Column], probabilities: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact quantiles by name, linearly interpolated between ranks; None for a column without values."""

    def ranks(n: int) -> list[int]:
        at = [p * (n - 1) for p in probabilities]
        return [r for a in at for r in (int(np.floor(a)) + 1, int(np.ceil(a)) + 1)] if n else []

    sizes: dict[str, int] = {}

    def noting(name: str) -> Ranks:
        return lambda n: (sizes.__setitem__(name, n), ranks(n))[1]

    found = order_statistics(df, {name: (c, noting(name)) for name, c in columns.items()})
    out: dict[str, list[float] | None] = {}
    for name, values in found.items():
        at = [p * (sizes[name] - 1) for p in probabilities]
        pairs = zip(at, values[::2], values[1::2])
        out[name] = [float(lo) if lo == hi else (np.ceil(a) - a) * float(lo) + (a - np.floor(a)) * float(hi) for a, lo, hi in pairs] if sizes[name] else None
    return out


def grouped_quantiles(df: DataFrame, by: str, value: Column, probabilities: dict[str, float]) -> DataFrame:
    """``by`` and a column for each name of ``probabilities``: exact quantiles of every group, however many there are."""
    counts = df.select(F.col(by), value.alias("__x")).where("__x is not null").groupBy(by, "__x").agg(F.count("*").alias("__n"))
    total = running(counts, [F.col(by).asc_nulls_first(), F.col("__x").asc()], {"__upto": F.col("__n")})
    groups = total.groupBy(F.col(by).alias("__by")).agg(F.sum("__n").alias("__size"), F.min(F.col("__upto") - F.col("__n")).alias("__before"))
    both = total.join(groups, F.col(by).eqNullSafe(F.col("__by")))
    upto = F.col("__upto") - F.col("__before")
    holds = lambda rank: (upto - F.col("__n") < rank) & (rank <= upto)
    out = []
    for name, p in probabilities.items():
        at = F.lit(p) * (F.col("__size") - 1)
        lo, hi = (F.max(F.when(holds(f(at) + 1), F.col("__x"))).cast("double") for f in (F.floor, F.ceil))
        at = F.lit(p) * (F.first("__size") - 1)
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return both.groupBy(by).agg(*out)


def up_to(df: DataFrame, keys: list[str], ranks: Ranks) -> tuple[int, list[Column]]:
    """The number of rows and, for each rank, the condition of the rows up to it in the order of ``keys`` (NULL first).

    The conditions compare a row with literals, so they need no shuffle and hold for any rows. ``keys`` must order
    rows totally where a rank falls between rows.
    """
    n, some = df.agg(F.count("*"), F.count(keys[0])).first()
    return n, _conditions(df, keys, list(ranks(n)), n, some)


def _conditions(df: DataFrame, keys: list[str], ranks: list[int], n: int, some: int) -> list[Column]:
    """Conditions for several ranks among ``n`` rows, of which ``some`` have a leading key."""
    if n * len(keys) <= CELLS:
        return _sorted_here(df.select(*keys).toArrow(), keys, ranks)
    x, nulls = F.col(keys[0]), n - some
    inner = [r for r in ranks if nulls < r < n]
    values = dict(zip(inner, order_statistics(df, {"x": (x, lambda _: [r - nulls for r in inner])})["x"]))
    sizes = df.agg(F.lit(0), *(F.count_if(f(x, F.lit(values[r]))) for r in inner for f in (operator.lt, operator.le))).first()
    out = []
    for r in ranks:
        if r <= 0 or r >= n:
            out.append(F.lit(r >= n))
        elif r <= nulls:
            out.append(x.isNull() & _inner(df.where(x.isNull()), keys[1:], r, nulls))
        else:
            at, v = 1 + 2 * inner.index(r), F.lit(values[r])
            below, upto = sizes[at] + nulls, sizes[at + 1] + nulls
            out.append(x.isNull() | (x < v) | ((x == v) & _inner(df.where(x == v), keys[1:], r - below, upto - below)))
    return out


def _inner(df: DataFrame, keys: list[str], rank: int, n: int) -> Column:
    """The condition for a rank among ``n`` rows that are equal in earlier keys."""
    if rank == n:
        return F.lit(True)
    if not keys:
        raise ValueError("the order is not total: a cut falls between rows that are equal in all keys")
    return _conditions(df, keys, [rank], *df.agg(F.count("*"), F.count(keys[0])).first())[0]


def _sorted_here(rows: pa.Table, keys: list[str], ranks: list[int]) -> list[Column]:
    ordered = pc.sort_indices(rows, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start")
    row = lambda at: [rows.column(k)[ordered[at].as_py()].as_py() for k in keys]
    out = []
    for r in ranks:
        if r <= 0 or r >= rows.num_rows:
            out.append(F.lit(r >= rows.num_rows))
            continue
        if row(r - 1) == row(r):
            raise ValueError("the order is not total: a cut falls between rows that are equal in all keys")
        condition = F.lit(True)
        for k, v in reversed([*zip(keys, row(r - 1))]):
            x = F.col(k)
            condition = x.isNull() & condition if v is None else x.isNull() | (x < F.lit(v)) | ((x == F.lit(v)) & condition)
        out.append(condition)
    return out


def running(df: DataFrame, order: list[Column], columns: dict[str, Column]) -> DataFrame:
    """Adds running totals by name, current row included, in the given order, which should be total.

    Each value of ``columns`` is what its column adds up. ``df`` is evaluated once: its rows are kept, dealt to ranges
    and sorted, while the ranges' sums are taken and then until the session drops them.
    """
    names = {name: f"__r{i}" for i, name in enumerate(columns)}
    dealt = df.withColumns({names[n]: c for n, c in columns.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("__range", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    sums = sorted(dealt.groupBy("__range").agg(*(F.sum(c).alias(c) for c in names.values())).collect())  # as many rows as ranges
    before: dict[int, list] = {}
    total = [0] * len(names)
    for r in sums:
        before[r["__range"]] = total
        total = [t + (v or 0) for t, v in zip(total, r[1:])]
    held, passed, added = list(names.values()), df.columns, list(columns)
    kinds = dict(dealt.select(*held).dtypes)
    kinds = {c: "double" if k in ("double", "float") else "bigint" for c, k in kinds.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ranges = batch.column("__range").to_numpy()
            cuts = [*np.flatnonzero(np.diff(ranges, prepend=-1)).tolist(), len(ranges)]
            for i, j in zip(cuts, cuts[1:]):  # ranges may share a task
                start, part, sums_ = carry.setdefault(int(ranges[i]), list(before[int(ranges[i])])), batch.slice(i, j - i), []
                for k, c in enumerate(held):
                    upto = np.cumsum(pc.fill_null(part.column(c), 0).to_numpy(zero_copy_only=False), dtype=float if kinds[c] == "double" else np.int64) + start[k]
                    start[k] = upto[-1].item()
                    sums_.append(pa.array(upto))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *sums_], [*passed, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` {kinds[c]}" for n, c in names.items())])
    return dealt.mapInArrow(add, schema)


def numbered(df: DataFrame, time: str, ties: list[str], name: str = "rn") -> DataFrame:
    """Adds the row number, from 1, in the order of time and ties (NULL first)."""
    return running(df, [F.col(c).asc() for c in (time, *ties)], {name: F.lit(1).cast("long")})


def falls(df: DataFrame, by: str, value: str) -> bool:
    """Whether ``value`` is ever below an earlier one in the order of ``by``; one number of each range reaches the driver."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, lo, hi = False, None, None
        for batch in batches:
            x = pc.drop_null(batch.column(1)).to_numpy(zero_copy_only=False)
            if len(x):
                bad |= bool((np.diff(x) < 0).any()) or (hi is not None and x[0] < hi)
                lo, hi = x[0] if lo is None else lo, max(x.max(), x[0] if hi is None else hi)
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([bad]), pa.array([float(lo)]), pa.array([float(hi)])], ["part", "bad", "lo", "hi"])

    rows = df.select(by, F.col(value).cast("double").alias("x")).repartitionByRange(F.col(by)).sortWithinPartitions(by)
    found = sorted(rows.mapInArrow(check, "part long, bad boolean, lo double, hi double").collect())
    return any(r["bad"] for r in found) or any(b["lo"] < a["hi"] for a, b in zip(found, found[1:]))

"""Row-local columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import DAY


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, as a double."""
    return F.expr(f"cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`) as double) / 1000000E0")


def amount_log(c: Column) -> Column:
    return F.log1p(c)


def amount_decimal(c: Column) -> Column:
    return c - F.floor(c)


def amount_is_round(c: Column) -> Column:
    return (amount_decimal(c) < F.lit(1e-6)).cast("int")


def decile(c: Column, edges: Column) -> Column:
    """Number of interior edges at or below the value, from 0 to 9; NULL stays NULL."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(c.isNotNull(), F.least(F.size(F.filter(inner, lambda e: e <= c)), F.lit(9)))


def hour_of(t: Column) -> Column:
    return F.pmod(F.floor(t / 3600), F.lit(24)).cast("int")


def weekday_of(t: Column) -> Column:
    return F.pmod(F.floor(t / DAY), F.lit(7)).cast("int")


def is_null(c: Column) -> Column:
    return c.isNull().cast("int")


def ref_day(t: Column, days: Column) -> Column:
    """Day of the event that the offset counts from; NULL offsets stay NULL."""
    return F.floor(t / DAY) - days


def composite_key(*parts: Column) -> Column:
    """Parts as text joined by an underscore, NULL as "NA"; concat_ws alone would merge keys."""
    return F.concat_ws("_", *(F.coalesce(p.cast("string"), F.lit("NA")) for p in parts))


def finite(c: Column) -> Column:
    """NULL for infinite and NaN values."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(c: Column, bound: float = 10.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), c)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def embedding_code(code: Column, cardinality: int) -> Column:
    """Code + 1 as a row of an embedding table: unseen and missing at 0, levels beyond the table at its last row."""
    return F.greatest(F.lit(0), F.least(F.coalesce(code, F.lit(-1)) + 1, F.lit(cardinality - 1))).cast("int")


def embedding_width(cardinality: int) -> int:
    from math import ceil

    return min(16, max(2, ceil(1.6 * cardinality**0.56)))


"""Encoders: statistics fitted on training rows as small tables, applied to all rows by lookup joins.

A lookup table has one row for each level that training rows hold. It is broadcast only when its counted rows
stay under BROADCAST_ROWS, and shuffled by level otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordering

BROADCAST_ROWS = 200_000


def lookup(df: DataFrame, table: DataFrame, level: Column, key: str, value: str, name: str, missing: Column) -> DataFrame:
    """Adds ``name``: the table's value at the level, NULL matching NULL; ``missing`` where the table has none."""
    small = table.select(F.col(key).alias("__level"), F.col(value).alias("__value")).persist()  # one fit for its count and its use
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    joined = df.withColumn("__key", level).join(small, F.col("__key").eqNullSafe(F.col("__level")), "left")
    return joined.select(*df.columns, F.coalesce("__value", missing).alias(name))


def level_tables(train: DataFrame, columns: list[str], time: str, row_id: str) -> tuple[DataFrame, dict[str, int]]:
    """(column, level, n, code) of all columns from one pass over training rows, and the number of levels by column.

    code numbers the non-NULL levels of a column from 0 by first appearance. The table is persisted.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns)))
    levels = train.select(time, row_id, pairs.alias("x")).groupBy("x.column", "x.level").agg(F.count("*").alias("n"), F.min(F.struct(time, row_id)).alias("first"))
    levels = levels.select("column", "level", "n", F.col(f"first.{time}").alias("t"), F.col(f"first.{row_id}").alias("i"))
    rows = ordering.running(levels, [F.col("column").asc(), F.col("level").isNull().asc(), F.col("t").asc(), F.col("i").asc()], {"rn": F.lit(1).cast("long")})
    start = rows.groupBy(F.col("column").alias("__column")).agg(F.min("rn").alias("start"))  # a row for each column
    code = F.when(F.col("level").isNotNull(), F.col("rn") - F.col("start")).cast("int")
    table = rows.join(F.broadcast(start), F.col("column") == F.col("__column")).select("column", "level", "n", code.alias("code")).persist()
    return table, {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}  # a row for each column


def lookup_levels(df: DataFrame, table: DataFrame, sizes: dict[str, int], wanted: dict[str, list[tuple[str, str, int]]], key: str = "{}") -> DataFrame:
    """Adds (name, statistic, missing) columns for each column of ``wanted`` from ``level_tables``.

    A column's levels are broadcast when they are BROADCAST_ROWS or fewer, and joined by a shuffle otherwise.
    """
    for c, outputs in wanted.items():
        small = table.where(F.col("column") == c).select(F.col("level").alias("__level"), *(F.col(stat).alias(f"__v_{name}") for name, stat, _ in outputs))
        if sizes.get(c, 0) <= BROADCAST_ROWS:
            small = F.broadcast(small)
        joined = df.join(small, F.col(key.format(c)).cast("string").eqNullSafe(F.col("__level")), "left")
        df = joined.select(*df.columns, *(F.coalesce(f"__v_{name}", F.lit(missing)).alias(name) for name, _, missing in outputs))
    return df


def frequency_map(train: DataFrame, column: str) -> DataFrame:
    """level, n: NULL is a counted level."""
    return train.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))


def frequency_encode(df: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """Training count of the level; unseen levels 0."""
    return lookup(df, table, F.col(column), "level", "n", name, F.lit(0).cast("long"))


def vocabulary(train: DataFrame, column: str, time: str, row_id: str) -> DataFrame:
    """level, code: levels numbered from 0 by first appearance in (time, id); NULL has no code."""
    levels = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.min(F.struct(time, row_id)).alias("first"))
    levels = levels.select("level", F.col(f"first.{time}").alias("t"), F.col(f"first.{row_id}").alias("i"))
    return ordering.numbered(levels, "t", ["i"], "rn").select("level", (F.col("rn") - 1).cast("int").alias("code"))


def category_code(df: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """Code of the level; NULL and unseen -1."""
    return lookup(df, table, F.col(column), "level", "code", name, F.lit(-1))


def quantile_edges(train: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Distinct exact quantiles, linearly interpolated; bins + 1 numbers at most reach the driver."""
    return sorted(set(ordering.quantiles(train, {"x": F.col(column)}, [i / bins for i in range(bins + 1)])["x"] or []))


def prior(train: DataFrame, label: str) -> float:
    return train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0


def one_hot_levels(train: DataFrame, column: str, cap: int = 25, least: int = 50) -> list | None:
    """Levels with a column of their own; None when there are more than ``cap`` levels, NULL included.

    Levels with under ``least`` rows share the infrequent column.
    """
    counts = frequency_map(train, column).limit(cap + 1).collect()  # cap + 1 rows at most
    if len(counts) > cap:
        return None
    return sorted((r["level"] for r in counts if r["n"] >= least and r["level"] is not None), key=str)


def small_vocabularies(train: DataFrame, columns: list[str], cap: int = 25) -> dict[str, dict]:
    """Counts by level of the columns with ``cap`` levels or fewer, NULL included; one pass finds the columns."""
    if not columns:
        return {}
    sizes = train.agg(*((F.approx_count_distinct(c)).alias(c) for c in columns)).first()
    out = {}
    for c in columns:
        if sizes[c] <= 2 * cap:  # the estimate only spares exact counts of columns that are far too large
            rows = frequency_map(train, c).limit(cap + 1).collect()  # cap + 1 rows at most
            if len(rows) <= cap:
                out[c] = {r["level"]: r["n"] for r in rows}
    return out


def one_hot(df: DataFrame, column: str, levels: list, known: list) -> DataFrame:
    """0/1 columns for ``levels``, one for the other ``known`` levels; unknown levels are zero everywhere."""
    own = [(F.col(column) == F.lit(v)) for v in levels]
    rare = [v for v in known if v not in levels and v is not None]
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.select("*", *(flag(c).alias(f"{column}={v}") for c, v in zip(own, levels)), flag(F.col(column).isin(rare) if rare else F.lit(False)).alias(f"{column}=infrequent"))


def medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; 0 where a column has no value."""
    return {c: q[0] if q else 0.0 for c, q in ordering.quantiles(train, {c: F.col(c) for c in columns}, [0.5]).items()} if columns else {}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in values.items()})


def population_scales(train: DataFrame, columns: list[str], least: float = 1e-9) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) by column; a deviation of ``least`` or less counts as 1."""
    row = train.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) > least else 1.0) for c in columns}


def standardise(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})

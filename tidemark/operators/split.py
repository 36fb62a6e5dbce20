"""Chronological splits and expanding-window folds, as columns keyed by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordering
from tidemark.schema import FOLDS, TEST_FRACTION, VALID_FRACTION


def split_sizes(n: int, valid: float = VALID_FRACTION, test: float = TEST_FRACTION) -> tuple[int, int, int]:
    """Rows of train, valid and test; fractions must lie in [0, 1) and leave some training rows."""
    if valid < 0 or test < 0 or not 0 < valid + test < 1:
        raise ValueError("valid and test must sum to a fraction between 0 and 1")
    n_test, n_valid = round(test * n), round(valid * n)
    return n - n_test - n_valid, n_valid, n_test


def chronological(df: DataFrame, time: str, ties: list[str], valid: float = VALID_FRACTION, test: float = TEST_FRACTION) -> DataFrame:
    """Adds part: train, valid or test, in time order."""
    _, (train, not_test) = ordering.up_to(df, [time, *ties], lambda n: (split_sizes(n, valid, test)[0], n - split_sizes(n, valid, test)[2]) if n else (0, 0))
    return df.withColumn("part", F.when(train, "train").when(not_test, "valid").otherwise("test"))


def block_ends(n: int, blocks: int) -> list[int]:
    """The last row number of each block: n rows in blocks that differ by one row at most, larger ones first."""
    size, more = divmod(n, blocks)
    return [size * (i + 1) + min(i + 1, more) for i in range(blocks)]


def expanding_blocks(df: DataFrame, time: str, ties: list[str], folds: int = FOLDS) -> DataFrame:
    """Adds block 0..folds; fold i trains on blocks up to i and validates on block i + 1. ``df`` has no holdout rows."""
    _, ends = ordering.up_to(df, [time, *ties], lambda n: block_ends(n, folds + 1))
    block = F.lit(folds)
    for i in range(folds - 1, -1, -1):
        block = F.when(ends[i], F.lit(i)).otherwise(block)
    return df.withColumn("block", block.cast("int"))


def fold(df: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("block") <= i), df.where(F.col("block") == i + 1)


def describe_parts(df: DataFrame, time: str, label: str, part: str = "part") -> DataFrame:
    return df.groupBy(part).agg(F.count("*").alias("n"), F.min(time).alias("t_min"), F.max(time).alias("t_max"), F.avg(label).alias("rate"))


def fold_summary(df: DataFrame, time: str, label: str, folds: int = FOLDS) -> DataFrame:
    """Sizes, boundary times and rates of each fold, from one aggregate by block."""
    by = df.groupBy("block").agg(F.count("*").alias("n"), F.sum(label).alias("pos"), F.min(time).alias("lo"), F.max(time).alias("hi"))  # folds + 1 rows
    train, valid = by.alias("a"), by.alias("b")
    joined = train.join(F.broadcast(valid), F.expr("a.block < b.block"))
    out = joined.groupBy(F.col("b.block").alias("block"), F.col("b.n").alias("n_valid"), F.col("b.lo").alias("valid_t_min"), F.col("b.pos").alias("pos")).agg(F.sum("a.n").alias("n_train"), F.max("a.hi").alias("train_t_max"), F.sum("a.pos").alias("train_pos"))
    rate = lambda a, b: F.col(a) / F.col(b).cast("double")
    return out.select((F.col("block") - 1).alias("fold"), "n_train", "n_valid", "train_t_max", "valid_t_min", rate("train_pos", "n_train").alias("train_rate"), rate("pos", "n_valid").alias("valid_rate")).where(F.col("fold") < folds)


def overlap(train: DataFrame, valid: DataFrame, time: str) -> DataFrame:
    """One row: last training time, first validation time, and whether they overlap (equal times do not)."""
    a, b = train.agg(F.max(time).alias("train_t_max")), valid.agg(F.min(time).alias("valid_t_min"))
    return a.join(F.broadcast(b)).withColumn("overlaps", F.coalesce(F.col("train_t_max") > F.col("valid_t_min"), F.lit(False)))


def assert_no_overlap(train: DataFrame, valid: DataFrame, time: str) -> None:
    if overlap(train, valid, time).first()["overlaps"]:
        raise ValueError("training rows lie after validation rows")


def assert_sorted(df: DataFrame, row_id: str, time: str) -> None:
    """Raises unless times never fall in the order of ids."""
    if ordering.falls(df, row_id, time):
        raise ValueError("rows are not sorted by time")


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds __shuffle, a pseudo-random order: the leaky control for a chronological split."""
    return df.withColumn("__shuffle", F.xxhash64(F.col(key), F.lit(seed)).cast("double"))

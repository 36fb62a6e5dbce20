"""Leakage audits: point-in-time values against brute force, invariance to the future, dependence on the fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import ordering, split
from tidemark.plans.features import FeatureBuilder


def brute_force_history(df: DataFrame, keys: list[str], time: str, row_id: str, amount: str, sample: int, seed: int = schema.SEED) -> DataFrame:
    """Prior count and mean of sampled rows by a join on key and t' < t; the sample is the broadcast side."""
    probe = split.sample_rows(df.select(row_id, time, *keys), row_id, sample, seed)
    a, b = F.broadcast(probe).alias("a"), df.select(time, amount, *keys).alias("b")  # ``sample`` rows
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = F.col(f"b.{time}") < F.col(f"a.{time}")
    for s in same:
        cond = cond & s
    found = b.join(a, cond, "inner").groupBy(F.col(f"a.{row_id}").alias(row_id)).agg(F.count("*").alias("n"), F.avg(F.col(f"b.{amount}").cast("double")).alias("mean"))
    return probe.select(row_id).join(found, row_id, "left").select(row_id, F.coalesce("n", F.lit(0)).alias("n"), "mean")


def audit_point_in_time(df: DataFrame, features: DataFrame, prefix: str, keys: list[str], time: str, row_id: str, amount: str, sample: int = 400) -> DataFrame:
    """One row: sampled rows and how many counts and means differ from brute force."""
    brute = brute_force_history(df, keys, time, row_id, amount, sample)
    n, mean = F.col(f"{prefix}_prior_count"), F.col(f"{prefix}_prior_amt_mean")
    close = F.abs(mean - F.col("mean")) <= 1e-3 + 1e-4 * F.abs(F.col("mean"))
    both = features.select(row_id, n, mean).join(F.broadcast(brute), row_id)
    return both.agg(F.count("*").alias("n_checked"), F.count_if(n != F.col("n")).alias("count_mismatches"), F.count_if(~((mean.isNull() & F.col("mean").isNull()) | F.coalesce(close, F.lit(False)))).alias("mean_mismatches"))


def perturbed(df: DataFrame, cut: float = 0.6, seed: int = schema.SEED) -> tuple[DataFrame, DataFrame]:
    """(df with its rows after the cut changed, ids before the cut): labels permuted, amounts 7 a + 13."""
    n_past = round(cut * df.count())
    rows = ordering.numbered(df, schema.TIME, [schema.ID], "__rn")
    past, future = rows.where(F.col("__rn") <= n_past).drop("__rn"), rows.where(F.col("__rn") > n_past)
    mixed = ordering.numbered(future.select(F.xxhash64(schema.ID, F.lit(seed)).cast("double").alias("h"), schema.ID, F.col(schema.TARGET).alias("__y")), "h", [schema.ID], "__rn")
    mixed = mixed.select((F.col("__rn") + n_past).alias("__rn"), "__y")
    changed = future.join(mixed, "__rn").drop("__rn", schema.TARGET).withColumnRenamed("__y", schema.TARGET)
    changed = changed.withColumn(schema.AMOUNT, (F.col(schema.AMOUNT) * 7 + 13).cast(df.schema[schema.AMOUNT].dataType))
    return past.unionByName(changed.select(*df.columns)), past.select(schema.ID)


def changed_cells(one: DataFrame, two: DataFrame, ids: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """feature, n_changed for features in which any row moved, most first; an empty table where none did."""
    names = [c for c in one.columns if c != schema.ID]
    a, b = (x.select(schema.ID, *(F.col(c).alias(f"{p}{c}") for c in names)) for x, p in ((one, "a_"), (two, "b_")))
    both = a.join(b, schema.ID)
    if ids is not None:
        both = both.join(ids, schema.ID, "left_semi")
    moved = lambda c: (F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()) | F.coalesce(F.abs(F.col(f"a_{c}").cast("double") - F.col(f"b_{c}").cast("double")) > tolerance, F.lit(False))
    counts = both.agg(*(F.count_if(moved(c)).alias(c) for c in names))
    rows = counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_changed")) for c in names))))
    return rows.where("n_changed > 0").orderBy(F.desc("n_changed"), "feature")


def audit_future_invariance(df: DataFrame, builder: FeatureBuilder, cut: float = 0.6, seed: int = schema.SEED) -> DataFrame:
    """Features of rows before the cut that move when rows after it change, with one fitted builder."""
    other, past = perturbed(df, cut, seed)
    return changed_cells(builder.transform(df), builder.transform(other), past)


def audit_fit_population(df: DataFrame, train: DataFrame, **options) -> DataFrame:
    """Features that move when statistics are fitted on all rows instead of the training rows."""
    return changed_cells(FeatureBuilder(**options).fit(train).transform(df), FeatureBuilder(**options).fit(df).transform(df))


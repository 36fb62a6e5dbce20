"""Point-in-time features: what was known of an entity strictly before a row.

ROWS frames follow (time, id), so of rows with one time the earlier id counts as before; windowed counts and
target encodings use RANGE frames and leave ties out. ``strict_ties`` leaves ties out everywhere. All columns of
one entity come from one select, so they share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import DAY

FIRST = Window.unboundedPreceding


def windowed_count(keys: list[str], time: str, seconds: float) -> Column:
    """Rows of the entity with t - seconds <= t' < t."""
    g = Window.partitionBy(*keys).orderBy(time)
    return F.count("*").over(g.rangeBetween(-int(seconds), 0)) - F.count("*").over(g.rangeBetween(0, 0))


def entity_columns(prefix: str, keys: list[str], time: str, row_id: str, amount: str, strict_ties: bool = False) -> dict[str, Column]:
    """The seven features of an entity, by name; amount features follow the double value of ``amount``.

    ``strict_ties`` takes rows a second earlier at least, so it is for times in whole seconds.
    """
    p = Window.partitionBy(*keys)
    g, r = p.orderBy(time), p.orderBy(time, row_id)
    x = F.col(amount).cast("double")
    if strict_ties:
        prior = g.rangeBetween(FIRST, -1)
        since = F.col(time) - F.max(time).over(prior)
    else:
        prior = r.rowsBetween(FIRST, -1)
        since = F.col(time) - F.lag(time).over(r)
    n, mean, spread = F.count("*").over(prior), F.avg(x).over(prior), F.stddev_pop(x).over(prior)
    return {
        f"{prefix}_prior_count": n,
        f"{prefix}_prior_amt_mean": mean,
        f"{prefix}_prior_amt_std": spread,
        f"{prefix}_amt_to_prior_mean": F.when(mean > 0, x / mean),
        f"{prefix}_secs_since_prev": since,
        f"{prefix}_prior_count_24h": windowed_count(keys, time, DAY),
        f"{prefix}_prior_count_7d": windowed_count(keys, time, 7 * DAY),
    }


def entity_block(df: DataFrame, prefix: str, keys: list[str], time: str, row_id: str, amount: str, strict_ties: bool = False) -> DataFrame:
    return df.select("*", *(c.alias(n) for n, c in entity_columns(prefix, keys, time, row_id, amount, strict_ties).items()))


def exact_prior_mean(keys: list[str], time: str, row_id: str, cents: str) -> Column:
    """Mean of earlier amounts from whole cents: the same double on any engine."""
    prior = Window.partitionBy(*keys).orderBy(time, row_id).rowsBetween(FIRST, -1)
    return F.sum(cents).over(prior).cast("double") / F.lit(100.0) / F.nullif(F.count("*").over(prior), F.lit(0).cast("long"))


def strict_prior_count(keys: list[str], time: str) -> Column:
    g = Window.partitionBy(*keys).orderBy(time)
    return F.count("*").over(g.rangeBetween(FIRST, 0)) - F.count("*").over(g.rangeBetween(0, 0))


def row_prior_count(keys: list[str], time: str, row_id: str) -> Column:
    return F.count("*").over(Window.partitionBy(*keys).orderBy(time, row_id).rowsBetween(FIRST, -1))


def _levels(df: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """(place, level, *more): a row for each row and column; NULL is a level."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.col(c).cast("string").alias("level")) for i, c in enumerate(columns))))
    return df.select(pairs.alias("x"), *(c.alias(n) for n, c in more.items())).select("x.place", "x.level", *more)


def _pivoted(found: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """One row per id: {column}_seen and {column}_te."""
    at = lambda c, i: F.max(F.when(F.col("place") == i, F.col(c)))
    return found.groupBy(F.col("__id").alias(row_id)).agg(*(at(kind, i).alias(f"{c}_{kind}") for i, c in enumerate(columns) for kind in ("seen", "te")))


def _smoothed(n: Column, s: Column, prior: float, smoothing: float) -> Column:
    weight = n + F.lit(float(smoothing))
    return F.when(weight > 0, (s + F.lit(prior * smoothing)) / weight).otherwise(F.lit(float(prior)))


def lagged_target_encoding(df: DataFrame, row_id: str, time: str, label: str, columns: list[str], prior: float, lag_seconds: float, smoothing: float, span: float = DAY) -> DataFrame:
    """Per row id and column, {column}_seen and {column}_te: rows of the level with t' < t - lag, strictly, and
    (sum y + prior k) / (n + k) over them; without rows and k the prior. Ids must be unique.

    Labels are events at their time, rows are questions at theirs less the lag. Both are dealt by level and ``span``
    of time, so the rows of a frequent level are spread over tasks; a level's spans are added up as one row each.
    """
    y, t = F.col(label).cast("double"), F.col(time).cast("double")
    events = _levels(df, columns, __t=t, __y=y).select("place", "level", F.lit(None).cast(df.schema[row_id].dataType).alias("__id"), "__t", "__y", F.lit(1).alias("event"))
    questions = _levels(df, columns, __id=F.col(row_id), __t=t - F.lit(float(lag_seconds))).select("place", "level", "__id", "__t", F.lit(None).cast("double").alias("__y"), F.lit(0).alias("event"))
    both = events.union(questions).withColumn("span", F.floor(F.col("__t") / F.lit(float(span))))
    keys = ["place", "level", "span"]
    sums = both.groupBy(*keys).agg(F.sum("event").alias("n"), F.sum("__y").alias("s"))
    earlier = Window.partitionBy("place", "level").orderBy("span").rowsBetween(FIRST, -1)
    before = sums.select(F.col("place").alias("p"), F.col("level").alias("l"), F.col("span").alias("d"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s"))
    inside = Window.partitionBy(*keys).orderBy("__t", "event").rowsBetween(FIRST, 0)  # of one time, questions come first
    counted = both.select(*keys, "__id", "event", F.sum("event").over(inside).alias("own_n"), F.coalesce(F.sum("__y").over(inside), F.lit(0.0)).alias("own_s")).where("event = 0")
    same = (F.col("place") == F.col("p")) & F.col("level").eqNullSafe(F.col("l")) & F.col("span").eqNullSafe(F.col("d"))
    n, s = F.col("own_n") + F.col("n"), F.col("own_s") + F.col("s")
    return _pivoted(counted.join(before, same).select("place", "__id", n.alias("seen"), _smoothed(n, s, prior, smoothing).alias("te")), row_id, columns)


def full_target_encoding(df: DataFrame, row_id: str, label: str, columns: list[str], prior: float, smoothing: float) -> DataFrame:
    """The same over all rows of the level: the leaky control, never a feature. One row per level is joined back."""
    levels = _levels(df, columns, __id=F.col(row_id), __y=F.col(label).cast("double"))
    table = levels.groupBy(F.col("place").alias("p"), F.col("level").alias("l")).agg(F.count("*").alias("n"), F.coalesce(F.sum("__y"), F.lit(0.0)).alias("s"))
    joined = levels.join(table, (F.col("place") == F.col("p")) & F.col("level").eqNullSafe(F.col("l")))
    return _pivoted(joined.select("place", "__id", F.col("n").alias("seen"), _smoothed(F.col("n"), F.col("s"), prior, smoothing).alias("te")), row_id, columns)

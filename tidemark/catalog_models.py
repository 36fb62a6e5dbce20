"""Queries that build the feature matrix, run audits, fit models and run the evaluation harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.catalog import DAY, EVENTS, PARTS, events, query, r6, table
from tidemark.models.gbm import GbmModel
from tidemark.models.linear import LinearModel
from tidemark.models.mlp import MlpModel
from tidemark.operators import metrics, profile, split
from tidemark.plans import audit, evaluate, features
from tidemark.sources import tables

BASE = f"""{EVENTS}, tx as (select event_id as "TransactionID", t as "TransactionDT", y as "isFraud", amount as "TransactionAmt", k as "card4", user_id as card1 from ev)"""


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Events in the shape of the transaction table; the label is never a feature."""
    ev = events(spark, d)
    k = F.col("k").cast("int")
    out = ev.select(F.col("event_id").alias(schema.ID), F.col("t").alias(schema.TIME), F.col("y").alias(schema.TARGET), F.col("amount").alias(schema.AMOUNT), F.when(k % 3 == 0, "W").when(k % 3 == 1, "C").otherwise("H").alias("ProductCD"), F.col("user_id").cast("string").alias("card1"), F.when(k % 5 > 0, (k % 5).cast("string")).alias("card2"), F.when(k % 2 == 0, "visa").otherwise("mastercard").alias("card4"), F.when(k % 11 > 2, (k % 11).cast("string")).alias("addr1"), F.col("k").alias("P_emaildomain"), (k % 30).cast("double").alias("D1"), k.cast("double").alias("V1"), (k * 2 + 1).cast("double").alias("V2"), F.col("k").isNotNull().cast("int").alias("has_identity_record"))
    return out.persist()


def _train(df: DataFrame) -> DataFrame:
    return split.chronological(df, schema.TIME, [schema.ID]).where("part = 'train'").drop("part").persist()


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    tx = transactions(spark, d)
    built = features.FeatureBuilder().fit(_train(tx)).transform(tx)
    return tables.stored(tx.select(schema.ID, schema.TIME, schema.TARGET).join(built, schema.ID))


@query(f"""with {BASE} select "TransactionID", round(ln(1 + "TransactionAmt"), 6) as amt_log, cast(floor("TransactionDT" / 3600) % 24 as integer) as dt_hour_assumed,
    count(*) over (partition by card1 order by "TransactionDT", "TransactionID" rows between unbounded preceding and 1 preceding) as uid_card1_prior_count,
    count(*) over (partition by card1 order by "TransactionDT" range between {DAY} preceding and current row) - count(*) over (partition by card1 order by "TransactionDT" range between current row and current row) as uid_card1_prior_count_24h
from tx""")
def feature_matrix(spark, d):
    tx = transactions(spark, d)
    built = features.FeatureBuilder().fit(_train(tx)).transform(tx)
    return built.select(schema.ID, r6(F.col("amt_log"), "amt_log"), "dt_hour_assumed", "uid_card1_prior_count", "uid_card1_prior_count_24h")


@query(f"""with {EVENTS} select a.event_id, count(b.event_id) as n, round(sum(b.cents) / 100.0E0 / nullif(count(b.event_id), 0), 9) as mean
from ev a left join ev b on a.user_id = b.user_id and b.t < a.t group by a.event_id""")
def theta_self_join(spark, d):
    """Brute-force history of every row: the same key and an earlier time."""
    ev = events(spark, d)
    a, b = ev.alias("a"), ev.alias("b")
    joined = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.t") < F.col("a.t")), "left")
    return joined.groupBy(F.col("a.event_id").alias("event_id")).agg(F.count("b.event_id").alias("n"), F.round(F.sum("b.cents") / F.lit(100.0) / F.nullif(F.count("b.event_id"), F.lit(0).cast("long")), 9).alias("mean"))


@query(f"""with {EVENTS}, w as (select event_id, count(*) over r as n, avg(amount) over r as m from ev window r as (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding)),
b as (select a.event_id, count(b.event_id) as n, avg(b.amount) as m from ev a left join ev b on a.user_id = b.user_id and b.t < a.t group by a.event_id)
select least(400, count(*)) as n_checked, count(*) filter (w.n != b.n) as count_mismatches, count(*) filter ((w.m is null) != (b.m is null) or abs(w.m - b.m) > 1e-3 + 1e-4 * abs(b.m)) as mean_mismatches from w join b using (event_id)""")
def audit_pit_theta(spark, d):
    tx = transactions(spark, d)
    built = features.FeatureBuilder().fit(_train(tx)).transform(tx)
    return audit.audit_point_in_time(tx, built, "uid_card1", ["card1"], schema.TIME, schema.ID, schema.AMOUNT)


FITTED = {"card1_freq": "cast(user_id as varchar)", "card2_freq": "case when cast(k as integer) % 5 > 0 then cast(k as integer) % 5 end", "addr1_freq": "case when cast(k as integer) % 11 > 2 then cast(k as integer) % 11 end", "P_emaildomain_freq": "k"}


@query(f"with {EVENTS}, {PARTS}, " + ", ".join(f"x{i} as (select {level} as l, part from pt), f{i} as (select l, count(*) filter (part = 'train') as f, count(*) as g from x{i} group by l)" for i, level in enumerate(FITTED.values())) + ", m as (" + " union all ".join(f"select '{name}' as feature, coalesce(sum(g) filter (f != g), 0)::bigint as n_changed from f{i}" for i, name in enumerate(FITTED)) + ") select * from m where n_changed > 0")
def audit_fit_population(spark, d):
    tx = transactions(spark, d)
    return audit.audit_fit_population(tx, _train(tx)).where(F.col("feature").isin(list(FITTED)))


INVARIANT = """select event_id, count(*) over r as uid_card1_prior_count, round(avg(amount) over r, 6) as uid_card1_prior_amt_mean, count(*) over s as uid_card1_prior_count_24h,
    (coalesce(sum(y) over g, 0) + 2.5) / (count(*) over g + 50) as card1_te
from {0} window r as (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding), s as (partition by user_id order by t range between 86400 preceding and current row exclude group), g as (partition by user_id order by t range between unbounded preceding and 2592001 preceding)"""


@query(f"""with {EVENTS}, k as (select *, row_number() over (order by t, event_id) <= 0.6 * count(*) over () as past from ev),
changed as (select event_id, user_id, t, case when past then amount else amount * 7 + 13 end as amount, case when past then y else 1 - y end as y from k), a as ({INVARIANT.format('ev')}), b as ({INVARIANT.format('changed')}),
m as (""" + " union all ".join(f"select '{c}' as feature, count(*) filter (a.{c} is distinct from b.{c}) as n_changed from a join b using (event_id) join k using (event_id) where past" for c in ("uid_card1_prior_count", "uid_card1_prior_amt_mean", "uid_card1_prior_count_24h", "card1_te")) + ") select * from m where n_changed > 0")
def audit_future_invariance(spark, d):
    tx = transactions(spark, d)
    return audit.audit_future_invariance(tx, features.FeatureBuilder().fit(_train(tx)))


@query()
def audit_planted_leak(spark, d):
    tx = transactions(spark, d)
    return audit.audit_future_invariance(tx, features.FeatureBuilder(target_encoding=features.leaky).fit(_train(tx)))


@query(f"with {EVENTS} select event_id as \"TransactionID\", cast(cast(k as integer) % 30 as float) as \"D1\", cast(k as float) as \"V1\", cast(cast(k as integer) * 2 + 1 as float) as \"V2\" from ev")
def raw_numerics(spark, d):
    """Raw numeric columns pass through the feature builder as floats."""
    tx = transactions(spark, d)
    return features.FeatureBuilder().fit(_train(tx)).transform(tx).select(schema.ID, "D1", "V1", "V2")


def _scored(spark: SparkSession, d: str, model) -> DataFrame:
    matrix = _matrix(spark, d)
    parts = split.chronological(matrix, schema.TIME, [schema.ID]).persist()
    train, valid, test = (parts.where(F.col("part") == p) for p in ("train", "valid", "test"))
    names = features.view_columns([c for c in matrix.columns if c != schema.TARGET], "base")
    model.fit(train, names, schema.TARGET, valid)
    return model.score(test).select(schema.ID, "score")


@query()
def lr_scores(spark, d):
    return _scored(spark, d, LinearModel())


@query()
def gbt_scores(spark, d):
    return _scored(spark, d, GbmModel())


@query()
def mlp_scores(spark, d):
    return _scored(spark, d, MlpModel())


@query()
def run_experiment(spark, d):
    return evaluate.run_experiment(LinearModel, _matrix(spark, d)).per_fold


FIXED = "select '{0}' as model, 'base' as view, avg(m) as cv_mean, stddev_pop(m) as cv_std, max(h) as holdout_average_precision, max(f) as fit_seconds from (select l_linenumber, avg({1}) as m, (select max({1}) from lineitem) as h, 2.0E0 as f from lineitem where l_linenumber <= 5 group by l_linenumber)"


@query(f"select model, view, round(cv_mean, 7) as cv_mean, round(cv_std, 7) as cv_std, holdout_average_precision, fit_seconds from ({FIXED.format('tax', 'l_tax')} union all {FIXED.format('discount', 'l_discount')})")
def results_table(spark, d):
    """The table of results, from fixed figures in the place of models' metrics."""
    lines, out = table(spark, d, "lineitem"), []
    for name, column in (("tax", "l_tax"), ("discount", "l_discount")):
        folds = lines.where("l_linenumber <= 5").groupBy((F.col("l_linenumber") - 1).alias("fold")).agg(F.avg(column).alias("average_precision"))
        holdout = {"average_precision": lines.agg(F.max(column)).first()[0]}
        out.append(evaluate.Experiment(name, "base", folds, holdout, folds, None, None, 2.0))
    return evaluate.results_table(out).withColumns({c: F.round(c, 7) for c in ("cv_mean", "cv_std")})


@query()
def split_leakage(spark, d):
    matrix = _matrix(spark, d)
    return evaluate.split_leakage(LinearModel, matrix, features.view_columns(matrix.columns, "base"), schema.TIME, schema.ID, schema.TARGET)


@query()
def te_leakage(spark, d):
    """Average precision with lagged, zero-lag and full-table target encodings."""
    tx = transactions(spark, d)
    train, out = _train(tx), None
    for arm, options in (("lagged", {}), ("zero_lag", {"lag_days": 0}), ("full_table", {"target_encoding": features.leaky})):
        built = features.FeatureBuilder(**options).fit(train).transform(tx)
        matrix = tables.stored(tx.select(schema.ID, schema.TIME, schema.TARGET).join(built, schema.ID))
        parts = split.chronological(matrix, schema.TIME, [schema.ID])
        model = LinearModel().fit(parts.where("part = 'train'"), features.view_columns(matrix.columns, "base"), schema.TARGET)
        weights = spark.createDataFrame(model.feature_importance(), "feature string, gain double")
        share = profile.gain_share(weights).where("family = 'target encoding'").select("share")
        row = metrics.average_precision(model.score(parts.where("part = 'test'")), "score", schema.TARGET).join(share)
        row = row.select(F.lit(arm).alias("arm"), "average_precision", F.col("share").alias("te_share"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def preprocessing_leakage(spark, d):
    """Average precision with imputation and scales fitted on training rows, and on the rows of all parts; coefficients come from training rows."""
    matrix = _matrix(spark, d)
    parts = split.chronological(matrix, schema.TIME, [schema.ID]).persist()
    train, test = (parts.where(F.col("part") == p) for p in ("train", "test"))
    names, out = [c for c in features.view_columns(matrix.columns, "base") if not c.endswith("_code")], None
    for arm, population in (("train", train), ("train_and_test", parts)):
        model = LinearModel().fit(train, names, schema.TARGET, population=population)
        row = metrics.average_precision(model.score(test), "score", schema.TARGET).select(F.lit(arm).alias("arm"), "average_precision")
        out = row if out is None else out.unionByName(row)
    return out

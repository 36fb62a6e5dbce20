"""All queries of the library over the test tables, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import encode, metrics, ordering, pit, profile, split, unsup
from tidemark.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY, WEEK = 86_400, 604_800
SMOOTHING, LAG = 50.0, WEEK


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where SQL can say it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- the frames that queries start from, and the same as SQL


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events as facts: seconds t, whole cents, amount, label y (errors), level k (NULL where it divides by 7)."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", "user_id", scalar.epoch_seconds("ts").alias("t"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.col("value").alias("amount"), (F.col("event_type") == "error").cast("int").alias("y"), F.when(k.cast("int") % 7 != 0, k).alias("k"))


EVENTS = """ev as (
    select event_id, user_id, cast(epoch_us(ts) as double) / 1000000 as t, cast(round(value * 100) as bigint) as cents, value as amount,
        case when event_type = 'error' then 1 else 0 end as y,
        case when cast(json_extract_string(props, '$.k') as integer) % 7 != 0 then json_extract_string(props, '$.k') end as k
    from events)"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", scalar.epoch_seconds("o_orderdate").alias("t"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


ORDERS = """od as (
    select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, cast(epoch_us(o_orderdate) as double) / 1000000 as t, cast(round(o_totalprice * 100) as bigint) as cents
    from orders)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Line items as scored rows: s between 0 and 1 with ties, label y (returned)."""
    s = ((F.col("l_quantity").cast("long") * 7 + F.col("l_partkey") * 3) % 997).cast("double") / 1000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", s.alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


SCORES = """sc as (
    select l_orderkey, l_linenumber, l_linestatus, cast((cast(l_quantity as bigint) * 7 + l_partkey * 3) % 997 as double) / 1000 as s,
        case when l_returnflag = 'R' then 1 else 0 end as y
    from lineitem)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents LEFT JOIN labels with the match flag."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return tables.left_join(docs, table(spark, d, "labels"), "doc_id", "has_label")


LABELLED = """dl as (
    select d.doc_id, lang, source, n_chars, quality, toxic, case when l.doc_id is null then 0 else 1 end as has_label
    from documents d left join labels l on d.doc_id = l.doc_id)"""

PARTS = """n as (select count(*) as n from ev),
pt as (select ev.*, row_number() over (order by t, event_id) as rn, case
        when row_number() over (order by t, event_id) <= n - round_even(0.2 * n, 0) - round_even(0.15 * n, 0) then 'train'
        when row_number() over (order by t, event_id) <= n - round_even(0.2 * n, 0) then 'valid' else 'test' end as part
    from ev, n)"""


def parted(spark: SparkSession, d: str) -> DataFrame:
    return split.chronological(events(spark, d), "t", ["event_id"])


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# --- point-in-time windows


@query(f"""with {EVENTS}, w as (
    select *, count(*) over r as n, sum(cents) over r as c, stddev_pop(amount) over r as sd, t - lag(t) over (partition by user_id order by t, event_id) as since,
        count(*) over (partition by user_id order by t range between {DAY} preceding and current row) - count(*) over g0 as n24,
        count(*) over (partition by user_id order by t range between {WEEK} preceding and current row) - count(*) over g0 as n7
    from ev
    window r as (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding),
        g0 as (partition by user_id order by t range between current row and current row))
select event_id, n as prior_count, round(cast(c as double) / 100 / nullif(n, 0), 9) as prior_mean, round(sd, 4) as prior_std,
    round(case when c > 0 then amount / (cast(c as double) / 100 / nullif(n, 0)) end, 6) as to_prior_mean, since as secs_since_prev, n24 as prior_count_24h, n7 as prior_count_7d
from w""")
def pit_entity_block(spark, d):
    block = pit.entity_columns("u", ["user_id"], "t", "event_id", "amount")
    return events(spark, d).select("event_id", block["u_prior_count"].alias("prior_count"), F.round(block["u_prior_amt_mean"], 9).alias("prior_mean"), F.round(block["u_prior_amt_std"], 4).alias("prior_std"), r6(block["u_amt_to_prior_mean"], "to_prior_mean"), block["u_secs_since_prev"].alias("secs_since_prev"), block["u_prior_count_24h"].alias("prior_count_24h"), block["u_prior_count_7d"].alias("prior_count_7d"))


@query(f"""with {EVENTS} select event_id,
    count(*) over (partition by user_id order by t range between 3600 preceding and current row) - count(*) over (partition by user_id order by t range between current row and current row) as n_hour,
    count(*) over (partition by user_id order by t range between {DAY} preceding and current row) - count(*) over (partition by user_id order by t range between current row and current row) as n_day
from ev""")
def pit_windowed_counts(spark, d):
    return events(spark, d).select("event_id", pit.windowed_count(["user_id"], "t", 3600).alias("n_hour"), pit.windowed_count(["user_id"], "t", DAY).alias("n_day"))


@query(f"""with {ORDERS} select o_orderkey, cast(sum(cents) over w as double) / 100 / nullif(count(*) over w, 0) as prior_mean from od
window w as (partition by o_custkey order by t, o_orderkey rows between unbounded preceding and 1 preceding)""")
def pit_prior_mean_exact(spark, d):
    return orders(spark, d).select("o_orderkey", pit.exact_prior_mean(["o_custkey"], "t", "o_orderkey", "cents").alias("prior_mean"))


@query(f"""with {ORDERS} select o_orderkey,
    count(*) over (partition by o_custkey order by t, o_orderkey rows between unbounded preceding and 1 preceding) as n_rows,
    count(*) over (partition by o_custkey order by t range between unbounded preceding and current row) - count(*) over (partition by o_custkey order by t range between current row and current row) as n_strict
from od""")
def pit_ties_strict_vs_rows(spark, d):
    return orders(spark, d).select("o_orderkey", pit.row_prior_count(["o_custkey"], "t", "o_orderkey").alias("n_rows"), pit.strict_prior_count(["o_custkey"], "t").alias("n_strict"))


def nested_keys(name: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"count(*) over (partition by {k} order by t, o_orderkey rows between unbounded preceding and 1 preceding) as {name}"


@query(f"""with {ORDERS} select o_orderkey, {nested_keys('n1', ['o_custkey'])}, {nested_keys('n2', ['o_custkey', 'o_orderstatus'])}, {nested_keys('n3', ['o_custkey', 'o_orderstatus', 'o_orderpriority'])} from od""")
def pit_nested_entities(spark, d):
    keys = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return orders(spark, d).select("o_orderkey", *(pit.row_prior_count(keys[:i], "t", "o_orderkey").alias(f"n{i}") for i in (1, 2, 3)))


def te_sql(lag: int) -> str:
    a, b = f"range between unbounded preceding and {lag} preceding", f"range between {lag} preceding and {lag} preceding"
    return f"""with {EVENTS}, {PARTS}, p as (select avg(cast(y as double)) as p from pt where part = 'train'), w as (
    select event_id, count(*) over a - count(*) over b as n, coalesce(sum(y) over a, 0) - coalesce(sum(y) over b, 0) as s
    from ev window a as (partition by k order by t {a}), b as (partition by k order by t {b}))
select event_id, n as n_seen, round((s + p * {SMOOTHING:g}) / (n + {SMOOTHING:g}), 6) as te from w, p"""


def _te(spark, d, lag):
    prior = encode.prior(parted(spark, d).where("part = 'train'"), "y")
    out = pit.lagged_target_encoding(events(spark, d), "event_id", "t", "y", ["k"], prior, lag, SMOOTHING)
    return out.select("event_id", F.col("k_seen").alias("n_seen"), r6(F.col("k_te"), "te"))


@query(te_sql(LAG))
def te_lagged(spark, d):
    return _te(spark, d, LAG)


@query(te_sql(0).replace("0 preceding and 0 preceding", "current row and current row").replace("unbounded preceding and 0 preceding", "unbounded preceding and current row"))
def te_zero_lag(spark, d):
    return _te(spark, d, 0)


@query(f"""with {EVENTS}, p as (select avg(cast(y as double)) as p from ev)
select event_id, round((sum(y) over (partition by k) + p * {SMOOTHING:g}) / (count(*) over (partition by k) + {SMOOTHING:g}), 6) as te from ev, p""")
def te_full_leaky(spark, d):
    ev = events(spark, d)
    return pit.full_target_encoding(ev, "event_id", "y", ["k"], encode.prior(ev, "y"), SMOOTHING).select("event_id", r6(F.col("k_te"), "te"))


# --- splits


@query(f"with {EVENTS}, {PARTS} select event_id, part from pt")
def split_chronological(spark, d):
    return parted(spark, d).select("event_id", "part")


@query(f"with {EVENTS}, {PARTS} select part, count(*) as n, min(t) as t_min, max(t) as t_max, round(avg(y), 6) as rate from pt group by part")
def split_describe(spark, d):
    return split.describe_parts(parted(spark, d), "t", "y").withColumn("rate", F.round("rate", 6))


FOLD_SQL = f"{EVENTS}, {PARTS}, bl as (select event_id, t, y, cast(ntile(6) over (order by t, event_id) - 1 as integer) as block from pt where part != 'test')"


def _blocks(spark, d):
    return split.expanding_blocks(parted(spark, d).where("part != 'test'"), "t", ["event_id"])


@query(f"with {FOLD_SQL} select event_id, block from bl")
def folds_expanding(spark, d):
    return _blocks(spark, d).select("event_id", "block")


@query(f"""with {FOLD_SQL}, b as (select block, count(*) as n, sum(y) as pos, min(t) as lo, max(t) as hi from bl group by block)
select v.block - 1 as fold, sum(a.n) as n_train, v.n as n_valid, max(a.hi) as train_t_max, v.lo as valid_t_min, round(sum(a.pos) / cast(sum(a.n) as double), 6) as train_rate, round(v.pos / cast(v.n as double), 6) as valid_rate
from b a join b v on a.block < v.block group by v.block, v.n, v.lo, v.pos""")
def fold_summary(spark, d):
    return split.fold_summary(_blocks(spark, d), "t", "y").withColumns({"train_rate": F.round("train_rate", 6), "valid_rate": F.round("valid_rate", 6)})


@query(f"with {EVENTS}, {PARTS} select (select max(t) from pt where part = 'train') as train_t_max, (select min(t) from pt where part = 'valid') as valid_t_min, (select max(t) from pt where part = 'train') > (select min(t) from pt where part = 'valid') as overlaps")
def overlap_guard(spark, d):
    parts = parted(spark, d)
    return split.overlap(parts.where("part = 'train'"), parts.where("part = 'valid'"), "t")


@query(f"with {EVENTS}, {PARTS} select event_id, amount from pt where part = 'train' and amount >= 50")
def filter_train_rows(spark, d):
    return parted(spark, d).where("part = 'train' and amount >= 50").select("event_id", "amount")


# --- joins and missingness


@query("select count(*) as n, count(l.doc_id) as n_matched, count(l.doc_id) / cast(count(*) as double) as match_rate from documents d left join labels l on d.doc_id = l.doc_id")
def left_join_match_rate(spark, d):
    return tables.match_rate(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query(f"with {LABELLED} select * from dl")
def left_join_flagged(spark, d):
    return labelled(spark, d).select("doc_id", "lang", "source", "n_chars", "quality", "toxic", "has_label")


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 1")
def one_to_one_check(spark, d):
    return tables.duplicated_keys(table(spark, d, "orders"), "o_custkey")


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def semi_join_pruned(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query(f"with {LABELLED} select doc_id, case when quality is null then 1 else 0 end as quality_isnull, case when toxic is null then 1 else 0 end as toxic_isnull from dl")
def isnull_indicators(spark, d):
    return labelled(spark, d).select("doc_id", *(scalar.is_null(F.col(c)).alias(f"{c}_isnull") for c in ("quality", "toxic")))


def _by_column(template: str, columns: tuple[str, ...] = ("quality", "toxic", "n_chars")) -> str:
    return " union all ".join(template.format(c=c) for c in columns)


@query(f"with {LABELLED} " + _by_column("select '{c}' as \"column\", round(avg(case when {c} is null then 1.0E0 else 0 end), 6) as missing_rate, round(avg(case when has_label = 1 then case when {c} is null then 1.0E0 else 0 end end), 6) as rate_matched, round(avg(case when has_label = 0 then case when {c} is null then 1.0E0 else 0 end end), 6) as rate_unmatched, round(case when count({c}) in (0, count(*)) then null else corr(case when {c} is null then 1.0E0 else 0 end, 1.0E0 - has_label) end, 6) as phi from dl"))
def missingness_phi(spark, d):
    out = profile.missingness_phi(labelled(spark, d), ["quality", "toxic", "n_chars"], "has_label")
    return out.select("column", *(F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c) for c in ("missing_rate", "rate_matched", "rate_unmatched", "phi")))


@query(f"with {LABELLED}, f as (select *, case when n_chars > 1500 then 1 else 0 end as y from dl) " + _by_column("select '{c}' as \"column\", round(0.5E0 + 0.5E0 * (avg(case when y = 1 then case when {c} is null then 1.0E0 else 0 end end) - avg(case when y = 0 then case when {c} is null then 1.0E0 else 0 end end)), 6) as auc, round(abs(0.5E0 * (avg(case when y = 1 then case when {c} is null then 1.0E0 else 0 end end) - avg(case when y = 0 then case when {c} is null then 1.0E0 else 0 end end))), 6) as lift from f", ("quality", "toxic")))
def isnull_auc_scan(spark, d):
    df = labelled(spark, d).withColumn("y", (F.col("n_chars") > 1500).cast("int"))
    return metrics.indicator_auc(df, ["quality", "toxic"], "y").select("column", r6(F.col("auc"), "auc"), r6(F.col("lift"), "lift"))


@query(f"with {LABELLED}, m as (" + _by_column("select '{c}' as c, avg(case when {c} is null then 1.0E0 else 0 end) as r from dl", ("quality", "toxic", "n_chars", "lang")) + ") select cast(case when r <= 0 then 0 when r <= 0.01 then 1 when r <= 0.1 then 2 when r <= 0.5 then 3 when r <= 0.9 then 4 else 5 end as integer) as bucket, count(*) as n_columns from m group by 1")
def missing_rate_buckets(spark, d):
    return profile.missing_buckets(labelled(spark, d), ["quality", "toxic", "n_chars", "lang"])


@query(f"with {LABELLED}, m as (" + _by_column("select '{c}' as c, avg(case when {c} is null then 1.0E0 else 0 end) as r from dl", ("quality", "toxic", "n_chars", "lang")) + ') select c as "column", round(r, 6) as missing_rate from m where r between 0.005 and 0.995')
def partly_missing_columns(spark, d):
    return profile.partly_missing(labelled(spark, d), ["quality", "toxic", "n_chars", "lang"]).select("column", r6(F.col("missing_rate"), "missing_rate"))


@query(f"with {LABELLED}, m as (" + " union all ".join(f"select {i} as place, '{c}' as c, md5(string_agg(case when {c} is null then '1' else '0' end, '' order by doc_id)) as mask from dl" for i, c in enumerate(("quality", "toxic", "n_chars", "lang"))) + '), f as (select mask, min(place) as first from m group by mask) select c as "column", cast(dense_rank() over (order by first) - 1 as integer) as "group" from m join f using (mask)')
def null_mask_groups(spark, d):
    return unsup.null_mask_groups(labelled(spark, d), "doc_id", ["quality", "toxic", "n_chars", "lang"])


# --- encoders and row-local columns


@query(f"with {EVENTS}, {PARTS}, f as (select k, count(*) as n from pt where part = 'train' group by k) select event_id, coalesce(n, 0) as k_freq from ev left join f on ev.k is not distinct from f.k")
def freq_encode(spark, d):
    parts = parted(spark, d)
    return encode.frequency_encode(parts, encode.frequency_map(parts.where("part = 'train'"), "k"), "k", "k_freq").select("event_id", "k_freq")


@query(f"with {EVENTS}, {PARTS}, v as (select k, row_number() over (order by min(rn)) - 1 as code from pt where part = 'train' and k is not null group by k) select event_id, cast(coalesce(code, -1) as integer) as k_code from ev left join v on ev.k = v.k")
def category_code(spark, d):
    parts = parted(spark, d)
    return encode.category_code(parts, encode.vocabulary(parts.where("part = 'train'"), "k", "t", "event_id"), "k", "k_code").select("event_id", "k_code")


@query(f"with {EVENTS} select event_id, round(ln(1 + amount), 6) as amt_log, round(amount - floor(amount), 6) as amt_decimal, case when amount - floor(amount) < 1e-6 then 1 else 0 end as amt_is_round from ev")
def amount_features(spark, d):
    a = F.col("amount")
    return events(spark, d).select("event_id", r6(scalar.amount_log(a), "amt_log"), r6(scalar.amount_decimal(a), "amt_decimal"), scalar.amount_is_round(a).alias("amt_is_round"))


@query(f"""with {EVENTS}, {PARTS}, e as (select list_sort(list_distinct(quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as e from pt where part = 'train')
select event_id, cast(len(list_filter(e, lambda x: x <= amount)) as integer) as amt_decile from ev, e""")
def amount_decile(spark, d):
    parts = parted(spark, d)
    edges = encode.quantile_edges(parts.where("part = 'train'"), "amount")
    return parts.select("event_id", scalar.decile(F.col("amount"), F.array(*map(F.lit, edges))).alias("amt_decile"))


@query(f"with {EVENTS} select event_id, cast(floor(t / 3600) % 24 as integer) as hour_assumed, cast(floor(t / 86400) % 7 as integer) as dow_assumed from ev")
def assumed_calendar(spark, d):
    return events(spark, d).select("event_id", scalar.hour_of(F.col("t")).alias("hour_assumed"), scalar.weekday_of(F.col("t")).alias("dow_assumed"))


@query(f"with {EVENTS} select event_id, cast(floor(t / 86400) as bigint) - cast(k as bigint) as k_ref_day from ev")
def ref_day(spark, d):
    return events(spark, d).select("event_id", scalar.ref_day(F.col("t"), F.col("k").cast("long")).alias("k_ref_day"))


@query(f"with {EVENTS} select event_id, concat(cast(user_id as varchar), '_', coalesce(k, 'NA')) as user_x_k from ev")
def interaction_keys(spark, d):
    return events(spark, d).select("event_id", scalar.composite_key(F.col("user_id"), F.col("k")).alias("user_x_k"))


@query(f"with {EVENTS} select event_id, case when y = 0 and amount < 100 then greatest(-10, least(10, amount)) end as clipped, cast(greatest(0, least(49, coalesce(cast(k as integer), -1) + 1)) as integer) as embedding_row from ev")
def clip_and_embedding_code(spark, d):
    amount = scalar.finite(F.when((F.col("y") == 0) & (F.col("amount") < 100), F.col("amount")).otherwise(F.lit(float("inf"))))
    return events(spark, d).select("event_id", scalar.clip(amount).alias("clipped"), scalar.embedding_code(F.col("k").cast("int"), 50).alias("embedding_row"))


@query("""with m as (select l_linestatus, case when l_linenumber <= 2 then null else l_quantity end as q from lineitem), v as (select quantile_cont(q, 0.5) as med from m)
select l_linestatus, count(*) as n, sum(coalesce(q, med)) as total, max(med) as median from m, v group by l_linestatus""")
def median_impute(spark, d):
    df = table(spark, d, "lineitem").select("l_linestatus", F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("q"))
    values = encode.medians(df, ["q"])
    return encode.impute(df, values).groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum("q").alias("total"), F.max(F.lit(values["q"])).alias("median"))


@query(f"with {EVENTS}, {PARTS}, m as (select avg(amount) as m, stddev_pop(amount) as s from pt where part = 'train') select event_id, round((amount - m) / s, 5) as z from ev, m")
def standardise_pop(spark, d):
    parts = parted(spark, d)
    scales = encode.population_scales(parts.where("part = 'train'"), ["amount"])
    return encode.standardise(parts, scales).select("event_id", F.round("amount", 5).alias("z"))


@query(f"with {ORDERS} select o_orderkey, " + ", ".join(f"""cast(o_orderpriority = '{p}' as integer) as "p={p}\"""" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + """, cast(o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') as integer) as "p=infrequent" from od""")
def one_hot(spark, d):
    df = orders(spark, d).select("o_orderkey", F.col("o_orderpriority").alias("p"))
    levels = encode.one_hot_levels(df, "p") or []
    return encode.one_hot(df, "p", levels, levels).drop("p")


@query("""with p as (select o_orderkey, case when o_orderkey <= 30 then 'rare a' when o_orderkey <= 60 then 'rare b' else o_orderstatus end as p from orders), n as (select p, count(*) as n from p group by p)
select o_orderkey, cast(p.p = 'F' as integer) as "p=F", cast(p.p = 'O' as integer) as "p=O", cast(p.p = 'P' as integer) as "p=P", cast(n < 50 as integer) as "p=infrequent" from p join n on p.p = n.p""")
def one_hot_pooled(spark, d):
    """Levels with under 50 rows share one column."""
    key = F.col("o_orderkey")
    df = table(spark, d, "orders").select(key, F.when(key <= 30, "rare a").when(key <= 60, "rare b").otherwise(F.col("o_orderstatus")).alias("p"))
    counts = encode.small_vocabularies(df, ["p"])["p"]
    return encode.one_hot(df, "p", encode.one_hot_levels(df, "p") or [], list(counts)).drop("p")


@query("""with m as (select l_orderkey, l_linenumber, case when l_linenumber > 2 then l_quantity end as q, l_extendedprice as x, cast(null as double) as z from lineitem),
v as (select quantile_cont(q, 0.5) as mq, quantile_cont(x, 0.5) as mx from m), f as (select l_orderkey, l_linenumber, coalesce(q, mq) as q, coalesce(x, mx) as x, coalesce(z, 0) as z from m, v),
s as (select avg(q) as aq, stddev_pop(q) as sq, avg(x) as ax, stddev_pop(x) as sx from f)
select l_orderkey, l_linenumber, round((q - aq) / sq, 5) as q, round((x - ax) / sx, 5) as x, cast(z as double) as z from f, s""")
def v_prepared(spark, d):
    """Median imputation and population scaling of a group of columns, one of them without any value."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("x"), F.lit(None).cast("double").alias("z"))
    ready = unsup.GroupCompressor({0: ["q", "x", "z"]}).fit_scales(df).prepared(df)
    return ready.select("l_orderkey", "l_linenumber", *(F.round(c, 5).alias(c) for c in ("q", "x", "z")))


# --- metrics

CURVE = f"{SCORES}, g as (select s, count(*) as n, sum(y) as tp from sc group by s), c as (select *, sum(n) over d as cum_n, sum(tp) over d as cum_tp, sum(n - tp) over a as cum_fp from g window d as (order by s desc), a as (order by s)), tot as (select sum(tp) as p, sum(n - tp) as neg from g)"
AP = "(select sum(tp * (cum_tp / cast(cum_n as double))) / max(p) from c, tot)"


@query(f"with {CURVE} select round({AP}, 9) as average_precision")
def metric_average_precision(spark, d):
    return metrics.average_precision(scores(spark, d), "s", "y").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"with {CURVE} select round(sum(tp * (cum_fp - (n - tp) * 0.5E0)) / (cast(max(p) as double) * max(neg)), 9) as roc_auc from c, tot")
def metric_roc_auc(spark, d):
    return metrics.roc_auc(scores(spark, d), "s", "y").select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"with {CURVE} select round((select avg(cast(y as double)) from sc), 9) as base_rate, round((select avg((greatest(0, least(1, s)) - y) * (greatest(0, least(1, s)) - y)) from sc), 7) as brier, round({AP} / (select avg(cast(y as double)) from sc), 7) as lift")
def metric_brier_lift(spark, d):
    return metrics.brier_and_lift(scores(spark, d), "s", "y").select(F.round("base_rate", 9).alias("base_rate"), F.round("brier", 7).alias("brier"), F.round("lift", 7).alias("lift"))


@query(f"""with {SCORES}, q as (select quantile_cont(s, 0.99) as thr from sc), f as (select count(*) filter (s >= thr) as n_flagged, coalesce(sum(y) filter (s >= thr), 0) as hit, sum(y) as pos, max(thr) as thr from sc, q)
select round(thr, 9) as threshold, n_flagged, round(hit / cast(n_flagged as double), 9) as precision, round(hit / cast(pos as double), 9) as recall, round(2 * hit / cast(n_flagged + pos as double), 9) as f1 from f""")
def metric_budget(spark, d):
    return metrics.at_budget(scores(spark, d), "s", "y").select("n_flagged", *(F.round(c, 9).alias(c) for c in ("threshold", "precision", "recall", "f1")))


@query(f"with {CURVE}, f as (select s, 2 * cum_tp / cast(cum_n + p as double) as f1 from c, tot) select s as threshold, round(f1, 9) as oracle_f1 from f order by f1 desc, s asc limit 1")
def metric_oracle_f1(spark, d):
    return metrics.oracle_f1(scores(spark, d), "s", "y").select("threshold", F.round("oracle_f1", 9).alias("oracle_f1"))


@query(f"""with {SCORES}, e as (select list_sort(list_distinct(quantile_cont(s, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from sc),
b as (select *, greatest(0, len(list_filter(e, lambda x: x < s)) - 1) as bin from sc, e)
select cast(bin as integer) as bin, count(*) as n, round(avg(s), 6) as mean_pred, round(avg(cast(y as double)), 6) as observed, round(avg(s) - avg(cast(y as double)), 6) as gap from b group by bin""")
def calibration_table(spark, d):
    return metrics.calibration_table(scores(spark, d), "s", "y").select("bin", "n", *(F.round(c, 6).alias(c) for c in ("mean_pred", "observed", "gap")))


@query(f"""with {SCORES}, q as (select quantile_cont(s, 0.99) as thr from sc), f as (select *, case when s >= thr then 1 else 0 end as fl from sc, q)
select l_linestatus, count(*) as n, cast(sum(fl) as bigint) as n_flagged, round(sum(fl) / cast((select sum(fl) from f) as double), 9) as queue_share, round(sum(fl * y) / cast(sum(y) as double), 9) as recall from f group by l_linestatus""")
def segmented_queue(spark, d):
    return metrics.segmented_queue(scores(spark, d), "l_linestatus", "s", "y").select("l_linestatus", "n", "n_flagged", F.round("queue_share", 9).alias("queue_share"), F.round("recall", 9).alias("recall"))


@query(f"""with {CURVE}, q as (select quantile_cont(s, 0.99) as thr from sc), b as (select count(*) as n, avg(cast(y as double)) as base_rate, avg((greatest(0, least(1, s)) - y) * (greatest(0, least(1, s)) - y)) as brier,
    count(*) filter (s >= thr) as n_flagged, cast(coalesce(sum(y) filter (s >= thr), 0) as double) as hit, cast(sum(y) as double) as pos, max(thr) as thr from sc, q),
o as (select s, 2 * cum_tp / cast(cum_n + p as double) as f1, cum_tp / cast(cum_n as double) as pr, cum_tp / cast(p as double) as re from c, tot order by 2 desc, 1 limit 1)
select b.n as n, {{}} from b, o""".format(", ".join(f"round({x}, 7) as {name}" for name, x in {
    "base_rate": "base_rate", "average_precision": AP, "lift": f"{AP} / base_rate", "roc_auc": "(select sum(tp * (cum_fp - (n - tp) * 0.5E0)) / (cast(max(p) as double) * max(neg)) from c, tot)", "brier": "brier", "threshold": "thr", "precision": "hit / n_flagged", "recall": "hit / pos", "f1": "2 * hit / (n_flagged + pos)",
    "oracle_threshold": "o.s", "oracle_f1": "o.f1", "oracle_precision": "o.pr", "oracle_recall": "o.re"}.items()) + ", n_flagged"))
def metric_bundle(spark, d):
    out = metrics.evaluate_scores(scores(spark, d), "s", "y")
    return out.select(*(c if c in ("n", "n_flagged") else F.round(c, 7).alias(c) for c in out.columns))


# --- profiles


@query(f"with {EVENTS} select cast(floor((t - (select min(t) from ev)) / 604800) as integer) as week, count(*) as n, round(avg(cast(y as double)), 6) as rate from ev group by 1")
def weekly_drift(spark, d):
    return profile.weekly_drift(events(spark, d), "t", "y").withColumn("rate", F.round("rate", 6))


@query(f"with {EVENTS} select k, count(*) as n, round(avg(cast(y as double)), 6) as rate from ev group by k having count(*) >= 50 order by avg(cast(y as double)) desc, k nulls first limit 8")
def rate_by_level_min_n(spark, d):
    return profile.rate_by(events(spark, d), F.col("k"), "y", "k", 50, 8).withColumn("rate", F.round("rate", 6))


@query(f"""with {EVENTS}, e as (select list_sort(list_distinct(quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as e from ev)
select cast(len(list_filter(e, lambda x: x <= amount)) as integer) as decile, count(*) as n, round(avg(cast(y as double)), 6) as rate from ev, e group by 1""")
def decile_rate(spark, d):
    ev = events(spark, d)
    edges = encode.quantile_edges(ev, "amount")
    return profile.rate_by(ev, scalar.decile(F.col("amount"), F.array(*map(F.lit, edges))), "y", "decile").withColumn("rate", F.round("rate", 6))


@query(f"with {EVENTS} select y, count(amount) as n, round(sum(cents) / 100.0E0 / count(*), 6) as mean, round(stddev_samp(amount), 4) as std, min(amount) as min, round(quantile_cont(amount, 0.25), 6) as p25, round(quantile_cont(amount, 0.5), 6) as p50, round(quantile_cont(amount, 0.75), 6) as p75, max(amount) as max from ev group by y")
def distribution_summary(spark, d):
    out = profile.distribution(events(spark, d), "amount", "y")
    return out.withColumns({c: F.round(c, 4 if c == "std" else 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query(f"""with {EVENTS}, w as (select cast(floor((t - (select min(t) from ev)) / {WEEK}) as integer) as week, count(*) as n, avg(cast(y as double)) as r from ev group by 1),
a as (select list(round(r, 6) order by week) as r, min(n) as lo, max(n) as hi, min(r) as rlo, max(r) as rhi from w), e as (select user_id, count(*) as n, sum(y) as pos from ev group by user_id)
select (select count(*) from ev) as n, (select cast(sum(y) as bigint) from ev) as n_positive, round((select avg(cast(y as double)) from ev), 6) as rate, cast((select floor(min(t) / {DAY}) from ev) as bigint) as first_day, cast((select floor(max(t) / {DAY}) from ev) as bigint) as last_day,
    round(rlo, 6) as week_rate_min, round(rhi, 6) as week_rate_max, lo as week_n_min, hi as week_n_max, array_to_string(r[:4], ' ') as first_weeks, array_to_string(r[-4:], ' ') as last_weeks,
    (select count(*) from e) as n_entities, round((select avg(n) from e), 6) as entity_mean, (select quantile_cont(n, 0.5) from e) as entity_median, (select quantile_cont(n, 0.95) from e) as entity_p95, (select max(n) from e) as entity_max, round((select avg(case when n = 1 then 1.0E0 else 0 end) from e), 6) as singleton_share, round((select avg(case when pos > 0 then 1.0E0 else 0 end) from e), 6) as any_positive_share,
    round((select avg(amount) from ev where y = 1), 6) as mean_positive, round((select avg(amount) from ev where y = 0), 6) as mean_negative, round((select quantile_cont(amount, 0.5) from ev where y = 1), 6) as median_positive, round((select quantile_cont(amount, 0.5) from ev where y = 0), 6) as median_negative, round((select corr(amount, t) from ev), 6) as corr_amount_time
from a""")
def dgp_evidence(spark, d):
    """Drift, entities and contrasts of groups as one row."""
    out = profile.dgp_evidence(events(spark, d), "t", "y", "amount", "user_id")
    return out.select(*(F.round(c, 6).alias(c) if k == "double" and c not in ("entity_median", "entity_p95") else F.col(c) for c, k in out.dtypes))


@query(f"""with {EVENTS}, b as (select user_id, count(*) as n, sum(y) as pos from ev group by user_id)
select count(*) as n_entities, round(avg(case when n = 1 then 1.0E0 else 0 end), 9) as singleton_share, quantile_cont(n, 0.5) as median_n, round(avg(n), 9) as mean_n, max(n) as max_n, round(avg(case when pos > 0 then 1.0E0 else 0 end), 9) as any_positive_share, round(sum(case when pos > 1 then pos else 0 end) / cast(sum(pos) as double), 9) as repeat_positive_share from b""")
def entity_rollup(spark, d):
    out = profile.entity_rollup(events(spark, d), "user_id", "y")
    return out.withColumns({c: F.round(c, 9) for c in ("singleton_share", "mean_n", "any_positive_share", "repeat_positive_share")})


def _resolution(c: str) -> str:
    return f"""select '{c}' as "column", (select count(distinct {c}) from od) as n_levels, cast(0 as double) as missing_rate, (select max(n) / cast(sum(n) as double) from (select count(*) as n from od group by {c})) as largest_level_share,
    cast(sum(kinds) - count(*) as bigint) as extra_entities, (sum(kinds) - count(*)) / cast(count(*) as double) as gain, round(avg(case when kinds = 1 then 1.0E0 else 0 end), 9) as frac_single_valued
    from (select o_custkey, count(distinct {c}) as kinds from od group by o_custkey)"""


@query(f"with {ORDERS} {_resolution('o_orderstatus')} union all {_resolution('o_orderpriority')}")
def entity_key_resolution(spark, d):
    return profile.key_resolution(orders(spark, d), ["o_custkey"], ["o_orderstatus", "o_orderpriority"]).withColumn("frac_single_valued", F.round("frac_single_valued", 9))


@query(f"with {EVENTS}, {PARTS} select count(*) as n, count(s.k2) as n_seen, count(s.k2) / cast(count(*) as double) as seen_share from pt left join (select distinct user_id as k2 from pt where part = 'train') s on pt.user_id = s.k2 where part = 'test'")
def new_level_exposure(spark, d):
    parts = parted(spark, d)
    return profile.new_level_exposure(parts.where("part = 'train'"), parts.where("part = 'test'"), "user_id")


@query(f"""with {FOLD_SQL}, f as (select block, avg(cast(y as double)) as r from bl where block > 0 group by block)
select 'events' as model, """ + ", ".join(f"round(max(case when block = {i + 1} then r end), 6) as fold_{i}" for i in range(5)) + ", round(avg(r), 6) as mean, round(stddev_pop(r), 6) as sd from f")
def per_fold_pivot(spark, d):
    rates = _blocks(spark, d).where("block > 0").groupBy((F.col("block") - 1).alias("fold")).agg(F.avg("y").alias("r")).withColumn("model", F.lit("events"))
    out = profile.per_fold_pivot(rates, "model", "fold", "r", list(range(5)))
    return out.select("model", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("""with h as (select l_linenumber as epoch, l_returnflag as run, avg(l_tax) as v from lineitem group by 1, 2)
select run, cast(arg_max(epoch, v) as integer) as best_epoch, round(max(v), 6) as best, round(arg_max(v, epoch), 6) as final, round(max(v) - arg_max(v, epoch), 6) as decay from h group by run""")
def history_summary(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("epoch"), F.col("l_returnflag").alias("run")).agg(F.avg("l_tax").alias("v"))
    return profile.history_summary(h, "run", "epoch", "v").select("run", "best_epoch", *(F.round(c, 6).alias(c) for c in ("best", "final", "decay")))


@query("""with i as (select case when p_size % 4 = 0 then 'uid_x' when p_size % 4 = 1 then 'a_te' when p_size % 4 = 2 then 'V7' else 'dist1' end as f, p_size as g from part)
select case f when 'uid_x' then 'entity history' when 'a_te' then 'target encoding' when 'V7' then 'raw V' else 'other' end as family, cast(sum(g) as double) as gain, round(sum(g) / cast((select sum(g) from i) as double), 9) as share from i group by f""")
def gain_share(spark, d):
    size = F.col("p_size")
    imp = table(spark, d, "part").select(F.when(size % 4 == 0, "uid_x").when(size % 4 == 1, "a_te").when(size % 4 == 2, "V7").otherwise("dist1").alias("feature"), size.cast("double").alias("gain"))
    return profile.gain_share(imp).withColumn("share", F.round("share", 9))


VIEW_NAMES = ["TransactionID", "TransactionDT", "isFraud", "amt_log", "V1", "V339", "Vx", "D1", "card1_te", "vpca_g00_0", "v_cluster", "v_cluster_dist"]


@query("with c as (select unnest([" + ", ".join(f"'{c}'" for c in VIEW_NAMES) + """]) as c), f as (select c, regexp_matches(c, '^V[0-9]+$') as raw, starts_with(c, 'vpca_') or starts_with(c, 'v_cluster') as packed from c where c not in ('TransactionID', 'TransactionDT', 'isFraud'))
select 'base' as view, c as "column" from f where not packed union all select 'unsup', c from f union all select 'compact', c from f where not raw""")
def feature_views(spark, d):
    """Columns of each view."""
    from tidemark.plans.features import view_columns

    return spark.createDataFrame([(v, c) for v in ("base", "unsup", "compact") for c in view_columns(VIEW_NAMES, v)], 'view string, `column` string')


@query(f"with {EVENTS} select event_id, t, amount, coalesce(k, 'none') as k from ev")
def attached_matrices(spark, d):
    """Two matrices of the same rows joined on the row id, with the check that they are the same."""
    from tidemark.plans.features import attach

    ev = events(spark, d)
    return attach(ev.select("event_id", "t"), ev.select("event_id", "amount", F.coalesce("k", F.lit("none")).alias("k")), "event_id")


@query("select least(150, count(*)) as n, least(150, count(*)) as n_kept from documents")
def limited_scan(spark, d):
    """A scan with a row limit, which bounds the fact side of the join only."""
    out = tables.left_join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", limit=150)
    return out.agg(F.count("*").alias("n"), F.count("has_identity_record").alias("n_kept"))


# --- unsupervised


@query("""with c as (select l_linenumber as cluster, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem)
select cluster, count(*) as n, round(avg(cast(y as double)), 9) as rate, round(avg(cast(y as double)) / (select avg(cast(y as double)) from c), 7) as lift from c group by cluster""")
def cluster_alignment(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("cluster"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return unsup.cluster_alignment(df, "cluster", "y").withColumns({"rate": F.round("rate", 9), "lift": F.round("lift", 7)})


@query("""with p as (select l_linestatus as a, l_returnflag as b, cast(count(*) as double) as n from lineitem group by 1, 2), s as (select
    (select sum(n * (n - 1) / 2) from p) as sab, (select sum(x * (x - 1) / 2) from (select sum(n) as x from p group by a)) as sa, (select sum(x * (x - 1) / 2) from (select sum(n) as x from p group by b)) as sb, (select sum(n) from p) as n)
select round((sab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 9) as ari from s""")
def ari(spark, d):
    return unsup.adjusted_rand(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag").select(F.round("ari", 9).alias("ari"))


@query("""with c as (select 0 as c, 0.0E0 as a, 0.0E0 as b union all select 1, 0.1E0, -0.1E0 union all select 2, -0.2E0, 0.2E0),
x as (select vec_id, cast(embedding[1] as double) as a, cast(embedding[2] as double) as b from embeddings),
dd as (select vec_id, c, sqrt((x.a - c.a) * (x.a - c.a) + (x.b - c.b) * (x.b - c.b)) as dist from x, c),
r as (select *, row_number() over (partition by vec_id order by dist, c) as rn from dd)
select vec_id, cast(max(case when rn = 1 then c end) as integer) as v_cluster, round(max(case when rn = 1 then dist end), 6) as v_cluster_dist, round(max(case when rn = 2 then dist end) - max(case when rn = 1 then dist end), 6) as v_cluster_margin from r group by vec_id""")
def fixed_center_features(spark, d):
    import numpy as np

    df = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    out = unsup.with_nearest(df, ["a", "b"], np.array([[0.0, 0.0], [0.1, -0.1], [-0.2, 0.2]]))
    return out.select("vec_id", "v_cluster", r6(F.col("v_cluster_dist"), "v_cluster_dist"), r6(F.col("v_cluster_margin"), "v_cluster_margin"))


def _wide_vectors(spark, d, n=64):
    return table(spark, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"V{i + 1}") for i in range(n)))


def _compressor():
    return unsup.GroupCompressor({0: [f"V{i}" for i in range(1, 33)], 1: [f"V{i}" for i in range(33, 65)]})


@query()
def group_pca(spark, d):
    df = _wide_vectors(spark, d)
    return _compressor().fit(df).transform(df, "vec_id").select("vec_id", "vpca_g00_0", "vpca_g01_0")


@query()
def kmeans_features(spark, d):
    df = _wide_vectors(spark, d)
    return _compressor().fit(df).transform(df, "vec_id").select("vec_id", "v_cluster", "v_cluster_dist", "v_cluster_margin")


@query()
def stability_sweep(spark, d):
    return unsup.stability_sweep(table(spark, d, "embeddings"), "embedding")


@query()
def pca_profile(spark, d):
    return unsup.pca_profile(_wide_vectors(spark, d), [f"V{i}" for i in range(1, 65)])

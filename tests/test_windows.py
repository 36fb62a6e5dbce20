"""Point-in-time features on frames small enough to check by hand."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import schema
from tidemark.operators import pit
from tidemark.plans import audit, features

COLUMNS = "TransactionID long, TransactionDT double, isFraud int, TransactionAmt double, ProductCD string, card1 int, card2 double, addr1 double, P_emaildomain string, R_emaildomain string, D1 double, has_identity_record int"


@pytest.fixture(scope="module")
def tiny(spark):
    t = [0.0, 100.0, 200.0, 300.0, 400.0, 400.0 + 2 * 86400]
    card = [1, 1, 2, 1, 2, 2]
    amount, fraud, product = [10.0, 20.0, 30.0, 100.0, 40.0, 50.0], [0, 1, 0, 0, 1, 0], "WWCWCC"
    data = [(i + 1, t[i], fraud[i], amount[i], product[i], card[i], None if card[i] == 1 else 5.0, 315.0 if card[i] == 1 else 325.0, "gmail.com", None, float(card[i] == 2), 0) for i in range(6)]
    return spark.createDataFrame(data, COLUMNS)


@pytest.fixture(scope="module")
def matrix(tiny):
    return rows(features.FeatureBuilder().fit(tiny).transform(tiny), schema.ID)


def test_history_uses_earlier_rows_only(matrix):
    assert [matrix[i]["uid_card1_prior_amt_mean"] for i in (1, 2, 4)] == [None, 10.0, 15.0]
    assert [matrix[i]["uid_card1_prior_count"] for i in (1, 2, 4)] == [0, 1, 2]
    assert [matrix[i]["uid_card1_secs_since_prev"] for i in (1, 2, 4)] == [None, 100.0, 200.0]
    assert matrix[2]["uid_card1_prior_amt_std"] == 0.0


def test_time_and_label_are_no_features(matrix):
    names = matrix[1].asDict()
    assert schema.TIME not in names and schema.TARGET not in names
    assert all(matrix[i]["D1_ref_day"] is not None for i in matrix)


def test_long_lag_gives_the_prior(tiny):
    out = features.FeatureBuilder(lag_days=365).fit(tiny).transform(tiny).select("card1_te").distinct().collect()
    assert len(out) == 1 and out[0][0] == pytest.approx(1 / 3, abs=1e-6)


def test_zero_lag_without_smoothing(tiny):
    out = rows(features.FeatureBuilder(lag_days=0, smoothing=0.0).fit(tiny).transform(tiny), schema.ID)
    assert [out[i]["card1_te"] for i in (1, 2, 4)] == pytest.approx([1 / 3, 0.0, 0.5], abs=1e-6)


def test_unseen_levels(tiny):
    builder = features.FeatureBuilder().fit(tiny.where("TransactionID < 4"))
    other = tiny.withColumn("ProductCD", F.lit("S")).withColumn("P_emaildomain", F.lit("new.org"))
    row = builder.transform(other).first()
    assert row["ProductCD_code"] == -1 and row["P_emaildomain_freq"] == 0


def test_null_is_a_counted_level(tiny):
    row = rows(features.FeatureBuilder().fit(tiny).transform(tiny), schema.ID)[1]
    assert row["R_emaildomain_freq"] == 6 and row["R_emaildomain_code"] == -1


@pytest.mark.parametrize("times,seconds,expected", [([0, 10, 20, 10_000_000], 100, [0, 1, 2, 0]), ([0, 0, 0], 1_000_000_000, [0, 0, 0])])
def test_windowed_count(spark, times, seconds, expected):
    df = spark.createDataFrame([(i, "a", float(t)) for i, t in enumerate(times)], "id int, k string, t double")
    got = df.select("id", pit.windowed_count(["k"], "t", seconds).alias("n")).orderBy("id").collect()
    assert [r["n"] for r in got] == expected


def test_unfitted_builder_raises(tiny):
    with pytest.raises(RuntimeError):
        features.FeatureBuilder().transform(tiny)


def test_one_exchange_serves_all_windows_of_an_entity(tiny):
    block = pit.entity_block(tiny, "u", ["card1"], schema.TIME, schema.ID, schema.AMOUNT)
    assert block._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_views(matrix):
    names = ["TransactionID", "amt_log", "V1", "vpca_g00_0", "v_cluster"]
    assert features.view_columns(names, "base") == ["amt_log", "V1"]
    assert features.view_columns(names, "compact") == ["amt_log", "vpca_g00_0", "v_cluster"]
    with pytest.raises(ValueError):
        features.view_columns(names, "other")


def test_planted_leak_is_found(tiny):
    honest = features.FeatureBuilder(lag_days=0).fit(tiny)
    assert audit.audit_future_invariance(tiny, honest).isEmpty()
    leaking = features.FeatureBuilder(target_encoding=features.leaky, smoothing=1.0).fit(tiny)
    past = tiny.withColumn(schema.TARGET, F.when(F.col(schema.ID) == 6, 1).otherwise(F.col(schema.TARGET)))
    moved = audit.changed_cells(leaking.transform(tiny), leaking.transform(past))
    assert "card1_te" in [r["feature"] for r in moved.collect()]


@pytest.mark.parametrize("lag,smoothing,span", [(0, 0.0, 10.0), (7.5, 2.0, 10.0), (25, 1.0, 1e9)])
def test_lagged_encoding_by_brute_force(spark, lag, smoothing, span):
    """Ties, a NULL level, lags that are no whole seconds, and spans that cut levels into many pieces."""
    import random

    rng = random.Random(3)
    data = [(i, float(rng.randint(0, 60)) / 2, rng.randint(0, 1), rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2])) for i in range(200)]
    df = spark.createDataFrame(data, "id long, t double, y int, k string, m int")
    got = rows(pit.lagged_target_encoding(df, "id", "t", "y", ["k", "m"], 0.3, lag, smoothing, span), "id")
    for at, c in ((3, "k"), (4, "m")):
        for r in data:
            seen = [o[2] for o in data if o[at] == r[at] and o[1] < r[1] - lag]
            want = (sum(seen) + 0.3 * smoothing) / (len(seen) + smoothing) if len(seen) + smoothing > 0 else 0.3
            assert got[r[0]][f"{c}_seen"] == len(seen) and got[r[0]][f"{c}_te"] == pytest.approx(want)
    full = rows(pit.full_target_encoding(df, "id", "y", ["k"], 0.3, 2.0), "id")
    for r in data:
        same = [o[2] for o in data if o[3] == r[3]]
        assert full[r[0]]["k_te"] == pytest.approx((sum(same) + 0.6) / (len(same) + 2))


def test_names_of_point_in_time_features():
    names = ["uid_card1_prior_count", "card1_te", "card1_freq", "amt_decile", "ProductCD_code", "V1"]
    assert [n for n in names if features.is_point_in_time(n)] == names[:2]
    assert [n for n in names if features.depends_on_fit(n)] == names[1:5]


def test_sort_fit_transform_in_one(tiny):
    """The wrapper fits on the masked rows only, whatever the order of the rows."""
    matrix, builder = features.build_feature_matrix(tiny.orderBy(F.desc(schema.ID)), F.col(schema.ID) <= 3)
    assert builder.fitted
    want = rows(features.FeatureBuilder().fit(tiny.where("TransactionID <= 3")).transform(tiny), schema.ID)
    assert rows(matrix, schema.ID) == want


def test_row_local_columns(spark):
    """Float keys as text, missing parts of keys, the logistic function, codes of embedding tables."""
    from tidemark.functions import scalar

    df = spark.createDataFrame([(1, 150.0, None, 0.0, 7), (2, 1.5, "x", 2.0, -1), (3, None, "y", -3.0, None), (4, 1e6, "z", 40.0, 1)], "i int, f double, s string, z double, c int")
    got = df.select("i", scalar.composite_key(F.col("f"), F.col("s")).alias("key"), scalar.sigmoid(F.col("z")).alias("p"), scalar.embedding_code(F.col("c"), 5).alias("code")).orderBy("i").collect()
    assert [r["key"] for r in got] == ["150.0_NA", "1.5_x", "NA_y", "1000000.0_z"]
    assert [r["p"] for r in got] == pytest.approx([0.5, 0.880797, 0.0474259, 1.0], abs=1e-6)
    assert [r["code"] for r in got] == [4, 0, 0, 2]


def test_strict_ties_by_brute_force(spark):
    """With strict_ties rows of one time do not see each other; large amounts lose nothing to cancellation."""
    import random
    from statistics import mean, pstdev

    rng = random.Random(5)
    data = [(i, float(rng.randint(0, 25)), rng.randint(1, 3), rng.choice([1e9, 0.01, 3.0]) + rng.random()) for i in range(150)]
    df = spark.createDataFrame(data, "id long, t double, k int, a double")
    got = rows(pit.entity_block(df, "u", ["k"], "t", "id", "a", strict_ties=True), "id")
    for r in data:
        seen = [o[3] for o in data if o[2] == r[2] and o[1] < r[1]]
        row = got[r[0]]
        assert row["u_prior_count"] == len(seen)
        assert row["u_prior_amt_mean"] == (pytest.approx(mean(seen)) if seen else None)
        assert row["u_prior_amt_std"] == (pytest.approx(pstdev(seen), rel=1e-6, abs=1e-6) if seen else None)
        before = [o[1] for o in data if o[2] == r[2] and o[1] < r[1]]
        assert row["u_secs_since_prev"] == (r[1] - max(before) if before else None)

"""Splits, metrics, sources and encoders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import encode, metrics, ordering, profile, split, unsup
from tidemark.sources import tables


@pytest.fixture(scope="module")
def toy(spark):
    order = np.random.default_rng(0).permutation(1000)
    return spark.createDataFrame([(int(i), float(60 * t), int(i % 29 == 0)) for i, t in enumerate(order)], "id long, t double, y int").cache()


def test_parts_are_exhaustive_and_ordered(toy):
    parts = {r["part"]: r for r in split.describe_parts(split.chronological(toy, "t", ["id"]), "t", "y").collect()}
    assert {k: v["n"] for k, v in parts.items()} == {"train": 650, "valid": 150, "test": 200}
    assert parts["train"]["t_max"] < parts["valid"]["t_min"] and parts["valid"]["t_max"] < parts["test"]["t_min"]


@pytest.mark.parametrize("valid,test", [(0.5, 0.5), (0, 0), (-0.1, 0.3)])
def test_bad_fractions(valid, test):
    with pytest.raises(ValueError):
        split.split_sizes(10, valid, test)


def test_blocks_match_array_split(toy):
    sizes = [r["count"] for r in split.expanding_blocks(toy, "t", ["id"]).groupBy("block").count().orderBy("block").collect()]
    assert sizes == [len(x) for x in np.array_split(np.arange(1000), 6)]


def test_overlap_guard(toy):
    blocks = split.expanding_blocks(toy, "t", ["id"])
    train, valid = split.fold(blocks, 1)
    split.assert_no_overlap(train, valid, "t")
    with pytest.raises(ValueError):
        split.assert_no_overlap(valid, train, "t")


def test_sorted_check(toy):
    split.assert_sorted(toy.select("t", "id").withColumn("n", toy["t"]), "n", "t")
    with pytest.raises(ValueError, match="sorted"):
        split.assert_sorted(toy, "id", "t")


def test_row_numbers(toy):
    got = [r["id"] for r in ordering.numbered(toy, "t", ["id"]).orderBy("rn").collect()]
    assert got == [r["id"] for r in toy.orderBy("t").collect()]


def test_perfect_ranking(spark):
    df = spark.createDataFrame([(i, float(i >= 950), int(i >= 950)) for i in range(1000)], "id int, s double, y int")
    row = metrics.evaluate_scores(df, "s", "y").first()
    assert row["average_precision"] == pytest.approx(1) and row["roc_auc"] == pytest.approx(1) and row["oracle_f1"] == pytest.approx(1)


def test_random_scores_have_no_lift(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(rng.random(5000), rng.random(5000) < 0.2)], "s double, y int")
    assert 0.7 < metrics.brier_and_lift(df, "s", "y").first()["lift"] < 1.4
    table = metrics.calibration_table(df, "s", "y").orderBy("bin").collect()
    assert len(table) == 10 and [r["mean_pred"] for r in table] == sorted(r["mean_pred"] for r in table)
    assert abs(metrics.at_budget(df, "s", "y").first()["n_flagged"] - 50) <= 2


def test_left_join_contract(spark):
    facts = spark.createDataFrame([(1,), (2,)], "TransactionID long")
    side = spark.createDataFrame([(2, "x")], "TransactionID long, DeviceType string")
    got = rows(tables.left_join(facts, side, "TransactionID"), "TransactionID")
    assert got[1]["has_identity_record"] == 0 and got[2]["has_identity_record"] == 1
    with pytest.raises(ValueError):
        tables.left_join(facts.union(facts), side, "TransactionID")


def test_csv_source(spark, tmp_path):
    (tmp_path / "train_identity.csv").write_text("TransactionID,id-01,DeviceType\n1,0.5,mobile\n")
    df = tables.read_csv(spark, "train_identity", str(tmp_path))
    assert df.columns == ["TransactionID", "id_01", "DeviceType"] and dict(df.dtypes)["TransactionID"] == "bigint"
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, "train_transaction", str(tmp_path))
    import hashlib

    found = tables.checksums(spark, str(tmp_path), "*.csv").first()
    assert (found["file"], found["md5"]) == ("train_identity.csv", hashlib.md5((tmp_path / "train_identity.csv").read_bytes()).hexdigest())
    assert tables.markdown(df).splitlines()[0].startswith("| TransactionID")
    with pytest.raises(ValueError):
        tables.markdown(df, limit=0)


def test_schema_check(spark, tmp_path):
    """The report names what differs on disk, before names are normalised."""
    (tmp_path / "train_transaction.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,V1,odd\n1,0,5,1.5,2,x\n2,1,6,2.5,3,y\n")
    (tmp_path / "test_transaction.csv").write_text("TransactionID,TransactionDT,TransactionAmt,V1,odd\n3,7,1.5,2,x\n")
    (tmp_path / "train_identity.csv").write_text("TransactionID,id_01,DeviceType\n1,0.5,mobile\n")
    (tmp_path / "test_identity.csv").write_text("TransactionID,id-01,DeviceType\n3,0.5,mobile\n")
    report = tables.schema_check(spark, str(tmp_path))
    assert report["files"]["train_transaction"] == {"n_cols": 6, "n_rows": 2} and len(report["checksums_md5"]) == 4
    told = " | ".join(report["discrepancies"])
    assert "sample_submission.csv is absent" in told and "id-01" in told and "block V has 1 columns of 339" in told and "not declared: odd" in told and "ProductCD" in told
    assert report["target_in_train"] and not report["target_in_test"] and report["train_identity_match_rate"] == 0.5


def test_cache_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    path = str(tmp_path / "cache")
    assert tables.cached_parquet(df, path).count() == 2
    assert tables.cached_parquet(df.where("x = 1"), path).count() == 2  # built once
    tables.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    tables.write_json({"b": 1, "a": 2.5}, str(tmp_path / "json"), spark)
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"a": 2.5, "b": 1}'


@pytest.mark.parametrize("cells", [1_000_000, 40])
def test_order_statistics(spark, monkeypatch, cells):
    """Cuts, blocks and quantiles with ties and NULLs, sorted here and by narrowing."""
    monkeypatch.setattr(ordering, "CELLS", cells)
    rng = np.random.default_rng(0)
    data = [(i, None if i % 37 == 0 else float(rng.integers(0, 25)), 2**60 + i) for i in rng.permutation(900).tolist()]
    df = spark.createDataFrame(data, "id long, t double, wide long").cache()
    rank = {r[0]: k + 1 for k, r in enumerate(sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0])))}
    parts = {r["id"]: r["part"] for r in split.chronological(df, "t", ["id"]).collect()}
    assert parts == {i: "train" if k <= 585 else "valid" if k <= 720 else "test" for i, k in rank.items()}
    blocks = {r["id"]: r["block"] for r in split.expanding_blocks(df, "t", ["id"], 4).collect()}
    assert blocks == {i: (k - 1) // 180 for i, k in rank.items()}
    some = [r[1] for r in data if r[1] is not None]
    q = ordering.quantiles(df, {"t": df["t"], "none": df["t"] * None}, [0, 0.1, 0.333, 0.5, 1])
    assert q["t"] == pytest.approx(np.quantile(some, [0, 0.1, 0.333, 0.5, 1])) and q["none"] is None
    assert ordering.order_statistics(df, {"w": (df["wide"], lambda n: [1, 450, n])})["w"] == [2**60, 2**60 + 449, 2**60 + 899]


def test_cut_within_equal_rows_is_refused(spark):
    df = spark.createDataFrame([(1, 1.0)] * 10, "id long, t double")
    with pytest.raises(ValueError, match="total"):
        split.chronological(df, "t", ["id"])


def test_splits_move_no_rows(toy):
    """Parts and blocks are conditions on the row itself: one scan, no exchange."""
    plan = split.expanding_blocks(split.chronological(toy, "t", ["id"]).where("part != 'test'"), "t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and plan.split("InMemoryRelation")[0].count("InMemoryTableScan") == 1


def test_running_totals_scan_once(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 7 as v").write.parquet(str(tmp_path / "x"))
    out = ordering.running(spark.read.parquet(str(tmp_path / "x")), [F.col("id").desc()], {"total": F.col("v"), "half": F.col("v") * 0.5})
    above = out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]  # what is kept lies below
    assert "FileScan" not in above and "Exchange" not in above and above.count("InMemoryTableScan") == 1
    got = {r["id"]: (r["total"], r["half"]) for r in out.collect()}
    total = 0
    for i in range(4999, -1, -1):
        total += i % 7
        assert got[i] == (total, total / 2)


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(2)
    data = [(None if i % 5 == 0 else i % 5, float(rng.integers(0, 30)) if i % 11 else None) for i in range(700)]
    got = {r["g"]: (r["a"], r["b"]) for r in ordering.grouped_quantiles(spark.createDataFrame(data, "g int, x double"), "g", F.col("x"), {"a": 0.25, "b": 0.5}).collect()}
    for g in {r[0] for r in data}:
        assert got[g] == pytest.approx(tuple(np.quantile([x for k, x in data if k == g and x is not None], [0.25, 0.5])))


def test_exact_median_and_population_scale(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert encode.medians(df, ["x"]) == {"x": 2.5}
    assert encode.population_scales(df, ["x"])["x"][1] == pytest.approx(1.118033988)


def test_ari_and_masks(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3, None if i % 2 else 1, None if i % 2 else 2, 1) for i in range(30)], "id int, a int, b int, p int, q int, r int")
    assert unsup.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(1)
    groups = {r["column"]: r["group"] for r in unsup.null_mask_groups(df, "id", ["p", "q", "r"]).collect()}
    assert groups == {"p": 0, "q": 0, "r": 1}
    assert profile.missing_buckets(df, ["p", "q", "r"]).count() == 2


def test_order_statistics_of_many_columns_take_few_scans(spark, monkeypatch):
    """Numbers of all kinds beyond what the driver sorts: the values of a plain sort, from a few scans for all columns."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators import ordering

    rng = np.random.default_rng(3)
    rows = [(float(v) if i % 3 else None, float("nan") if i % 50 == 0 else float(v) * 1e300, i % 7 - 3, int(w)) for i, (v, w) in enumerate(zip(rng.normal(size=3000), rng.integers(-(2**62), 2**62, 3000)))]
    df = spark.createDataFrame(rows, "a double, b double, c int, d long").cache()
    columns, at = {c: F.col(c) for c in df.columns}, [0, 0.1, 0.5, 0.99, 1]
    plain = ordering.quantiles(df, columns, at)
    monkeypatch.setattr(ordering, "CELLS", 100)
    monkeypatch.setattr(ordering, "_estimate", None)  # the scans column by column, which took too long
    assert repr(ordering.quantiles(df, columns, at)) == repr(plain)
    monkeypatch.setattr(ordering, "BINS", 8)
    assert repr(ordering.quantiles(df.drop("a", "b"), {c: columns[c] for c in "cd"}, [0.5])) == repr({c: ordering.quantiles(df, {c: columns[c]}, [0.5])[c] for c in "cd"})

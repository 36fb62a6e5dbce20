"""Model contracts on a small synthetic frame."""

import numpy as np
import pytest

from tidemark.models.gbm import GbmModel
from tidemark.models.linear import LinearModel
from tidemark.models.mlp import MlpModel

FEATURES = ["amt_log", "V1", "V2", "ProductCD_code"]


@pytest.fixture(scope="module")
def synth(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=800)
    y = (rng.random(800) < 1 / (1 + np.exp(1.5 - 2 * z))).astype(int)
    data = [(i, float(4 + rng.normal()), float(z[i]), None if i % 40 == 0 else float(z[i] + rng.normal()), int(rng.integers(0, 5)), int(y[i])) for i in range(800)]
    return spark.createDataFrame(data, "id int, amt_log double, V1 double, V2 double, ProductCD_code int, y int").cache()


@pytest.mark.parametrize("make,ranked", [(lambda: LinearModel(iterations=20), True), (lambda: GbmModel(trees=4, depth=3, min_rows=20), True), (lambda: MlpModel(hidden=(16, 8), epochs=3, batch=64, rate=0.01), False)])
def test_contract(spark, synth, make, ranked):
    train, test = synth.where("id < 600"), synth.where("id >= 600")
    model = make().timed_fit(train, FEATURES, "y", test)
    unseen = spark.createDataFrame([(9000, 4.0, 0.0, None, 99999, 0), (9001, 4.0, 0.0, None, -1, 1)], test.schema)
    got = model.score(test.union(unseen)).toPandas()
    assert len(got) == 202 and np.isfinite(got["score"]).all() and got["score"].between(0, 1).all() and model.fit_seconds > 0
    assert set(test.columns) <= set(got.columns)
    known = got[got["id"] < 9000]
    assert known[known["y"] == 1]["score"].mean() > known[known["y"] == 0]["score"].mean()
    found = model.feature_importance()
    assert (found is not None) == ranked
    if ranked:
        assert [v for _, v in found] == sorted((v for _, v in found), reverse=True)


def test_registered_compression_takes_whole_vectors(spark, tmp_path):
    from tidemark import catalog

    spark.createDataFrame([(0, 1, [float(i) for i in range(64)])], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    names = [f"V{i}" for i in range(1, 65)]
    assert catalog._wide_vectors(spark, str(tmp_path)).columns == ["vec_id", "label", *names]
    own = catalog._compressor()
    assert [c for g in own.groups.values() for c in g] == names and (own.cap, own.starts) == (12, 10)


def test_stops_at_the_best_tree(spark, synth):
    """The history holds the average precision of every prefix of the trees, and the best one is kept."""
    from tidemark.operators import metrics

    train, test = synth.where("id < 600"), synth.where("id >= 600")
    model = GbmModel(trees=6, depth=2, min_rows=20, patience=2).fit(train, FEATURES, "y", test)
    assert [h["trees"] for h in model.history] == list(range(1, len(model.history) + 1))
    best = max(model.history, key=lambda h: (h["valid_pr_auc"], -h["trees"]))
    assert model.kept == best["trees"] and len(model.history) in (6, model.kept + 2)
    for h in model.history[:3]:
        plain = metrics.average_precision(model._margin(model._prepared(test), h["trees"]), "__margin", "y").first()[0]
        assert h["valid_pr_auc"] == pytest.approx(plain)


def test_optimiser_state_is_carried(spark, synth):
    model = MlpModel(hidden=(8,), epochs=3, batch=64).fit(synth, FEATURES, "y")
    assert model.layers.steps >= 3 and set(model.layers.m) == set(model.layers.v) <= set(model.layers.p)
    assert len(model.history) == 3 and model.history[-1]["train_loss"] < model.history[0]["train_loss"]


def test_stability_sweep(spark):
    """Three clear clouds: every seed finds them, and the figures are those of brute force."""
    from tidemark.operators import unsup

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(40, 3)) * 0.1 + c for c in ([0, 0, 0], [5, 0, 0], [0, 5, 5])])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    got = {r["k"]: r for r in unsup.stability_sweep(df, "v", ks=(2, 3), seeds=3, starts=4).collect()}
    assert got[3]["ari_mean"] == got[3]["ari_min"] == 1
    centers, named = x.reshape(3, 40, 3).mean(1), np.repeat(np.arange(3), 40)
    assert got[3]["inertia"] == pytest.approx(((x - centers[named]) ** 2).sum())
    distance = np.linalg.norm(x[:, None] - x, axis=2)
    silhouette = []
    for i in range(len(x)):
        means = [distance[i, named == k].sum() / ((named == k).sum() - (k == named[i])) for k in range(3)]
        a, b = means[named[i]], min(m for k, m in enumerate(means) if k != named[i])
        silhouette.append((b - a) / max(a, b))
    assert got[3]["silhouette"] == pytest.approx(np.mean(silhouette), abs=1e-6) and got[2]["silhouette"] < got[3]["silhouette"]


def test_compressor(spark):
    """Components are those of numpy's decomposition up to their sign; an empty column counts as its median 0."""
    from tidemark.operators import unsup

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r), None) for i, r in enumerate(x)], "id int, a double, b double, c double, d double, e double")
    own = unsup.GroupCompressor({0: ["a", "b"], 1: ["c", "d", "e"]}, k=3, starts=2).fit(df)
    out = own.transform(df, "id").orderBy("id").toPandas()
    z = (x - x.mean(0)) / x.std(0)
    for g, columns in ((0, [0, 1]), (1, [2, 3])):
        _, _, v = np.linalg.svd(z[:, columns])
        assert np.abs(out[f"vpca_g{g:02d}_0"].to_numpy()) == pytest.approx(np.abs(z[:, columns] @ v[0]), abs=1e-6)
    points = out[own.names].to_numpy()
    distance = np.linalg.norm(points[:, None] - own.centers, axis=2)
    assert out["v_cluster"].tolist() == distance.argmin(1).tolist() and out["v_cluster_dist"].to_numpy() == pytest.approx(distance.min(1))
    with pytest.raises(RuntimeError):
        unsup.GroupCompressor({0: ["a"]}).transform(df, "id")


def test_harness(spark, synth):
    """Folds, holdout, table and files of a run."""
    from tidemark.plans import evaluate

    matrix = synth.withColumn("t", synth["id"].cast("double"))
    run = evaluate.run_experiment(lambda: LinearModel(iterations=10), matrix.drop("ProductCD_code"), time="t", row_id="id", label="y", folds=2)
    assert [r["fold"] for r in run.per_fold.orderBy("fold").collect()] == [0, 1] and 0 < run.holdout["roc_auc"] <= 1
    row = evaluate.results_table([run]).first()
    assert row["model"] == "linear" and row["holdout_roc_auc"] == run.holdout["roc_auc"]
    shown = run.per_fold.toPandas()["average_precision"]
    assert row["cv_mean"] == pytest.approx(shown.mean()) and row["cv_std"] == pytest.approx(shown.std(ddof=0))


def test_saved_results(spark, synth, tmp_path):
    from tidemark.plans import evaluate

    matrix = synth.select("id", synth["id"].cast("double").alias("t"), "y", "amt_log", "V1")
    run = evaluate.run_experiment(lambda: LinearModel(iterations=5), matrix, time="t", row_id="id", label="y", folds=1)
    evaluate.save([run], str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == 1
    assert {p.name for p in (tmp_path / "linear_base").iterdir()} >= {"per_fold", "calibration", "holdout", "importance"}


def test_pca_profile(spark):
    from tidemark.operators import unsup

    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3)) @ rng.normal(size=(3, 5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double")
    got = unsup.pca_profile(df, list("abcde")).first()
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    share = np.linalg.svd(z, compute_uv=False) ** 2
    share /= share.sum()
    upper = np.abs(np.corrcoef(z.T))[np.triu_indices(5, 1)]
    assert got["pc1_share"] == pytest.approx(share[0]) and got["n_pc95"] == int(np.searchsorted(np.cumsum(share), 0.95) + 1)
    assert got["mean_abs_corr"] == pytest.approx(upper.mean()) and got["share_above_09"] == pytest.approx((upper > 0.9).mean())


def test_split_leakage(spark):
    """A feature that tells the time leaks under a shuffled split of a label that drifts."""
    from tidemark.plans import evaluate

    rng = np.random.default_rng(6)
    data = [(i, float(i), int(rng.random() < (0.1 if (i // 100) % 2 else 0.6)), *(float((i // 100) == k) for k in range(10))) for i in range(1000)]
    df = spark.createDataFrame(data, "id long, t double, y int, " + ", ".join(f"b{k} double" for k in range(10)))
    got = {r["arm"]: r["roc_auc"] for r in evaluate.split_leakage(lambda: LinearModel(iterations=20), df, [f"b{k}" for k in range(10)], "t", "id", "y").collect()}
    assert got["shuffled"] > 0.7 > got["chronological"]


def test_linear_fit_is_the_optimum(spark, synth):
    """A handful of passes reach the least loss: the gradient over all rows vanishes there."""
    from tidemark.models import linear

    model, passes, plain = LinearModel(), [], linear._sums
    linear._sums = lambda ready, width, b: (passes.append(b), plain(ready, width, b))[1]
    try:
        model.fit(synth, ["amt_log", "V1", "V2"], "y")
    finally:
        linear._sums = plain
    assert len(passes) <= 12
    rows = synth.toPandas()
    x = rows[["amt_log", "V1", "V2"]].fillna(rows["V2"].median())
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    y, n = rows["y"].to_numpy(), len(rows)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    p = 1 / (1 + np.exp(-(z @ model.coefficients + model.intercept)))
    assert np.abs(z.T @ (w * (p - y)) / n + model.coefficients / (model.c * n)).max() < 1e-5 and abs((w * (p - y)).sum() / n) < 1e-5
    alone = LinearModel().fit(synth.where("y = 1"), ["V1"], "y").score(synth).toPandas()["score"]
    assert (alone == 1).all()


def test_scales_of_all_rows_reach_the_leaky_arm(spark, monkeypatch):
    """Both arms of preprocessing_leakage are those of brute force, and a drift of the test rows' scales sets them apart."""
    from tidemark import catalog, catalog_models, schema

    rng = np.random.default_rng(7)
    n, start, cut = 1000, 800, 650
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 2)) + 0.5 * y[:, None]
    x[start:, 0] *= 12
    x[::25, 1] = np.nan
    data = [(i, float(i), int(y[i]), float(x[i, 0]), None if np.isnan(x[i, 1]) else float(x[i, 1])) for i in range(n)]
    frame = spark.createDataFrame(data, f"{schema.ID} long, {schema.TIME} double, {schema.TARGET} int, a double, b double")
    monkeypatch.setattr(catalog_models, "_matrix", lambda spark, d: frame)
    got = {r["arm"]: r["average_precision"] for r in catalog.QUERIES["preprocessing_leakage"](spark, "").collect()}
    wanted, weight = {}, np.where(y == 1, 1 / (2 * y[:cut].mean()), 1 / (2 * (1 - y[:cut].mean())))[:cut]
    for arm, rows in (("train", cut), ("train_and_test", n)):
        z = np.where(np.isnan(x), np.nanmedian(x[:rows], axis=0), x)
        z = np.hstack([(z - z[:rows].mean(0)) / z[:rows].std(0), np.ones((n, 1))])
        b, ridge = np.zeros(3), np.diag([10.0, 10.0, 0.0])  # 1 / C
        for _ in range(30):
            p = 1 / (1 + np.exp(-(z[:cut] @ b)))
            b -= np.linalg.solve((z[:cut] * (weight * p * (1 - p))[:, None]).T @ z[:cut] + ridge, z[:cut].T @ (weight * (p - y[:cut])) + ridge @ b)
        hits = y[start:][np.argsort(-(z[start:] @ b))]
        wanted[arm] = (np.cumsum(hits) / np.arange(1, n - start + 1))[hits == 1].mean()
    assert got == pytest.approx(wanted, abs=1e-6) and abs(got["train"] - got["train_and_test"]) > 0.02


def test_stored_frame_begins_at_its_files(spark, synth):
    from tidemark.sources import tables

    held = tables.stored(synth.withColumn("z", synth["V1"] * 2).join(synth.select("id"), "id"))
    assert held.schema == tables.stored(held).schema and held.count() == 800
    assert "Join" not in held._jdf.queryExecution().toString()


def test_parameters_are_summed_before_the_driver(spark):
    """Vectors of many tasks arrive at the driver as one, whatever their number and length."""
    from tidemark.models import base

    size = 2 * base.CHUNK + 5
    made = spark.range(0, 12, 1, 12).mapInArrow(lambda batches: (c for b in batches for i in b.column("id").to_pylist() for c in base.chunks(np.arange(size) * float(i))), base.CHUNKS)
    assert (base.summed(made) == np.arange(size) * 66.0).all()
    assert len(base.summed(made.where("chunk < 0"))) == 0


def test_epoch_sends_one_set_of_parameters(spark, synth):
    """Training collects no row of parameters for each task, and gives its broadcasts back."""
    from tidemark.models import mlp

    model = MlpModel(hidden=(8,), epochs=2, batch=64)
    collected, plain = [], mlp.summed
    mlp.summed = lambda rows: (collected.append(plain(rows)), collected[-1])[1]
    try:
        model.fit(synth.repartition(7), FEATURES, "y")
    finally:
        mlp.summed = plain
    parameters = sum(v.size for v in model.layers.p.values())
    assert [len(v) for v in collected] == [3 + 3 * parameters] * 2


def _plain_trees(x, y, trees, depth, rate, least, l2):
    """Boosting by brute force: every cut of every node on all rows; x without missing values."""
    edges = [np.unique(np.quantile(c, np.arange(32) / 32)) for c in x.T]
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    margin = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, nodes, out = weight * (y - p), weight * p * (1 - p), [np.arange(len(y))], []
        for _ in range(depth):
            below = []
            for rows in nodes:
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                cuts = [(score(rows[left]) + score(rows[~left]) - score(rows), -f, -k, left) for f, e in enumerate(edges) for k, v in enumerate(e) for left in [x[rows, f] <= v] if left.sum() >= least and (~left).sum() >= least]
                best = max(cuts, key=lambda c: c[:3], default=(0,))
                below += [rows[best[3]], rows[~best[3]]] if best[0] > 0 else []
                out += [] if best[0] > 0 else [rows]
            nodes = below
        for rows in nodes + out:
            margin[rows] += rate * g[rows].sum() / (h[rows].sum() + l2)
    return margin


def test_trees_are_those_of_brute_force(spark, synth, monkeypatch):
    """Whatever the number of tasks, and beyond the trees after which margins are added up anew."""
    from tidemark.models import gbm

    monkeypatch.setattr(gbm, "REPLAY", 3)
    model = GbmModel(trees=5, depth=3, min_rows=20, row_share=1.0, column_share=1.0).fit(synth.repartition(5, "id"), ["amt_log", "V1"], "y")
    got = model._margin(model._prepared(synth), 5).orderBy("id").toPandas()
    wanted = _plain_trees(got[["amt_log", "V1"]].to_numpy(), got["y"].to_numpy(), 5, 3, 0.05, 20, 10.0)
    assert got["__margin"].to_numpy() == pytest.approx(wanted, abs=1e-6)


def test_early_stopping_by_ranges(spark, synth, monkeypatch):
    """Validation rows in many ranges give the figures of one; without rows all trees are kept."""
    from tidemark.models import gbm

    model = GbmModel(trees=4, depth=3, min_rows=20).fit(synth, FEATURES, "y", synth)
    whole = [h["valid_pr_auc"] for h in model.history]
    monkeypatch.setattr(gbm, "RANGE_ROWS", 90)
    model.history = []
    model._stop_early(synth, "y")
    assert [h["valid_pr_auc"] for h in model.history] == pytest.approx(whole)
    assert GbmModel(trees=2, depth=2, min_rows=20).fit(synth, FEATURES, "y", synth.where("id < 0")).kept == 2


def test_a_tree_is_one_pass_for_each_level(spark, synth):
    """Passes grow with the levels of trees only, and missing and rare values have a bin of their own."""
    tracker, group = spark.sparkContext.statusTracker(), "passes"
    spark.sparkContext.setJobGroup(group, group)
    try:
        GbmModel(trees=2, depth=3, min_rows=20).fit(synth, FEATURES, "y")
        few = len(tracker.getJobIdsForGroup(group))
        GbmModel(trees=6, depth=3, min_rows=20).fit(synth, FEATURES, "y")
        more = len(tracker.getJobIdsForGroup(group)) - few
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert more - few <= 4 * 3
    rare = spark.createDataFrame([(i, None if i % 50 == 0 else float(i % 40 == 1), int(i % 40 == 1 or i % 50 == 0)) for i in range(1200)], "id int, x double, y int")
    got = GbmModel(trees=3, depth=2, min_rows=5).fit(rare, ["x"], "y").score(rare).groupBy("y").agg({"score": "min"}).toPandas().set_index("y")["min(score)"]
    assert got[1] > 0.5 > got[0]

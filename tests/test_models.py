"""Trees, boosting, ensembles, persistence, and the adaptive loop."""

from __future__ import annotations

import pickle
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrove.functions.settings import BoostSettings, DriftSettings
from tidegrove.operators import boosting, ensembles
from tidegrove.operators.boosting import BoostModel, LocalRows, Tree, average_precision, derivatives, fit, fit_bins, fit_bins_local, fit_local, grow, matrix, partial_histograms, roc_auc, search
from tidegrove.plans import models
from tidegrove.sources import tables
from tidegrove.streaming import adaptive

QUICK = BoostSettings(trees=25, depth=3, learning_rate=0.2, min_samples_split=5, min_child_weight=1.0, subsample=1.0, colsample=1.0, mi_weight=0.0)
NAMES = [f"f{k}" for k in range(6)]


def data(n: int = 800, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    x = np.random.default_rng(seed).standard_normal((n, 6))
    return x, (x[:, 0] + x[:, 1] + 0.5 * x[:, 2] > 0).astype(float)


@pytest.fixture(scope="module")
def frame(spark):
    x, y = data()
    x[::13, 3] = np.nan
    return tables.from_arrays(spark, x, y).repartition(3)


def test_binary_model_learns():
    x, y = data()
    xv, yv = data(400, 7)
    model = fit_local(x, y, NAMES, QUICK)
    assert roc_auc(model.predict(xv), yv) > 0.95 and average_precision(model.predict(xv), yv) > 0.95
    assert model.importance()[:2].sum() > model.importance()[3:].sum()
    mixed = fit_local(x, y, NAMES, replace(QUICK, mi_weight=0.3, subsample=0.8, colsample=0.7))
    assert roc_auc(mixed.predict(xv), yv) > 0.93
    assert fit_local(x, y, NAMES, replace(QUICK, subsample=0.8)).to_json() == fit_local(x, y, NAMES, replace(QUICK, subsample=0.8)).to_json()


def test_early_stopping_keeps_the_best_trees():
    x, y = data(300)
    noise = np.random.default_rng(0).permutation(y)
    model = fit_local(x, noise, NAMES, replace(QUICK, trees=200, patience=2), data(200, 3))
    assert len(model.trees) < 200 and model.best_score == max(model.best_score, *[np.mean(model.history[max(0, i - 2) : i + 1]) for i in range(len(model.history))])


def test_capacity_and_traversal():
    t = Tree()
    a = t.add()
    b, c = t.add(), t.add()
    t.feature[a], t.threshold[a], t.left[a], t.right[a] = 0, 3, b, c
    t.value[b], t.value[c] = 0.1, 0.9
    assert t.predict(np.array([[2], [5]])).tolist() == [0.1, 0.9]
    x, y = data(2000)
    bins = fit_bins_local(x, NAMES, 32)
    g, h = derivatives(QUICK, np.zeros(len(y)), y)
    tree = grow(LocalRows(bins.transform(x), bins.widths, y, g, h, np.arange(len(y))), replace(QUICK, min_samples_split=2), list(range(6)))
    assert len(tree.value) <= 15


def test_histogram_parent_is_left_plus_right():
    x, y = data(500)
    bins = fit_bins_local(x, NAMES, 16)
    b = bins.transform(x).T
    g, h = derivatives(QUICK, np.zeros(len(y)), y)
    values = np.stack([g, h, y, np.ones_like(g)], axis=1)
    whole = partial_histograms(b, values, np.zeros(len(y), int), [0], 17)[0]
    node = np.where(b[0] <= 5, 1, 2)
    parts = partial_histograms(b, values, node, [1, 2], 17)
    assert np.allclose(whole, parts[1] + parts[2])
    gain, k, at = search(whole, QUICK, 0, range(6))
    best = max(
        ((lambda l, t: 0.5 * (l[0] ** 2 / (l[1] + 2) + (t[0] - l[0]) ** 2 / (t[1] - l[1] + 2) - t[0] ** 2 / (t[1] + 2)) - 0.1)(whole[f, : i + 1].sum(0), whole[f].sum(0)), -f, -i)
        for f in range(6)
        for i in range(16)
        if whole[f, : i + 1, 1].sum() >= 1 and whole[f, i + 1 :, 1].sum() >= 1
    )
    assert gain == pytest.approx(best[0]) and k == -best[1]


def test_bins_are_monotone_and_equal_on_spark(frame):
    x, _ = matrix(frame.orderBy("row_id"), NAMES, "label")
    ours, theirs = fit_bins_local(x, NAMES, 32), fit_bins(frame, NAMES, 32)
    for a, b in zip(ours.edges, theirs.edges):
        assert a.tolist() == b.tolist()
    assert ours.medians == theirs.medians
    b = ours.transform(x)
    order = np.argsort(x[:, 0])
    assert (np.diff(b[order, 0]) >= 0).all()


def test_distributed_trees_equal_local_ones(frame):
    s = replace(QUICK, trees=4)
    local, spread = fit(frame, NAMES, "label", "row_id", s, distributed=False), fit(frame, NAMES, "label", "row_id", s, distributed=True)
    assert len(local.trees) == len(spread.trees) == 4
    for a, b in zip(local.trees, spread.trees):
        assert (a.feature, a.threshold, a.left) == (b.feature, b.threshold, b.left)
        assert np.allclose(a.value, b.value)
    assert any(t.left[0] >= 0 for t in local.trees)


@pytest.mark.parametrize("objective", ["logistic", "squared"])
def test_held_table_and_samples_are_the_same_over_the_cluster(frame, objective):
    s = replace(QUICK, trees=45, depth=2, subsample=0.7, colsample=0.7, patience=1, objective=objective, learning_rate=0.9)
    train = frame.where("row_id % 3 > 0")
    held = frame.where("row_id % 3 = 0").withColumn("label", F.when(F.col("row_id") % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    local, spread = (fit(train, NAMES, "label", "row_id", s, held, distributed=d) for d in (False, True))
    assert local.history and len(local.trees) == len(spread.trees) < 45
    assert np.allclose(local.history, spread.history) and np.isclose(local.best_score, spread.best_score)
    for a, b in zip(local.trees, spread.trees):
        assert (a.feature, a.threshold, a.left) == (b.feature, b.threshold, b.left)
        assert np.allclose(a.value, b.value)


def test_no_gradient_no_trees_over_the_cluster(frame):
    s = replace(QUICK, trees=2, objective="squared")
    assert [fit(frame.withColumn("label", F.lit(2.0)), NAMES, "label", "row_id", s, distributed=d).trees for d in (False, True)] == [[], []]


def test_transform_and_tables(spark, frame, tmp_path):
    model = fit(frame, NAMES, "label", "row_id", QUICK)
    scored = model.transform(frame, "p", spread="sd").orderBy("row_id").toPandas()
    x, y = matrix(frame.orderBy("row_id"), NAMES, "label")
    assert np.allclose(scored["p"], model.predict(x)) and (scored["sd"] >= 0).all()
    table = model.tree_table(spark)
    assert table.select("tree_id").distinct().count() == len(model.trees)
    usage = {r.feature: r.n for r in table.where("kind = 'split'").groupBy("feature").agg(F.countDistinct("tree_id").alias("n")).collect()}
    assert usage == {k: n for k, n in enumerate(model.usage().tolist()) if n}
    tables.save_models(spark, {"a": model}, str(tmp_path / "m"))
    back = tables.load_models(spark, str(tmp_path / "m"))["a"]
    assert np.array_equal(back.predict(x), model.predict(x)) and np.array_equal(back.importance(), model.importance())
    assert np.array_equal(pickle.loads(pickle.dumps(model)).predict(x), model.predict(x))
    for bad in ("{", "{}", b"\xff"):
        with pytest.raises(ValueError, match="deserialization failed"):
            BoostModel.from_json(bad)


@pytest.mark.parametrize("objective", ["squared", "huber", "poisson"])
def test_regression_objectives(objective):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 2))
    rate = np.exp(0.5 + 0.3 * x[:, 0] + 0.7 * x[:, 1])
    y = rng.poisson(rate).astype(float)
    model = fit_local(x, y, ["a", "b"], replace(QUICK, objective=objective, trees=60, huber_delta=3.0))
    assert np.sqrt(np.mean((model.predict(x) - rate) ** 2)) < 0.8 * rate.std()
    prediction, spread = model.staged(x)
    assert np.allclose(prediction, model.predict(x)) and spread.max() > 0


def test_prune():
    x, y = data()
    model = fit_local(x, y, NAMES, replace(QUICK, colsample=0.2))
    used = {k for k, n in enumerate(model.usage()) if n}
    gone, n = model.prune(used, 0.8)
    assert not [t for t in gone.trees if t.used()] and n > 0
    assert model.prune(set(), 0.8)[1] == 0


def test_classes(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 600)
    x = rng.standard_normal((600, 4)) + y[:, None]
    df = tables.from_arrays(spark, x, y)
    model = ensembles.fit_classes(df, NAMES[:4], "label", "row_id", QUICK)
    p = model.probabilities(x)
    assert np.allclose(p.sum(1), 1) and np.mean(np.array(model.predict(x)) == y) > 0.8
    out = model.transform(df, "c").toPandas()
    assert (out["c"].astype(float) == np.array(model.predict(x))).all()
    assert ensembles.last_max(np.array([[0.5, 0.5, 0.1]])).tolist() == [1]


def test_partitions(spark):
    rng = np.random.default_rng(2)
    part = rng.integers(0, 3, 900)
    x = rng.standard_normal((900, 2)) + 8 * np.stack([part == 1, part == 2], axis=1)
    y = ((x[:, 0] - 8 * (part == 1) > 0) ^ (part == 2)).astype(float)
    df = tables.from_arrays(spark, x, y)
    model = ensembles.fit_partitions(df, ["f0", "f1"], "label", "row_id", 3, QUICK)
    assert np.mean((model.predict(x) > 0.5) == (y > 0.5)) > 0.9
    where = df.withColumn("p", ensembles.nearest_expression(["f0", "f1"], model.centers)).orderBy("row_id").toPandas()["p"]
    assert (where == ensembles.nearest(x, model.centers)).all()
    again = ensembles.from_json(ensembles.to_json(model))
    assert np.array_equal(again.predict(x), model.predict(x))
    assert model.observe(df, "label") == []
    flipped = df.withColumn("label", F.when(F.col("f0") > 4, 1 - F.col("label")).otherwise(F.col("label")))
    drifted = [model.observe(flipped, "label") for _ in range(8)][-1]
    assert drifted
    fixed = model.retrain(flipped, "label", "row_id", drifted, QUICK)
    xf, yf = matrix(flipped.orderBy("row_id"), ["f0", "f1"], "label")
    assert np.mean((fixed.predict(xf) > 0.5) == (yf > 0.5)) > np.mean((model.predict(xf) > 0.5) == (yf > 0.5))
    with pytest.raises(ValueError):
        ensembles.fit_centers(df.limit(2), ["f0"], "row_id", 5)


@pytest.mark.parametrize(("state", "count", "vulnerable", "degraded", "recovered", "want"), [
    ("normal", 0, False, False, False, ("normal", 0)),
    ("normal", 1, False, False, False, ("normal", 1)),
    ("normal", 1, False, False, True, ("normal", 0)),
    ("normal", 0, True, False, False, ("normal", 1)),
    ("normal", 1, True, False, False, ("alert", 1)),
    ("normal", 1, True, False, True, ("normal", 0)),
    ("alert", 1, True, False, False, ("alert", 1)),
    ("alert", 1, False, True, False, ("alert", 1)),
    ("alert", 1, True, True, False, ("alert", 2)),
    ("alert", 2, True, True, False, ("adapt", 0)),
    ("alert", 2, True, False, True, ("normal", 0)),
    ("alert", 2, False, False, True, ("normal", 0)),
    ("adapt", 0, False, False, True, ("adapt", 0)),
])
def test_state_machine(state, count, vulnerable, degraded, recovered, want):
    cfg = DriftSettings(alert_after=2, adapt_after=3)
    assert adaptive.next_state(state, count, vulnerable, degraded, recovered, cfg) == want


def test_degraded_batches_up_to_an_adaptation():
    """By size of the training set: 1, 2 and 4 batches after the alert's own."""
    for rows, batches in ((1000, 2), (100_000, 4), (500_000, 7)):
        cfg, state, count, n = DriftSettings.for_rows(rows), "normal", 0, 0
        while state != "adapt":
            state, count = adaptive.next_state(state, count, True, True, False, cfg)
            n += 1
        assert n == batches
        state, count, n = "normal", 0, 0
        while state != "adapt":
            state, count = adaptive.next_regression_state(state, count, True, cfg)
            n += 1
        assert n == batches
    assert adaptive.next_regression_state("alert", 2, False, cfg) == ("normal", 0)


def test_metabolism_and_strategy():
    m = adaptive.Metabolism(3, DriftSettings())
    m.update(np.array([0, 1, 2]), 100)
    for _ in range(3):
        m.update(np.array([0]), 500)
    assert m.utility[0] == 1 and m.utility[1] == pytest.approx(0.9995 ** (500 + 1000 + 1500)) and m.uses.tolist() == [4, 1, 1]
    assert m.dead() == set() and m.healthy() == {0}
    for _ in range(4):
        m.expose([1])
    assert m.vulnerable() == {1}
    m.update(np.array([0]), 500)
    assert m.dead() == {1, 2}
    x = np.array([[1.0, np.nan], [2.0, np.nan], [9.0, np.nan]])
    assert adaptive.volatility(x) == pytest.approx([np.sqrt(50 / 3), 0])
    assert adaptive.minority_error(np.array([0.1, 0.9, 0.9]), np.array([1.0, 1.0, 0.0])) == 0.5 and adaptive.minority_error(np.zeros(1), np.zeros(1)) == 0
    assert adaptive.strategy(np.array([20.0]), 0.5) == (1.0, 0.0, "features")
    assert adaptive.strategy(np.array([1.0]), 0.5) == (pytest.approx(0.1), 0.8, "data")
    assert adaptive.strategy(np.zeros(0), 0.0)[2] == "cautious"


def test_ema_and_diagnostics():
    xs = np.random.default_rng(0).random(50)
    slow = 0.3
    for v in xs:
        slow = 0.1 * v + 0.9 * slow
    assert adaptive.ema(0.3, xs, 0.1) == pytest.approx(slow)
    assert adaptive.entropy(np.array([])) == 0 and adaptive.entropy(np.ones(5)) == 0
    assert adaptive.entropy(np.linspace(0, 1, 1000)) == pytest.approx(np.log2(10), abs=0.01)
    assert adaptive.autocorrelation(np.ones(5)) == 0 and adaptive.heteroscedasticity(np.arange(5), np.arange(5.0)) == 0


def test_adaptive_loop_recovers():
    x, y = data(3000)
    loop = adaptive.Adaptive.start(fit_local(x, y, NAMES, QUICK), 3000, *data(500, 9), cooldown=200, buffer=2000, least_buffer=500)
    xs, ys = data(6000, 5)
    assert not any(r["adapted"] for r in adaptive.replay(loop, xs[:1000], ys[:1000], 250))
    reports = adaptive.replay(loop, xs[1000:], 1 - ys[1000:], 250)
    assert loop.adaptations > 0 and any(r["state"] == "alert" for r in reports)
    loop.state, loop.count = "alert", 2
    assert loop.state_text() == "Alert(2)"
    with pytest.raises(ValueError):
        adaptive.Adaptive.start(loop.model, 10, x[:0], y[:0])


def test_adaptive_regressor():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 3))
    y = 2 * x[:, 0] + x[:, 1]
    s = replace(QUICK, objective="squared", trees=60)
    loop = adaptive.AdaptiveRegressor.start(fit_local(x, y, ["a", "b", "c"], s), x, y, x[:500], y[:500], cooldown=300)
    reports = adaptive.replay(loop, x, y + 6, 400)
    assert loop.adaptations > 0 and reports[-1]["rmse"] < reports[0]["rmse"]
    with pytest.raises(ValueError):
        adaptive.AdaptiveRegressor.start(fit_local(x, rng.standard_normal(4000), ["a", "b", "c"], replace(s, trees=1)), x, y, x, y)


def test_stream_and_replayed_batch(spark, tmp_path):
    x, y = data(900)
    loop = adaptive.Adaptive.start(fit_local(x, y, NAMES, QUICK), 900, *data(300, 9))
    tables.from_arrays(spark, *data(600, 11)).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, " + ", ".join(f"{n} double" for n in NAMES) + ", label double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict = {}
    query = adaptive.attach(stream, loop, NAMES, "label", str(tmp_path / "c"), "row_id", seen.__setitem__, availableNow=True)
    assert query.awaitTermination(120)
    assert loop.observed == 600 and sorted(seen) == list(range(len(seen))) and loop.last_batch == max(seen)
    assert query.loop is loop
    windows = adaptive.windowed_errors(stream.withColumn("ts", F.timestamp_seconds("row_id")), "ts", "f0", "5 minutes")
    query = windows.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.sql("select sum(n) from w").first()[0] == 600


def test_stream_goes_on_after_a_crash(spark, tmp_path):
    """A query killed in the middle of a batch and started anew with a loop of its own ends like one that never stopped."""
    x, y = data(900)
    model = fit_local(x, y, NAMES, QUICK)
    fresh = lambda: adaptive.Adaptive.start(model, 900, *data(300, 9), cooldown=200, buffer=600, least_buffer=300, tolerance=0.3)
    xs, ys = data(3000, 12)
    schema = "row_id long, " + ", ".join(f"{n} double" for n in NAMES) + ", label double"
    for k in range(10):
        part = slice(300 * k, 300 * k + 300)
        tables.from_arrays(spark, xs[part], 1 - ys[part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name: str, sink) -> object:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = adaptive.attach(stream, fresh(), NAMES, "label", str(tmp_path / f"c_{name}"), "row_id", sink, str(tmp_path / f"s_{name}"), availableNow=True)
        return query

    whole: dict = {}
    query = run("whole", whole.__setitem__)
    assert query.awaitTermination(120)
    seen: dict = {}
    crash = {3, 7}

    def sink(number: int, report: dict) -> None:
        seen[number] = report
        if number in crash:
            crash.remove(number)
            raise RuntimeError("the driver is gone")

    for _ in range(2):
        with pytest.raises(Exception, match="the driver is gone"):
            run("broken", sink).awaitTermination(120)
    last = run("broken", sink)
    assert last.awaitTermination(120)
    assert seen == whole and any(r["adapted"] for r in whole.values())
    kept = adaptive.LoopState(spark, str(tmp_path / "s_broken"))
    assert kept.versions() == [8, 9]
    back, straight = kept.load(), adaptive.LoopState(spark, str(tmp_path / "s_whole")).load()
    assert back.status() == straight.status() and np.array_equal(back.x, straight.x) and np.array_equal(back.metabolism.utility, straight.metabolism.utility)
    assert np.array_equal(back.model.predict(xs), straight.model.predict(xs))
    assert adaptive.LoopState(spark, str(tmp_path / "none")).load() is None


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,V1,V2,Class\n1, 2.5 ,x,1\n2,,4,bad\n3\n")
    got = tables.read_labelled_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in got] == [(2.5, None, 1.0), (None, 4.0, 0.0)]
    named = tables.read_labelled_csv(spark, str(tmp_path / "a.csv"), "Class")
    assert named.columns == ["id", "V1", "V2", "Class"]
    assert tables.synthetic(spark, 50, 3).where("label = 1").count() > 5


@pytest.mark.parametrize("name", ["fit_binary", "fit_binary_distributed", "fit_regressor", "fit_multiclass", "partitioned_fit", "adaptive_replay", "hash_sample"])
def test_model_queries(spark, name):
    assert models.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_first_tree_of_many_rows_is_not_collected(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    here = sorted(models.first_tree(spark, sf).collect(), key=lambda r: r.path)
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 100)
    monkeypatch.setattr(boosting, "_by_id", lambda *_: pytest.fail("rows were collected"))
    assert sorted(models.first_tree(spark, sf).collect(), key=lambda r: r.path) == here


def test_training_in_one_process_is_bounded_in_rows_too():
    """A driver of 1,500 MB holds some 1.25 million rows of few features beside its JVM."""
    assert boosting.trains_here(600_000, 4) and boosting.trains_here(1_200_000, 4)
    assert not boosting.trains_here(4_800_000, 4) and not boosting.trains_here(5_000_000, 1)

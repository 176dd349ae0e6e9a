"""The estimator layer, reduced precision, and the variance split."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrove.functions import precision
from tidegrove.functions.settings import BoostSettings
from tidegrove.operators import boosting, ensembles
from tidegrove.operators.estimators import AdaptiveClassifier, BoostClasses, BoostClassifier, BoostPartitions, BoostRegressor, NotFitted, alternative_settings, best_variance_split, metric_report, report_text
from tidegrove.sources import tables
from tidegrove.streaming import adaptive


@pytest.fixture(scope="module")
def frame(spark):
    x = np.random.default_rng(42).standard_normal((500, 4))
    return tables.from_arrays(spark, x, x[:, 0] + x[:, 1] + 0.5 * x[:, 2] > 0)


FEATURES = ["f0", "f1", "f2", "f3"]


def test_classifier(spark, frame, tmp_path):
    est = BoostClassifier(FEATURES, trees=20, depth=3, learning_rate=0.2)
    with pytest.raises(NotFitted):
        est.transform(frame)
    est.fit(frame)
    assert est.score(frame) > 0.9 and sum(est.importance().values()) == pytest.approx(1)
    out = est.transform(frame)
    assert out.where((F.col("probability") < 0) | (F.col("probability") > 1) | (F.col("log_probability") > 0)).count() == 0
    assert out.where("prediction = 1").count() > est.transform(frame, 0.9).where("prediction = 1").count()
    est.save(spark, str(tmp_path / "m"))
    again = BoostClassifier(**est.get_params()).load(spark, str(tmp_path / "m"))
    assert again.score(frame) == est.score(frame) == BoostClassifier.loads(est.dumps()).score(frame)
    with pytest.raises(TypeError):
        BoostClassifier(FEATURES, nothing=1)
    with pytest.raises(ValueError, match="missing columns"):
        est.fit(frame.drop("f0"))


def test_regressor(frame):
    df = frame.withColumn("label", F.col("f0") * 3 + F.col("f1"))
    est = BoostRegressor(FEATURES, trees=60, learning_rate=0.2, min_samples_split=10, min_child_weight=1.0).fit(df)
    assert est.score(df) > 0.9
    assert est.transform(df, uncertainty=True).where("uncertainty > 0").count() == 500
    assert BoostRegressor(FEATURES, auto=False, trees=5).fit(df).model.settings.objective == "squared"


def test_classes(frame):
    df = frame.withColumn("label", F.when(F.col("f0") > 0.5, "a").when(F.col("f0") < -0.5, "b").otherwise("c"))
    est = BoostClasses(FEATURES, trees=15, depth=3, learning_rate=0.3, min_samples_split=5, min_child_weight=1.0, mi_weight=0.0).fit(df)
    assert est.score(df) > 0.9 and sum(est.importance().values()) == pytest.approx(1)


def test_reduced_precision():
    assert precision.half(np.array([42.5]))[0] == precision.brain(np.array([42.5]))[0] == 42.5
    assert precision.dot(np.array([1.0, 2, 3]), np.array([4.0, 5, 6])) == pytest.approx(32, abs=0.1)
    big = np.array([20_000.0, 0.1])
    assert precision.dot(big, big) == float((big * big).sum())
    assert precision.weighted_sum(np.array([1.0, 2]), np.array([0.5, 0.25])) == 1.0
    assert precision.gradient_sum(np.full(10, 2.0)) == 20.0


def test_variance_split():
    y = np.array([1.0, 1, 1, 9, 9, 9])
    cells = np.stack([np.ones(6), y, y * y], axis=1)[None]
    gain, k, at = best_variance_split(cells)
    assert (k, at) == (0, 2) and gain == pytest.approx(y.var())
    assert best_variance_split(np.zeros((1, 3, 3))) == (0.0, -1, -1)


def test_alternative_settings():
    s = alternative_settings(10_000, 50, 0.1, 0.2, 4)
    assert (s.learning_rate, s.depth, s.gamma, s.patience) == (0.05, 5, 0.1, 2000) and s.reg_lambda == pytest.approx(1.2)


def classes_of(frame):
    return frame.withColumn("label", F.when(F.col("f0") > 0.5, "a").when(F.col("f0") < -0.5, "b").otherwise("c"))


def test_two_columns_of_probability(frame):
    est = BoostClassifier(FEATURES, trees=10, depth=3).fit(frame)
    rows = est.log_probabilities(est.decision(est.probabilities(frame))).collect()
    for r in rows:
        assert sum(r.probabilities) == pytest.approx(1) and r.decision == r.probabilities[1]
        assert r.log_probabilities == pytest.approx([np.log(max(p, 1e-15)) for p in r.probabilities])


def test_persistence_of_classes_and_partitions(spark, frame, tmp_path):
    settings = {"trees": 10, "depth": 3, "learning_rate": 0.3, "min_samples_split": 5, "min_child_weight": 1.0}
    many = classes_of(frame)
    for k, est in enumerate((BoostClasses(FEATURES, **settings).fit(many), BoostPartitions(FEATURES, partitions=3, **settings).fit(frame), BoostPartitions(FEATURES, partitions=2, several=True, **settings).fit(many))):
        df = many if k != 1 else frame
        out = "prediction" if k != 1 else "probability"
        want = est.transform(df).orderBy("row_id").select(out).collect()
        est.save(spark, str(tmp_path / f"m{k}"))
        again = type(est)(**est.get_params()).load(spark, str(tmp_path / f"m{k}"))
        assert again.transform(df).orderBy("row_id").select(out).collect() == want
        again = type(est).loads(est.dumps())
        assert again.transform(df).orderBy("row_id").select(out).collect() == want and again.importance() == est.importance()
    with pytest.raises(ValueError, match="deserialization failed"):
        ensembles.model_from_json("[1]")


def test_partitions_of_several_classes(frame):
    many = classes_of(frame)
    for method in ("kmeans", "random"):
        est = BoostPartitions(FEATURES, partitions=3, method=method, several=True, trees=15, depth=3, learning_rate=0.3, min_samples_split=5, min_child_weight=1.0, mi_weight=0.0).fit(many)
        assert est.transform(many).where(F.col("prediction") == F.col("label")).count() > 440
        assert est.model.predict(np.zeros((2, 4))).shape == (2, 3)
        assert est.observe_batch(many) == []
        turned = many.withColumn("label", F.when(F.col("label") == "a", "b").when(F.col("label") == "b", "a").otherwise("c"))
        drifted = [est.observe_batch(turned) for _ in range(8)][-1]
        assert drifted
        est.observe_batch(turned, retrain=True)
        assert est.transform(turned).where(F.col("prediction") == F.col("label")).count() > 400
    with pytest.raises(ValueError):
        ensembles.PartitionSettings(method="other")


def test_large_models_train_over_the_cluster(frame, monkeypatch):
    """Classes and partitions too large for a task are trained by jobs, with the same trees."""
    many, s = classes_of(frame), BoostSettings(trees=4, depth=2, learning_rate=0.3, subsample=1.0, colsample=1.0, min_samples_split=5, min_child_weight=1.0, mi_weight=0.0)
    here = ensembles.fit_classes(many, FEATURES, "label", "row_id", s), ensembles.fit_partitions(frame, FEATURES, "label", "row_id", 2, s)
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 100)
    there = ensembles.fit_classes(many, FEATURES, "label", "row_id", s), ensembles.fit_partitions(frame, FEATURES, "label", "row_id", 2, s)
    x = np.random.default_rng(1).standard_normal((200, 4))
    assert np.allclose(here[0].probabilities(x), there[0].probabilities(x)) and np.allclose(here[1].predict(x), there[1].predict(x))
    assert {p: v.baseline for p, v in here[1].state.items()} == pytest.approx({p: v.baseline for p, v in there[1].state.items()})


def test_classes_stop_early(frame):
    many = classes_of(frame)
    s = BoostSettings(trees=300, depth=2, learning_rate=0.5, patience=1, subsample=1.0, colsample=1.0, min_samples_split=5, min_child_weight=1.0)
    held = ensembles.fit_classes(many, FEATURES, "label", "row_id", s, many.where("row_id % 3 = 0"))
    assert all(m.best_score is not None and len(m.trees) < 300 for m in held.models)
    with pytest.raises(ValueError):
        ensembles.fit_classes(many.where("label = 'a'"), FEATURES, "label", "row_id", s)


def test_adaptive_classifier(frame):
    est = AdaptiveClassifier(FEATURES, trees=20, depth=3, learning_rate=0.2, loop={"cooldown": 100, "tolerance": 0.1, "least_buffer": 100})
    with pytest.raises(NotFitted):
        est.status()
    est.fit(frame, frame.where("row_id % 2 = 0"))
    assert est.status()["state"] == "normal" and est.status()["baseline"] > 0.9
    straight = adaptive.Adaptive.start(est.model, 500, *boosting.matrix(frame.where("row_id % 2 = 0").orderBy("row_id"), FEATURES, "label"))
    assert est.loop_.baseline == pytest.approx(straight.baseline, abs=1e-5) and est.loop_.alert_threshold == pytest.approx(straight.alert_threshold, abs=1e-5)
    turned = frame.withColumn("label", 1 - F.col("label"))
    reports = [est.observe_batch(turned) for _ in range(5)]
    assert any(r["adapted"] for r in reports) and est.status()["adaptations"] > 0
    assert est.model is est.loop_.model


def test_custom_loss(frame):
    pinball = lambda margin, y: (np.where(margin > y, 0.2, -0.8), np.ones_like(y))
    df = frame.withColumn("label", F.col("f0") + F.randn(1))
    for distributed in (False, True):
        model = boosting.fit(df, ["f0"], "label", "row_id", BoostSettings(objective="custom", loss=pinball, trees=30, depth=2, learning_rate=0.5, subsample=1.0, min_samples_split=5, min_child_weight=1.0), distributed=distributed)
        below = model.transform(df, "q").agg(F.avg((F.col("label") < F.col("q")).cast("double"))).first()[0]
        assert 0.6 < below < 0.95
    assert boosting.BoostModel.from_json(model.to_json()).settings.loss is None


def test_metric_report(spark, frame, tmp_path):
    est = BoostClassifier(FEATURES, trees=10, depth=3).fit(frame)
    report = metric_report(est.transform(frame), "probability", "label", "row_id", "first")
    r = report.first()
    assert r.tp + r.fp + r.fn + r.tn == 500 and 0.8 < r.roc_auc <= 1 and 0.8 < r.pr_auc <= 1
    tables.write_report(report, str(tmp_path / "r"))
    tables.write_report(report, str(tmp_path / "r"), append=True)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    assert report_text(report).startswith("first: ROC-AUC 0.")


def test_quick_train(frame):
    model = boosting.quick_train(frame, FEATURES, "label", "row_id", trees=7)
    assert len(model.trees) == 7 and model.settings.learning_rate == 0.15

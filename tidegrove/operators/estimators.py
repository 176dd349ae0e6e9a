"""Estimators over DataFrames: fit returns the estimator, transform adds predictions.

Parameters are keyword arguments of the settings; ``row_id`` names a unique column,
which makes samples and order repeatable.
"""

from __future__ import annotations

import pickle
from dataclasses import fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.functions.settings import BoostSettings, derive, derive_regression
from tidegrove.operators import ensembles
from tidegrove.operators import relational as op
from tidegrove.operators.boosting import fit, matrix
from tidegrove.operators.ordered import Ordered
from tidegrove.sources import tables


class NotFitted(RuntimeError):
    """The estimator has no model yet."""


class _Estimator:
    def __init__(self, features: list[str], label: str = "label", row_id: str = "row_id", auto: bool = True, **settings):
        unknown = set(settings) - {f.name for f in fields(BoostSettings)}
        if unknown:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        self.features, self.label, self.row_id, self.auto, self.settings = list(features), label, row_id, auto, settings
        self.model_ = None

    def get_params(self) -> dict:
        return {"features": self.features, "label": self.label, "row_id": self.row_id, "auto": self.auto, **self.settings}

    def set_params(self, **params):
        self.__init__(**{**self.get_params(), **params})
        return self

    @property
    def model(self):
        if self.model_ is None:
            raise NotFitted("fit the estimator first")
        return self.model_

    def _check(self, df: DataFrame, label: bool) -> None:
        missing = [c for c in [*self.features, *([self.label, self.row_id] if label else [])] if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")

    def save(self, spark: SparkSession, path: str) -> None:
        tables.save_models(spark, {"model": self.model}, path)

    def load(self, spark: SparkSession, path: str):
        self.model_ = tables.load_models(spark, path)["model"]
        return self

    def dumps(self) -> bytes:
        return pickle.dumps((self.get_params(), self.model.to_json()))

    @classmethod
    def loads(cls, raw: bytes):
        params, text = pickle.loads(raw)
        out = cls(**params)
        out.model_ = ensembles.model_from_json(text)
        return out

    def importance(self) -> dict[str, float]:
        return dict(zip(self.features, self.model.importance().tolist(), strict=True))


class BoostClassifier(_Estimator):
    """A binary model: positives are labels over a half."""

    def fit(self, df: DataFrame, evaluate: DataFrame | None = None, distributed: bool | None = None) -> BoostClassifier:
        self._check(df, True)
        n, ratio = df.where(F.col(self.label).isNotNull()).agg(F.count("*"), F.avg((F.col(self.label) > 0.5).cast("double"))).first()
        s = derive(n, len(self.features), ratio, **self.settings) if self.auto and n else BoostSettings(**self.settings)
        self.model_ = fit(df, self.features, self.label, self.row_id, s, evaluate, distributed)
        return self

    def transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Adds probability, log_probability (floored at 1e-15) and prediction."""
        self._check(df, False)
        out = self.model.transform(df, "probability")
        return out.withColumn("log_probability", F.log(F.greatest("probability", F.lit(1e-15)))).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Adds ``probabilities``: those of a negative and of a positive."""
        self._check(df, False)
        return self.model.transform(df, "p_").withColumn("probabilities", F.array(1 - F.col("p_"), F.col("p_"))).drop("p_")

    def log_probabilities(self, df: DataFrame) -> DataFrame:
        """Adds ``log_probabilities`` of both classes, floored at those of 1e-15."""
        self._check(df, False)
        log = lambda p: F.log(F.greatest(p, F.lit(1e-15)))
        return self.model.transform(df, "p_").withColumn("log_probabilities", F.array(log(1 - F.col("p_")), log(F.col("p_")))).drop("p_")

    def decision(self, df: DataFrame) -> DataFrame:
        """Adds ``decision``, the number that is held against a threshold: the probability of a positive."""
        self._check(df, False)
        return self.model.transform(df, "decision")

    def score(self, df: DataFrame) -> float:
        """Accuracy."""
        return self.transform(df).agg(F.avg((F.col("prediction") == (F.col(self.label) > 0.5).cast("int")).cast("double"))).first()[0]


class BoostRegressor(_Estimator):
    """Robust by itself: Huber if over 5 % of labels are outliers, squared error otherwise; or set ``objective``."""

    def fit(self, df: DataFrame, evaluate: DataFrame | None = None, distributed: bool | None = None) -> BoostRegressor:
        self._check(df, True)
        if self.auto:
            o = Ordered(df.sparkSession, df=df.select(F.col(self.label).cast("double").alias("y")).where("y IS NOT NULL"))
            stats = o.outlier_ratio("{df}", "y").first()
            s = derive_regression(stats["n"], len(self.features), stats["ratio"], o.mad("{df}", "y"), **self.settings)
        else:
            s = BoostSettings(**{"objective": "squared", "mi_weight": 0.0, **self.settings})
        self.model_ = fit(df, self.features, self.label, self.row_id, s, evaluate, distributed)
        return self

    def transform(self, df: DataFrame, uncertainty: bool = False) -> DataFrame:
        self._check(df, False)
        return self.model.transform(df, "prediction", "uncertainty" if uncertainty else None)

    def score(self, df: DataFrame) -> float:
        """R squared."""
        return op.run(df.sparkSession, op.regression_metrics("{scored}", "prediction", self.label), scored=self.transform(df)).first()["r2"]


class BoostClasses(_Estimator):
    """One model against the rest for each class; labels of any type."""

    def fit(self, df: DataFrame, evaluate: DataFrame | None = None) -> BoostClasses:
        self._check(df, True)
        self.model_ = ensembles.fit_classes(df, self.features, self.label, self.row_id, None if self.auto and not self.settings else BoostSettings(**self.settings), evaluate)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check(df, False)
        return self.model.transform(df)

    def score(self, df: DataFrame) -> float:
        return self.transform(df).agg(F.avg((F.col("prediction") == F.col(self.label).cast("string")).cast("double"))).first()[0]

    def importance(self) -> dict[str, float]:
        total = sum(m.usage() for m in self.model.models)
        return dict(zip(self.features, (total / max(total.sum(), 1)).tolist(), strict=True))


class BoostPartitions(_Estimator):
    """A specialist for each region of the features; ``partitions``, ``method`` (kmeans or random) and ``several`` (labels
    are classes) besides the settings of the specialists."""

    def __init__(self, features: list[str], label: str = "label", row_id: str = "row_id", auto: bool = True, partitions: int = 10, method: str = "kmeans", several: bool = False, **settings):
        super().__init__(features, label, row_id, auto, **settings)
        self.partitions, self.method, self.several = partitions, method, several

    def get_params(self) -> dict:
        return {**super().get_params(), "partitions": self.partitions, "method": self.method, "several": self.several}

    def fit(self, df: DataFrame) -> BoostPartitions:
        self._check(df, True)
        s = replace(ensembles.PartitionSettings().specialist, **self.settings)
        self.model_ = ensembles.fit_partitions(df, self.features, self.label, self.row_id, self.partitions, s, self.method, self.several)
        return self

    def observe_batch(self, df: DataFrame, retrain: bool = False) -> list[int]:
        """Partitions whose error has drifted; ``retrain``: they get new specialists from these rows."""
        self._check(df, True)
        drifted = self.model.observe(df, self.label)
        if retrain and drifted:
            self.model_ = self.model.retrain(df, self.label, self.row_id, drifted, replace(ensembles.PartitionSettings().specialist, **self.settings))
        return drifted

    def transform(self, df: DataFrame) -> DataFrame:
        self._check(df, False)
        return self.model.transform(df, "prediction" if self.several else "probability")

    def importance(self) -> dict[str, float]:
        one = lambda m: sum(x.usage() for x in m.models) if isinstance(m, ensembles.MultiClassModel) else m.usage()
        total = sum(one(m) for m in self.model.specialists.values())
        return dict(zip(self.features, (total / max(total.sum(), 1)).tolist(), strict=True))


class AdaptiveClassifier(BoostClassifier):
    """A binary model that observes batches and adapts to drift; ``loop`` names values of ``DriftSettings``."""

    def __init__(self, features: list[str], label: str = "label", row_id: str = "row_id", auto: bool = True, loop: dict | None = None, **settings):
        super().__init__(features, label, row_id, auto, **settings)
        self.loop, self.loop_ = dict(loop or {}), None

    def get_params(self) -> dict:
        return {**super().get_params(), "loop": self.loop}

    def fit(self, df: DataFrame, evaluate: DataFrame | None = None, distributed: bool | None = None) -> AdaptiveClassifier:
        """Without ``evaluate`` the loop is calibrated on the training rows."""
        from tidegrove.streaming.adaptive import Adaptive

        super().fit(df, evaluate, distributed)
        n = df.where(F.col(self.label).isNotNull()).count()
        self.loop_ = Adaptive.start_over(self.model, n, (df if evaluate is None else evaluate).where(F.col(self.label).isNotNull()), self.label, self.row_id, **self.loop)
        return self

    def observe_batch(self, df: DataFrame) -> dict:
        """One batch, which the driver reads in the order of the row ids; the report of the loop."""
        self._check(df, True)
        if self.loop_ is None:
            raise NotFitted("fit the estimator first")
        x, y = matrix(df.where(F.col(self.label).isNotNull()).orderBy(self.row_id), self.features, self.label)
        report = self.loop_.observe(x, y) if len(y) else {}
        self.model_ = self.loop_.model
        return report

    def status(self) -> dict:
        if self.loop_ is None:
            raise NotFitted("fit the estimator first")
        return self.loop_.status()


def metric_report(scored: DataFrame, score: str, label: str, order: str, name: str = "model", threshold: float = 0.5) -> DataFrame:
    """One row: name, roc_auc, pr_auc (ties by ``order``), precision, recall, F1, accuracy and the four counts."""
    o = Ordered(scored.sparkSession, scored=scored.select(F.col(score).alias("s"), F.col(label).alias("y"), F.col(order).alias("o")))
    counts = o.run(op.confusion("{scored}", "s", "y", threshold)).first().asDict()
    row = {"name": name, "roc_auc": o.roc_auc("{scored}", "s", "y", "o").first()[0], "pr_auc": o.pr_auc("{scored}", "s", "y", "o").first()[0], **counts}
    kinds = ", ".join(f"{k} {'string' if k == 'name' else 'long' if k in ('tp', 'fp', 'fn', 'tn') else 'double'}" for k in row)
    return scored.sparkSession.createDataFrame([tuple(row.values())], kinds)


def report_text(report: DataFrame) -> str:
    """Reports as lines of text."""
    line = "{name}: ROC-AUC {roc_auc:.6f}, PR-AUC {pr_auc:.6f}, precision {precision_:.4f} ({tp} of {hits}), recall {recall:.4f} ({tp} of {positives}), F1 {f1:.4f}, TN {tn}"
    return "\n".join(line.format(**r.asDict(), hits=r.tp + r.fp, positives=r.tp + r.fn) for r in report.collect())


def best_variance_split(hist: np.ndarray, least: int = 1) -> tuple[float, int, int]:
    """(reduction, feature, bin) by variance of the labels; hist is (features, bins, [n, y, y squared])."""
    best = (0.0, -1, -1)
    for k, cells in enumerate(hist):
        n, y, yy = cells.sum(0)
        left = np.cumsum(cells, axis=0)[:-1]
        nl, yl, yyl = left.T
        ok = (nl >= least) & (n - nl >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = (yyl - yl * yl / nl) + (yy - yyl - (y - yl) ** 2 / (n - nl))
        gain = np.where(ok, (yy - y * y / n - inside) / n, -np.inf) if n else np.zeros(0)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), k, int(gain.argmax()))
    return best


def alternative_settings(n: int, features: int, pos_ratio: float, missing: float, categories: int) -> BoostSettings:
    """A second published rule: slow and long, regularised by missing values and category counts.  Fixed values."""
    rate = 0.05 if n < 20_000 else 0.02
    return replace(
        BoostSettings(),
        learning_rate=rate,
        trees=100,
        depth=6 if features <= 20 else 5 if features <= 100 else 4,
        min_samples_split=20,
        min_child_weight=max(10.0, pos_ratio * n * 0.01),
        gamma=0.1 if missing > 0.1 else 0.0,
        reg_lambda=1.0 + 0.05 * categories,
        mi_weight=0.3 / max(pos_ratio, 1e-6),
        patience=int(np.ceil(100 / rate)),
        scale_pos_weight=(1 - pos_ratio) / max(pos_ratio, 1e-6),
        subsample=0.8,
        colsample=0.8,
    )

"""Models made of several boosted models: one against the rest, and one per partition."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrove.functions.settings import BoostSettings, PartitionDrift, derive
from tidegrove.operators.boosting import BoostModel, average_precision, fit, fit_local, free_name, trains_here


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def last_max(x: np.ndarray) -> np.ndarray:
    """Index of the largest in each row, the last one on ties."""
    return x.shape[1] - 1 - x[:, ::-1].argmax(1)


@dataclass
class MultiClassModel:
    """A binary model per class; probabilities are a softmax over the models' probabilities."""

    classes: list
    models: list[BoostModel]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(np.stack([m.predict(x) for m in self.models], axis=1))

    def predict(self, x: np.ndarray) -> list:
        return [self.classes[i] for i in last_max(self.probabilities(x))]

    def to_json(self) -> str:
        return json.dumps({"kind": "classes", "classes": self.classes, "models": [m.to_json() for m in self.models]})

    @classmethod
    def from_json(cls, text: str) -> MultiClassModel:
        d = json.loads(text)
        return cls(d["classes"], [BoostModel.from_json(m) for m in d["models"]])

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with the class predicted (as text) and an array of probabilities; a narrow pass."""
        names = [*df.columns, output, "probabilities"]
        schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType()), T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
        features = self.models[0].bins.features
        at = [df.columns.index(f) for f in features]

        def run(batches):
            for batch in batches:
                x = np.stack([batch.column(k).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for k in at], axis=1) if batch.num_rows else np.zeros((0, len(at)))
                p = self.probabilities(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([str(self.classes[i]) for i in last_max(p)], pa.string()), pa.array(list(p), pa.list_(pa.float64()))], names=names)

        return df.mapInArrow(run, schema)


def _binary(label: str, c) -> F.Column:
    return (F.col(label) == F.lit(c)).cast("double")


def fit_classes(df: DataFrame, features: list[str], label: str, row_id: str, settings: BoostSettings | None = None, evaluate: DataFrame | None = None) -> MultiClassModel:
    """One model per class, with early stopping on ``evaluate`` if given; a class that fails to train raises.

    Models small enough for one process are trained as parallel tasks, each with a copy of the rows; larger ones one
    after the other over the cluster."""
    known = df.where(F.col(label).isNotNull())
    counts = known.groupBy(label).count().orderBy(label).collect()
    classes, n = [r[0] for r in counts], sum(r["count"] for r in counts)
    if len(classes) < 2:
        raise ValueError("labels of at least two classes are needed")
    held = None if evaluate is None else evaluate.where(F.col(label).isNotNull())
    if not trains_here(n, len(features)):
        models = []
        for c, many in zip(classes, (r["count"] for r in counts), strict=True):
            s = settings or derive(n, len(features), many / n)
            one = free_name(known, "one")
            models.append(fit(known.withColumn(one, _binary(label, c)), features, one, row_id, s, None if held is None else held.withColumn(one, _binary(label, c))))
        return MultiClassModel(classes, models)
    cols = [F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)]
    pick = lambda some, h: some.select(F.xxhash64(row_id).alias("row"), F.col(label).alias("label"), F.lit(h).alias("held"), *cols)
    rows = pick(known, False) if held is None else pick(known, False).union(pick(held, True))
    each = rows.withColumn("class_", F.explode(F.array(*(F.lit(k) for k in range(len(classes))))))
    names = [f"f{i}" for i in range(len(features))]

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["class_"].iloc[0])
        pdf = pdf.sort_values(["row", *names], kind="stable")
        y, x, apart = (pdf["label"] == classes[k]).to_numpy(float), pdf[names].to_numpy(float), pdf["held"].to_numpy(bool)
        s = settings or derive(int((~apart).sum()), len(features), float(y[~apart].mean()))
        model = fit_local(x[~apart], y[~apart], features, s, (x[apart], y[apart]) if apart.any() else None, ids=pdf["row"].to_numpy()[~apart])
        return pd.DataFrame({"class_": [k], "json": [model.to_json()]})

    found = {r.class_: BoostModel.from_json(r.json) for r in each.groupBy("class_").applyInPandas(train, "class_ int, json string").collect()}
    return MultiClassModel(classes, [found[k] for k in range(len(classes))])


# --- partitions -----------------------------------------------------------------------


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center, the first on ties; a missing coordinate counts as no distance."""
    d = np.nan_to_num(x[:, None, :] - centers[None]) ** 2
    return d.sum(2).argmin(1)


def distances(features: list[str], centers: np.ndarray):
    """A column: the array of squared distances to literal centers, in generated code, without a join."""
    apart = [f"(nanvl(CAST(`{f}` AS DOUBLE), CAST(NULL AS DOUBLE)) - CAST({{!r}} AS DOUBLE))" for f in features]
    # Summed from the first coordinate on; a missing one counts nothing.  Text, as a call for each term would take longer than the query.
    one = lambda c: " + ".join(f"coalesce({(t := x.format(float(v)))} * {t}, 0.0D)" for x, v in zip(apart, c, strict=True))
    return F.expr(f"array({', '.join(map(one, centers))})")


def nearest_expression(features: list[str], centers: np.ndarray):
    """The nearest center as a column."""
    d = distances(features, centers)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def fit_centers(df: DataFrame, features: list[str], row_id: str, k: int, iterations: int = 10) -> np.ndarray:
    """k-means: start at the rows of least hash, a fixed number of rounds, an empty cluster's center becomes zero.

    A round is one aggregate with k rows of result."""
    n = df.count()
    if k > n:
        raise ValueError("more partitions than rows")
    some = df.orderBy(F.xxhash64(row_id), row_id).limit(k).select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).collect()
    centers = np.array([list(r) for r in some])
    for _ in range(iterations):
        means = df.withColumn("p_", nearest_expression(features, centers)).groupBy("p_").agg(*(F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features))).collect()
        centers = np.zeros((k, len(features)))
        for r in means:
            centers[r.p_] = [r[f"m{i}"] or 0.0 for i in range(len(features))]
    return centers


def random_centers(features: int, k: int, seed: int = 1) -> np.ndarray:
    """Centers between -1 and 1 in each coordinate: the partitions of an ensemble that isn't fitted to the rows."""
    return np.random.default_rng(seed).uniform(-1, 1, (k, features))


@dataclass
class PartitionState:
    """Error of a partition: at training, and its moving average since."""

    baseline: float
    ema: float
    seen: int = 0


@dataclass(frozen=True)
class PartitionSettings:
    """How an ensemble is cut and its specialists are trained (the published defaults)."""

    partitions: int = 10
    method: str = "kmeans"
    iterations: int = 10
    seed: int = 1
    specialist: BoostSettings = BoostSettings(trees=200, depth=6, learning_rate=0.05, patience=50, mi_weight=0.3)
    drift: PartitionDrift = PartitionDrift()

    def __post_init__(self):
        if self.method not in ("kmeans", "random"):
            raise ValueError(f"unknown method {self.method}")
        if self.partitions < 1:
            raise ValueError("at least one partition is needed")


@dataclass
class PartitionedModel:
    """A specialist for each partition, the general model where there is none.  ``classes``: of a model of several classes."""

    features: list[str]
    centers: np.ndarray
    specialists: dict[int, BoostModel | MultiClassModel]
    general: BoostModel | MultiClassModel
    state: dict[int, PartitionState]
    drift: PartitionDrift = PartitionDrift()

    @property
    def classes(self) -> list | None:
        return self.general.classes if isinstance(self.general, MultiClassModel) else None

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: of a positive, or of each class."""
        part = nearest(x, self.centers)
        out = np.zeros(len(x) if self.classes is None else (len(x), len(self.classes)))
        for p in np.unique(part):
            mine = part == p
            out[mine] = _probabilities(self.specialists.get(int(p), self.general), x[mine], self.classes)
        return out

    def labels(self, x: np.ndarray) -> np.ndarray:
        """The label predicted, as a number: 1 for a positive, or the index of the class."""
        p = self.predict(x)
        return last_max(p) if self.classes else (p > 0.5).astype(int)

    def observe(self, df: DataFrame, label: str, alpha: float | None = None) -> list[int]:
        """Partitions whose error has drifted: its moving average is far over the baseline."""
        alpha = self.drift.alpha if alpha is None else alpha
        cols = [F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(self.features)]
        truth = _index(label, self.classes).alias("y")
        width = len(cols) + 1

        def errors(batches):
            for batch in batches:
                x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1) if batch.num_rows else np.zeros((0, width))
                wrong = self.labels(x[:, :-1]) != x[:, -1]
                yield pa.RecordBatch.from_arrays([pa.array(nearest(x[:, :-1], self.centers).astype(np.int32)), pa.array(wrong.astype(float))], names=["p", "wrong"])

        rates = df.where(F.col(label).isNotNull()).select(*cols, truth).mapInArrow(errors, "p int, wrong double").groupBy("p").agg(F.avg("wrong").alias("e"), F.count("*").alias("n")).orderBy("p").collect()
        drifted = []
        for r in rates:
            s = self.state.setdefault(r.p, PartitionState(r.e, r.e))
            s.ema, s.seen = alpha * r.e + (1 - alpha) * s.ema, s.seen + r.n
            if s.ema > self.drift.factor * max(s.baseline, self.drift.least):
                drifted.append(r.p)
        return drifted

    def retrain(self, df: DataFrame, label: str, row_id: str, partitions: list[int], settings: BoostSettings) -> PartitionedModel:
        """New specialists for these partitions only (those with enough rows)."""
        found = _train_parts(df, self.features, label, row_id, self.centers, settings, partitions, self.drift.retrain_rows, self.classes)
        state = {**self.state, **{p: PartitionState(e, e) for p, (_, e) in found.items()}}
        return replace(self, specialists={**self.specialists, **{p: m for p, (m, _) in found.items()}}, state=state)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with the probability of a positive, or the class (as text) and ``probabilities``; a narrow pass."""
        names = [*df.columns, output, *(["probabilities"] if self.classes else [])]
        kinds = [T.StringType(), T.ArrayType(T.DoubleType())] if self.classes else [T.DoubleType()]
        schema = T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in zip(names[len(df.columns) :], kinds, strict=True))])
        at = [df.columns.index(f) for f in self.features]

        def run(batches):
            for batch in batches:
                x = np.stack([batch.column(k).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for k in at], axis=1) if batch.num_rows else np.zeros((0, len(at)))
                p = self.predict(x)
                found = [pa.array([str(self.classes[i]) for i in last_max(p)], pa.string()), pa.array(list(p), pa.list_(pa.float64()))] if self.classes else [pa.array(p)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=names)

        return df.mapInArrow(run, schema)

    def to_json(self) -> str:
        return to_json(self)


def _probabilities(model: BoostModel | MultiClassModel, x: np.ndarray, classes: list | None) -> np.ndarray:
    """A specialist may have met only some of the classes."""
    if classes is None:
        return model.predict(x)
    out = np.zeros((len(x), len(classes)))
    out[:, [classes.index(c) for c in model.classes]] = model.probabilities(x)
    return out


def _index(label: str, classes: list | None) -> F.Column:
    """The label as a number: 1 for a positive, or the index of the class."""
    if classes is None:
        return (F.col(label) > 0.5).cast("double")
    return (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("double")


def _train_parts(df: DataFrame, features: list[str], label: str, row_id: str, centers: np.ndarray, settings: BoostSettings, only: list[int] | None, least: int, classes: list | None = None) -> dict[int, tuple[BoostModel | MultiClassModel, float]]:
    """Of each partition with enough rows the specialist and its error on them.

    Partitions small enough for one process are trained as parallel tasks, larger ones over the cluster."""
    cols = [F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)]
    names = [f"f{k}" for k in range(len(features))]
    known = df.where(F.col(label).isNotNull()).withColumn("p_", nearest_expression(features, centers))
    if only is not None:
        known = known.where(F.col("p_").isin(only))
    sizes = {r.p_: r["count"] for r in known.groupBy("p_").count().collect()}
    large = [p for p, n in sizes.items() if not trains_here(n, len(features))]

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", *names], kind="stable")
        x, y, ids = pdf[names].to_numpy(float), pdf["y"].to_numpy(float), pdf["row"].to_numpy()
        if classes is None:
            model = fit_local(x, y, features, settings, ids=ids)
            wrong = (model.predict(x) > 0.5) != (y > 0.5)
        else:
            seen = sorted(set(y.astype(int).tolist()))
            model = MultiClassModel([classes[k] for k in seen], [fit_local(x, (y == k).astype(float), features, settings, ids=ids) for k in seen])
            wrong = np.array(seen)[last_max(model.probabilities(x))] != y
        return pd.DataFrame({"p": np.array([pdf["p_"].iloc[0]], np.int32), "json": [model.to_json()], "error": [float(wrong.mean())]})

    small = [p for p, n in sizes.items() if p not in large and n >= least]
    rows = known.where(F.col("p_").isin(small)).select("p_", F.xxhash64(row_id).alias("row"), _index(label, classes).alias("y"), *cols)
    out = {r.p: (model_from_json(r.json), r.error) for r in rows.groupBy("p_").applyInPandas(train, "p int, json string, error double").collect()} if small else {}
    for p in sorted(large):
        mine = known.where(F.col("p_") == p).drop("p_")
        model = fit(mine, features, label, row_id, settings) if classes is None else fit_classes(mine, features, label, row_id, settings)
        scored = model.transform(mine.select(*features, label), "p_")
        wrong = (F.col("p_") > 0.5) != (F.col(label) > 0.5) if classes is None else F.col("p_") != F.col(label).cast("string")
        out[p] = (model, scored.agg(F.avg(wrong.cast("double"))).first()[0])
    return out


def fit_partitions(df: DataFrame, features: list[str], label: str, row_id: str, k: int, settings: BoostSettings, method: str = "kmeans", several: bool = False) -> PartitionedModel:
    """Partitions around centers (by k-means, or random ones), a specialist each, and a general model for partitions of
    too few rows.  ``several``: the labels are classes of any number and type."""
    cfg = PartitionSettings(partitions=k, method=method, specialist=settings)
    known = df.where(F.col(label).isNotNull())
    centers = fit_centers(known, features, row_id, k, cfg.iterations) if method == "kmeans" else random_centers(len(features), k, cfg.seed)
    general = fit_classes(known, features, label, row_id, settings) if several else fit(known, features, label, row_id, settings)
    found = _train_parts(known, features, label, row_id, centers, settings, None, cfg.drift.least_rows, general.classes if several else None)
    return PartitionedModel(features, centers, {p: m for p, (m, _) in found.items()}, general, {p: PartitionState(e, e) for p, (_, e) in found.items()}, cfg.drift)


def validation_weights(model: PartitionedModel, x: np.ndarray, y: np.ndarray) -> dict[int, float]:
    """Average precision of each specialist on its share of validation rows, at least .5; 1 for five rows or fewer."""
    part = nearest(x, model.centers)
    return {int(p): max(0.5, average_precision(model.predict(x[part == p]), y[part == p])) if (part == p).sum() > 5 else 1.0 for p in np.unique(part)}


def to_json(model: PartitionedModel) -> str:
    return json.dumps({"kind": "partitions", "features": model.features, "centers": model.centers.tolist(), "general": model.general.to_json(), "specialists": {str(k): m.to_json() for k, m in model.specialists.items()}, "state": {str(k): [s.baseline, s.ema, s.seen] for k, s in model.state.items()}})


def from_json(text: str) -> PartitionedModel:
    d = json.loads(text)
    return PartitionedModel(d["features"], np.array(d["centers"]), {int(k): model_from_json(m) for k, m in d["specialists"].items()}, model_from_json(d["general"]), {int(k): PartitionState(*s) for k, s in d["state"].items()})


def model_from_json(text: str | bytes) -> BoostModel | MultiClassModel | PartitionedModel:
    """Whichever model a text holds."""
    try:
        kind = json.loads(text).get("kind")
        if kind in ("classes", "partitions"):
            return MultiClassModel.from_json(text) if kind == "classes" else from_json(text)
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"deserialization failed: {e}") from e
    return BoostModel.from_json(text)

"""Reading and writing: text tables, and models as tables or JSON."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ready_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's folder or, on one machine that names none, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tidegrove-checkpoints"))


def read_labelled_csv(spark: SparkSession, path: str, label: str | None = None, skip: int = 1) -> DataFrame:
    """A CSV file with a header: features as doubles (what doesn't parse is null), the label 0 where it doesn't parse.

    Without a label name the first ``skip`` columns are dropped and the last one is
    the label.  Rows of a single cell are dropped.  Everything is read as text, so
    there is no pass to infer types."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = raw.columns
    target = label or names[-1]
    features = [c for c in (names if label else names[skip:]) if c != target]
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)")
    many = F.size(F.array_compact(F.array(*(F.col(f"`{c}`") for c in names)))) >= 2
    return raw.where(many).select(*(number(c).alias(c) for c in features), F.coalesce(number(target), F.lit(0.0)).alias(target))


def from_arrays(spark: SparkSession, x, y=None, names: list[str] | None = None) -> DataFrame:
    """numpy arrays as a table with ``row_id``, features and, if given, ``label``."""
    import numpy as np
    import pandas as pd

    x = np.asarray(x, float)
    frame = pd.DataFrame(x, columns=names or [f"f{k}" for k in range(x.shape[1])])
    frame.insert(0, "row_id", np.arange(len(x)))
    if y is not None:
        frame["label"] = np.asarray(y, float)
    return spark.createDataFrame(frame)


def synthetic(spark: SparkSession, n: int, features: int, seed: int = 42) -> DataFrame:
    """Normal features f0 .. and ``label`` = f0 + f1 + f2 / 2 > 0."""
    df = spark.range(n).withColumnRenamed("id", "row_id").select("row_id", *(F.randn(seed + k).alias(f"f{k}") for k in range(features)))
    return df.withColumn("label", (F.col("f0") + F.col("f1") + 0.5 * F.col("f2") > 0).cast("double"))


_MODELS = T.StructType([T.StructField("model_id", T.StringType()), T.StructField("json", T.StringType())])


def save_models(spark: SparkSession, models: dict[str, object], path: str) -> None:
    """Models by name as a Parquet table of their JSON."""
    spark.createDataFrame([(k, m.to_json()) for k, m in models.items()], _MODELS).coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[str, object]:
    from tidegrove.operators.ensembles import model_from_json

    return {r.model_id: model_from_json(r.json) for r in spark.read.schema(_MODELS).parquet(path).collect()}


def write_report(report: DataFrame, path: str, append: bool = False) -> None:
    """Metric reports (see ``estimators.metric_report``) as a Parquet table, a row each."""
    report.coalesce(1).write.mode("append" if append else "overwrite").parquet(path)

"""Named queries over the star-schema tables, with their SQL twins.

A relational query is one text: Spark plans it over DataFrames, and the twin is
the same text over plain table names, run by an independent engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.functions import scalar as fn
from tidegrove.operators import ensembles, estimators
from tidegrove.operators import relational as op
from tidegrove.operators.ordered import Ordered, clock, literal
from tidegrove.operators.relational import round6
from tidegrove.plans import models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _batched(name: str, sql: str) -> None:
    """A query over events in batches of a thousand."""
    _relational(name, sql, plan=lambda o: o.run(sql.replace(_BATCHED, o.batches(_EVENTS, ["ts", "event_id"], 1000, clock("ts")))))


def _relational(name: str, sql: str, spark_sql: str | None = None, plan: Callable[[Ordered], DataFrame] | None = None) -> None:
    """``spark_sql`` or ``plan``: what Spark runs instead, while ``sql`` stays the twin."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    # Histograms take one scan in Spark.
    text = spark_sql or sql.replace(_HIST, _HIST_SPARK).replace(_SMALL, _SMALL_SPARK)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
        return plan(Ordered(spark, **frames)) if plan else op.run(spark, text, **frames)

    query.__name__ = name
    QUERIES[name] = query
    ORACLES[name] = sql.format(**{t: t for t in tables})


# Relations that several queries share.
_R = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS y, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS q FROM {lineitem})"
_BINS = "(SELECT CAST(floor(l_discount * 100 + 0.5) AS INT) AS b0, CAST(floor(l_tax * 100 + 0.5) AS INT) AS b1, CAST(floor((l_quantity - 1) / 2) AS INT) AS b2, CAST(floor(l_extendedprice / 4000) AS INT) AS b3, CASE WHEN l_returnflag = 'R' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS y FROM {lineitem})"
_FEATURES = ["b0", "b1", "b2", "b3"]
_P = "CAST(0.33 AS DOUBLE)"
_HIST = op.histogram(_BINS, _FEATURES, *fn.logistic(_P, "y", 2.0), "y")
_SMALL = op.histogram(_BINS, _FEATURES, *fn.logistic(_P, "y", 2.0), "y", "b2 <= 8")
_HIST_SPARK = op.histogram_in_one_scan(_BINS, _FEATURES, *fn.logistic(_P, "y", 2.0), "y")
_SMALL_SPARK = op.histogram_in_one_scan(_BINS, _FEATURES, *fn.logistic(_P, "y", 2.0), "y", "b2 <= 8")
_ORDERS = "(SELECT o_orderkey, o_totalprice, o_orderstatus, 1.0 / (1.0 + exp(-(o_totalprice - 150000.0) / 60000.0)) AS p, CASE WHEN o_orderstatus = 'F' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS y FROM {orders})"
_EVENTS = "(SELECT event_id, ts, value, user_id, event_type, CASE WHEN event_type = 'error' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS y, 1.0 / (1.0 + exp(-(value - 50.0) / 25.0)) AS p, value - 48.0 AS err FROM {events})"
_BATCHED = f"({op.batches(_EVENTS, 'ts, event_id', 1000)})"
_TREE_A = [{"feature": 0, "threshold": 3, "left": 1, "right": 2}, {"feature": 2, "threshold": 8, "left": 3, "right": 4}, {"value": 0.4}, {"value": -0.25}, {"value": 0.1}]
_TREE_B = [{"feature": 1, "threshold": 4, "left": 1, "right": 2}, {"value": -0.3}, {"feature": 3, "threshold": 9, "left": 3, "right": 4}, {"value": 0.2}, {"value": 0.55}]
_MARGIN = f"(SELECT b0, b1, b2, b3, y, {op.score_expression(_TREE_A, 'b{}')} AS s1, {op.score_expression(_TREE_B, 'b{}')} AS s2 FROM {_BINS} AS z)"

# Profiles and automatic settings.
_PROFILED = (_R, ["q", "l_extendedprice", "l_discount", "l_tax"], "y")
_relational("profile_columns", op.profile(*_PROFILED), op.profile_in_one_scan(*_PROFILED))
_relational("pos_ratio_base_score", op.base_log_odds(_R, "y"))
_relational("auto_config", models.auto_settings_sql(_R, "y", 4))
_relational("upper_median", f"SELECT {round6('v')} AS v FROM ({op.upper_median('{events}', 'value')}) AS m", plan=lambda o: o.statistics("{events}", "value", v="floor(n / 2)").selectExpr("round(v, 6) AS v"))
_relational("mad", f"SELECT {round6('v')} AS v FROM ({op.mad('{events}', 'value')}) AS m", plan=lambda o: o.run(f"SELECT {round6(literal(o.mad('{events}', 'value')))} AS v"))
_relational("iqr_outlier_ratio", op.outlier_ratio("{lineitem}", "l_extendedprice"), plan=lambda o: o.outlier_ratio("{lineitem}", "l_extendedprice"))
_relational("regressor_auto_config", models.regressor_settings_sql("{lineitem}", "l_extendedprice", 3), plan=lambda o: models.regressor_settings(o, "{lineitem}", "l_extendedprice", 3))
_relational("column_stats_by_type", f"SELECT event_type, count(*) AS n, {round6('avg(value)')} AS mean, {round6('var_pop(value)')} AS var FROM {{events}} AS t GROUP BY event_type")

# Binning.
_relational("quantile_edges", op.quantile_edges("{lineitem}", "l_extendedprice"), plan=lambda o: o.quantile_edges("{lineitem}", "l_extendedprice"))
_relational("value_edges", op.quantile_edges("{lineitem}", "l_discount"), plan=lambda o: o.quantile_edges("{lineitem}", "l_discount"))
_LINE = "CAST(l_linenumber AS DOUBLE)"
_relational("bin_floor_regime", op.bin_counts("{lineitem}", "l_extendedprice", op.quantile_edges("{lineitem}", "l_extendedprice")), plan=lambda o: o.bin_counts("{lineitem}", "l_extendedprice", o.quantile_edges("{lineitem}", "l_extendedprice")))
_relational("bin_ceil_regime", op.bin_counts("{lineitem}", _LINE, op.quantile_edges("{lineitem}", _LINE)), plan=lambda o: o.bin_counts("{lineitem}", _LINE, o.quantile_edges("{lineitem}", _LINE)))
_relational("impute_median", f"SELECT count(*) AS n, count(q) AS known, {round6('sum(coalesce(q, (SELECT v FROM (' + op.upper_median(_R, 'q') + ') AS m)))')} AS total FROM {_R} AS t", plan=lambda o: o.run(f"SELECT count(*) AS n, count(q) AS known, {round6(f'sum(coalesce(q, {literal(o.upper_median(_R, chr(113)))}))')} AS total FROM {_R} AS t"))

# Losses.
_relational("logistic_grad_hess", op.gradient_sums(_R, "l_returnflag", fn.logistic("(l_discount * 5.0 + 0.2)", "y", 2.5), "y"))
_relational("poisson_grad_hess", op.gradient_sums(_R, "l_returnflag", fn.poisson("(l_tax * 20.0)", "l_quantity"), "l_quantity"))
_relational("huber_grad_hess", op.gradient_sums(_R, "l_returnflag", fn.huber("(l_discount * 300.0)", "l_quantity", "CAST(10.0 AS DOUBLE)"), "l_quantity"))
_relational("mse_grad", op.gradient_sums(_R, "l_returnflag", fn.squared("(l_discount * 300.0)", "l_quantity"), "l_quantity"))
_relational("poisson_deviance", op.poisson_deviance(_R, "(l_tax * 20.0)", "l_quantity"))
_relational("mean_base_score", f"SELECT {round6('avg(l_quantity)')} AS base_score, {round6('ln(avg(l_quantity))')} AS log_base_score FROM {{lineitem}} AS t")
_relational("gradient_norm", f"SELECT {round6('sqrt(sum(g * g))')} AS norm, {round6('avg(g)')} AS mean, {round6('min(p)')} AS low, {round6('max(p)')} AS high FROM (SELECT p, {fn.logistic('p', 'y')[0]} AS g FROM {_ORDERS} AS o) AS t")

# Histograms and splits.
_h6 = "SELECT feature, bin, " + ", ".join(f"{round6(c)} AS {c}" for c in ("g", "h", "y")) + ", CAST(n AS BIGINT) AS n FROM ({}) AS x"
_relational("grad_histogram", _h6.replace("{}", _HIST))
_relational("hist_subtract", _h6.replace("{}", op.subtract(_HIST, _SMALL)))
_relational("prefix_sums", f"SELECT feature, bin, {round6('gl')} AS gl, {round6('hl')} AS hl, {round6('gt')} AS gt, CAST(nl AS BIGINT) AS nl, CAST(nt AS BIGINT) AS nt FROM ({op.prefix_sums(_HIST)}) AS x")
_relational("split_gain", f"SELECT feature, bin, {round6('gain')} AS gain FROM ({op.split_gains(_HIST, 1.0, 0.1, 1.0)}) AS x")
_relational("split_gain_entropy_ungated", f"SELECT feature, bin, {round6('gain')} AS gain FROM ({op.split_gains(_HIST, 1.0, 0.1, 1.0, 0.3)}) AS x")
_relational("best_split_feature", f"SELECT feature, bin, {round6('gain')} AS gain FROM ({op.best_split(_HIST, lam=1.0, gamma=0.1, min_child=1.0)}) AS x")

_PRICED = f"(SELECT b0, b1, b2, b3, v FROM (SELECT *, CAST(b3 AS DOUBLE) * 4.0 + b0 AS v FROM {_BINS} AS z0) AS z1)"
_BEST = f"SELECT feature, bin, {round6('reduction')} AS reduction FROM ({{}}) AS s"
_relational("variance_split", _BEST.replace("{}", op.variance_split(op.variance_histogram(_PRICED, _FEATURES, "v"))), _BEST.replace("{}", op.variance_split(op.variance_histogram_in_one_scan(_PRICED, _FEATURES, "v"))))

# Trees and scores.
_relational("depth2_tree_score", f"SELECT s1, s2, count(*) AS n, {round6('sum(y)')} AS y FROM {_MARGIN} AS t GROUP BY s1, s2")
_relational("leaf_values", f"SELECT feature, bin, {round6(fn.leaf('g', 'h', 1.0))} AS value FROM ({_HIST}) AS x")
_relational("margin_clamp", f"SELECT {round6('sum(' + fn.clamp('l_extendedprice / 1000.0 - 30.0') + ')')} AS total, {round6('max(' + fn.clamp('l_extendedprice / 1000.0 - 30.0') + ')')} AS high FROM {{lineitem}} AS t")
_relational("sigmoid_prob", f"SELECT {round6('sum(' + fn.sigmoid('s1 + s2') + ')')} AS p, {round6('sum(' + fn.logit(fn.sigmoid('s1 + s2')) + ')')} AS m, {round6('sum(ln(greatest(' + fn.sigmoid('s1') + ', 0.000000000000001)))')} AS log_p FROM {_MARGIN} AS t")
_relational(
    "staged_uncertainty",
    f"SELECT s1, s2, {round6('0.1 + 0.5 * (s1 + s2)')} AS prediction, {round6('sqrt(greatest(0.0, (a * a + b * b + c * c) / 3.0 - ((a + b + c) / 3.0) * ((a + b + c) / 3.0)))')} AS spread "
    f"FROM (SELECT DISTINCT s1, s2, CAST(0.1 AS DOUBLE) AS a, 0.1 + 0.5 * s1 AS b, 0.1 + 0.5 * s1 + 0.5 * s2 AS c FROM {_MARGIN} AS t) AS x",
)

# Metrics.
_relational("roc_auc", op.roc_auc(_ORDERS, "p", "y", "o_orderkey"), plan=lambda o: o.roc_auc(_ORDERS, "p", "y", "o_orderkey"))
_relational("pr_auc", op.pr_auc(_ORDERS, "p", "y", "o_orderkey"), plan=lambda o: o.pr_auc(_ORDERS, "p", "y", "o_orderkey"))
_relational("roc_auc_by_score", op.roc_auc_by_score(_BINS, "b0", "y"), plan=lambda o: o.roc_auc_by_score(_BINS, "b0", "y"))
_relational("pr_auc_by_score", op.pr_auc_by_score(_BINS, "b0", "y"), plan=lambda o: o.pr_auc_by_score(_BINS, "b0", "y"))
_relational(
    "probability_columns",
    f"SELECT y, count(*) AS n, {round6('sum(1.0 - p)')} AS p0, {round6('sum(p)')} AS p1, {round6('sum(ln(greatest(1.0 - p, 0.000000000000001)))')} AS log_p0, {round6('sum(ln(greatest(p, 0.000000000000001)))')} AS log_p1 FROM {_ORDERS} AS t GROUP BY y",
)
_REPORT = f"SELECT r.auc AS roc_auc, q.auc AS pr_auc, c.* FROM ({op.roc_auc(_ORDERS, 'p', 'y', 'o_orderkey')}) AS r CROSS JOIN ({op.pr_auc(_ORDERS, 'p', 'y', 'o_orderkey')}) AS q CROSS JOIN ({op.confusion(_ORDERS, 'p', 'y')}) AS c"
_relational("metric_report", _REPORT, plan=lambda o: estimators.metric_report(o.run(f"SELECT p, y, o_orderkey FROM {_ORDERS} AS t"), "p", "y", "o_orderkey").drop("name"))
_relational("confusion_f1", op.confusion(_ORDERS, "p", "y"))
_relational("threshold_sweep", op.threshold_sweep(_ORDERS, "p", "y"), op.threshold_sweep_in_one_scan(_ORDERS, "p", "y"))
_relational("class_f1_counts", op.class_f1_counts(_ORDERS, "CASE WHEN p < 0.3 THEN 'P' WHEN p < 0.6 THEN 'F' ELSE 'O' END", "o_orderstatus"))
_relational("macro_f1", op.macro_f1(_ORDERS, "CASE WHEN p < 0.3 THEN 'P' WHEN p < 0.6 THEN 'F' ELSE 'O' END", "o_orderstatus"))
_relational("rmse_mae_r2", op.regression_metrics("{lineitem}", "l_quantity * 1500.0", "l_extendedprice"))

# Several classes.
_relational("ovr_label_expand", f"SELECT c.class, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = c.class THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM {{orders}} AS t JOIN (VALUES ('F'), ('O'), ('P')) AS c(class) ON true GROUP BY c.class")
_relational(
    "ovr_softmax_argmax",
    f"SELECT CASE WHEN c >= b AND c >= a THEN 2 WHEN b >= a THEN 1 ELSE 0 END AS predicted, count(*) AS n, {round6('sum(exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)))')} AS pa "
    f"FROM (SELECT a, b, c, greatest(a, b, c) AS m FROM (SELECT p AS a, 1.0 - p AS b, abs(p - 0.5) AS c FROM {_ORDERS} AS o) AS x) AS t GROUP BY 1",
)

# Batches, buffers, drift.
_batched("batch_metrics", f"SELECT batch, count(*) AS n, {round6('avg(abs(err))')} AS mae, {round6('sqrt(avg(err * err))')} AS rmse, {round6('avg(y)')} AS pos_ratio FROM {_BATCHED} AS t GROUP BY batch")
_relational("rolling_buffer", f"SELECT event_id, {round6('value')} AS value FROM ({op.newest(_EVENTS, 'event_id', 500)}) AS b")
_relational("vulnerability_baseline", op.vulnerability_baseline(_EVENTS, "p", "y"))
_VULNERABLE = f"(SELECT * FROM (SELECT *, {fn.vulnerability('p', 'y', '0.2')} AS v FROM {_EVENTS} AS e) AS w WHERE abs(y - p) > 0.2)"
_relational("vulnerability_ema", op.ema(_VULNERABLE, "v", "event_id"), plan=lambda o: o.ema(_VULNERABLE, "v", ["event_id"]))
_batched(
    "recent_weighted_rmse",
    f"SELECT batch, {round6('0.5 * rmse + 0.3 * lag(rmse, 1) OVER (ORDER BY batch) + 0.2 * lag(rmse, 2) OVER (ORDER BY batch)')} AS weighted "
    f"FROM (SELECT batch, sqrt(avg(err * err)) AS rmse FROM {_BATCHED} AS t GROUP BY batch) AS b",
)
_batched("recent_avg_metric", f"SELECT batch, {round6('avg(mae) OVER (ORDER BY batch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS recent FROM (SELECT batch, avg(abs(err)) AS mae FROM {_BATCHED} AS t GROUP BY batch) AS b")
_batched("smoothed_validation", f"SELECT batch, {round6('avg(mae) OVER (ORDER BY batch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS smoothed FROM (SELECT batch, avg(abs(err)) AS mae FROM {_BATCHED} AS t GROUP BY batch) AS b")
_batched(
    "recent_avg_pr_auc",
    f"SELECT batch, {round6('avg(auc) OVER (ORDER BY batch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS recent FROM ("
    "SELECT batch, CASE WHEN max(pt) = 0 THEN 0.0 ELSE sum(CASE WHEN y > 0 THEN tp / seen ELSE 0.0 END) / max(pt) END AS auc FROM ("
    "SELECT batch, y, sum(y) OVER (PARTITION BY batch ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, "
    "count(*) OVER (PARTITION BY batch ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen, sum(y) OVER (PARTITION BY batch) AS pt "
    f"FROM {_BATCHED} AS t) AS r GROUP BY batch) AS b",
)
_relational("error_entropy", op.error_entropy(_EVENTS, "abs(err)"))
_relational("residual_autocorr", op.autocorrelation(_EVENTS, "err", "event_id"), plan=lambda o: o.autocorrelation(_EVENTS, "err", ["event_id"]))
_relational("heteroscedasticity", op.heteroscedasticity(_EVENTS, "p", "err", "event_id"), plan=lambda o: o.heteroscedasticity(_EVENTS, "p", "err", "event_id"))
_relational("feature_mean_shift", op.mean_shift(_EVENTS, ["value", "p"], "event_id"), plan=lambda o: o.mean_shift(_EVENTS, ["value", "p"], ["event_id"]))
_relational("feature_volatility", f"SELECT {round6('sqrt(avg((value - md) * (value - md)))')} AS volatility FROM (SELECT value, (SELECT v FROM ({op.upper_median('{events}', 'value')}) AS m) AS md FROM {{events}} AS e) AS t", plan=lambda o: o.run(f"SELECT {round6('sqrt(avg((value - md) * (value - md)))')} AS volatility FROM (SELECT value, {literal(o.upper_median('{events}', 'value'))} AS md FROM {{events}} AS e) AS t"))
_relational(
    "drift_strategy",
    op.drift_strategy(_EVENTS, ["value"], [f"(SELECT v FROM ({op.upper_median('{events}', 'value')}) AS m)"], "p", "y"),
    plan=lambda o: o.run(op.drift_strategy(_EVENTS, ["value"], [literal(o.upper_median("{events}", "value"))], "p", "y")),
)
_relational("feature_decay", op.decay(_EVENTS, "user_id", "event_id"))
_relational("minority_error_rate", f"SELECT {round6('avg(CASE WHEN p < 0.5 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)')} AS rate, count(*) AS n FROM {_EVENTS} AS t WHERE y > 0.5")
# Diagnoses of twenty groups of events: entropy, autocorrelation and spread of the errors.
_GROUPED = f"(SELECT event_type AS t, CAST(user_id % 4 AS INT) AS u, event_id, err, abs(err) AS e FROM {_EVENTS} AS e0)"
_SPREAD = f"(SELECT t, u, max(e) AS top, avg(e) AS mu, count(*) AS k, sqrt(avg(err * err)) AS rmse, var_pop(e) AS het, var_pop(err) AS var FROM {_GROUPED} AS g GROUP BY t, u)"
_EVEN = (
    "(SELECT t, u, sum(-share * log2(share)) AS h FROM (SELECT t, u, n / CAST(sum(n) OVER (PARTITION BY t, u) AS DOUBLE) AS share FROM "
    f"(SELECT g.t, g.u, least(floor(g.e / (s.top + 0.0000000001) * 10), 9) AS b, count(*) AS n FROM {_GROUPED} AS g JOIN {_SPREAD} AS s ON g.t = s.t AND g.u = s.u GROUP BY 1, 2, 3) AS c) AS d GROUP BY t, u)"
)
_LAGGED = (
    "(SELECT t, u, sum(d * coalesce(after, 0.0)) / sum(d * d) AS acf FROM (SELECT t, u, d, lead(d) OVER (PARTITION BY t, u ORDER BY event_id DESC) AS after FROM "
    f"(SELECT g.t, g.u, g.event_id, g.e - s.mu AS d FROM {_GROUPED} AS g JOIN {_SPREAD} AS s ON g.t = s.t AND g.u = s.u) AS x) AS y GROUP BY t, u)"
)
_GRID = f"(SELECT s.t, s.u, s.k * 40 AS n, e.h, l.acf, s.het / 8.0 AS het, s.rmse, s.var / 300.0 AS cx, s.rmse / 20.0 - 1.0 AS deg FROM {_SPREAD} AS s JOIN {_EVEN} AS e ON s.t = e.t AND s.u = e.u JOIN {_LAGGED} AS l ON s.t = l.t AND s.u = l.u)"
_score = fn.drift_score("h", "acf", "het", "rmse")
_relational("drift_score", f"SELECT t, u, n, {fn.drift_kind('h')} AS kind, {round6(_score)} AS score FROM {_GRID} AS t")
_relational("new_tree_count", f"SELECT t, u, n, {fn.tree_count(_score, 'abs(acf)', 'least(het / rmse, 1.0)', 'n', 'cx', 'deg')} AS trees FROM {_GRID} AS t")
_relational("complexity", f"SELECT {round6('var_pop(err) + 0.5 * var_pop(p)')} AS complexity FROM {_EVENTS} AS t")

# Partitions: the rows of the first ten vectors are the centers.
_DIMS, _CENTERS = 64, 10


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, list[float]]]:
    """vec_id, label, c0 .. and the nearest center (partition_, distance): literal centers, so there is no join."""
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(f"c{i}") for i in range(_DIMS)))
    names = [f"c{i}" for i in range(_DIMS)]
    centers = {r.vec_id: [r[c] for c in names] for r in points.where(F.col("vec_id") < _CENTERS).orderBy("vec_id").collect()}
    found = points.select("*", ensembles.distances(names, np.array(list(centers.values()))).alias("d_"))
    return found.select("vec_id", "label", *names, (F.array_position("d_", F.array_min("d_")) - 1).cast("int").alias("partition_"), F.array_min("d_").alias("distance")), centers


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _assigned(spark, sf_dir)
    return rows.select("vec_id", "partition_", F.round("distance", 6).alias("distance"))


def kmeans_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New centers, zero for one without rows, in one aggregate."""
    rows, centers = _assigned(spark, sf_dir)
    known = spark.createDataFrame([(int(k),) for k in centers], "partition_ int")
    means = rows.groupBy("partition_").agg(*(F.avg(f"c{i}").alias(f"c{i}") for i in range(_DIMS)), F.count("*").alias("n"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return known.join(F.broadcast(means), "partition_", "left").select("partition_", *(zero(F.col(f"c{i}")).alias(f"c{i}") for i in range(_DIMS)), F.coalesce("n", F.lit(0)).alias("n"))


def partition_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _assigned(spark, sf_dir)
    return rows.groupBy("partition_").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") != F.col("partition_")).cast("double")), 6).alias("error"))


def _assigned_sql() -> tuple[str, str]:
    points = "(SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS c{i}" for i in range(_DIMS)) + " FROM embeddings)"
    centers = f"(SELECT CAST(vec_id AS INT) AS partition_, {', '.join(f'c{i}' for i in range(_DIMS))} FROM {points} AS z WHERE vec_id < {_CENTERS})"
    return f"(SELECT n.partition_, n.distance, q.* FROM ({op.nearest_center(points, centers, _DIMS, 'vec_id')}) AS n JOIN {points} AS q ON n.vec_id = q.vec_id)", centers


_ASSIGNED, _KNOWN = _assigned_sql()
QUERIES |= {f.__name__: f for f in (nearest_centroid, kmeans_one_step, partition_error)}
ORACLES["nearest_centroid"] = f"SELECT vec_id, partition_, {round6('distance')} AS distance FROM {_ASSIGNED} AS n"
ORACLES["kmeans_one_step"] = f"SELECT k.partition_, {', '.join(round6(f'coalesce(avg(a.c{i}), 0.0)') + f' AS c{i}' for i in range(_DIMS))}, count(a.vec_id) AS n FROM {_KNOWN} AS k LEFT JOIN {_ASSIGNED} AS a ON k.partition_ = a.partition_ GROUP BY k.partition_"
ORACLES["partition_error"] = f"SELECT partition_, count(*) AS n, {round6('avg(CASE WHEN label <> partition_ THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)')} AS error FROM {_ASSIGNED} AS a GROUP BY partition_"

# Fitted models, and operators on their trees; whole models and the replay of drift have no SQL form.
QUERIES |= models.QUERIES
ORACLES |= models.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best first split of lineitem for the label R, from histograms of gradients."""
    return QUERIES["best_split_feature"](spark, sf_dir)

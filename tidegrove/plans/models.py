"""Queries that fit models, and the SQL of automatic settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.functions import settings as st
from tidegrove.functions.settings import BoostSettings
from tidegrove.operators import ensembles
from tidegrove.operators import relational as op
from tidegrove.operators.boosting import BoostModel, fit
from tidegrove.operators.ordered import Ordered, clock
from tidegrove.operators.relational import round6
from tidegrove.sources.tables import ready_checkpoints
from tidegrove.streaming import adaptive


def _case(pairs: list[tuple[str, object]], other: object) -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in pairs)} ELSE {other} END"


def auto_settings_sql(rel: str, label: str, features: int) -> str:
    """The settings of ``settings.derive`` in SQL, from the same tables of tiers."""
    level = _case([(f"r < {e} OR r > {1 - e}", f"'{n}'") for e, n in st.IMBALANCE], "'balanced'")
    size = _case([(f"n < 1000 OR {features} < 10", "'trivial'"), (f"n < 10000 AND {features} < 50", "'simple'"), (f"n > 100000 OR {features} > 200", "'complex'")], "'standard'")
    rate = _case([("level = 'extreme'", 0.025), *((f"size = '{k}'", v) for k, v in st.RATES.items())], 0.08)
    depth = _case([(f"size = '{k}' AND level = '{i}'", v) for k, d in st.DEPTHS.items() for i, v in d.items()] + [(f"size = '{k}'", v) for k, v in st.USUAL_DEPTH.items()], 5)
    trees = _case([(f"size = '{k}'", f"greatest({a}, least({b}, floor(50 * ln(n))))") for k, (a, b) in st.TREES.items()], 300)
    patience = _case([(f"n < {int(e)}", p) for e, p in st.PATIENCE if e < 1e9], st.PATIENCE[-1][1]) + " + " + _case([("level = 'extreme'", 20), ("level = 'high'", 10)], 0)
    child = _case([(f"level = '{k}'", f"greatest({a}, least({b}, n * r * {s}))") for k, (s, a, b) in st.CHILD.items()], "greatest(1.0, least(5.0, n * r * 0.005))")
    lam = _case([(f"level = '{k}'", v) for k, v in st.LAMBDAS.items()], 0.10)
    mi = _case([(f"level = '{k}'", v) for k, v in st.MI.items()], 0.05)
    return f"""
    SELECT level, size, {round6(rate)} AS learning_rate, CAST({depth} AS INT) AS depth, CAST({trees} AS INT) AS trees, CAST({patience} AS INT) AS patience,
           {round6(f"({lam}) * sqrt({features})")} AS reg_lambda, {round6(child)} AS min_child_weight, {round6(mi)} AS mi_weight,
           {round6("(1.0 - r) / greatest(r, 0.000001)")} AS scale_pos_weight
    FROM (SELECT n, r, {level} AS level, {size} AS size
          FROM (SELECT count(*) AS n, avg(CASE WHEN {label} > 0.5 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END) AS r FROM {rel} AS t) AS a) AS b"""


def regressor_settings_sql(rel: str, label: str, features: int) -> str:
    """The settings of ``settings.derive_regression`` in SQL."""
    return f"""
    SELECT CASE WHEN ratio > 0.05 THEN 'huber' ELSE 'squared' END AS objective, {round6("1.35 * spread")} AS huber_delta,
           {round6("CASE WHEN n < 5000 THEN 0.1 ELSE 0.05 END")} AS learning_rate, CAST(greatest(4, least(8, floor(ln({features})) + 3)) AS INT) AS depth,
           {round6(f"0.1 * sqrt({features})")} AS reg_lambda, CAST(greatest(200, least(2000, 100 * floor(ln(n)))) AS INT) AS trees
    FROM (SELECT n, ratio, (SELECT v FROM ({op.mad(rel, label)}) AS m) AS spread FROM ({op.outlier_ratio(rel, label)}) AS o) AS x"""


def regressor_settings(o: Ordered, rel: str, label: str, features: int) -> DataFrame:
    """The same from order statistics that run on many machines."""
    r = o.outlier_ratio(rel, label).first()
    s = st.derive_regression(r["n"], features, r["ratio"], o.mad(rel, label))
    row = (s.objective, round(s.huber_delta, 6), s.learning_rate, s.depth, round(s.reg_lambda, 6), s.trees)
    return o.spark.createDataFrame([row], "objective string, huber_delta double, learning_rate double, depth int, reg_lambda double, trees int")


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_QUICK = BoostSettings(trees=12, depth=4, learning_rate=0.2, subsample=1.0, colsample=1.0, min_samples_split=20, min_child_weight=1.0, mi_weight=0.05)


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    charge = F.col("l_extendedprice") * (1 - 5 * F.col("l_discount")) * (1 + F.col("l_tax")) / 1000
    tier = F.when(charge > 45, "high").when(charge > 20, "middle").otherwise("low")
    return df.select(*_FEATURES, charge.alias("charge"), tier.alias("tier"), key.alias("row_id"), (charge > 25).cast("double").alias("y"))


def fit_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prediction and rows by label of a model fitted on all of lineitem."""
    df = _lineitem(spark, sf_dir)
    scored = fit(df, _FEATURES, "y", "row_id", _QUICK).transform(df.select(*_FEATURES, "y"), "p")
    return scored.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_p"))


def fit_binary_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of a model fitted by a Spark job per level."""
    model = fit(_lineitem(spark, sf_dir), _FEATURES, "y", "row_id", BoostSettings(**{**_QUICK.__dict__, "trees": 2, "depth": 3}), distributed=True)
    return model.tree_table(spark)


def fit_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lineitem(spark, sf_dir)
    s = BoostSettings(**{**_QUICK.__dict__, "objective": "squared", "mi_weight": 0.0})
    model = fit(df, _FEATURES, "charge", "row_id", s)
    scored = model.transform(df.select(*_FEATURES, "charge"), "p", spread="spread")
    return op.run(spark, op.regression_metrics("{scored}", "p", "charge"), scored=scored)


def fit_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lineitem(spark, sf_dir)
    model = ensembles.fit_classes(df, _FEATURES, "tier", "row_id", _QUICK)
    return model.transform(df.select(*_FEATURES, "tier")).groupBy("tier", "prediction").agg(F.count("*").alias("n"))


def partitioned_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lineitem(spark, sf_dir)
    model = ensembles.fit_partitions(df, _FEATURES, "y", "row_id", 4, _QUICK)
    return spark.createDataFrame([(p, s.baseline) for p, s in sorted(model.state.items())], "partition int, error double")


def adaptive_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the adaptive loop over events in batches of a thousand, in order of time.

    The first quarter trains, the second calibrates, the rest is observed, its last third with labels turned round.
    The driver holds a batch and the loop's buffer, whatever the size of the table."""
    features = ["value", "user"]
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "value", F.col("user_id").cast("double").alias("user"), (F.col("value") > 60).cast("double").alias("y"))
    o = Ordered(spark, events=events)
    ready_checkpoints(spark)
    rows = o.run(f"SELECT event_id, value, user, y, rn, n_, floor(n_ / 4) AS q FROM {o.numbered('{events}', ['ts', 'event_id'], clock('ts'))} AS e").checkpoint()
    first = rows.where("rn <= q")
    model = fit(first, features, "y", "event_id", _QUICK)
    loop = adaptive.Adaptive.start_over(model, first.count(), rows.where("rn > q AND rn <= 2 * q"), "y", "event_id", cooldown=1000)
    later = rows.where("rn > 2 * q").orderBy("rn").select("value", "user", F.when(F.col("rn") > 3 * F.col("q"), 1 - F.col("y")).otherwise(F.col("y")))
    reports, batch = [], []

    def observe() -> None:
        x = np.array(batch, float)
        reports.append(loop.observe(x[:, :2], x[:, 2]))
        batch.clear()

    for row in later.toLocalIterator():
        batch.append(tuple(row))
        if len(batch) == 1000:
            observe()
    if batch:
        observe()
    return spark.createDataFrame([(k, float(r["pr_auc"]), float(r["ema"]), r["state"], bool(r["adapted"]), r["trees"]) for k, r in enumerate(reports)], "batch int, pr_auc double, ema double, state string, adapted boolean, trees int")


# --- first trees: small enough to be said in SQL as well --------------------------------

_FIRST = BoostSettings(trees=1, depth=2, learning_rate=0.2, subsample=1.0, colsample=1.0, min_samples_split=20, min_child_weight=1.0, mi_weight=0.0, reg_lambda=1.0, gamma=0.1)
_TIERS = ("high", "low", "middle")
_CHARGE = "(l_extendedprice * (1.0 - 5.0 * l_discount) * (1.0 + l_tax) / 1000.0)"


def first_tree_sql(rel: str, features: list[str], label: str, s: BoostSettings) -> str:
    """The first tree of a model in plain SQL, by edges, bins, gradients at the base score, histograms and best splits:
    (path, kind, feature, threshold, value), where a path says left or right from the root on."""
    edges = ", ".join(f"e{k} AS (SELECT list(edge ORDER BY edge) AS edges FROM ({op.quantile_edges(rel, f, s.bins)}) AS q)" for k, f in enumerate(features))
    below = lambda k, f: f"len(list_filter((SELECT edges FROM e{k}), lambda x: x < {f}))"
    size = lambda k: f"len((SELECT edges FROM e{k}))"
    bins = ", ".join(f"CASE WHEN {size(k)} <= 8 THEN least({below(k, f)}, {size(k)} - 1) ELSE greatest({below(k, f)} - 1, 0) END AS b{k}" for k, f in enumerate(features))
    if s.objective == "logistic":
        base = "SELECT greatest(-10.0, ln(count(*) FILTER (y > 0.5) / CAST(greatest(count(*) FILTER (NOT y > 0.5), 1) AS DOUBLE))) AS f FROM rows_"
        g, h = "1.0 / (1.0 + exp(-f)) - y", "(1.0 / (1.0 + exp(-f))) * greatest(1.0 - 1.0 / (1.0 + exp(-f)), 0.000001)"
    else:
        base, g, h = "SELECT avg(y) AS f FROM rows_", "f - y", "1.0"
    parts = [f"rows_ AS (SELECT {label} AS y, {', '.join(f'{f} AS x{k}' for k, f in enumerate(features))} FROM {rel} AS t)", edges]
    parts.append(f"base AS ({base})")
    parts.append(f"n0 AS (SELECT '' AS path, {g} AS g, {h} AS h, {bins.replace(' < ', ' < ')} FROM rows_, base)")
    for k, f in enumerate(features):
        parts[-1] = parts[-1].replace(f"x < {f}", f"x < x{k}")
    chosen = "CASE s.feature " + " ".join(f"WHEN {k} THEN b{k}" for k in range(len(features))) + " END"
    for depth in range(s.depth):
        cells = " UNION ALL ".join(f"SELECT path, {k} AS feature, b{k} AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM n{depth} GROUP BY path, b{k}" for k in range(len(features)))
        run, whole = "OVER (PARTITION BY path, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "OVER (PARTITION BY path, feature)"
        gain = f"0.5 * (gl * gl / (hl + {s.reg_lambda!r}) + (gt - gl) * (gt - gl) / (ht - hl + {s.reg_lambda!r}) - gt * gt / (ht + {s.reg_lambda!r})) - {s.gamma!r}"
        live = f"hl >= {s.min_child_weight!r} AND ht - hl >= {s.min_child_weight!r} AND nt >= {s.min_samples_split} AND ht >= {s.min_child_weight!r}" + (f" AND abs(gt) >= {0.01 * s.min_child_weight!r}" if depth else "")
        parts.append(
            f"s{depth} AS (SELECT path, feature, bin AS threshold FROM (SELECT path, feature, bin, gain, row_number() OVER (PARTITION BY path ORDER BY gain DESC, feature, bin) AS rank_ FROM ("
            f"SELECT path, feature, bin, {gain} AS gain FROM (SELECT path, feature, bin, max(bin) {whole} AS last, sum(g) {run} AS gl, sum(h) {run} AS hl, sum(g) {whole} AS gt, sum(h) {whole} AS ht, sum(n) {whole} AS nt FROM ({cells}) AS c) AS p "
            f"WHERE bin < last AND {live}) AS q) AS r WHERE rank_ = 1 AND gain > 0.000001)"
        )
        kept = ", ".join(["n.g", "n.h", *(f"n.b{k}" for k in range(len(features)))])
        parts.append(f"n{depth + 1} AS (SELECT n.path || CASE WHEN {chosen} <= s.threshold THEN 'L' ELSE 'R' END AS path, {kept} FROM n{depth} AS n JOIN s{depth} AS s ON n.path = s.path)")
    nodes = " UNION ALL ".join(f"SELECT path, -sum(g) / (sum(h) + {s.reg_lambda!r}) AS value FROM n{d} GROUP BY path" for d in range(s.depth + 1))
    splits = " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(s.depth))
    return f"""
    WITH {', '.join(parts)}
    SELECT a.path, CASE WHEN b.feature IS NULL THEN 'leaf' ELSE 'split' END AS kind, CAST(b.feature AS INT) AS feature, CAST(b.threshold AS INT) AS threshold, CASE WHEN b.feature IS NULL THEN {round6("a.value")} END AS value
    FROM ({nodes}) AS a LEFT JOIN ({splits}) AS b ON a.path = b.path"""


def tree_rows(models: list[BoostModel]) -> list[tuple]:
    """(tree_id, path, kind, feature, threshold, value) of all trees of some models."""
    out = []
    for i, t in enumerate(t for m in models for t in m.trees):
        todo = [(0, "")]
        while todo:
            at, path = todo.pop()
            split = t.left[at] >= 0
            out.append((i, path, "split" if split else "leaf", int(t.feature[at]) if split else None, int(t.threshold[at]) if split else None, None if split else round(float(t.value[at]), 6)))
            if split:
                todo += [(t.left[at], path + "L"), (t.right[at], path + "R")]
    return out


_TREE_ROWS = "tree_id int, path string, kind string, feature int, threshold int, value double"


def first_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tree of a binary model, trained in one process if the rows fit one, else over the cluster."""
    return spark.createDataFrame(tree_rows([fit(_lineitem(spark, sf_dir), _FEATURES, "y", "row_id", _FIRST)]), _TREE_ROWS).drop("tree_id")


def first_tree_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with a Spark job per level."""
    return spark.createDataFrame(tree_rows([fit(_lineitem(spark, sf_dir), _FEATURES, "y", "row_id", _FIRST, distributed=True)]), _TREE_ROWS).drop("tree_id")


def first_tree_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = replace(_FIRST, objective="squared")
    return spark.createDataFrame(tree_rows([fit(_lineitem(spark, sf_dir), _FEATURES, "charge", "row_id", s)]), _TREE_ROWS).drop("tree_id")


def first_trees_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tree of each class against the rest; classes in the order of their names."""
    model = ensembles.fit_classes(_lineitem(spark, sf_dir), _FEATURES, "tier", "row_id", _FIRST)
    return spark.createDataFrame(tree_rows(model.models), _TREE_ROWS)


_TIER_SQL = f"CASE WHEN {_CHARGE} > 45 THEN 'high' WHEN {_CHARGE} > 20 THEN 'middle' ELSE 'low' END"
_ONE_HOT = [f"CASE WHEN {_TIER_SQL} = '{c}' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END" for c in _TIERS]
_BY_CLASS = " UNION ALL ".join(f"SELECT {k} AS tree_id, x.* FROM ({first_tree_sql('lineitem', _FEATURES, y, _FIRST)}) AS x" for k, y in enumerate(_ONE_HOT))
_BINARY = first_tree_sql("lineitem", _FEATURES, f"CASE WHEN {_CHARGE} > 25 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END", _FIRST)

_DEAD = "(SELECT * FROM (VALUES (1), (3)) AS v(feature))"
#: Operators on tables of trees, over those of ``first_trees_by_class``.
_ON_TREES = {
    "feature_usage": op.feature_usage("{trees}"),
    "tree_dependency": op.dependency("{trees}", _DEAD),
    "prune_trees": op.prune("{trees}", _DEAD, 0.7),
    "truncate_trees": "SELECT tree_id, count(*) AS nodes FROM {trees} AS t WHERE tree_id <= 1 GROUP BY tree_id",
}


def _on_trees(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.run(spark, _ON_TREES[name], trees=first_trees_by_class(spark, sf_dir))

    query.__name__ = name
    return query


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders by a digest of their key: repeatable anywhere, without a shuffle; the feature is the sampling."""
    return op.run(spark, op.sample("{orders}", "o_orderkey", 0.1), orders=spark.read.parquet(f"{sf_dir}/orders.parquet")).select("o_orderkey")


QUERIES = {f.__name__: f for f in (fit_binary, fit_binary_distributed, fit_regressor, fit_multiclass, partitioned_fit, adaptive_replay, first_tree, first_tree_distributed, first_tree_regression, first_trees_by_class, hash_sample)}
QUERIES |= {name: _on_trees(name) for name in _ON_TREES}
ORACLES = {
    "first_tree": _BINARY,
    "first_tree_distributed": _BINARY,
    "first_tree_regression": first_tree_sql("lineitem", _FEATURES, _CHARGE, replace(_FIRST, objective="squared")),
    "first_trees_by_class": _BY_CLASS,
    # The digest's first eight hexadecimal digits, as a share of all.
    "hash_sample": "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) < 429496729",
}
ORACLES |= {name: sql.replace("{trees}", f"({_BY_CLASS})") for name, sql in _ON_TREES.items()}

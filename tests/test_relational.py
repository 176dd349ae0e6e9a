"""Every relational query against its SQL twin in an independent engine, and golden scalars."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from tidegrove.functions import scalar as fn
from tidegrove.functions import settings as st
from tidegrove.operators import relational as op
from tidegrove.operators.boosting import find_bins, pick_edges
from tidegrove.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    return f"{v:.5f}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(catalog.ORACLES[name])
    names = list(rel.columns)
    want = sorted(tuple(norm(row[names.index(c)]) for c in sorted(names)) for row in rel.fetchall())
    assert cols == sorted(names) and got == want and got


def one(spark, expression: str):
    return spark.sql(f"SELECT {expression}").first()[0]


def test_golden_scalars(spark):
    for y, f in ((1.0, 0.1), (0.0, 0.5), (3.0, 1.2), (2.0, 0.8)):
        g, h = fn.poisson(f"CAST({f} AS DOUBLE)", f"CAST({y} AS DOUBLE)")
        assert one(spark, g) == pytest.approx(math.exp(f) - y) and one(spark, h) == pytest.approx(math.exp(f))
    for f, g in ((0.5, 0.5), (1.5, 1.0), (3.0, 1.0)):
        assert one(spark, fn.huber(f"CAST({f} AS DOUBLE)", "0.0D", "1.0D")[0]) == pytest.approx(g)
    assert one(spark, fn.sigmoid("0.0D")) == 0.5
    assert one(spark, fn.entropy("5.0D", "10.0D")) == 1.0
    assert one(spark, fn.entropy("0.0D", "10.0D")) == 0.0
    assert one(spark, fn.leaf("1.0D", "0.0D", 0.0)) == 0.0
    tree = [{"feature": 0, "threshold": 3, "left": 1, "right": 2}, {"value": 0.1}, {"value": 0.9}]
    score = op.score_expression(tree)
    assert spark.sql(f"SELECT {score} AS s FROM (VALUES (2), (5)) AS v(f0)").collect() == [(0.1,), (0.9,)]


def test_poisson_loss(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.69), (3.0, 1.10)], "y double, f double")
    assert op.run(spark, op.poisson_deviance("{df}", "f", "y"), df=df).first()[0] < 0.5


@pytest.mark.parametrize("bins", [4, 32])
def test_edges_in_sql_equal_numpy(spark, bins):
    rng = random.Random(bins)
    for m in (1, 3, bins, bins + 1, 500):
        values = sorted({round(rng.uniform(-5, 5), 2) for _ in range(m)})
        df = spark.createDataFrame([(v,) for v in values * 2] + [(None,), (float("nan"),)], "v double")
        got = [r.edge for r in op.run(spark, op.quantile_edges("{df}", "v", bins), df=df).orderBy("k").collect()]
        assert got == pick_edges(np.array(values), bins).tolist()
        counts = {r.bin: r.n for r in op.run(spark, op.bin_counts("{df}", "v", op.quantile_edges("{df}", "v", bins)), df=df.where("NOT isnan(v)")).collect()}
        b = find_bins(np.array(got), np.array(values))
        assert counts == {int(k): 2 * int(n) for k, n in zip(*np.unique(b, return_counts=True))}


def test_missing_values_and_empty_tables(spark):
    empty = spark.createDataFrame([], "v double, y double, p double, o long")
    for sql in (op.upper_median("{df}", "v"), op.error_entropy("{df}", "v"), op.heteroscedasticity("{df}", "p", "v", "o"), op.roc_auc("{df}", "p", "y", "o"), op.regression_metrics("{df}", "p", "y"), op.base_log_odds("{df}", "y")):
        assert op.run(spark, sql, df=empty).count() == 1
    assert op.run(spark, op.mad("{df}", "v"), df=empty).first()[0] == 1.0
    assert op.run(spark, op.quantile_edges("{df}", "v"), df=empty).count() == 0
    ones = spark.createDataFrame([(1.0, 0.5, k) for k in range(4)], "y double, p double, o long")
    assert op.run(spark, op.roc_auc("{df}", "p", "y", "o"), df=ones).first()[0] == 0.5
    assert op.run(spark, op.pr_auc("{df}", "p", "y", "o"), df=ones).first()[0] == 1.0


def test_histograms_add_up(spark, duck):
    total = duck.sql("select count(*) from lineitem").fetchall()[0][0]
    rows = catalog.QUERIES["grad_histogram"](spark, SF).collect()
    for k in range(4):
        assert sum(r.n for r in rows if r.feature == k) == total


def test_derived_settings():
    s = st.derive(170_000, 30, 0.002)
    assert (s.learning_rate, s.depth, s.patience, s.mi_weight) == (0.025, 8, 50, 0.25)
    assert s.trees == 700 and s.scale_pos_weight == pytest.approx(499)
    assert st.derive(500, 4, 0.5).depth == 4
    assert st.derive(5_000, 20, 0.05, depth=9).depth == 9
    assert st.derive_regression(1000, 20, 0.1, 2.0).huber_delta == pytest.approx(2.7)
    with pytest.raises(ValueError):
        st.BoostSettings(bins=300)


def plain(v):
    return None if v is None else round(float(v), 6)


@pytest.mark.parametrize(("rows", "parts"), [(0, 64), (9, 3), (400, 3)])
def test_forms_over_ranges_equal_plain_ones(spark, monkeypatch, rows, parts):
    """With nulls, NaN, ties, a value that half of the rows have, and empty tables."""
    from tidegrove.operators import ordered

    monkeypatch.setattr(ordered, "PARTS", parts)
    rng = random.Random(rows)
    data = []
    for i in range(rows):
        v = rng.choice([7.0, 7.0, 7.0, round(rng.gauss(0, 3), 1), rng.gauss(0, 3), None, float("nan")])
        data.append((i, v, rng.choice([0.25, round(rng.random(), 2)]), float(rng.random() < 0.4), round(rng.gauss(0, 5), 2)))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "o long, v double, p double, y double, e double").repartition(3)
    o = ordered.Ordered(spark, df=df)
    same = lambda a, b: [[plain(x) for x in r] for r in a.collect()] == [[plain(x) for x in r] for r in b.collect()]
    old = lambda sql: op.run(spark, sql, df=df)
    assert plain(o.upper_median("{df}", "v")) == plain(old(op.upper_median("{df}", "v")).first()[0])
    assert plain(o.mad("{df}", "v")) == plain(old(op.mad("{df}", "v")).first()[0])
    assert same(o.outlier_ratio("{df}", "p"), old(op.outlier_ratio("{df}", "p")))
    for bins in (4, 32):
        assert same(o.quantile_edges("{df}", "v", bins).orderBy("k"), old(op.quantile_edges("{df}", "v", bins)).orderBy("k"))
    if rows:
        edges = o.quantile_edges("{df}", "p", 32)
        assert same(o.bin_counts("{df}", "p", edges).orderBy("bin"), old(op.bin_counts("{df}", "p", op.quantile_edges("{df}", "p", 32))).orderBy("bin"))
    if rows:
        assert same(o.roc_auc("{df}", "p", "y", "o"), old(op.roc_auc("{df}", "p", "y", "o")))
        assert same(o.pr_auc("{df}", "p", "y", "o"), old(op.pr_auc("{df}", "p", "y", "o")))
        assert same(o.roc_auc_by_score("{df}", "p", "y"), old(op.roc_auc_by_score("{df}", "p", "y")))
        assert same(o.pr_auc_by_score("{df}", "p", "y"), old(op.pr_auc_by_score("{df}", "p", "y")))
    for order in (["o"], ["p", "o"]):
        text = ", ".join(order)
        assert same(o.ema("{df}", "e", order), old(op.ema("{df}", "e", text)))
        assert same(o.run(f"SELECT o, batch FROM {o.batches('{df}', order, 7)} AS b ORDER BY o"), old(f"SELECT o, batch FROM ({op.batches('{df}', text, 7)}) AS b ORDER BY o"))
    if rows:
        assert same(o.autocorrelation("{df}", "e", ["o"]), old(op.autocorrelation("{df}", "e", "o")))
    assert same(o.heteroscedasticity("{df}", "p", "e", "o"), old(op.heteroscedasticity("{df}", "p", "e", "o")))
    shift = lambda f: sorted((r.feature, plain(r["shift"]), r.drifted) for r in f.collect())
    assert shift(o.mean_shift("{df}", ["p", "e"], ["o"], 50, 5)) == shift(old(op.mean_shift("{df}", ["p", "e"], "o", 50, 5)))
    assert sorted(map(tuple, old(op.profile_in_one_scan("{df}", ["v", "p"], "y")).collect())) == [r for r in sorted(map(tuple, old(op.profile("{df}", ["v", "p"], "y")).collect())) if rows]
    assert same(old(op.threshold_sweep_in_one_scan("{df}", "p", "y")), old(op.threshold_sweep("{df}", "p", "y"))) or not rows

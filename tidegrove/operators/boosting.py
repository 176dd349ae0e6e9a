"""Second-order gradient-boosted trees on quantile bins.

Bins come from one aggregate job per feature set; a bin model is a small table
that is applied as numpy lookups in Arrow batches or as SQL.  Trees grow level
by level from histograms of gradients.  The histograms come either from a numpy
array in one task (``LocalRows``: small models, one-vs-rest classes, partitions)
or from a Spark job per level (``SparkRows``): partial histograms by numpy in
each task, added by key, so only nodes * features * bins rows reach the driver.
Both feed the same split search.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.functions.settings import BoostSettings, RegressionDrift

MARGIN = 10.0
#: Rows times columns (the features, and four for label, id, margin and gradients) up to which a model is trained in one
#: task.  Training takes some 40 bytes a cell beside the JVM, in the driver's process if it is not a task of many.
LOCAL_CELLS = 10_000_000


# --- bins -----------------------------------------------------------------------


def pick_edges(distinct: np.ndarray, bins: int) -> np.ndarray:
    """Edges from sorted distinct values: finer in the outer tenths."""
    m = len(distinct)
    if m <= bins:
        return distinct if m else np.zeros(1)
    i, q = np.arange(bins + 1), bins // 4
    share = np.where(i < q, 0.10 * i / (bins / 4), np.where(i > 3 * bins // 4, 0.90 + 0.10 * (i - 3 * bins // 4) / (bins / 4), 0.10 + 0.80 * (i - q) / (bins / 2)))
    return np.unique(distinct[np.minimum(np.floor((m - 1) * share + 0.5).astype(np.int64), m - 1)])


def find_bins(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Up to eight edges: the first not below x, else the last.  More: the last below x, else 0."""
    below = np.searchsorted(edges, x, "left")
    return np.minimum(below, len(edges) - 1) if len(edges) <= 8 else np.maximum(below - 1, 0)


@dataclass
class BinModel:
    """Edges and median (what a missing value becomes) of each feature."""

    features: list[str]
    edges: list[np.ndarray]
    medians: list[float]

    def transform(self, x: np.ndarray) -> np.ndarray:
        """Bins (n, features) of a matrix in which NaN is missing."""
        out = np.empty(x.shape, np.int16)
        for k, (edges, median) in enumerate(zip(self.edges, self.medians, strict=True)):
            col = np.where(np.isnan(x[:, k]), median, x[:, k])
            out[:, k] = find_bins(edges, col)
        return out

    @property
    def widths(self) -> list[int]:
        return [len(e) for e in self.edges]


def fit_bins(df: DataFrame, features: list[str], bins: int = 32) -> BinModel:
    """Exact edges over distinct values and exact medians, one plan for all features.

    Each feature's values are cut into ranges (see ``ordered``); a window is over the distinct values of one range of one
    feature, and what reaches the driver is at most bins + 2 values a feature."""
    from pyspark.sql import Window as W

    from tidegrove.operators.ordered import Ordered, edge_shares, part

    value = [f"CAST(`{f}` AS DOUBLE)" for f in features]
    cuts = Ordered(df.sparkSession, df=df).cuts("{df}", *value)
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.expr(v).alias("v"), F.expr(part(v, c)).alias("part")) for k, (v, c) in enumerate(zip(value, cuts, strict=True))))
    long = df.select(F.explode(cells).alias("e")).select("e.*")
    counts = long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("k", "part", "v").agg(F.count("*").alias("c"))
    ranges = counts.groupBy("k", "part").agg(F.count("*").alias("pm"), F.sum("c").alias("pn"))
    # A row a range: at most features * (ordered.PARTS + 1).
    before = W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("pm", "pn")] + [F.sum("pm").over(W.partitionBy("k")).alias("m"), F.sum("pn").over(W.partitionBy("k")).alias("n")]
    order = W.partitionBy("k", "part").orderBy("v")
    ranked = counts.join(F.broadcast(ranges.select("k", "part", *totals)), ["k", "part"]).select(
        "k", "v", "c", "m", "n", (F.row_number().over(order) - 1 + F.col("before_pm")).alias("at"), (F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("before_pn")).alias("upto")
    )
    wanted = F.array(*(F.floor((F.col("m") - 1) * s + 0.5) for s in edge_shares(bins)))
    is_edge = (F.col("m") <= bins) | F.array_contains(wanted, F.col("at").cast("long"))
    is_median = (F.floor(F.col("n") / 2) >= F.col("upto") - F.col("c")) & (F.floor(F.col("n") / 2) < F.col("upto"))
    edges: list[list[float]] = [[] for _ in features]
    medians = [0.0] * len(features)
    for r in ranked.where(is_edge | is_median).select("k", "v", is_edge.alias("edge"), is_median.alias("median")).collect():
        if r.edge:
            edges[r.k].append(r.v)
        if r["median"]:
            medians[r.k] = r.v
    return BinModel(list(features), [np.array(sorted(e)) if e else np.zeros(1) for e in edges], medians)


def fit_bins_local(x: np.ndarray, features: list[str], bins: int) -> BinModel:
    edges, medians = [], []
    for k in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, k]), k])
        edges.append(pick_edges(np.unique(v), bins))
        medians.append(float(v[len(v) // 2]) if len(v) else 0.0)
    return BinModel(list(features), edges, medians)


# --- losses -----------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def derivatives(s: BoostSettings, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if s.objective == "custom":
        g, h = s.loss(margin, y)
        return np.asarray(g, float), np.asarray(h, float)
    if s.objective == "logistic":
        p, w = sigmoid(margin), np.where(y > 0.5, s.scale_pos_weight, 1.0)
        return w * (p - y), w * p * np.maximum(1 - p, 1e-6)
    if s.objective == "poisson":
        rate = np.minimum(np.exp(np.minimum(margin, 700)), 1e15)
        return rate - y, np.maximum(rate, 1e-6)
    r = margin - y
    if s.objective == "huber":
        delta = max(s.huber_delta, 0.1)
        inside = np.abs(r) <= delta
        return np.where(inside, r, delta * np.sign(r)), inside.astype(float)
    return r, np.ones_like(r)


def base_score(s: BoostSettings, n: float, total: float, positive: float) -> float:
    """Of sums over the training rows.  Poisson starts at the log of the mean (``compat``: the mean)."""
    if s.objective == "logistic":
        return float(np.clip(math.log(positive / max(n - positive, 1)) if positive else -MARGIN, -MARGIN, MARGIN))
    mean = total / max(n, 1)
    return math.log(max(mean, 1e-9)) if s.objective == "poisson" and not s.compat else mean


# --- splits -----------------------------------------------------------------------


def binary_entropy(pos: float, total: float) -> float:
    if total < 1e-9 or pos / total < 1e-4:
        return 0.0
    p = math.floor(pos / total * 10_000) / 10_000
    return 0.0 if p >= 1 else -p * math.log2(p) - (1 - p) * math.log2(1 - p)


def search(hist: np.ndarray, s: BoostSettings, depth: int, columns: Iterable[int]) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a node; hist is (features, bins, [g, h, y, n]).

    The entropy term counts only where the parent is impure and the plain gain is
    over nine tenths of the best so far, so candidates are visited in order of
    bins.  Ties go to the earlier feature."""
    best = (-math.inf, -1, -1)
    mi = s.mi_weight * math.exp(-0.15 * depth)
    lam = s.reg_lambda
    for k in columns:
        live = np.flatnonzero(hist[k, :, 3])
        if len(live) < 2:
            continue
        left = np.cumsum(hist[k, live], axis=0)
        g, h, y, n = left[-1]
        if h <= s.min_child_weight * 0.01 or n < s.min_samples_split:
            continue
        gl, hl, yl, nl = left[:-1].T
        ok = (hl >= s.min_child_weight) & (h - hl >= s.min_child_weight)
        with np.errstate(divide="ignore", invalid="ignore"):
            newton = 0.5 * (gl * gl / (hl + lam) + (g - gl) ** 2 / (h - hl + lam) - (g * g / (h + lam) if h + lam else 0.0)) - s.gamma
        newton = np.where(ok & np.isfinite(newton), newton, -np.inf)
        parent = binary_entropy(y, n) if mi else 0.0
        if parent <= 0.01:
            j = int(np.argmax(newton))
            top, at = float(newton[j]), int(live[j])
        else:
            top, at = -math.inf, -1
            for j in np.flatnonzero(np.isfinite(newton)).tolist():
                value = float(newton[j])
                if value > 0.9 * top:
                    value += mi * (parent - nl[j] / n * binary_entropy(yl[j], nl[j]) - (n - nl[j]) / n * binary_entropy(y - yl[j], n - nl[j]))
                if value > top:
                    top, at = value, int(live[j])
        if top > best[0]:
            best = (top, k, at)
    return best


@dataclass
class Tree:
    """Nodes by number; left < 0 marks a leaf.  ``weight``: what its values are multiplied by."""

    feature: list[int] = field(default_factory=list)
    threshold: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    weight: float = 1.0

    def add(self) -> int:
        for x, v in ((self.feature, -1), (self.threshold, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            x.append(v)
        return len(self.feature) - 1

    def predict(self, bins: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = (np.array(x) for x in (self.feature, self.threshold, self.left, self.right, self.value))
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            node = at[rows]
            rows, node = rows[left[node] >= 0], node[left[node] >= 0]
            go = bins[rows, feature[node]] <= threshold[node]
            at[rows] = np.where(go, left[node], right[node])
        return value[at]

    def used(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for f, left in zip(self.feature, self.left, strict=True):
            if left >= 0:
                out[f] = out.get(f, 0) + 1
        return out


def grow(rows, s: BoostSettings, columns: list[int]) -> Tree:
    """One tree, level by level.  ``rows`` gives the histograms of nodes and moves rows to the children."""
    tree = Tree()
    frontier = [tree.add()]
    pairs: list[tuple[int, int, np.ndarray]] = []
    rows.start()
    for depth in range(s.depth + 1):
        if not frontier:
            break
        # Of two siblings only the smaller is counted, the other is what is left of the parent.
        hists = rows.histograms([small for small, _, _ in pairs] or frontier)
        hists |= {large: parent - hists[small] for small, large, parent in pairs}
        pairs = []
        splits: dict[int, tuple[int, int, int, int]] = {}
        following: list[int] = []
        for node in frontier:
            hist = hists[node]
            g, h, _, n = hist[columns[0]].sum(0)
            tree.value[node] = -g / (h + s.reg_lambda) if h + s.reg_lambda else 0.0
            # At the base score of all rows the root's gradients add up to zero, whatever there is to learn.
            flat = abs(g) < 0.01 * s.min_child_weight and (depth > 0 or s.compat)
            if flat or depth >= s.depth or n < s.min_samples_split or h < s.min_child_weight:
                continue
            gain, k, at = search(hist, s, depth, columns)
            if gain <= 1e-6:
                continue
            tree.feature[node], tree.threshold[node] = k, at
            tree.left[node], tree.right[node] = tree.add(), tree.add()
            splits[node] = (k, at, tree.left[node], tree.right[node])
            following += [tree.left[node], tree.right[node]]
            fewer = 2 * hist[k, : at + 1, 3].sum() <= n
            pairs.append((tree.left[node], tree.right[node], hist) if fewer else (tree.right[node], tree.left[node], hist))
        rows.split(splits)
        frontier = following
    return tree


class LocalRows:
    """Histograms of rows held in numpy arrays."""

    def __init__(self, bins: np.ndarray, widths: list[int], y: np.ndarray, g: np.ndarray, h: np.ndarray, sample: np.ndarray, by_feature: np.ndarray | None = None):
        """``by_feature``: the bins with a row for each feature, if at hand."""
        by_feature = np.ascontiguousarray(bins.T) if by_feature is None else by_feature
        whole = len(sample) == len(y)
        self.width, self.sample = max(widths), sample
        values = np.stack([g, h, y, np.ones_like(g)])
        self.values = (values if whole else values[:, sample]).T
        self.some = by_feature if whole else by_feature[:, sample]

    def start(self) -> None:
        self.node = np.zeros(len(self.sample), np.int64)
        #: The last node that each row was in: in the end its leaf.
        self.leaf = self.node

    def histograms(self, nodes: list[int]) -> dict[int, np.ndarray]:
        return partial_histograms(self.some, self.values, self.node, nodes, self.width)

    def split(self, splits: dict[int, tuple[int, int, int, int]]) -> None:
        self.leaf = np.where(self.node >= 0, self.node, self.leaf)
        self.node = move(self.some, self.node, splits)


def partial_histograms(bins: np.ndarray, values: np.ndarray, node: np.ndarray, nodes: list[int], width: int) -> dict[int, np.ndarray]:
    """(features, width, 4) of each node; ``bins`` has a row for each feature."""
    slot = np.full(max(nodes) + 1, -1)
    slot[nodes] = np.arange(len(nodes))
    where = np.where((node >= 0) & (node <= max(nodes)), slot[np.clip(node, 0, max(nodes))], -1)
    keep = np.flatnonzero(where >= 0)
    if len(keep) < len(node):
        bins, values, where = bins[:, keep], values[keep], where[keep]
    base, size = where * width, len(nodes) * width
    g, h, y = (np.ascontiguousarray(values[:, c]) for c in range(3))
    out = np.zeros((len(bins), len(nodes), width, 4))
    for k, row in enumerate(bins):
        at = base + row
        for c, v in enumerate((g, h, y)):
            out[k, :, :, c] = np.bincount(at, v, size).reshape(len(nodes), width)
        out[k, :, :, 3] = np.bincount(at, minlength=size).reshape(len(nodes), width)
    return {n: out[:, i] for i, n in enumerate(nodes)}


def move(bins: np.ndarray, node: np.ndarray, splits: dict[int, tuple[int, int, int, int]]) -> np.ndarray:
    """Rows of split nodes to the children, all others to -1; ``bins`` has a row for each feature."""
    out = np.full(len(node), -1)
    for n, (k, at, left, right) in splits.items():
        mine = np.flatnonzero(node == n)
        out[mine] = np.where(bins[k, mine] <= at, left, right)
    return out


class SparkRows:
    """Histograms of a DataFrame (bins array, y, margin, in_tree).  Rows keep no node: a task walks the tree so far,
    at most ``depth`` comparisons a row, so no state has to be written between levels."""

    def __init__(self, df: DataFrame, widths: list[int], s: BoostSettings):
        self.df, self.width, self.s, self.features = df, max(widths), s, len(widths)

    def start(self) -> None:
        self.history: list[dict[int, tuple[int, int, int, int]]] = []

    def split(self, splits) -> None:
        self.history.append(splits)

    def histograms(self, nodes: list[int]) -> dict[int, np.ndarray]:
        s, width, history, features = self.s, self.width, list(self.history), self.features

        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(nodes), features, width, 4))
            for batch in batches:
                bins = np.ascontiguousarray(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, features).T)
                y, margin = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                node = np.zeros(len(y), np.int64)
                for splits in history:
                    node = move(bins, node, splits)
                g, h = derivatives(s, margin, y)
                found = partial_histograms(bins, np.stack([g, h, y, np.ones_like(g)], axis=1), node, nodes, width)
                total += np.stack([found[n] for n in nodes])
            at = np.argwhere(total[..., 3] > 0)
            cells = total[tuple(at.T)]
            yield pa.RecordBatch.from_arrays([pa.array(at[:, k].astype(np.int32)) for k in range(3)] + [pa.array(np.ascontiguousarray(cells[:, c])) for c in range(4)], names=["node", "feature", "bin", "g", "h", "y", "n"])

        parts = self.df.where("in_tree").select("bins", "y", "margin").mapInArrow(part, "node int, feature int, bin int, g double, h double, y double, n double")
        summed = parts.groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in ("g", "h", "y", "n"))).toPandas()
        out = np.zeros((len(nodes), features, width, 4))
        out[summed["node"], summed["feature"], summed["bin"]] = summed[["g", "h", "y", "n"]].to_numpy()
        return {n: out[i] for i, n in enumerate(nodes)}


# --- models -----------------------------------------------------------------------


@dataclass
class BoostModel:
    settings: BoostSettings
    bins: BinModel
    base: float
    trees: list[Tree]
    best_score: float | None = None
    history: list[float] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += self.settings.learning_rate * t.weight * t.predict(bins)
        return out

    def link(self, margin: np.ndarray) -> np.ndarray:
        if self.settings.objective == "logistic":
            return sigmoid(margin)
        return np.minimum(np.exp(np.minimum(margin, 700)), 1e15) if self.settings.objective == "poisson" else margin

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.link(self.margins(self.bins.transform(x)))

    def staged(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prediction and the standard deviation of the staged margins, the base included."""
        bins = self.bins.transform(x)
        now = np.full(len(bins), self.base)
        total, squares = now.copy(), now * now
        for t in self.trees:
            now = now + self.settings.learning_rate * t.weight * t.predict(bins)
            total, squares = total + now, squares + now * now
        k = len(self.trees) + 1
        return self.link(now), np.sqrt(np.maximum(squares / k - (total / k) ** 2, 0))

    def usage(self) -> np.ndarray:
        """Trees that split on each feature."""
        out = np.zeros(len(self.bins.features), np.int64)
        for t in self.trees:
            out[list(t.used())] += 1
        return out

    def importance(self) -> np.ndarray:
        u = self.usage()
        return u / max(u.sum(), 1)

    def prune(self, dead: set[int], threshold: float) -> tuple[BoostModel, int]:
        """Without trees of which a share of splits of at least the threshold is on dead features."""
        keep = []
        for t in self.trees:
            used = t.used()
            splits = sum(used.values())
            if not splits or sum(n for f, n in used.items() if f in dead) / splits < threshold:
                keep.append(t)
        return replace(self, trees=keep), len(self.trees) - len(keep)

    def transform(self, df: DataFrame, output: str = "prediction", spread: str | None = None) -> DataFrame:
        """``df`` with predictions (and their staged deviation): a narrow pass in Arrow batches."""
        from pyspark.sql import types as T

        names = [*df.columns, output, *([spread] if spread else [])]
        schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names[len(df.columns) :])])
        at = [df.columns.index(f) for f in self.bins.features]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(k).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for k in at], axis=1) if batch.num_rows else np.zeros((0, len(at)))
                cols = self.staged(x) if spread else (self.predict(x),)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cols)], names=names)

        return df.mapInArrow(run, schema)

    def tree_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, k, "split" if left >= 0 else "leaf", int(f) if left >= 0 else None, int(th) if left >= 0 else None, int(left) if left >= 0 else None, int(right) if left >= 0 else None, float(v) * t.weight)
            for i, t in enumerate(self.trees)
            for k, (f, th, left, right, v) in enumerate(zip(t.feature, t.threshold, t.left, t.right, t.value, strict=True))
        ]
        return spark.createDataFrame(rows, "tree_id int, node_id int, kind string, feature int, threshold int, left int, right int, value double")

    def to_json(self) -> str:
        best = self.best_score if self.best_score is not None and math.isfinite(self.best_score) else None
        return json.dumps(
            {
                "settings": asdict(replace(self.settings, loss=None)),
                "bins": {"features": self.bins.features, "edges": [e.tolist() for e in self.bins.edges], "medians": self.bins.medians},
                "base": self.base,
                "trees": [asdict(t) for t in self.trees],
                "best_score": best,
                "history": self.history,
            }
        )

    @classmethod
    def from_json(cls, text: str | bytes) -> BoostModel:
        try:
            d = json.loads(text)
            bins = BinModel(d["bins"]["features"], [np.array(e) for e in d["bins"]["edges"]], d["bins"]["medians"])
            return cls(BoostSettings(**d["settings"]), bins, d["base"], [Tree(**t) for t in d["trees"]], d["best_score"], d["history"])
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"deserialization failed: {e}") from e


def average_precision(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-score, kind="stable")
    hit = y[order] > 0.5
    return float((np.cumsum(hit)[hit] / (np.flatnonzero(hit) + 1)).mean()) if hit.any() else 0.0


def roc_auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-score, kind="stable")
    hit = y[order] > 0.5
    p, n = int(hit.sum()), int((~hit).sum())
    return float(np.cumsum(hit)[~hit].sum() / (p * n)) if p and n else 0.5


class _Stopper:
    """Early stopping on the mean of the last three scores, larger being better.

    Binary models are scored every 20 trees and patience counts scores; others
    every 10 trees and patience counts trees."""

    def __init__(self, s: BoostSettings):
        self.s, self.history, self.best, self.at, self.stale = s, [], -math.inf, 0, 0
        self.every = 20 if s.objective == "logistic" else 10

    def due(self, i: int) -> bool:
        return i % self.every == 0

    def stop(self, i: int, score: float) -> bool:
        self.history.append(score)
        smooth = float(np.mean(self.history[-3:])) if self.s.objective == "logistic" else score
        if smooth > self.best + 1e-5:
            self.best, self.at, self.stale = smooth, i, 0
        else:
            self.stale += 1
        patience = self.stale if self.s.objective == "logistic" else i - self.at
        return patience >= self.s.patience and self.stale > 0


def _score(s: BoostSettings, margin: np.ndarray, y: np.ndarray) -> float:
    if s.objective == "logistic":
        return average_precision(margin, y)
    value = np.exp(np.minimum(margin, 700)) if s.objective == "poisson" and not s.compat else margin
    return -float(np.sqrt(np.mean((value - y) ** 2)))


def fit_local(x: np.ndarray, y: np.ndarray, features: list[str], s: BoostSettings, evaluate: tuple[np.ndarray, np.ndarray] | None = None, start: BoostModel | None = None, ids: np.ndarray | None = None, guard: RegressionDrift | None = None) -> BoostModel:
    """Train in this process.  ``start``: go on from a model (its bins are kept, its trees stay).
    ``guard``: bounds on gradients and margins, for labels that may have moved far from the model.
    ``ids``: hashes of the rows' ids, by which row samples are then drawn as over the cluster."""
    model = BoostModel(s, fit_bins_local(x, features, s.bins), base_score(s, len(y), float(y.sum()), float((y > 0.5).sum())), []) if start is None else replace(start, settings=replace(s, learning_rate=start.settings.learning_rate), trees=list(start.trees))
    weight = 1.0 if start is None else s.learning_rate / start.settings.learning_rate
    bins = model.bins.transform(x)
    by_feature = np.ascontiguousarray(bins.T)
    margin = model.margins(bins)
    held = None if evaluate is None else (model.bins.transform(evaluate[0]), evaluate[1])
    held_margin = None if held is None else model.margins(held[0])
    rng = np.random.default_rng(s.seed)
    widths, before, stopper = model.bins.widths, len(model.trees), _Stopper(s)
    mean = float(y.mean()) if len(y) else 0.0
    if guard and not abs(margin.mean() - mean) <= guard.reset_over * abs(mean):
        margin = np.full(len(y), mean)
    n, k = len(y), len(features)
    for i in range(s.trees):
        if s.subsample < 1 and ids is not None:
            rows = np.flatnonzero(sampled(ids, i, s))
        else:
            rows = np.sort(rng.permutation(n)[: max(1, int(s.subsample * n))]) if s.subsample < 1 else np.arange(n)
        columns = sorted(rng.permutation(k)[: max(1, int(s.colsample * k))].tolist()) if s.colsample < 1 else list(range(k))
        g, h = derivatives(s, margin, y)
        norm = float(np.sqrt((g * g).sum()))
        if i % 100 == 0 and norm < 0.001 or guard and norm > guard.gradient_norm * guard.stop_factor:
            break
        if guard and norm > guard.gradient_norm:
            g = g * (guard.gradient_norm / norm)
        local = LocalRows(bins, widths, y, g, h, rows, by_feature)
        tree = grow(local, s, columns)
        tree.weight = weight
        model.trees.append(tree)
        margin = margin + s.learning_rate * (np.array(tree.value)[local.leaf] if len(rows) == n else tree.predict(bins))
        if s.objective == "logistic":
            margin = np.clip(margin, -MARGIN, MARGIN)
        if guard:
            far = max(1.0, guard.clamp_factor * abs(mean))
            margin = np.clip(margin, mean - far, mean + far)
        if held is not None:
            held_margin = held_margin + s.learning_rate * tree.predict(held[0])
            if stopper.due(i) and stopper.stop(i, _score(s, held_margin, held[1])):
                break
    if held is not None and stopper.history:
        model.trees = model.trees[: before + stopper.at + 1]
        model.best_score, model.history = stopper.best, stopper.history
    return model


_P = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _xxhash(x: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    """Spark's ``xxhash64`` of integers of 4 or 8 bytes, going on from ``seed``."""
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = seed + _P[4] + np.uint64(size)
    if size == 8:
        h = turn(h ^ turn(x * _P[1], 31) * _P[0], 27) * _P[0] + _P[3]
    else:
        h = turn(h ^ (x & np.uint64(0xFFFFFFFF)) * _P[0], 23) * _P[1] + _P[2]
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def sampled(ids: np.ndarray, tree: int, s: BoostSettings) -> np.ndarray:
    """Whether each row (hash of its id) is in the sample of a tree: the test of ``fit_spark`` in numpy."""
    h = np.full(len(ids), 42, np.uint64)
    for x, size in ((np.asarray(ids).astype(np.int64).view(np.uint64), 8), (tree, 4), (s.seed, 4 if -(2**31) <= s.seed < 2**31 else 8)):
        h = _xxhash(x if isinstance(x, np.ndarray) else np.full(len(ids), x, np.int64).view(np.uint64), h, size)
    return h.view(np.int64) % 1_000_000 < int(s.subsample * 1_000_000)


def _gradient_norm(rows: DataFrame, s: BoostSettings) -> float:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, margin = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            g, _ = derivatives(s, margin, y)
            yield pa.RecordBatch.from_arrays([pa.array([float((g * g).sum())])], names=["g"])

    return math.sqrt(rows.select("y", "margin").mapInArrow(run, "g double").agg(F.sum("g")).first()[0] or 0.0)


def _score_spark(held: DataFrame, s: BoostSettings) -> float:
    """``_score`` of a table of margins; equal margins are in the order of the hash of the row id, as in ``fit``."""
    if s.objective != "logistic":
        value = F.exp(F.least("margin", F.lit(700.0))) if s.objective == "poisson" and not s.compat else F.col("margin")
        return -math.sqrt(held.agg(F.avg((value - F.col("y")) * (value - F.col("y")))).first()[0])
    # Sorted once; counts of the parts before give each part its first rank.
    ranked = held.orderBy(F.desc("margin"), "row").select("y").checkpoint()

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = hits = 0
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            n, hits = n + len(y), hits + int((y > 0.5).sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), n, hits)], names=["part", "n", "hits"])

    before, n, hits = {}, 0, 0
    for r in sorted(ranked.mapInArrow(counts, "part long, n long, hits long").collect()):
        before[r.part] = (n, hits)
        n, hits = n + r.n, hits + r.hits

    def precision(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits = before.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            hit = batch.column(0).to_numpy(zero_copy_only=False) > 0.5
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array([float(((hits + np.arange(1, len(at) + 1)) / (n + at + 1)).sum())])], names=["p"])
            n, hits = n + len(hit), hits + len(at)

    return ranked.mapInArrow(precision, "p double").agg(F.sum("p")).first()[0] / hits if hits else 0.0


def fit_spark(df: DataFrame, features: list[str], label: str, row_id: str, s: BoostSettings, evaluate: DataFrame | None = None) -> BoostModel:
    """Train on a DataFrame that need not fit one machine: a job per level of each tree.

    Row samples are hashes of the row id, so they need no shuffle and repeat on retry.
    Margins are recomputed from the trees in the pass that makes the histograms; every
    ``KEEP`` trees they are checkpointed, which cuts lineage and survives lost executors.
    Margins of ``evaluate`` are brought up to date and checkpointed whenever a score is due."""
    bins = fit_bins(df, features, s.bins)
    y = F.col(label).cast("double")
    n, total, positive = df.agg(F.count("*"), F.sum(y), F.count(F.when(y > 0.5, 1))).first()
    model = BoostModel(s, bins, base_score(s, n, total or 0.0, positive), [])
    rng = np.random.default_rng(s.seed)
    rows = _with_margins(df.select(F.xxhash64(row_id).alias("row"), y.alias("y"), *features), features, model).checkpoint()
    held = None if evaluate is None else _with_margins(evaluate.select(F.xxhash64(row_id).alias("row"), y.alias("y"), *features), features, model).checkpoint()
    stopper, done, scored = _Stopper(s), 0, 0
    for i in range(s.trees):
        columns = sorted(rng.permutation(len(features))[: max(1, int(s.colsample * len(features)))].tolist()) if s.colsample < 1 else list(range(len(features)))
        fresh = BoostModel(s, bins, 0.0, model.trees[done:])
        chosen = F.pmod(F.xxhash64(F.col("row"), F.lit(i), F.lit(s.seed)), F.lit(1_000_000)) < int(s.subsample * 1_000_000)
        if i % 100 == 0 and _gradient_norm(_add_margins(rows, fresh, s), s) < 0.001:
            break
        now = _add_margins(rows, fresh, s).withColumn("in_tree", chosen if s.subsample < 1 else F.lit(True))
        model.trees.append(grow(SparkRows(now, bins.widths, s), s, columns))
        if held is not None and stopper.due(i):
            held = _add_margins(held, BoostModel(s, bins, 0.0, model.trees[scored:]), s, clip=False).checkpoint()
            scored = len(model.trees)
            if stopper.stop(i, _score_spark(held, s)):
                break
        if (i + 1) % KEEP == 0 and i + 1 < s.trees:
            rows = _add_margins(rows, BoostModel(s, bins, 0.0, model.trees[done:]), s).checkpoint()
            done = len(model.trees)
    if stopper.history:
        model.trees = model.trees[: stopper.at + 1]
        model.best_score, model.history = stopper.best, stopper.history
    return model


#: Trees between checkpoints of the margins.
KEEP = 10


def _with_margins(df: DataFrame, features: list[str], model: BoostModel) -> DataFrame:
    base, bins = model.base, model.bins

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k + 2).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for k in range(len(features))], axis=1) if batch.num_rows else np.zeros((0, len(features)))
            found = bins.transform(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(features)), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(1), pa.array(np.full(len(found), base))], names=["row", "bins", "y", "margin"])

    return df.mapInArrow(run, f"row {dict(df.dtypes)['row']}, bins array<short>, y double, margin double")


def _add_margins(rows: DataFrame, model: BoostModel, s: BoostSettings, clip: bool = True) -> DataFrame:
    if not model.trees:
        return rows
    features = len(model.bins.features)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            margin = batch.column(3).to_numpy(zero_copy_only=False).copy()
            for t in model.trees:
                margin += s.learning_rate * t.weight * t.predict(bins)
                if clip and s.objective == "logistic":
                    np.clip(margin, -MARGIN, MARGIN, out=margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(margin)], names=["row", "bins", "y", "margin"])

    return rows.mapInArrow(run, f"row {dict(rows.dtypes)['row']}, bins array<short>, y double, margin double")


def trains_here(rows: int, features: int) -> bool:
    """Whether a model of so many rows is trained in one process."""
    return rows * (features + 4) <= LOCAL_CELLS


def quick_train(df: DataFrame, features: list[str], label: str, row_id: str, evaluate: DataFrame | None = None, **overrides) -> BoostModel:
    """A binary model with settings derived from the data; some may be given."""
    from tidegrove.functions.settings import derive

    n, ratio = df.where(F.col(label).isNotNull()).agg(F.count("*"), F.avg((F.col(label) > 0.5).cast("double"))).first()
    return fit(df, features, label, row_id, derive(n, len(features), ratio or 0.0, **overrides), evaluate)


def fit(df: DataFrame, features: list[str], label: str, row_id: str, s: BoostSettings | None = None, evaluate: DataFrame | None = None, distributed: bool | None = None) -> BoostModel:
    """Train where the data allow: in the driver's process up to ``LOCAL_CELLS`` cells, else over the cluster.

    Without settings they are derived from the data.  Differences from published
    behaviour, all restored by ``compat``: Poisson starts at ln(mean) and is
    validated on its own scale, and a root whose gradients cancel is still split."""
    from tidegrove.functions.settings import derive

    known = df.where(F.col(label).isNotNull())
    n, ratio = known.agg(F.count("*"), F.avg((F.col(label) > 0.5).cast("double"))).first()
    if not n:
        raise ValueError("no labelled rows to fit")
    s = s or derive(n, len(features), ratio)
    if distributed or (distributed is None and not trains_here(n, len(features))):
        from tidegrove.sources.tables import ready_checkpoints

        ready_checkpoints(df.sparkSession)
        return fit_spark(known, features, label, row_id, s, None if evaluate is None else evaluate.where(F.col(label).isNotNull()))
    x, y, ids = _by_id(known, features, label, row_id)
    held = None if evaluate is None else _by_id(evaluate.where(F.col(label).isNotNull()), features, label, row_id)[:2]
    return fit_local(x, y, features, s, held, ids=ids)


def _by_id(df: DataFrame, features: list[str], label: str, row_id: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and hashes of the row ids in the order of those hashes (then of the features), which doesn't
    depend on how the rows are dealt; nothing is shuffled for it."""
    hashed = free_name(df, "hash")
    x, y = matrix(df.withColumn(hashed, F.xxhash64(row_id)), features, label, also=hashed)
    ids = x[1]
    x = x[0]
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    if same.any():
        order = np.lexsort((y, *x.T[::-1], ids))
    return x[order], y[order], ids[order]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def matrix(df: DataFrame, features: list[str], label: str, also: str | None = None):
    """Features and label as arrays; null becomes NaN.  ``also``: a long column, which then comes with the features."""
    extra = [F.col(also)] if also else []
    t = df.select(*(F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)), F.col(label).cast("double").alias("y"), *extra).toArrow()
    cols = [t.column(k).to_numpy() for k in range(len(features) + 1 + len(extra))]
    x, y = np.stack(cols[: len(features)], axis=1).astype(float, copy=False), np.asarray(cols[len(features)], float)
    return ((x, cols[-1]) if also else x), y

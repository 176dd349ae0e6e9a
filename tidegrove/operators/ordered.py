"""Order statistics, edges, ranks and ordered sums without a window over all rows.

A relation is cut into ``PARTS`` ranges at approximate quantiles; a window numbers the
rows of one range, and the sums of the ranges before (a table of at most ``PARTS`` + 1
rows, which is broadcast) make the numbers global.  Results are exact whatever the cuts:
those only decide how even the ranges are.  Cuts are the one thing read beforehand, by
an aggregate with a row of result; all else is one plan.

``rel`` is SQL text of a relation whose ``{names}`` stand for the given frames, as in
``relational``, whose plain forms say what is computed.  Where rows of one value must be
told apart by further columns, all of them are in one range; forms by count
(``..._by_score``) have no such limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrove.functions import scalar as fn
from tidegrove.operators import relational as op
from tidegrove.operators.relational import round6

PARTS = 64


class Ordered:
    """Operators over the given frames."""

    def __init__(self, spark: SparkSession, **frames: DataFrame):
        self.spark, self.frames = spark, frames

    def run(self, sql: str) -> DataFrame:
        return op.run(self.spark, sql, **self.frames)

    def cuts(self, rel: str, *values: str) -> list[list[float]]:
        """For each value some approximate quantiles, ascending."""
        shares = ", ".join(f"{(i + 1) / PARTS!r}D" for i in range(PARTS - 1))
        columns = ", ".join(f"approx_percentile(CASE WHEN NOT isnan({v}) THEN CAST({v} AS DOUBLE) END, array({shares}), 1000)" for v in values)
        return [sorted(set(x or [])) for x in self.run(f"SELECT {columns} FROM {rel} AS t").first()]

    # --- values ----------------------------------------------------------------------

    def _ranked(self, rel: str, value: str) -> str:
        """Distinct values v (no null or NaN) with their count k, 0-based place, rows up to and including them, and totals m and n."""
        (cuts,) = self.cuts(rel, value)
        counted = f"(SELECT v, k, {part('v', cuts)} AS part FROM (SELECT v, count(*) AS k FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {rel} AS t) AS a WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY v) AS b)"
        return f"""
        (SELECT /*+ BROADCAST(o) */ v, k, (row_number() OVER w) - 1 + before_m AS at, (sum(k) OVER w) + before_n AS upto, total_m AS m, total_n AS n
         FROM {counted} AS p JOIN {offsets(counted, m='1', n='k')} AS o ON p.part = o.part
         WINDOW w AS (PARTITION BY p.part ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

    def statistics(self, rel: str, value: str, **positions: str) -> DataFrame:
        """One row: by name the values at 0-based positions (expressions over the count n) of the sorted values."""
        columns = ", ".join(f"max(CASE WHEN {p} >= upto - k AND {p} < upto THEN v END) AS {name}" for name, p in positions.items())
        return self.run(f"SELECT {columns}, coalesce(max(n), 0) AS n FROM {self._ranked(rel, value)} AS r")

    def upper_median(self, rel: str, value: str) -> float | None:
        return self.statistics(rel, value, v="floor(n / 2)").first()["v"]

    def mad(self, rel: str, value: str) -> float:
        """Median absolute deviation from the upper median, 1 for no rows."""
        middle = self.upper_median(rel, value)
        return 1.0 if middle is None else self.upper_median(rel, f"abs(({value}) - {literal(middle)})")

    def outlier_ratio(self, rel: str, value: str) -> DataFrame:
        """As ``relational.outlier_ratio``: n, n_outliers, q1, q3 and ratio in one row."""
        q1, q3, _ = self.statistics(rel, value, q1="floor(n / 4)", q3="floor(n * 3 / 4)").first()
        low, high = literal(q1), literal(q3)
        out = f"count(CASE WHEN v < {low} - 1.5 * ({high} - {low}) OR v > {high} + 1.5 * ({high} - {low}) THEN 1 END)"
        return self.run(f"""
        SELECT count(*) AS n, {out} AS n_outliers, {low} AS q1, {high} AS q3,
               {round6(f"CASE WHEN count(*) < 4 OR {high} - {low} < 0.0000000001 THEN 0.0 ELSE {out} / CAST(count(*) AS DOUBLE) END")} AS ratio
        FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {rel} AS t) AS x""")

    def quantile_edges(self, rel: str, value: str, bins: int = 32) -> DataFrame:
        """(k, edge): as ``relational.quantile_edges``."""
        wanted = ", ".join(f"CAST(floor((m - 1) * {share!r}D + 0.5) AS BIGINT)" for share in edge_shares(bins))
        return self.run(f"""
        SELECT CAST(k AS INT) AS k, edge FROM (
            SELECT posexplode(sort_array(collect_list(v))) AS (k, edge) FROM {self._ranked(rel, value)} AS r
            WHERE m <= {bins} OR array_contains(array({wanted}), at)) AS e""")

    def bin_counts(self, rel: str, value: str, edges: DataFrame) -> DataFrame:
        """(bin, n): as ``relational.bin_counts``; the edges are one array, so rows are neither joined nor shuffled by value."""
        return op.run(
            self.spark,
            f"""
        SELECT CAST(CASE WHEN size(edges) <= 8 THEN least(below, size(edges) - 1) ELSE greatest(below - 1, 0) END AS INT) AS bin, count(*) AS n
        FROM (SELECT edges, size(filter(edges, e -> e < v)) AS below
              FROM (SELECT CAST({value} AS DOUBLE) AS v, (SELECT sort_array(collect_list(edge)) FROM {{edges_}}) AS edges FROM {rel} AS t) AS a WHERE v IS NOT NULL) AS b
        GROUP BY 1""",
            edges_=edges,
            **self.frames,
        )

    # --- rows ------------------------------------------------------------------------

    def numbered(self, rel: str, order: list[str], by: str | None = None) -> str:
        """The relation with 1-based numbers ``rn`` in a total order and the number of rows ``n_``.

        ``by``: a number that never falls along the order and makes the ranges; without it the first column of the order."""
        by = by or f"CAST({order[0]} AS DOUBLE)"
        (cuts,) = self.cuts(rel, by)
        placed = f"(SELECT *, {part(by, cuts)} AS part_ FROM {rel} AS t)"
        return f"""
        (SELECT /*+ BROADCAST(o) */ p.*, row_number() OVER (PARTITION BY p.part_ ORDER BY {", ".join(order)}) + before_n AS rn, total_n AS n_
         FROM {placed} AS p JOIN {offsets(placed, 'part_', n='1')} AS o ON p.part_ = o.part)"""

    def _scored(self, rel: str, score: str, label: str, order: str) -> str:
        """Of each row: label, positives and rows up to it by falling score, and totals."""
        rows = f"(SELECT CAST({score} AS DOUBLE) AS s, {fn.as_binary(label)} AS y, {order} AS o FROM {rel} AS t)"
        (cuts,) = self.cuts(rows, "-s")
        placed = f"(SELECT s, y, o, {part('-s', cuts)} AS part FROM {rows} AS r)"
        return f"""
        (SELECT /*+ BROADCAST(b) */ y, (sum(y) OVER w) + before_p AS tp, (row_number() OVER w) + before_n AS seen, total_p AS p, total_n AS n
         FROM {placed} AS a JOIN {offsets(placed, p='y', n='1')} AS b ON a.part = b.part WINDOW w AS (PARTITION BY a.part ORDER BY s DESC, o))"""

    def roc_auc(self, rel: str, score: str, label: str, order: str) -> DataFrame:
        return self.run(f"SELECT {round6('CASE WHEN coalesce(max(p), 0) = 0 OR max(p) = max(n) THEN 0.5 ELSE sum(CASE WHEN y = 0 THEN tp ELSE 0.0 END) / (max(p) * (max(n) - max(p))) END')} AS auc FROM {self._scored(rel, score, label, order)} AS q")

    def pr_auc(self, rel: str, score: str, label: str, order: str) -> DataFrame:
        return self.run(f"SELECT {round6('CASE WHEN coalesce(max(p), 0) = 0 THEN 0.0 ELSE sum(CASE WHEN y > 0 THEN tp / seen ELSE 0.0 END) / max(p) END')} AS auc FROM {self._scored(rel, score, label, order)} AS q")

    def _by_score(self, rel: str, score: str, label: str) -> str:
        """Of each score, falling: positives, negatives, and those above it."""
        counts = f"(SELECT s, count(CASE WHEN yes THEN 1 END) AS pos, count(CASE WHEN NOT yes THEN 1 END) AS neg FROM (SELECT CAST({score} AS DOUBLE) AS s, {fn.positive(label)} AS yes FROM {rel} AS t) AS r GROUP BY s)"
        (cuts,) = self.cuts(rel, f"-({score})")
        placed = f"(SELECT s, pos, neg, {part('-s', cuts)} AS part FROM {counts} AS c)"
        return f"""
        (SELECT /*+ BROADCAST(b) */ pos, neg, (sum(pos) OVER w) - pos + before_p AS above, (sum(neg) OVER w) - neg + before_n AS below, total_p AS p, total_n AS n
         FROM {placed} AS a JOIN {offsets(placed, p='pos', n='neg')} AS b ON a.part = b.part WINDOW w AS (PARTITION BY a.part ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

    def roc_auc_by_score(self, rel: str, score: str, label: str) -> DataFrame:
        return self.run(f"SELECT {round6('CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.5 ELSE sum(neg * (above + pos / 2.0)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) END')} AS auc FROM {self._by_score(rel, score, label)} AS q")

    def pr_auc_by_score(self, rel: str, score: str, label: str) -> DataFrame:
        return self.run(f"SELECT {round6('CASE WHEN coalesce(sum(pos), 0) = 0 THEN 0.0 ELSE sum(pos * (above + pos) / CAST(above + pos + below + neg AS DOUBLE)) / sum(pos) END')} AS auc FROM {self._by_score(rel, score, label)} AS q")

    def autocorrelation(self, rel: str, error: str, order: list[str]) -> DataFrame:
        """As ``relational.autocorrelation``: products of neighbours in a range, and of the ends of neighbouring ranges."""
        (cuts,) = self.cuts(rel, f"CAST({order[0]} AS DOUBLE)")
        keys = ", ".join(f"{o} AS o{k}" for k, o in enumerate(order))
        by = ", ".join(f"o{k}" for k in range(len(order)))
        mean = f"(SELECT avg(abs({error})) FROM {rel} AS m)"
        rows = f"(SELECT abs({error}) - {mean} AS e, {part(f'CAST({order[0]} AS DOUBLE)', cuts)} AS part, {keys} FROM {rel} AS t)"
        return self.run(f"""
        SELECT {round6("CASE WHEN coalesce(sum(squares), 0.0) < 0.0000000001 THEN 0.0 ELSE sum(inside + coalesce(last * next, 0.0)) / sum(squares) END")} AS acf
        FROM (SELECT squares, inside, last, lead(first) OVER (ORDER BY part) AS next
              FROM (SELECT part, sum(e * e) AS squares, coalesce(sum(e * follows), 0.0) AS inside, max_by(e, struct({by})) AS last, min_by(e, struct({by})) AS first
                    FROM (SELECT *, lead(e) OVER (PARTITION BY part ORDER BY {by}) AS follows FROM {rows} AS r) AS a GROUP BY part) AS b) AS c""")

    def heteroscedasticity(self, rel: str, predicted: str, error: str, order: str) -> DataFrame:
        rows = f"(SELECT CAST({predicted} AS DOUBLE) AS p_, {order} AS o_, abs({error}) AS e FROM {rel} AS t)"
        return self.run(f"""
        SELECT {round6("coalesce(sqrt(sum((v - mu) * (v - mu))), 0.0)")} AS het, count(*) AS chunks
        FROM (SELECT v, avg(v) OVER () AS mu
              FROM (SELECT chunk, var_pop(e) AS v
                    FROM (SELECT e, floor((rn - 1) / floor(n_ / least(10, floor(n_ / 10)))) AS chunk FROM {self.numbered(rows, ['p_', 'o_'])} AS a WHERE n_ >= 10) AS b
                    GROUP BY chunk) AS c) AS d""")

    def ema(self, rel: str, value: str, order: list[str], alpha: float = 0.1, start: float = 0.0) -> DataFrame:
        keep = 1 - alpha
        return self.run(f"""
        SELECT {round6(f"sum({alpha!r} * x_ * power(CAST({keep!r} AS DOUBLE), n_ - rn)) + power(CAST({keep!r} AS DOUBLE), max(n_)) * {start!r}")} AS ema, count(*) AS n
        FROM (SELECT {value} AS x_, rn, n_ FROM {self.numbered(rel, order)} AS a) AS b""")

    def batches(self, rel: str, order: list[str], size: int, by: str | None = None) -> str:
        """Rows with a batch number, ``size`` rows a batch, in order."""
        return f"(SELECT *, CAST(floor((rn - 1) / {size}) AS INT) AS batch FROM {self.numbered(rel, order, by)} AS n)"

    def mean_shift(self, rel: str, features: list[str], order: list[str], size: int = 1000, least: int = 100) -> DataFrame:
        """As ``relational.mean_shift``: the oldest and the newest rows are two top-k, nothing is numbered."""
        end = lambda way: f"(SELECT * FROM {rel} AS t ORDER BY {', '.join(f'{o} {way}' for o in order)} LIMIT {size})"
        mean = lambda name, way: f"SELECT {', '.join(f'avg({f}) AS {name}{k}' for k, f in enumerate(features))} FROM {end(way)} AS e"
        move = lambda k: f"abs(new{k} - old{k}) / greatest(abs(old{k}), 0.0000000001)"
        rows = ", ".join(f"named_struct('feature', '{f}', 'shift', {round6(move(k))}, 'drifted', {move(k)} > 0.2)" for k, f in enumerate(features))
        return self.run(f"""
        SELECT f.* FROM (SELECT explode(array({rows})) AS f FROM ({mean('old', 'ASC')}) AS a JOIN ({mean('new', 'DESC')}) AS b JOIN (SELECT count(*) AS n FROM {rel} AS t) AS c WHERE n >= {least}) AS x""")


def literal(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST({value!r} AS DOUBLE)"


def clock(ts: str) -> str:
    """Seconds of a time without zone, up to the second."""
    return f"(unix_date(CAST({ts} AS DATE)) * 86400.0D + hour({ts}) * 3600 + minute({ts}) * 60 + floor(second({ts})))"


def part(value: str, cuts: list[float]) -> str:
    """The number of cuts below a value, by halving."""

    def half(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN {value} <= {literal(cuts[middle])} THEN {half(low, middle)} ELSE {half(middle + 1, high)} END"

    return half(0, len(cuts))


def offsets(placed: str, key: str = "part", **sums: str) -> str:
    """Of each range the sums over those before it and over all: a window over one row a range."""
    inner = ", ".join(f"sum({x}) AS {name}" for name, x in sums.items())
    outer = ", ".join(f"coalesce(sum({name}) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_{name}, sum({name}) OVER () AS total_{name}" for name in sums)
    return f"(SELECT part, {outer} FROM (SELECT {key} AS part, {inner} FROM {placed} AS x GROUP BY {key}) AS y)"


def edge_shares(bins: int) -> list[float]:
    """Shares of the distinct values at which edges lie: finer in the lowest and highest tenth."""
    q = bins // 4
    return [0.10 * i / (bins / 4) if i < q else 0.90 + 0.10 * (i - 3 * bins // 4) / (bins / 4) if i > 3 * bins // 4 else 0.10 + 0.80 * (i - q) / (bins / 2) for i in range(bins + 1)]

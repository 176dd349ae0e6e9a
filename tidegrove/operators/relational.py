"""Set-based operators of the engine, as SQL that Spark plans and other engines can check.

Texts marked "Spark" use its array functions to get by with one scan; the plain
ones say the same for any engine.  Operators that need an order over all rows are
here in their plain form, with a window over everything; ``ordered`` has the forms
that run on many machines.

A function takes relations (SQL text of a table or subquery) and column
expressions and returns a query.  ``run`` executes one with DataFrames in the
places of its ``{name}`` parameters.  Ordered operators take the columns of a
total order, so results don't depend on how rows are distributed.  Where a
window needs all rows in one order, rows are first reduced to counts per value
(``ranked`` operators), or the window is over what an aggregate left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrove.functions import scalar as fn


def run(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(sql, **frames)


def round6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


# --- profiles and order statistics -------------------------------------------------


def profile(rel: str, features: list[str], label: str) -> str:
    """Per feature: rows, missing (null or NaN), distinct values, positives of the label.  A scan per feature."""
    parts = [
        f"SELECT '{f}' AS feature, count(*) AS n, count(*) - count(CASE WHEN NOT isnan({f}) THEN {f} END) AS n_missing, "
        f"count(DISTINCT CASE WHEN NOT isnan({f}) THEN {f} END) AS n_distinct, count(CASE WHEN {fn.positive(label)} THEN 1 END) AS n_positive FROM {rel} AS t"
        for f in features
    ]
    return " UNION ALL ".join(parts)


def profile_in_one_scan(rel: str, features: list[str], label: str) -> str:
    """``profile`` for Spark: rows are turned into (feature, value), counted by value, then by feature."""
    values = ", ".join(f"named_struct('feature', '{f}', 'v', CASE WHEN NOT isnan({f}) THEN CAST({f} AS DOUBLE) END)" for f in features)
    return f"""
    SELECT feature, CAST(sum(k) AS BIGINT) AS n, CAST(sum(CASE WHEN v IS NULL THEN k ELSE 0 END) AS BIGINT) AS n_missing, count(v) AS n_distinct, CAST(sum(pos) AS BIGINT) AS n_positive
    FROM (SELECT f.feature, f.v, count(*) AS k, count(CASE WHEN yes THEN 1 END) AS pos FROM (SELECT explode(array({values})) AS f, {fn.positive(label)} AS yes FROM {rel} AS t) AS a GROUP BY f.feature, f.v) AS b
    GROUP BY feature"""


def base_log_odds(rel: str, label: str) -> str:
    """Positives, negatives and ln(pos / max(neg, 1)), at least -10."""
    return f"""
    SELECT pos, neg, {round6("pos / CAST(pos + neg AS DOUBLE)")} AS pos_ratio,
           {round6("CASE WHEN pos = 0 THEN -10.0 ELSE greatest(-10.0, ln(pos / CAST(greatest(neg, 1) AS DOUBLE))) END")} AS base_score
    FROM (SELECT count(CASE WHEN {fn.positive(label)} THEN 1 END) AS pos, count(CASE WHEN NOT {fn.positive(label)} THEN 1 END) AS neg FROM {rel} AS t) AS c"""


def order_statistic(rel: str, value: str, position: str) -> str:
    """One row ``v``: the value at a 0-based position (an expression over the count n) of the sorted values.

    Values are counted first; the window is over distinct values."""
    return f"""
    SELECT max(v) AS v FROM (
        SELECT v, sum(k) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, k, sum(k) OVER () AS n
        FROM (SELECT v, count(*) AS k FROM (SELECT {value} AS v FROM {rel} AS t) AS a WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY v) AS b) AS c
    WHERE {position} >= upto - k AND {position} < upto"""


def upper_median(rel: str, value: str) -> str:
    return order_statistic(rel, value, "floor(n / 2)")


def mad(rel: str, value: str) -> str:
    """Median absolute deviation from the upper median, 1 for no rows."""
    spread = order_statistic(rel, f"abs({value} - (SELECT v FROM ({upper_median(rel, value)}) AS m))", "floor(n / 2)")
    return f"SELECT coalesce(max(v), 1.0) AS v FROM ({spread}) AS s"


def outlier_ratio(rel: str, value: str) -> str:
    """Share beyond 1.5 interquartile ranges; 0 for fewer than four values or no spread."""
    q1, q3 = (order_statistic(rel, value, f"floor(n * {k} / 4)") for k in (1, 3))
    return f"""
    SELECT count(*) AS n, count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers,
           max(q1) AS q1, max(q3) AS q3,
           {round6("CASE WHEN count(*) < 4 OR max(q3) - max(q1) < 0.0000000001 THEN 0.0 ELSE count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) / CAST(count(*) AS DOUBLE) END")} AS ratio
    FROM (SELECT {value} AS v, (SELECT v FROM ({q1}) AS a) AS q1, (SELECT v FROM ({q3}) AS b) AS q3 FROM {rel} AS t) AS x"""


def sample(rel: str, key: str, share: float) -> str:
    """Rows whose key has a digest in the lowest ``share``: for Spark; no shuffle, and the same rows anywhere."""
    return f"SELECT * FROM {rel} AS t WHERE CAST(conv(substring(md5(CAST({key} AS STRING)), 1, 8), 16, 10) AS BIGINT) < {int(share * (1 << 32))}"


# --- binning ---------------------------------------------------------------------


def quantile_edges(rel: str, value: str, bins: int = 32) -> str:
    """(k, edge): bin edges over the distinct values, finer in the lowest and highest tenth.

    At most ``bins`` distinct values are their own edges; else positions
    0 .. bins map to shares 0-.10 (first quarter), .10-.90, .90-1 (last quarter)."""
    q = bins // 4
    share = f"CASE WHEN i < {q} THEN 0.10 * i / {bins / 4!r} WHEN i > {3 * bins // 4} THEN 0.90 + 0.10 * (i - {3 * bins // 4}) / {bins / 4!r} ELSE 0.10 + 0.80 * (i - {q}) / {bins / 2!r} END"
    steps = ", ".join(f"({i})" for i in range(bins + 1))
    return f"""
    SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INT) AS k, edge FROM (
        SELECT DISTINCT v AS edge FROM (
            SELECT v, row_number() OVER (ORDER BY v) - 1 AS pos_, count(*) OVER () AS m
            FROM (SELECT DISTINCT {value} AS v FROM {rel} AS t) AS d WHERE v IS NOT NULL AND NOT isnan(v)) AS s
        LEFT JOIN (SELECT CAST(i AS DOUBLE) AS i FROM (VALUES {steps}) AS w(i)) AS g
          ON m > {bins} AND pos_ = CAST(floor((m - 1) * ({share}) + 0.5) AS BIGINT)
        WHERE m <= {bins} OR i IS NOT NULL) AS e"""


def bin_counts(rel: str, value: str, edges: str) -> str:
    """(bin, n): how many rows fall in each bin.

    Up to eight edges: the first edge not below the value, else the last.  More:
    the last edge below the value, else 0.  Distinct values are looked up, then
    their counts added: the range join is over distinct values and few edges."""
    return f"""
    SELECT CAST(CASE WHEN m <= 8 THEN least(below, m - 1) ELSE greatest(below - 1, 0) END AS INT) AS bin, CAST(sum(k) AS BIGINT) AS n
    FROM (SELECT v, max(k) AS k, count(CASE WHEN edge < v THEN 1 END) AS below, count(*) AS m
          FROM (SELECT v, count(*) AS k FROM (SELECT {value} AS v FROM {rel} AS t) AS a WHERE v IS NOT NULL GROUP BY v) AS c
          JOIN (SELECT edge FROM ({edges}) AS e0) AS e ON true GROUP BY v) AS x
    GROUP BY 1"""


# --- gradients, histograms, splits ---------------------------------------------------


def gradient_sums(rel: str, key: str, pair: tuple[str, str], y: str) -> str:
    g, h = pair
    return f"SELECT {key} AS k, count(*) AS n, {round6(f'sum({g})')} AS g, {round6(f'sum({h})')} AS h, {round6(f'sum({y})')} AS y FROM {rel} AS t GROUP BY {key}"


def histogram(rel: str, features: list[str], g: str, h: str, y: str, where: str = "true") -> str:
    """(feature, bin, g, h, y, n) from a relation whose features are bins."""
    parts = [
        f"SELECT {k} AS feature, CAST({f} AS INT) AS bin, sum({g}) AS g, sum({h}) AS h, sum({y}) AS y, count(*) AS n FROM {rel} AS t WHERE {where} GROUP BY {f}" for k, f in enumerate(features)
    ]
    return " UNION ALL ".join(parts)


def histogram_in_one_scan(rel: str, features: list[str], g: str, h: str, y: str, where: str = "true") -> str:
    """``histogram`` for Spark: one scan and one exchange of at most features * bins rows a task."""
    bins = ", ".join(f"CAST({f} AS INT)" for f in features)
    return f"""
    SELECT feature, bin, sum(g) AS g, sum(h) AS h, sum(y) AS y, count(*) AS n
    FROM (SELECT posexplode(array({bins})) AS (feature, bin), {g} AS g, {h} AS h, {y} AS y FROM {rel} AS t WHERE {where}) AS x GROUP BY feature, bin"""


def subtract(parent: str, child: str) -> str:
    """The sibling's histogram."""
    return f"""
    SELECT p.feature, p.bin, p.g - coalesce(c.g, 0.0) AS g, p.h - coalesce(c.h, 0.0) AS h, p.y - coalesce(c.y, 0.0) AS y, p.n - coalesce(c.n, 0) AS n
    FROM ({parent}) AS p LEFT JOIN ({child}) AS c ON p.feature = c.feature AND p.bin = c.bin"""


def prefix_sums(hist: str) -> str:
    """Left sums up to each bin, and totals."""
    left = "OVER (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    total = "OVER (PARTITION BY feature)"
    cols = ", ".join(f"sum({c}) {left} AS {c}l, sum({c}) {total} AS {c}t" for c in ("g", "h", "y", "n"))
    return f"SELECT feature, bin, {cols}, max(bin) {total} AS last FROM ({hist}) AS hist"


def split_gains(hist: str, lam: float, gamma: float, min_child: float, mi: float = 0.0) -> str:
    """(feature, bin, gain) of every split that leaves rows and enough hessian on both sides."""
    info = "0.0"
    if mi:
        info = f"{mi!r} * ({fn.entropy('yt', 'nt')} - nl / CAST(nt AS DOUBLE) * ({fn.entropy('yl', 'CAST(nl AS DOUBLE)')}) - (nt - nl) / CAST(nt AS DOUBLE) * ({fn.entropy('(yt - yl)', 'CAST(nt - nl AS DOUBLE)')}))"
    return f"""
    SELECT feature, bin, {fn.gain("gl", "hl", "gt", "ht", lam, gamma)} + {info} AS gain
    FROM ({prefix_sums(hist)}) AS p WHERE bin < last AND nl >= 1 AND nt - nl >= 1 AND hl >= {min_child!r} AND ht - hl >= {min_child!r}"""


def best_split(hist: str, **settings: float) -> str:
    """The split of largest gain; ties go to the lower feature, then the lower bin."""
    return f"SELECT feature, bin, gain FROM ({split_gains(hist, **settings)}) AS s ORDER BY gain DESC, feature, bin LIMIT 1"


def variance_histogram(rel: str, features: list[str], y: str) -> str:
    """(feature, bin, n, y, yy): rows, sums and sums of squares of a label per bin."""
    return " UNION ALL ".join(f"SELECT {k} AS feature, CAST({f} AS INT) AS bin, count(*) AS n, sum({y}) AS y, sum({y} * {y}) AS yy FROM {rel} AS t GROUP BY {f}" for k, f in enumerate(features))


def variance_histogram_in_one_scan(rel: str, features: list[str], y: str) -> str:
    """``variance_histogram`` for Spark."""
    bins = ", ".join(f"CAST({f} AS INT)" for f in features)
    return f"SELECT feature, bin, count(*) AS n, sum(y) AS y, sum(y * y) AS yy FROM (SELECT posexplode(array({bins})) AS (feature, bin), {y} AS y FROM {rel} AS t) AS x GROUP BY feature, bin"


def variance_split(hist: str, least: int = 1) -> str:
    """The split that reduces the variance of the label most, ties to the lower feature, then bin."""
    left = "OVER (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = ", ".join(f"sum({c}) {left} AS {c}l, sum({c}) OVER (PARTITION BY feature) AS {c}t" for c in ("n", "y", "yy"))
    return f"""
    SELECT feature, bin, ((yyt - yt * yt / nt) - (yyl - yl * yl / nl) - (yyt - yyl - (yt - yl) * (yt - yl) / (nt - nl))) / nt AS reduction
    FROM (SELECT feature, bin, {cols} FROM ({hist}) AS h) AS p WHERE nl >= {least} AND nt - nl >= {least} ORDER BY 3 DESC, feature, bin LIMIT 1"""


# --- metrics ---------------------------------------------------------------------


def _ranked(rel: str, score: str, label: str, order: str) -> str:
    down = "OVER (ORDER BY s DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
    SELECT y, sum(y) {down} AS tp, count(*) {down} AS seen, sum(y) OVER () AS p, count(*) OVER () AS n
    FROM (SELECT {score} AS s, {fn.as_binary(label)} AS y, {order} AS o FROM {rel} AS t) AS r"""


def roc_auc(rel: str, score: str, label: str, order: str) -> str:
    """Area under ROC, ties broken by ``order``; 0.5 if there is one class only."""
    return f"SELECT {round6('CASE WHEN max(p) = 0 OR max(p) = max(n) THEN 0.5 ELSE sum(CASE WHEN y = 0 THEN tp ELSE 0.0 END) / (max(p) * (max(n) - max(p))) END')} AS auc FROM ({_ranked(rel, score, label, order)}) AS q"


def pr_auc(rel: str, score: str, label: str, order: str) -> str:
    """Average precision, ties broken by ``order``; 0 without positives."""
    return f"SELECT {round6('CASE WHEN max(p) = 0 THEN 0.0 ELSE sum(CASE WHEN y > 0 THEN tp / seen ELSE 0.0 END) / max(p) END')} AS auc FROM ({_ranked(rel, score, label, order)}) AS q"


def roc_auc_by_score(rel: str, score: str, label: str) -> str:
    """Area under ROC with ties at half, from counts per score: what a large input should use."""
    return f"""
    SELECT {round6("CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.5 ELSE sum(neg * (above + pos / 2.0)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) END")} AS auc
    FROM (SELECT pos, neg, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
          FROM (SELECT {score} AS s, count(CASE WHEN {fn.positive(label)} THEN 1 END) AS pos, count(CASE WHEN NOT {fn.positive(label)} THEN 1 END) AS neg FROM {rel} AS t GROUP BY {score}) AS c) AS w"""


_COUNTS = "count(CASE WHEN hit AND yes THEN 1 END) AS tp, count(CASE WHEN hit AND NOT yes THEN 1 END) AS fp, count(CASE WHEN NOT hit AND yes THEN 1 END) AS fn, count(CASE WHEN NOT hit AND NOT yes THEN 1 END) AS tn"


def _f1(extra: str = "") -> str:
    p, r = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END", "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END"
    f1 = "CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END"
    return f"{extra} tp, fp, fn, tn, {round6(p)} AS precision_, {round6(r)} AS recall, {round6(f1)} AS f1, {round6('CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) END')} AS accuracy"


def confusion(rel: str, score: str, label: str, threshold: float = 0.5) -> str:
    return f"SELECT {_f1()} FROM (SELECT {_COUNTS} FROM (SELECT {score} >= {threshold!r} AS hit, {fn.positive(label)} AS yes FROM {rel} AS t) AS x) AS c"


def threshold_sweep(rel: str, score: str, label: str) -> str:
    """The first threshold of .10, .15, ... .85 with the best F1, from a row for each row and threshold."""
    steps = ", ".join(f"({i / 100!r})" for i in range(10, 90, 5))
    return f"""
    SELECT {_f1("threshold,")} FROM (SELECT CAST(u.th AS DOUBLE) AS threshold, {_COUNTS}
        FROM (SELECT th, {score} >= th AS hit, {fn.positive(label)} AS yes FROM {rel} AS t JOIN (VALUES {steps}) AS v(th) ON true) AS u GROUP BY u.th) AS c
    ORDER BY f1 DESC, threshold LIMIT 1"""


def threshold_sweep_in_one_scan(rel: str, score: str, label: str) -> str:
    """``threshold_sweep`` for Spark: hits at each threshold are conditional counts, so nothing is multiplied."""
    steps = [i / 100 for i in range(10, 90, 5)]
    hits = ", ".join(f"count(CASE WHEN s >= {t!r}D AND yes THEN 1 END) AS tp{k}, count(CASE WHEN s >= {t!r}D AND NOT yes THEN 1 END) AS fp{k}" for k, t in enumerate(steps))
    rows = ", ".join(f"named_struct('threshold', {t!r}D, 'tp', tp{k}, 'fp', fp{k}, 'fn', p - tp{k}, 'tn', n - fp{k})" for k, t in enumerate(steps))
    return f"""
    SELECT {_f1("threshold,")} FROM (SELECT c.* FROM (SELECT explode(array({rows})) AS c
        FROM (SELECT count(CASE WHEN yes THEN 1 END) AS p, count(CASE WHEN NOT yes THEN 1 END) AS n, {hits} FROM (SELECT {score} AS s, {fn.positive(label)} AS yes FROM {rel} AS t) AS x) AS y) AS z) AS w
    ORDER BY f1 DESC, threshold LIMIT 1"""


def class_f1_counts(rel: str, predicted: str, label: str) -> str:
    """Per class: support, predictions, hits, precision, recall, F1.  The rows are reduced to a table of pairs first."""
    pairs = f"SELECT {label} AS y, {predicted} AS p, count(*) AS n FROM {rel} AS t GROUP BY 1, 2"
    return f"""
    SELECT c, support, predicted, hits,
           {round6("CASE WHEN predicted = 0 THEN 0.0 ELSE hits / CAST(predicted AS DOUBLE) END")} AS precision_,
           {round6("CASE WHEN support = 0 THEN 0.0 ELSE hits / CAST(support AS DOUBLE) END")} AS recall,
           {round6("CASE WHEN hits = 0 THEN 0.0 ELSE 2.0 * hits / CAST(support + predicted AS DOUBLE) END")} AS f1
    FROM (SELECT c, CAST(sum(s) AS BIGINT) AS support, CAST(sum(q) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits
          FROM (SELECT y AS c, n AS s, 0 AS q, CASE WHEN y = p THEN n ELSE 0 END AS h FROM ({pairs}) AS a
                UNION ALL SELECT p AS c, 0 AS s, n AS q, 0 AS h FROM ({pairs}) AS b) AS u GROUP BY c) AS f"""


def macro_f1(rel: str, predicted: str, label: str) -> str:
    return f"""
    SELECT count(*) AS classes, {round6("avg(f1)")} AS macro_f1, {round6("sum(f1 * support) / sum(support)")} AS weighted_f1
    FROM ({class_f1_counts(rel, predicted, label)}) AS k"""


def regression_metrics(rel: str, predicted: str, label: str) -> str:
    """RMSE, MAE and R squared (against the mean)."""
    return f"""
    SELECT {round6("sqrt(avg((y - p) * (y - p)))")} AS rmse, {round6("avg(abs(y - p))")} AS mae,
           {round6("CASE WHEN var_pop(y) = 0 THEN 0.0 ELSE 1.0 - avg((y - p) * (y - p)) / var_pop(y) END")} AS r2
    FROM (SELECT CAST({label} AS DOUBLE) AS y, CAST({predicted} AS DOUBLE) AS p FROM {rel} AS t) AS x"""


def pr_auc_by_score(rel: str, score: str, label: str) -> str:
    """Average precision with rows of one score taken together, from counts per score."""
    down = "OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
    SELECT {round6("CASE WHEN coalesce(sum(pos), 0) = 0 THEN 0.0 ELSE sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos) END")} AS auc
    FROM (SELECT pos, sum(pos) {down} AS tp, sum(k) {down} AS seen
          FROM (SELECT {score} AS s, count(*) AS k, count(CASE WHEN {fn.positive(label)} THEN 1 END) AS pos FROM {rel} AS t GROUP BY {score}) AS c) AS w"""


def poisson_deviance(rel: str, margin: str, label: str) -> str:
    return f"SELECT {round6(f'avg({fn.rate(margin)} - ({label}) * ({margin}))')} AS loss FROM {rel} AS t"


# --- drift ---------------------------------------------------------------------


def error_entropy(rel: str, error: str, bins: int = 10) -> str:
    """Entropy in bits of the non-negative finite errors in equal-width bins from 0 to the largest (an aggregate, not a window)."""
    sound = f"SELECT e FROM (SELECT {error} AS e FROM {rel} AS t) AS x WHERE e >= 0 AND e < CAST('Infinity' AS DOUBLE)"
    return f"""
    SELECT {round6("coalesce(sum(-p * log2(p)), 0.0)")} AS entropy, count(*) AS bins
    FROM (SELECT k / CAST(sum(k) OVER () AS DOUBLE) AS p
          FROM (SELECT b, count(*) AS k
                FROM (SELECT least(floor(e / ((SELECT max(e) FROM ({sound}) AS m) + 0.0000000001) * {bins}), {bins - 1}) AS b FROM ({sound}) AS s) AS y GROUP BY b) AS c) AS z"""


def autocorrelation(rel: str, error: str, order: str) -> str:
    """Lag-1 autocorrelation of absolute errors, newest first; 0 without spread."""
    return f"""
    SELECT {round6("CASE WHEN sum((e - mu) * (e - mu)) < 0.0000000001 THEN 0.0 ELSE sum((e - mu) * (coalesce(nxt, mu) - mu)) / sum((e - mu) * (e - mu)) END")} AS acf
    FROM (SELECT e, avg(e) OVER () AS mu, lead(e) OVER (ORDER BY o DESC) AS nxt FROM (SELECT abs({error}) AS e, {order} AS o FROM {rel} AS t) AS a) AS b"""


def heteroscedasticity(rel: str, predicted: str, error: str, order: str) -> str:
    """Spread of the variance of absolute errors over chunks of rows sorted by prediction; 0 for under ten rows."""
    return f"""
    SELECT {round6("coalesce(sqrt(sum((v - mu) * (v - mu))), 0.0)")} AS het, count(*) AS chunks
    FROM (SELECT v, avg(v) OVER () AS mu
          FROM (SELECT chunk, var_pop(e) AS v
                FROM (SELECT e, floor((rn - 1) / floor(n / least(10, floor(n / 10)))) AS chunk
                      FROM (SELECT abs({error}) AS e, row_number() OVER (ORDER BY {predicted}, {order}) AS rn, count(*) OVER () AS n FROM {rel} AS t) AS a WHERE n >= 10) AS b
                GROUP BY chunk) AS c) AS d"""


def mean_shift(rel: str, features: list[str], order: str, size: int = 1000, least: int = 100) -> str:
    """Per feature: relative shift of the mean of the newest rows from the oldest; drifted over 0.2."""
    means = ", ".join(f"avg(CASE WHEN up <= {size} THEN {f} END) AS old{k}, avg(CASE WHEN down <= {size} THEN {f} END) AS new{k}" for k, f in enumerate(features))
    parts = [f"SELECT '{f}' AS feature, {round6(f'abs(new{k} - old{k}) / greatest(abs(old{k}), 0.0000000001)')} AS shift, abs(new{k} - old{k}) / greatest(abs(old{k}), 0.0000000001) > 0.2 AS drifted FROM m WHERE n >= {least}" for k, f in enumerate(features)]
    return f"""
    WITH m AS (SELECT {means}, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS up, row_number() OVER (ORDER BY {order} DESC) AS down FROM {rel} AS t) AS a)
    {" UNION ALL ".join(parts)}"""


def ema(rel: str, value: str, order: str, alpha: float = 0.1, start: float = 0.0) -> str:
    """Exponential moving average after the last row, in closed form: one aggregate over numbered rows."""
    keep = 1 - alpha
    return f"""
    SELECT {round6(f"sum({alpha!r} * x * power(CAST({keep!r} AS DOUBLE), n - rn)) + power(CAST({keep!r} AS DOUBLE), max(n)) * {start!r}")} AS ema, count(*) AS n
    FROM (SELECT {value} AS x, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM {rel} AS t) AS a"""


def newest(rel: str, order: str, k: int) -> str:
    """The k newest rows."""
    return f"SELECT * FROM {rel} AS t ORDER BY {order} DESC LIMIT {k}"


def batches(rel: str, order: str, size: int) -> str:
    """Rows with a batch number, ``size`` rows a batch, in order."""
    return f"SELECT *, CAST(floor((row_number() OVER (ORDER BY {order}) - 1) / {size}) AS INT) AS batch FROM {rel} AS t"


def vulnerability_baseline(rel: str, p: str, y: str) -> str:
    """Mean of confidence times squared error, positives weighted, and the two thresholds by share of positives."""
    tiers = lambda a, b, c, d: f"CASE WHEN r < 0.02 THEN {a} WHEN r < 0.10 THEN {b} WHEN r < 0.20 THEN {c} ELSE {d} END"
    ratio = f"(SELECT avg({fn.as_binary(y)}) FROM {rel} AS t0)"
    w = f"CASE WHEN {fn.positive(y)} THEN least(1.0 / {ratio}, 1000.0) ELSE 1.0 END"
    return f"""
    SELECT {round6("base")} AS baseline, {round6(f"base * {tiers(1.5, 1.8, 2.0, 2.5)}")} AS alert_threshold, {round6(f"base * {tiers(2.0, 2.5, 3.0, 3.5)}")} AS adapt_threshold
    FROM (SELECT avg(2.0 * abs({p} - 0.5) * ({y} - {p}) * ({y} - {p}) * ({w})) AS base, {ratio} AS r FROM {rel} AS t) AS x"""


def drift_strategy(rel: str, features: list[str], medians: list[str], p: str, y: str) -> str:
    """Scores of corruption (volatile features and wrong positives) and of concept drift, and what they call for.

    ``medians``: of each feature, as expressions."""
    spread = [f"sqrt(avg(({f} - {m}) * ({f} - {m})))" for f, m in zip(features, medians, strict=True)]
    wrong = f"coalesce(avg(CASE WHEN {fn.positive(y)} THEN CASE WHEN abs({y} - {p}) > 0.3 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END), 0.0)"
    return f"""
    SELECT {round6("corruption")} AS corruption, {round6("concept")} AS concept,
           CASE WHEN corruption > 0.6 AND corruption > concept THEN 'features' WHEN concept > 0.7 THEN 'data' ELSE 'cautious' END AS strategy
    FROM (SELECT least(1.0, least(v / 10.0, 1.0) * minority * 2.0) AS corruption, CASE WHEN v < 3.0 AND minority > 0.3 THEN 0.8 ELSE 0.0 END AS concept
          FROM (SELECT ({" + ".join(spread)}) / {len(features)!r} AS v, {wrong} AS minority FROM {rel} AS t) AS a) AS b"""


def decay(rel: str, key: str, at: str, rate: float = 0.0005, dead_below: float = 0.15) -> str:
    """(key, since, utility, dead): of each key the rows since it was last seen and what is left of its use."""
    return f"""
    SELECT k, since, {round6(f"power(CAST({1 - rate!r} AS DOUBLE), since)")} AS utility, power(CAST({1 - rate!r} AS DOUBLE), since) < {dead_below!r} AS dead
    FROM (SELECT k, (SELECT max({at}) FROM {rel} AS t0) - last AS since FROM (SELECT {key} AS k, max({at}) AS last FROM {rel} AS t GROUP BY {key}) AS a) AS b"""


# --- clusters ----------------------------------------------------------------------


def nearest_center(points: str, centers: str, dims: int, key: str) -> str:
    """(key, partition, distance): the center of least squared distance, the lower number on ties.

    ``points`` and ``centers`` have columns c0 .. c{dims-1}.  Every pair is a row here; ``ensembles.nearest_expression``
    is the form without a join."""
    d = " + ".join(f"(p.c{i} - c.c{i}) * (p.c{i} - c.c{i})" for i in range(dims))
    return f"""
    SELECT {key}, partition_, distance FROM (
        SELECT {key}, partition_, distance, row_number() OVER (PARTITION BY {key} ORDER BY distance, partition_) AS rn
        FROM (SELECT p.{key}, c.partition_, {d} AS distance FROM {points} AS p JOIN {centers} AS c ON true) AS all_) AS r WHERE rn = 1"""


# --- trees -----------------------------------------------------------------------


def score_expression(nodes: list[dict], column: str = "f{}", at: int = 0) -> str:
    """A tree as nested CASE over bin columns: ``nodes`` by number, a split with feature, threshold, left, right, a leaf with value."""
    node = nodes[at]
    if "value" in node:
        return f"CAST({float(node['value'])!r} AS DOUBLE)"
    return (
        f"CASE WHEN {column.format(node['feature'])} <= {node['threshold']} THEN {score_expression(nodes, column, node['left'])} "
        f"ELSE {score_expression(nodes, column, node['right'])} END"
    )


def feature_usage(trees: str) -> str:
    """(feature, usage, importance): the number of trees that split on a feature, and its share."""
    return f"""
    SELECT feature, usage_, {round6("usage_ / CAST(sum(usage_) OVER () AS DOUBLE)")} AS importance
    FROM (SELECT feature, count(DISTINCT tree_id) AS usage_ FROM {trees} AS t WHERE kind = 'split' GROUP BY feature) AS u"""


def dependency(trees: str, dead: str) -> str:
    """(tree_id, splits, on_dead, dependency): the share of a tree's splits on the features of ``dead`` (column feature)."""
    return f"""
    SELECT tree_id, count(CASE WHEN kind = 'split' THEN 1 END) AS splits, count(CASE WHEN kind = 'split' AND d.feature IS NOT NULL THEN 1 END) AS on_dead,
           {round6("CASE WHEN count(CASE WHEN kind = 'split' THEN 1 END) = 0 THEN 0.0 ELSE count(CASE WHEN kind = 'split' AND d.feature IS NOT NULL THEN 1 END) / CAST(count(CASE WHEN kind = 'split' THEN 1 END) AS DOUBLE) END")} AS dependency
    FROM {trees} AS t LEFT JOIN {dead} AS d ON t.feature = d.feature GROUP BY tree_id"""


def prune(trees: str, dead: str, threshold: float) -> str:
    """The trees whose dependency on dead features stays below the threshold."""
    bad = f"SELECT tree_id AS bad_id FROM ({dependency(trees, dead)}) AS d0 WHERE dependency >= {threshold!r}"
    return f"SELECT t.* FROM {trees} AS t LEFT JOIN ({bad}) AS b ON t.tree_id = b.bad_id WHERE b.bad_id IS NULL"

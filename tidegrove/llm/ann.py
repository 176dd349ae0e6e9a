"""Approximate nearest neighbours by cosine: stable projections, kd-trees, a chi-square stopping test.

Vectors are scaled to length one, where a large cosine is a small Euclidean
distance, and projected to ``dims`` dimensions by a Gaussian matrix.  For a pair
at distance d, the squared projected distance over d squared has a chi-square
distribution with ``dims`` degrees of freedom.  So once everything within
projected distance x of a query has been verified, and x squared over the
squared distance of the k-th best so far is beyond that distribution's
``confidence`` quantile, each true neighbour has been met with at least that
probability, and the search stops.

The top of the kd-tree is cut from a bounded sample of projected vectors; its
cells are the shards.  A query is first answered in its own cell; the distance
found there bounds which other cells the test still lets it visit.  In a cell a
local kd-tree's leaves are visited by growing distance.  Cells and their queries
are dealt in blocks, so a vector with very many copies only means more blocks.

Vectors that are null, zero, or hold a null or non-finite component take no part
(such a query has no rows).  Vectors are compared with those of the same length.
A repeated id is a row like any other: a query never finds its own row, but may
find another with its id.  Null ids are candidates, never queries.  Columns
besides the id and the vector are ignored, whatever their names.  Fewer than k
candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrove.llm.common import ready_checkpoints, table


@dataclass(frozen=True)
class AnnConfig:
    """k neighbours; dims must be even (the distribution then has a closed form); at most ``sample`` vectors shape the cells."""

    k: int = 5
    dims: int = 8
    confidence: float = 0.97
    seed: int = 7
    sample: int = 20_000
    cell_points: int = 16_000
    leaf: int = 256
    cell_queries: int = 4_096


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(np.array(mid), dims) < p else (low, mid)
    return high


def project(vectors: np.ndarray, cfg: AnnConfig) -> np.ndarray:
    """Coordinates of the vectors' directions; the matrix depends on the length of the vectors and the seed."""
    scale = np.abs(vectors).max(1, keepdims=True)
    unit = vectors / scale
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    return unit @ np.random.default_rng([cfg.seed, vectors.shape[1]]).standard_normal((vectors.shape[1], cfg.dims))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows; equal rows give equal numbers wherever they stand."""
    top = np.abs(a).max(1, keepdims=True), np.abs(b).max(1, keepdims=True)
    if max(t.max(initial=1.0) for t in top) > 1e100 or min(t.min(initial=1.0) for t in top) < 1e-100:
        a, b = a / top[0], b / top[1]
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def cut(coords: np.ndarray, levels: int, first: int = 0):
    """A kd-tree of (axis, value, below, above); its leaves are numbered from ``first``."""
    if levels <= 0 or len(coords) < 2:
        return first, first + 1
    axis = int(np.argmax(coords.max(0) - coords.min(0)))
    value = float(np.median(coords[:, axis]))
    side = coords[:, axis] < value
    if side.all() or not side.any():
        return first, first + 1
    below, first = cut(coords[side], levels - 1, first)
    above, first = cut(coords[~side], levels - 1, first)
    return (axis, value, below, above), first


def cell_distances(tree, n: int, coords: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each of a tree's n cells (0 to its own)."""
    out = np.zeros((len(coords), n))

    def walk(node, offsets, total):
        if isinstance(node, int):
            out[:, node] = total
            return
        axis, value, below, above = node
        gap = coords[:, axis] - value
        old = offsets.get(axis, 0.0)
        for child, off in ((below, np.maximum(gap, 0)), (above, np.maximum(-gap, 0))):
            new = np.maximum(old, off * off)
            walk(child, {**offsets, axis: new}, total - old + new)

    walk(tree, {}, np.zeros(len(coords)))
    return out


class LocalIndex:
    """The points of one cell in the order of a kd-tree's leaves."""

    def __init__(self, vectors: np.ndarray, cfg: AnnConfig):
        self.cfg = cfg
        coords = project(vectors, cfg)
        order, self.bounds, todo = [], [], [np.arange(len(vectors))]
        while todo:
            at = todo.pop()
            axis = int(np.argmax(coords[at].max(0) - coords[at].min(0)))
            if len(at) <= cfg.leaf or np.ptp(coords[at, axis]) == 0:
                for i in range(0, len(at), cfg.leaf):
                    order.append(at[i : i + cfg.leaf])
                continue
            half = np.argpartition(coords[at, axis], len(at) // 2)
            todo += [at[half[len(at) // 2 :]], at[half[: len(at) // 2]]]
        self.leaves = order
        self.low = np.array([coords[x].min(0) for x in order])
        self.high = np.array([coords[x].max(0) for x in order])
        self.vectors = vectors
        self.unit = vectors / np.abs(vectors).max(1, keepdims=True)
        self.unit /= np.sqrt((self.unit * self.unit).sum(1, keepdims=True))

    def search(self, queries: np.ndarray, rows: np.ndarray, own_rows: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, cosine) of the k best of each query; ``bound``: a cosine that the k-th best is known to reach."""
        cfg, n = self.cfg, len(queries)
        coords = project(queries, cfg)
        gap = np.maximum(np.maximum(self.low[None] - coords[:, None], coords[:, None] - self.high[None]), 0)
        reach = (gap * gap).sum(2)
        turn = np.argsort(reach, axis=1, kind="stable")
        unit = queries / np.abs(queries).max(1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kth, active = bound.copy(), np.arange(n)
        for step in range(len(self.leaves)):
            leaf = turn[active, step]
            far = reach[active, leaf] / np.maximum(2 - 2 * kth[active], 1e-12)
            go = ~np.isfinite(kth[active]) | (chi_square_cdf(far, cfg.dims) < cfg.confidence) | (reach[active, leaf] <= 0)
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            found = []
            for number in np.unique(leaf):
                who, points = active[leaf == number], self.leaves[number]
                near = unit[who] @ self.unit[points].T
                near[rows[points][None, :] == own_rows[who][:, None]] = -np.inf
                least = kth[who] - 1e-9
                if len(points) > cfg.k:
                    least = np.maximum(least, np.partition(near, len(points) - cfg.k, axis=1)[:, -cfg.k] - 1e-9)
                x, y = np.nonzero((near >= least[:, None]) & np.isfinite(near))
                found.append((who[x], points[y]))
            q, p = (np.concatenate(c) for c in zip(*found, strict=True))
            score = cosines(queries[q], self.vectors[p])
            q, p, score = (np.concatenate(c) for c in zip(best, (q, p, score), strict=True))
            order = np.lexsort((rows[p], ids[p], -score, q))
            q, p, score = q[order], p[order], score[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            keep = rank < cfg.k
            best = q[keep], p[keep], score[keep]
            full = rank == cfg.k - 1
            kth[q[full]] = np.maximum(kth[q[full]], score[full])
        return best


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


_SCHEMA = "q long, query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, cfg: AnnConfig = AnnConfig(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    ready_checkpoints(spark)
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where(v.isNotNull() & sound & F.exists(v, lambda x: x != 0))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("width", F.size("v"))
        .checkpoint()
    )
    sizes = {r.width: r["count"] for r in rows.groupBy("width").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trees, offset = {}, 0
    for width, n in sorted(sizes.items()):
        levels = max(0, math.ceil(math.log2(n / cfg.cell_points)))
        some = rows.where(F.col("width") == width).orderBy(F.xxhash64("row")).limit(cfg.sample).select("v").toArrow().column(0) if levels else None
        tree, cells = cut(project(_matrix(some), cfg), levels) if levels else (0, 1)
        trees[width] = (tree, cells, offset)
        offset += cells
    most = chi_square_quantile(cfg.confidence, cfg.dims)

    def visits(home: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                    widths = part.column("width").to_numpy(zero_copy_only=False)
                    for width in np.unique(widths):
                        some = part.filter(pa.array(widths == width))
                        tree, cells, first = trees[int(width)]
                        reach = cell_distances(tree, cells, project(_matrix(some.column("v")), cfg))
                        own = reach.argmin(1)
                        if home:
                            at, cell = np.arange(len(own)), own
                        else:
                            bound = some.column("bound").to_numpy(zero_copy_only=False)
                            near = reach <= most * np.maximum(2 - 2 * bound, 0)[:, None] + 1e-12
                            near[~np.isfinite(bound)] = True
                            near[np.arange(len(own)), own] = False
                            at, cell = np.nonzero(near)
                        yield some.take(pa.array(at)).append_column("cell", pa.array((cell + first).astype(np.int32)))

        return run

    def search(data: pa.Table) -> pa.Table:
        asks = data.column("asks").to_numpy(zero_copy_only=False)
        points, queries = data.filter(pa.array(~asks)), data.filter(pa.array(asks))
        empty = pa.table({k: pa.array([], t) for k, t in (("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        if not points.num_rows or not queries.num_rows:
            return empty
        rows = points.column("row").to_numpy()
        known = points.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
        index = LocalIndex(_matrix(points.column("v")), cfg)
        parts = []
        for i in range(0, queries.num_rows, 512):
            some = queries.slice(i, 512)
            q, p, score = index.search(_matrix(some.column("v")), rows, some.column("row").to_numpy(), known, some.column("bound").to_numpy())
            parts.append(
                pa.table({"q": some.column("row").take(pa.array(q)), "query_id": some.column("id").take(pa.array(q)), "vec_id": points.column("id").take(pa.array(p)), "score": pa.array(score)})
            )
        return pa.concat_tables(parts) if parts else empty

    kept = "row long, id long, width int, v array<double>"
    points = rows.select("row", "id", "width", "v").mapInArrow(visits(True), f"{kept}, cell int")
    homes = {r.cell: r["count"] for r in points.groupBy("cell").count().collect()}

    def ask(queries: DataFrame) -> DataFrame:
        """Queries (with cell and bound) against the points of their cells, in blocks of both."""
        asked = {r.cell: r["count"] for r in queries.groupBy("cell").count().collect()}
        if not asked:
            return spark.createDataFrame([], _SCHEMA)
        deal = spark.createDataFrame([(c, -(-homes.get(c, 1) // (2 * cfg.cell_points)), -(-n // cfg.cell_queries)) for c, n in asked.items()], "cell int, pn int, qn int")

        def dealt(df: DataFrame, mine: str, theirs: str, other: str) -> DataFrame:
            one = df.join(deal, "cell").withColumn(mine, F.pmod(F.xxhash64("row"), F.col(mine)).cast("int"))
            return one.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))

        a = dealt(points, "pn", "qn", "qn").select("cell", "pn", "qn", "row", "id", "v", F.lit(False).alias("asks"), F.lit(0.0).alias("bound"))
        b = dealt(queries, "qn", "pn", "pn").select("cell", "pn", "qn", "row", "id", "v", F.lit(True).alias("asks"), "bound")
        return a.union(b).groupBy("cell", "pn", "qn").applyInArrow(search, _SCHEMA)

    best = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    queries = rows.where(F.col("asks") & F.col("id").isNotNull()).select("row", "id", "width", "v", F.lit(float("-inf")).alias("bound"))
    near = ask(queries.mapInArrow(visits(True), f"{kept}, bound double, cell int")).checkpoint()
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cfg.k).drop("rank")
    bounds = ranked.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    told = queries.drop("bound").join(bounds, F.col("row") == F.col("q"), "left")
    told = told.select("row", "id", "width", "v", F.when(F.col("n") >= cfg.k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("bound"))
    far = ask(told.mapInArrow(visits(False), f"{kept}, bound double, cell int").checkpoint())
    out = ranked.union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cfg.k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)

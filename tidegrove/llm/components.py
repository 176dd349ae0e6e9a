"""Connected components of a graph given as a table of edges, by alternating star operations.

Each round first links every larger neighbour of a node to the node's smallest
neighbour, then every smaller one and the node itself.  The edges shrink to
stars around the smallest node of each component in a number of rounds
logarithmic in practice.  Nodes with very many neighbours are joined, not
gathered: their smallest neighbour is found by a partial aggregate and broadcast,
so that a star is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrove.llm.common import join_skewed, ready_checkpoints


#: Edges in a file of a checkpoint.
FILE_EDGES = 100_000


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One operation on edges (a, b), a > b, at most n of them."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("copies")).select("a", F.least("a", "m").alias("m"), "copies")
        far = join_skewed(near.where("b > a"), least, ["a"], "copies", 2 * n)
        moved = far.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("copies"))
        moved = join_skewed(edges, least, ["a"], "copies", n).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root): for each node that isn't its component's smallest, that smallest node.

    ``edges`` has columns a and b of one type; the order in an edge and repeated
    edges don't matter.  No edges give no rows."""
    ready_checkpoints(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.withColumnRenamed("b", "root")
        state, n = seen, seen[0]
        # The first operation leaves no more edges than there were.  Few edges need few files.
        files = 1 + n // FILE_EDGES
        half = _star(now, True, n).coalesce(files)
        now = _star(half.checkpoint() if n > FILE_EDGES else half, False, n).coalesce(files).checkpoint()

"""Shards of near-equal bytes by best-fit-decreasing bin packing.

Documents with equal texts form a group that stays together.  Groups are taken
by falling size; each enters the bin with the least capacity left that still
holds it, found in a balanced tree over what the bins have left.  Which of
several groups of one size goes where does not matter to the packing, so the
driver sees only how many groups there are of each size; the groups themselves
are numbered within their size and looked up in the packing by joins.

A group of more than one shard's worth of bytes cannot stay together if shards
are to be near equal: it alone is dealt, by row, into parts small enough, each
of which is then one item.

Null texts count as empty ones.  A row is numbered as such, so repeated ids and
repeated rows each get a slot.  Texts longer than a shard's worth raise the
capacity.  Columns besides the id and the text are ignored, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrove.llm.common import mix64, ready_checkpoints, table

#: Fixed overhead of a document in bytes.
OVERHEAD = 16
#: Groups of one size, and rows of one shard, that one task numbers.
NUMBERED = 100_000


class CapacityTree:
    """A treap of (capacity left, bin); keys are unique, priorities are a hash of the bin."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _split(node, key):
        """Nodes before ``key`` and the rest; a node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = CapacityTree._split(node[3], key)
            return node, right
        left, node[2] = CapacityTree._split(node[2], key)
        return left, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = CapacityTree._merge(a[3], b)
            return a
        b[2] = CapacityTree._merge(a, b[2])
        return b

    def put(self, left: int, number: int) -> None:
        import numpy as np

        node = [(left, number), int(mix64(np.array([number + 1]))[0]), None, None]
        a, b = self._split(self.root, node[0])
        self.root = self._merge(self._merge(a, node), b)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least left of those that hold ``size``."""
        below, rest = self._split(self.root, (size, -1))
        if rest is None:
            self.root = below
            return None
        parent, node = None, rest
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            rest = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(below, rest)
        return node[0]


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Pack (size, count) items: runs (size, first, end, bin), items of a size numbered from 0.

    A bin that just took an item has the least left of all that could, so it goes
    on taking items of this size until they no longer fit: a run at a time gives
    exactly what an item at a time would.  None if more than ``most`` bins are
    needed or an item exceeds the capacity."""
    tree, bins, runs = CapacityTree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        if size > capacity:
            return None
        done = 0
        while done < count:
            if (found := tree.take_tightest(size)) is None:
                if bins == most:
                    return None
                found = (capacity, bins)
                bins += 1
            left, number = found
            n = min(count - done, left // size if size else count - done)
            runs.append((size, done, done + n, number))
            done += n
            tree.put(left - n * size, number)
    return runs


def pack_into(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing into ``shards`` bins, with the least capacity found: equal shares, and then ever more slack."""
    total = sum(s * n for s, n in sizes)
    least = max([math.ceil(total / shards), *(s for s, _ in sizes)]) if sizes else 0
    slack = 0
    while (runs := best_fit_decreasing(sizes, least + slack, shards)) is None:
        slack = max(1, 2 * slack, least >> 17)
    return runs


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null).

    Texts are read once; their sizes and digests, some fifty bytes a row, are
    checkpointed and all else works on those."""
    spark = docs.sparkSession
    ready_checkpoints(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.unhex(F.sha2(text, 256)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ).checkpoint()
    n_rows, total, largest = rows.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    share = max(math.ceil((total or 0) / shards), largest or 0)

    # Fewer than ``shards`` groups can exceed a shard's worth of bytes.
    big = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share).collect()
    parts = spark.createDataFrame([(r.key, 16 * math.ceil(r.bytes / share)) for r in big], "key binary, parts int")
    rows = rows.join(F.broadcast(parts), "key", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")))).drop("parts")

    groups = rows.groupBy("key", "part").agg(F.sum("size").alias("bytes"))
    counts = groups.groupBy("bytes").count().collect()
    runs = pack_into([(r.bytes, r["count"]) for r in counts], shards)
    packed = spark.createDataFrame([(s, a, b, k) for s, a, b, k in runs], "bytes long, first long, end long, shard int")

    # Sizes that many groups have are numbered in cells, each after those before it.
    hot = [(r.bytes, math.ceil(r["count"] / NUMBERED)) for r in counts if r["count"] > 2 * NUMBERED]
    groups = groups.withColumn("cell", F.lit(0))
    if hot:
        cells = spark.createDataFrame(hot, "bytes long, cells int")
        groups = groups.drop("cell").join(cells, "bytes", "left").withColumn("cell", F.coalesce(F.pmod(F.xxhash64("key", "part"), F.col("cells")), F.lit(0))).drop("cells")
    placed = groups.withColumn("at", F.row_number().over(W.partitionBy("bytes", "cell").orderBy("key", "part")) - 1)
    if hot:
        placed = _after_earlier(placed, groups, ["bytes"], "cell", "at")
    placed = placed.join(packed, "bytes").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("end"))).select("key", "part", "shard")

    out = rows.join(placed, ["key", "part"])
    blocks = math.ceil(n_rows / shards / NUMBERED) or 1
    out = out.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    slots = out.withColumn("slot", (F.row_number().over(W.partitionBy("shard", "block").orderBy("id", "row")) - 1).cast("long"))
    if blocks > 1:
        slots = _after_earlier(slots, out, ["shard"], "block", "slot")
    return slots.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _after_earlier(numbered: DataFrame, rows: DataFrame, keys: list[str], cell: str, number: str) -> DataFrame:
    """Numbers within (keys, cell) made numbers within keys: the counts of earlier cells are added."""
    counts = rows.groupBy(*keys, cell).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).drop("n")
    return numbered.join(starts, [*keys, cell]).withColumn(number, F.col(number) + F.col("before")).drop("before")


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents under ``path``, a folder per shard.  Ids must be unique here."""
    place = assign_shards(docs, shards, id_col, text_col).select(id_col, "shard", "slot")
    docs.join(place, id_col).repartition("shard", F.floor(F.col("slot") / NUMBERED)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))

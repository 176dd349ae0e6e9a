"""SimHash near-duplicates: fingerprints, sharded vantage-point trees, components.

The top of a tree is grown on the driver from a bounded sample; its leaves are
shards.  A fingerprint lives in one shard and is looked for in every later shard
that the triangle bound cannot rule out: with vantage point v and radius m, a
fingerprint at distance d from v can have partners within r inside only if
d <= m + r and outside only if d >= m + 1 - r.  In a shard the same bounds drive
a local tree down to small leaves, where distances are counted; points already
known to be in one component are not compared again.  The search is exact.  A
shard with many points or many visitors is dealt over a grid of tasks.  A shard
returns a spanning forest of the links it finds, so a group of m close
fingerprints costs m - 1 edges; components come from those forests.

Two kinds of fingerprint: ``fingerprints`` are 64 bits over all shingles, linked
within a few bits.  ``wide_fingerprints`` are longer, over distinct shingles, so
that the share of differing bits tells the Jaccard similarity; documents of
similarity s or more differ in length by that factor at most, so each band of
lengths has a tree of its own, which the band below visits as well.

Null and empty texts have fingerprint zero, linked like any other.  Texts of any
length are hashed whole.  Equal texts and repeated rows share a fingerprint and
so a component.  Null ids are kept and never name a component unless it has no
other.  Columns besides the id and the text are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.llm.common import free_name, join_skewed, mix64, ready_checkpoints, slices, span_hashes, table, utf8, window_hashes, word_spans
from tidegrove.llm.components import components

#: Fingerprints that a shard of the tree should hold, and rows that one task compares them with.
SHARD_POINTS, VISITORS = 32_000, 128_000
#: Levels of a tree grown from the sample, over all trees; larger shards are searched in blocks of points.  With twice
#: ``SAMPLED`` fingerprints for each of at most 2 ** (MOST_LEVELS + 1) shards it bounds what the driver reads.
MOST_LEVELS = 10
#: Sampled fingerprints for each shard.
SAMPLED = 64
#: Points of a local leaf, and distances counted at once.
LEAF, CHUNK = 256, 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def fingerprint(text: str, size: int = 4) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= size:
        return xxhash.xxh64_intdigest(flat, 42)
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends[:-size]]
    hashes = np.array([digest(flat[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :], strict=True)], "<u8")
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _written(fps: np.ndarray) -> pa.Array:
    """Fingerprints (rows of 64-bit words) as binary values, most significant byte first."""
    n, words = fps.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (8 * words)).astype(np.int32)), pa.py_buffer(fps.astype(">u8").tobytes())])


def _read(column) -> np.ndarray:
    """The fingerprints of a binary column without nulls, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column, n = column.cast(pa.binary()), len(column)
    if not n:
        return np.zeros((0, 1), np.uint64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].reshape(n, -1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp, band) per row; fp is the fingerprint as eight bytes, the band 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _written(found[:, None]), pa.array(np.zeros(len(found), np.int32))], names=["id", "fp", "band"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp binary, band int")


# --- wide fingerprints -----------------------------------------------------------------


def _totals(x: np.ndarray) -> list[np.ndarray]:
    """Of words x[i, ...], how many of the i have each bit: bit k of the counts in the k-th array.

    Three words of one weight are a sum of that weight and a carry of the next."""
    planes: list[np.ndarray] = []
    while len(x):
        carry = []
        while len(x) > 1:
            m = len(x) // 3
            if m:
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                both = a ^ b
                carry.append((a & b) | (c & both))
                x = np.concatenate([both ^ c, x[3 * m :]])
            else:
                carry.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
        planes.append(x[0])
        x = np.concatenate(carry) if carry else x[:0]
    return planes


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two such counts."""
    zero = np.zeros_like((a or b)[0])
    out, carry = [], zero
    for k in range(max(len(a), len(b)) + 1):
        x, y = (p[k] if k < len(p) else zero for p in (a, b))
        out.append(x ^ y ^ carry)
        carry = (x & y) | (carry & (x ^ y))
    return out


def _over_half(planes: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Bits whose count is over half of n (which follows the first axis)."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    half = n // 2
    over, equal = np.zeros_like(planes[0]), np.full_like(planes[0], full)
    for k in range(len(planes) - 1, -1, -1):
        bit = np.where(half >> k & 1, full, np.uint64(0))[:, None]
        over |= equal & planes[k] & ~bit
        equal &= ~(planes[k] ^ bit)
    return over


def wide_print(shingles: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of ``words`` * 64 bits of documents with ``n`` shingle hashes each, one after the other."""
    keys = mix64(np.arange(1, words + 1, dtype=np.uint64))
    out = np.zeros((len(n), words), np.uint64)
    lead = np.cumsum(n) - n
    # Documents of about the same number of shingles go together, padded with zeros.
    scale = np.int64(1) << np.maximum(0, np.frexp(n)[1] - 4)
    padded = np.where(n > 4096, 4096, -(-n // scale) * scale)
    for p in np.unique(padded[(n > 0) & (n <= 4096)]).tolist():
        mine = np.flatnonzero((padded == p) & (n <= 4096))
        step = max(1, (1 << 18) // (p * words))
        for i in range(0, len(mine), step):
            some = mine[i : i + step]
            at = np.arange(p)[:, None]
            real = at < n[some]
            h = shingles[np.where(real, at + lead[some], 0)]
            out[some] = _over_half(_totals(mix64(h[:, :, None] ^ keys) * real[:, :, None]), n[some])
    for j in np.flatnonzero(n > 4096).tolist():
        total: list[np.ndarray] = []
        for a in range(lead[j], lead[j] + n[j], 4096):
            h = shingles[a : min(a + 4096, lead[j] + n[j])]
            total = _added(total, _totals(mix64(h[:, None, None] ^ keys)))
        out[j] = _over_half(total, n[j : j + 1])[0]
    return out


def distinct_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 48-bit shingle hashes of each text, one text after the other, and their numbers.

    A text of fewer words has its whole sequence as a shingle, one of none has none."""
    raw, off = utf8(texts)
    starts, ends, first = word_spans(raw, off)
    words = span_hashes(_LOWER[raw], starts, ends)
    n = np.diff(first)
    many = np.maximum(n - size + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    h = window_hashes(words, size)[np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[:-1], many)] if len(text) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        text = np.concatenate([text, short])
        h = np.concatenate([h, [window_hashes(words[first[i] : first[i + 1]], int(n[i]))[0] ^ np.uint64(n[i] << 20) for i in short.tolist()]])
    key = np.sort((text.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key & np.uint64((1 << 48) - 1), np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(n))


def wide_fingerprints(docs: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text", size: int = 5, words: int = 16) -> DataFrame:
    """(id, fp, band) per row: fingerprint of ``words`` * 64 bits over the distinct shingles, band of their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, 1 << 15) for i in range(0, batch.num_rows, 1 << 15)):
                for part in slices(rows, "text"):
                    shingles, n = distinct_shingles(part.column("text"), size)
                    band = np.where(n > 0, np.floor(np.log(np.maximum(n, 1)) / -math.log(similarity) + 1e-9) + 1, 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("id"), _written(wide_print(shingles, n, words)), pa.array(band)], names=["id", "fp", "band"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp binary, band int")


def radius(similarity: float, bits: int, sigmas: float = 2.0) -> int:
    """Bits in which documents of a Jaccard similarity differ, on average and ``sigmas`` standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + sigmas * math.sqrt(bits * share * (1 - share)))


# --- trees -----------------------------------------------------------------------------


def _rows(fps: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return fps[:, None] if fps.ndim == 1 else fps


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int32)


def _vantage(points: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Of sixteen points the one whose distances spread most (its index), their median, the distances."""
    best = (-1.0, 0, np.zeros(0, np.int32))
    some = points[:: max(1, len(points) // 1024)]
    for i in range(0, len(points), max(1, len(points) // 16)):
        spread = float(np.var(_distance(some, points[i])))
        if spread > best[0]:
            best = (spread, i, best[2])
    d = _distance(points, points[best[1]])
    m = int(np.median(d))
    return best[1], m if (d > m).any() else m - 1, d


def grow(sample: np.ndarray, levels: int, first: int = 0):
    """A tree of (v, m, inside, outside); its leaves are numbered from ``first``."""
    sample = _rows(sample)
    if levels == 0 or len(sample) < 4:
        return first, first + 1
    v, m, d = _vantage(sample)
    if m < 0:
        return first, first + 1
    inside, first = grow(sample[d <= m], levels - 1, first)
    outside, first = grow(sample[d > m], levels - 1, first)
    return (sample[v], m, inside, outside), first


def place(tree, fps: np.ndarray, r: int, lives: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each visit: index into ``fps``, shard, and whether it is the fingerprint's own shard.

    Other shards are visited only if their number is higher: a pair meets in the later of its two.
    Without ``lives`` the fingerprints belong to another tree and visit all shards that they may."""
    fps = _rows(fps)
    rows, shards, homes = [], [], []
    todo = [(tree, np.arange(len(fps)), np.full(len(fps), lives))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            rows.append(at)
            shards.append(np.full(len(at), node, np.int32))
            homes.append(home)
            continue
        v, m, inside, outside = node
        d = _distance(fps[at], v)
        go_in, go_out = d <= m + r, d >= m + 1 - r
        todo.append((inside, at[go_in], home[go_in] & (d[go_in] <= m)))
        todo.append((outside, at[go_out], home[go_out] & (d[go_out] > m)))
    at, shard, home = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, int), (shards, np.int32), (homes, bool)))
    own = np.full(len(fps), -1, np.int32)
    own[at[home]] = shard[home]
    keep = home | (shard > own[at])
    return at[keep], shard[keep], home[keep]


class _Forest:
    """Union-find over 0 .. n-1; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link many pairs; those of an already known tree are seen off together."""
        while len(a):
            _, i = np.unique(a, return_index=True)
            _, j = np.unique(b, return_index=True)
            for k in np.union1d(i, j).tolist():
                x, y = self.find(int(a[k])), self.find(int(b[k]))
                if x != y:
                    self.up[max(x, y)] = min(x, y)
            ra, rb = self.roots(a), self.roots(b)
            more = ra != rb
            a, b = a[more], b[more]

    def roots(self, i: np.ndarray) -> np.ndarray:
        while True:
            j = self.up[i]
            if (j == i).all():
                return i
            i = j


def link_within(points: np.ndarray, fps: np.ndarray, r: int, ask: np.ndarray | None = None, sift: int | None = None) -> _Forest:
    """A forest over ``fps`` (distinct) whose components are those of the links within r between ``points`` and ``ask`` (indices; all).

    ``sift``: pairs that differ more than so in their first 64 bits are passed over."""
    fps = _rows(fps)
    lead = np.ascontiguousarray(fps[:, 0])
    forest = _Forest(len(fps))
    todo = [(points, np.arange(len(fps)) if ask is None else ask)]
    while todo:
        own, ask = todo.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) > LEAF:
            v, m, d = _vantage(fps[own])
            # All near the vantage point are one component with it, however many they are.
            near = own[d <= r]
            forest.link(near, np.full(len(near), own[v]))
            e = _distance(fps[ask], fps[own[v]])
            near = ask[e <= r]
            forest.link(near, np.full(len(near), own[v]))
            if (d <= m).any():
                for mine, theirs in ((d <= m, e <= m + r), (d > m, e >= m + 1 - r)):
                    todo.append((own[mine], ask[theirs]))
                continue
        roots = forest.roots(own)
        if (roots == roots[0]).all():
            ask = ask[forest.roots(ask) != roots[0]]
        step = max(1, CHUNK // len(own))
        theirs = lead[own]
        for i in range(0, len(ask), step):
            some = ask[i : i + step]
            x, y = np.nonzero(np.bitwise_count(lead[some][:, None] ^ theirs) <= (r if sift is None else sift))
            a, b = some[x], own[y]
            other = a != b
            if fps.shape[1] > 1 and other.any():
                other[other] = np.bitwise_count(fps[a[other]] ^ fps[b[other]]).sum(1, dtype=np.int32) <= r
            if other.any():
                forest.link(a[other], b[other])
    return forest


def _trees(prints: DataFrame) -> dict[int, tuple]:
    """A tree for each band, grown from a sample whose size is bounded by ``MOST_LEVELS``."""
    counts = {x.band: x["count"] for x in prints.groupBy("band").count().collect()}
    n = sum(counts.values())
    most = max(SHARD_POINTS, n >> MOST_LEVELS)
    levels = {b: max(0, math.ceil(math.log2(c / most))) for b, c in counts.items()}
    wanted = sum(SAMPLED << v for v in levels.values() if v)
    # Twice as many as wanted pass the hash, so a band is rarely short of them.
    share = min(1.0, 2 * wanted / max(1, n))
    sample = prints.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("band", "fp").collect() if wanted else []
    of: dict[int, list[bytes]] = {}
    for x in sorted(sample, key=lambda x: bytes(x.fp)):
        of.setdefault(x.band, []).append(bytes(x.fp))
    return {b: grow(_read(pa.array(of.get(b, []), pa.binary())), v)[0] if v else 0 for b, v in levels.items()}


def near_links(prints: DataFrame, r: int = 4, sift: int | None = None) -> DataFrame:
    """Edges (a, b) between the nodes of distinct fingerprints (columns node, fp, band; no repeats) whose components are
    those of all links within ``r`` bits in a band and between neighbouring ones: the union of the shards' spanning forests."""
    kind = dict(prints.dtypes)["node"]
    trees = _trees(prints)

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                fps, bands = _read(part.column(1)), part.column(2).to_numpy()
                for band in np.unique(bands).tolist():
                    mine = np.flatnonzero(bands == band)
                    for tree in (band, band + 1):
                        if tree in trees:
                            at, shard, home = place(trees[tree], fps[mine], r, tree == band)
                            rows = part.take(pa.array(mine[at]))
                            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(len(at), tree, np.int32)), pa.array(shard), pa.array(home)], names=["node", "fp", "tree", "shard", "home"])

    def search(data: pa.Table) -> pa.Table:
        fps = _read(data.column("fp"))
        own, ask = (np.flatnonzero(data.column(c).to_numpy(zero_copy_only=False)) for c in ("own", "ask"))
        roots = link_within(own, fps, r, ask, sift).roots(np.arange(len(fps)))
        moved = np.flatnonzero(roots != np.arange(len(fps)))
        return pa.table({"a": data.column("node").take(pa.array(moved)), "b": data.column("node").take(pa.array(roots[moved]))})

    placed = prints.select("node", "fp", "band").mapInArrow(visits, f"node {kind}, fp binary, tree int, shard int, home boolean")
    # Larger shards are searched as a grid: blocks of their points, by blocks of all that is compared with them.
    sizes = placed.groupBy("tree", "shard").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count("*").alias("all")).collect()
    split = [(x.tree, x.shard, -(-x.homes // (2 * SHARD_POINTS)), -(-x["all"] // VISITORS)) for x in sizes if x.homes]
    # At most twice 2 ** MOST_LEVELS and the number of bands.
    grid = prints.sparkSession.createDataFrame(split, "tree int, shard int, points int, visitors int")
    mine = F.pmod(F.xxhash64("fp"), F.col("points")).cast("int")
    asks = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("visitors")).cast("int")
    # A row asks in all cells of its column and, if at home, is asked in all cells of its row.
    cell = lambda point, visitor, own, ask: F.struct(point.alias("point"), visitor.alias("visitor"), own.alias("own"), ask.alias("ask"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    column = F.transform(every("points"), lambda i: cell(i, asks, F.col("home") & (i == mine), F.lit(True)))
    row = F.transform(F.filter(every("visitors"), lambda j: F.col("home") & (j != asks)), lambda j: cell(mine, j, F.lit(True), F.lit(False)))
    dealt = placed.join(F.broadcast(grid), ["tree", "shard"]).select("node", "fp", "tree", "shard", F.explode(F.concat(column, row)).alias("cell")).select("node", "fp", "tree", "shard", "cell.*")
    return dealt.groupBy("tree", "shard", "point", "visitor").applyInArrow(search, f"a {kind}, b {kind}")


def _components(every: DataFrame, r: int, sift: int | None = None) -> DataFrame:
    """``every`` (id, fp, band) with the least id of the component; equal fingerprints and bands are linked."""
    ready_checkpoints(every.sparkSession)
    every = every.checkpoint()
    # A node is named by its least id, nulls last, so a component's least node has its least id.
    least = F.min("id")
    prints = every.groupBy("fp", "band").agg(least.alias("least"), F.count("*").alias("copies"))
    prints = prints.select(F.struct(F.col("least").isNull().alias("none"), "least", "fp", "band").alias("node"), "fp", "band", "copies").checkpoint()
    roots = components(near_links(prints, r, sift)).select(F.col("a.fp").alias("fp"), F.col("a.band").alias("band"), F.col("root.least").alias("moved"), F.lit(True).alias("has"))
    named = prints.select("fp", "band", "copies", F.col("node.least").alias("least")).join(roots, ["fp", "band"], "left")
    named = named.select("fp", "band", "copies", F.when(F.col("has"), F.col("moved")).otherwise(F.col("least")).alias("component_id"))
    return join_skewed(every, named, ["fp", "band"], "copies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, r: int = 4) -> DataFrame:
    """Per row: the id, the fingerprint (hex), the least id of the component of links within ``r`` bits."""
    found = _components(fingerprints(docs, id_col, text_col, size), r)
    return found.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, size: int = 5, words: int = 16) -> DataFrame:
    """Per row: the id and the least id of the component of documents whose word shingles are alike.

    Documents are linked if their wide fingerprints differ in so few bits as those of a Jaccard ``similarity`` do
    (two standard deviations more, so that nearly all pairs of it are found; some of a little less are as well)."""
    bits = 64 * words
    r = radius(similarity, bits)
    share = r / bits
    sift = int(64 * share + 3.5 * math.sqrt(64 * share * (1 - share)))
    found = _components(wide_fingerprints(docs, similarity, id_col, text_col, size, words), r, sift if words > 1 else None)
    return found.select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, r: int = 4, similarity: float | None = None) -> DataFrame:
    """Of each component the row of least id (and of them that of least hash of the text, if the id repeats).

    Components are those of ``near_duplicates`` or, with a ``similarity``, of ``similar_documents``.
    Rows are told apart by id and text; those with a null id come after all others; of rows alike in both any one stays."""
    key, many = free_name(docs, "key"), free_name(docs, "many")
    # Beyond any id below 2**62; equal texts are near-duplicates anyway.
    stand_in = F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 2).bitwiseOR(F.lit(1 << 62))
    first_id = F.coalesce(F.col(id_col).cast("long"), stand_in).alias("id")
    keyed = docs.withColumn(key, F.struct(first_id, F.xxhash64(F.col(text_col)).alias("text")))
    found = near_duplicates(keyed, key, text_col, size, r) if similarity is None else similar_documents(keyed, key, text_col, similarity, size)
    stay = found.where(F.col(key) == F.col("component_id")).groupBy(key).agg((F.count("*") > 1).alias(many))
    some = stay.where(F.col(many)).limit(1).count()
    kept = keyed.join(stay, key)
    if some:
        kept = kept.where(~F.col(many)).union(kept.where(F.col(many)).dropDuplicates([key]))
    return kept.select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

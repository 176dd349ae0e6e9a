"""Exact substring dedup with fixed-block anchors.

A window is ``window`` consecutive words.  Each document is also cut into
non-overlapping blocks of half a window; any window holds at least one whole
block of its document.  So a window that starts in two documents shows up as a
block of the one that equals some run of words of the other:

1. every run of half a window, at every place (the probes; those at block places
   are the index), goes to a bucket of its hash, and buckets report probes that
   meet a block of an earlier document, and blocks met by a later one;
2. hits are extended: the windows around them, and no others, are hashed whole
   (96 bits) and compared, the least document of each window being found;
3. windows that an earlier document has are merged to maximal repeats, whose
   words are removed.

Hashes travel in packed arrays, a few bytes each: a row per bucket and some
megabytes of text.  Buckets and groups of documents grow in number with the
input, not in size.  Of a run that many documents of one task share, what those
documents say of each other is settled there: only the least of its blocks, the
greatest of its probes and what no block of the task precedes go to the bucket.

Null and empty texts have no words.  A document shorter than a window loses
nothing.  Rows that share an id do not count as earlier than each other, nor do
null ids, which lose nothing.  Repeated windows inside one document stay.
Columns besides the id and the text are ignored, whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.llm.common import mix64, slices, span_hashes, table, utf8, window_hashes, word_spans

#: Text bytes packed into one row per bucket, per bucket, and per group of documents.
PACKED_BYTES, BUCKET_BYTES, GROUP_BYTES = 8 << 20, 9 << 20, 6 << 20

#: The five primes of XXH64.
_XX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)

_PACKED = "bucket int, docs binary, counts binary, places binary, hashes binary"


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def pack(bucket: np.ndarray, docs: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket; entries must come in the order of documents and places."""
    small = bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket
    order = np.argsort(small, kind="stable")
    bucket, docs, places, hashes = bucket[order], docs[order], places[order], hashes[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    rows: list[list] = [[], [], [], [], []]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        d = docs[a:b]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        rows[0].append(int(bucket[a]))
        rows[1].append(_squeeze(np.r_[d[first[:1]], np.diff(d[first]), len(first)]))
        rows[2].append(_squeeze(np.diff(np.r_[first, b - a]).astype(np.uint32)))
        rows[3].append(_squeeze(_steps(places[a:b].astype(np.int32))))
        rows[4].append(hashes[a:b].tobytes())
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["bucket", "docs", "counts", "places", "hashes"])


def unpack(data: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of packed rows: documents, places, hashes."""

    def loosen(raw: bytes, dtype, n: int) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)

    docs, places, hashes = [], [], []
    for row in data.select(["docs", "counts", "places", "hashes", "n", "runs"]).to_pylist():
        d = loosen(row["docs"], np.int64, row["runs"] + 1)[:-1]
        docs.append(np.repeat(np.cumsum(d), loosen(row["counts"], np.uint32, row["runs"])))
        places.append(np.cumsum(loosen(row["places"], np.int32, row["n"]), dtype=np.int32))
        hashes.append(np.frombuffer(row["hashes"], kind))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, kind)
    return np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)


_LONG = np.dtype([("a", "<u8"), ("b", "<u4")])


class Packer:
    """Gathers entries of several slices of text and packs them when they are many."""

    def __init__(self, buckets: int, kind: np.dtype):
        self.buckets, self.kind, self.parts, self.bytes = buckets, kind, [], 0

    def add(self, size: int, spread: np.ndarray, docs: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(((spread % np.uint64(self.buckets)).astype(np.int32), docs, places.astype(np.int32), hashes))
        self.bytes += size
        if self.bytes >= PACKED_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            cols = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.bytes = [], 0
            yield sized(pack(*self.thin(*cols)), self.kind)

    def thin(self, *cols: np.ndarray) -> tuple[np.ndarray, ...]:
        return cols


#: Entries of one run in a packed row from which they are settled among themselves.
SHARED = 16


class _Probes(Packer):
    """Packs probes; hits that the task can tell by itself go straight to their groups, as buckets beyond the others."""

    def __init__(self, buckets: int, block: int, groups: int):
        super().__init__(buckets, np.dtype("<u4"))
        self.block, self.groups = block, groups

    def thin(self, bucket: np.ndarray, docs: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        # Counted in slots first, so that only what may be frequent is sorted.
        slot = hashes >> np.uint32(12)
        may = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= SHARED)[slot])
        key = (bucket[may].astype(np.uint64) << np.uint64(32)) | hashes[may]
        order = np.argsort(key)
        some, order = key[order], may[order]
        lead = np.flatnonzero(np.r_[True, some[1:] != some[:-1]]) if len(some) else np.zeros(0, np.int64)
        many = np.diff(np.r_[lead, len(some)])
        hot = many >= SHARED
        if not hot.any():
            return bucket, docs, places, hashes
        at = order[np.repeat(hot, many)]
        lead = np.cumsum(many[hot]) - many[hot]
        run = np.repeat(np.arange(len(lead)), many[hot])
        d, block = docs[at], places[at] % self.block == 0
        none = np.iinfo(np.int64)
        least = np.minimum.reduceat(np.where(block, d, none.max), lead)[run]
        most = np.maximum.reduceat(d, lead)[run]
        hit = (d > least) | (block & (d < most))
        # All of the least document's blocks and of the greatest one's probes: few, and which of them doesn't matter.
        told = hit & ~(block & (d == least)) & (d != most)
        bucket, docs, places = bucket.copy(), docs, places
        bucket[at[told]] = self.buckets + group_of(d[told], self.groups)
        return bucket, docs, places, hashes


def sized(rows: pa.RecordBatch, kind: np.dtype) -> pa.RecordBatch:
    """With the numbers of entries and of runs, which decompression needs."""
    n = [len(x) // kind.itemsize for x in rows.column("hashes").to_pylist()]
    runs = [int(np.frombuffer(pa.decompress(x, _plain_size(x), codec="zstd", asbytes=True), np.int64)[-1]) for x in rows.column("docs").to_pylist()]
    return rows.append_column("n", pa.array(n, pa.int32())).append_column("runs", pa.array(runs, pa.int32()))


def _plain_size(frame: bytes) -> int:
    import zstandard

    return zstandard.frame_content_size(frame)


PACKED = _PACKED + ", n int, runs int"


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    raw, off = utf8(texts)
    starts, ends, first = word_spans(raw, off)
    return span_hashes(raw, starts, ends), first, len(raw)


def probes(block: int, window: int, buckets: int, groups: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map (id, text) batches to packed hashes of every run of ``block`` words of the documents that have a window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Probes(buckets, block, groups)
        for batch in batches:
            for part in slices(batch, "text"):
                words, first, size = _word_hashes(part.column("text"))
                n = np.diff(first)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                long = np.flatnonzero(n >= window)
                if not len(long):
                    continue
                h = window_hashes(words, block)
                many = n[long] - block + 1
                lead = np.cumsum(many) - many
                places = np.arange(int(many.sum())) - np.repeat(lead, many)
                h = h[places + np.repeat(first[long], many)]
                yield from packer.add(size, h >> np.uint64(32), np.repeat(ids[long], many), places, h.astype(np.uint32))
        yield from packer.flush()

    return run


def meet(block: int, buckets: int, groups: int) -> Callable[[pa.Table], pa.Table]:
    """In a bucket: probes that meet a block of an earlier document, and blocks that a later one's probe meets."""

    def run(data: pa.Table) -> pa.Table:
        docs, places, h = unpack(data, np.dtype("<u4"))
        if data.num_rows and data.column("bucket")[0].as_py() >= buckets:
            # Known hits of one group.
            return _by_group(docs, places, groups)
        at = np.flatnonzero(places % block == 0)
        at = at[np.lexsort((docs[at], h[at]))]
        keys, lead = np.unique(h[at], return_index=True)
        least = docs[at[lead]]
        slot = np.searchsorted(keys, h)
        slot[slot == len(keys)] = 0
        met = np.flatnonzero(keys[slot] == h) if len(keys) else np.zeros(0, np.int64)
        slot = slot[met]
        most = np.full(len(keys), np.iinfo(np.int64).min)
        np.maximum.at(most, slot, docs[met])
        hit = (docs[met] > least[slot]) | ((places[met] % block == 0) & (docs[met] < most[slot]))
        return _by_group(docs[met[hit]], places[met[hit]], groups)

    return run


def _by_group(docs: np.ndarray, places: np.ndarray, groups: int) -> pa.Table:
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    rows = pack(group_of(docs, groups), docs, places, np.zeros(len(docs), "<u1"))
    return pa.Table.from_batches([sized(rows, np.dtype("<u1"))])


def group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    """``pmod(xxhash64(id), groups)`` as Spark computes it for a long."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in _XX)

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    h = turn(docs.astype(np.int64).view(np.uint64) * p2, 31) * p1 ^ (p5 + np.uint64(42 + 8))
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return ((h ^ (h >> np.uint64(32))).view(np.int64) % groups).astype(np.int32)


def _places_of(data: pa.Table) -> dict[int, np.ndarray]:
    docs, places, _ = unpack(data, np.dtype("<u1"))
    order = np.argsort(docs, kind="stable")
    docs, places = docs[order], places[order]
    edges = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True]) if len(docs) else np.zeros(1, int)
    return {int(docs[a]): places[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)}


def extend(block: int, window: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """In a group of documents: packed hashes of the windows that hold a hit."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        found = _places_of(hits)
        packer, out = Packer(buckets, _LONG), []
        docs = docs.filter(pa.array([x is not None and x in found for x in docs.column("id").to_pylist()], pa.bool_()))
        for batch in docs.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                words, first, size = _word_hashes(part.column("text"))
                a, b = window_hashes(words, window), window_hashes(mix64(words ^ np.uint64(0x5BF03635)), window)
                ids, picks = part.column("id").to_pylist(), []
                for i, doc in enumerate(ids):
                    n = int(first[i + 1] - first[i]) - window + 1
                    if n <= 0:
                        continue
                    edge = np.zeros(n + window + 1, np.int32)
                    hit = found[doc][found[doc] < n + window]
                    np.add.at(edge, np.maximum(hit - (window - block), 0), 1)
                    np.add.at(edge, hit + 1, -1)
                    picks.append(np.flatnonzero(np.cumsum(edge[:n]) > 0) + first[i])
                if not picks:
                    continue
                at = np.concatenate(picks)
                which = np.searchsorted(first, at, "right") - 1
                h = np.empty(len(at), _LONG)
                h["a"], h["b"] = a[at], b[at].astype(np.uint32)
                out += packer.add(size, b[at] >> np.uint64(32), np.array(ids, np.int64)[which], at - first[which], h)
        out += packer.flush()
        return pa.Table.from_batches(out, _arrow_packed())

    return run


def _arrow_packed() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("docs", "counts", "places", "hashes")), ("n", pa.int32()), ("runs", pa.int32())])


def repeats(groups: int) -> Callable[[pa.Table], pa.Table]:
    """In a bucket: the windows that an earlier document has."""

    def run(data: pa.Table) -> pa.Table:
        docs, places, h = unpack(data, _LONG)
        order = np.lexsort((docs, h["b"], h["a"]))
        docs, places, h = docs[order], places[order], h[order]
        lead = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
        least = np.repeat(docs[lead], np.diff(np.r_[lead, len(docs)]))
        late = docs > least
        return _by_group(docs[late], places[late], groups)

    return run


def cover(places: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words some window covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _rest(window: int, texts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """In a group of documents: what is left of each."""

    def run(docs: pa.Table, late: pa.Table) -> pa.Table:
        found = _places_of(late)
        rows: list[list] = [[], [], [], []]
        for doc, text in zip(docs.column("id"), docs.column("text"), strict=True):
            words = (text.as_py() or "").encode().split()
            gone = 0
            if (places := found.get(doc.as_py())) is not None and len(words) >= window:
                # Ids may repeat, so places may be another row's: none counts beyond this row's windows.
                covered = cover(places[places <= len(words) - window], window, len(words))
                gone = int(covered.sum())
                kept = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])
            else:
                kept = b" ".join(words)
            for x, y in zip(rows, (len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None), strict=True):
                x.append(y)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = [docs.column("id"), *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))]
        names = ["id", "n_words", "n_removed", "kept_sha256", "kept"]
        return pa.table(cols[: 5 if texts else 4], names=names[: 5 if texts else 4])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per row: the id (long), n_words, n_removed, kept_sha256, and the kept words joined by spaces if ``texts``.

    ``window`` must be even.  The documents cross the network once, to groups of
    some megabytes that both later steps read; hashes cross it packed."""
    if window % 2:
        raise ValueError("the window must be an even number of words")
    block = window // 2
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, groups = 1 + total // BUCKET_BYTES, 1 + total // GROUP_BYTES

    known = rows.where("id IS NOT NULL")
    hits = known.mapInArrow(probes(block, window, buckets, groups), PACKED).groupBy("bucket").applyInArrow(meet(block, buckets, groups), PACKED)

    grouped = rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(groups)).cast("int"))

    def beside(other: DataFrame):
        return grouped.groupBy("bucket").cogroup(other.groupBy("bucket"))

    windows = beside(hits).applyInArrow(extend(block, window, buckets), PACKED)
    late = windows.groupBy("bucket").applyInArrow(repeats(groups), PACKED)
    out = beside(late).applyInArrow(_rest(window, texts), "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
    return out.withColumnRenamed("id", id_col)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)

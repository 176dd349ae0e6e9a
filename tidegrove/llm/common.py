"""Shared helpers: reading tables, checkpoints, and vectorised text hashing.

Text columns reach Python as Arrow string arrays.  The helpers below look at
the UTF-8 buffer of such an array directly, so that cutting words and hashing
them costs a few numpy passes and no Python object per word.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Text bytes handled at once; bounds the numpy temporaries of one task.
SLICE_BYTES = 1 << 19

_C = np.uint64(0x9E3779B97F4A7C15)
_C_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's folder, or one of our own if it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tidegrove-checkpoints"))


#: Keys of more than this share of all rows are joined by broadcast: it bounds their number.
HOT_SHARE = 10_000
#: Rows up to which the whole of their names is broadcast.
FEW_ROWS = 100_000


def join_skewed(rows: DataFrame, names: DataFrame, keys: list[str], copies: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``names``, which has each key once and, in ``copies``, its number of rows.

    There are no more names than rows, so few rows' names are broadcast.  Else keys of one in ``HOT_SHARE`` rows or more, of which there are ``HOT_SHARE`` at most, are broadcast, so that none of
    them is one task; the others are joined by a shuffle.  ``total``: the number of rows or a bound on it, if known."""
    if total is None:
        total = names.agg(F.sum(copies)).first()[0] or 0
    if total <= FEW_ROWS:
        return rows.join(F.broadcast(names.drop(copies)), keys)
    hot = names.where(F.col(copies) * HOT_SHARE >= total).drop(copies)
    rare = names.where(F.col(copies) * HOT_SHARE < total).drop(copies)
    left = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).union(left.join(rare, keys))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_numbers = np.zeros(0, np.uint64)
_powers = np.zeros((2, 0), np.uint64)


def _factors(n: int) -> np.ndarray:
    """A fixed pseudo-random odd number for each eight bytes of a word."""
    global _numbers
    if len(_numbers) < n:
        _numbers = mix64(np.arange(1, max(256, 2 * n) + 1, dtype=np.uint64) * _C) | np.uint64(1)
    return _numbers[:n]


def _word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant modulo 2**64, and those of its inverse."""
    global _powers
    if _powers.shape[1] < n:
        m = max(4096, 2 * n)
        rows = []
        for base in (_C, _C_INV):
            row = np.full(m, base, np.uint64)
            row[0] = 1
            rows.append(np.multiply.accumulate(row))
        _powers = np.stack(rows)
    return _powers[0, :n], _powers[1, :n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``size`` text bytes (a row is never cut)."""
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each of n texts the offset of its first word (n + 1 numbers)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    solid = ~_WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


#: Bytes up to which words are hashed together, eight bytes at a time.
_LONG_WORD = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that ``word_spans`` found in ``raw`` (or a copy without capitals)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    # The eight bytes from every place on.
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    factors = _factors(_LONG_WORD // 8)
    total = (eight[starts] & _MASKS[np.minimum(lens, 8)]) * factors[0]
    more, k = np.flatnonzero((lens > 8) & (lens <= _LONG_WORD)), 1
    while len(more):
        left = lens[more] - 8 * k
        total[more] += (eight[starts[more] + 8 * k] & _MASKS[np.minimum(left, 8)]) * factors[k]
        more, k = more[left > 8], k + 1
    for i in np.flatnonzero(lens > _LONG_WORD).tolist():
        words = np.zeros(-(-int(lens[i]) // 8) * 8, np.uint8)
        words[: lens[i]] = raw[starts[i] : ends[i]]
        words = words.view("<u8")
        total[i] = (words * _factors(len(words))).sum(dtype=np.uint64)
    return mix64(total ^ (lens.astype(np.uint64) << np.uint64(48)))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive word hashes (len(words) - k + 1 of them, none if too few)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _word_powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mix64((total[k:] - total[:-k]) * down[: n - k + 1])

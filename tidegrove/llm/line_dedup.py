"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased).  It is removed if an earlier
line (by document id, then place) has a Jaccard similarity of ``similarity`` or
more with it; both are judged on the input.  Lines without words are kept.

Words are ordered by rarity, from counts over all documents held in a table of
fixed size (words that share a slot share its count: any order gives the same
result, a good one short lists).  Two lines that are similar enough share one of
their first, rarest words, and there:

* lines of the same set are seen at once, those of one task before anything is
  sent, and only the first of them goes on;
* others are candidates if length, position and a 128-bit bitmap of their sets
  allow the overlap needed; a line proposes the ``tries`` most promising earlier
  one or ones, which are verified on the word sets themselves;
* in the list of a word that many lines share, lines are compared by classes of
  length and position, so that those which cannot match never meet, and a line
  stops at the first run of earlier lines that holds a candidate;
* a line with more candidates, none of those proposed being similar enough, is
  looked up again with all of them.

So a group of m similar lines costs a few verifications a line, not m * m, and
no candidate is lost; no more pairs than a fixed number are held at once.  Word
sets are of 48-bit hashes or longer ones.

Null and empty texts have no lines to remove.  Of rows that share an id a line is
earlier than those of later places, in either row; lines of one place are not
earlier than each other.  Rows with a null id lose nothing and count for nothing.  Columns
besides the id and the text are ignored, whatever their names.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.llm.common import SLICE_BYTES, mix64, slices, span_hashes, table, utf8, word_spans
from tidegrove.llm.substring_dedup import PACKED, Packer, group_of, unpack

#: Slots of the table of word counts.
SLOTS = 1 << 20
#: Chunks in which tables of counts are added up.
CHUNKS = 64
#: Text bytes per bucket of prefixes, and per group of documents.
BUCKET_BYTES, GROUP_BYTES = 9 << 20, 6 << 20
#: Postings of at most this many sets are compared together, longer ones one by one, those of more than ``LARGE`` by classes.
SMALL, LARGE = 48, 1024
#: Pairs compared at once, and earlier lines of a large posting that a line is compared with first.
PAIRS, FIRST_RUN = 1 << 20, 64
#: Sets of lines that a task remembers, to see repeats off.
REMEMBERED = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: A line's entry at one word of its prefix: the word, the size of the set, the word's place, both halves of the bitmap, the set.
#: Larger sizes stand as ``HUGE`` and pass every filter; later places stand as 255, which only weakens one.
ENTRY = np.dtype([("word", "<u4"), ("n", "<u2"), ("at", "u1"), ("bits", "<u8"), ("more", "<u8"), ("set", "<u4")])
HUGE = 65_535


@dataclass(frozen=True)
class LineConfig:
    similarity: Fraction = Fraction(4, 5)
    tries: int = 1

    def need(self, total: np.ndarray) -> np.ndarray:
        """Least overlap of two sets of ``total`` words together."""
        a, b = self.similarity.numerator, self.similarity.numerator + self.similarity.denominator
        return -(-(total * a) // b)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Words of a set of n that must hold one shared with any similar set."""
        return n - -(-(n * self.similarity.numerator) // self.similarity.denominator) + 1


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of all words: hash, line; of each text the number of its first line (n + 1 numbers); bytes."""
    raw, off = utf8(texts)
    starts, ends, _ = word_spans(raw, off)
    breaks = np.flatnonzero(raw == 10) + 1
    first = np.arange(len(off)) + np.searchsorted(breaks, off, "right")
    # A line starts at each text and after each break; at one place the text that starts there comes last.
    heads = np.empty(len(off) - 1 + len(breaks), np.int64)
    opens = np.zeros(len(heads), bool)
    opens[first[:-1]] = True
    heads[opens], heads[~opens] = off[:-1], breaks
    line = np.searchsorted(heads, starts, "right") - 1
    return span_hashes(_LOWER[raw], starts, ends), line, first, len(raw)


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's table of counts, in chunks."""
    counts, size = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for part in slices(batch, "text"):
            raw, off = utf8(part.column("text"))
            starts, ends, _ = word_spans(raw, off)
            counts += np.bincount((span_hashes(_LOWER[raw], starts, ends) >> np.uint64(44)).astype(np.int32), minlength=SLOTS)
            size += len(raw)
    if size:
        rows = [pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in counts.reshape(CHUNKS, -1)]
        sizes = [size, *[0] * (CHUNKS - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(rows, pa.binary()), pa.array(sizes, pa.int64())], names=["chunk", "counts", "size"])


def _add_counts(data: pa.Table) -> pa.Table:
    size = SLOTS // CHUNKS * 8
    total = sum(np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), np.int64) for x in data.column("counts").to_pylist())
    return pa.table({"chunk": data.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary()), "size": pa.array([pa.compute.sum(data.column("size")).as_py()], pa.int64())})


def rarity(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A level of frequency from 0 to 255 for each slot (a megabyte, whatever the input), and the bytes of all texts."""
    schema = "chunk int, counts binary, size long"
    chunks = rows.select("text").mapInArrow(count_words, schema).groupBy("chunk").applyInArrow(_add_counts, schema).collect()
    if not chunks:
        return np.zeros(SLOTS, np.uint8), 0
    counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(chunks, key=lambda r: r.chunk)])
    return np.minimum(255, np.log2(1 + counts) * 5).astype(np.uint8), sum(r["size"] for r in chunks)


def _by_line(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The order by line, then key.  Lines ascend already, so one sort of line and leading bits of the key will
    nearly always do."""
    room = int(line[-1]).bit_length() if len(line) else 0
    if room <= 24:
        both = (line.astype(np.uint64) << np.uint64(64 - room) if room else np.uint64(0)) | (key >> np.uint64(room))
        order = np.argsort(both)
        both, some = both[order], key[order]
        if not ((both[1:] == both[:-1]) & (some[1:] != some[:-1])).any():
            return order
    return np.lexsort((key, line))


class LineSets:
    """The distinct words of all lines of some texts, rarest first; empty lines are left out."""

    def __init__(self, texts: pa.Array, levels: np.ndarray):
        h, line, self.first, self.bytes = _words(texts)
        key = (levels[(h >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
        order = _by_line(key, line)
        key, line = key[order], line[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        self.key, line = key[new], line[new]
        self.lead = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        self.line = line[self.lead]
        self.n = np.diff(np.r_[self.lead, len(line)])
        mixed = mix64(self.key)
        self.sum = np.add.reduceat(mixed, self.lead) if len(line) else np.zeros(0, np.uint64)
        self.set = (self.sum >> np.uint64(7)).astype(np.uint32)
        # Each word flips one of 128 bits, so the bits in which two sets differ are at most the words they don't share.
        bit = np.uint64(1) << ((mixed >> np.uint64(58)) & np.uint64(63))
        half = (mixed >> np.uint64(57)) & np.uint64(1)
        self.bits, self.more = (np.bitwise_xor.reduceat(bit * x, self.lead) if len(line) else np.zeros(0, np.uint64) for x in (half, np.uint64(1) - half))
        self.doc = np.searchsorted(self.first, self.line, "right") - 1
        self.place = self.line - self.first[self.doc]

    def words(self, i: int) -> np.ndarray:
        return self.key[self.lead[i] : self.lead[i] + self.n[i]]


def _spread(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What decides a word's bucket, and what stands for it there."""
    mixed = mix64(key ^ np.uint64(0x51ED270B))
    return mixed >> np.uint64(32), mixed.astype(np.uint32)


class _Seen:
    """A task's lines by their sets: which of new ones repeat an earlier line."""

    def __init__(self) -> None:
        self.first: dict[int, tuple[int, int]] = {}

    def repeats(self, sums: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        if len(self.first) > REMEMBERED:
            self.first.clear()
        order = np.lexsort((places, docs, sums))
        out = np.zeros(len(sums), bool)
        get = self.first.get
        for i, key, line in zip(order.tolist(), sums[order].tolist(), zip(docs[order].tolist(), places[order].tolist(), strict=True), strict=True):
            known = get(key)
            if known is None or line < known:
                self.first[key] = line
            else:
                out[i] = line != known
        return out


def prefixes(levels: np.ndarray, buckets: int, cfg: LineConfig) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed entries of all lines; a line that repeats one of the same task has a single entry, of size 0, anywhere."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(buckets, ENTRY), _Seen()
        for batch in batches:
            for part in slices(batch, "text"):
                s = LineSets(part.column("text"), levels)
                docs = part.column("id").to_numpy(zero_copy_only=False)[s.doc]
                again = seen.repeats(s.sum, docs, s.place)
                many = np.where(again, 1, cfg.prefix(s.n))
                who = np.repeat(np.arange(len(s.n)), many)
                at = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                spread, word = _spread(s.key[s.lead[who] + at])
                spread = np.where(again[who], mix64(docs[who].astype(np.int64).view(np.uint64)), spread)
                e = np.empty(len(who), ENTRY)
                e["word"], e["n"], e["at"], e["bits"], e["more"], e["set"] = word, np.where(again[who], 0, np.minimum(s.n[who], HUGE)), np.minimum(at, 255), s.bits[who], s.more[who], s.set[who]
                yield from packer.add(s.bytes, spread, docs[who], s.place[who], e)
        yield from packer.flush()

    return run


_PAIR_NAMES = ("xd", "xl", "xs", "yd", "yl", "ys", "more")
#: A pair goes to the group of its later line (``bucket``).  Beside it goes, once for each earlier line and group, an ask
#: (no later line) to the earlier line's group, with the group that wants the words (``to``).
_PAIR = "bucket int, xd long, xl int, xs long, yd long, yl int, ys long, more boolean, to int"


def _in_order(key: np.ndarray, docs: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The order by key, document and line; only runs of equal keys are sorted by the latter two."""
    order = np.argsort(key)
    some = key[order]
    run = np.zeros(len(key), bool)
    run[1:] = some[1:] == some[:-1]
    run[:-1] |= run[1:]
    at = np.flatnonzero(run)
    mine = order[at]
    order[at] = mine[np.lexsort((lines[mine], docs[mine], key[mine]))]
    return order


_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Classes:
    """The entries of a bucket, one for each distinct (word, set): its first line."""

    def __init__(self, data: pa.Table):
        docs, lines, e = unpack(data, ENTRY)
        known = e["n"] == 0
        repeats = [(docs[known], lines[known], e["set"][known])]
        docs, lines, e = docs[~known], lines[~known], e[~known]
        # Other sets of the same word and set number may stand between equal ones: these then count as two.
        order = _in_order((e["word"].astype(np.uint64) << np.uint64(32)) | e["set"], docs, lines)
        docs, lines, e = docs[order], lines[order], e[order]
        same = np.zeros(len(e), bool)
        same[1:] = (e["word"][1:] == e["word"][:-1]) & (e["n"][1:] == e["n"][:-1]) & (e["bits"][1:] == e["bits"][:-1]) & (e["more"][1:] == e["more"][:-1]) & (e["set"][1:] == e["set"][:-1])
        lead = np.flatnonzero(~same)
        rep = np.repeat(lead, np.diff(np.r_[lead, len(e)]))
        later = same & (e["at"] == 0) & ((docs != docs[rep]) | (lines != lines[rep]))
        repeats.append((docs[later], lines[later], e["set"][later]))
        self.repeats = tuple(np.concatenate(x) for x in zip(*repeats, strict=True))
        order = lead[_in_order(e["word"][lead], docs[lead], lines[lead])]
        self.docs, self.lines, self.e = docs[order], lines[order], e[order]
        self.n, self.at, self.bits, self.more = self.e["n"].astype(np.int32), self.e["at"].astype(np.int32), self.e["bits"].copy(), self.e["more"].copy()
        cuts = np.r_[True, self.e["word"][1:] != self.e["word"][:-1]] if len(order) else np.zeros(0, bool)
        self.post = np.flatnonzero(cuts)
        self.size = np.diff(np.r_[self.post, len(order)])

    def pairs(self, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices (later, earlier) of lines that share a posting that isn't large, in pieces; ``only``: which may be the later."""
        small = (self.size > 1) & (self.size <= SMALL)
        base, size = self.post[small], self.size[small]
        step = max(1, PAIRS // (SMALL * SMALL))
        for i in range(0, len(base), step):
            b, s = base[i : i + step], size[i : i + step]
            each = np.repeat(np.arange(len(b)), s)
            x = np.arange(len(each)) - np.repeat(np.cumsum(s) - s, s) + b[each]
            before = x - b[each]
            if only is not None:
                before = np.where(only[x], before, 0)
            y = np.arange(int(before.sum())) - np.repeat(np.cumsum(before) - before, before) + np.repeat(b[each], before)
            yield np.repeat(x, before), y
        middle = (self.size > SMALL) & (self.size <= LARGE)
        for b, s in zip(self.post[middle].tolist(), self.size[middle].tolist(), strict=True):
            rows = np.arange(b + 1, b + s)
            if only is not None:
                rows = rows[only[rows]]
            wide = max(1, PAIRS // s)
            for i in range(0, len(rows), wide):
                some = rows[i : i + wide]
                before = some - b
                yield np.repeat(some, before), np.arange(int(before.sum())) - np.repeat(np.cumsum(before) - before, before) + b

    def candidates(self, cfg: LineConfig, only: np.ndarray | None = None) -> Iterator[_Found]:
        """Those pairs that the filters let through, with the bound on their overlap less the overlap needed; all of a line in one piece."""
        n, at, bits, more = self.n, self.at, self.bits, self.more
        for x, y in self.pairs(only):
            nx, ny = n[x], n[y]
            huge = np.maximum(nx, ny) == HUGE
            need = cfg.need(nx + ny)
            least = np.minimum(nx, ny)
            # The cheap filters first: most pairs already differ too much in length or meet too late.
            keep = np.flatnonzero((np.minimum(least, np.minimum(nx - at[x], ny - at[y])) >= need) | huge)
            x, y, need, least, total, huge = x[keep], y[keep], need[keep], least[keep], (nx + ny)[keep], huge[keep]
            apart = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int32) + np.bitwise_count(more[x] ^ more[y])
            spare = np.minimum(least, (total - apart) // 2) - need
            ok = ((spare >= 0) | huge) & ((self.docs[x] != self.docs[y]) | (self.lines[x] != self.lines[y]))
            yield x[ok], y[ok], spare[ok]

    def classes(self, cfg: LineConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """In each large posting, of each class of lines of one length and position: its lines; all lines of classes
        that can be similar, the larger of the overlaps in question and the overlaps needed."""
        for b, s in zip(self.post[self.size > LARGE].tolist(), self.size[self.size > LARGE].tolist(), strict=True):
            n, at = self.n[b : b + s], self.at[b : b + s]
            kinds, kind = np.unique(n.astype(np.int64) << 8 | at, return_inverse=True)
            order = np.argsort(kind, kind="stable")
            edge = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
            length, place = (kinds >> 8).astype(np.int32), (kinds & 255).astype(np.int32)
            reach = length - place
            for k in range(len(kinds)):
                need = cfg.need(length[k] + length)
                meet = (np.minimum(np.minimum(reach[k], reach), np.minimum(length[k], length)) >= need) | (np.maximum(length[k], length) == HUGE)
                others = np.flatnonzero(meet)
                if len(others):
                    y = np.sort(np.concatenate([order[edge[j] : edge[j + 1]] for j in others.tolist()]))
                    yield b + order[edge[k] : edge[k + 1]], b + y, np.minimum(length[k], n[y]), need[kind[y]]

    def among(self, cfg: LineConfig, only: np.ndarray | None = None, stop: bool = False) -> Iterator[tuple[_Found, np.ndarray]]:
        """The candidates of large postings, in pieces of some lines and a run of earlier ones, and the lines (of this
        piece's) that have earlier lines beyond it.  ``stop``: a line with candidates is not compared further."""
        for x, y, least, need in self.classes(cfg):
            open_ = x if only is None else x[only[x]]
            total = self.n[x[0]] + self.n[y]
            huge = np.maximum(self.n[x[0]], self.n[y]) == HUGE
            a, run = 0, FIRST_RUN
            while a < len(y):
                open_ = open_[np.searchsorted(open_, y[a], "right") :]
                if not len(open_):
                    break
                z = slice(a, min(len(y), a + run))
                met = np.zeros(len(open_), bool)
                wide = max(1, PAIRS // run)
                for i in range(0, len(open_), wide):
                    some = open_[i : i + wide]
                    apart = np.bitwise_count(self.bits[some][:, None] ^ self.bits[y[z]]).astype(np.int32)
                    apart += np.bitwise_count(self.more[some][:, None] ^ self.more[y[z]])
                    ok = ((total[z] - apart) // 2 >= need[z]) | huge[z]
                    ok &= y[z] < some[:, None]
                    u, v = np.nonzero(ok)
                    w = v + a
                    other = (self.docs[some[u]] != self.docs[y[w]]) | (self.lines[some[u]] != self.lines[y[w]])
                    u, v, w = u[other], v[other], w[other]
                    if len(u):
                        met[i + u] = True
                        spare = np.minimum(least[w], (total[w] - apart[u, v]) // 2) - need[w]
                        yield (some[u], y[w], spare), some[some > y[z][-1]]
                a += run
                if stop:
                    open_ = open_[~met]
                run = min(4 * run, 1 << 12)

    def best(self, cfg: LineConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each line the most promising candidates (later, earlier), and whether it may have more."""
        for found in self.candidates(cfg):
            x, y, keep, many = _first(*found, cfg.tries)
            yield x[keep], y[keep], (many > cfg.tries)[keep]
        for found, beyond in self.among(cfg, stop=True):
            x, y, keep, many = _first(*found, cfg.tries)
            yield x[keep], y[keep], ((many > cfg.tries) | np.isin(x, beyond))[keep]

    def all(self, cfg: LineConfig, only: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All candidates of some lines."""
        for x, y, _ in self.candidates(cfg, only):
            yield x, y
        for (x, y, _), _ in self.among(cfg, only):
            yield x, y

    def table(self, x: np.ndarray, y: np.ndarray, more: np.ndarray) -> pa.Table:
        cols = (self.docs[x], self.lines[x], self.e["set"][x].astype(np.int64), self.docs[y], self.lines[y], self.e["set"][y].astype(np.int64), more)
        return pa.table(dict(zip(_PAIR_NAMES, map(pa.array, cols), strict=True)))


def _first(x: np.ndarray, y: np.ndarray, spare: np.ndarray, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs by later line and promise, which are among a line's first, and how many the line has.

    Of equal promise any will do: lines choose at random, so that none is asked for by all others like it."""
    order = np.lexsort((mix64(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)), -spare, x))
    x, y = x[order], y[order]
    lead = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    many = np.repeat(np.diff(np.r_[lead, len(x)]), np.diff(np.r_[lead, len(x)]))
    return x, y, np.arange(len(x)) - np.repeat(lead, np.diff(np.r_[lead, len(x)])) < tries, many


def _routed(pairs: pa.Table, groups: int) -> pa.Table:
    """Pairs with the groups that they go to, and the asks for their earlier lines."""
    later = pa.array(group_of(pairs.column("xd").to_numpy(), groups), pa.int32())
    n = pairs.num_rows
    pairs = pairs.append_column("to", later)
    asks = pairs.filter(pa.compute.is_valid(pairs.column("yd"))).group_by(["yd", "yl", "ys", "to"]).aggregate([])
    m = asks.num_rows
    cols = {"bucket": pa.array(group_of(asks.column("yd").to_numpy(), groups), pa.int32()), "xd": pa.nulls(m, pa.int64()), "xl": pa.nulls(m, pa.int32()), "xs": pa.nulls(m, pa.int64())}
    asks = pa.table({**cols, **{k: asks.column(k) for k in ("yd", "yl", "ys")}, "more": pa.array(np.zeros(m, bool)), "to": asks.column("to")})
    pairs = pa.table({"bucket": later, **{k: pairs.column(k) for k in _PAIR_NAMES}, "to": pa.nulls(n, pa.int32())})
    return pa.concat_tables([pairs, asks])


def propose(cfg: LineConfig, groups: int) -> Callable[[pa.Table], pa.Table]:
    """In a bucket: repeats of a set (no earlier line given), and each line's most promising candidates."""

    def run(data: pa.Table) -> pa.Table:
        c = _Classes(data)
        d, ln, s = c.repeats
        out = [_settled(pa.table({"xd": d, "xl": ln, "xs": s.astype(np.int64)}))]
        found = list(c.best(cfg))
        if found:
            out.append(c.table(*(np.concatenate(v) for v in zip(*found, strict=True))))
        return _routed(pa.concat_tables(out), groups)

    return run


def propose_all(cfg: LineConfig, groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """In a bucket: all candidates of the lines asked for; those already settled pass as they are."""

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _routed(_settled(asked), groups)
        out = [_settled(asked.filter(asked.column("ok")))]
        asked = asked.filter(pa.compute.invert(asked.column("ok")))
        if asked.num_rows and data.num_rows:
            c = _Classes(data)
            who = set(zip(*(asked.column(k).to_pylist() for k in ("xd", "xl", "xs")), strict=True))
            only = np.zeros(len(c.docs), bool)
            for i in np.flatnonzero(np.isin(c.docs, asked.column("xd").to_numpy())).tolist():
                only[i] = (int(c.docs[i]), int(c.lines[i]), int(c.e["set"][i])) in who
            for x, y in c.all(cfg, only):
                if len(x):
                    out.append(c.table(x, y, np.zeros(len(x), bool)))
        return _routed(pa.concat_tables(out), groups)

    return run


def _settled(lines: pa.Table) -> pa.Table:
    """Lines that go, as pairs without an earlier line."""
    n = lines.num_rows
    blank = (pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool)))
    return pa.table([*(lines.column(k) for k in ("xd", "xl", "xs")), *blank], names=list(_PAIR_NAMES))


def _short(words: np.ndarray) -> np.ndarray:
    """48 bits of each word's hash, as six bytes."""
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1).view("V6")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common words of two sets."""
    wide = np.zeros((len(a) + len(b), 8), np.uint8)
    wide[: len(a), :6] = a.view(np.uint8).reshape(-1, 6)
    wide[len(a) :, :6] = b.view(np.uint8).reshape(-1, 6)
    both = np.sort(wide.reshape(-1).view("<u8"))
    return int((both[1:] == both[:-1]).sum())


_SENT = "bucket int, xd long, xl int, xs long, yd long, yl int, ys long, more boolean, words binary"


def _wanted(docs: pa.Table, pairs: pa.Table, doc: str, line: str, mark: str, levels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(index of a pair, words of its line) for each pair whose line is found; only the lines meant are cut into words."""
    meant: dict[tuple[int, int, int], list[int]] = {}
    lines: dict[int, set[int]] = {}
    for i, k in enumerate(zip(*(pairs.column(c).to_pylist() for c in (doc, line, mark)), strict=True)):
        if k[0] is not None:
            meant.setdefault(k, []).append(i)
            lines.setdefault(k[0], set()).add(k[1])
    for keys, s in _some_lines(docs, lines, levels):
        for i, at in enumerate(s.doc.tolist()):
            # Taken out, so that a row that repeats an id and a line counts once.
            found = meant.pop((*keys[at][1:], int(s.set[i])), None)
            if found:
                words = s.words(i)
                for j in found:
                    yield j, words


def _some_lines(docs: pa.Table, lines: dict[int, set[int]], levels: np.ndarray) -> Iterator[tuple[list[tuple[int, int, int]], LineSets]]:
    """Sets of the given lines of the given documents, with (row, id, line) of each."""
    keys: list[tuple[int, int, int]] = []
    texts: list[str] = []
    size = 0
    column = docs.column("text")
    for row, name in enumerate(docs.column("id").to_pylist()):
        if name is not None and name in lines:
            cut = column[row].as_py().split("\n")
            for k in sorted(lines[name]):
                if k < len(cut):
                    keys.append((row, name, k))
                    texts.append(cut[k])
                    size += len(cut[k])
            if size > SLICE_BYTES:
                yield keys, LineSets(pa.array(texts), levels)
                keys, texts, size = [], [], 0
    if keys:
        yield keys, LineSets(pa.array(texts), levels)


def send(levels: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """In a group of documents: the words of each earlier line asked for, once to each group that asks; the group's own
    pairs pass as they are."""

    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        asking = pa.compute.is_valid(rows.column("to"))
        asks, pairs = rows.filter(asking), rows.filter(pa.compute.invert(asking))
        found: list[tuple[int, bytes]] = []
        line, raw = None, b""
        if asks.num_rows:
            # The asks for one line come one after the other, so its words are packed once.
            for j, words in _wanted(docs, asks, "yd", "yl", "ys", levels):
                if words is not line:
                    line, raw = words, _short(words).tobytes()
                found.append((j, raw))
        some = asks.take(pa.array([j for j, _ in found], pa.int64()))
        n = len(found)
        blank = {"xd": pa.nulls(n, pa.int64()), "xl": pa.nulls(n, pa.int32()), "xs": pa.nulls(n, pa.int64()), "more": pa.nulls(n, pa.bool_())}
        cols = {"bucket": some.column("to"), **blank, **{k: some.column(k) for k in ("yd", "yl", "ys")}, "words": pa.array([w for _, w in found], pa.binary())}
        pairs = pairs.drop_columns("to").append_column("words", pa.nulls(pairs.num_rows, pa.binary()))
        return pa.concat_tables([pa.table({k: cols[k] for k in ("bucket", *_PAIR_NAMES, "words")}), pairs.select(["bucket", *_PAIR_NAMES, "words"])])

    return run


_VERDICT = "bucket int, xd long, xl int, xs long, ok boolean"


def verify(levels: np.ndarray, buckets: int, cfg: LineConfig) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """In a group of documents: a row (ok) for each line that has a similar earlier one; of the others, for
    those that have more candidates, a row for each bucket of their prefix."""

    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if sent.num_rows:
            has = pa.compute.is_valid(sent.column("words"))
            given = sent.filter(has)
            words = dict(zip(zip(*(given.column(k).to_pylist() for k in ("yd", "yl", "ys")), strict=True), given.column("words").to_pylist(), strict=True))
            sent = sent.filter(pa.compute.invert(has))
            keys = list(zip(*(sent.column(k).to_pylist() for k in ("xd", "xl", "xs")), strict=True))
            theirs = [words.get(y) for y in zip(*(sent.column(k).to_pylist() for k in ("yd", "yl", "ys")), strict=True)]
            more = sent.column("more").to_pylist()
            good = {k for k, y in zip(keys, sent.column("yd").to_pylist(), strict=True) if y is None}
            again: dict[tuple, list[int]] = {}
            ask = sent.append_column("j", pa.array(range(len(keys)), pa.int64())).filter(pa.array([w is not None for w in theirs], pa.bool_()))
            back = ask.column("j").to_pylist()
            for i, mine in _wanted(docs, ask, "xd", "xl", "xs", levels):
                j = back[i]
                other = np.frombuffer(theirs[j], "V6")
                shared = _shared(_short(mine), other)
                if shared >= cfg.similarity * (len(mine) + len(other) - shared):
                    good.add(keys[j])
                elif more[j]:
                    spread, _ = _spread(mine[: int(cfg.prefix(np.array([len(mine)]))[0])])
                    again[keys[j]] = sorted(set((spread % np.uint64(buckets)).astype(int).tolist()))
            rows += [(hash(k) % buckets, *k, True) for k in good]
            rows += [(b, *k, False) for k, many in again.items() if k not in good for b in many]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "xd", "xl", "xs", "ok"])

    return run


def strip(levels: np.ndarray, texts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """In a group of documents: each without the lines that go."""

    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        gone_of: dict[int, dict[int, set[int]]] = {}
        for d, ln, s in zip(*(gone.column(k).to_pylist() for k in ("xd", "xl", "xs")), strict=True):
            gone_of.setdefault(d, {}).setdefault(ln, set()).add(s)
        # Ids may repeat: a line goes only if its set is the one meant.
        drop: dict[int, set[int]] = {}
        for keys, sets in _some_lines(docs, {d: set(x) for d, x in gone_of.items()}, levels):
            for at, mark in zip(sets.doc.tolist(), sets.set.tolist(), strict=True):
                row, name, k = keys[at]
                if mark in gone_of[name][k]:
                    drop.setdefault(row, set()).add(k)
        rows: list[list] = [[], [], [], []]
        for row, text in enumerate(docs.column("text")):
            body = text.as_py()
            n = body.count("\n") + 1
            less = drop.get(row, ())
            if less:
                body = "\n".join([x for k, x in enumerate(body.split("\n")) if k not in less])
            for x, y in zip(rows, (n, len(less), hashlib.sha256(body.encode()).hexdigest(), body if texts else None), strict=True):
                x.append(y)
        cols = [docs.column("id"), *(pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), docs.column("rest")]
        names = ["id", "n_lines", "n_removed", "kept_sha256", "kept", "rest"]
        keep = [i for i, x in enumerate(names) if texts or x not in ("kept", "rest")]
        return pa.table([cols[i] for i in keep], names=[names[i] for i in keep])

    return run


def remove_lines(docs: DataFrame, cfg: LineConfig = LineConfig(), id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per row: the id (long), n_lines, n_removed, kept_sha256; with ``texts`` also ``kept``, the text without
    the removed lines, and ``rest``, a struct of the row's other columns.

    One plan: the documents cross the network once, into groups of some
    megabytes that all later steps share; the prefixes cross it once, packed."""
    spare = [F.col(c) for c in docs.columns if c not in (id_col, text_col)] if texts else []
    rest = F.struct(*spare) if spare else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    plain = rows.select("id", "text").where("id IS NOT NULL")
    levels, total = rarity(rows)
    buckets, groups = 1 + total // BUCKET_BYTES, 1 + total // GROUP_BYTES

    entries = plain.mapInArrow(prefixes(levels, buckets, cfg), PACKED).groupBy("bucket")
    grouped = rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(groups)).cast("int")).groupBy("bucket")

    def in_group(df: DataFrame, doc) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(doc), F.lit(groups)).cast("int"))

    def settle(pairs: DataFrame) -> DataFrame:
        """Verdicts on candidate pairs.  However many lines are like one line, its group is asked once by each group."""
        one = pairs.groupBy("bucket", "xd", "xl", "xs", "yd", "yl", "ys", "to").agg(F.max("more").alias("more"))
        sent = grouped.cogroup(one.groupBy("bucket")).applyInArrow(send(levels), _SENT)
        return grouped.cogroup(sent.groupBy("bucket")).applyInArrow(verify(levels, buckets, cfg), _VERDICT)

    first = settle(entries.applyInArrow(propose(cfg, groups), _PAIR))
    rest_pairs = entries.cogroup(first.groupBy("bucket")).applyInArrow(propose_all(cfg, groups), _PAIR)
    gone = settle(rest_pairs).where("ok").select("xd", "xl", "xs")
    schema = "id long, n_lines long, n_removed long, kept_sha256 string"
    if texts:
        schema += ", kept string, rest " + dict(rows.dtypes)["rest"]
    out = grouped.cogroup(in_group(gone, F.col("xd")).groupBy("bucket")).applyInArrow(strip(levels, texts), schema)
    return out.withColumnRenamed("id", id_col)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document."""
    return remove_lines(table(spark, sf_dir, "documents"), texts=False)

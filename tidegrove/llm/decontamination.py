"""Benchmark decontamination by template canonicalisation.

Words are stripped of edge punctuation and lower-cased; numbers, names and units
become typed placeholders, which keep their value as a slot.  Names in a row are
one placeholder, and so are a number and its unit.  Windows of ``window`` such tokens of every benchmark item are hashed; windows of documents
are looked up among them.  Matches of one document and item that lie on one
diagonal are gathered: the tokens they cover and their slots.  A slot value of
the item must stand for one value of the document throughout, and the other way
round; windows that break this don't count.  Where no diagonal
is enough, those at most ``drift`` words apart from the next are added up, as a
slot may have grown or shrunk between them.  A document leaks an item if
``enough`` words (or the whole item, if shorter) are covered, so questions with
new numbers or names are caught as well as exact ones.

A window counts if it has ``literals`` tokens that are no placeholders.  One of
fewer counts if units of equal value make up for them and no window on its
diagonal breaks the slots.  Windows of the plain lower-cased words are looked up
as well: they need no literals and no slots, so verbatim copies are found in any
case and however many numbers, units or names they have.

Items shorter than a window form one window of their length, for placeholders
down to ``shortest`` tokens.  Items shorter than that are found verbatim; those
of one or two words only as a whole sentence or line.  Words of punctuation alone
are left out.  Nulls match nothing.  Null and empty documents leak nothing.  Repeated items and rows are treated alike.  Other columns pass
through; the added column is renamed if its name is taken.  Empty tables give
empty results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrove.llm.common import free_name, mix64, table, window_hashes


@dataclass(frozen=True)
class TemplateConfig:
    """Lengths in tokens; ``block``, ``block_bytes``: benchmark items and bytes of them looked for in one pass, on average,
    which bounds what is broadcast (some twenty times the bytes)."""

    window: int = 8
    literals: int = 5
    enough: int = 12
    shortest: int = 5
    block: int = 50_000
    block_bytes: int = 4 << 20
    drift: int = 4


#: Units that follow a number or stand alone.
UNITS = frozenset("kg g mg lb lbs oz km m cm mm mi ft in inch inches mile miles meter meters metre metres litre litres liter liters l ml gal gallon gallons h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years usd eur gbp dollar dollars cent cents euro euros pound pounds percent % degree degrees c f k kw kwh mph kmh hz khz mhz ghz kb mb gb tb".split())
_EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "%") + "“”‘’«»…–—¿¡"
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*%?\Z")
LITERAL, NUMBER, UNIT, NAME = range(4)


class Canon:
    """A worker's words: for each its canonical hash, its kind by itself, and whether it ends a sentence."""

    MOST = 250_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.value, self.kind, self.ends, self.bare = np.zeros(1024, np.uint64), np.zeros(1024, np.int8), np.zeros(1024, bool), np.zeros(1024, bool)

    def _add(self, word: str) -> int:
        import xxhash

        i = len(self.index)
        if i == len(self.kind):
            self.value, self.kind, self.ends, self.bare = (np.concatenate([x, np.zeros_like(x)]) for x in (self.value, self.kind, self.ends, self.bare))
        core = word.strip(_EDGE)
        low = core.lower()
        self.value[i] = xxhash.xxh64_intdigest(low.encode(), 1)
        if _NUMBER.match(core):
            self.kind[i] = NUMBER
        elif low in UNITS:
            self.kind[i] = UNIT
        elif core[:1].isupper() and core[1:] == core[1:].lower():
            self.kind[i] = NAME
        self.ends[i] = not core or word.rstrip("\"')]”’»*#$&%")[-1:] in (".", "!", "?", ":", "…")
        self.bare[i] = not core
        self.index[word] = i
        return i

    def read(self, texts: list[str]) -> Words:
        """The words of some texts, one text after the other.

        A capital makes a name unless the word opens the text, a line or a sentence."""
        if len(self.index) > self.MOST:
            self.clear()
        get, add, at, opens, counts = self.index.get, self._add, [], [], []
        for text in texts:
            before = len(at)
            for line in text.split("\n"):
                words = line.split()
                if words:
                    opens.append(len(at))
                    at += [i if (i := get(w)) is not None else add(w) for w in words]
            counts.append(len(at) - before)
        i = np.array(at, np.int64)
        first = np.zeros(len(i), bool)
        first[1:] = self.ends[i[:-1]]
        first[opens] = True
        text, solid = np.repeat(np.arange(len(texts)), counts), ~self.bare[i]
        i, first, text = i[solid], first[solid], text[solid]
        kind = np.where((self.kind[i] == NAME) & first, LITERAL, self.kind[i])
        return Words(self.value[i], first, text, kind)


class Words:
    """Words (hash, whether one opens a sentence, number of the text) and the tokens they make up.

    Of a token: its hash, its kind, its slot value, its text and its first word."""

    def __init__(self, value: np.ndarray, first: np.ndarray, text: np.ndarray, kind: np.ndarray):
        self.value, self.first, self.text = value, first, text
        joins = np.zeros(len(kind), bool)
        names = (kind[1:] == NAME) & (kind[:-1] == NAME)
        units = (kind[1:] == UNIT) & (kind[:-1] == NUMBER) & ~first[1:]
        joins[1:] = names | units
        at = np.flatnonzero(~joins)
        self.start = np.append(at, len(value))
        self.kind, self.owner = kind[at], text[at]
        # A number and its unit are two slots, so that a number has one value with and without a unit.
        self.unit = np.zeros(len(at), np.uint64)
        with_unit = (self.kind == NUMBER) & (np.diff(self.start) > 1)
        self.unit[with_unit] = value[at[with_unit] + 1]
        self.slot = value[at]
        several = (self.kind == NAME) & (np.diff(self.start) > 1)
        if several.any():
            place = np.arange(len(value)) - np.repeat(at, np.diff(self.start))
            self.slot[several] = np.add.reduceat(mix64(value + place.astype(np.uint64)), at)[several]
        self.token = np.where(self.kind == LITERAL, self.slot, mix64(self.kind.astype(np.uint64)))


def _enough(words: Words, cfg: TemplateConfig, size: int) -> np.ndarray:
    """Whether each window of tokens has so many literals and units that it may count; of fewer tokens there are none."""
    plain = np.concatenate([[0], np.cumsum((words.kind == LITERAL) | (words.kind == UNIT) | (words.unit > 0))])
    return plain[size:] - plain[: max(len(plain) - size, 0)] >= min(cfg.literals, size)


class _Windows:
    """Windows of numbered owners, sorted by hash, with a table of leading bits that sees most other hashes off."""

    def __init__(self, parts: list[tuple[np.ndarray, int, np.ndarray, int]]):
        h, item, at = (np.concatenate(x) for x in zip(*((h, np.full(len(h), k), at) for h, k, at, _ in parts), strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], item[order], at[order]
        self.sizes = sorted({size for *_, size in parts})
        self.seen: np.ndarray | None = None

    def find(self, tokens: np.ndarray, owner: np.ndarray, size: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of one text that are among these, and for each the index here."""
        if self.seen is None:
            # Made where it is needed, not sent.
            bits = min(24, max(12, (16 * len(self.h)).bit_length()))
            self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
            self.seen[self.h >> self.shift] = True
        h = window_hashes(tokens, size) ^ np.uint64(size)
        if not len(h):
            return np.zeros(0, int), np.zeros(0, int)
        may = self.seen[h >> self.shift] & (owner[size - 1 :] == owner[: len(h)])
        at = np.flatnonzero(may if allowed is None else may & allowed)
        low, high = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        n = high - low
        return np.repeat(at, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _template(words: Words) -> tuple[bytes, ...]:
    """What items must have in common to match the same documents up to the values of their slots: the tokens, their
    lengths in words, and which slots are equal."""
    slots = np.concatenate([np.where(words.kind == LITERAL, np.uint64(0), words.slot), words.unit])
    _, first, which = np.unique(slots, return_index=True, return_inverse=True)
    return words.token.tobytes(), words.start.tobytes(), first[which].tobytes(), (words.unit > 0).tobytes()


class Bench:
    """The items' windows of tokens and of plain words.

    Items of one template are a class: windows that all its items share are held and looked up once."""

    def __init__(self, items: list[tuple[object, str | None]], cfg: TemplateConfig):
        canon, self.cfg, self.items = Canon(), cfg, []
        numbers: dict[tuple[bytes, ...], int] = {}
        self.members: list[list[int]] = []
        for name, text in items:
            words = canon.read([text or ""])
            if len(words.value):
                k = numbers.setdefault(_template(words), len(numbers))
                if k == len(self.members):
                    self.members.append([])
                self.members[k].append(len(self.items))
                self.items.append((name, words, k))
        tokens, shared, plain = [], [], []
        for k, members in enumerate(self.members):
            words = self.items[members[0]][1]
            size = min(cfg.window, len(words.token))
            if size >= cfg.shortest:
                at = np.flatnonzero(_enough(words, cfg, size))
                tokens.append(((window_hashes(words.token, size) ^ np.uint64(size))[at], k, at, size))
            size = min(cfg.window, len(words.value))
            h = np.stack([window_hashes(self.items[i][1].value, size) ^ np.uint64(size) for i in members])
            same = (h == h[0]).all(0)
            at = np.flatnonzero(same)
            shared.append((h[0][at], k, at, size))
            at = np.flatnonzero(~same)
            if len(at):
                plain += [(row[at], i, at, size) for i, row in zip(members, h, strict=True)]
        self.tokens, self.shared, self.plain = _Windows(tokens), _Windows(shared), _Windows(plain)

    def leaks(self, texts: list[str], canon: Canon) -> list[list]:
        """Of each text the names of the items that it leaks."""
        cfg, words = self.cfg, canon.read(texts)
        # Of a text and a class, and of its single items: (shift, place in the item, size, place in the text, or -1 for plain words).
        found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)
        own: dict[tuple[int, int], dict[int, list[tuple[int, int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        for windows in (self.shared, self.plain):
            for size in windows.sizes:
                at, j = windows.find(words.value, words.text, size)
                for p, k, q in zip(at.tolist(), windows.item[j].tolist(), windows.at[j].tolist(), strict=True):
                    if size > 2 or words.first[p] and (p + size == len(words.first) or words.first[p + size]):
                        text = int(words.text[p])
                        (found[text, k] if windows is self.shared else own[text, self.items[k][2]][k]).append((p - q, q, size, -1))
        for size in self.tokens.sizes:
            at, j = self.tokens.find(words.token, words.owner, size, _enough(words, cfg, size))
            for p, k, q in zip(at.tolist(), self.tokens.item[j].tolist(), self.tokens.at[j].tolist(), strict=True):
                found[int(words.owner[p]), k].append((int(words.start[p] - self.items[self.members[k][0]][1].start[q]), q, size, p))
        out: list[list[int]] = [[] for _ in texts]
        for text, k in found.keys() | own.keys():
            members, mine, theirs = self.members[k], found.get((text, k), []), own.get((text, k), {})
            item = self.items[members[0]][1]
            if mine and self._leaked(item, words, mine, strict=False):
                out[text] += members
                continue
            # Where windows of tokens could be enough, it depends on an item's own values.
            for i in members if self._possible(item, mine) else theirs:
                if self._leaked(self.items[i][1], words, mine + theirs.get(i, [])):
                    out[text].append(i)
        return [[self.items[i][0] for i in sorted(some)] for some in out]

    def _possible(self, item: Words, matches: list[tuple[int, int, int, int]]) -> bool:
        covered = np.zeros(len(item.value), bool)
        for _, q, size, p in matches:
            covered[q : q + size] |= p < 0
            if p >= 0:
                covered[item.start[q] : item.start[q + size]] = True
        return int(covered.sum()) >= min(self.cfg.enough, len(item.value))

    def _leaked(self, item: Words, words: Words, matches: list[tuple[int, int, int, int]], strict: bool = True) -> bool:
        """Whether the matches cover enough; ``strict``: windows of few literals, whose values must agree, may help."""
        diagonals = defaultdict(list)
        for m in matches:
            diagonals[m[0]].append(m)
        if any(self._covered(item, words, some, strict) for some in diagonals.values()):
            return True
        shifts = sorted(diagonals)
        groups = [[shifts[0]]]
        for a, b in zip(shifts, shifts[1:]):
            if b - a > self.cfg.drift:
                groups.append([])
            groups[-1].append(b)
        return any(len(g) > 1 and self._covered(item, words, [m for x in g for m in diagonals[x]], strict) for g in groups)

    def _covered(self, item: Words, words: Words, matches: list[tuple[int, int, int, int]], also_strict: bool) -> bool:
        need = min(self.cfg.enough, len(item.value))
        covered: set[int] = set()
        windows = []
        for _, q, size, p in sorted(matches):
            if p < 0:
                covered.update(range(q, q + size))
            else:
                windows.append((q, size, p))
        if len(covered) >= need:
            return True
        more = set(covered)
        for some, strict in ((covered, False), (more, True))[: 1 + also_strict]:
            here, there, broken = {}, {}, False
            for q, size, p in sorted(windows):
                slots = [s for k in range(size) if item.kind[q + k] != LITERAL for s in self._slots(item, q + k, words, p + k)]
                same = self._same(item, q, words, p, size) if strict else int((item.kind[q : q + size] == LITERAL).sum())
                if same < min(self.cfg.literals, size):
                    continue
                if all(here.get(a, b) == b and there.get(b, a) == a for a, b in slots) and len({a for a, _ in slots}) == len({b for _, b in slots}) == len(set(slots)):
                    here.update(slots)
                    there.update((b, a) for a, b in slots)
                    some.update(range(int(item.start[q]), int(item.start[q + size])))
                else:
                    broken = True
            if len(some) >= need and not (strict and broken):
                return True
        return False

    @staticmethod
    def _same(item: Words, q: int, words: Words, p: int, size: int) -> int:
        """Tokens of equal value, or numbers of equal unit."""
        one, other = item.unit[q : q + size], words.unit[p : p + size]
        return int(((one == other) & ((one > 0) | (item.slot[q : q + size] == words.slot[p : p + size]))).sum())

    @staticmethod
    def _slots(item: Words, q: int, words: Words, p: int) -> list[tuple[int, int]]:
        pairs = [(int(item.slot[q]), int(words.slot[p]))]
        return [*pairs, (int(item.unit[q]), int(words.unit[p]))] if item.unit[q] and words.unit[p] else pairs


#: Characters of text whose windows are looked up together.
TOGETHER = 1 << 18


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about ``TOGETHER`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


def find_leaks(docs: DataFrame, benchmark: DataFrame, cfg: TemplateConfig = TemplateConfig(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "leaks") -> tuple[DataFrame, str]:
    """``docs`` with an array of the ids of leaked items (longs), and that column's name.

    The items are read in blocks of about ``cfg.block`` items or ``cfg.block_bytes``; a pass over the documents, in
    one narrow stage, looks up the windows of one block.  The documents are never
    shuffled.  The tables of a block are made once and broadcast; their size is bounded by the block."""
    out = free_name(docs, out_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])
    names = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    total, size = names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-total // cfg.block), -(-size // cfg.block_bytes))

    def passing(items: list[tuple[object, str | None]], df: DataFrame, more: bool) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(Bench(items, cfg))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench, canon = sent.value, Canon()
            for batch in batches:
                for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    texts = [t or "" for t in part.column(at).cast(pa.string()).to_pylist()]
                    found = [x for some in _runs(texts) for x in bench.leaks(some, canon)]
                    columns = list(part.columns)
                    if more:
                        found = [a + b for a, b in zip(columns.pop().to_pylist(), found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], names=schema.names)

        return df.mapInArrow(run, schema)

    df = docs
    for k in range(blocks):
        some = names if blocks == 1 else names.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        items = sorted(((r.id, r.text) for r in some.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        df = passing(items, df, k > 0)
    return df, out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: each document and each benchmark item that it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode(leaks).alias("item_id"))

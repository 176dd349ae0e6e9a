"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can come last in that prefix's
encoding.  Whether token ``b`` may follow token ``a`` depends on the two alone:
it may if the bytes of ``a + b`` encode to just these two.  So the last token
of prefix ``i`` is the one token that ends there and may follow the last token
of the prefix before it.  Storing these last tokens makes appending exact
(earlier entries never change) and lets an edit re-encode from the edit on only
until the table agrees with the old one again.

Nulls count as empty texts, an empty text has no tokens, a text of any length is
encoded whole; repeated rows give repeated results; columns besides the id and
the text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.llm.common import table

#: Pieces, and stretches between single spaces, whose ids a worker remembers (of each kind).
CACHE_PIECES = 300_000


#: Fixed value: the pattern for which texts may be cut at spaces.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Touching(Exception):
    """A space touches other white space."""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition of BPE: join the pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
        if rank == sys.maxsize:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class PrefixEncoder:
    """Encodes single pieces.  Tokens that BPE itself never makes can't be used and are left out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Every string that some token ends with: the token of just these bytes, or -1.
        self.tails = {b[i:]: -1 for b in ranks for i in range(len(b))} | ranks
        self._follows: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}

    def alone(self, token: int) -> bool:
        """Whether the token's bytes encode to it."""
        if (found := self._alone.get(token)) is None:
            found = self._alone[token] = merge_by_rank(self.bytes_of[token], self.ranks) == [token]
        return found

    def follows(self, a: int, b: int) -> bool:
        key = (a, b)
        if (found := self._follows.get(key)) is None:
            if len(self._follows) > 400_000:
                self._follows.clear()
            both = self.bytes_of[a] + self.bytes_of[b]
            whole = self.ranks.get(both)
            found = (whole is None or not self.alone(whole)) and merge_by_rank(both, self.ranks) == [a, b]
            self._follows[key] = found
        return found

    def extend(self, piece: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Fill ``last`` (entry i: the last token of the first i bytes) up to ``stop``; entry 0 is -1."""
        get, known, follows = self.tails.get, self._follows.get, self.follows
        for i in range(len(last), (len(piece) if stop is None else stop) + 1):
            j = i - 1
            while (token := get(piece[j:i])) is not None:
                if token >= 0:
                    if not j:
                        ok = self.alone(token)
                    elif (ok := known((last[j], token))) is None:
                        ok = follows(last[j], token)
                    if ok:
                        last.append(token)
                        break
                if not j:
                    raise ValueError("the vocabulary lacks a single byte")
                j -= 1
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return last

    def tokens(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.tokens(self.extend(piece, [-1]))

    def append(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The piece with ``more`` after it, and its table: no entry of the old one changes."""
        return piece + more, self.extend(piece + more, list(last))

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace piece[start:end]; recompute from there until a token's whole length agrees with the old table.

        An entry depends on the bytes and entries of the last ``longest`` places only,
        so once that many agree, the rest of the old table stands."""
        text, shift = piece[:start] + new + piece[end:], start + len(new) - end
        out, same = list(last[: start + 1]), 0
        for i in range(start + 1, len(text) + 1):
            self.extend(text, out, i)
            k = i - shift
            same = same + 1 if i > start + len(new) and out[i] == last[k] else 0
            if same >= self.longest:
                return text, out + last[k + 1 :]
        return text, out


@lru_cache(1)
def _classes() -> tuple[str, str]:
    """The insides of character classes for letters and for numbers, from the general categories."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        if (runs := found.get(unicodedata.category(chr(c))[0])) is not None:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found[k]) for k in "LN")  # type: ignore[return-value]


#: The code points with the White_Space property.
SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(4)
def splitter(pattern: str) -> re.Pattern[str]:
    """A tokenizer's pattern for ``re``: its property classes and ``\\s`` are spelled out, which is
    exact and several times faster than an engine that knows the properties."""
    letters, numbers = _classes()
    out, inside = "", False
    for part in re.findall(r"\\p\{\w\}|\\[sS]|\\.|[\[\]]|.", pattern):
        if part in "[]":
            inside = part == "["
        body = {"\\p{L}": letters, "\\p{N}": numbers, "\\s": SPACE}.get(part)
        if part == "\\S":
            out += f"[^{SPACE}]"
        else:
            out += part if body is None else body if inside else f"[{body}]"
    return re.compile(out)


class Pieces(dict):
    """The ids (4 little-endian bytes each) of pieces that a worker has met."""

    def __init__(self, encode):
        super().__init__()
        self.of = encode

    def __missing__(self, piece: str) -> bytes:
        out = self.of(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out


class TextEncoder:
    """Encodes whole texts.

    No piece goes over a single space that stands between two other characters
    that are no white space: a piece may start with such a space and none ends
    with it.  So texts are cut there first, and stretches met before are looked
    up whole.  A text in which a space touches other white space goes through
    the pattern in one."""

    def __init__(self, path: str, pattern: str):
        self.pieces = PrefixEncoder(load_ranks(path))
        self.split = splitter(pattern).findall
        self.table = [self.pieces.bytes_of.get(i, b"") for i in range(max(self.pieces.bytes_of) + 1)]
        self.known = Pieces(self._piece)
        self.stretches = Pieces(self._stretch)
        self.cut = pattern == GPT2_PATTERN

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Touching
        return self.slow(" " + part)

    def slow(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if self.cut:
            head, *rest = text.split(" ")
            try:
                if head and not head[-1].isspace():
                    return self.slow(head) + b"".join(map(self.stretches.__getitem__, rest))
            except _Touching:
                pass
        return self.slow(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row: the id column, ``n_tokens``, the digests of the ids and of the decoded bytes, and ``ids`` if asked for.

    A narrow plan: one pass over the two columns, no shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                n, a, b, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    got = enc.encode(text or "")
                    n.append(len(got) // 4)
                    a.append(hashlib.sha256(got).hexdigest())
                    b.append(hashlib.sha256(enc.decode(got)).hexdigest())
                    kept.append(got)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
                if ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in kept], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return pair.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Texts of id arrays (null for null); bytes that are no UTF-8 become the replacement character."""

    @F.pandas_udf("string")
    def texts(col):
        enc = encoder(path, pattern)
        return col.map(lambda x: None if x is None else enc.decode(np.asarray(x, "<u4").tobytes()).decode("utf-8", "replace"))

    return encoded.withColumn(out_col, texts(F.col(ids_col)))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)

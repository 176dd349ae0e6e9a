"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A tokenizer's vocabulary is a compression table for written language, so words
take few tokens for their characters and random strings take many.  Runs of
code-like characters with a low count of characters per token are reported,
unless they are of a kind known to be harmless: digests in hexadecimal, UUIDs,
plain numbers, and identifiers made of words.

Nulls count as empty texts and give no spans; texts are scanned whole; repeated
rows give repeated results; columns besides the id and the text are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.llm.bpe import load_ranks
from tidegrove.llm.common import table

#: The order of kinds at one start.
KINDS = ("assign", "access", "hex", "random")

#: ``[Pp]`` and so on instead of a flag: a flag would also fold letters beyond ASCII.
_ASSIGN = re.compile(
    "("
    + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: Greedy runs, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: A run may follow ``=``, as in env files and query strings; up to two at its end are padding.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_WORDS = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]*|[0-9]{0,4})\Z")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|[-_/+=]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of what the fixed patterns find, by start."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def harmless(run: str, vocabulary, most_ratio: float) -> bool:
    """Digests of the usual lengths, UUIDs, numbers, and identifiers of words and short numbers.

    An identifier's parts are cut at signs, at a capital after a small letter and
    at a digit after a letter; random strings fall apart into many such parts, so
    a name's parts must be three characters long on average.  The letters of its
    parts, made small, must take few tokens themselves, as words do."""
    if _DIGEST.match(run) and len(run) in _DIGEST_LENGTHS or _UUID.match(run) or run.isdigit():
        return True
    parts = [p for p in _HUMP.split(run) if p]
    if len(run) < 3 * len(parts) or not all(_WORDS.match(p) for p in parts):
        return False
    words = [p.lower() for p in parts if p.isalpha()]
    return sum(map(len, words)) > most_ratio * sum(len(vocabulary.encode_ordinary(w)) for w in words)


@lru_cache(2)
def _vocabulary(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def random_spans(text: str, vocabulary, most_ratio: float) -> list[tuple[int, int, int]]:
    """Runs with at most ``most_ratio`` characters a token that are not harmless."""
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        if not harmless(run, vocabulary, most_ratio) and len(run) <= most_ratio * len(vocabulary.encode_ordinary(run)):
            out.append((m.start(), 3, m.end()))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most_ratio: float = 1.9) -> DataFrame:
    """Per row: the id, counts of base spans by kind, ``base_sha256``, ``spans`` and ``n_random``.

    A narrow plan: one pass over the two columns, no shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                every = sorted(base + random_spans(text, vocabulary, most_ratio))
                n = [sum(s[1] == k for s in every) for k in range(4)]
                rows.append((*n[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), n[3]))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=names)

    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return pair.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

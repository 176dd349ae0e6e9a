"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``words`` words.  Each passage is encoded from
its characters and words; a gated attention (tanh times sigmoid) weighs the
passages of a bag, and the weighted sum of their encodings is scored by a
logistic unit.  Only documents have labels; what the passages are worth is learnt
from those.  Training is on the driver, over a bounded sample of labelled
documents (``sample``: those of least hash of their id, whole texts, but none of
more than ``longest`` bytes); scoring is a narrow pass over all documents.

A null or empty text is a bag of one empty passage and is scored.  A labelled id
with different labels, a null label or a null id is left out of training; with no
usable label every score is 0.5.  Of rows that repeat a labelled id one is learnt
from, that of the least text digest; repeated rows get equal scores.  Columns
besides those named are ignored, whatever their names.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.llm.common import free_name, slices, span_hashes, table, utf8, word_spans


@dataclass(frozen=True)
class QualityConfig:
    """words a passage; at most ``sample`` labelled documents of at most ``longest`` bytes are learnt from (scored are all),
    which bounds what reaches the driver; widths of encoding and attention; training settings."""

    words: int = 64
    sample: int = 4_000
    longest: int = 1 << 17
    width: int = 16
    attention: int = 8
    epochs: int = 30
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


#: Signs that have a count of their own.
_SIGNS = b".,;:!?'\"-()*%$#&@/|<>_=+[]{}\\^~`"
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09]] = 4
_CLASS[[0x0A, 0x0D]] = 5
_CLASS[0x80:0xC0] = 6
_CLASS[0xC0:] = 7
for _i, _c in enumerate(_SIGNS):
    _CLASS[_c] = 8 + _i
_CLASSES = 8 + len(_SIGNS)
#: Coarse classes whose pairs are counted: other signs and controls count with the signs.
_COARSE = np.where(_CLASS >= 8, 0, _CLASS)
FEATURES = _CLASSES + 64 + 5


def passages(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the offset of each text's first (n + 1 numbers)."""
    raw, off = utf8(texts)
    starts, ends, first = word_spans(raw, off)
    n = np.diff(first)
    per = np.maximum(1, -(-n // words))
    lead = np.concatenate([[0], np.cumsum(per)])
    p = int(lead[-1])
    # Where passages start, in bytes: a text's first at the text's start, others at a word.
    within = np.arange(p) - np.repeat(lead[:-1], per)
    at = np.repeat(off[:-1], per)
    later = within > 0
    at[later] = starts[(np.repeat(first[:-1], per) + within * words)[later]]
    size = np.diff(np.concatenate([at, [len(raw)]]))
    owner = np.repeat(np.arange(p), size)
    counts = np.bincount(owner * _CLASSES + _CLASS[raw], minlength=p * _CLASSES).reshape(p, _CLASSES)
    coarse = _COARSE[raw]
    same = owner[1:] == owner[:-1]
    pairs = np.bincount((owner[1:] * 64 + coarse[:-1] * 8 + coarse[1:])[same], minlength=p * 64).reshape(p, 64)

    hashes = span_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - first[:-1][doc]
    passage = lead[:-1][doc] + place // words
    grid = np.zeros((p, words), np.uint64)
    grid[passage, place % words] = hashes
    many = np.bincount(passage, minlength=p)
    alike = np.bincount(passage[1:][(hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])], minlength=p)
    grid.sort(1)
    distinct = (np.diff(grid, axis=1) != 0).sum(1) + (grid[:, 0] != 0)
    heads = np.bincount(passage[_CLASS[raw[starts]] == 2], minlength=p) if len(starts) else np.zeros(p)
    some, length = np.maximum(many, 1), np.maximum(size, 1)
    extra = np.stack([np.log1p(many), size / some / 8, distinct / some, alike / some, heads / some], axis=1)
    x = np.concatenate([np.sqrt(counts / length[:, None]), np.sqrt(pairs / length[:, None]), extra], axis=1)
    return x.astype(np.float32), lead


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """Parameters by name: shift, scale (of the features), W, b, V, U, w, c, d."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.params = params

    @classmethod
    def fresh(cls, x: np.ndarray, cfg: QualityConfig) -> AttentionModel:
        rng = np.random.default_rng(cfg.seed)
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        return cls(
            {
                "shift": x.mean(0, dtype=np.float64),
                "scale": 1 / np.maximum(x.std(0, dtype=np.float64), 1e-3),
                "W": draw(x.shape[1], cfg.width),
                "b": np.zeros(cfg.width),
                "V": draw(cfg.width, cfg.attention),
                "U": draw(cfg.width, cfg.attention),
                "w": draw(cfg.attention),
                "c": draw(cfg.width),
                "d": np.zeros(1),
            }
        )

    def forward(self, x: np.ndarray, lead: np.ndarray) -> dict[str, np.ndarray]:
        """Everything on the way to the scores of the bags x[lead[i]:lead[i + 1]], none of them empty."""
        p = self.params
        x = np.clip((x - p["shift"]) * p["scale"], -5, 5)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        many = np.diff(lead)
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, lead[:-1]), many))
        a = e / np.repeat(np.add.reduceat(e, lead[:-1]), many)
        z = np.add.reduceat(a[:, None] * h, lead[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, x: np.ndarray, lead: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, f = self.params, self.forward(x, lead)
        many = np.diff(lead)
        out = (f["score"] - y) / len(y)
        dz = np.repeat(out[:, None] * p["c"], many, axis=0)
        da = (f["h"] * dz).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, lead[:-1]), many))
        dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dh,
            "b": dh.sum(0),
            "V": f["h"].T @ dt,
            "U": f["h"].T @ dg,
            "w": (f["t"] * f["g"]).T @ ds,
            "c": f["z"].T @ out,
            "d": np.array([out.sum()]),
        }


def train(x: np.ndarray, lead: np.ndarray, y: np.ndarray, cfg: QualityConfig) -> AttentionModel:
    """Adam over shuffled bags."""
    model = AttentionModel.fresh(x, cfg)
    rng = np.random.default_rng(cfg.seed + 1)
    names = ("W", "b", "V", "U", "w", "c", "d")
    m = {k: np.zeros_like(model.params[k]) for k in names}
    v = {k: np.zeros_like(model.params[k]) for k in names}
    step = 0
    for epoch in range(cfg.epochs):
        order = rng.permutation(len(y))
        rate = cfg.rate * (1 - epoch / cfg.epochs) + cfg.rate / 50
        for i in range(0, len(y), cfg.batch):
            some = order[i : i + cfg.batch]
            rows = np.concatenate([np.arange(lead[k], lead[k + 1]) for k in some])
            cuts = np.concatenate([[0], np.cumsum(lead[some + 1] - lead[some])])
            step += 1
            for k, g in model.gradients(x[rows], cuts, y[some]).items():
                g = g + cfg.decay * model.params[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.params[k] = model.params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, learnable: Column, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel | None:
    """Train on labelled documents for whose id ``learnable`` (a condition on the label table) holds."""
    spark = docs.sparkSession
    known = labels.where(learnable).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    clear = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    chosen = clear.orderBy(F.xxhash64("id"), "id").limit(cfg.sample).select("id", "y").collect()
    if not chosen:
        return None
    # At most ``sample`` rows, so they can be broadcast.
    picked = F.broadcast(spark.createDataFrame(chosen, clear.select("id", "y").schema))
    words = cfg.words

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, lead = passages(part.column("text"), words)
                rows = [x[a:b].tobytes() for a, b in zip(lead[:-1], lead[1:], strict=True)]
                digests = [hashlib.sha256(r).digest() for r in rows]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], names=["id", "y", "digest", "x"])

    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= cfg.longest)
    encoded = pair.join(picked, "id").select("id", "y", "text").mapInArrow(encode, f"id {dict(pair.dtypes)['id']}, y double, digest binary, x binary")
    bags = encoded.groupBy("id").agg(F.min(F.struct("digest", "y", "x")).alias("bag")).select("bag.*").toArrow()
    if not bags.num_rows:
        return None
    # Whatever order Spark returned.
    bags = bags.sort_by([("digest", "ascending"), ("y", "ascending")])
    parts = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in bags.column("x").to_pylist()]
    y = (bags.column("y").to_numpy() > 0.5).astype(float)
    return train(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), y, cfg)


def score_quality(docs: DataFrame, model: AttentionModel | None, words: int = QualityConfig.words, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores (named ``score_col``, with underscores added if that is taken)."""
    name = free_name(docs, score_col)
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    params = {k: v for k, v in model.params.items()}
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = AttentionModel(params)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], names=["text"])
            scores, done = [], 0
            for part in slices(texts, "text"):
                x, lead = passages(part.column("text"), words)
                scores.append(found.forward(x, lead)["score"])
                done += part.num_rows
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, _with(docs, name))


def _with(docs: DataFrame, name: str):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])


def fold(id_col: str = "doc_id") -> Column:
    """0, 1 or 2; 1 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, fold() != 1)
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

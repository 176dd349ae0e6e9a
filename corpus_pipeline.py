"""Documents to tokens: quality, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrove.llm.bpe import encode_texts
from tidegrove.llm.common import free_name, ready_checkpoints, table
from tidegrove.llm.decontamination import find_leaks
from tidegrove.llm.line_dedup import remove_lines
from tidegrove.llm.quality import fit_quality, fold, score_quality
from tidegrove.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects (score under 0.5); it learns outside the held-out fold."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold() != 1)
    score = free_name(docs, "score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines like an earlier one from the texts; every document stays, if need be with an empty text."""
    kinds = dict(docs.dtypes)
    found = remove_lines(docs)
    new = {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.col("kept"), "n_chars": F.length("kept").cast(kinds.get("n_chars", "long"))}
    return found.select(*(new.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of least id, of each group linked by a similarity of 0.8 in shingles of five words."""
    return keep_one(docs, size=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak a benchmark item."""
    found, leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size(leaks) == 0).drop(leaks)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts and decode them again: counts and digests per document."""
    import public_tokenizers

    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Classifier, fingerprints and tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is checkpointed, as the next stage reads it several times."""
    ready_checkpoints(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = docs.checkpoint()
    return docs

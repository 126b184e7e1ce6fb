"""Corpus cleaning: quality rules, line dedup, near-dedup, benchmark decontamination, SentencePiece encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm import common, decontaminate, line_dedup, near_copies, pieces, quality, simhash


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """``df`` with the columns of ``docs``; ``n_chars`` follows the text."""
    cols = {"n_chars": F.length("text").cast("long").alias("n_chars")}
    return df.select(*[cols.get(c, F.col(c)) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do boilerplate lines of the others."""
    return _as_documents(quality.apply_rules(docs), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents stay, even where nothing is left of the text."""
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts of a similarity of 0.8 or more on five-word shingles, found by
    blocks of SimHash fingerprints."""
    return simhash.keep_one(docs, find=near_copies.near_duplicates)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids (``ids``, ``n_ids``; with marks behind where documents have such columns); ``text``
    is decoded from these. Written here, so that few long texts at a time go to Python."""
    model = pieces.model_file()
    ids, n_ids, decoded = common.unused(docs, "ids", "n_ids", "decoded")
    out = pieces.decode(pieces.encode(docs, model, out_col=ids), model, ids_col=ids, out_col=decoded)
    text = [F.col(decoded).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return common.written(out.select(*text, F.size(ids).cast("long").alias(n_ids), ids), "pipeline-pieces")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express fingerprints, edit search and segmentation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. A stage's scratch tables, and what it read, are deleted
    once its own result is written."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"pipeline-{name}")
        with common.scratch_dropped():
            docs = common.written(stage(spark, docs, sf_dir), name, path)
        if last:
            common.drop_path(spark, last)
        last = path
    return docs

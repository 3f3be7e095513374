"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents, whatever more there are and whatever they are called.

A null text is empty: the classifier judges it by its bias, it has no near copies but other empty texts, holds no
benchmark item and no personal data, and packs as its end id. Rows with null ids go through like others; of a
near-duplicate group the least id stays, null ids last, and of rows with that id any one. Repeated rows are such a group. Very long
texts are read whole by each stage. Equal scores and similarities are on the keeping side at the quality threshold, and on the linking
side at the similarity. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier scores at its threshold or more."""
    from vellum.llm import _shared, quality

    return quality.keep(docs, _shared.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    from vellum.llm import simhash

    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    from vellum.llm import _shared, decontaminate

    return decontaminate.clean(docs, _shared.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write each span's kind in its place; n_chars follows the text."""
    from vellum.llm import pii

    redacted = pii.redact(docs, pii.fit(spark))
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the pieces of all texts into sequences."""
    from vellum.llm import packing, tokens

    return packing.pack(packing.pieces(docs, tokens.default_path(), end_id=0))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# Fingerprints, a trained classifier and alignments are beyond SQL: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; the last stage's rows. A stage's own tables, and its input, go when it is written."""
    from vellum.llm import _shared

    docs, before = _shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = _shared.scratch_path(spark, f"pipeline-{name}")
        with _shared.scope(spark):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _shared.remove(spark, before)
        before = path
    return docs

"""Incremental indexing: only what a snapshot does not know yet is opened again.

A file stream would follow new paths only, so changes are found by joining listings.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vellum import scratch
from vellum.operators import changes
from vellum.plans import index
from vellum.plans.registry import Strategy, strategy
from vellum.sources import tree
from vellum.sources.catalog import Repo

SNAPSHOT = "path string, size long, mod_time timestamp"


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest listing stored at path, or an empty one."""
    try:
        every = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SNAPSHOT)
    return every.where(F.col("version") == every.agg(F.max("version")).first()[0]).select("path", "size", "mod_time")


@dataclass
class Reindex:
    """Documents of new and modified files, and all changes. commit() makes the snapshot new; call it when the documents are stored.

    Until then a repeated run finds the same changes again.
    """

    documents: DataFrame
    changes: DataFrame
    listing: DataFrame
    path: str

    def commit(self) -> None:
        spark = self.listing.sparkSession
        version = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
        self.listing.select("path", "size", "mod_time").withColumn("version", F.lit(version)).write.mode("append").parquet(self.path)


def reindex(spark: SparkSession, repo: Repo, path: str, plan: Strategy | None = None, with_chunks: bool = False) -> Reindex:
    """What has changed since the snapshot at path."""
    plan = plan or strategy(repo.application)
    now = scratch.stored(tree.entries(spark, os.path.abspath(repo.directory), plan.skip_directories), "listing")
    kept = now.where((F.col("entry") == "file") & F.col("extension").isin(plan.extensions()))
    found = scratch.stored(changes.changes(snapshot(spark, path), kept), "changes")
    fresh = kept.join(found.where(F.col("change").isin("added", "modified")).select("path"), "path", "left_semi")
    done = scratch.stored(index.outcomes(fresh, plan), "outcomes")
    return Reindex(index.documents(done, repo, plan, with_chunks), found, kept, path)

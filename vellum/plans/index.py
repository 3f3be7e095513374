"""Indexing a repository: entries, then documents, events and statistics over one scan.

The tree is listed once and written; the extension filter runs on metadata, so only files that have a
parser are opened. A file that cannot be described or read fails by itself; what its
parser objects to is kept as parse_error and does not fail it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import scratch
from vellum.errors import NOT_IN_REPO, NOT_REGULAR
from vellum.functions import paths
from vellum.operators import chunks, events
from vellum.plans.registry import Strategy, strategy
from vellum.sources import catalog, tree
from vellum.sources.catalog import Repo

# Fixed order of the columns of a document.
DOCUMENT = (
    "app_type", "chunks", "extension", "mime_type", "mod_time", "name", "path", "properties", "properties_json", "rel_path", "repo", "size", "uri", "parse_error",
)


@dataclass
class IndexResult:
    """Tables over one scan that is written to the shared folder, so that all agree whatever is lost. close() deletes it."""

    documents: DataFrame
    events: DataFrame
    stats: DataFrame
    entries: DataFrame
    outcomes: DataFrame

    def close(self) -> None:
        scratch.remove(self.outcomes)
        scratch.remove(self.entries)


def classified(entries: DataFrame, plan: Strategy) -> DataFrame:
    """Every kept file, with the error that fails it before it is opened."""
    kept = entries.where((F.col("entry") == "file") & F.col("extension").isin(plan.extensions()))
    outside = ~paths.is_local(F.col("rel_path"))
    return kept.withColumn("error", F.coalesce("stat_error", F.when(~F.col("is_regular"), F.lit(NOT_REGULAR)), F.when(outside, F.lit(NOT_IN_REPO))))


def parsed(read: DataFrame, plan: Strategy) -> DataFrame:
    """Files with content, and read_error, as their parsers read them."""
    found, out = read.withColumn("error", F.coalesce("error", "read_error")), None
    for ext, parser in sorted(plan.parsers.items()):
        part = parser.parse(found.where(F.col("extension") == ext))
        out = part if out is None else out.unionByName(part)
    return out.drop("content", "read_error")


def outcomes(entries: DataFrame, plan: Strategy) -> DataFrame:
    """Every kept file with its content's parse, or the error that failed it."""
    kept = classified(entries, plan)
    failed = kept.where(F.col("error").isNotNull()).withColumns({"content": F.lit(None).cast("binary"), "read_error": F.lit(None).cast("string")})
    return parsed(tree.with_content(kept.where(F.col("error").isNull())).unionByName(failed), plan)


def documents(found: DataFrame, repo: Repo, plan: Strategy, with_chunks: bool = False) -> DataFrame:
    """The documents of the outcomes that did not fail. Chunks stay null unless asked for."""
    own = F.struct(*[F.lit(getattr(repo, k)).alias(k) for k in ("application", "name", "directory", "config", "db")])
    ready = found.where(F.col("error").isNull()).withColumns({
        "app_type": F.lit(repo.application),
        "chunks": chunks.chunks(F.col("body"), F.col("lines_before")) if with_chunks else F.lit(None).cast(chunks.TYPE),
        "mime_type": paths.mime_type(F.col("extension")),
        "properties": F.try_parse_json("properties_json"),
        "repo": own,
        "uri": plan.uri(F.col("path")),
    })
    return plan.load(ready.select(*DOCUMENT))


def stats(entries: DataFrame, found: DataFrame, plan: Strategy) -> DataFrame:
    """One row of four counters."""
    skipped = ~F.col("extension").isin(plan.extensions()) & (F.col("entry") == "file")
    seen = entries.agg(F.count_if(F.col("entry") == "dir-skipped").alias("dirs_skipped"), F.count_if(skipped).alias("docs_skipped"))
    done = found.agg(F.count_if(F.col("error").isNull()).alias("docs_prepared"), F.count_if(F.col("error").isNotNull()).alias("docs_failed"))
    return seen.join(F.broadcast(done))  # one row each


def _index(entries: DataFrame, repo: Repo, plan: Strategy, with_chunks: bool) -> IndexResult:
    entries = scratch.stored(entries, "entries")
    found = scratch.stored(outcomes(entries, plan), "outcomes")
    return IndexResult(documents(found, repo, plan, with_chunks), events.events(entries, found, plan.extensions()), stats(entries, found, plan), entries, found)


def index_directory(spark: SparkSession, repo: Repo, plan: Strategy | None = None, with_chunks: bool = False) -> IndexResult:
    """Index the whole tree of a repository."""
    plan = plan or strategy(repo.application)
    return _index(tree.entries(spark, os.path.abspath(repo.directory), plan.skip_directories), repo, plan, with_chunks)


def index_files(spark: SparkSession, repo: Repo, file_paths: list[str], plan: Strategy | None = None, with_chunks: bool = False) -> IndexResult:
    """Index single files: no walk and no skip list; each needs a parser for its extension."""
    plan = plan or strategy(repo.application)
    return _index(tree.files(spark, [os.path.abspath(p) for p in file_paths], repo.directory), repo, plan, with_chunks)


def index_repo(spark: SparkSession, name: str, config_dir: str | None = None, with_chunks: bool = False) -> IndexResult:
    """Index a repository of the catalog by its name."""
    return index_directory(spark, catalog.load(catalog.config_dir(config_dir, spark), name), with_chunks=with_chunks)

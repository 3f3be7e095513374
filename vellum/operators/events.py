"""Events of an index run as a table.

Every file ends with exactly one of file-skipped, file-indexed and file-error. ``delivered`` marks
what a directory run hands to a callback: skips only. file-parsed stands for a parse without
objections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from vellum.functions import paths

# Every kind of event, in the order of a run. Those that nothing emits yet are last.
KINDS = (
    "dir-skipped", "file-skipped", "file-indexing", "file-parsing", "file-parsed", "file-indexed", "file-error",
    "dir-indexing", "dir-indexed", "file-embedding", "file-embedded", "file-storing", "file-stored",
)
DELIVERED = ("dir-skipped", "file-skipped")


def steps(error, described, parse_error):
    """The kinds that one kept file goes through, in order."""
    early = F.array(F.lit("file-indexing"), F.lit("file-error"))
    unread = F.array(F.lit("file-indexing"), F.lit("file-parsing"), F.lit("file-error"))
    doubted = F.array(F.lit("file-indexing"), F.lit("file-parsing"), F.lit("file-indexed"))
    clean = F.array(*[F.lit(k) for k in ("file-indexing", "file-parsing", "file-parsed", "file-indexed")])
    return F.when(~described, early).when(error.isNotNull(), unread).when(parse_error.isNotNull(), doubted).otherwise(clean)


def events(entries: DataFrame, outcomes: DataFrame, extensions: list[str]) -> DataFrame:
    """(path, rel_path, step, kind, error, delivered), a row an event; order by walk, then step."""
    dropped = (F.col("entry") == "dir-skipped") | ~F.col("extension").isin(extensions)
    skips = entries.where(dropped).select(
        "path", "rel_path", F.lit(0).alias("step"), F.when(F.col("entry") == "dir-skipped", "dir-skipped").otherwise("file-skipped").alias("kind"), F.lit(None).cast("string").alias("error")
    )
    described = F.col("stat_error").isNull() & F.col("is_regular") & paths.is_local(F.col("rel_path"))
    files = outcomes.select("path", "rel_path", "error", F.posexplode(steps(F.col("error"), described, F.col("parse_error"))).alias("step", "kind"))
    files = files.select("path", "rel_path", "step", "kind", F.when(F.col("kind") == "file-error", F.col("error")).alias("error"))
    return skips.unionByName(files).withColumn("delivered", F.col("kind").isin(*DELIVERED))


def in_order(found: DataFrame) -> DataFrame:
    """Events in the order of a walk, by a range sort."""
    return found.orderBy(paths.walk_key(F.col("rel_path")), "step")


def deliver(found: DataFrame, callback: Callable[[Row], None], every: bool = False) -> None:
    """Hand events to a callback on the driver, one partition at a time."""
    for row in in_order(found if every else found.where("delivered")).toLocalIterator(prefetchPartitions=True):
        callback(row)

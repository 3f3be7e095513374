"""What changed between two listings of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed, modified (size or time differ) or same. One join on path."""
    own = lambda df, tag: df.select("path", F.struct("size", "mod_time").alias(tag))
    both = own(before, "b").join(own(after, "a"), "path", "full")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified").otherwise("same")
    return both.select("path", kind.alias("change"))

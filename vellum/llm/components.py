"""Connected components of a link table, by alternating large-star and small-star rounds.

Kiveris et al., "Connected components in MapReduce and beyond" (2014). Links stay
in tables: each round is two aggregations and two joins on node ids, written to the
shared folder, and the rounds end when the table no longer changes. Before the rounds, parts
of at most PART links become stars inside tasks, which leaves the rounds short chains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import _shared


PART = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links but the roots, and its root, the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while ((up := label[label]) != label).any():
            label = up
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contracted(batches):
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if held:
        found = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links(a, b); the root is the least node that can be reached."""
    found = _shared.stored(links.where(F.col("a") != F.col("b")).select("a", "b"), "links")
    parts = max(1, -(-found.count() // PART))
    current = _shared.stored(found.repartition(parts).mapInArrow(_contracted, "a long, b long").distinct(), "links")
    before = _signature(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a large component's centre has a part of all links: such nodes are joined apart
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _shared.often_first(both, least, ["a"], "n", 2 * before[0]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = _shared.stored(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _shared.often_first(large, down, ["a"], "n", large.count()).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        current = _shared.stored(small.select("x.*").where(F.col("a") != F.col("b")).distinct(), "links")
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))

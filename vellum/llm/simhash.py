"""SimHash near-duplicates by a binary-trie self-join.

Equal fingerprints are one class. Classes link at ERRORS differing bits or fewer.
As ERRORS is 3, two linked fingerprints agree on at least one of four 16-bit blocks,
so each block's value gives a subtrie that is joined with itself on its own:
node pairs go down together, carry the bits in which they differ, and are dropped
beyond the budget. A pair of subtries whose keys are all linked already is dropped
too, so a dense group of m near copies gives m - 1 links and not m * m.
Subtries of more than HOT keys are cut again by four blocks of their other 48 bits.

Nulls: a null text is empty, and texts without words have fingerprint zero, which
links like any other. A row with a null doc_id gets its group's component; a group of
only such rows has component null. Repeated ids are rows of their own; ties of ids in a group are no ties of the
result, which is the least id. Very long texts are read whole. Other columns are not read, whatever their names, and
``deduplicate`` keeps them. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import _shared, components, sketches
from vellum.llm.trie import Trie

WORDS = 3
SEED = 42
ERRORS = 3
BLOCK_BITS = 16
HOT = 50_000
BATCH = 100_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bits set in over half of the hashes of the text's word shingles."""
    seq = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not seq:
        return 0
    shingles = map(b" ".join, zip(*(seq[k:] for k in range(words)), strict=False)) if len(seq) >= words else [b" ".join(seq)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and its 64-bit fingerprint as a signed long."""

    def rows(batches):
        for batch in _shared.slices(batches):
            found = np.array([fingerprint(t or "", words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, fp long")


def _subtries(batches):
    """Runs of equal (block, value, cut) in sorted rows; each is joined with itself."""
    held: list[tuple[np.ndarray, ...]] = []

    def joined(columns):
        block, keys = columns[0], columns[3]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
        lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
        some = hi - lo > 1
        links = Trie(keys, BLOCK_BITS, ERRORS).join(lo[some], hi[some]) if some.any() else []
        i, j = (np.array(x, dtype=np.int64) for x in zip(*links, strict=True)) if links else (np.empty(0, np.int64),) * 2
        back = lambda at: _rotated(keys[at], -BLOCK_BITS * block[at]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back(i)), pa.array(back(j))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("block", "value", "cut")]
        held.append((*new, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)))
        if sum(len(x[0]) for x in held) >= BATCH:
            whole = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            last = np.all([c == c[-1] for c in whole[:3]], axis=0)
            at = len(last) if not (~last).any() else int(np.flatnonzero(~last)[-1]) + 1
            held = [tuple(c[at:] for c in whole)] if at < len(last) else [whole]
            if at < len(last):
                yield joined(tuple(c[:at] for c in whole))
    if held and sum(len(x[0]) for x in held):
        yield joined(tuple(np.concatenate(c) for c in zip(*held, strict=True)))


def _rotated(keys: np.ndarray, left: np.ndarray) -> np.ndarray:
    k = (left % 64).astype(np.uint64)
    return np.where(k == 0, keys, (keys << k) | (keys >> ((np.uint64(64) - k) & np.uint64(63))))


def links(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the budget; classes has distinct fp."""
    n = _shared.partitions(classes.sparkSession)
    turned = lambda b: F.col("fp") if b == 0 else F.shiftleft("fp", 16 * b).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * b))
    rows = classes.select(F.explode(F.array(*[F.struct(F.lit(b).alias("block"), turned(b).alias("k")) for b in range(4)])).alias("x"))
    rows = rows.select("x.block", F.shiftrightunsigned("x.k", 48).cast("int").alias("value"), "x.k")
    # at most 4 * 2**16 blocks' values exist, so this side of the join has a fixed bound
    large = rows.groupBy("block", "value").count().where(F.col("count") > hot).select("block", "value", F.lit(True).alias("large"))
    part = lambda c: F.shiftrightunsigned("k", 12 * c).bitwiseAND(F.lit(0xFFF)) + F.lit(4096 * c)
    cut = F.when(F.col("large"), F.array(*[part(c).cast("int") for c in range(4)])).otherwise(F.array(F.lit(-1)))
    return (
        rows.join(F.broadcast(large), ["block", "value"], "left")
        # the sign bit is turned so that signed order is the trie's order
        .select("block", "value", F.explode(cut).alias("cut"), F.col("k").bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("key"))
        .repartition(n, "block", "value", "cut")
        .sortWithinPartitions("block", "value", "cut", "key")
        .mapInArrow(_subtries, "a long, b long")
    )


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    found = _shared.stored(fingerprints(docs, words), "fingerprints")
    classes = _shared.stored(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components.components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = _shared.stored(rooted.join(least, "root").select("fp", "n", "component_id"), "named")
    total = classes.agg(F.sum("n")).first()[0] or 0
    return _shared.often_first(found, named, ["fp"], "n", total)


def deduplicate(docs: DataFrame, similarity: float = sketches.SIMILARITY) -> DataFrame:
    """The rows of docs, columns as they are, that stand for their group: the least doc_id, of equal ones any one row.

    Groups are connected by exact similarities of five-word shingles (see sketches).
    docs must read the same rows in the same order each time, as a written table does.
    """
    name = _shared.free_name(docs, "vellum_row")
    numbered = docs.select("*", F.monotonically_increasing_id().alias(name))
    id = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))  # null ids come last
    found = _shared.stored(sketches.sketched(numbered.select(F.col(name).alias("row"), id.alias("id"), "text")), "sketches")
    classes = found.groupBy("node").agg(F.min("id").alias("id"), F.min_by("row", "id").alias("row"))
    near = sketches.links(found.dropDuplicates(["node"]), similarity)
    roots = components.components(near).withColumnRenamed("root", "group")
    grouped = classes.join(roots, "node", "left").groupBy(F.coalesce("group", "node")).agg(F.min_by("row", "id").alias(name))
    kept = _shared.stored(grouped.select(name), "kept")
    return numbered.join(kept.hint("merge"), name, "left_semi").select(*_shared.own_columns(docs))


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

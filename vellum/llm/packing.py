"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Every partition packs its own pieces best-fit, longest first. Bins that are nearly
full are done. In what best-fit leaves, no two bins of a partition fit together, so all but
one are more than half full: the underfull ones (at most one a partition) are merged up a tree, FAN
partitions' bins in one, as items of repeated best-fit rounds. Each meets the open bins of every fill; of one
fill a partition takes as many as it has underfull bins at most, as more of them cannot be used. The
rounds end when one partition has held all underfull bins: then no two bins fit together that a
round could have joined, and what is open is done. What is left in ITEMS bins or fewer is packed at
once in the end.

Nulls: a null text has the end id alone; a null doc_id is a document like others, its pieces first among equal
lengths. Ties go by (doc_id, piece); equal rows are packed as separate pieces. Very long texts become many pieces, of
which all but the last are sequences of their own. Other columns are not read, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm import _shared, tokens

CAPACITY = 2048
ITEMS = 60_000
SLACK = 4
SALTS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "number long, fill int, done boolean, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document; only documents over the capacity are cut."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches):
        model = tokens.encoder(path)
        for batch in _shared.slices(batches):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), model.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                for k in range(0, len(ids) // 4, capacity):
                    part = ids[4 * k : 4 * (k + capacity)]
                    out.append((doc_id, k // capacity, k, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes come longest first. Bins of equal room are a stack."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that some bin has, ascending
    bins, where = 0, []
    for size in sizes:
        k = bisect.bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            at = stacks[room].pop()
            if not stacks[room]:
                rooms.pop(k)
        else:
            room, at, bins = capacity, bins, bins + 1
        where.append(at)
        if room > size:
            room -= size
            if not stacks[room]:
                bisect.insort(rooms, room)
            stacks[room].append(at)
    return where


def _packed(at: int, capacity: int, slack: int, last: bool):
    """One partition's part of round ``at``: items of ``fill`` with their members become bins."""

    def group(key, frame):
        rows = frame.select(["fill", "members"]).to_pylist()
        first = lambda r: [(m["doc_id"] is not None, m["doc_id"] or 0, m["piece"]) for m in r["members"][:1]]
        rows.sort(key=lambda r: (-r["fill"], first(r)))
        members: dict[int, list] = {}
        fills: dict[int, int] = {}
        for r, k in zip(rows, best_fit([r["fill"] for r in rows], capacity), strict=True):
            members.setdefault(k, []).extend(r["members"])
            fills[k] = fills.get(k, 0) + r["fill"]
        number = ((at << 24) + key[0].as_py()) << 28
        out = [{"number": number + k, "fill": fills[k], "done": last or capacity - fills[k] <= slack, "members": m} for k, m in members.items()]
        return pa.Table.from_pylist(out, schema=SCHEMA)

    return group


MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
SCHEMA = pa.schema([("number", pa.int64()), ("fill", pa.int32()), ("done", pa.bool_()), ("members", pa.list_(MEMBER))])


def _first(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """rows with n, their number among those that agree in ``by``; in two steps, so that no group is sorted in one task."""
    order = F.xxhash64("number")
    salt = F.pmod(order, F.lit(SALTS)).alias("salt")
    salted = rows.select("*", salt).withColumn("n", F.row_number().over(Window.partitionBy(*by, "salt").orderBy(order, "number"))).drop("salt")
    few = salted.where(F.col("n") <= most).withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order, "number")))
    return few.unionByName(salted.where(F.col("n") > most))


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = ITEMS, slack: int = SLACK) -> DataFrame:
    """Pieces with sequence_id and offset; pieces of the full capacity are sequences of their own."""
    items = _shared.stored(items, "pieces")
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    finished = [items.where(F.col("length") >= capacity).select((-1 - F.monotonically_increasing_id()).alias("number"), F.array(member).alias("members"))]
    opened = items.where(F.col("length") < capacity).select(F.lit(0).cast("long").alias("number"), F.col("length").cast("int").alias("fill"), F.array(member).alias("members"))
    fan, n, at = max(2, per_partition // capacity), opened.count(), 0
    while n:
        whole, rest = n <= per_partition, None
        if whole:
            chosen, last = opened.withColumn("part", F.lit(0).cast("long")), True
        elif not at:
            parts = -(-n // per_partition)
            chosen, last = opened.withColumn("part", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(parts))), False
        else:
            under = F.col("fill") * 2 <= capacity
            few = opened.where(under).count()
            parts = -(-few // fan)
            last = parts <= 1
            if not few:
                finished.append(opened.select("number", "members"))
                break
            dealt = opened.withColumn("part", F.pmod(F.xxhash64("number", F.lit(at)), F.lit(parts)))
            met = _shared.stored(_first(dealt.where(~under), fan, "part", "fill"), f"met-{at}")
            chosen = dealt.where(under).unionByName(met.where(F.col("n") <= fan).drop("n"))
            rest = met.where(F.col("n") > fan).select("number", "fill", "members")
        bins = _shared.stored(chosen.groupBy("part").applyInArrow(_packed(at, capacity, slack, last), BINS), f"bins-{at}")
        finished.append(bins.where("done").select("number", "members"))
        opened = bins.where(~F.col("done")).select("number", "fill", "members")
        if last:
            finished += [rest.select("number", "members")] if rest is not None else []
            break
        opened = opened if rest is None else opened.unionByName(rest)
        n, at = opened.count(), at + 1
    every = finished[0]
    for more in finished[1:]:
        every = every.unionByName(more)
    return every.select(F.col("number").alias("sequence_id"), "members").mapInArrow(_opened, f"{PIECES}, sequence_id long, offset long")


def _opened(batches):
    """A row for each member of a bin, with the lengths before it as its offset."""
    for batch in batches:
        lists = batch.column("members")
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        length = flat.field("length").to_numpy(zero_copy_only=False)
        before = np.cumsum(length) - length
        first = np.cumsum(sizes) - sizes
        offset = before - np.repeat(before[first[sizes > 0]], sizes[sizes > 0])
        number = np.repeat(batch.column("sequence_id").to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(number), pa.array(offset)], names=[*[f.name for f in MEMBER], "sequence_id", "offset"])


def op7_best_fit(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(pieces(_shared.table(spark, sf_dir, "documents"), tokenizer or tokens.default_path(), end_id=0))

"""Sharding by fixed virtual slots, with DataFrame functions only.

Records are hashed by text into thousands of slots, bytes and rows are summed for
each slot (a table of ``slots`` rows, whatever the data's size), and a versioned
slot-to-shard map, stored as a table, gives every slot to one shard. Rebalancing reads the newest
version, moves whole slots and stores the next one, so no other record changes its shard.

Groups are equal texts. They share a slot, and so a shard, unless a group alone has more than
1 / SPLIT of a shard's even part of the bytes: no map of whole slots could then keep sizes near
equal, as the law ``bytes`` demands, and such a group (there are fewer than SPLIT a shard) is
dealt over all slots by its records' ids. Records that agree in id and text are dealt by their place in
the stored table of records, so that no key, null included, gathers rows in one task.

Nulls: a null text has no bytes (size 8, crc32 of nothing) and is one text with the empty one; null ids are
ids like any other, first in their slot. Repeated rows are records of their own; ties in a slot's order (id,
size, crc32) are rows that agree in every result column. Very long texts are one record of one slot, which the map
gives to the emptiest shard. An empty table gives an empty result. Columns of the input other than the id and
the text are ignored, whatever their names; ``write_shards`` keeps them.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm import _shared

SLOTS = 8192
OVERHEAD = 8
SPLIT = 2
SHARDS = 24


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot]; every edit makes a new version and keeps the edits made."""

    shard_of: tuple[int, ...]
    shards: int
    version: int = 1
    edits: tuple[tuple[int, int, int, int], ...] = field(default=())  # version, slot, from, to

    def moved(self, moves: dict[int, int], shards: int | None = None) -> SlotMap:
        new = list(self.shard_of)
        log = []
        for slot, to in sorted(moves.items()):
            log.append((self.version + 1, slot, new[slot], to))
            new[slot] = to
        return SlotMap(tuple(new), shards or self.shards, self.version + 1, self.edits + tuple(log))

    def store(self, spark: SparkSession, path: str) -> None:
        """Write this version below path. Writing it once more changes nothing."""
        rows = spark.createDataFrame([(s, k, self.shards) for s, k in enumerate(self.shard_of)], "virtual_slot int, shard int, shards int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(r["version"] for r in spark.read.parquet(path).select("version").distinct().collect())


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, by default the newest, with the edits since the first one. A version has a row a slot."""
    every = [v for v in versions(spark, path) if version is None or v <= version]
    maps = []
    for v in every:
        rows = spark.read.parquet(path).where(F.col("version") == v).orderBy("virtual_slot").collect()
        maps.append((v, tuple(r["shard"] for r in rows), rows[0]["shards"]))
    edits = []
    for (_, old, _), (v, new, _) in zip(maps, maps[1:], strict=False):
        edits += [(v, slot, a, b) for slot, (a, b) in enumerate(zip(old, new, strict=True)) if a != b]
    return SlotMap(maps[-1][1], maps[-1][2], maps[-1][0], tuple(edits))


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: heaviest slots first, each to the shard with the fewest bytes so far; empty slots are dealt in turn."""
    heap = [(0, k) for k in range(shards)]
    shard_of = [slot % shards for slot in range(slots)]
    for slot in sorted((s for s in range(slots) if loads.get(s)), key=lambda s: (-loads[s], s)):
        used, shard_of[slot] = heapq.heappop(heap)
        heapq.heappush(heap, (used + loads[slot], shard_of[slot]))
    return SlotMap(tuple(shard_of), shards)


def rebalance(current: SlotMap, loads: dict[int, int], tolerance: float = 0.0) -> SlotMap:
    """Edit the map until no move of one slot from the fullest to the emptiest shard narrows their gap."""
    used = [0] * current.shards
    for slot, k in enumerate(current.shard_of):
        used[k] += loads.get(slot, 0)
    held: list[set[int]] = [set() for _ in used]
    for slot, k in enumerate(current.shard_of):
        if loads.get(slot, 0):
            held[k].add(slot)
    moves: dict[int, int] = {}
    for _ in range(4 * len(current.shard_of)):
        full, thin = max(range(len(used)), key=used.__getitem__), min(range(len(used)), key=used.__getitem__)
        gap = used[full] - used[thin]
        if gap <= tolerance * sum(used) / len(used):
            break
        slot = min((s for s in held[full] if loads[s] < gap), key=lambda s: (abs(gap - 2 * loads[s]), s), default=None)
        if slot is None:
            break
        held[full].discard(slot), held[thin].add(slot)
        used[full] -= loads[slot]
        used[thin] += loads[slot]
        moves[slot] = thin
    return current.moved(moves) if moves else current


def grow(current: SlotMap, loads: dict[int, int]) -> SlotMap:
    """One more shard, which takes slots from the fullest shards; no slot moves between old shards."""
    used = [0] * current.shards
    held: list[list[int]] = [[] for _ in used]
    for slot in sorted(range(len(current.shard_of)), key=lambda s: (loads.get(s, 0), s)):
        used[current.shard_of[slot]] += loads.get(slot, 0)
        held[current.shard_of[slot]].append(slot)
    share, new, moves = sum(used) / (current.shards + 1), 0, {}
    while True:
        full = max(range(current.shards), key=used.__getitem__)
        slot = held[full].pop() if held[full] else None
        if slot is None or new + loads.get(slot, 0) > share:
            break
        new += loads.get(slot, 0)
        used[full] -= loads.get(slot, 0)
        moves[slot] = current.shards
    return current.moved(moves, current.shards + 1)


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, text_hash and spread of every record, written once: the texts are read a single time."""
    text = _shared.whole_text()
    sized = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    # the files that are read back are the same each time, and so is a record's place in them
    return _shared.stored(sized, "records").withColumn("spread", F.xxhash64("doc_id", F.monotonically_increasing_id()))


def large_groups(sized: DataFrame, shards: int, slots: int = SLOTS) -> list[int]:
    """Hashes of the texts whose records have more than 1 / SPLIT of a shard's part of all bytes: fewer than SPLIT * shards."""
    by_slot = slot_loads(sized.withColumn("virtual_slot", F.pmod("text_hash", F.lit(slots)).cast("int")))
    loads = {r["virtual_slot"]: r["bytes"] for r in by_slot.collect()}  # at most `slots` rows
    most = sum(loads.values()) / (shards * SPLIT)
    full = [s for s, b in loads.items() if b > most]
    if not full:
        return []
    inside = sized.where(F.pmod("text_hash", F.lit(slots)).isin(full))
    return [r["text_hash"] for r in inside.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > most) & (F.col("n") > 1)).collect()]


def slotted(sized: DataFrame, large: list[int], slots: int = SLOTS) -> DataFrame:
    """records with their virtual_slot: by text, or by id and place for the large groups."""
    own = F.when(F.col("text_hash").isin(large), F.col("spread")).otherwise(F.col("text_hash")) if large else F.col("text_hash")
    return sized.withColumn("virtual_slot", F.pmod(own, F.lit(slots)).cast("int"))


def slot_loads(sized: DataFrame) -> DataFrame:
    return sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def mapped(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, SlotMap, dict[int, int]]:
    """Records with their slots, the newest map stored at path, and the rows of each slot.

    Without a stored map the first version is made; where an edit would make the shards more even, the next version is
    stored too. What is used is always what is read back.
    """
    spark = docs.sparkSession
    sized = records(docs)
    sized = slotted(sized, large_groups(sized, shards, slots), slots)
    found = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in slot_loads(sized).collect()}  # at most `slots` rows
    loads = {s: b for s, (b, _) in found.items()}
    if not _shared.exists(spark, path):
        first_map(loads, shards, slots).store(spark, path)
    current = read_map(spark, path)
    edited = rebalance(current, loads)
    if edited.version != current.version:
        edited.store(spark, path)
        edited = read_map(spark, path)
    return sized, edited, {s: n for s, (_, n) in found.items()}


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Every record with its shard and its gapless place there, and the map in force, stored at path.

    A place is the count of rows in the shard's earlier slots plus the row's
    number in its slot, so rows are numbered in thousands of windows and never a
    shard at a time.
    """
    spark = docs.sparkSession
    sized, slot_map, counts = mapped(docs, path or _shared.scratch_path(spark, "slot-map"), shards, slots)
    before, rows = [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        rows.append((slot, shard, before[shard]))
        before[shard] += counts.get(slot, 0)
    places = spark.createDataFrame(rows, "virtual_slot int, shard int, before long")  # `slots` rows of 16 bytes
    own = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    placed = (
        sized.withColumn("n", F.row_number().over(own).cast("long") - 1)
        .join(F.broadcast(places), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("n")).alias("slot"), "virtual_slot")
    )
    return placed, slot_map


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """Write whole rows by shard below path/data, by the newest map at path/map, which is made or edited as the loads ask.

    docs must read the same rows in the same order each time, as a written table does.
    """
    _, slot_map, _ = mapped(docs, f"{path}/map", shards, slots)
    large = large_groups(records(docs), slot_map.shards, slots)
    name = _shared.free_name(docs, "vellum_shard")
    hashed = F.xxhash64(_shared.whole_text())
    own = F.when(hashed.isin(large), F.xxhash64("doc_id", F.monotonically_increasing_id())).otherwise(hashed) if large else hashed
    shard_of = F.split(F.lit(",".join(map(str, slot_map.shard_of))), ",").cast("array<int>")
    slot = F.pmod(own, F.lit(slots)).cast("int")
    (
        docs.select(*_shared.own_columns(docs), F.element_at(shard_of, slot + 1).alias(name))
        .repartition(_shared.partitions(docs.sparkSession), hashed)
        .write.mode("overwrite")
        .partitionBy(name)
        .parquet(f"{path}/data")
    )
    return slot_map


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slot_map = assign(_shared.table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )

"""Similarity of texts by five-word shingles, for near-duplicate groups at a stated similarity.

A sketch is a 64-bit SimHash and MINIMA least hashes of a text's set of shingles; it only proposes.
Texts of Jaccard similarity s agree on each of BANDS keys of ROWS least hashes with probability
s ** ROWS, which at 0.8 leaves one pair in 1.7 million without a common key. Texts of a common key
are joined by the binary trie of their SimHashes with a budget of ERRORS bits, and a pair within it is a
candidate if the share of equal least hashes reaches the similarity less MARGIN, five standard
errors of that share. Every pair of texts that candidates connect is then held to the similarity of
the sets of shingles themselves, unless links of that similarity connect the two already.

Keys shared by more than HOT texts, and candidate groups of more than GROUP texts, are dealt in parts, and
each two parts meet in one task: no task grows with a group, and no pair is left out.

Nulls: a null text is empty; texts without words are one node, as are all of equal sets of shingles, so repeated rows and
ties in similarity need no order. Fewer words than WORDS are one shingle. Very long texts are read whole. Of other columns
row and id are carried along. An empty table gives no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import _shared, components
from vellum.llm.trie import Trie

WORDS = 5
SIMILARITY = 0.8
MARGIN = 0.13
MINIMA = 256
BANDS, ROWS = 20, 3
ERRORS = 32
HOT = 20_000
GROUP = 2_000
DOCUMENTS = 400
BATCH = 60_000

# Odd multipliers, one for each least hash and shingle place, by a fixed rule.
_MIX = np.array([xxhash.xxh64_intdigest(k.to_bytes(2, "little"), 11) | 1 for k in range(MINIMA)], dtype=np.uint64)
_PLACE = np.array([xxhash.xxh64_intdigest(k.to_bytes(2, "little"), 12) | 1 for k in range(WORDS)], dtype=np.uint64)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in a row, and each text's count: fewer words are one shingle, none are one of value 0."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    own = list(set().union(*split))
    at = dict(zip(own, range(len(own)), strict=True))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    out = []
    for words in split:
        h = hashes[np.fromiter(map(at.__getitem__, words), np.int64, len(words))] if words else np.zeros(0, np.uint64)
        n = min(len(h), WORDS)
        value = np.zeros(max(1, len(h) - WORDS + 1), np.uint64)
        for k in range(n):
            value = (value ^ (value >> np.uint64(31))) * _PLACE[k] + h[k : k + len(value)]
        value ^= value >> np.uint64(33)
        value *= np.uint64(0xFF51AFD7ED558CCD)
        out.append(value ^ (value >> np.uint64(32)))
    return np.concatenate(out), np.array([len(x) for x in out])


def distinct(texts: list[str | None]) -> list[np.ndarray]:
    """The set of each text's shingles, sorted: how often one occurs does not count, as in the similarity."""
    flat, sizes = shingles(texts)
    return [np.unique(x) for x in np.split(flat, np.cumsum(sizes)[:-1])]


def sketch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The SimHashes of the texts' sets of shingles, and their least hashes (a row for each text)."""
    return _sketch(distinct(texts))


def _sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    start = np.cumsum(sizes) - sizes
    least = np.stack([np.minimum.reduceat((flat ^ (flat >> np.uint64(29))) * m, start) for m in _MIX], axis=1)
    bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, start, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel(), least


def _keys(least: np.ndarray) -> np.ndarray:
    """BANDS keys of each text."""
    out = np.zeros((len(least), BANDS), np.uint64)
    for k in range(ROWS):
        out = (out ^ (out >> np.uint64(31))) * _PLACE[k] + least[:, k : k + BANDS * ROWS : ROWS]
    return out.view(np.int64)


def sketched(texts: DataFrame) -> DataFrame:
    """texts(row, id, text) as row, id, node, fp, bands, signature, text; equal sets of shingles have one node."""

    def rows(batches):
        for part in _shared.slices(batches, DOCUMENTS):
            sets = distinct(part.column("text").to_pylist())
            fp, least = _sketch(sets)
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
            signature = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
            columns = [
                part.column("row"), part.column("id"), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)),
                pa.array(_keys(least).tolist(), pa.list_(pa.int64())), pa.array([x.tobytes() for x in signature], pa.binary()), part.column("text"),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "node", "fp", "bands", "signature", "text"])

    return texts.select("row", "id", "text").mapInArrow(rows, "row long, id long, node long, fp long, bands array<long>, signature binary, text string")


def _dealt(rows: DataFrame, keys: list[str], most: int, columns: list[str]) -> DataFrame:
    """rows, which have the number n of their key's rows, in tasks' order: key, part, other part, SimHash.

    Keys of more than ``most`` rows are dealt in parts of about that many by node; a row goes to each
    two parts of which one is its own.
    """
    parts = F.ceil(F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda k: (parts == 1) | (k != own))
    both = F.transform(others, lambda k: F.struct(F.least(k, own).alias("part"), F.greatest(k, own).alias("other")))
    order = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # signed order as the trie's
    dealt = rows.select(*keys, "fp", *columns, F.explode(both).alias("x")).select(*keys, "x.part", "x.other", order.alias("fp"), *columns)
    by = [*keys, "part", "other"]
    return dealt.repartition(_shared.partitions(rows.sparkSession), *by).sortWithinPartitions(*by, "fp")


def candidates(nodes: DataFrame, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect all nodes whose sketches may be of the similarity; nodes has distinct node."""
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    counts = _shared.stored(keys.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1).withColumn("total", F.col("n")), "keys")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # only keys that several nodes have take the sketches along
    shared = _shared.often_first(keys, counts, ["band", "key"], "n", total).groupBy("node").agg(F.collect_list(F.struct("band", "key", F.col("total").alias("n"))).alias("x"))
    rows = nodes.select("node", "fp", "signature").join(shared, "node").select("node", "fp", "signature", F.inline("x"))
    return _dealt(rows, ["band", "key"], hot, ["node", "signature"]).mapInArrow(_joined(2, similarity - MARGIN), "a long, b long")


def links(nodes: DataFrame, similarity: float = SIMILARITY, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """Links (a, b), each of the similarity, that connect all nodes that have it; nodes has distinct node."""
    group = min(group, hot)
    roots = _shared.stored(components.components(candidates(nodes, similarity, hot)).withColumnRenamed("root", "group"), "candidates")
    sizes = roots.groupBy("group").agg(F.count("*").alias("n")).withColumn("total", F.col("n"))
    total = roots.count()
    members = _shared.often_first(roots, sizes, ["group"], "n", total).withColumnRenamed("total", "n")
    rows = nodes.select("node", "fp", "signature", "text").join(members, "node")
    return _dealt(rows, ["group"], group, ["node", "signature", "text"]).mapInArrow(_joined(1, similarity - MARGIN, similarity), "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, sorted, have this Jaccard similarity or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _joined(keys: int, least: float, similarity: float | None = None):
    """Each run of equal keys and parts in sorted rows is joined with itself: by sketches, and by sets if a similarity is given."""
    first = keys + 2  # the key's columns, part and other; then fp, node, signature, text

    def batch_links(columns):
        fp, node, signature, *text = columns[first:]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:first]], axis=0)) + 1
        lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
        some = hi - lo > 1
        agree = lambda i, j: (signature[i] == signature[j]).mean(axis=1) >= least
        exact = None
        if text:
            sets = [x for at in range(0, len(fp), DOCUMENTS) for x in distinct(text[0][at : at + DOCUMENTS].tolist())]
            exact = lambda i, j: similar(sets[i], sets[j], similarity)
        found = Trie(fp, 0, ERRORS, agree, exact).join(lo[some], hi[some]) if some.any() else []
        i, j = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    def rows(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(first + 2)]
            own[first] = own[first].view(np.uint64) ^ np.uint64(1 << 63)
            own.append(np.frombuffer(b"".join(batch.column(first + 2).to_pylist()), np.uint8).reshape(-1, MINIMA))
            if similarity is not None:
                own.append(np.array(batch.column(first + 3).to_pylist() + [None], dtype=object)[:-1])
            held.append(own)
            n += batch.num_rows
            if n < (BATCH if similarity is None else GROUP):
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            before = np.flatnonzero(~np.all([c == c[-1] for c in whole[:first]], axis=0))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:  # the last run may go on in the next batch
                yield batch_links([c[:cut] for c in whole])
            held = [[c[cut:] for c in whole]]
            n = len(whole[0]) - cut
        if n:
            yield batch_links([np.concatenate(c) for c in zip(*held, strict=True)])

    return rows

"""Benchmark decontamination: rare gapped n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and underscores in lower case, so signs, case and
line breaks do not hide a copy. The corpus is counted once for the words that
benchmark items use. A seed is two words of an item that lie at most SPAN words apart, and it
is met where a document has both in that order at most REACH words apart: a copy keeps
seeds though every third word is replaced, left out or moved by an insertion. An item's seeds
are those that chance makes rarest: all whose words' shares multiply to less than CHANCE, and
always the rarest half, so that an item keeps seeds however common its words or its
copies are. Every seed that occurs in a document opens a window around the place where
the item would lie. A window whose words cannot reach THRESHOLD even in the best order
is let go; with the others the item is aligned by Smith-Waterman over words, a match worth
its word's rarity and a mismatch or gap costing GAP. The score is the best local
alignment's part of the item's full worth; THRESHOLD and above is contamination.

An item worth less than LEAST in all (a probability of one in 10 ** LEAST that chance puts it at a
place) would convict texts that merely share a phrase: it is not judged, and ``worths`` tells which
items those are.

Items are read in blocks of at most BLOCK words; only one block's words, seeds and
counts go to the tasks at a time, so what is broadcast is bounded. Word counts are always taken over
all rows that came in, so the blocks do not change any result.

Nulls: a null text or one without words matches nothing; items without words have no seeds; a
null item_id or doc_id is carried along. Equal items are matched apart, and repeated rows are rows of
their own. Of several best alignments of one item the first in the text gives the end. Very long texts are
matched whole, very long items are a block of their own. Other columns are not read, whatever
their names, and ``clean`` keeps them. Empty tables give no rows; without items all rows are clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import _shared

SPAN, REACH = 2, 3
CHANCE = 1e-8
GAP = 1.0
THRESHOLD = 0.45
LEAST = 10.0
BLOCK = 200_000
DOCUMENTS = 1000
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Block:
    """Some benchmark items over their own vocabulary."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.item_ids = [i for i, _ in items]
        own = sorted({w for _, ws in items for w in ws})
        self.at = {w: k for k, w in enumerate(own)}
        self.items = [np.array([self.at[w] for w in ws], dtype=np.int64) for _, ws in items]

    def local(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Every word of the texts in a row as its place in the vocabulary or -1, and the texts' word counts."""
        split = [words(t) for t in texts]
        get, out = self.at.get, np.empty(sum(map(len, split)), dtype=np.int64)
        start = 0
        for ws in split:
            out[start : start + len(ws)] = [get(w, -1) for w in ws]
            start += len(ws)
        return out, np.fromiter(map(len, split), np.int64, len(split))


@dataclass
class Match:
    item: int
    score: float
    seeds: int
    end: int


class Matcher(Block):
    def __init__(self, block: Block, counts: np.ndarray, total: int):
        self.item_ids, self.at, self.items = block.item_ids, block.at, block.items
        share = (counts + 0.5) / (total + 1.0)
        self.worth = np.clip(-np.log10(share), 1.0, 8.0)
        self.full = np.array([float(self.worth[item].sum()) for item in self.items])
        keys, owner, place = [], [], []
        for k, item in enumerate(self.items):
            if self.full[k] < LEAST:
                continue
            pairs = [(np.arange(len(item) - gap), gap) for gap in range(1, SPAN + 1) if len(item) > gap]
            first = np.concatenate([at for at, _ in pairs]) if pairs else np.empty(0, np.int64)
            second = first + (np.repeat([gap for _, gap in pairs], [len(at) for at, _ in pairs]) if pairs else 0)
            chance = np.log10(share)[item[first]] + np.log10(share)[item[second]]
            rare = (chance < np.log10(CHANCE)) | (chance <= np.median(chance)) if len(first) else np.empty(0, bool)
            keys.append(item[first][rare] * len(self.at) + item[second][rare])
            owner.append(np.full(int(rare.sum()), k))
            place.append(first[rare])
        keys, owner, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, owner, place))
        order = np.argsort(keys, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.distinct, self.first, self.times = np.unique(keys[order], return_index=True, return_counts=True)
        self.opens = np.zeros(len(self.at), dtype=bool)
        if len(self.distinct):
            self.opens[self.distinct // len(self.at)] = True

    def hits(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions (in flat) and rows of the seed table, for all texts at once."""
        ends = np.repeat(np.cumsum(sizes), sizes)
        known = np.flatnonzero(flat >= 0)
        known = known[self.opens[flat[known]]]
        at, seed = [], []
        for gap in range(1, REACH + 1):
            some = known[known + gap < ends[known]]
            some = some[flat[some + gap] >= 0]
            own = flat[some] * len(self.at) + flat[some + gap]
            k = np.minimum(np.searchsorted(self.distinct, own), len(self.distinct) - 1)
            found = self.distinct[k] == own
            some, k = some[found], k[found]
            n_rows = self.times[k]
            at.append(np.repeat(some, n_rows))
            seed.append(np.repeat(self.first[k] - (np.cumsum(n_rows) - n_rows), n_rows) + np.arange(int(n_rows.sum())))
        return np.concatenate(at), np.concatenate(seed)

    def may_reach(self, item: int, window: np.ndarray) -> bool:
        """Whether the window's words, in whatever order and with no cost, are worth THRESHOLD of the item."""
        own = self.items[item]
        return self.worth[own[np.isin(own, window)]].sum() >= THRESHOLD * self.full[item]

    def align(self, item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
        """Best local alignment's worth and its end in the window."""
        worth, slope = self.worth[item], GAP * np.arange(len(window) + 1)
        row, best, end = np.zeros(len(window) + 1), 0.0, 0
        for word, value in zip(item, worth, strict=True):
            step = np.maximum(row - GAP, 0.0)
            step[1:] = np.maximum(step[1:], row[:-1] + np.where(window == word, value, -GAP))
            row = np.maximum.accumulate(step + slope) - slope
            k = int(row.argmax())
            if row[k] > best:
                best, end = float(row[k]), k
        return best, end

    def match(self, texts: list[str | None]) -> list[list[Match]]:
        """For each text its contaminating items, best alignment of each."""
        flat, sizes = self.local(texts)
        out: list[list[Match]] = [[] for _ in texts]
        if not len(self.distinct) or not len(flat):
            return out
        at, seed = self.hits(flat, sizes)
        ends = np.cumsum(sizes)
        text, item = np.searchsorted(ends, at, side="right"), self.owner[seed]
        begin = at - self.place[seed]
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        edge = np.flatnonzero((text[1:] != text[:-1]) | (item[1:] != item[:-1])) + 1
        for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(text)]]), strict=True):
            if a == b:
                continue
            t, own = int(text[a]), self.items[item[a]]
            pad = len(own) // 2 + 4
            low, high = int(ends[t] - sizes[t]), int(ends[t])
            found = Match(int(item[a]), 0.0, int(b - a), 0)
            starts = begin[a:b]
            cut = np.flatnonzero(np.diff(starts) > len(own) + 2 * pad) + 1
            for run in np.split(starts, cut):
                first, last = max(low, int(run[0]) - pad), min(high, int(run[-1]) + len(own) + pad)
                if not self.may_reach(int(item[a]), flat[first:last]):
                    continue
                value, end = self.align(own, flat[first:last])
                if value > found.score:
                    found.score, found.end = value, first + end - low
            found.score /= self.full[item[a]]
            if found.score >= THRESHOLD:
                out[t].append(found)
        return out


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[Block]:
    """The benchmark in blocks of at most ``size`` words, or one longer item."""
    held, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ws = words(r["text"])
        if held and n + len(ws) > size:
            yield Block(held)
            held, n = [], 0
        held.append((r["item_id"], ws))
        n += len(ws)
    if held:
        yield Block(held)


def matcher(docs: DataFrame, block: Block) -> Matcher:
    """The block with its words counted over all docs; a row a word and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def rows(batches):
        own = shared.value
        counts, total = np.zeros(len(own.at), dtype=np.int64), 0
        for part in _shared.slices(batches, DOCUMENTS):
            flat, _ = own.local(part.column("text").to_pylist())
            counts += np.bincount(flat[flat >= 0], minlength=len(counts))
            total += len(flat)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], total))], names=["word", "n"])

    counts, total = np.zeros(len(block.at), dtype=np.int64), 0
    for r in docs.select("text").mapInArrow(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            total = r["n"]
        else:
            counts[r["word"]] = r["n"]
    return Matcher(block, counts, total)


PAIRS = "doc_id long, item_id long, score double, seeds int, end_word long"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("seeds", pa.int32()), ("end_word", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: score, seeds found, word at which the copy ends."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out, last = docs.sparkSession.createDataFrame([], PAIRS), None
    for block in blocks(benchmark):
        if last is not None:  # written, so that the next block's matcher takes this one's place
            out = out.unionByName(_shared.stored(last, "contaminated"))
            shared.destroy()  # noqa: F821
        shared = docs.sparkSession.sparkContext.broadcast(matcher(docs, block))

        def rows(batches, shared=shared):
            own = shared.value
            for part in _shared.slices(batches, DOCUMENTS):
                found = own.match(part.column("text").to_pylist())
                pairs = [(d, own.item_ids[m.item], m.score, m.seeds, m.end) for d, ms in zip(part.column("doc_id").to_pylist(), found, strict=True) for m in ms]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pairs, strict=True) if pairs else [[]] * 5, ARROW, strict=True)], schema=ARROW)

        last = docs.mapInArrow(rows, PAIRS)
    return out if last is None else out.unionByName(last)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, columns as they are, that hold no benchmark item."""
    counted, shared = docs, None
    for block in blocks(benchmark):
        if shared is not None:
            docs = _shared.stored(docs, "clean")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(matcher(counted, block))

        def rows(batches, shared=shared):
            own = shared.value
            for part in _shared.slices(batches, DOCUMENTS):
                yield part.filter(pa.array([not ms for ms in own.match(part.column("text").to_pylist())], pa.bool_()))

        docs = _shared.map_rows(docs, rows)
    return docs


def worths(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, worth and judged of every benchmark item: items worth less than LEAST are not judged."""
    out = docs.sparkSession.createDataFrame([], "item_id long, worth double, judged boolean")
    for block in blocks(benchmark):
        found = matcher(docs, block)
        rows = [(i, float(w), bool(w >= LEAST)) for i, w in zip(found.item_ids, found.full, strict=True)]
        out = out.unionByName(_shared.stored(docs.sparkSession.createDataFrame(rows, out.schema), "worths"))
    return out


def op4_seed_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "benchmark"))

"""Canonical length-limited Huffman codes over numpy arrays.

Code lengths come from package-merge, so they are optimal under the limit. Codes
are canonical: the lengths alone rebuild them. A document's code starts on a byte
and has a checkpoint (bit offset) every STEP symbols; all stretches between
checkpoints decode side by side, each by looking up the next LIMIT bits in a table.
"""

from __future__ import annotations

import numpy as np

LIMIT = 20
STEP = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits; 0 for symbols that never occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n, merged, levels = len(order), np.empty(0), []
    for _ in range(limit):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        merged = both[at]
    depth, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


class Codebook:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.width = int(lengths.max(initial=1))
        sizes = self.lengths[order].astype(np.int64)
        spans = np.left_shift(1, self.width - sizes)  # entries of the decoding table that a code fills
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = (starts >> (self.width - sizes)).astype(np.uint64)
        self._order, self._spans = order, spans

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next ``width`` bits; unused entries have length 0."""
        symbol, length = np.zeros(1 << self.width, dtype=np.uint32), np.zeros(1 << self.width, dtype=np.uint8)
        filled = int(self._spans.sum())
        symbol[:filled] = np.repeat(self._order, self._spans)
        length[:filled] = np.repeat(self.lengths[self._order], self._spans)
        return symbol, length

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Codes of several documents in a row, each from a byte of its own.

        Returns the bytes, the byte at which each document starts (and the end), and
        the bit offset of every checkpoint, document by document.
        """
        bits = self.lengths[ids].astype(np.int64)
        if len(ids) and not bits.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(bits)
        first = np.cumsum(counts) - counts
        total = np.concatenate([[0], ends])
        size = (total[first + counts] - total[first] + 7) // 8
        byte = np.concatenate([[0], np.cumsum(size)])
        shift = byte[:-1] * 8 - total[first]
        at = (ends - bits) + np.repeat(shift, counts)
        words = int(byte[-1] + 3) // 4 + 2
        room = self.codes[ids] << (64 - bits - (at & 31)).astype(np.uint64)
        word = at >> 5
        # codes never overlap, so sums of their bits are exact in doubles
        packed = np.bincount(word, weights=(room >> np.uint64(32)).astype(np.float64), minlength=words)
        packed += np.bincount(word + 1, weights=(room & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
        marks = checkpoints(counts)
        place = np.repeat(first, marks) + STEP * (np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks))
        return packed.astype(">u4").tobytes()[: int(byte[-1])], byte, at[place] if len(ids) else np.empty(0, dtype=np.int64)


def checkpoints(counts: np.ndarray) -> np.ndarray:
    return (counts + STEP - 1) // STEP


def decode(table: tuple[np.ndarray, np.ndarray], width: int, data: bytes, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All ids of documents with these counts; offsets are their checkpoints' bits in data."""
    symbol, length = table
    marks = checkpoints(counts)
    left = np.full(len(offsets), STEP, dtype=np.int64)
    some = marks > 0
    left[np.cumsum(marks)[some] - 1] = counts[some] - STEP * (marks[some] - 1)
    start = np.cumsum(left) - left
    out = np.empty(int(left.sum()), dtype=np.uint32)
    raw = np.frombuffer(data + b"\0" * 12, dtype=np.uint8).astype(np.uint64)
    # the 40 bits from every byte on: any code of up to 20 bits lies in them whole
    window = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
    order = np.argsort(-left, kind="stable")
    at, to, left = offsets[order].astype(np.int64), start[order], left[order]
    alive = np.searchsorted(-left, -np.arange(1, STEP + 1), side="right")
    mask = np.uint64((1 << width) - 1)
    for step in range(int(left[0]) if len(left) else 0):
        n = alive[step]
        bit = at[:n]
        key = ((window[bit >> 3] >> (40 - width - (bit & 7)).astype(np.uint64)) & mask).astype(np.int64)
        out[to[:n] + step] = symbol[key]
        at[:n] = bit + length[key]
    return out

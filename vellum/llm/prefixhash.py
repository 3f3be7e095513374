"""Document fingerprints from prefix polynomial hashes.

For a text c[0..n) the prefix array holds, modulo a 31-bit prime, the sums of
c[j] / B**(j+1). The hash of any span [a, b) is then (S[b] - S[a]) * B**b, which is
the span's polynomial whatever its place: one subtraction and one product tell whether two
spans are equal, and binary search over span lengths gives the longest common
extension. Two primes together make the 62 bits of every hash that is kept or compared.

A fingerprint keeps some of those values: the text's length and hash; hashes of
the prefixes and suffixes at every multiple of a power of two, at most POINTS each; and the
lengths and hashes of at most SPANS spans between places that the content chooses: those whose
last WINDOW code points hash to a multiple of a power of two, the least power that leaves so few. The places
of a higher power are among those of a lower one, and hashes of neighbouring spans add up, so that spans of
texts of any two lengths compare. The likeness of two fingerprints is the part of the longer text that
their longest common prefix and suffix cover, both found by binary search over common points, and
between those the spans that both texts have, wherever they lie.

Nulls: a null text is empty. Empty texts are equal to each other (likeness 1) and
unlike all others (0). The next document is the next row by (doc_id, text), so repeated
ids are rows of their own, and rows equal in both are alike in every result; null ids come first.
One document is its own next. Very long texts are hashed whole, one task holding two of them at a time. Other
columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import _shared

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
POINTS = 32
SPANS = 32
WINDOW = 8
LEAST = 2  # the least power of two for places
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 16


class Powers:
    """Powers of a base and of its inverse, by two short tables."""

    def __init__(self, base: int, prime: int):
        self.prime = np.uint64(prime)
        self._low = self._table(base, _STEP)
        self._low_inverse = self._table(pow(base, -1, prime), _STEP)
        self._bases = pow(base, _STEP, prime), pow(pow(base, -1, prime), _STEP, prime)
        self._high = [self._table(b, 64) for b in self._bases]

    def _table(self, base: int, size: int) -> np.ndarray:
        out = np.ones(size, dtype=np.uint64)
        done, factor = 1, base % int(self.prime)
        while done < size:  # base**done times what is there
            n = min(done, size - done)
            out[done : done + n] = out[:n] * np.uint64(factor) % self.prime
            done, factor = done + n, factor * factor % int(self.prime)
        return out

    def of(self, at: np.ndarray, inverse: bool = False) -> np.ndarray:
        low = (self._low_inverse if inverse else self._low)[at & (_STEP - 1)]
        top = int(at.max(initial=0)) >> 16
        if not top:
            return low
        if top >= len(self._high[inverse]):
            self._high[inverse] = self._table(self._bases[inverse], 2 * top)
        return low * self._high[inverse][at >> 16] % self.prime


_POWERS: list[Powers] = []


def powers() -> list[Powers]:
    if not _POWERS:
        _POWERS.extend(Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True))
    return _POWERS


class PrefixHash:
    """Span hashes of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        self.n = len(codes)
        at = np.arange(1, self.n + 1)
        self.sums = []
        for p in powers():
            out = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum((codes + np.uint64(1)) * p.of(at, inverse=True) % p.prime, out=out[1:])
            out %= p.prime
            self.sums.append(out)

    def spans(self, a, b, k: int = 0) -> np.ndarray:
        """Hashes of the spans [a, b) by the k-th prime."""
        a, b, p = np.asarray(a), np.asarray(b), powers()[k]
        return (self.sums[k][b] + p.prime - self.sums[k][a]) % p.prime * p.of(b) % p.prime

    def both(self, a, b) -> np.ndarray:
        """62-bit hashes of the spans [a, b)."""
        return self.spans(a, b, 0) << np.uint64(31) | self.spans(a, b, 1)

    def whole(self) -> int:
        return int(self.both([0], [self.n])[0])

    @cached_property
    def fingerprint(self) -> Fingerprint:
        return Fingerprint.of(self)

    @cached_property
    def powers_at(self) -> np.ndarray:
        """Of the WINDOW code points that start at each place: the power of two that their hash is a multiple of."""
        return self._powers_at(np.arange(max(0, self.n - WINDOW + 1)))

    def _powers_at(self, start: np.ndarray) -> np.ndarray:
        mixed = (self.spans(start, start + WINDOW) * _MIX) >> np.uint64(32)
        return np.bitwise_count(~mixed & (mixed - np.uint64(1))).clip(max=32)

    def equal(self, a: int, other: PrefixHash | Spliced, b: int, length: int) -> bool:
        return bool(self.both([a], [a + length])[0] == other.both([b], [b + length])[0])

    def common_extension(self, a: int, other: PrefixHash | Spliced, b: int) -> int:
        """Length of the longest equal spans that start at a here and at b there: by doubled lengths, then by a search that tries 16 at once."""
        low, high = 0, min(self.n - a, other.n - b)
        tried = 1 << np.arange(high.bit_length())
        while low < high:
            same = self.both(np.full_like(tried, a), a + tried) == other.both(np.full_like(tried, b), b + tried)
            k = int(same.sum())  # all up to the longest are equal
            low, high = int(tried[k - 1]) if k else low, int(tried[k]) - 1 if k < len(tried) else high
            step = max(1, (high - low) // 16)
            tried = np.append(np.arange(low + step, high, step), high)
        return low


class Spliced:
    """Span hashes of head[:cut] + tail[:more], answered from the two texts' own arrays."""

    def __init__(self, head: PrefixHash, cut: int, tail: PrefixHash, more: int):
        self.head, self.cut, self.tail, self.more, self.n = head, cut, tail, more, cut + more

    def spans(self, a, b, k: int = 0) -> np.ndarray:
        a, b, p = np.asarray(a), np.asarray(b), powers()[k]
        left = self.head.spans(np.minimum(a, self.cut), np.minimum(b, self.cut), k)
        over = np.maximum(b - self.cut, 0)
        right = self.tail.spans(np.maximum(a - self.cut, 0), over, k)
        return (left * p.of(np.minimum(over, b - a)) + right) % p.prime

    @cached_property
    def powers_at(self) -> np.ndarray:
        """As of a text of its own: only windows over the seam are hashed anew."""
        before = max(0, self.cut - WINDOW + 1)
        seam = np.arange(before, max(before, min(self.cut, self.n - WINDOW + 1)))
        return np.concatenate([self.head.powers_at[:before], self._powers_at(seam), self.tail.powers_at[: max(0, self.more - WINDOW + 1)]])

    both, whole, _powers_at = PrefixHash.both, PrefixHash.whole, PrefixHash._powers_at


def stride(n: int) -> int:
    s = 1
    while n // s > POINTS:
        s *= 2
    return s


@dataclass(frozen=True)
class Fingerprint:
    """powers has, for each span but the last, the power of two of the place that ends it."""

    n: int
    whole: int
    prefixes: np.ndarray
    suffixes: np.ndarray
    power: int
    lengths: tuple[int, ...]
    hashes: tuple[int, ...]
    powers: tuple[int, ...]

    def __str__(self) -> str:
        points = lambda x: x.astype(">u8").tobytes().hex()
        numbers = lambda x: ",".join(f"{k:x}" for k in x)
        return f"{self.n:x}.{self.whole:016x}.{points(self.prefixes)}.{points(self.suffixes)}.{self.power:x}.{numbers(self.lengths)}.{points(np.array(self.hashes, np.uint64))}.{numbers(self.powers)}"

    @classmethod
    def of(cls, text: PrefixHash | Spliced) -> Fingerprint:
        s = stride(text.n)
        at = np.arange(1, text.n // s + 1) * s
        found = text.powers_at[: max(0, text.n - WINDOW)]  # the text's own end is no place
        more = np.cumsum(np.bincount(found, minlength=34)[::-1])[::-1]  # places of each power or a higher one; none of 33
        power = max(LEAST, int(np.argmax(more < SPANS)))
        place = np.flatnonzero(found >= power)
        edge = np.concatenate([[0], place + WINDOW, [text.n]])
        start = np.concatenate([[0], np.zeros_like(at), text.n - at, edge[:-1]])
        end = np.concatenate([[text.n], at, np.full_like(at, text.n), edge[1:]])
        whole, prefixes, suffixes, spans = np.split(text.both(start, end), np.cumsum([1, len(at), len(at)]))
        return cls(text.n, int(whole[0]), prefixes, suffixes, power, tuple(np.diff(edge).tolist()), tuple(spans.tolist()), tuple(found[place].tolist()))

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, prefixes, suffixes, power, lengths, hashes, powers = text.split(".")
        points = lambda x: np.frombuffer(bytes.fromhex(x), ">u8").astype(np.uint64)
        numbers = lambda x: tuple(int(k, 16) for k in x.split(",") if k)
        return cls(int(n, 16), int(whole, 16), points(prefixes), points(suffixes), int(power, 16), numbers(lengths), tuple(points(hashes).tolist()), numbers(powers))

    def spans(self, power: int) -> list[tuple[int, int, int]]:
        """(start, length, hash) of the spans between places of the power or a higher one; neighbours' hashes are added up."""
        if power <= self.power:
            return list(zip(accumulate(self.lengths, initial=0), self.lengths, self.hashes, strict=False))
        out, start, size, value = [], 0, 0, (0, 0)
        for k, (length, whole) in enumerate(zip(self.lengths, self.hashes, strict=True)):
            own = whole >> 31, whole & ((1 << 31) - 1)
            value = tuple((v * pow(b, length, p) + x) % p for v, x, b, p in zip(value, own, BASES, PRIMES, strict=True)) if size else own
            size += length
            if k == len(self.powers) or self.powers[k] >= power:
                out.append((start, size, value[0] << 31 | value[1]))
                start, size, value = start + size, 0, (0, 0)
        return out


def _agreed(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first points agree; all before an equal point are equal."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
    return low


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    s = max(stride(a.n), stride(b.n))
    thin = lambda f, x: x[s // stride(f.n) - 1 :: s // stride(f.n)]
    head, tail = s * _agreed(thin(a, a.prefixes), thin(b, b.prefixes)), s * _agreed(thin(a, a.suffixes), thin(b, b.suffixes))
    power = max(a.power, b.power)
    if not head and not tail and power == a.power == b.power and set(a.hashes).isdisjoint(b.hashes):
        return 0.0
    between = []  # spans that reach into what the ends do not cover
    for f in (a, b):
        between.append([(start, n, h) for start, n, h in f.spans(power) if start + n > head and start < f.n - tail])
    both = Counter((n, h) for _, n, h in between[0]) & Counter((n, h) for _, n, h in between[1])
    shared = []
    for f, own in zip((a, b), between, strict=True):
        left, covered = both.copy(), 0
        for start, n, h in own:
            if left[n, h]:
                left[n, h] -= 1
                covered += max(0, min(start + n, f.n - tail) - max(start, head))
        shared.append(covered)
    return min(head + tail + min(shared), a.n, b.n, max(a.n, b.n) - 1) / max(a.n, b.n)


def _edited(rows):
    """Rows in order, each with the next one's text; yields a result for all but borrowed rows."""
    kept = None
    for own, doc_id, text in rows:
        now = (own, doc_id, text, PrefixHash(text))
        if kept is not None and kept[0]:
            yield _result(kept, now)
        kept = now


def _result(row, following) -> dict:
    _, doc_id, text, hashes = row
    _, _, other, more = following
    cut, take = hashes.n - hashes.n // 2, min(hashes.n // 2, more.n)
    edited = Spliced(hashes, cut, more, take)
    own, changed = hashes.fingerprint, Fingerprint.of(edited)
    return {
        "doc_id": doc_id,
        "n_chars": hashes.n,
        "edited_sha256": hashlib.sha256((text[:cut] + other[:take]).encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": str(own),
        "edited_fingerprint": str(changed),
        "near_edited": likeness(own, changed),
        "near_next": likeness(own, more.fingerprint),
        "prefix_edited": hashes.common_extension(0, edited, 0),
        "prefix_next": hashes.common_extension(0, more, 0),
    }


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited long, prefix_next long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(k, pa.string()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[(k, pa.float64()) for k in ("near_edited", "near_next")], *[(k, pa.int64()) for k in ("prefix_edited", "prefix_next")]])


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    Texts are shuffled once, into ranges of ids, and read in order. The first row of
    each range goes to the range before it as well, marked as borrowed.
    """
    spark = docs.sparkSession
    ranges = _shared.key_ranges(docs, "doc_id", _shared.partitions(spark))
    n = ranges.count
    docs = docs.select(F.col("doc_id").cast("long"), _shared.whole_text().alias("text")).withColumn("home", ranges.bucket("doc_id"))
    leads = F.col("doc_id").isin(list(ranges.first_keys))
    if docs.where(F.col("doc_id").isNull()).select(F.lit(1)).take(1):  # then the first row of all is one of these
        leads = F.col("doc_id").isin(list(ranges.first_keys[1:])) | F.col("doc_id").isNull()
    to = F.when(leads, F.array(F.col("home"), F.col("home") - 1)).otherwise(F.array(F.col("home")))

    def rows(batches):
        def stream():
            ended, seen = None, False
            for batch in batches:
                for bucket, doc_id, own, text in zip(*(batch.column(k).to_pylist() for k in ("bucket", "doc_id", "own", "text")), strict=True):
                    if own:
                        yield True, doc_id, text
                    elif not seen:  # of several rows of a leading id the first is the next document
                        seen = True
                        yield False, doc_id, text

        held = []
        for r in _edited(stream()):
            held.append(r)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=ARROW)

    return (
        docs.select("doc_id", "text", "home", F.explode(to).alias("bucket"))
        .select("doc_id", "text", (F.col("bucket") == F.col("home")).alias("own"), F.pmod("bucket", F.lit(n)).alias("bucket"))
        .repartitionById(n, "bucket")
        .sortWithinPartitions(F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(rows, RESULT)
    )


def op2_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(_shared.table(spark, sf_dir, "documents"))

import hashlib
import os
import random
from functools import lru_cache

import pytest

from vellum.llm.prefixhash import Fingerprint, PrefixHash, Spliced, likeness, op2_prefix_hashes, with_next

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)


@lru_cache(maxsize=None)
def polynomial(span):
    """The 62-bit hash of a span, code point by code point."""
    value = [0, 0]
    for c in span:
        value = [(v * b + ord(c) + 1) % p for v, b, p in zip(value, BASES, PRIMES, strict=True)]
    return value[0] << 31 | value[1]


def plain(text):
    """What the fingerprint of a text has to say, from its definition."""
    n, step = len(text), 1
    while n // step > 32:
        step *= 2
    ends = [k * step for k in range(1, n // step + 1)]
    places = {}
    for at in range(n - 8):
        mixed = ((polynomial(text[at : at + 8]) >> 31) * 0x9E3779B97F4A7C15 % 2**64) >> 32
        places[at + 8] = next((k for k in range(32) if mixed >> k & 1), 32)
    power = next(k for k in range(2, 35) if sum(v >= k for v in places.values()) < 32)
    cuts = [0, *[p for p, v in places.items() if v >= power], n]
    spans = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    sixteen = lambda values: "".join(f"{v:016x}" for v in values)
    prefixes, suffixes = (sixteen(polynomial(x) for x in xs) for xs in ([text[:k] for k in ends], [text[n - k :] for k in ends]))
    lengths, powers = ",".join(f"{len(x):x}" for x in spans), ",".join(f"{places[p]:x}" for p in cuts[1:-1])
    return f"{n:x}.{polynomial(text):016x}.{prefixes}.{suffixes}.{power:x}.{lengths}.{sixteen(map(polynomial, spans))}.{powers}"


def covered(a, b):
    """An upper bound of what two different texts share: equal ends, and what lies between in runs of WINDOW that both have."""
    size = max(len(a), len(b))
    head = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
    known = {b[k : k + 8] for k in range(len(b) - 7)}
    some = sum(any(a[j : j + 8] in known for j in range(max(0, k - 7), k + 1)) for k in range(len(a)))
    return min(1.0, (max(some, 0) + head + tail + 16) / size)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for k, (doc_id, text) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + other[:n]
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, other


def check(got, rows):
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256))
    want = sorted(expected(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert len(got) == len(want)
    for r, (doc_id, n, sha, text, edited, other) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, n, sha)
        assert (r.prefix_edited, r.prefix_next) == tuple(len(os.path.commonprefix([text, x])) for x in (edited, other))
        if n < 800:
            assert r.fingerprint == plain(text)
            assert len(edited) >= 800 or r.edited_fingerprint == plain(edited)
            for near, x in ((r.near_edited, edited), (r.near_next, other)):
                assert (near == 1.0) == (text == x) and 0 <= near <= 1
                assert not (text and x) or near <= covered(text, x)
        if n >= 64:  # all but one step of the unchanged half is covered
            assert r.near_edited >= (n - n // 2) / max(n, len(edited)) - 1 / 16


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_query_equals_brute_force(spark, sf_dir, table, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check(op2_prefix_hashes(spark, sf_dir).collect(), table("documents", "doc_id, text"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edges(edges, empty):
    check(with_next(edges).collect(), [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()])
    assert with_next(empty).count() == 0
    one = with_next(edges.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_spans_and_extensions():
    rng = random.Random(2)
    for _ in range(40):
        a = "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 60)))
        b = "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 60))) + a[3:30]
        x, y = PrefixHash(a), PrefixHash(b)
        for _ in range(30):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
            longest = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
            assert x.common_extension(i, y, j) == longest
        cut, more = rng.randint(0, len(a)), rng.randint(0, len(b))
        assert str(Fingerprint.of(Spliced(x, cut, y, more))) == str(Fingerprint.of(PrefixHash(a[:cut] + b[:more])))


def test_long_texts_use_the_high_powers():
    a = "ab" * 100_000
    x, y = PrefixHash(a), PrefixHash("z" + a)
    assert x.equal(0, y, 1, len(a)) and not x.equal(0, y, 0, len(a))


def test_likeness():
    of = lambda t: Fingerprint.of(PrefixHash(t))
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    text = make(1000)
    assert likeness(of(text), of(text)) == 1.0 == likeness(of(""), of(""))
    assert likeness(of(text), of("")) == 0.0
    assert 0.85 < likeness(of(text), of(text[:500] + "#" + text[501:])) < 1
    assert likeness(of(text), of(text[::-1])) < 0.1
    assert likeness(Fingerprint.parse(str(of(text))), of(text)) == 1.0
    for n in (100, 2000, 60_000):
        text = make(n)
        assert likeness(of(text), of("#" + text[1:-1] + "#")) > 0.7  # both ends differ
        edited = list(text)
        for k in range(5):
            edited[n * (2 * k + 1) // 10] = "#"
        assert likeness(of(text), of("".join(edited))) > (0.5 if n > 100 else 0.2)
        assert likeness(of(text), of(text[n // 2 :] + text[: n // 2])) > 0.5  # halves that changed places
        assert likeness(of(text), of(make(n))) < 0.15
        twice = text + make(3 * n)  # lengths whose places differ in power
        assert 0.1 < likeness(of(text), of(twice)) <= 0.25 and likeness(of(text), of(twice)) == likeness(of(twice), of(text))


def test_periodic_texts_have_bounded_fingerprints():
    for text in ("x" * 100_000, "ab" * 50_000, "lorem ipsum " * 9000, "\n" * 31):
        found = Fingerprint.of(PrefixHash(text))
        assert len(found.lengths) <= 32 and sum(found.lengths) == len(text)
        assert str(Fingerprint.parse(str(found))) == str(found)


def test_ids_beyond_doubles_lose_no_rows(spark):
    rng = random.Random(4)
    rows = [((1 << 62) + rng.randrange(500), f"text {k}") for k in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        check(with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

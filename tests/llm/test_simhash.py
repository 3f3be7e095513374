import random
import re

import numpy as np
import pytest
import xxhash

from vellum.llm import components, simhash
from vellum.llm.trie import Trie


def by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys, errors=3):
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (keys[i] ^ keys[j]).bit_count() <= errors:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(keys))]


def test_query_equals_brute_force(spark, sf_dir, table):
    rows = sorted(table("documents", "doc_id, text"))
    prints = [by_hand(t) for _, t in rows]
    root = groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash_trie(spark, sf_dir).collect()}
    assert got == {d: (f"{p:016x}", rows[k][0]) for (d, _), p, k in zip(rows, prints, root, strict=True)}


def clustered(n, seed):
    """Random keys, chains of near ones and dense balls."""
    rng = random.Random(seed)
    keys = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(6):
        k = rng.getrandbits(64)
        for _ in range(n // 4):
            keys.add(k := k ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 4]))) & ((1 << 64) - 1))
        c = rng.getrandbits(64)
        keys |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n // 4)}
    return sorted(keys)


@pytest.mark.parametrize("hot", [50_000, 8])
def test_links_keep_every_group(spark, hot):
    keys = clustered(200, hot)
    signed = np.array(keys, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(k,) for k in signed], "fp long"), hot).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3 for r in links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()}
    want = groups(keys)
    name = lambda k: got.get(signed[k], signed[k])
    assert len(set(map(name, range(len(keys))))) == len(set(want))
    assert len({(name(k), want[k]) for k in range(len(keys))}) == len(set(want))


def test_dense_group_gives_few_links():
    base = 0x1234_5678_9ABC_DEF0
    keys = np.unique(np.array([base ^ (1 << a) ^ (1 << b) for a in range(48) for b in range(48)], dtype=np.uint64))
    trie = Trie(keys, 0, 3)
    assert len(trie.join(np.array([0]), np.array([len(keys)]))) == len(keys) - 1


@pytest.mark.parametrize("part", [500_000, 40])
def test_components_of_random_links(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART", part)
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: root(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(edges, empty):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.component_id)
    assert by_id[7] == {3} and 3 in by_id[3] and by_id[1] == by_id[11] == {-5}
    assert None in by_id and len(by_id[None]) == 2  # one of them has the empty text's group
    kept = simhash.deduplicate(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == sorted((d is None, d or 0) for d in (None, -5, 2, 3, 3, 8, 9, 1 << 60))
    assert simhash.near_duplicates(empty).count() == 0 == simhash.deduplicate(empty).count()

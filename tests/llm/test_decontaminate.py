import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import decontaminate as d


def naive(worth, item, window):
    best, row = 0.0, [0.0] * (len(window) + 1)
    for w, value in zip(item, worth, strict=True):
        new = [0.0]
        for j, x in enumerate(window):
            new.append(max(0.0, row[j] + (value if x == w else -d.GAP), row[j + 1] - d.GAP, new[j] - d.GAP))
        row = new
        best = max(best, *row)
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(4)
    block = d.Block([(1, list("abcdefgh"))])
    m = d.Matcher(block, np.arange(1, 9) * 10, 1000)
    for _ in range(60):
        item, window = rng.integers(0, 8, 7), rng.integers(-1, 8, rng.integers(1, 25))
        assert abs(m.align(item, window)[0] - naive(m.worth[item], item, window)) < 1e-9


def test_every_exact_copy_is_found(spark, table):
    sf = "/root/testdata/sf0.01"
    text = lambda t: " " + " ".join(d.words(t)) + " "
    items = {i: text(t) for i, t in table("benchmark", "item_id, text", sf)}
    exact = {(k, i) for k, t in table("documents", "doc_id, text", sf) for own in [text(t)] for i, x in items.items() if x in own}
    rows = d.op4_seed_align(spark, sf).collect()
    assert exact and exact <= {(r.doc_id, r.item_id) for r in rows}
    assert len(rows) <= len(exact) + 2 and all(d.THRESHOLD <= r.score <= 1 + 1e-9 for r in rows)


def small(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    item = [word() for _ in range(40)]
    noise = lambda n: [rng.choice(["the", "of", "and", word()]) for _ in range(n)]
    edited = [word() if k % 5 == 4 else w for k, w in enumerate(item)]
    shorter = [w for k, w in enumerate(item) if k % 6 != 2]
    docs = [noise(300), noise(200) + item + noise(100), noise(50) + edited + noise(60), noise(80) + shorter, [w.upper() + "!!" for w in item], noise(30) + item[:8] + noise(20), ["the", "of"] * 4000 + item]
    return (
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "the of"), (None, "zz yy"), (13, " ".join(item))], "item_id long, text string"),
    )


def test_edited_copies(spark):
    docs, benchmark = small(spark)
    found = {(r.doc_id, r.item_id) for r in d.contaminated(docs, benchmark).collect() if r.item_id in (10, 13)}
    assert found == {(k, i) for k in (1, 2, 3, 4, 6) for i in (10, 13)}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, benchmark = small(spark)
    whole = sorted((r.doc_id, r.item_id, r.score) for r in d.contaminated(docs, benchmark.where("item_id is not null")).collect())
    one = d.blocks
    monkeypatch.setattr(d, "blocks", lambda b: one(b, 3))
    assert whole == sorted((r.doc_id, r.item_id, r.score) for r in d.contaminated(docs, benchmark.where("item_id is not null")).collect())


def plain_words(text):
    return re.findall(r"\w+", (text or "").lower())


def all_pairs(docs, items):
    """Every document and item aligned, with rarities counted anew: (doc_id, item_id) to its score."""
    counts = Counter(w for _, t in docs for w in plain_words(t))
    total = sum(counts.values())
    worth = lambda w: min(8.0, max(1.0, -math.log10((counts[w] + 0.5) / (total + 1.0))))
    out = {}
    for i, t in items:
        item = plain_words(t)
        values = [worth(w) for w in item]
        if sum(values) < 10:
            continue
        for k, text in docs:
            window = plain_words(text)
            if sum(v for v, w in zip(values, item, strict=True) if w in set(window)) < 0.45 * sum(values):
                continue  # cannot reach it in any order
            score = naive(values, item, window) / sum(values)
            if score >= 0.45:
                out[k, i] = score
    return out


def edits(rng, item, other):
    """Copies of an item with words replaced, left out and put in."""
    yield [other() if k % 3 == 2 else w for k, w in enumerate(item)]
    yield [other() if rng.random() < 0.3 else w for w in item]
    yield [w for k, w in enumerate(item) if k % 3 != 1]
    yield [x for w in item for x in (w, other())]
    yield [x for w in item for x in ((w, other()) if rng.random() < 0.5 else (w,)) if rng.random() > 0.15]
    yield item[len(item) // 3 :]


def test_recall_against_all_pairs(spark, table):
    rng = random.Random(9)
    items = table("benchmark", "item_id, text")
    docs = [(k, t) for k, t in table("documents", "doc_id, text") if len(t or "") < 3000]
    vocabulary = plain_words(" ".join(t or "" for _, t in docs))
    other = lambda: rng.choice(vocabulary)
    for i, t in items:
        for n, words in enumerate(edits(rng, plain_words(t), other)):
            docs.append((1_000_000 + 10 * i + n, " ".join([other() for _ in range(60)] + words + [other() for _ in range(40)])))
    expected = all_pairs(docs, items)
    found = {(r.doc_id, r.item_id): r.score for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    planted = {p for p in expected if p[0] >= 1_000_000}
    print(len(expected), len(planted), len(expected.keys() & found.keys()))
    assert len(planted) >= 4 * len(items) and found.keys() <= expected.keys()
    assert len(expected.keys() & found.keys()) >= 0.97 * len(expected)
    assert all(found[p] <= expected[p] + 1e-9 for p in found)


def test_items_that_are_worth_little_are_not_judged(spark):
    docs = spark.createDataFrame([(k, f"yes the plan of the day {k} was good for us") for k in range(20)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "yes"), (2, "the plan"), (3, "entirely other words that no text of these has")], "item_id long, text string")
    assert d.clean(docs, benchmark).count() == 20 and d.contaminated(docs, benchmark).count() == 0
    assert {r.item_id: r.judged for r in d.worths(docs, benchmark).collect()} == {1: False, 2: False, 3: True}


def test_a_second_block_sees_the_counts_of_all_rows(spark, monkeypatch):
    docs, benchmark = small(spark)
    one = d.blocks
    kept = {r.doc_id for r in d.clean(docs, benchmark).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {r.doc_id for r in d.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(d, "blocks", lambda b: one(b, 3))
    assert kept == {r.doc_id for r in d.clean(docs, benchmark).collect()}


def test_edges(spark, edges, empty):
    benchmark = spark.createDataFrame([(1, "the same text in several rows"), (2, None), (2, ""), (None, "wholly unrelated sentence made of unseen vocabulary only")], "item_id long, text string")
    rows = d.contaminated(edges, benchmark).collect()
    assert sorted((r.doc_id, r.item_id or -1) for r in rows) == [(3, 1), (3, 1), (7, 1)]
    odd = edges.withColumn("a.b", F.lit(1))
    kept = d.clean(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == edges.count() - 3
    assert d.contaminated(empty, benchmark).count() == 0 == d.clean(empty, benchmark).count()
    assert d.clean(edges, benchmark.limit(0)).count() == edges.count()

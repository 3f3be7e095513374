import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from vellum.llm import packing, tokens


def check(rows, capacity):
    """Sequences are gapless and fit; returns their number."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query_equals_brute_force(spark, sf_dir, table):
    library = Tokenizer.from_file(tokens.default_path())
    want, total = {}, 0
    for doc_id, text in table("documents", "doc_id, text"):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[doc_id, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    rows = packing.op7_best_fit(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check(rows, 2048) <= -(-total // 2048) * 1.02 + 1


def items(spark, lengths):
    return spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], packing.PIECES)


def test_rounds_merge_partitions(spark):
    rng = random.Random(1)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 60), 100]) for _ in range(3000)]
    rows = packing.pack(items(spark, lengths), 100, per_partition=200).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert check(rows, 100) <= sum(lengths) / 100 * 1.03 + 2


def test_items_that_never_fit_together_end(spark):
    rows = packing.pack(items(spark, [60] * 900 + [30]), 100, per_partition=50).collect()
    assert check(rows, 100) == 900 and len(rows) == 901


def joinable(rows, capacity):
    """How many pairs of sequences could be one, each used once, greedily."""
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    sizes, pairs = sorted(fill.values()), 0
    while len(sizes) > 1:
        small = sizes.pop(0)
        partner = next((k for k in range(len(sizes) - 1, -1, -1) if sizes[k] + small <= capacity), None)
        if partner is None:
            break
        sizes.pop(partner)
        pairs += 1
    return pairs


def test_many_open_bins_are_merged_up_the_tree(spark):
    rng = random.Random(3)
    for lengths in ([rng.choice([55, 58, 61]) for _ in range(1200)] + [rng.randint(5, 44) for _ in range(300)], [rng.randint(51, 99) for _ in range(1500)], [34] * 1400 + [rng.randint(1, 90) for _ in range(100)]):
        rows = packing.pack(items(spark, lengths), 100, per_partition=200).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
        check(rows, 100)
        assert joinable(rows, 96) <= 1  # bins of 96 and more are done, whatever comes
        at_once = packing.pack(items(spark, lengths), 100).collect()
        assert check(rows, 100) <= check(at_once, 100) * 1.02 + 1


def test_best_fit():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert packing.best_fit([], 10) == [] and packing.best_fit([10, 10], 10) == [0, 1]


def test_edges(spark, edges, empty):
    parts = packing.pieces(edges, tokens.default_path(), 0, 50)
    rows = packing.pack(parts, 50).collect()
    assert check(rows, 50) and len(rows) == parts.count()
    per_doc = defaultdict(int)
    for r in rows:
        per_doc[r.doc_id] += 1
    assert per_doc[None] == 2 and per_doc[1] == 1 and per_doc[8] > 1000
    assert packing.pack(packing.pieces(empty, tokens.default_path(), 0)).count() == 0

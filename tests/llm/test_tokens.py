import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from vellum.llm import huffman, tokenfile, tokens

ODD = [
    "", "a'S b't 's ''s don't's", "İstanbul% ÇA'ĺx é! é́", "ΑΣ ΟΔΟΣ. σ'ς", "x\t\ty z q\x1cw\x85r", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "a_b__c9_9 ½²³ 12.5%",
    "日本語 text 한국어", "́́ a ́b", " lead  double  trail ", "ß ẞ ﬁ Å ª º µ", "'''ll 'LL I'LL l'l", "a" * 300 + "%" * 300, "é% Å! Å", "ÿŸ Ÿ'", None,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(library, table):
    texts = ODD + [t for (t,) in table("documents", "text")]
    for remembered, together in ((300_000, 500), (50, 3)):
        own = tokens.Encoder(tokens.default_path(), remembered, together)
        for k in range(0, len(texts), 60):
            for t, got in zip(texts[k : k + 60], own.encode(texts[k : k + 60]), strict=True):
                assert np.frombuffer(got, "<u4").tolist() == expected(library, t)


def kraft(lengths):
    return sum(2.0 ** -int(x) for x in lengths if x)


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n, limit in ((2, 5), (3, 2), (300, 9), (256, 8), (5000, 20)):
        counts = (rng.zipf(1.3, n) % 10**9).astype(np.int64)
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and abs(kraft(lengths) - 1) < 1e-9
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55], dtype=np.int64)
    assert huffman.code_lengths(fib, 20).tolist() == [9, 9, 8, 7, 6, 5, 4, 3, 2, 1]
    assert huffman.code_lengths(fib, 4).max() == 4
    assert huffman.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    assert huffman.code_lengths(np.zeros(3, np.int64)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


def test_limited_lengths_are_optimal():
    from functools import lru_cache

    def best(counts, limit):
        counts = sorted(counts, reverse=True)

        @lru_cache(None)
        def go(k, room, least):  # room: free leaves at depth `limit`
            if k == len(counts):
                return 0
            return min((counts[k] * n + rest for n in range(least, limit + 1) if (left := room - (1 << (limit - n))) >= 0 and (rest := go(k + 1, left, n)) is not None), default=None)

        return go(0, 1 << limit, 1)

    rng = np.random.default_rng(2)
    for _ in range(10):
        counts = rng.integers(1, 100, 7)
        assert int((huffman.code_lengths(counts, 4) * counts).sum()) == best(counts.tolist(), 4)


def test_codes_round_trip():
    rng = np.random.default_rng(3)
    for vocabulary in (1, 2, 40, 5000):
        sizes = np.array([0, 1, 255, 256, 257, 3000, 0, 5])
        ids = (rng.zipf(1.2, int(sizes.sum())) % vocabulary).astype(np.int64)
        book = huffman.Codebook(huffman.code_lengths(np.bincount(ids, minlength=vocabulary)))
        data, byte, at = book.encode(ids, sizes)
        assert len(data) == byte[-1] and len(at) == huffman.checkpoints(sizes).sum()
        assert np.array_equal(huffman.decode(book.decoder(), book.width, data, at, sizes), ids)
    with pytest.raises(ValueError):
        huffman.Codebook(np.array([1, 1, 0], np.uint8)).encode(np.array([2]), np.array([1]))


def test_query_is_an_exact_round_trip(spark, sf_dir, table, library):
    start, want = 0, {}
    for doc_id, text in sorted(table("documents", "doc_id, text")):
        ids = np.array([*expected(library, text), 2], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.op6_token_file(spark, sf_dir).collect()} == want


def test_file_is_in_order_and_smaller(spark, sf_dir, tmp_path):
    path = str(tmp_path / "f")
    tokenfile.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokens.default_path(), 2)
    blocks = sorted((p, b) for p, b in ((r.f, r.body) for r in spark.read.parquet(f"{path}/blocks").selectExpr("input_file_name() AS f", "body").collect()))
    by_file = {}
    for name, body in blocks:
        by_file.setdefault(name, []).append(np.frombuffer(body, "<i8", int(np.frombuffer(body, "<u4", 1, 4)[0]), 16))
    ranges = sorted((int(min(map(min, x))), int(max(map(max, x)))) for _, x in sorted(by_file.items()))
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert ranges == [(int(min(map(min, x))), int(max(map(max, x)))) for _, x in sorted(by_file.items())]
    total = spark.read.parquet(f"{path}/blocks").selectExpr("sum(tokens) AS n", "sum(length(body)) AS b").first()
    assert len(blocks) >= 4 and total.b < 1.9 * total.n


def test_edges(spark, edges, empty, tmp_path, library):
    path = str(tmp_path / "f")
    tokenfile.write(edges, path, tokens.default_path(), 2)
    rows = sorted(tokenfile.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in edges.select("doc_id").collect()), key=lambda d: (d is not None, d or 0))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    got = sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == sorted((r.doc_id or 0, [*expected(library, r.text), 2]) for r in edges.select("doc_id", "text").collect())
    tokenfile.write(empty, str(tmp_path / "e"), tokens.default_path(), 2)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0

import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vellum.llm import quality


def test_held_out_accuracy(spark, table):
    sf = "/root/testdata/sf0.01"
    truth = {d: q for d, q in table("labels", "doc_id, quality", sf) if q is not None}
    rows = quality.op3_ftrl_quality(spark, sf).collect()
    assert len(rows) == len(table("documents", "doc_id", sf))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    good = [r for r in held if truth[r.doc_id] == 1]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert np.mean([r.predicted for r in good]) >= 0.98


M64 = (1 << 64) - 1


def plain_features(text, bits=quality.BITS):
    """Feature values of one text, gram by gram with Python integers."""
    words, found = (text or "").split(), {}

    def add(gram):
        gram ^= gram >> 29
        bucket = max(1, gram & ((1 << bits) - 1))
        found[bucket] = found.get(bucket, 0) + 1

    symbols = [(xxhash.xxh64_intdigest(w, 1), xxhash.xxh64_intdigest(quality.shape(w), 2)) for w in words]
    for s in symbols:
        add(s[0])
        add(s[1])
    for a, b in zip(symbols, symbols[1:], strict=False):
        for x, y in zip(a, b, strict=True):
            add((x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F) & M64)
        if a[0] == b[0]:
            add(xxhash.xxh64_intdigest("a word and the same word", 3))
    size = max(1.0, math.sqrt(sum(n * n for n in found.values())))
    return {0: 1.0} | {k: n / size for k, n in found.items()}


def plain_fit(rows):
    """FTRL-proximal over (features, label) rows, one coordinate at a time."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, label in rows:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - label) * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / quality.ALPHA * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_weights_and_scores_equal_a_plain_version(spark, sf_dir, table):
    labels, docs = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, truth = dict(table("documents", "doc_id, text")), {d: q for d, q in table("labels", "doc_id, quality") if q is not None}
    spread = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    taught = sorted((d for d in truth if d in texts and zlib.crc32(str(d).encode()) % 5), key=spread.get)
    expected = plain_fit([(plain_features(texts[d]), truth[d]) for d in taught])
    w = quality.fit(docs, labels)
    assert set(np.flatnonzero(w)) == set(expected) and all(abs(w[k] - v) < 1e-9 for k, v in expected.items())
    for r in quality.score(docs, w).select("text", "vellum_score").collect():
        margin = sum(expected.get(k, 0.0) * v for k, v in plain_features(r.text).items())
        assert abs(r.vellum_score - 1 / (1 + math.exp(-margin))) < 1e-4


def test_training_ignores_held_out_labels_and_is_repeatable(spark, sf_dir):
    labels, docs = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality", "toxic")
    assert np.array_equal(quality.fit(docs, labels), quality.fit(docs.repartition(7), turned))
    assert quality.sample(docs, labels, 10).count() == 10


def test_edges(spark, edges, empty):
    labels = spark.createDataFrame([(2, 1, None), (2, 0, 0), (None, 1, 1), (7, None, 0), (3, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    w = quality.fit(edges, labels)
    out = quality.score(edges, w)
    assert out.columns == [*edges.columns, "vellum_score"] and out.where("vellum_score BETWEEN 0 AND 1").count() == edges.count()
    assert quality.score(empty, w).count() == 0
    none = quality.fit(empty, labels.limit(0))
    assert {r.vellum_score for r in quality.score(edges, none).collect()} == {0.5}


def test_rows_and_columns_stay(spark, edges, empty):
    labels = spark.createDataFrame([(2, 1, None), (3, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    odd = edges.withColumns({"vellum_score": F.lit("mine"), "Vellum_Score_": F.lit("mine"), "a.b": F.lit("dot")})
    kept = quality.keep(odd, labels, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert {(r["vellum_score"], r["Vellum_Score_"], r["a.b"]) for r in kept.collect()} == {("mine", "mine", "dot")}
    assert quality.keep(empty, labels).count() == 0 and quality.keep(odd, labels, 1.1).count() == 0


def test_ftrl_separates():
    model = quality.Ftrl(8)
    for _ in range(50):
        model.update(np.array([0, 1]), np.ones(2), 1.0)
        model.update(np.array([0, 2]), np.ones(2), 0.0)
    w = model.weights(slice(None))
    assert w[1] > 0.5 and w[2] < -0.5 and w[3] == 0


def test_shape():
    assert [quality.shape(w) for w in ("the", "The", "THE!!", "a%%%", "12.5", "")] == ["a", "Aa", "A!", "a%", "9.9", ""]
    assert quality.shape("ab-9." * 500) == "a-9." * 500  # whole words, however long

import math
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from test_decontaminate import all_pairs
from test_pii import base_spans
from test_quality import plain_features, plain_fit
from test_sketches import kept
from tokenizers import Tokenizer

import corpus_pipeline
from vellum.llm import pii, quality, tokens


def brute_force(spark, sf_dir, table):
    """doc_id and text of what should reach the personal-data stage, by plain loops that call no stage."""
    rows = sorted(table("documents", "doc_id, text"))
    texts, truth = dict(rows), {d: q for d, q in table("labels", "doc_id, quality") if q is not None}
    spread = {r.doc_id: r.h for r in spark.createDataFrame([(d,) for d in truth], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    taught = sorted((d for d in truth if d in texts and zlib.crc32(str(d).encode()) % 5), key=spread.get)
    w = plain_fit([(plain_features(texts[d]), truth[d]) for d in taught])
    good = [(d, t) for d, t in rows if 1 / (1 + math.exp(-sum(w.get(k, 0.0) * v for k, v in plain_features(t).items()))) >= quality.THRESHOLD]
    one = kept(good, 0.8)
    single = [(d, t) for d, t in good if d in one]
    held = {d for d, _ in all_pairs(single, table("benchmark", "item_id, text"))}
    return [(d, t) for d, t in single if d not in held]


def test_run_equals_brute_force(spark, sf_dir, table):
    want = brute_force(spark, sf_dir, table)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in want}
    found = pii.detect(spark.createDataFrame(want, "doc_id long, text string"), pii.fit(spark))
    redacted = {}
    for r in found.select("row.doc_id", "text", pii._written("spans").alias("spans")).collect():
        out, at = [], 0
        for kind, a, b in (s.split(":") for s in r.spans.split(",") if s):
            if int(a) >= at:
                out += [r.text[at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        redacted[r.doc_id] = "".join(out) + r.text[at:]
    assert all(not base_spans(t) for t in redacted.values())
    library, length = Tokenizer.from_file(tokens.default_path()), defaultdict(int)
    for r in rows:
        length[r.doc_id] += r.length
    assert dict(length) == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in redacted.items()}


def test_empty_tables_go_through(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_stages_keep_columns_and_bear_edges(spark, edges, sf_dir, tmp_path):
    own = {"vellum_text": "t", "vellum_row": "r", "vellum_score": "s", "a.b": "d"}
    docs = edges.withColumns({k: F.lit(v) for k, v in own.items()})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert all({r[c] for r in docs.select(f"`{c}`").collect()} == {v} for c, v in own.items())
    assert docs.count() > 0

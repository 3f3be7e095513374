import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import _shared


def test_ranges_are_even_for_sparse_and_clustered_keys(spark):
    rng = random.Random(1)
    for keys in (list(range(5000)), [rng.randrange(-1000, 1000) for _ in range(4000)] + [1 << 62, -(1 << 62)], [7] * 300 + [rng.getrandbits(60) for _ in range(900)]):
        df = spark.createDataFrame([(k,) for k in keys], "k long")
        ranges = _shared.key_ranges(df, "k", 20)
        rows = df.groupBy(ranges.bucket("k").alias("b")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("b").collect()
        assert [r.b for r in rows] == list(range(ranges.count)) and tuple(r.lo for r in rows) == ranges.first_keys
        assert all(a.hi < b.lo for a, b in zip(rows, rows[1:], strict=False))
        assert max(r.n for r in rows) <= max(400, 2 * len(keys) // 20)


def test_few_keys_and_nulls(spark):
    df = spark.createDataFrame([(None,), (3,), (None,)], "k long")
    ranges = _shared.key_ranges(df, "k", 8)
    assert ranges.count == 1 and {r.b for r in df.select(ranges.bucket("k").alias("b")).collect()} == {0}
    assert _shared.key_ranges(df.where("k > 9"), "k", 8).count == 1
    assert _shared.key_ranges(df, "k", 1).first_keys == (3,)


def test_hot_keys_are_joined_apart(spark):
    rows = spark.createDataFrame([(k % 3 if k < 3000 else k,) for k in range(5000)], "k long")
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), (F.max("k") * 2).alias("v"))
    out = _shared.often_first(rows, classes, ["k"], "n", 5000)
    assert out.count() == 5000 and out.where("v <> 2 * k").count() == 0


def test_scratch_tables_can_be_discarded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_shared, "shared_dir", lambda _: str(tmp_path))
    assert _shared.stored(spark.range(3), "x").count() == 3
    assert list(tmp_path.iterdir())
    _shared.discard(spark)
    assert not list(tmp_path.iterdir())


class Session:
    """As much of a session as shared_dir reads."""

    def __init__(self, named, master):
        self.sparkContext = self.conf = self
        self.named, self.master, self.applicationId = named, master, "app"

    def get(self, key, default=None):
        return self.named

    def getConf(self):
        return self


def test_shared_folder(tmp_path):
    assert _shared.shared_dir(Session("file:///x/", "yarn")) == "file:///x"
    own = _shared.shared_dir(Session(None, "local[4]"))
    assert own and own == _shared.shared_dir(Session(None, "local[4]"))
    with pytest.raises(RuntimeError):
        _shared.shared_dir(Session(None, "local-cluster[3,2,1000]"))

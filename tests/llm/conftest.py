import os

import duckdb
import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet consectetur 12.5 a.b@c.de " * 12_000
EDGES = [
    (None, "a row without an id", "en", None),
    (None, None, None, None),
    (-5, None, "en", "s"),
    (1, "", "en", "s"),
    (2, "one", "en", "s"),
    (3, "the same text in several rows of this table", None, "s"),
    (3, "the same text in several rows of this table", None, "s"),
    (3, "another text of the same id", "en", "s"),
    (7, "the same text in several rows of this table", "en", "s"),
    (8, LONG, "en", "s"),
    (9, "x" * 300_000, "en", "s"),
    (1 << 60, "é ñ 日本 \U0001f600 ́ don't  'S\tx\r\ny\x0bz", "fr", "s"),
    (11, " \n\t ", "en", "s"),
]
CLASHING = (
    "fp n least root node row id component_id bucket home own score vellum key token times common base delta start end left right m kind spans host path way "
    "template rate bad lab virtual_slot shard slot size before piece length part bin fill members marks code block cut value large label labels quality spread"
).split()


@pytest.fixture
def edges(spark):
    """Documents with nulls, repeats, empty and very long texts, and many more columns."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(c) for c in CLASHING if c != "vellum"})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def table(sf_dir):
    def rows(name, columns, sf=None):
        return duckdb.connect().execute(f"SELECT {columns} FROM '{sf or sf_dir}/{name}.parquet'").fetchall()

    return rows


@pytest.fixture(scope="session", autouse=True)
def quiet_tokenizers():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

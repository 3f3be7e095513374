"""Helpers that the training-data operators share: scratch tables, folds, id ranges."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all
    runs on this machine, as in local tests, a temporary folder stands in for it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="vellum-")
    return _OWN[context.applicationId]


_SCOPES: list[list[str]] = []


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vellum-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, below this application's."""
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables made inside; what is to stay must have been written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def stored(df: DataFrame, label: str, compression: str = "zstd", **options: str) -> DataFrame:
    """df written to the shared folder, with the writer's options, and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(compression=compression, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete every scratch table of this application. No result that still reads one survives this."""
    remove(spark, _own_dir(spark))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most ``rows`` rows and about ``size`` bytes of a column, so that little is held as Python objects at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = np.arange(batch.num_rows) // rows
        if column in batch.schema.names:
            own = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = start + ((np.cumsum(own) - own) // size) * batch.num_rows
        edge = [0, *(np.flatnonzero(start[1:] != start[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge, edge[1:], strict=False):
            yield batch.slice(a, b - a)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def map_rows(docs: DataFrame, rows, added: Iterable[T.StructField] = ()) -> DataFrame:
    """docs.mapInArrow(rows) whose rows have docs' columns and the added ones. All but text go by number, so any names will do."""
    text = next((k for k, c in enumerate(docs.columns) if c.lower() == "text"), None)
    fields = [*docs.schema.fields, *added]
    numbered = [T.StructField("text" if k == text else f"c{k}", f.dataType) for k, f in enumerate(fields)]
    safe = docs.toDF(*[f.name for f in numbered[: len(docs.columns)]])
    return safe.mapInArrow(rows, T.StructType(numbered)).toDF(*[f.name for f in fields])


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores behind it a name that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


@dataclass(frozen=True)
class Ranges:
    """Runs of ascending keys of near-equal row counts, and the least key that each one holds."""

    starts: tuple[int, ...]
    first_keys: tuple[int, ...] = ()

    @property
    def count(self) -> int:
        return max(1, len(self.starts))

    def bucket(self, key: str) -> Column:
        """The number of the key's range, found among every m-th start and then among m of them; null keys are in the first."""
        m = max(1, math.isqrt(self.count))
        longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
        reached = lambda starts: F.size(F.filter(starts, lambda s: s <= F.col(key)))
        coarse = F.greatest(reached(longs(self.starts[::m])), F.lit(1))
        fine = F.greatest(reached(F.slice(longs(self.starts), (coarse - 1) * m + 1, F.lit(m))), F.lit(1))
        return F.when(F.col(key).isNull(), 0).otherwise((coarse - 1) * m + fine - 1).cast("int")


def key_ranges(df: DataFrame, key: str, buckets: int) -> Ranges:
    """Cut df into at most ``buckets`` ranges of an integer key, by approximate quantiles. Only the key column is read.

    What comes to the driver is two numbers a range, however sparse or clustered the keys are.
    """
    shares = [k / buckets for k in range(1, buckets)]
    wanted = F.percentile_approx(key, shares or [0.5], min(1_000_000, max(10_000, 100 * buckets)))
    low, found = df.agg(F.min(key), wanted).first()
    if low is None:
        return Ranges((0,))
    starts = Ranges(tuple(sorted({low, *(found if shares else ())})))
    firsts = df.where(F.col(key).isNotNull()).groupBy(starts.bucket(key).alias("bucket")).agg(F.min(key).alias("first")).collect()
    # quantiles are doubles, so beyond 2**53 a start need not be a key; ranges without rows join the one before
    return Ranges(*(tuple(x) for x in zip(*((starts.starts[r["bucket"]], r["first"]) for r in sorted(firsts, key=lambda r: r["bucket"])), strict=True)))


def often_first(rows: DataFrame, classes: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows inner-joined with their classes, without a hot key in one task.

    classes has a row for each key and the count of its rows. Keys with over a
    thousandth of all rows number fewer than 1000: those are broadcast, and the
    rest is joined by a shuffle.
    """
    often = F.broadcast(classes.where(F.col(count) * 1000 > total).drop(count))
    seldom = classes.where(F.col(count) * 1000 <= total).drop(count)
    return rows.join(often, keys).unionByName(rows.join(often.select(*keys), keys, "left_anti").join(seldom, keys))

"""A directory tree as a table: the ``vellum_tree`` data source.

Rows are files (everything that is not a directory itself, links included) and the directories
that were skipped. A link to a directory is a file here: it is not descended. The
root is exempt from the skip list; a root that is a link is one file. A directory that cannot be
read fails the query.

The driver opens directories breadth-first only until there is enough to share out, and none beyond WIDE
entries: a wider directory goes to several tasks, each of which lists it and takes the names of its share by
their checksum. Tasks walk the rest. Options: path, skip (base names, comma-separated), partitions.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellum.functions import paths

SCHEMA = "entry string, path string, rel_path string, size long, mod_time timestamp, is_regular boolean, stat_error string"
ARROW = pa.schema([
    ("entry", pa.string()), ("path", pa.string()), ("rel_path", pa.string()), ("size", pa.int64()),
    ("mod_time", pa.timestamp("us", "UTC")), ("is_regular", pa.bool_()), ("stat_error", pa.string()),
])
ROWS = 8192
WIDE = 10_000


def described(path: str, rel_path: str) -> tuple:
    """The row of one file; a link is followed."""
    try:
        found = os.stat(path)
    except OSError as e:
        return "file", path, rel_path, None, None, None, f"{e.strerror}: {path}"
    return "file", path, rel_path, found.st_size, found.st_mtime_ns // 1000, stat.S_ISREG(found.st_mode), None


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)


@dataclass
class Share(InputPartition):
    """Directories to walk (path, share, of how many shares), and rows that are settled already (path, relative path, skipped or not)."""

    directories: list[tuple[str, int, int]]
    settled: list[tuple[str, str, bool]]

    def __init__(self, directories, settled):
        super().__init__(None)
        self.directories, self.settled = directories, settled


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.skip = frozenset(x for x in options.get("skip", "").split(",") if x)
        self.shares = max(1, int(options.get("partitions", "16")))

    def _inside(self, path: str) -> str:
        return os.path.relpath(path, self.root)

    def _entries(self, directory: str, share: int = 0, shares: int = 1) -> Iterator[tuple[str, str | None, bool]]:
        """(path, relative path or None for a directory to walk, skipped or not) of one directory, or of a share of its names."""
        with os.scandir(directory) as entries:
            for e in entries:
                if shares > 1 and zlib.crc32(os.fsencode(e.name)) % shares != share:
                    continue
                if not e.is_dir(follow_symlinks=False):
                    yield e.path, self._inside(e.path), False
                elif e.name in self.skip:
                    yield e.path, self._inside(e.path), True
                else:
                    yield e.path, None, False

    def partitions(self) -> list[Share]:
        if os.path.islink(self.root) or not os.path.isdir(self.root):
            os.lstat(self.root)
            return [Share([], [(self.root, ".", False)])]
        waiting, settled, wide = deque([self.root]), [], []
        while waiting and len(waiting) < 4 * self.shares and len(settled) < 4 * WIDE:
            directory = waiting.popleft()
            own = list(islice(self._entries(directory), WIDE + 1))
            if len(own) > WIDE:
                wide.append(directory)
                continue
            waiting.extend(path for path, inside, _ in own if inside is None)
            settled += [x for x in own if x[1] is not None]
        shares = [Share([], []) for _ in range(self.shares if wide else min(self.shares, max(1, len(waiting) + len(settled))))]
        for directory in wide:
            for k, share in enumerate(shares):
                share.directories.append((directory, k, len(shares)))
        for k, directory in enumerate(waiting):
            shares[k % len(shares)].directories.append((directory, 0, 1))
        for k, row in enumerate(settled):
            shares[k % len(shares)].settled.append(row)
        return shares

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        def row(path: str, inside: str, skipped: bool) -> tuple:
            return ("dir-skipped", path, inside, None, None, None, None) if skipped else described(path, inside)

        def rows():
            for x in share.settled:
                yield row(*x)
            waiting = list(share.directories)
            while waiting:
                for path, inside, skipped in self._entries(*waiting.pop()):
                    if inside is None:
                        waiting.append((path, 0, 1))
                    else:
                        yield row(path, inside, skipped)

        yield from batches(rows())


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellum_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def entries(spark: SparkSession, directory: str, skip: frozenset[str] = frozenset()) -> DataFrame:
    """Files and skipped directories below directory, with name and extension."""
    spark.dataSource.register(TreeSource)
    found = spark.read.format("vellum_tree").option("path", directory).option("skip", ",".join(sorted(skip))).option("partitions", spark.sparkContext.defaultParallelism).load()
    return _named(found)


def files(spark: SparkSession, file_paths: list[str], directory: str) -> DataFrame:
    """Rows of the given files: no walk, no skip list."""
    root = os.path.abspath(directory)
    rows = spark.createDataFrame([(p,) for p in file_paths], "path string")

    def described_rows(parts):
        for part in parts:
            yield from batches(described(p, os.path.relpath(os.path.abspath(p), root)) for p in part.column("path").to_pylist())

    found = rows.mapInArrow(described_rows, SCHEMA)
    return _named(found)


def _named(found: DataFrame) -> DataFrame:
    return found.withColumns({"name": paths.base_name(F.col("path")), "extension": paths.extension(F.col("path"))})


def with_content(kept: DataFrame, partition_bytes: int = 64 << 20) -> DataFrame:
    """Adds content and read_error to files. Small and large files are dealt out so that tasks read about alike."""
    spark = kept.sparkSession
    n = spark.sparkContext.defaultParallelism
    total = kept.agg(F.sum("size")).first()[0] or 0
    schema = T.StructType([*kept.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())])

    def rows(parts):
        for part in parts:
            for k, path in enumerate(part.column("path").to_pylist()):
                try:
                    with open(path, "rb") as f:
                        content, problem = f.read(), None
                except OSError as e:
                    content, problem = None, f"{e.strerror}: {path}"
                own = part.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([content], pa.binary()), pa.array([problem], pa.string())], names=schema.names)

    # only the listing's rows are dealt; contents stay in the task that read them
    return kept.repartition(max(n, -(-total // partition_bytes)), "path").mapInArrow(rows, schema)

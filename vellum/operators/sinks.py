"""Where results go: JSON, tables for reading, and stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.errors import VellumError

# Fixed order of the fields of a document's JSON, which has neither properties_json nor parse_error.
DOCUMENT_FIELDS = (
    ("appType", "app_type"), ("chunks", "chunks"), ("extension", "extension"), ("mimeType", "mime_type"), ("modTime", "mod_time"), ("name", "name"),
    ("path", "path"), ("properties", "properties"), ("relPath", "rel_path"), ("repo", "repo"), ("size", "size"), ("uri", "uri"),
)
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}


def document_json(documents: DataFrame) -> Column:
    """A document as JSON; nulls stay. Fields that documents lacks are left out."""
    return F.to_json(F.struct(*[F.col(own).alias(name) for name, own in DOCUMENT_FIELDS if own in documents.columns]), JSON)


def repo_json() -> Column:
    """One repository as JSON, in the order of its fields."""
    return F.to_json(F.struct("application", "name", "directory", "config", "db"), JSON)


def repos_json(repos: DataFrame) -> DataFrame:
    """One row: the catalog by name as a JSON array, [] if it is empty."""
    item = F.struct(F.col("name"), F.struct("application", "name", "directory", "config", "db").alias("item"))
    return repos.agg(F.coalesce(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["item"]), JSON), F.lit("[]")).alias("repos"))


def aligned(header: list[str], rows: list[tuple]) -> str:
    """A table with two blanks between columns; the last column is not padded."""
    lines = [tuple(header), *rows]
    width = [max(len(str(line[k])) for line in lines) for k in range(len(header))]
    return "".join("".join(str(x).ljust(w + 2) for x, w in zip(line[:-1], width, strict=False)) + str(line[-1]) + "\n" for line in lines)


def repos_table(repos: DataFrame) -> str:
    return aligned(["NAME", "APPLICATION", "DIRECTORY", "CONFIG", "DB"], [tuple(r) for r in repos.orderBy("name").toLocalIterator()])


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks and their vectors as Parquet, by repository; a repository's earlier rows are replaced."""
    if "repo" not in chunks.columns:
        raise VellumError("chunks have no repo column")
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)

"""Applications and the file formats that each one's repositories hold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.errors import UnknownApplication
from vellum.functions import frontmatter, properties


class Parser(Protocol):
    """A format: builds columns over the text of many files; keeps no state."""

    name: str
    extension: str

    def parse(self, files: DataFrame) -> DataFrame:
        """Adds status, body, lines_before, properties_json and parse_error to files with a content column."""


@dataclass(frozen=True)
class Markdown:
    name: str = "Markdown"
    extension: str = ".md"

    def parse(self, files: DataFrame) -> DataFrame:
        text = frontmatter.unix_lines(frontmatter.text_of(F.col("content")))
        part = files.withColumn("note", frontmatter.split(text))
        read = part.withColumn("read", properties.properties(F.col("note.front_matter")))
        return read.select(
            *files.columns, "note.status", "note.body", "note.lines_before", "read.properties_json",
            F.coalesce(frontmatter.error(F.col("note.status")), F.col("read.error")).alias("parse_error"),
        )


def _no_uri(path: Column) -> Column:
    """No link scheme is specified: every uri is null."""
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Strategy:
    """What to skip and how to read one application's repositories; fixed during a run."""

    application: str
    skip_directories: frozenset[str] = frozenset()
    parsers: dict[str, Parser] = field(default_factory=dict)
    uri: Callable[[Column], Column] = _no_uri
    load: Callable[[DataFrame], DataFrame] = lambda documents: documents

    def extensions(self) -> list[str]:
        return sorted(self.parsers)


STRATEGIES = {"obsidian": Strategy("obsidian", frozenset({".obsidian"}), {".md": Markdown()})}


def strategy(application: str) -> Strategy:
    try:
        return STRATEGIES[application]
    except KeyError:
        raise UnknownApplication(f"'{application}': unknown application") from None

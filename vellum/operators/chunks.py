"""Chunks of a body by its headings, with array functions inside each row: no shuffle, no Python.

A heading is a line of one to six '#' and a blank, outside fenced code (lines that
begin with three backticks open and close a fence). A chunk runs from its heading to the line
before the next; its heading path is that heading and those above it. What precedes the first
heading is a chunk with an empty path, unless it is blank. The empty line after a final LF is no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.bind import let

TYPE = "array<struct<text: string, heading_path: array<string>, start_line: int, end_line: int>>"
_MARK = "array<struct<at: int, path: array<struct<level: int, title: string>>>>"


def lines_of(body: Column) -> Column:
    return let(F.split(body, "\n"), lambda found: F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found))


def _headings(lines: Column) -> Column:
    """(place, path) of every heading. Only lines that can matter enter the fold."""
    numbered = F.transform(lines, lambda l, i: F.struct(i.alias("at"), l.alias("line")))
    marks = F.filter(numbered, lambda x: F.startswith(x["line"], F.lit("```")) | F.rlike(x["line"], F.lit("^#{1,6} ")))
    zero = F.struct(F.lit(False).alias("fenced"), F.array().cast(_MARK).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        level = F.length(F.regexp_extract(x["line"], "^(#{1,6}) ", 1)).cast("int")
        own = F.struct(level.alias("level"), F.trim(F.substr(x["line"], level + 1)).alias("title"))
        before = F.coalesce(F.try_element_at(acc["found"], F.lit(-1))["path"], F.array().cast("array<struct<level: int, title: string>>"))
        path = F.concat(F.filter(before, lambda h: h["level"] < level), F.array(own))
        is_fence = F.startswith(x["line"], F.lit("```"))
        taken = F.when(is_fence | acc["fenced"], acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(x["at"].alias("at"), path.alias("path")))))
        return F.struct(F.when(is_fence, ~acc["fenced"]).otherwise(acc["fenced"]).alias("fenced"), taken.alias("found"))

    return F.aggregate(marks, zero, step, lambda acc: acc["found"])


def chunks(body: Column, lines_before: Column) -> Column:
    """The chunks of a body whose first line is the file's line lines_before + 1; null for a null body."""

    def cut(note: Column) -> Column:
        lines, offset = note["lines"], note["offset"]

        def at(found: Column) -> Column:
            first = F.coalesce(F.try_element_at(found, F.lit(1))["at"], F.size(lines))
            lead = F.struct(F.lit(0).alias("from"), first.alias("to"), F.array().cast("array<string>").alias("heading_path"))
            own = F.transform(found, lambda h, i: F.struct(h["at"].alias("from"), F.coalesce(F.get(found, i + 1)["at"], F.size(lines)).alias("to"), F.transform(h["path"], lambda p: p["title"]).alias("heading_path")))
            rows = F.transform(
                F.concat(F.array(lead), own),
                lambda s: F.struct(
                    F.array_join(F.slice(lines, s["from"] + 1, s["to"] - s["from"]), "\n").alias("text"),
                    s["heading_path"].alias("heading_path"),
                    (offset + s["from"] + 1).cast("int").alias("start_line"),
                    (offset + s["to"]).cast("int").alias("end_line"),
                ),
            )
            return F.filter(rows, lambda c: (F.size(c["heading_path"]) > 0) | F.rlike(c["text"], F.lit(r"\S")))

        return let(_headings(lines), at)

    def of(given: Column) -> Column:
        note = F.struct(lines_of(given["body"]).alias("lines"), given["offset"].alias("offset"))
        return F.when(given["body"].isNotNull(), let(note, cut))

    # all is bound once: what a lambda takes from outside would be worked out again for each element
    return let(F.struct(body.alias("body"), lines_before.alias("offset")), of).cast(TYPE)


def exploded(documents: DataFrame, *keys: str) -> DataFrame:
    """A row for each chunk: the keys, chunk_no from 0, text, heading_path, start_line, end_line."""
    return documents.select(*keys, F.posexplode("chunks").alias("chunk_no", "c")).select(*keys, "chunk_no", "c.*")


def embedding_input(heading_path: Column, text: Column) -> Column:
    """What is embedded: the heading path, then the text."""
    return F.concat_ws("\n", F.when(F.size(heading_path) > 0, F.array_join(heading_path, " > ")), text)

"""Front matter: the metadata block at the head of a note. String functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.errors import UNTERMINATED
from vellum.functions.bind import let

OPEN, CLOSE = "---\n", "\n---\n"


def unix_lines(text: Column) -> Column:
    """CR LF becomes LF; a lone CR stays."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def text_of(content: Column) -> Column:
    """Bytes as text. A cast keeps bytes that are not UTF-8."""
    return content.cast("string")


def split(text: Column) -> Column:
    """struct(status, front_matter, body, lines_before) of text with LF line ends.

    status is none, empty, ok or unterminated. The block opens with a first line of
    exactly three dashes and closes at the first later such line that ends in LF.
    front_matter is null unless ok or empty; body is null if unterminated;
    lines_before counts the lines that precede the body.
    """

    def parts(x: Column) -> Column:
        whole, rest = x["text"], x["rest"]
        has, at = F.startswith(whole, F.lit(OPEN)), x["at"]
        empty, ok = has & F.startswith(rest, F.lit(OPEN)), has & (at > 0)
        block = F.substr(rest, F.lit(1), at - 1)
        return F.struct(
            F.when(~has, "none").when(empty, "empty").when(ok, "ok").otherwise("unterminated").alias("status"),
            F.when(empty, "").when(ok, block).alias("front_matter"),
            F.when(~has, whole).when(empty, F.substr(rest, F.lit(len(OPEN) + 1))).when(ok, F.substr(rest, at + len(CLOSE))).alias("body"),
            F.when(~has, 0).when(empty, 2).when(ok, 3 + F.length(block) - F.length(F.replace(block, F.lit("\n")))).alias("lines_before"),
        )

    after = lambda t: F.struct(t.alias("text"), F.substr(t, F.lit(len(OPEN) + 1)).alias("rest"))
    found = lambda x: F.struct(x["text"].alias("text"), x["rest"].alias("rest"), F.instr(x["rest"], F.lit(CLOSE)).alias("at"))
    return let(text, lambda t: let(after(t), lambda x: let(found(x), parts)))


def error(status: Column) -> Column:
    return F.when(status == "unterminated", F.lit(UNTERMINATED))

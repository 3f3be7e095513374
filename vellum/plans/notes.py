"""Notes and their places, made from the documents table: as columns and, for checking, as SQL.

Every document becomes a note around its whole text. The form goes by doc_id % 8, so that
each case of front matter occurs: 0 none, 1 plain, 2 CR LF, 3 empty, 4 unterminated, 5 nothing
but front matter, 6 blank, 7 no line end after the closing dashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = ("draft", "open", "done")
SUFFIXES = (".md", ".MD", ".txt", ".canvas", ".md")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and note."""
    number = F.col("doc_id").cast("string")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS]), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("---\ntitle: Note "), number, F.lit("\nstatus: "), status, F.lit("\nsource: "), F.col("source"), F.lit("\nrating: "), (F.col("doc_id") % 7).cast("string"), F.lit("\n---\n"))
    body = F.concat(F.lit("# Note "), number, F.lit("\n"), text, F.lit("\n## Part\n```\n# code\n```\n### Deep\nend\n"))
    form = F.col("doc_id") % 8
    note = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(head, body))
        .when(form == 2, F.replace(F.concat(head, body), F.lit("\n"), F.lit("\r\n")))
        .when(form == 3, F.concat(F.lit("---\n---\n"), body))
        .when(form == 4, F.concat(F.lit("---\ntitle: open\n"), body))
        .when(form == 5, head)
        .when(form == 6, F.concat(F.lit("---\n\n---\n"), body))
        .otherwise(F.concat(F.lit("---\ntitle: cut\n"), text, F.lit("\n---")))
    )
    return documents(spark, sf_dir).select("doc_id", note.alias("note"))


NOTES_SQL = """
    parts AS (
        SELECT doc_id, doc_id % 8 AS form, coalesce(text, '') AS t,
               concat('---', chr(10), 'title: Note ', doc_id, chr(10), 'status: ', (['draft', 'open', 'done'])[doc_id % 3 + 1], chr(10), 'source: ', source, chr(10), 'rating: ', doc_id % 7, chr(10), '---', chr(10)) AS head,
               concat('# Note ', doc_id, chr(10), coalesce(text, ''), chr(10), '## Part', chr(10), '```', chr(10), '# code', chr(10), '```', chr(10), '### Deep', chr(10), 'end', chr(10)) AS body0
        FROM documents),
    notes AS (
        SELECT doc_id, CASE form
            WHEN 0 THEN body0
            WHEN 1 THEN head || body0
            WHEN 2 THEN replace(head || body0, chr(10), chr(13) || chr(10))
            WHEN 3 THEN '---' || chr(10) || '---' || chr(10) || body0
            WHEN 4 THEN '---' || chr(10) || 'title: open' || chr(10) || body0
            WHEN 5 THEN head
            WHEN 6 THEN '---' || chr(10) || chr(10) || '---' || chr(10) || body0
            ELSE '---' || chr(10) || 'title: cut' || chr(10) || t || chr(10) || '---' END AS note
        FROM parts),
    cut AS (
        SELECT doc_id, t, starts_with(t, '---' || chr(10)) AS has, substr(t, 5) AS rest, instr(substr(t, 5), chr(10) || '---' || chr(10)) AS pos
        FROM (SELECT doc_id, replace(note, chr(13) || chr(10), chr(10)) AS t FROM notes)),
    split AS (
        SELECT doc_id,
               CASE WHEN NOT has THEN 'none' WHEN starts_with(rest, '---' || chr(10)) THEN 'empty' WHEN pos > 0 THEN 'ok' ELSE 'unterminated' END AS status,
               CASE WHEN NOT has THEN NULL WHEN starts_with(rest, '---' || chr(10)) THEN '' WHEN pos > 0 THEN substr(rest, 1, pos - 1) END AS front_matter,
               CASE WHEN NOT has THEN t WHEN starts_with(rest, '---' || chr(10)) THEN substr(rest, 5) WHEN pos > 0 THEN substr(rest, pos + 5) END AS body,
               CASE WHEN NOT has THEN 0 WHEN starts_with(rest, '---' || chr(10)) THEN 2 WHEN pos > 0 THEN 3 + length(substr(rest, 1, pos - 1)) - length(replace(substr(rest, 1, pos - 1), chr(10), '')) END AS lines_before
        FROM cut)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and rel_path: some below a skipped directory, with several suffixes."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 5 + 1).cast("int"))
    hidden = F.when(F.col("doc_id") % 11 == 0, F.lit("/.obsidian")).otherwise("")
    return documents(spark, sf_dir).select("doc_id", F.concat("source", hidden, F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix).alias("rel_path"))


PLACED_SQL = """
    placed AS (
        SELECT doc_id, concat(source, CASE WHEN doc_id % 11 = 0 THEN '/.obsidian' ELSE '' END, '/', lang, '/doc_', doc_id, (['.md', '.MD', '.txt', '.canvas', '.md'])[doc_id % 5 + 1]) AS rel_path
        FROM documents),
    typed AS (SELECT *, lower(regexp_extract(rel_path, '(\\.[^./]*)$', 1)) AS extension, list_contains(string_split(rel_path, '/')[1:-2], '.obsidian') AS below FROM placed)"""

"""Token files: ids in canonical Huffman codes, in blocks that decode on their own.

A token file is a folder of two Parquet tables. ``codebook`` (id, bits) has the
code lengths, from which the codes follow. ``blocks`` has a row for each block, in
ascending doc_id order over its part files: bucket and first_token (the block's
place), documents, tokens, and ``body``, whose layout is, little-endian:

    "VTB1", u32 documents, u32 checkpoints, u32 0
    i64 doc_id (null: the least integer) | u32 ids | by document
    u64 bit offset of every 256th id of each document, from the codes' first bit
    the codes, each document's from a byte of its own

Nulls: a null text is empty and so has the end id alone; a null doc_id comes first.
Equal doc_ids stay apart, by their number of ids and then by their codes, so rows that tie in all agree in ids too.
An empty table gives a file without blocks. A document is never cut over blocks, so a block is
BLOCK ids or one very long document beyond that. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import _shared, huffman, tokens

BLOCK = 1 << 18
NO_ID = -(1 << 63)


def _least(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def token_table(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id and ids of each whole text, 16 bits each where the vocabulary allows, as they are met.

    Every task adds one last row that has counts only: how often it met each id.
    """

    def rows(batches):
        model = tokens.encoder(path)
        width = "<u2" if model.vocabulary <= 1 << 16 else "<u4"
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        total = np.zeros(model.vocabulary, dtype=np.int64)
        for batch in _shared.slices(batches):
            ids = [np.frombuffer(x + end, "<u4").astype(width) for x in model.encode(batch.column("text").to_pylist())]
            total += np.bincount(np.concatenate(ids), minlength=len(total))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        used = np.flatnonzero(total)
        counts = np.stack([used, total[used]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names=names)

    names = ["doc_id", "ids", "counts"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, ids binary, counts binary")


def _flat(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    size = np.dtype(width).itemsize
    return np.frombuffer(b"".join(parts), width), np.array([len(x) // size for x in parts], dtype=np.int64)


def id_counts(table: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all texts, from the counts of the tasks; at most a vocabulary of rows comes back."""

    def rows(batches):
        for batch in batches:
            for found in batch.column("counts").to_pylist():
                used, n = np.frombuffer(found, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], names=["id", "n"])

    out = np.zeros(vocabulary, dtype=np.int64)
    for r in table.where(F.col("counts").isNotNull()).select("counts").mapInArrow(rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


CODED = "bucket int, doc_id long, n int, marks binary, code binary"
BLOCKS = "bucket int, first_token long, documents int, tokens long, body binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Tokenise docs and write the token file at path."""
    spark = docs.sparkSession
    model = tokens.encoder(tokenizer)
    width, vocabulary = ("<u2" if model.vocabulary <= 1 << 16 else "<u4"), model.vocabulary
    table = _shared.stored(token_table(docs, tokenizer, end_id), "ids", "snappy")
    lengths = huffman.code_lengths(id_counts(table, vocabulary))
    ids = table.where(F.col("counts").isNull()).select("doc_id", "ids")
    ranges = _shared.key_ranges(ids, "doc_id", _shared.partitions(spark))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def coded(batches):
        book = huffman.Codebook(lengths)
        for batch in batches:
            for part in _shared.slices([batch], 512):
                flat, counts = _flat(part.column("ids"), width)
                data, byte, at = book.encode(flat, counts)
                stops = np.concatenate([[0], np.cumsum(huffman.checkpoints(counts))])
                at = [(at[a:b] - 8 * s).astype("<u8").tobytes() for a, b, s in zip(stops, stops[1:], byte, strict=False)]
                codes = [data[a:b] for a, b in zip(byte, byte[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("bucket"), part.column("doc_id"), pa.array(counts, pa.int32()), pa.array(at, pa.binary()), pa.array(codes, pa.binary())],
                    names=["bucket", "doc_id", "n", "marks", "code"],
                )

    (
        ids.withColumn("bucket", ranges.bucket("doc_id"))
        .mapInArrow(coded, CODED)
        .repartitionById(ranges.count, "bucket")
        .sortWithinPartitions("bucket", "doc_id", "n", "code")
        .mapInArrow(_blocks, BLOCKS)
        .write.parquet(f"{path}/blocks")
    )


def _blocks(batches):
    """Runs of coded documents as blocks; the rows come sorted by bucket and doc_id."""
    held: list[tuple] = []
    bucket, first, size = None, 0, 0

    def block():
        nonlocal first, size
        marks, shift = [], 0
        for _, _, at, code in held:
            marks.append(np.frombuffer(at, "<u8") + np.uint64(8 * shift))
            shift += len(code)
        marks = np.concatenate(marks)
        body = b"".join(
            [
                b"VTB1",
                np.array([len(held), len(marks), 0], "<u4").tobytes(),
                np.array([NO_ID if d is None else d for d, *_ in held], "<i8").tobytes(),
                np.array([n for _, n, *_ in held], "<u4").tobytes(),
                marks.astype("<u8").tobytes(),
                *[code for *_, code in held],
            ]
        )
        out = pa.RecordBatch.from_pylist(
            [{"bucket": bucket, "first_token": first, "documents": len(held), "tokens": size, "body": body}],
            schema=pa.schema([("bucket", pa.int32()), ("first_token", pa.int64()), ("documents", pa.int32()), ("tokens", pa.int64()), ("body", pa.binary())]),
        )
        first, size = first + size, 0
        held.clear()
        return out

    for batch in batches:
        for b, *row in zip(*(batch.column(k).to_pylist() for k in ("bucket", "doc_id", "n", "marks", "code")), strict=True):
            if b != bucket:
                if held:
                    yield block()
                bucket, first = b, 0
            held.append(tuple(row))
            size += row[1]
            if size >= BLOCK:
                yield block()
    if held:
        yield block()


def read_codebook(spark: SparkSession, path: str) -> huffman.Codebook:
    """At most a vocabulary of rows."""
    rows = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, dtype=np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return huffman.Codebook(lengths)


def open_block(body: bytes, table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, counts and all ids of one block."""
    if body[:4] != b"VTB1":
        raise ValueError("not a token block")
    n, marks, _ = np.frombuffer(body, "<u4", 3, 4)
    at = 16
    doc_ids = np.frombuffer(body, "<i8", n, at)
    counts = np.frombuffer(body, "<u4", n, at + 8 * n).astype(np.int64)
    offsets = np.frombuffer(body, "<u8", marks, at + 12 * n)
    return doc_ids, counts, huffman.decode(table, width, body[at + 12 * int(n) + 8 * int(marks) :], offsets, counts)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, and its ids (32 bits each) if wanted."""
    book = read_codebook(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = sorted((r["bucket"], r["n"]) for r in blocks.groupBy("bucket").agg(F.sum("tokens").alias("n")).collect())  # a row a bucket
    before, total = [0] * (max([b for b, _ in sums], default=0) + 1), 0
    for b, n in sums:
        before[b] = total
        total += n

    def rows(batches):
        table = book.decoder()
        for batch in batches:
            for bucket, first, body in zip(*(batch.column(k).to_pylist() for k in ("bucket", "first_token", "body")), strict=True):
                doc_ids, counts, ids = open_block(body, table, book.width)
                raw, ends = ids.astype("<u4", copy=False).tobytes(), np.cumsum(counts)
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [
                    pa.array(doc_ids, mask=doc_ids == NO_ID),
                    pa.array(before[bucket] + first + ends - counts),
                    pa.array(counts),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.select("bucket", "first_token", "body").mapInArrow(rows, schema)


def op6_token_file(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = _shared.scratch_path(spark, "token-file")
    write(_shared.table(spark, sf_dir, "documents"), path, tokenizer or tokens.default_path(), end_id=2)
    return read(spark, path)

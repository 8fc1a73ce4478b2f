"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(modulus: int = 5) -> Column:
    """crc32 of doc_id as text, modulo 5; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset and all runs in one process,
    as in tests, a temporary folder takes its place."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarrylake-"))
        found = sc.getCheckpointDir()
    return found


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Cuts the lineage with a Parquet table in the shared folder; a lost executor then costs no recomputation. The table and where it stands."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrylake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    return stored_at(df)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that stored_at has written and nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from here on: whole texts travel in them, and each Python worker holds a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def released(work):
    """work, a function of batches for mapInArrow; when its task ends, freed memory goes back to the system, since Python workers outlive tasks and
    share their executor's memory."""

    @functools.wraps(work)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return tidy


def each_released(work):
    """work, a function of the tables of a group, in the same way after each group."""

    def tidy(*tables: pa.Table) -> pa.Table:
        try:
            return work(*tables)
        finally:
            release()

    # Spark asks for the number of parameters
    return (lambda one: tidy(one)) if len(inspect.signature(work).parameters) == 1 else (lambda one, other: tidy(one, other))


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_of(spark: SparkSession, n_bytes: int, piece_bytes: int) -> int:
    """How many pieces of about piece_bytes the bytes make; at least the shuffle's partitions, so that all tasks have work."""
    return max(shuffle_partitions(spark), -(-int(n_bytes) // piece_bytes))


def _packed_block(block: int, docs: list[tuple[int | None, bool, bytes]]) -> tuple[int, bytes, bytes]:
    ids = np.array([0 if d is None else d for d, _, _ in docs], np.int64)
    marks = np.array([(d is None) + 2 * bool(f) for d, f, _ in docs], np.uint8)
    head = np.concatenate([ids, np.array([len(t) for _, _, t in docs], np.int64)]).tobytes() + marks.tobytes()
    press = zstandard.ZstdCompressor(3).compress
    return block, press(head), press(b"".join(t for _, _, t in docs))


def _pack(n_blocks: int, flush_bytes: int = 64 << 20):
    return released(lambda batches: _packed(batches, n_blocks, flush_bytes))


def _packed(batches: Iterator[pa.RecordBatch], n_blocks: int, flush_bytes: int) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, list] = {}
    copies: dict[int, int] = {}  # of equal rows the next one goes to the next block
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for block, docs in blocks.items():
            cols = [[x] for x in _packed_block(block, docs)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["block", "heads", "texts"])

    for b in batches:
        for deal, doc_id, flag, text in zip(b.column("deal").to_pylist(), b.column("doc_id").to_pylist(), b.column("flag").to_pylist(), b.column("text").to_pylist(), strict=True):
            nth = copies[deal] = copies.get(deal, -1) + 1
            blocks.setdefault((deal + nth) % n_blocks, []).append((doc_id, flag, text))
            held += len(text) + 64
        if held >= flush_bytes:
            yield from flush()
            blocks, copies, held = {}, {}, 0
    yield from flush()


def blocked(docs: DataFrame, n_blocks: int) -> DataFrame:
    """Deals documents (doc_id, flag boolean, text binary) to blocks by a hash of id and text, equal rows in turn, so that no id, and no row that repeats, makes a block larger
    than others. Each map task sends its part of a block as one compressed row (block, heads, texts), so that a shuffle of texts is about as small as their files."""
    at = docs.select(F.xxhash64("doc_id", "text").alias("deal"), "doc_id", F.col("flag"), F.col("text"))
    return at.mapInArrow(_pack(n_blocks), "block long, heads binary, texts binary").repartition(n_blocks, "block")


def unpacked(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int | None, bool, bytes]]:
    """(block, doc_id, flag, text) of each document in the packed rows."""
    press = zstandard.ZstdDecompressor().decompress
    for block, head, text in zip(rows.column("block"), rows.column("heads"), rows.column("texts"), strict=True):
        raw, body = press(head.as_py()), press(text.as_py())
        n = len(raw) // 17
        ids, lengths, marks = np.frombuffer(raw, np.int64, n).tolist(), np.frombuffer(raw, np.int64, n, 8 * n).tolist(), raw[16 * n :]
        at = 0
        for d, k, m in zip(ids, lengths, marks, strict=True):
            yield block.as_py(), None if m & 1 else d, bool(m & 2), body[at : at + k]
            at += k

"""Document fingerprints from closed syncmers, matched by position.

A k-byte string is a closed syncmer if its smallest inner s-byte string (by hash) is its first or its last. Whether it is depends on
these k bytes alone, so an edit moves only anchors that it touches, and every window of 2 k - s - 1 bytes holds one. The fingerprint is
all anchors of the text, each with its position and 32-bit hash, whatever the length: as base64, the steps between positions as bytes
(no step is longer than k - s), then the hashes.

Likeness matches anchors by position: the i-th anchor of a hash in one text stands for the i-th of it in the other, and a match counts where
its shift is that of the matched anchor before or after it, so that anchors which agree by chance or out of place do not. With m matches that count, likeness is
m / (anchors of both - m).

To compare each document with the next one by doc_id, texts are dealt to ranges of doc_id and read in order with one row held back. A range
also gets one text more: the first one of the next range, which a pass over the rows with the ranges' first ids picks out.

Defined results: null text is empty; a text without a syncmer (under k bytes) is one anchor as a whole, and an empty text has the
empty fingerprint; likeness of equal fingerprints is 1, also of two empty ones; the document after the last is the first, so a single
row is its own next; rows with one doc_id are ordered by text and share a range; null doc_ids come last; a very long text is read whole, and its fingerprint
grows with it; other columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_of, released, small_batches, table, text_of

K, S = 32, 8
PIECE_BYTES = 16 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def anchors(raw: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of raw (s is 8, k a multiple of it)."""
    if not raw:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    if len(raw) < k:
        return np.zeros(1, np.int64), np.array([xxhash.xxh32_intdigest(raw)], np.uint32)
    b = np.frombuffer(raw, np.uint8)
    # 8 inner bytes as one integer at each place: eight strided views put side by side
    w = np.empty(len(b) - 7, np.uint64)
    for j in range(8):
        part = b[j : j + (len(b) - 7 - j) // 8 * 8 + 8]
        part = part[: len(part) // 8 * 8].view(np.uint64)
        w[j::8] = part[: len(w[j::8])]
    h = w * _A
    h ^= h >> np.uint64(32)
    h *= _B
    want, m, have = k - s + 1, h, 1
    while have < want:
        step = min(have, want - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    n = len(m)
    at = np.flatnonzero((h[:n] == m) | (h[want - 1 :] == m))
    g = w[at] * _B
    for j in range(8, k, 8):
        g ^= g >> np.uint64(29)
        g = (g + w[at + j]) * _A
    return at, (g >> np.uint64(32)).astype(np.uint32)


class Marks(NamedTuple):
    """A text's anchors: positions, hashes, and the hash with its number among equal ones, so that no two are alike."""

    at: np.ndarray
    hashes: np.ndarray
    keys: np.ndarray


def marks(text: str) -> Marks:
    at, h = anchors(text.encode("utf-8", "surrogatepass"))
    order = np.argsort(h, kind="stable")
    one = h[order]
    begins = np.ones(len(one), bool)
    begins[1:] = one[1:] != one[:-1]
    places = np.arange(len(one))
    keys = np.empty(len(one), np.uint64)
    keys[order] = (one.astype(np.uint64) << np.uint64(32)) | (places - np.maximum.accumulate(np.where(begins, places, 0))).astype(np.uint64)
    return Marks(at, h, keys)


def fingerprint(m: Marks) -> str:
    return base64.b64encode(np.diff(m.at, prepend=0).astype(np.uint8).tobytes() + m.hashes.astype(">u4").tobytes()).decode()


def likeness(a: Marks, b: Marks) -> float:
    if len(a.at) == len(b.at) and (a.hashes == b.hashes).all() and (a.at == b.at).all():
        return 1.0
    _, i, j = np.intersect1d(a.keys, b.keys, assume_unique=True, return_indices=True)
    order = np.argsort(a.at[i])
    shift = b.at[j[order]] - a.at[i[order]]
    same = np.zeros(len(shift) + 1, bool)
    same[1:-1] = shift[1:] == shift[:-1]
    m = int((same[1:] | same[:-1]).sum()) if len(shift) else 0
    return m / (len(a.at) + len(b.at) - m)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
TABLE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, mark: Marks, following: str, next_mark: Marks) -> tuple:
    new = edited(text, following)
    own = marks(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(mark), fingerprint(own), likeness(mark, own), likeness(mark, next_mark))


@released
def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range come by doc_id, the one that is ahead last: each row with the next."""
    held, rows, chars = None, [], 0
    for b in batches:
        for ahead, doc_id, text in zip(b.column("ahead").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            text = text.as_py()
            mark = marks(text)
            if held is not None:
                rows.append(_row(*held, text, mark))
                chars += len(text)
            held = None if ahead else (doc_id, text, mark)
            if chars >= 4_000_000:
                yield _batch(rows)
                rows, chars = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)


def fingerprints(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", text_of().alias("text"))
    n_bytes, nulls = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    n = pieces_of(spark, n_bytes, piece_bytes)
    # the first id of each range: one number a piece
    ranges = rows.select("doc_id").where("doc_id is not null").repartitionByRange(n, "doc_id").select(F.spark_partition_id().alias("part"), "doc_id")
    firsts = sorted(r.first for r in ranges.groupBy("part").agg(F.min("doc_id").alias("first")).collect())
    n_ranges = len(firsts) + bool(nulls)
    shared = spark.sparkContext.broadcast(np.array(firsts, np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right") - 1
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(shared.value), at).astype(np.int32))

    starts = spark.createDataFrame([(d, (i - 1) % n_ranges) for i, d in enumerate([*firsts, *([None] if nulls else [])])], "first long, part int")
    heads = rows.join(F.broadcast(starts), F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("part").agg(F.min("text").alias("text"))
    dealt = rows.select(range_of("doc_id").alias("part"), F.lit(False).alias("ahead"), "doc_id", "text").unionAll(heads.select("part", F.lit(True), F.lit(None).cast("long"), "text"))
    order = ["part", "ahead", F.col("doc_id").asc_nulls_last(), "text"]
    return dealt.repartitionById(max(1, n_ranges), "part").sortWithinPartitions(*order).select("ahead", "doc_id", "text").mapInArrow(_in_order, TABLE)


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

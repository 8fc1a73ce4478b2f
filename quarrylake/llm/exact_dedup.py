"""Exact deduplication by content sort.

Normalised texts are dealt by sampled splitters over (first bytes, digest, length, id), sorted
within each partition by disk-backed sort, and compared in full with their neighbour. The splitters hold only
a short prefix and three numbers, so a sample of them stays small however long the texts are, and
because the id is part of the key, a group that holds a third of all rows spreads over as many partitions as
its size asks for. What is left at partition edges is at most two runs a partition.

Defined results: null text is empty; a null doc_id sorts after all others and keep_id is then null
only if no row of the group has an id; repeated rows count as many times as they occur and all but the first
are dropped; an empty table gives an empty result; other
columns of the input are not looked at, whatever their names; very long texts are compared whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, pieces_of, released, small_batches, stored, table, text_of

PREFIX_CHARS = 32
PIECE_BYTES = 32 << 20
BROADCAST_ROWS = 200_000
RUNS = "part int, run long, nth long, doc_id long, text_sha256 string, head_id long, head_chars long, run_size long, edge binary"
FIELDS = pa.schema(
    [("part", pa.int32()), ("run", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("head_id", pa.int64()), ("head_chars", pa.int64()), ("run_size", pa.int64()), ("edge", pa.binary())]
)


@released
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring full comparisons over one sorted partition. Rows of a run carry its head (its first row in
    sort order: most code points, then smallest id) and its size in this partition; one row of
    the first and of the last run also carries the bytes, for the comparison across the partition's edges."""
    ids: list[int | None] = []  # of the current run; its texts are not kept
    norm: bytes | None = None
    sha, part, run, chars = "", 0, 0, 0

    def out(edge: bool) -> pa.RecordBatch:
        n = len(ids)
        arrays = [[part] * n, [run] * n, range(n), ids, [sha] * n, [ids[0]] * n, [chars] * n, [n] * n, [norm if edge else None] + [None] * (n - 1)]
        return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, FIELDS, strict=True)], schema=FIELDS)

    pending: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        parts, doc_ids, neg_chars, norms, shas = (batch.column(k) for k in ("part", "doc_id", "neg_chars", "norm", "text_sha256"))
        for i in range(batch.num_rows):
            text = norms[i].as_py()
            if text != norm:
                if norm is not None:
                    pending.append(out(run == 0))
                    held += len(ids)
                    run += 1
                    if held >= 8192:
                        yield from pa.Table.from_batches(pending).combine_chunks().to_batches()
                        pending, held = [], 0
                norm, sha, part, chars, ids = text, shas[i].as_py(), parts[i].as_py(), neg_chars[i].as_py(), []
            ids.append(doc_ids[i].as_py())
    if norm is not None:
        pending.append(out(True))
        yield from pa.Table.from_batches(pending).combine_chunks().to_batches()


def groups(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", text_of().alias("text"))
    # Python's and Java's class agree on these six characters
    rows = rows.select("doc_id", (-F.char_length("text")).cast("long").alias("neg_chars"), F.regexp_replace("text", f"[{SPACE}]+", "").alias("norm"))
    rows = rows.select("doc_id", "neg_chars", F.substring("norm", 1, PREFIX_CHARS).alias("front"), F.xxhash64("norm").alias("digest"), "norm")
    n_bytes = docs.select(F.sum(F.octet_length(text_of()))).first()[0] or 0
    dealt = rows.repartitionByRange(pieces_of(spark, n_bytes, piece_bytes), "front", "digest", "neg_chars", F.col("doc_id").asc_nulls_last())
    ordered = dealt.sortWithinPartitions("front", "digest", "norm", "neg_chars", F.col("doc_id").asc_nulls_last())
    # the digest of the result is taken after the shuffle, from the bytes that were compared
    seen = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "neg_chars", F.col("norm").cast("binary").alias("norm"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    runs = stored(seen.mapInArrow(_runs, RUNS))
    # runs of equal bytes at partition edges are one group; its head is the first in sort order
    whole = (
        runs.where(F.col("edge").isNotNull())
        .groupBy("edge")
        .agg(F.min(F.struct("head_chars", F.col("head_id").isNull().alias("no_id"), "head_id")).alias("head"), F.sum("run_size").alias("size"), F.collect_list(F.struct("part", "run")).alias("at"), F.min("part").alias("first_part"))
        .where(F.size("at") > 1)
        .select(F.explode("at").alias("at"), F.col("head.head_id").alias("whole_head"), F.col("size").alias("whole_size"), "first_part")
        .select("at.part", "at.run", "whole_head", "whole_size", "first_part")
    )
    joined = runs.drop("edge").join(whole, ["part", "run"], "left")
    straddles = F.col("first_part").isNotNull()
    return joined.select(
        "doc_id", F.when(straddles, F.col("whole_head")).otherwise(F.col("head_id")).alias("keep_id"), F.when(straddles, F.col("whole_size")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("nth") == 0) & (~straddles | (F.col("first_part") == F.col("part")))).alias("kept"), "text_sha256",
    )


def deduplicated(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that share doc_id and normalised text one, whichever, stays. Only keys that lose rows are
    joined to docs, so that texts which stay are not shuffled again while these keys are few (they are counted)."""
    key = lambda sha: F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), sha).cast("binary"), 256)
    rows = groups(docs, piece_bytes).select(key("text_sha256").alias("__key"), F.col("kept").cast("int").alias("__kept"))
    lost = stored(rows.groupBy("__key").agg(F.max("__kept").alias("__kept"), F.count(F.lit(1)).alias("__rows")).where("__kept = 0 or __rows > 1").select("__key", "__kept"))
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost
    keyed = docs.withColumn("__key", key(F.sha2(F.regexp_replace(text_of(), f"[{SPACE}]+", "").cast("binary"), 256)))
    alone = keyed.join(lost, "__key", "left_anti")
    repeated = keyed.join(lost.where("__kept = 1").select("__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return alone.select(*docs.columns).unionAll(repeated.select(*docs.columns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""

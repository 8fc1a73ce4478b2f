"""Incremental catalog loads: upserts, change sets and guarded deletes. Each gives the new snapshot; the caller writes it to a new place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str], overwrite: list[str], fill: list[str], reset: dict[str, str] | None = None) -> DataFrame:
    """keep: old values stay; overwrite: new values win; fill: new values win unless null; reset: column -> column by whose change (not to
    null) it becomes null. One full outer join on the key."""
    o, n = old.select(F.struct("*").alias("o"), F.col(key).alias("__k")), new.select(F.struct("*").alias("n"), F.col(key).alias("__k"))
    j = o.join(n, "__k", "full_outer")
    both, fresh = F.col("o").isNotNull() & F.col("n").isNotNull(), F.col("o").isNull()
    value = {key: F.col("__k")}
    for c in keep:
        value[c] = F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    for c in overwrite:
        value[c] = F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    for c in fill:
        value[c] = F.coalesce(f"n.{c}", f"o.{c}")
    for c, by in (reset or {}).items():
        changed = both & F.col(f"n.{by}").isNotNull() & ~F.col(f"n.{by}").eqNullSafe(F.col(f"o.{by}"))
        value[c] = F.when(changed, None).when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return j.select(*[value[c].alias(c) for c in old.columns])


def scan_diff(existing: DataFrame, found: DataFrame) -> DataFrame:
    """path and change (added, changed, kept, removed) by path without case; changed: another size, or one of the columns width, height and duration, as far as existing has them,
    is not known."""
    unknown = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("width", "height", "duration") if c in existing.columns], F.lit(False))
    e = existing.select(F.lower("path").alias("path"), "id", F.col("file_size").alias("__size"), unknown.alias("__unknown"), F.lit(True).alias("__old"))
    f = found.select(F.lower("path").alias("path"), "file_size", F.lit(True).alias("__new"))
    j = e.join(f, "path", "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__size").eqNullSafe(F.col("file_size")) | F.col("__unknown"), "changed").otherwise("kept")
    return j.select("path", "id", change.alias("change"))


def tombstones(existing: DataFrame, found: DataFrame, root: str, skipped: list[str], most_skipped: int = 20, bulk: int = 100) -> DataFrame:
    """ids to delete: files below root that were not found. None at all if more than most_skipped folders could not be read, or if more than
    bulk files and more than were found would go; files in a skipped folder stay."""
    if len(skipped) > most_skipped:
        return existing.select("id").limit(0)
    gone = existing.where(paths.under_dir(F.col("path"), root)).withColumn("__k", F.lower("path")).join(found.select(F.lower("path").alias("__k")), "__k", "left_anti")
    if skipped:
        gone = gone.where(~paths.in_scope(F.col("path"), skipped))
    ids = gone.select("id")
    n = ids.agg(F.count(F.lit(1)).alias("n_gone")).crossJoin(found.agg(F.count(F.lit(1)).alias("n_found")))  # one row each
    allowed = n.where(~((F.col("n_gone") > bulk) & (F.col("n_gone") > F.col("n_found")))).select(F.lit(1).alias("__ok"))
    return ids.join(F.broadcast(allowed)).select("id")


def merge_by_id(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of incoming replace those with their id; others follow."""
    return current.join(incoming.select("id"), "id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows that the table lacks, the first of each key."""
    cols = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")
    return first.join(table.select(key), key, "left_anti").select(*rows.columns)


def patch_paths(files: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: id, new_path. The file's name follows from its path."""
    j = files.join(moves, "id", "left").withColumn("path", F.coalesce("new_path", "path"))
    return j.withColumn("filename", F.when(F.col("new_path").isNotNull(), paths.basename(F.col("path"))).otherwise(F.col("filename"))).select(*files.columns)


def stale_fingerprints(files: DataFrame) -> DataFrame:
    """Files whose fingerprint is missing or was taken at another modification time; equal nulls are fresh."""
    fresh = F.col("phash").isNotNull() & F.col("dhash").isNotNull() & F.col("sig_modified_at").eqNullSafe(F.col("modified_at"))
    return files.where(~fresh)


def with_missing_columns(df: DataFrame, schema) -> DataFrame:
    """The schema's columns, null where an older table lacks them."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

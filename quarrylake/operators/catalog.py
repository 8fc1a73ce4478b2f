"""Views and statistics of a file catalog: id, path, filename, file_size and whatever else there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def matching(files: DataFrame, folder: str | None = None, search: str = "", scope: list[str] | None = None) -> DataFrame:
    """Files below the folder and within the scope whose name holds the search text; blank conditions do not restrict."""
    term = search.strip()
    out = files.where(paths.in_scope(F.col("path"), scope or []))
    if folder:
        out = out.where(paths.under_dir(F.col("path"), folder))
    return out.where(F.contains(paths.ascii_lower(F.col("filename")), paths.ascii_lower(F.lit(term)))) if term else out


def view(files: DataFrame, folder: str | None = None, search: str = "", limit: int = 2000, offset: int = 0) -> DataFrame:
    """One page in the order of filename and id."""
    return matching(files, folder, search).orderBy("filename", "id").offset(max(0, offset)).limit(min(max(1, limit), 5000))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))


def dir_stats(files: DataFrame) -> DataFrame:
    """Files directly in each folder; folders' names are case-sensitive."""
    return files.select(paths.parent_dir(F.col("path")).alias("dir")).where("dir is not null").groupBy("dir").agg(F.count(F.lit(1)).alias("n"))


def tree_rollup(files: DataFrame) -> DataFrame:
    """path, parent, depth and item_count of each folder: files are counted by folder first, so that the explosion grows with folders."""
    direct = dir_stats(files)
    up = direct.select(F.explode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("path"), "n")
    return up.groupBy("path").agg(F.sum("n").alias("item_count")).select("path", paths.parent_dir(F.col("path")).alias("parent"), F.size(F.split("path", r"\\")).cast("long").alias("depth"), "item_count")


def root_counts(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files below each root, zeros too; a file counts for every root above it. One pass, no join: one sum a root."""
    one = files.agg(*[F.count_if(paths.under_dir(F.col("path"), r)).alias(f"c{i}") for i, r in enumerate(roots)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.col(f"c{i}").alias("n")) for i, r in enumerate(roots)])).alias("x")).select("x.root", "x.n")


def with_progress(files: DataFrame, progress: DataFrame) -> DataFrame:
    """progress: id, position."""
    from ..functions.scalars import watch_state

    return files.join(progress, "id", "left").withColumn("state", watch_state(F.col("position"), F.col("duration")))


def recent(files: DataFrame, progress: DataFrame, n: int = 30) -> DataFrame:
    """The n files last played: progress has id and updated_at, of which the latest counts."""
    last = progress.groupBy("id").agg(F.max("updated_at").alias("updated_at"))
    return files.join(last, "id").orderBy(F.col("updated_at").desc(), "id").limit(n)


def above_floors(files: DataFrame, **floors: float) -> DataFrame:
    """Inclusive lower bounds by column; unknown values fail a bound that is set."""
    for c, least in floors.items():
        files = files.where(F.col(c) >= least)
    return files


def sort_order(field: str, descending: bool = False, tie: str = "id") -> list[Column]:
    """Missing values come last either way."""
    c = F.col(field)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(tie).asc()]


def by_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("id").distinct(), "id", "left_semi")


def library_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("thumbnail_path").isNull()).alias("missing_thumbnails"))

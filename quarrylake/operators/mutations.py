"""Changes to catalogs as new snapshots: updates by id, clears, deletes that cascade, and what a catalog and a disk do not share. The caller writes what is returned to a
new place."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .similarity import shared_checkpoints

#: How many numbers a name may get, how many warnings are named, what counts as a short video.
MOST_NUMBER, NAMED_WARNINGS, SHORT_SECONDS, SHORT_FRAMES = 999, 3, 5.0, 3


def latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: of both tables the one with the greatest order; among equals new ones, then the greatest row. Partial maxima meet, never all rows of a key."""
    cols = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(F.col(order), F.lit(0), *[c for c in cols if c != order]).alias("r")).unionByName(new.select(key, F.struct(F.col(order), F.lit(1), *[c for c in cols if c != order]).alias("r")))
    return both.groupBy(key).agg(F.max("r").alias("r")).select(*[F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in old.columns])


def saved_progress(progress: DataFrame, updates: DataFrame, videos: DataFrame) -> DataFrame:
    """progress and updates: video_id, position, updated_at. The last position of each video; positions that are no number or negative, and those of unknown videos, do
    not count."""
    p = F.col("position")
    valid = updates.where(p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < float("inf"))).join(videos.select(F.col("id").alias("video_id")), "video_id", "left_semi")
    return latest(progress, valid.select(*progress.columns), "video_id", "updated_at")


def saved_settings(settings: DataFrame, updates: DataFrame) -> DataFrame:
    """settings: key, value; updates have nth besides, the last one wins."""
    last = updates.groupBy("key").agg(F.max_by("value", "nth").alias("value"))
    return settings.join(last.select("key"), "key", "left_anti").unionByName(last)


def updated(table: DataFrame, changes: DataFrame, key: str, columns: list[str], clears: list[str] = ()) -> DataFrame:
    """Rows with a change (one a key) take its columns, nulls too; their columns in clears become null, since they were derived from the old ones."""
    c = changes.select(F.col(key).alias("__k"), F.struct(*columns).alias("__c"))
    j, hit = table.join(c, F.col(key) == F.col("__k"), "left"), F.col("__k").isNotNull()
    value = {x: F.when(hit, F.col(f"__c.{x}")).otherwise(F.col(x)) for x in columns} | {x: F.when(~hit, F.col(x)) for x in clears}
    return j.select(*[value.get(x, F.col(x)).alias(x) for x in table.columns])


def cleared(table: DataFrame, ids: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    return updated(table, ids.select(key).distinct(), key, [], columns) if columns else table


def without(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def deleted_with_progress(videos: DataFrame, progress: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without these videos; they belong in one commit."""
    return without(videos, ids), without(progress, ids, "video_id")


def all_ids(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionAll(b), [t.select("id") for t in tables]).distinct()


def orphans(found: DataFrame, *tables: DataFrame, leftovers: str = "tmp") -> DataFrame:
    """found: path. Files that are named after no id of the tables, and all leftovers of writers."""
    f = found.withColumn("__id", paths.stem(F.col("path")))
    left = paths.extension(F.col("path")) == leftovers
    known = all_ids(*[t.select(F.col("id").cast("string").alias("id")) for t in tables])
    return f.where(~left).join(known.select(F.col("id").alias("__id")), "__id", "left_anti").select(*found.columns).unionByName(f.where(left).select(*found.columns))


def gone_from_disk(rows: DataFrame, inventory: DataFrame, readable: DataFrame) -> DataFrame:
    """rows: id, path; inventory: path; readable: dir. Rows of folders that could be read whose file is not there; a folder that could not be read tells nothing."""
    here = rows.withColumn("__dir", paths.parent_dir(F.col("path"))).join(readable.select(F.col("dir").alias("__dir")).distinct(), "__dir", "left_semi")
    key = lambda df: df.withColumn("__k", F.lower(paths.norm_path(F.col("path"))))
    return key(here).join(key(inventory).select("__k"), "__k", "left_anti").select(*rows.columns)


def with_presence(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Each asked id once with known (true or false): both halves of a report in one join."""
    return ids.select("id").distinct().join(table.select("id", F.lit(True).alias("known")).distinct(), "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


def set_changes(current: DataFrame, watched: DataFrame, key: str) -> DataFrame:
    """key and change: added where only current has it, removed where only watched has."""
    a, b = current.select(key).distinct().withColumn("__a", F.lit(1)), watched.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full_outer").where("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), "removed").otherwise("added").alias("change"))


def roots_to_forget(roots: DataFrame, removed: str) -> DataFrame:
    """roots: root. Those that are the removed folder or lie in it."""
    return roots.where((paths.dedupe_key(F.col("root")) == paths.dedupe_key(F.lit(removed))) | paths.under_dir(F.col("root"), removed))


def deduped_roots(roots: DataFrame, order: str) -> DataFrame:
    """roots: root and its order. Of roots that differ in case or a closing separator the first stays."""
    return roots.groupBy(paths.dedupe_key(F.col("root")).alias("dir_key")).agg(F.min_by("root", order).alias("root"), F.min(order).alias(order))


def taken(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted: id, path. Adds taken: another row has the path, but for case."""
    k = files.select(F.lower("path").alias("__k"), F.col("id").alias("__id")).groupBy("__k").agg(F.min("__id").alias("__lo"), F.max("__id").alias("__hi"))
    j = wanted.withColumn("__k", F.lower("path")).join(k, "__k", "left")
    other = F.col("__lo").isNotNull() & ((F.col("__lo") != F.col("id")) | (F.col("__hi") != F.col("id")))
    return j.withColumn("taken", F.coalesce(other, F.lit(False))).select(*wanted.columns, "taken")


def _numbered(path: Column, n: Column) -> Column:
    """The path itself for 1, else "name (n).ext"."""
    dot = F.regexp_extract(path, r"(?<=[^\\/])(\.[^.\\/]*)\z", 1)
    return F.when(n == 1, path).otherwise(F.concat(F.left(path, F.length(path) - F.length(dot)), F.lit(" ("), n.cast("string"), F.lit(")"), dot))


def _names_taken(keys: DataFrame) -> DataFrame:
    """keys: key of a path that is taken, and more. Which number it takes of which name: its own as 1, and of the name that it would be a number of."""
    part = lambda k: F.regexp_extract("key", r"(?s)^(.*) \(([1-9]\d{0,2})\)((?:\.[^.\\/]*)?)\z", k)
    of = keys.withColumn("name", F.concat(part(1), part(3))).withColumn("n", part(2).try_cast("int")).where((F.col("n") > 1) & (_numbered(F.col("name"), F.col("n")) == F.col("key")))
    more = [c for c in keys.columns if c != "key"]
    return keys.select(F.col("key").alias("name"), F.lit(1).alias("n"), *more).unionAll(of.select("name", "n", *more))


def _dealt_numbers(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One name: those who want it by id, at most MOST_NUMBER rows, each the first number that no file has, nobody before in this list, and nobody with a smaller id elsewhere."""
    gone: dict[int, int] = {}
    for n, holder in zip(right["n"], right["holder"], strict=True):
        gone[n] = min(holder, gone.get(n, holder))
    ids = sorted(left["id"])
    out, free = [], list(range(1, MOST_NUMBER + 1))
    for i in ids:
        at = next((k for k, n in enumerate(free) if not gone.get(n, i) < i), None)
        out.append((i, left["name"].iloc[0], None if at is None else free.pop(at)))
    return pd.DataFrame(out, columns=["id", "name", "n"]).astype({"n": "Int32"})


def free_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted: id (one each), path. In the order of ids each gets its path if that is free, else the first free "name (n).ext" with n from 2 to 999; null if all are taken. A path is free if no file has it and
    nobody before got it, but for case and separators.

    All who want one name deal its numbers among themselves; a path that two names come to goes to the smaller id, and the other name deals anew without it for larger ids. What is once
    lost stays lost, so rounds go on until no path is there twice."""
    shared_checkpoints(wanted.sparkSession)
    key = lambda c: F.lower(paths.norm_path(c))
    asked = wanted.select("id", "path", key(F.col("path")).alias("name"))
    # beyond so many of one name nobody gets a number
    first = asked.withColumn("__nth", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("__nth") <= MOST_NUMBER).select("id", "name").checkpoint()
    shown = asked.groupBy("name").agg(F.min("path").alias("shown"), F.count(F.lit(1)).alias("asked"))
    lost = _names_taken(files.select(key(F.col("path")).alias("key")).distinct().withColumn("holder", F.lit(-(1 << 63)).cast("long")))
    lost = lost.join(shown.select("name"), "name", "left_semi").checkpoint()
    while True:
        crowded = shown.where("asked > 1").select("name").unionAll(lost.select("name")).distinct()
        alone = first.join(crowded, "name", "left_anti").select("id", "name", F.lit(1).alias("n"))
        many = first.join(crowded, "name", "left_semi").groupBy("name").cogroup(lost.groupBy("name")).applyInPandas(_dealt_numbers, "id long, name string, n int")
        got = alone.unionAll(many).join(shown, "name").withColumn("free_path", _numbered(F.col("shown"), F.col("n"))).select("id", "name", "n", "free_path", key(F.col("free_path")).alias("key")).checkpoint()
        winner = got.where("n is not null").groupBy("key").agg(F.min("id").alias("holder"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", "holder")
        more = got.join(winner, "key").where("id <> holder").select("name", "n", "holder").checkpoint()
        if not more.limit(1).count():
            break
        lost = lost.unionAll(more).checkpoint()
    # a path of its own keeps its letters
    return asked.join(got.select("id", "n", "free_path"), "id", "left").select("id", "path", F.when(F.col("n") == 1, F.col("path")).otherwise(F.col("free_path")).alias("free_path"))


def short_videos(videos: DataFrame) -> DataFrame:
    """videos: duration, frames (distinct ones), image_kind (what the first bytes show). Those that are pictures in truth."""
    d = F.col("duration")
    return videos.where((d.isNull() & F.col("image_kind").isNotNull()) | (d < 1) | ((d <= SHORT_SECONDS) & (F.col("frames") <= SHORT_FRAMES)))


def at_most(videos: DataFrame, seconds: float) -> DataFrame:
    """Videos of at most so many seconds, and those of unknown length."""
    return videos.where(F.col("duration").isNull() | (F.col("duration") <= seconds))


def having(table: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal these values: one row at most if a key is among them."""
    return table.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in values.items()], F.lit(True)))


def repointed(rows: DataFrame, legacy: list[str], unified: str) -> DataFrame:
    """rows: id, path. Files that lie directly in a legacy folder move to the unified one; a second pass changes nothing."""
    folder = F.regexp_replace(F.lower(paths.parent_dir(F.col("path"))), r"\\+$", "")
    old = folder.isin(*[x.replace("/", "\\").rstrip("\\").lower() for x in legacy])
    return rows.withColumn("path", F.when(F.coalesce(old, F.lit(False)), F.concat(F.lit(unified.rstrip("\\/") + "\\"), paths.basename(F.col("path")))).otherwise(F.col("path")))


def outcome_counts(outcomes: DataFrame, by: str = "outcome") -> DataFrame:
    return outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def capped_warnings(warnings: DataFrame, order: str) -> DataFrame:
    """warnings: message and its order. The first three and how many more there are: a report, one row."""
    first = warnings.orderBy(order).limit(NAMED_WARNINGS).agg(F.sort_array(F.collect_list(F.struct(order, "message"))).alias("m")).select(F.col("m.message").alias("named"))
    n = warnings.agg(F.greatest(F.count(F.lit(1)) - NAMED_WARNINGS, F.lit(0)).alias("more"))
    return first.join(F.broadcast(n))


def seen_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.coalesce("duration", F.lit(0.0))), F.lit(0.0)).alias("duration"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("file_size"))


def pick(files: DataFrame, left_out: DataFrame, seed: int) -> DataFrame:
    """One row by a seeded draw among those whose id is not left out."""
    return files.join(left_out.select("id"), "id", "left_anti").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(1)


def by_prefix(media: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """media: md5, first_seen. The newest whose digest begins so."""
    return media.where(F.col("md5").startswith(prefix.strip().lower())).orderBy(F.col("first_seen").desc(), "md5").limit(limit)


def restored_is_stale(count: Column, cached: Column) -> Column:
    """A cached result is stale as soon as the library has grown beyond it."""
    return F.coalesce(count > cached, F.lit(True))


def write_cache(df: DataFrame, path: str) -> None:
    """A result as JSON. Spark's commit makes it whole or nothing: readers ask for the mark of success."""
    df.write.mode("overwrite").json(path)

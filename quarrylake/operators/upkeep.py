"""Upkeep of the archive: recovery after a stop, registries without repeats, backups, and positions that a player reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .messages import DAY

#: Kinds that a finished row of the same name saves; days from which on a dead child counts as frozen; days that a backup stays.
RESCUED_KINDS, FROZEN_DAYS, BACKUP_DAYS = ("image", "video"), 100, 14


def recovered(messages: DataFrame, now: int) -> DataFrame:
    """The archive as a new process finds it fit: finished rows lose the traces of failures, dead images and videos take over from a finished row
    of their name (the smallest id), rows at work wait again, and frozen children are due now. A second pass changes nothing."""
    done = messages.where("dl = 'ok' and md5 is not null and name is not null").groupBy("name").agg(F.min_by(F.struct(*[c for c in ("md5", "path", "bytes") if c in messages.columns]), "id").alias("__d"))
    j = messages.join(done, "name", "left")
    dl = F.col("dl")
    saved = (dl == "dead") & F.col("kind").isin(*RESCUED_KINDS) & F.col("__d").isNotNull()
    busy, clean = dl == "busy", saved | (dl == "ok")
    frozen = (dl == "dead") & ~saved & F.col("parent").isNotNull() & (F.coalesce(F.col("msg_id").cast("string"), F.lit("")) == "") & (F.col("next_try") > now + FROZEN_DAYS * DAY)
    when = lambda cond, value, c: F.when(cond, value).otherwise(F.col(c)).cast(messages.schema[c].dataType)
    rules = {
        "dl": (saved, F.lit("ok")), "tries": (clean, F.lit(0)), "dead_at": (clean, F.lit(None)), "err": (clean, F.lit(None)), "prog_at": (clean, F.lit(None)),
        "md5": (saved, F.col("__d")["md5"]), "dedup": (saved, F.lit(1)), "dl_bytes": (saved | busy, F.lit(0)), "dl_total": (saved | busy, F.lit(None)), "next_try": (frozen, F.lit(now)),
    } | {c: (saved, F.col("__d")[c]) for c in ("path", "bytes") if c in messages.columns}
    out = {c: when(cond, value, c) for c, (cond, value) in rules.items() if c in messages.columns}
    # a row that is saved is ok; one at work waits
    out["dl"] = F.when(busy, "pending").otherwise(out["dl"])
    return j.withColumns(out).select(*messages.columns)


def retained(events: DataFrame, cutoff: int) -> DataFrame:
    """events: status, received_at. All but those that were done before the cutoff."""
    return events.where(~F.coalesce((F.col("status") == "done") & (F.col("received_at") < cutoff), F.lit(False)))


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows whose key is the same but for case and outer white space the first stays; rows with a blank key all stay."""
    k = F.lower(F.regexp_replace(F.coalesce(F.col(key), F.lit("")), r"^\s+|\s+$", ""))
    named = rows.withColumn("__k", k)
    first = named.where("__k <> ''").groupBy("__k").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return first.unionByName(named.where("__k = ''").drop("__k"))


def backup(tables: dict[str, DataFrame], folder: str, day: str) -> None:
    """A snapshot of each table in the day's folder; a second one on a day replaces the first."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{day}/{name}")


def expired_backups(days: DataFrame, today: str, keep: int = BACKUP_DAYS) -> DataFrame:
    """days: day (a date). Those whose backup may go."""
    return days.where(F.col("day") < F.date_sub(F.lit(today).cast("date"), keep))


def tracked_positions(polls: DataFrame, most_misses: int = 6) -> DataFrame:
    """polls: session, t, state, source, position, duration. The positions that are to be saved: live ones, at most the duration, where they
    differ from the last; up to the first poll that finds the player stopped or the end of the first run of most_misses without a live position."""
    w = Window.partitionBy("session").orderBy("t")
    p = F.col("position")
    live = F.coalesce((F.col("source") == "live") & ~F.isnan(p) & (p >= 0) & (p < float("inf")), F.lit(False))
    runs = polls.withColumn("__live", live).withColumn("__run", F.sum(F.col("__live").cast("int")).over(w))
    runs = runs.withColumn("__misses", F.sum((~F.col("__live")).cast("int")).over(Window.partitionBy("session", "__run").orderBy("t")))
    stopped = F.max(F.coalesce(F.col("state") == "stopped", F.lit(False))).over(w)
    lost = F.coalesce(F.max(F.col("__misses") >= most_misses).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    kept = runs.withColumn("__end", stopped | lost).where("not __end and __live")
    at = kept.select("session", "t", F.when(F.col("duration") > 0, F.least("position", "duration")).otherwise(p).alias("position"))
    return at.withColumn("__last", F.lag("position").over(w)).where("__last is null or __last <> position").drop("__last")

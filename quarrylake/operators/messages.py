"""A message archive with its download queue: id, parent, kind, dl, name, ts, ok_at, dead_at, tries, bytes and more. now and today are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import backoff, download_status

#: Fixed values of the queue, in seconds or attempts.
DAY, STALL, MAX_TRIES, DEAD_TRIES, ORPHAN_DAYS = 86400, 1800, 6, 15, 365


def state_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("dl").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("dl") == "dead") & (F.coalesce("tries", F.lit(0)) < DEAD_TRIES)).alias("retryable"))


def histogram(messages: DataFrame, statuses: list[str]) -> DataFrame:
    """status and n, with zeros for the statuses that do not occur."""
    counts = messages.groupBy(download_status(F.col("dl"), F.col("kind"), F.col("dedup")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    domain = messages.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return domain.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(messages: DataFrame, midnight: int) -> DataFrame:
    ok, today = F.col("dl") == "ok", (F.col("ts") >= midnight) | (F.col("ok_at") >= midnight)
    size = F.coalesce("bytes", F.lit(0))
    return messages.agg(
        F.count_if(ok).alias("ok"), F.sum(F.when(ok, size).otherwise(0)).alias("ok_bytes"), F.count_if(ok & today).alias("today"),
        F.sum(F.when(ok & today, size).otherwise(0)).alias("today_bytes"), F.count_if(ok & today & (F.col("dedup") > 0)).alias("dedup_today"),
    )


def with_group(messages: DataFrame) -> DataFrame:
    """Adds grp (the parent, else the row itself), hot (some row of the group is busy) and done_at (the group's last completion)."""
    grp = Window.partitionBy("grp")
    out = messages.withColumn("grp", F.coalesce("parent", "id"))
    return out.withColumn("hot", F.max((F.col("dl") == "busy").cast("int")).over(grp)).withColumn("done_at", F.max("ok_at").over(grp))


def list_order() -> list[Column]:
    return [F.col("hot").desc(), F.col("done_at").desc_nulls_last(), F.col("grp").desc(), F.col("ok_at").desc_nulls_last(), F.col("id").asc()]


def today_list(messages: DataFrame, midnight: int) -> DataFrame:
    """Rows of today, rows at work, waiting or lately failed, and children of a busy parent; without shells. One scan: an OR, not a union."""
    p = messages.select(F.col("id").alias("__p"), F.col("dl").alias("parent_dl"), F.col("ts").alias("parent_ts"))
    j = messages.join(p, F.col("parent") == F.col("__p"), "left").drop("__p")
    wanted = (F.coalesce("parent_ts", "ts") >= midnight) | (F.col("ok_at") >= midnight) | (F.col("dead_at") >= midnight) | F.col("dl").isin("busy", "pending") | (F.col("parent_dl") == "busy")
    return with_group(j.where(F.coalesce(wanted, F.lit(False)) & (F.col("kind") != "forward"))).drop("parent_ts")


def history(messages: DataFrame, limit: int = 500) -> DataFrame:
    """First the newest groups' rows up to the limit, then their shells go: in this order of steps."""
    n = min(max(1, limit), 2000)
    return with_group(messages.orderBy(F.coalesce("parent", "id").desc(), "id").limit(n)).where("kind <> 'forward'")


def _failures(messages: DataFrame) -> DataFrame:
    return messages.where("dl = 'dead' and name is not null and name <> ''")


def collapsed_failures(messages: DataFrame) -> DataFrame:
    """Dead rows with one kind and name fold into the one that failed last: kind, name, id, n, first_id, last_id. Their ids are rows of failure_members: a name may fail without end."""
    g = _failures(messages).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("dead_at", -F.col("id"))).alias("id"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return g.where("n >= 2")


def failure_members(messages: DataFrame) -> DataFrame:
    """kind, name, id of all rows that collapsed_failures folds."""
    dead, folded = _failures(messages), collapsed_failures(messages).select("kind", "name")
    return dead.join(folded, ["kind", "name"], "left_semi").select("kind", "name", "id")


def forward_progress(messages: DataFrame) -> DataFrame:
    return messages.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("dl") == "ok").alias("done"))


def after_failure(messages: DataFrame, now: int) -> DataFrame:
    """The queue's transition of each row after a failed attempt: new_dl, new_tries, next_try, new_dead_at."""
    fed, dead = F.col("dl_bytes") > 0, F.col("dead_at").isNotNull()
    stalled = F.col("prog_at").isNotNull() & (F.lit(now) - F.col("prog_at") >= STALL)
    orphan = F.col("msg_id").isNull() & F.col("parent").isNull()
    pick = lambda a, b, c, d: F.when(fed, a).when(dead, b).when(stalled, c).otherwise(d)
    tries = F.col("tries") + 1
    long = lambda x: F.lit(x).cast("long")
    return messages.withColumns(
        {
            "new_dl": pick(F.lit("pending"), F.lit("dead"), F.lit("dead"), F.lit("pending")),
            "new_tries": pick(F.lit(0), tries, tries, tries).cast("long"),
            "next_try": pick(long(now + 60), long(now + DAY), F.when(orphan, long(now + ORPHAN_DAYS * DAY)).otherwise(long(now + DAY)), F.lit(now) + backoff(F.col("tries"), 30, 1800)).cast("long"),
            "new_dead_at": pick(F.lit(None).cast("long"), F.col("dead_at"), long(now), F.lit(None).cast("long")),
        }
    )


def event_after_failure(events: DataFrame, now: int) -> DataFrame:
    tries = F.col("tries") + 1
    return events.withColumn("new_status", F.when(tries >= MAX_TRIES, "dead").otherwise("error")).withColumn("next_try", (F.lit(now) + backoff(F.col("tries"), 15, 3600)).cast("long"))


def due(messages: DataFrame, now: int, n: int) -> DataFrame:
    """What the queue takes next: waiting rows first, then of the dead ones at most ten."""
    ready = F.col("next_try") <= now
    waiting = messages.where((F.col("dl") == "pending") & ready).orderBy("id").limit(n)
    again = messages.where((F.col("dl") == "dead") & ready & (F.col("tries") < DEAD_TRIES) & (F.col("msg_id").isNotNull() | F.col("parent").isNotNull())).orderBy("id").limit(min(10, n))
    return waiting.unionByName(again).orderBy((F.col("dl") == "dead").asc(), "id").limit(n)


def requeued(messages: DataFrame, now: int) -> DataFrame:
    """Dead rows wait again."""
    dead = F.col("dl") == "dead"
    out = {"dl": F.when(dead, "pending").otherwise(F.col("dl")), "tries": F.when(dead, 1).otherwise(F.col("tries")).cast("long"), "next_try": F.when(dead, 0).otherwise(F.col("next_try")).cast("long"), "dead_at": F.when(~dead, F.col("dead_at")), "prog_at": F.when(dead, F.lit(now)).otherwise(F.col("prog_at")).cast("long")}
    return messages.withColumns(out)


def rescued(messages: DataFrame) -> DataFrame:
    """Dead rows whose name some finished row bears take over its md5 and path, from the row with the smallest id."""
    done = messages.where("dl = 'ok' and md5 is not null and name is not null").groupBy("name").agg(F.min_by(F.struct("md5", "bytes"), "id").alias("__d"))
    j = messages.join(done, "name", "left")
    hit = (F.col("dl") == "dead") & F.col("__d").isNotNull()
    return j.withColumns({"dl": F.when(hit, "ok").otherwise(F.col("dl")), "md5": F.when(hit, F.col("__d.md5")).otherwise(F.col("md5")), "bytes": F.when(hit, F.col("__d.bytes")).otherwise(F.col("bytes"))}).select(*messages.columns)


def active_chats(messages: DataFrame, cutoff: int, key: str) -> DataFrame:
    return messages.where(F.col("ts") >= cutoff).groupBy(key).agg(F.max("ts").alias("last_ts"))


def changed_rows(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """ids whose columns differ between two snapshots, or that only one has."""
    a, b = before.select("id", F.struct(*columns).alias("a")), after.select("id", F.struct(*columns).alias("b"))
    return a.join(b, "id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def known_streak_stop(rows: DataFrame, key: str, order: Column, streak: int) -> DataFrame:
    """Rows in order up to the end of the first run of `streak` known ones (column known)."""
    w = Window.partitionBy(key).orderBy(order)
    runs = rows.withColumn("__run", F.sum((~F.col("known")).cast("int")).over(w))
    # before the first unknown row a run starts at zero
    runs = runs.withColumn("__in_run", F.sum(F.col("known").cast("int")).over(Window.partitionBy(key, "__run").orderBy(order)))
    stop = F.sum((F.col("__in_run") >= streak).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("__stop", F.coalesce(stop, F.lit(0))).where("__stop = 0").drop("__run", "__in_run", "__stop")

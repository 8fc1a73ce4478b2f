"""The download queue's life: claims, progress, ends, stalls; events that are due; messages that an outage left out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .messages import DAY, STALL, rescued

#: Fixed values, in seconds unless named otherwise: how far before an outage to look, how long one may be, how long a chat counts as active, page size; a quiet link, and how
#: long to wait between two attempts to heal it.
LEAD_IN, GAP_MOST, ACTIVE, PAGE, FAILS_MOST = 120, 7 * DAY, 3 * DAY, 20, 3
QUIET, HEAL_COOLDOWN, WATCH_STEP, WATCH_MOST = 180, 45 * 60, 30, 600


def claimed(messages: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Waiting and dead rows among ids are at work; the time of their progress stays if they have one."""
    j = messages.join(ids.select("id", F.lit(True).alias("__c")).distinct(), "id", "left")
    hit = F.col("__c").isNotNull() & F.col("dl").isin("pending", "dead")
    return j.withColumns({"dl": F.when(hit, "busy").otherwise(F.col("dl")), "prog_at": F.when(hit, F.coalesce("prog_at", F.lit(now))).otherwise(F.col("prog_at"))}).select(*messages.columns)


def progressed(messages: DataFrame, samples: DataFrame) -> DataFrame:
    """samples: id, t, done. Of rows at work the last sample counts; for others it comes too late."""
    last = samples.groupBy("id").agg(F.max(F.struct("t", "done")).alias("__s"))
    j, hit = messages.join(last, "id", "left"), F.col("__s").isNotNull() & (F.col("dl") == "busy")
    return j.withColumns({"dl_bytes": F.when(hit, F.col("__s.done")).otherwise(F.col("dl_bytes")), "prog_at": F.when(hit, F.col("__s.t")).otherwise(F.col("prog_at"))}).select(*messages.columns)


def finished(messages: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """results: id, md5, bytes. These rows are done and lose the traces of failures; dead rows of the same name take over."""
    r = results.groupBy("id").agg(F.min_by(F.struct("md5", "bytes"), "md5").alias("__r"))
    j, hit = messages.join(r, "id", "left"), F.col("__r").isNotNull()
    out = {"dl": F.when(hit, "ok").otherwise(F.col("dl")), "md5": F.when(hit, F.col("__r.md5")).otherwise(F.col("md5")), "bytes": F.when(hit, F.col("__r.bytes")).otherwise(F.col("bytes")), "ok_at": F.when(hit, F.lit(now)).otherwise(F.col("ok_at"))}
    out |= {c: F.when(~hit, F.col(c)) for c in ("dead_at", "err", "prog_at") if c in messages.columns} | {"tries": F.when(hit, 0).otherwise(F.col("tries")).cast(messages.schema["tries"].dataType)}
    return rescued(j.withColumns(out).select(*messages.columns))


def reaped(messages: DataFrame, now: int) -> DataFrame:
    """Rows at work without progress for half an hour, or without any, are dead."""
    stale = (F.col("dl") == "busy") & (F.col("prog_at").isNull() | (F.lit(now) - F.col("prog_at") > STALL))
    return messages.withColumns({"dl": F.when(stale, "dead").otherwise(F.col("dl")), "dead_at": F.when(stale, F.lit(now)).otherwise(F.col("dead_at"))})


def due_events(events: DataFrame, now: int, n: int) -> DataFrame:
    """New events, and failed ones whose time has come, by id: what a worker takes."""
    return events.where((F.col("status") == "new") | ((F.col("status") == "error") & (F.col("next_try") <= now))).orderBy("id").limit(n)


def watermark(events: DataFrame) -> DataFrame:
    return events.agg(F.max("received_at").alias("received_at"))


def unknown_messages(page: DataFrame, archive: DataFrame) -> DataFrame:
    """Messages that the archive lacks: by msg_id where they have one that is known, else by scope, peer, sender and time."""
    by_id = page.join(archive.where("msg_id is not null and msg_id <> ''").select("msg_id"), "msg_id", "left_anti")
    k = ["scope", "peer_id", "sender_id", "ts"]
    return by_id.join(archive.select(*k), k, "left_anti").select(*page.columns)


def gap_backfill(history: DataFrame, archive: DataFrame, down_since: int, now: int) -> DataFrame:
    """history: what chats hold since. The messages of an outage that the archive lacks, of chats that were active lately; an outage of over a week is left to the user."""
    if now - down_since > GAP_MOST:
        return history.limit(0)
    active = archive.where(F.col("ts") >= now - ACTIVE).select("scope", "peer_id").distinct()
    return unknown_messages(history.where(F.col("ts") >= down_since - LEAD_IN).join(active, ["scope", "peer_id"], "left_semi"), archive)


def backed_off(attempts: DataFrame, rows_a_piece: int | None = None) -> DataFrame:
    """attempts: key, t, failed. Those that are made: after k failures in a row a key waits min(30 k, 600) seconds; a success starts anew. Which attempt is next depends on the one made
    and on the failures so far, as far as they change the wait: a chain of jumps with that many states."""
    from ..streaming import jumps

    most = WATCH_MOST // WATCH_STEP
    failed = lambda rows: rows["failed"].fillna(False).to_numpy(bool)
    fails = lambda rows, so_far: np.where(failed(rows), min(so_far + 1, most), 0)
    chain = jumps.Chain(lambda rows: rows["t"].to_numpy(), lambda rows, s: rows["t"].to_numpy() + WATCH_STEP * fails(rows, s), fails, most + 1)
    made = lambda rows, _, at, __: rows.iloc[at][["key", "t", "failed"]]
    return jumps.taken(attempts.select("key", "t", "failed"), ["key"], ["t", "failed"], chain, made, "key long, t long, failed boolean", rows_a_piece or jumps.ROWS_A_PIECE)


def heal_due(quiet_for: Column, since_last: Column) -> Column:
    """A link that is quiet for three minutes is healed, at most every 45 minutes."""
    return (quiet_for >= QUIET) & (since_last.isNull() | (since_last >= HEAL_COOLDOWN))


def selected_in_groups(groups: DataFrame, selected: DataFrame) -> DataFrame:
    return groups.join(selected.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def numbered_from(rows: DataFrame, table: DataFrame, order: list[str], seq: str = "seq") -> DataFrame:
    """Rows with numbers that go on from the table's greatest. The numbers are dealt by ranges of the order: each range counts its rows, and only the counts meet."""
    spark, top = rows.sparkSession, table.agg(F.coalesce(F.max(seq), F.lit(0)).alias("__top"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = dealt.join(F.broadcast(counts), "__part").join(F.broadcast(top))
    return out.withColumn(seq, (F.col("__top") + F.col("__before") + nth).cast("long")).drop("__part", "__before", "__top")

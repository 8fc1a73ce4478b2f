"""A registry of links: which messages to look at, what is kept of a link, and how new ones are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MAGNET, URL, normal_url
from .queue import numbered_from

#: Messages a pass, characters of a title, the sender before a line of a forward, what the headers of a sheet hold.
BATCH, TITLE_CHARS = 500, 300
FORWARD_PREFIX = r"^\S{0,40}\(\d{2}:\d{2}:\d{2}\):\s*"
HEADERS = (("序号", "seq"), ("链接", "link"), ("标题", "title"), ("首次日期", "first_date"), ("首次时间", "first_time"), ("发送者", "sender"), ("群号", "gid"), ("备注", "note"))


def resolved_headers(names: list[str]) -> dict[str, int]:
    """Which column holds which field: the first whose header has the field's word in it."""
    out: dict[str, int] = {}
    for word, field in HEADERS:
        if (at := next((i for i, n in enumerate(names) if word in (n or "")), None)) is not None:
            out[field] = at
    return out


def read_registry(table: DataFrame) -> DataFrame:
    """A sheet's table with whatever headers as a registry, missing fields null."""
    at = resolved_headers(table.columns)
    return table.select(*[(F.col(f"`{table.columns[at[f]]}`") if f in at else F.lit(None)).cast("long" if f == "seq" else "string").alias(f) for _, f in HEADERS])


def to_scan(messages: DataFrame, cursor: int, dirty: DataFrame, magnets: bool = False, limit: int = BATCH) -> DataFrame:
    """messages: id, text. Beyond the cursor or changed since, with a link in them; one pass takes so many by id."""
    t = F.lower("text")
    links = t.contains("magnet:?") if magnets else t.contains("http://") | t.contains("https://")
    changed = messages.join(dirty.select("id").distinct(), "id", "left_semi").where(F.col("id") <= cursor)
    return messages.where(F.col("id") > cursor).unionByName(changed).where(links).orderBy("id").limit(limit)


def link_rows(messages: DataFrame, magnets: bool = False) -> DataFrame:
    """messages: id, scope, peer_id, sender_nick, ts, text. One row a link, the first place of each: link_key, id, nth, link, title, first_date, first_time, sender, gid."""
    pattern = MAGNET if magnets else URL
    # a line with links falls into what stands before each link and the link
    lines = messages.select("*", F.posexplode(F.split("text", "\n")).alias("__line", "line"))
    found = lines.withColumn("__links", F.regexp_extract_all("line", F.lit(f"({pattern})"), F.lit(1))).select("*", F.posexplode("__links").alias("__at", "raw"))
    # what stands before a link: the line up to it, as long as what the pattern parts and the links before it
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    at = length(F.slice(F.split("line", pattern), F.lit(1), F.col("__at") + 1)) + length(F.slice("__links", F.lit(1), F.col("__at")))
    before = F.left(F.col("line"), at)
    head = F.regexp_replace(F.regexp_replace(before, r"^[ ：:\x{3000}\t]+|[ ：:\x{3000}\t]+$", ""), FORWARD_PREFIX, "")
    link = F.col("raw") if magnets else normal_url(F.col("raw"))
    when = F.timestamp_seconds("ts")
    rows = found.select(
        F.lower(link).alias("link_key"), "id", (F.col("__line") * 10_000 + F.col("__at")).cast("long").alias("nth"), link.alias("link"), F.substring(head, 1, TITLE_CHARS).alias("title"), F.date_format(when, "yyyy-MM-dd").alias("first_date"),
        F.date_format(when, "HH:mm:ss").alias("first_time"), F.coalesce("sender_nick", F.lit("")).alias("sender"), F.when(F.col("scope") == "group", F.col("peer_id").cast("string")).otherwise("").alias("gid"),
    ).where("link <> ''")
    return rows.groupBy("link_key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "link_key"]), F.struct("id", "nth")).alias("r")).select("link_key", "r.*")


def appended(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """What is to be appended: rows whose link the registry lacks (as it is now), once each, with numbers that go on from its greatest."""
    new = rows.join(registry.select(F.lower("link").alias("link_key")), "link_key", "left_anti")
    return numbered_from(new, registry, ["id", "nth"])


def advanced(scanned: DataFrame, cursor: int) -> DataFrame:
    """The cursor after a pass whose rows have been written: only then may it move."""
    return scanned.agg(F.greatest(F.lit(cursor), F.coalesce(F.max("id"), F.lit(cursor))).alias("cursor"))

"""Queries of logs, upkeep, bursts and layout, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import layout, logs, upkeep
from ..streaming import folds
from .queries import EV, MIDNIGHT, NOW, _t, downloads, query, timed

#: Log lines, by event_id: these stand for a console's.
LINES = (
    "01-15 10:00:00 [warn] 二维码已保存到 D:\\x\\qr.png", "01-15 10:00:01 [error] [Core] [Login] Login Error, ErrCode: 3", "01-15 10:00:02 [info] 正在快速登录 10001 now", "01-15 10:00:03 [info] 协议适配器初始化完成, 2",
    "01-15 10:00:04 [info] NapCat.Core Version: 4.8.1 ", "01-15 10:00:05 [warn] 请扫描下面的二维码", "no time [error] 账号已被冻结", "01-15 10:00:07 [fatal] resource TYPE x is currently disabled, failure: 12",
    "01-15 10:00:08 [info] WebUi User Panel Url: http://h/?t=1", "01-15 10:00:09 [info] nothing",
)
LINE_SQL = f"lines AS (SELECT event_id AS id, [{', '.join(repr(x) if chr(92) not in x else chr(39) + x + chr(39) for x in LINES)}][event_id % {len(LINES)} + 1] AS line FROM events)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, LINES)), (F.col("event_id") % len(LINES) + 1).cast("int")).alias("line"))


@query(f"WITH {LINE_SQL} " + " UNION ALL ".join(f"SELECT id, '{name}' AS signal, '{severity}' AS severity FROM lines WHERE regexp_matches(line, '(?i){pattern}')" for name, pattern, severity in logs.SIGNALS))
def risk_signals(spark, d):
    return logs.risk_signals(lines(spark, d))


@query(f"""WITH {LINE_SQL}, t AS (SELECT id, trim(line) AS line FROM lines WHERE regexp_matches(line, '^..-.. ..:')),
x AS (SELECT id, CASE WHEN contains(line, '{logs.QR_SAVED}') THEN ['qr_saved', trim(split_part(line, '{logs.QR_SAVED}', 2))] WHEN contains(line, '{logs.LOGIN_ERROR}') THEN ['login_error', line] WHEN contains(line, '{logs.QUICK_LOGIN}') THEN ['quick_login', split_part(trim(split_part(line, '{logs.QUICK_LOGIN}', 2)), ' ', 1)]
WHEN contains(line, '{logs.READY}') THEN ['adapter_ready', NULL] WHEN contains(line, '{logs.VERSION}') THEN ['core_version', trim(split_part(line, '{logs.VERSION}', 2))] WHEN contains(line, '{logs.PANEL}') THEN ['panel_url', trim(split_part(line, '{logs.PANEL}', 2))]
WHEN NOT contains(line, '{logs.QR_PROMPT}') AND (contains(line, '[error]') OR contains(line, '[fatal]') OR contains(line, '[warn]')) THEN ['diagnostic', line] END AS e FROM t)
SELECT id, e[1] AS event, e[2] AS detail FROM x WHERE e IS NOT NULL""")
def log_events(spark, d):
    return logs.log_events(lines(spark, d))


@query(f"""WITH {EV}, m AS (SELECT * REPLACE (next_try + (id % 3) * 17280000 AS next_try) FROM ev), s AS (SELECT name, arg_min(md5, id) AS smd5 FROM m WHERE dl = 'ok' AND md5 IS NOT NULL AND name IS NOT NULL GROUP BY name),
j AS (SELECT m.*, smd5, coalesce(dl = 'dead' AND kind IN ('image', 'video') AND smd5 IS NOT NULL, false) AS saved FROM m LEFT JOIN s USING (name))
SELECT id, CASE WHEN saved THEN 'ok' WHEN dl = 'busy' THEN 'pending' ELSE dl END AS dl, CASE WHEN saved OR dl = 'ok' THEN 0 ELSE tries END AS tries, CASE WHEN NOT saved AND dl <> 'ok' THEN dead_at END AS dead_at, CASE WHEN saved THEN smd5 ELSE md5 END AS md5,
CASE WHEN saved OR dl = 'busy' THEN 0 ELSE dl_bytes END AS dl_bytes, CASE WHEN dl = 'dead' AND NOT saved AND parent IS NOT NULL AND msg_id IS NULL AND next_try > {NOW + 8640000} THEN {NOW} ELSE next_try END AS next_try FROM j""")
def startup_recovery(spark, d):
    m = downloads(spark, d).withColumn("next_try", F.col("next_try") + (F.col("id") % 3) * 17280000)
    return upkeep.recovered(m, NOW).select("id", "dl", "tries", "dead_at", "md5", "dl_bytes", "next_try")


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '  ' WHEN doc_id % 2 = 0 THEN upper(substr(md5(text), 1, 2)) ELSE ' ' || substr(md5(text), 1, 2) END AS hash FROM documents)
SELECT doc_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(hash)) ORDER BY doc_id) AS nth FROM s) WHERE nth = 1 OR trim(hash) = ''""")
def sheet_keep_first(spark, d):
    md5 = F.substring(F.md5(F.col("text").cast("binary")), 1, 2)
    s = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 13 == 0, "  ").when(F.col("doc_id") % 2 == 0, F.upper(md5)).otherwise(F.concat(F.lit(" "), md5)).alias("hash"))
    return upkeep.keep_first(s, "hash", "doc_id")


@query("SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-30' - 14")
def backup_retention(spark, d):
    return upkeep.expired_backups(_t(spark, d, "events").select(F.to_date("ts").alias("day")).distinct(), "2024-01-30")


POLLS = "p AS (SELECT user_id AS session, event_id AS t, event_type, event_type IN ('view', 'click') AS live, value, event_type = 'error' AND event_id % 5 = 0 AS stopped FROM events)"


@query(f"""WITH {POLLS}, r AS (SELECT *, sum(CASE WHEN live THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t) AS run FROM p),
m AS (SELECT *, sum(CASE WHEN live THEN 0 ELSE 1 END) OVER (PARTITION BY session, run ORDER BY t) AS misses FROM r),
e AS (SELECT session, min(t) FILTER (WHERE stopped) AS s, min(t) FILTER (WHERE misses >= 6) AS l FROM m GROUP BY session),
k AS (SELECT m.session, m.t, least(value, 50.0) AS position FROM m JOIN e ON m.session = e.session WHERE live AND (s IS NULL OR m.t < s) AND (l IS NULL OR m.t <= l)),
c AS (SELECT *, lag(position) OVER (PARTITION BY session ORDER BY t) AS last FROM k) SELECT session, t, position FROM c WHERE last IS NULL OR last <> position""")
def tracked_positions(spark, d):
    e, kind = _t(spark, d, "events"), F.col("event_type")
    polls = e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("t"), F.when((kind == "error") & (F.col("event_id") % 5 == 0), "stopped").otherwise("playing").alias("state"),
        F.when(kind.isin("view", "click"), "live").otherwise("title").alias("source"), F.col("value").alias("position"), F.lit(50.0).alias("duration"),
    )
    return upkeep.tracked_positions(polls)


@query()
def capped_bursts(spark, d):
    return folds.capped_sessions(timed(spark, d), 14400, 28800)


@query()
def justified_layout(spark, d):
    """A gallery for each source: documents as pictures."""
    items = _t(spark, d, "documents").select(F.xxhash64("source").alias("key"), F.col("doc_id").alias("nth"), ((F.col("n_chars") % 37 + 8) / 16.0).alias("aspect"))
    return layout.justified_rows(items, 1200.0, 180.0, 8.0, 40.0, *layout.ASPECTS)


@query(f"SELECT event_id AS id, {MIDNIGHT} - 86400 * 30 AS cutoff FROM events WHERE NOT (event_type = 'purchase' AND floor(epoch(ts)) < {MIDNIGHT} - 86400 * 30)")
def event_retention(spark, d):
    cutoff = MIDNIGHT - 86400 * 30
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "done").otherwise("new").alias("status"), scalars.epoch(F.col("ts")).alias("received_at"))
    return upkeep.retained(e, cutoff).select("id", F.lit(cutoff).alias("cutoff"))

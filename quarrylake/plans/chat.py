"""Queries of chat events in JSON, the queue's life, the registry of links and displayed text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, scalars
from ..operators import events, logs, queue, registry
from .queries import EV, MIDNIGHT, NOW, _t, downloads, query
from .upkeep import LINE_SQL, lines

GROUP = "turn % 3 > 0"
#: Events that conversations stand for: each row is a message of a text, a picture, a card and, in some, a quotation; rows of turn 4 k + 3 are notices.
CHAT = f"""chat AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS id, conv_id, turn, role, text, CASE WHEN {GROUP} THEN 'group' ELSE 'private' END AS scope,
CASE WHEN {GROUP} THEN conv_id % 7 ELSE conv_id % 50 END AS peer_id, conv_id % 50 AS sender_id, turn * 60 + conv_id AS ts, conv_id * 1000 + turn AS msg_id FROM conversations)"""
MESSAGES = f"{CHAT}, m AS (SELECT * FROM chat WHERE turn % 4 <> 3)"


def segment(kind: str, **data) -> F.Column:
    """One segment of a payload; its data as the event schema has it."""
    return F.struct(F.lit(kind).alias("type"), F.struct(*[F.lit(data[k]).cast("string").alias(k) if isinstance(data.get(k), str) else data.get(k, F.lit(None)).cast("string").alias(k) for k in DATA]).alias("data"))


DATA = [x.split()[0] for x in events.DATA.split(", ")]


def chat(spark: SparkSession, d: str) -> DataFrame:
    """id, payload and the conversation's own columns. Ids go by (conv_id, turn, role, text); repeated rows get their own."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    c = queue.numbered_from(c, spark.createDataFrame([(0,)], "id long"), ["conv_id", "turn", "role", "text"], "id")
    group = F.col("turn") % 3 > 0
    card = F.to_json(F.struct(F.concat(F.lit("card "), F.col("conv_id").cast("string")).alias("prompt"), F.concat(F.lit("https://x.example/"), F.col("conv_id").cast("string"), F.lit("?a=1&b=2")).alias("link"), F.lit("magnet:?xt=urn:btih:0AbC").alias("m")))
    segments = F.array(
        segment("text", text=F.col("text")), segment("image", url=F.concat(F.lit("http://i/"), F.col("conv_id").cast("string")), file=F.concat(F.md5(F.col("conv_id").cast("string").cast("binary")), F.lit(".jpg"))),
        segment("json", data=card), segment("reply", id=F.when(F.col("turn") % 2 == 0, F.col("conv_id")).cast("string")), segment("location", title="Here", lat="1.5", lng="2.5"), segment("at", qq="7"), segment("poke"),
    )
    payload = F.struct(
        F.when(F.col("turn") % 4 == 3, "notice").otherwise("message").alias("post_type"), F.when(group, "group").otherwise("private").alias("message_type"), (F.col("conv_id") % 7).alias("group_id"), (F.col("turn") * 60 + F.col("conv_id")).alias("time"),
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("message_id"), F.struct((F.col("conv_id") % 50).alias("user_id"), F.col("role").alias("nickname")).alias("sender"), segments.alias("message"),
    )
    return c.withColumn("payload", F.to_json(payload))


@query(f"WITH {MESSAGES} SELECT id, msg_id AS message_id, scope AS message_type, ts AS time, role AS nickname FROM m")
def message_events(spark, d):
    m = events.message_events(chat(spark, d), groups=True)
    return m.select("id", F.col("message_id").cast("long").alias("message_id"), "message_type", "time", F.col("sender.nickname").alias("nickname"))


CARD = "'[JSON卡片]' || chr(10) || 'card ' || conv_id || chr(10) || 'https://x.example/' || conv_id || '?a=1&b=2' || chr(10) || 'magnet:?xt=urn:btih:0AbC'"
SEGS = f"""segs AS (SELECT m.*, i AS seg_index, CASE i WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 3 THEN 'reply' ELSE 'other' END AS kind,
CASE i WHEN 0 THEN coalesce(text, '') WHEN 1 THEN '' WHEN 2 THEN {CARD} WHEN 3 THEN CASE WHEN turn % 2 = 0 THEN '' ELSE '[回复]' END WHEN 4 THEN '[位置]' || chr(10) || 'Here' WHEN 5 THEN '[@]' ELSE '[poke]' END AS shown,
CASE WHEN i = 1 THEN 'http://i/' || conv_id ELSE '' END AS src, CASE WHEN i = 1 THEN md5(CAST(conv_id AS VARCHAR)) || '.jpg' WHEN i = 3 AND turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE '' END AS ref,
CASE WHEN i = 1 OR (i = 3 AND turn % 2 = 0) THEN 'pending' ELSE 'none' END AS dl FROM m, unnest(range(7)) AS u(i))"""
PREFIX = "CASE WHEN scope = 'group' THEN '[' || peer_id || '/' || role || '] ' ELSE '[' || role || '(' || sender_id || ')] ' END"


@query(f"WITH {MESSAGES}, {SEGS} SELECT id AS event_id, CAST(msg_id AS VARCHAR) AS msg_id, scope, peer_id, sender_id, role AS sender_nick, ts, CAST(seg_index AS INTEGER) AS seg_index, kind, shown AS text, src, ref, '' AS name, dl, CASE WHEN dl = 'none' THEN {PREFIX} || shown END AS line FROM segs")
def segments_explode(spark, d):
    """Segments of messages as rows of the archive."""
    return events.segment_rows(events.message_events(chat(spark, d), groups=True))


@query(f"WITH {MESSAGES} SELECT id, '[回复←' || role || '：' || substr(trim(coalesce(text, '') || '[图片]' || {CARD} || '[回复]' || '[位置]' || chr(10) || 'Here' || '@7 ' || '[poke]'), 1, 200) || ']' AS line FROM m WHERE scope = 'private'")
def quotations(spark, d):
    return events.message_events(chat(spark, d)).select("id", events.quotation(F.struct("sender", "message", "raw_message")).alias("line"))


@query(f"WITH {MESSAGES} SELECT id, 'http://i/' || conv_id AS url, CASE WHEN id % 2 = 0 THEN 'image' ELSE 'json' END AS type FROM m")
def fresh_urls(spark, d):
    """The segment that a row of the archive has in its event, and a link read anew."""
    m = events.message_events(chat(spark, d), groups=True)
    rows = m.select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("seg_index"))
    at = events.segment_at(rows, m).join(m.select(F.col("id").alias("event_id"), "message"), "event_id")
    return at.select(F.col("event_id").alias("id"), events.fresh_url(F.col("message"), F.col("segment.type"), F.col("seg_index")).alias("url"), F.col("segment.type").alias("type"))


@query(f"WITH {MESSAGES}, {SEGS} SELECT count(*) AS n, count(DISTINCT id) AS n_events, count(CASE WHEN seg_index = 0 THEN 1 END) AS n_texts FROM segs")
def replay_twice(spark, d):
    """Events that are taken apart again replace what they gave before."""
    rows = events.segment_rows(events.message_events(chat(spark, d), groups=True)).checkpoint()
    twice = events.replayed(events.replayed(rows, rows.where("event_id % 3 = 0")), rows.where("event_id % 2 = 0"))
    return twice.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_events"), F.count_if(F.col("seg_index") == 0).alias("n_texts"))


def forwards(spark: SparkSession, d: str) -> DataFrame:
    """id and content: a conversation's row, within it a forward with the same text, four levels deep."""
    c = chat(spark, d).select("id", "role", "text", "turn", F.col("conv_id").alias("t"))
    content = F.lit(None).cast("string")
    for _ in range(5):
        inner = segment("forward", id="f", content=content)
        content = F.to_json(F.array(F.struct(F.struct(F.col("role").alias("nickname")).alias("sender"), F.col("t").alias("time"), F.array(segment("text", text=F.col("text")), segment("image", url="u"), inner).alias("message"))))
    return c.select("id", content.alias("content"))


@query(f"WITH {CHAT} SELECT id, CAST(k AS INTEGER) AS depth, role AS sender_nick, conv_id AS ts, kind, CASE WHEN kind = 'text' THEN coalesce(text, '') ELSE '' END AS text, CASE WHEN kind = 'image' THEN 'u' ELSE '' END AS src, CAST(len(p) AS BIGINT) AS places FROM chat, (SELECT k, list_resize([0, 0], 2 * k + 2, 2) AS p FROM unnest(range(4)) AS v(k)), (VALUES ('text'), ('image'), ('forward')) AS s(kind)")
def forward_flatten(spark, d):
    return events.flattened_forwards(forwards(spark, d)).select("id", "depth", "sender_nick", "ts", "kind", "text", "src", F.size("place").cast("long").alias("places"))


def _nested(depth: int) -> str:
    pad, line = "  " * (depth + 1), "role || '(' || strftime(make_timestamp(conv_id * 1000000), '%H:%M:%S') || '): ' || coalesce(text, '') || '[图片]'"
    inner = "'[合并转发]'" if depth == 3 else f"'[合并转发↓]' || chr(10) || {_nested(depth + 1)} || chr(10) || '{pad}[合并转发↑]'"
    return f"'{pad}' || {line} || {inner}"


@query(f"WITH {CHAT} SELECT id, {_nested(0)} AS text FROM chat")
def forward_lines(spark, d):
    return forwards(spark, d).select("id", events.rendered_nodes(F.col("content")).alias("text"))


# --- registry ---

TEXTS = r"texts AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'group' ELSE 'private' END AS scope, page_id % 9 AS peer_id, 'n' || page_id % 5 AS nick, page_id * 100 AS ts, url, CASE WHEN page_id % 3 > 0 THEN url ELSE 'magnet' END AS shown FROM pages)"


def link_texts(spark: SparkSession, d: str) -> DataFrame:
    i, p = F.col("page_id"), _t(spark, d, "pages")
    line = F.concat(F.lit("see "), F.when(i % 3 == 1, F.concat("url", F.lit("/all of it, then "))).otherwise(""), F.lit("： "), F.when(i % 3 > 0, F.col("url")).otherwise("magnet"), F.lit("。 and more"))
    text = F.concat(F.lit("first line\nann(12:00:01): "), line)
    return p.select(i.alias("id"), F.when(i % 2 == 0, "group").otherwise("private").alias("scope"), (i % 9).alias("peer_id"), F.concat(F.lit("n"), (i % 5).cast("string")).alias("sender_nick"), (i * 100).alias("ts"), text.alias("text"))


@query(f"WITH {TEXTS} SELECT id FROM texts WHERE (id > 20 OR id % 7 = 0) AND shown <> 'magnet' ORDER BY id LIMIT 500")
def link_cursor(spark, d):
    t = link_texts(spark, d)
    return registry.to_scan(t, 20, t.where("id % 7 = 0")).select("id")


@query(f"""WITH {TEXTS}, l AS (SELECT *, lower(url) AS k, url AS link, 1 AS pos, CASE WHEN id % 3 = 1 THEN 'see ' || url || '/all of it, then' ELSE 'see' END AS title FROM texts WHERE shown <> 'magnet'
UNION ALL SELECT *, lower(url) || '/all', url || '/all', 0, 'see' FROM texts WHERE id % 3 = 1), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id, pos) AS nth FROM l),
n AS (SELECT * FROM o WHERE nth = 1 AND k NOT IN (SELECT lower(url) FROM pages WHERE page_id % 10 = 1))
SELECT id, link, title, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS first_date, strftime(make_timestamp(ts * 1000000), '%H:%M:%S') AS first_time, nick AS sender, CASE WHEN scope = 'group' THEN CAST(peer_id AS VARCHAR) ELSE '' END AS gid, 41 + row_number() OVER (ORDER BY id, pos) AS seq FROM n""")
def registry_append(spark, d):
    known = _t(spark, d, "pages").where("page_id % 10 = 1").select(F.col("url").alias("link"), F.lit(41).cast("long").alias("seq"))
    return registry.appended(known, registry.link_rows(link_texts(spark, d))).select("id", "link", "title", "first_date", "first_time", "sender", "gid", "seq")


@query(f"WITH {TEXTS} SELECT greatest(20, coalesce(max(id), 20)) AS cursor FROM texts WHERE (id > 20 OR id % 7 = 0) AND shown <> 'magnet'")
def cursor_advance(spark, d):
    t = link_texts(spark, d)
    return registry.advanced(registry.to_scan(t, 20, t.where("id % 7 = 0"), limit=1 << 30), 20)


# --- queue ---


@query(f"WITH {EV}, c AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 AND dl IN ('pending', 'dead') THEN 'busy' ELSE dl END AS dl) FROM ev), s AS (SELECT id, max(id % 7 + k) AS t, arg_max(id * k, id % 7 + k) AS done FROM ev, unnest(range(3)) AS u(k) WHERE id % 2 = 0 GROUP BY id) SELECT c.id, dl, CASE WHEN s.id IS NOT NULL AND dl = 'busy' THEN s.t ELSE prog_at END AS prog_at, CASE WHEN s.id IS NOT NULL AND dl = 'busy' THEN s.done ELSE dl_bytes END AS dl_bytes FROM c LEFT JOIN s ON c.id = s.id")
def queue_progress(spark, d):
    m = downloads(spark, d)
    samples = m.where("id % 2 = 0").select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("id", (F.col("id") % 7 + F.col("k")).alias("t"), (F.col("id") * F.col("k")).alias("done"))
    return queue.progressed(queue.claimed(m, m.where("id % 5 = 0"), NOW), samples).select("id", "dl", "prog_at", "dl_bytes")


@query(f"""WITH {EV}, f AS (SELECT * REPLACE (CASE WHEN id % 9 = 0 THEN 'ok' ELSE dl END AS dl, CASE WHEN id % 9 = 0 THEN 'm' || id ELSE md5 END AS md5, CASE WHEN id % 9 = 0 THEN {NOW} ELSE ok_at END AS ok_at, CASE WHEN id % 9 > 0 THEN dead_at END AS dead_at, CASE WHEN id % 9 = 0 THEN 0 ELSE tries END AS tries) FROM ev),
s AS (SELECT name, arg_min(md5, id) AS smd5 FROM f WHERE dl = 'ok' AND md5 IS NOT NULL AND name IS NOT NULL GROUP BY name),
r AS (SELECT f.*, dl = 'dead' AND smd5 IS NOT NULL AS saved, smd5 FROM f LEFT JOIN s USING (name))
SELECT id, CASE WHEN saved THEN 'ok' WHEN dl = 'busy' AND (prog_at IS NULL OR {NOW} - prog_at > 1800) THEN 'dead' ELSE dl END AS dl, CASE WHEN saved THEN smd5 ELSE md5 END AS md5, ok_at, tries, CASE WHEN dl = 'busy' AND (prog_at IS NULL OR {NOW} - prog_at > 1800) THEN {NOW} ELSE dead_at END AS dead_at FROM r""")
def queue_ends(spark, d):
    """Rows that end well, dead ones that live from them, and rows at work that have stalled."""
    m = downloads(spark, d)
    done = m.where("id % 9 = 0").select("id", F.concat(F.lit("m"), F.col("id").cast("string")).alias("md5"), "bytes")
    return queue.reaped(queue.finished(m, done, NOW), NOW).select("id", "dl", "md5", "ok_at", "tries", "dead_at")


EVENTS = f"e AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'error' WHEN 2 THEN 'done' ELSE 'dead' END AS status, {NOW} - 40000 + event_id * 100 AS next_try, CAST(epoch(ts) AS BIGINT) AS received_at FROM events)"


@query(f"WITH {EVENTS} SELECT id, status FROM e WHERE status = 'new' OR (status = 'error' AND next_try <= {NOW}) ORDER BY id LIMIT 20")
def events_due(spark, d):
    i = F.col("event_id")
    e = _t(spark, d, "events").select(i.alias("id"), F.when(i % 4 == 0, "new").when(i % 4 == 1, "error").when(i % 4 == 2, "done").otherwise("dead").alias("status"), (F.lit(NOW - 40000) + i * 100).alias("next_try"))
    return queue.due_events(e, NOW, 20).select("id", "status")


@query("SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) AS received_at FROM events")
def events_watermark(spark, d):
    return queue.watermark(_t(spark, d, "events").select(scalars.epoch(F.col("ts")).alias("received_at")))


ARCHIVED = f"a AS (SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN CAST(event_id AS VARCHAR) END AS msg_id, 'private' AS scope, user_id AS peer_id, user_id AS sender_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)"


@query(f"WITH {ARCHIVED}, h AS (SELECT * FROM a WHERE ts <= {MIDNIGHT}), act AS (SELECT DISTINCT peer_id FROM h WHERE ts >= {MIDNIGHT} + 86400 - 3 * 86400), p AS (SELECT * FROM a WHERE ts >= {MIDNIGHT} - 86400 - 120 AND ts <= {MIDNIGHT} + 86400 AND peer_id IN (SELECT peer_id FROM act)) SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.msg_id = p.msg_id) AND NOT EXISTS (SELECT 1 FROM h WHERE h.peer_id = p.peer_id AND h.sender_id = p.sender_id AND h.ts = p.ts)")
def gap_backfill(spark, d):
    """An outage of two days: of what chats hold, the archive lacks what came after its end."""
    i = F.col("event_id")
    a = _t(spark, d, "events").select(i.alias("id"), F.when(i % 3 > 0, i.cast("string")).alias("msg_id"), F.lit("private").alias("scope"), F.col("user_id").alias("peer_id"), F.col("user_id").alias("sender_id"), scalars.epoch(F.col("ts")).alias("ts"))
    return queue.gap_backfill(a.where(F.col("ts") <= MIDNIGHT + 86400), a.where(F.col("ts") <= MIDNIGHT), MIDNIGHT - 86400, MIDNIGHT + 86400).select("id")


@query()
def watch_backoff(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("key"), (scalars.epoch(F.col("ts")) / 100).cast("long").alias("t"), (F.col("event_type") == "error").alias("failed"))
    return queue.backed_off(e)


# --- logs ---


@query(f"""WITH {LINE_SQL}, k AS (SELECT *, id % 97 AS log FROM lines), l AS (SELECT log, max(id) FILTER (WHERE contains(line, '{logs.LOGIN_ERROR}')) AS err, max(id) FILTER (WHERE contains(line, '{logs.QR_SAVED}')) AS qr,
max(id) FILTER (WHERE contains(line, '{logs.READY}')) AS ready, max(id) FILTER (WHERE regexp_matches(line, '^\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d')) AS stamped, log % 2 = 0 AS ports FROM k GROUP BY log)
SELECT log, CASE WHEN err IS NOT NULL AND err > coalesce(qr, -1) THEN 'waiting_qr' WHEN qr IS NOT NULL AND ready IS NULL THEN 'waiting_qr' WHEN ready IS NOT NULL AND ports THEN 'ready' WHEN ready IS NOT NULL THEN 'initializing' WHEN stamped IS NOT NULL THEN 'starting' ELSE 'not_running' END AS stage FROM l""")
def log_stages(spark, d):
    """The lines of 97 logs; every other one's ports are open."""
    k = lines(spark, d).withColumn("log", F.col("id") % 97)
    return logs.log_stages(k, "log").select("log", display.stage_of(F.col("login_error"), F.col("qr"), F.col("ready"), F.col("log") % 2 == 0, F.col("stamp")).alias("stage"))


# --- text ---


@query(r"""WITH v(k, u) AS (VALUES (0, 'B'), (1, 'KB'), (2, 'MB'), (3, 'GB'), (4, 'TB')), n AS (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 100000 ELSE 100000000 END END AS n FROM events),
s AS (SELECT id, n, u, k, n / pow(1024, k) AS x FROM n JOIN v ON k = CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END)
SELECT id, CASE WHEN n <= 0 THEN '0 B' ELSE regexp_replace(CAST(CAST(floor(x * 10 + 0.5) / 10 AS DECIMAL(20, 1)) AS VARCHAR), '\.0$', '') || ' ' || u END AS file_size,
CASE WHEN n <= 0 THEN '-' WHEN x >= 100 OR k = 0 THEN CAST(CAST(floor(x + 0.5) AS BIGINT) AS VARCHAR) || ' ' || u ELSE CAST(CAST(floor(x * 10 + 0.5) / 10 AS DECIMAL(20, 1)) AS VARCHAR) || ' ' || u END AS download_size FROM s""")
def size_labels(spark, d):
    e, i = _t(spark, d, "events"), F.col("event_id")
    scale = F.when(i % 4 == 0, 1).when(i % 4 == 1, 100).when(i % 4 == 2, 100_000).otherwise(100_000_000)
    n = F.when(i % 50 == 0, 0).otherwise(F.floor(F.col("value") * 100) * scale).cast("long")
    return e.select(i.alias("id"), display.file_size_text(n).alias("file_size"), display.download_size_text(n).alias("download_size"))


@query("""SELECT doc_id AS id, CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || ':' || lpad(CAST(n_chars % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(n_chars // 60 AS VARCHAR) END || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS duration,
CASE WHEN doc_id % 3 = 0 THEN '' ELSE n_chars || '×' || doc_id % 3 END AS resolution, CAST(least(n_chars * 0.1, 10.0) AS DOUBLE) AS anchor_at, CAST(n_chars * 0.85 AS DOUBLE) AS tail_at, CASE WHEN doc_id % 2 = 0 THEN CAST(least(100, floor(n_chars / 2000.0 * 100 + 0.5)) AS BIGINT) END AS percent FROM documents""")
def media_labels(spark, d):
    n, i = F.col("n_chars"), F.col("doc_id")
    at = display.sample_times(n.cast("double"))
    return _t(spark, d, "documents").select(
        i.alias("id"), display.duration_text(n).alias("duration"), display.resolution_text(n, i % 3).alias("resolution"), at["anchor"].alias("anchor_at"), at["tail"].alias("tail_at"),
        display.percent(n, F.lit(2000), F.when(i % 2 == 0, "busy").otherwise("ok")).alias("percent"),
    )


@query("""SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN '-' WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%m-%d %H:%M') END AS clock, CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS midnight, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CAST(floor(epoch(ts)) AS BIGINT) AS parsed, strftime(ts, '%m-%d %H:%M:%S') AS log_stamp FROM events""")
def time_labels(spark, d):
    e = _t(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    t = F.col("t")
    stamp = display.utc_stamp(t)
    return e.select(
        F.col("event_id").alias("id"), display.clock_text(F.when(F.col("event_id") % 9 > 0, t), F.lit("2024-01-15 10:00:00").cast("timestamp")).alias("clock"), display.midnight(t).alias("midnight"), stamp.alias("stamp"),
        F.unix_timestamp(display.parsed_utc(F.when(F.col("event_id") % 2 == 0, stamp).otherwise(F.regexp_replace(stamp, "T", " ")))).alias("parsed"), display.log_stamp(F.concat(F.date_format(t, "MM-dd HH:mm:ss"), F.lit(" [info] x"))).alias("log_stamp"),
    )


@query("""WITH x AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN '  ' END AS name, CASE WHEN doc_id % 5 IN (1, 2) THEN text END AS text, CASE WHEN doc_id % 5 = 3 THEN 'D:\\a/' || lang END AS path, CASE WHEN doc_id % 2 = 0 THEN 'image' ELSE 'odd' END AS kind FROM documents)
SELECT id, coalesce(CASE WHEN regexp_replace(name, '\\s+', '', 'g') <> '' THEN name END, CASE WHEN regexp_replace(text, '\\s+', '', 'g') <> '' THEN substr(text, 1, 80) END, CASE WHEN path IS NOT NULL THEN regexp_extract(path, '[^/\\\\]*$') END, CASE kind WHEN 'image' THEN '图片' ELSE '消息' END) AS label FROM x""")
def row_labels(spark, d):
    i = F.col("doc_id")
    return _t(spark, d, "documents").select(i.alias("id"), display.row_label(F.when(i % 5 == 0, F.col("source")).when(i % 5 == 1, "  "), F.when((i % 5).isin(1, 2), F.col("text")), F.when(i % 5 == 3, F.concat(F.lit("D:\\a/"), "lang")), F.when(i % 2 == 0, "image").otherwise("odd")).alias("label"))


@query(r"""SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'png' WHEN lower(regexp_extract(split_part(url, '?', 1), '[^.]*$')) IN ('jpg', 'jpeg', 'png', 'gif', 'bmp', 'webp') THEN lower(regexp_extract(split_part(url, '?', 1), '[^.]*$')) ELSE 'jpg' END AS extension, md5(url) AS hint,
TRUE AS is_hash, page_id * 10 AS full_size, CASE WHEN page_id % 2 = 0 THEN 8080 ELSE 6099 END AS port, page_id % 4 > 0 AS valid, page_id % 2 = 0 AS same, TRUE AS agree FROM pages""")
def file_hints(spark, d):
    """What links, names and headers tell about files."""
    i, name = F.col("page_id"), F.concat(F.upper(F.md5(F.col("url").cast("binary"))), F.lit(".jpg"))
    return _t(spark, d, "pages").select(
        i.alias("id"), display.media_extension(F.when(i % 3 == 0, "image/png"), F.col("url"), F.lit("image")).alias("extension"), display.md5_hint(name).alias("hint"), display.is_hash_name(name).alias("is_hash"),
        display.full_size(F.concat(F.lit("bytes 0-1/ "), (i * 10).cast("string"))).alias("full_size"), display.port_of(F.when(i % 2 == 0, "ws://h:8080/x").otherwise("ws://h/x"), 6099).alias("port"),
        display.valid_target(F.when(i % 4 > 0, "D:\\a\\b").otherwise("D:\\a/../b")).alias("valid"), display.same_folder(F.lit("D:\\A/b\\"), F.when(i % 2 == 0, "d:/a/B").otherwise("d:/a/c")).alias("same"), display.extensions_agree(F.lit("JPG"), F.lit("jpeg")).alias("agree"),
    )


@query("SELECT id, text LIKE '%[图片] x' OR text LIKE '%[视频]' AS bare FROM (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN lang || '[图片] x' WHEN 1 THEN lang || ' [图片] abc.JPG' ELSE lang || '[图片] a.png [视频]' END AS text FROM documents)")
def bare_placeholders(spark, d):
    i = F.col("doc_id")
    text = F.concat("lang", F.when(i % 3 == 0, "[图片] x").when(i % 3 == 1, " [图片] abc.JPG").otherwise("[图片] a.png [视频]"))
    return _t(spark, d, "documents").select(i.alias("id"), display.has_bare_media(F.lit("forward"), text, F.lit("ok")).alias("bare"))

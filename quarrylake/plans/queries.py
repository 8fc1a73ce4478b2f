"""The operators applied to the driver's tables, with the same in SQL. Which columns play which part is in the functions below."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, scalars
from ..operators import catalog, ingest, messages, search, similarity
from ..streaming import folds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIDNIGHT = 1705276800  # 2024-01-15
NOW = MIDNIGHT + 40_000


def query(sql: str | None = None):
    def registered(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return registered


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- catalog: pages, by their URL without query and anchor ---

FILES = r"""files AS (SELECT page_id AS id, regexp_extract(url, '^[^?#]*') AS path, regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/\\]*$') AS filename, length(html) AS file_size FROM pages)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", r"^[^?#]*", 0).alias("path"), F.char_length("html").cast("long").alias("file_size"))
    return p.withColumn("filename", paths.basename(F.col("path")))


@query(f"WITH {FILES} SELECT id, path, filename, file_size FROM files WHERE starts_with(translate(replace(path, '/', '\\'), '{UPPER}', '{LOWER}'), 'https:\\') AND contains(translate(filename, '{UPPER}', '{LOWER}'), '2') ORDER BY filename, id LIMIT 20 OFFSET 5")
def catalog_view(spark, d):
    return catalog.view(files(spark, d), "HTTPS:/", " 2 ", 20, 5).select("id", "path", "filename", "file_size")


@query(f"WITH {FILES} SELECT count(*) AS total, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size FROM files WHERE starts_with(lower(path), 'https:/') AND contains(lower(filename), '2')")
def catalog_totals(spark, d):
    return catalog.totals(catalog.matching(files(spark, d), "https:", "2"))


@query(f"WITH {FILES} SELECT regexp_extract(replace(path, '/', '\\'), '^(.*)\\\\[^\\\\]*$', 1) AS dir, count(*) AS n FROM files WHERE contains(path, '/') GROUP BY 1")
def dir_stats(spark, d):
    return catalog.dir_stats(files(spark, d))


@query(rf"""WITH {FILES}, parts AS (SELECT string_split(replace(path, '/', '\'), '\') AS p FROM files),
up AS (SELECT array_to_string(p[1:i], '\') AS path, i FROM parts, unnest(range(1, len(p))) AS u(i))
SELECT path, CASE WHEN any_value(i) > 1 THEN regexp_extract(path, '^(.*)\\[^\\]*$', 1) END AS parent, CAST(any_value(i) AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS item_count FROM up GROUP BY path""")
def dir_tree_rollup(spark, d):
    return catalog.tree_rollup(files(spark, d))


@query(rf"""WITH {FILES}, roots(root) AS (VALUES ('http:'), ('https:'), ('ftp:'), ('https://m.ththth.example.net'))
SELECT root, count(path) AS n FROM roots LEFT JOIN files ON starts_with(lower(path), root || '/') GROUP BY root""")
def root_counts(spark, d):
    return catalog.root_counts(files(spark, d), ["http:", "https:", "ftp:", "https://m.ththth.example.net"])


@query(f"WITH {FILES} SELECT f.id, f.path FROM files f WHERE id IN (SELECT doc_id FROM labels)")
def ids_lookup(spark, d):
    return catalog.by_ids(files(spark, d), _t(spark, d, "labels").select(F.col("doc_id").alias("id"))).select("id", "path")


@query(f"WITH {FILES} SELECT id, filename, lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) AS ext, regexp_replace(lower(replace(regexp_replace(path, '[^/]*$', ''), '/', '\\')), '\\\\+$', '') AS dir_key FROM files")
def path_parts(spark, d):
    return files(spark, d).select("id", "filename", paths.extension(F.col("path")).alias("ext"), paths.dedupe_key(F.regexp_replace("path", r"[^/]*$", "")).alias("dir_key"))


@query(f"WITH {FILES} SELECT id, CASE WHEN starts_with(lower(path), 'http://') THEN 'D:\\web' || substr(path, 6) ELSE path END AS path, CASE WHEN id % 10 = 0 THEN 'moved.html' ELSE filename END AS filename FROM files")
def path_moves(spark, d):
    f = files(spark, d).withColumn("path", paths.moved(F.col("path"), "http:", "D:\\web"))
    patched = ingest.patch_paths(f, f.where("id % 10 = 0").select("id", F.lit("E:\\x/moved.html").alias("new_path")))
    return f.select("id", "path").join(patched.select("id", "filename"), "id").select("id", "path", "filename")


# --- progress and sorting: documents as videos ---

DOCS = "docs AS (SELECT d.doc_id AS id, d.source AS filename, CAST(d.n_chars AS DOUBLE) AS duration, d.n_chars AS file_size, l.quality * (d.doc_id % 7) / 6.0 * d.n_chars AS position FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def videos(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("n_chars").cast("double").alias("duration"), F.col("n_chars").alias("file_size"))
    l = _t(spark, d, "labels").join(v.select("id", "duration"), F.col("doc_id") == F.col("id"))  # noqa: E741
    return v, l.select("id", (F.col("quality") * (F.col("id") % 7) / F.lit(6.0) * F.col("duration")).alias("position"))


@query(f"WITH {DOCS} SELECT id, position, CASE WHEN coalesce(position, 0) <= 0 THEN 'unwatched' WHEN duration > 0 AND position / duration >= 0.95 THEN 'finished' ELSE 'in_progress' END AS state FROM docs")
def progress_left_join(spark, d):
    return catalog.with_progress(*videos(spark, d)).select("id", "position", "state")


@query("SELECT c_custkey AS id, c_name AS name, max(ts) AS updated_at FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL ORDER BY updated_at DESC, id LIMIT 30")
def recent_topk(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return catalog.recent(c, _t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("updated_at"))).select("id", "name", "updated_at")


@query(f"WITH {DOCS} SELECT id, duration, position FROM docs WHERE file_size >= 500 AND position >= 200")
def media_floor_filter(spark, d):
    v, p = videos(spark, d)
    return catalog.above_floors(v.join(p, "id", "left"), file_size=500, position=200).select("id", "duration", "position")


@query(f"WITH {DOCS} SELECT id, position FROM docs ")
def sort_media_nulls_last(spark, d):
    v, p = videos(spark, d)
    return v.join(p, "id", "left").orderBy(*catalog.sort_order("position", True)).select("id", "position")


@query("SELECT c_custkey AS id, lower(regexp_replace(c_name, '[0-9]+', '')) || lpad(CAST(length(CAST(CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS VARCHAR)) AS VARCHAR), 8, '0') || CAST(CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS VARCHAR) AS sort_key FROM customer")
def natural_sort_key(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalars.natural_key(F.col("c_name")).alias("sort_key"))


@query("SELECT CASE date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') BETWEEN 2 AND 6 THEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END END AS label, count(*) AS n FROM events GROUP BY 1")
def play_history_days(spark, d):
    return _t(spark, d, "events").groupBy(scalars.day_label(F.to_date("ts"), F.lit("2024-01-20").cast("date")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- loads ---


@query("""WITH o AS (SELECT doc_id, text, source, n_chars, lang FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 > 0),
n AS (SELECT doc_id, text, 'new' AS source, CASE WHEN doc_id % 5 > 0 THEN n_chars + doc_id % 2 + doc_id % 4 END AS n_chars, lang FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.source, o.source) AS source, coalesce(n.n_chars, o.n_chars) AS n_chars,
CASE WHEN o.doc_id IS NOT NULL AND n.doc_id IS NOT NULL AND n.n_chars IS NOT NULL AND n.n_chars IS DISTINCT FROM o.n_chars THEN NULL WHEN o.doc_id IS NULL THEN n.lang ELSE o.lang END AS lang
FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def upsert_merge(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    new = docs.where("doc_id % 3 = 0").withColumn("source", F.lit("new")).withColumn("n_chars", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") + F.col("doc_id") % 2 + F.col("doc_id") % 4))
    return ingest.upsert(docs.where("doc_id % 2 = 0 or doc_id % 3 > 0"), new, "doc_id", keep=[], overwrite=["source"], fill=["n_chars"], reset={"lang": "n_chars"})


SLICES = r"""e AS (SELECT doc_id AS id, 'D:\vid' || (doc_id % 3) || '\' || doc_id || '.mp4' AS path, n_chars AS file_size FROM documents WHERE doc_id % 4 > 0 OR doc_id % 5 = 0),
f AS (SELECT 'd:\VID' || (doc_id % 3) || '\' || doc_id || '.mp4' AS path, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS file_size FROM documents WHERE doc_id % 5 > 0)"""


def slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, d, "documents")
    path = lambda top: F.concat(F.lit(top), (F.col("doc_id") % 3).cast("string"), F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".mp4"))
    e = docs.where("doc_id % 4 > 0 or doc_id % 5 = 0").select(F.col("doc_id").alias("id"), path("D:\\vid").alias("path"), F.col("n_chars").alias("file_size"))
    return e, docs.where("doc_id % 5 > 0").select(path("d:\\VID").alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("file_size"))


@query(f"WITH {SLICES} SELECT coalesce(lower(e.path), lower(f.path)) AS path, e.id, CASE WHEN e.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'removed' WHEN e.file_size IS DISTINCT FROM f.file_size THEN 'changed' ELSE 'kept' END AS change FROM e FULL JOIN f ON lower(e.path) = lower(f.path)")
def scan_diff(spark, d):
    return ingest.scan_diff(*slices(spark, d))


@query(rf"WITH {SLICES} SELECT e.id FROM e WHERE starts_with(lower(e.path), 'd:\vid1\') AND lower(e.path) NOT IN (SELECT lower(path) FROM f) AND (SELECT count(*) FROM e WHERE starts_with(lower(e.path), 'd:\vid1\') AND lower(e.path) NOT IN (SELECT lower(path) FROM f)) <= greatest(100, (SELECT count(*) FROM f))")
def tombstones_guarded(spark, d):
    e, f = slices(spark, d)
    return ingest.tombstones(e, f, "D:\\vid1", ["D:\\vid2\\broken"])


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'in' ELSE 'cur' END AS side, n_chars FROM documents")
def merge_by_id(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return ingest.merge_by_id(docs.where("id % 2 = 0 or id % 3 > 0").withColumn("side", F.lit("cur")), docs.where("id % 3 = 0").withColumn("side", F.lit("in")))


@query("WITH n AS (SELECT md5(text) AS md5, min(doc_id) AS first_seen FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT md5, first_seen FROM n WHERE md5 NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def media_insert_or_ignore(spark, d):
    m = _t(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("md5"), F.col("doc_id").alias("first_seen"))
    return ingest.insert_or_ignore(m.where("first_seen % 2 = 0"), m.where("first_seen % 2 = 1"), "md5", ["first_seen"])


@query("SELECT doc_id AS id FROM documents WHERE NOT (doc_id % 4 > 0 AND doc_id % 9 > 0 AND (CASE WHEN doc_id % 5 > 0 THEN n_chars END) IS NOT DISTINCT FROM (CASE WHEN doc_id % 6 > 0 THEN n_chars END))")
def stale_fingerprints(spark, d):
    when = lambda k, v: F.when(F.col("doc_id") % k > 0, v)
    f = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), when(4, F.lit(1)).alias("phash"), when(9, F.lit(1)).alias("dhash"), when(5, F.col("n_chars")).alias("sig_modified_at"), when(6, F.col("n_chars")).alias("modified_at"))
    return ingest.stale_fingerprints(f).select("id")


# --- similarity ---


def bits(first: int):
    return F.expr(f"aggregate(sequence(0, 31), 0L, (a, i) -> a + if(get(embedding, i + {first}) > 0, shiftleft(1L, i), 0L))")


def sigs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits(0).alias("phash"), bits(32).alias("dhash"))


SIGS = "sigs AS (SELECT vec_id AS id, CAST(sum(CASE WHEN i <= 32 AND embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END) AS BIGINT) AS phash, CAST(sum(CASE WHEN i > 32 AND embedding[i] > 0 THEN 1::BIGINT << (i - 33) ELSE 0 END) AS BIGINT) AS dhash FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY vec_id)"
PAIRS = "pairs AS (SELECT a.id AS a, b.id AS b, CAST(greatest(bit_count(xor(a.phash, b.phash)), bit_count(xor(a.dhash, b.dhash))) AS INTEGER) AS distance FROM sigs a JOIN sigs b ON a.id < b.id WHERE greatest(bit_count(xor(a.phash, b.phash)), bit_count(xor(a.dhash, b.dhash))) <= {})"


@query(f"WITH {SIGS}, {PAIRS.format(9)} SELECT * FROM pairs")
def hamming_pairs(spark, d):
    return similarity.close_pairs(sigs(spark, d), 9, 32)


@query(f"WITH {SIGS}, t AS (SELECT * FROM sigs WHERE id = 7) SELECT s.id, CAST(bit_count(xor(s.phash, t.phash)) + bit_count(xor(s.dhash, t.dhash)) AS INTEGER) AS distance FROM sigs s, t WHERE s.id <> 7 AND bit_count(xor(s.phash, t.phash)) + bit_count(xor(s.dhash, t.dhash)) <= 26")
def template_topk(spark, d):
    return similarity.like_template(sigs(spark, d), 7, 26).orderBy("distance", "id")


@query(f"WITH RECURSIVE {SIGS}, {PAIRS.format(8)}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT a AS id, least(min(b), a) AS pool FROM reach GROUP BY a")
def similar_pools(spark, d):
    return similarity.pools(sigs(spark, d), 8, 32)


@query("SELECT doc_id, md5(text) AS digest, min(doc_id) OVER (PARTITION BY md5(text)) AS keeper_id, doc_id = min(doc_id) OVER (PARTITION BY md5(text)) AS kept FROM documents")
def content_dedup(spark, d):
    """Content addresses: the smallest id of a digest stays."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("grp"))
    return similarity.keepers(docs, []).select(F.col("id").alias("doc_id"), F.col("grp").alias("digest"), "keeper_id", "kept")


@query("SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS extras FROM (SELECT count(*) AS n FROM documents GROUP BY md5(text)) WHERE n > 1")
def group_extras(spark, d):
    return similarity.group_totals(_t(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("grp")))


def _letter_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pixels: how often, of 2000 characters, each letter and each digit occurs, at most 255; n is the text's length. Each text's bytes are counted in one pass."""
    places = np.frombuffer((LOWER + "0123456789").encode(), np.uint8)
    for b in batches:
        grids = []
        for text, n in zip(b.column("text"), b.column("n").to_pylist(), strict=True):
            counts = np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=128)[places] if n else None
            grids.append(np.minimum(255, counts * 2000 // n).astype(np.uint8).tobytes() if n else None)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pool", "id", "created_at")), pa.array(grids, pa.binary())], ["pool", "id", "created_at", "pixels"])


@query()
def greedy_groups(spark, d):
    """Groups by pixels: how often each letter and each digit occurs in the whole text (36 shares, a byte each) stands for a picture's grid, its language and length class for its
    pool. Empty texts have an empty grid, which is like no other."""
    pool = (F.pmod(F.xxhash64("lang"), F.lit(1000)) * 100 + F.floor(F.log2(F.greatest("n_chars", F.lit(1))))).cast("long")
    docs = _t(spark, d, "documents").select(pool.alias("pool"), F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    grids = docs.withColumn("n", F.length("text")).mapInArrow(_letter_shares, "pool long, id long, created_at long, pixels binary")
    return similarity.greedy_groups(grids)


# --- queue: events as downloads ---

DL = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'busy' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'dead' ELSE 'none' END"
T = "CAST(floor(epoch(ts)) AS BIGINT)"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
EV = f"""ev AS (SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN user_id END AS parent, {DL} AS dl, CASE WHEN event_id % 11 = 0 THEN 'forward' ELSE 'image' END AS kind, 'f' || {K} AS name, {T} AS ts,
CASE WHEN {DL} = 'ok' THEN {T} + 90000 END AS ok_at, CASE WHEN {DL} = 'dead' AND event_id % 2 = 0 THEN {T} + 60 END AS dead_at, event_id % 20 AS tries, {T} - 1700 AS prog_at, {T} + (event_id % 50) * 1000 AS next_try,
CASE WHEN event_id % 4 = 0 THEN event_id END AS msg_id, CASE WHEN event_id % 6 = 0 THEN 10 ELSE 0 END AS dl_bytes, CAST(floor(value * 100) AS BIGINT) AS bytes, event_id % 2 AS dedup, CASE WHEN {DL} = 'ok' THEN md5(CAST(event_id AS VARCHAR)) END AS md5 FROM events)"""


def downloads(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    i, t = F.col("event_id"), scalars.epoch(F.col("ts"))
    dl = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "busy").when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "dead").otherwise("none")
    return e.select(
        i.alias("id"), F.when(i % 3 > 0, F.col("user_id")).alias("parent"), dl.alias("dl"), F.when(i % 11 == 0, "forward").otherwise("image").alias("kind"), F.concat(F.lit("f"), F.from_json("props", "k long")["k"].cast("string")).alias("name"), t.alias("ts"),
        F.when(dl == "ok", t + 90000).alias("ok_at"), F.when((dl == "dead") & (i % 2 == 0), t + 60).alias("dead_at"), (i % 20).alias("tries"), (t - 1700).alias("prog_at"), (t + (i % 50) * 1000).alias("next_try"),
        F.when(i % 4 == 0, i).alias("msg_id"), F.when(i % 6 == 0, 10).otherwise(0).alias("dl_bytes"), F.floor(F.col("value") * 100).alias("bytes"), (i % 2).alias("dedup"), F.when(dl == "ok", F.md5(i.cast("string").cast("binary"))).alias("md5"),
    )


@query(f"WITH {EV} SELECT dl, count(*) AS n, count(CASE WHEN dl = 'dead' AND tries < 15 THEN 1 END) AS retryable FROM ev GROUP BY dl")
def dl_stats(spark, d):
    return messages.state_counts(downloads(spark, d))


@query(f"WITH {EV}, x AS (SELECT *, ts >= {MIDNIGHT} OR coalesce(ok_at >= {MIDNIGHT}, false) AS today FROM ev WHERE dl = 'ok') SELECT count(*) AS ok, CAST(sum(bytes) AS BIGINT) AS ok_bytes, count(CASE WHEN today THEN 1 END) AS today, CAST(sum(CASE WHEN today THEN bytes ELSE 0 END) AS BIGINT) AS today_bytes, count(CASE WHEN today AND dedup > 0 THEN 1 END) AS dedup_today FROM x")
def dl_summary(spark, d):
    return messages.summary(downloads(spark, d), MIDNIGHT)


@query(f"WITH {EV}, s AS (SELECT CASE WHEN dl IN ('busy', 'pending') THEN 'downloading' WHEN dl = 'dead' THEN 'dead' WHEN dl = 'none' OR kind = 'forward' THEN 'archived' WHEN dedup > 0 THEN 'dedup' ELSE 'ok' END AS status FROM ev), dom(status) AS (VALUES ('downloading'), ('dead'), ('archived'), ('dedup'), ('ok'), ('lost')) SELECT dom.status, count(s.status) AS n FROM dom LEFT JOIN s ON dom.status = s.status GROUP BY dom.status")
def status_histogram_zero_filled(spark, d):
    return messages.histogram(downloads(spark, d), ["downloading", "dead", "archived", "dedup", "ok", "lost"])


@query(f"WITH {EV} SELECT kind, name, count(*) AS n, arg_max(id, (coalesce(dead_at, -1), -id)) AS id, min(id) AS first_id, max(id) AS last_id FROM ev WHERE dl = 'dead' GROUP BY kind, name HAVING count(*) >= 2")
def collapse_failures(spark, d):
    return messages.collapsed_failures(downloads(spark, d))


@query(f"WITH {EV} SELECT parent, count(*) AS total, count(CASE WHEN dl = 'ok' THEN 1 END) AS done FROM ev WHERE parent IS NOT NULL GROUP BY parent")
def forward_progress(spark, d):
    return messages.forward_progress(downloads(spark, d))


@query(f"""WITH {EV} SELECT id, CASE WHEN dl_bytes > 0 THEN 'pending' WHEN dead_at IS NOT NULL OR {NOW} - prog_at >= 1800 THEN 'dead' ELSE 'pending' END AS new_dl, CASE WHEN dl_bytes > 0 THEN 0 ELSE tries + 1 END AS new_tries,
CAST(CASE WHEN dl_bytes > 0 THEN {NOW + 60} WHEN dead_at IS NOT NULL THEN {NOW + 86400} WHEN {NOW} - prog_at >= 1800 THEN CASE WHEN msg_id IS NULL AND parent IS NULL THEN {NOW + 365 * 86400} ELSE {NOW + 86400} END ELSE {NOW} + least(30 * pow(2, tries), 1800) END AS BIGINT) AS next_try,
CASE WHEN dl_bytes > 0 THEN NULL WHEN dead_at IS NOT NULL THEN dead_at WHEN {NOW} - prog_at >= 1800 THEN {NOW} END AS new_dead_at FROM ev""")
def queue_transition(spark, d):
    return messages.after_failure(downloads(spark, d), NOW).select("id", "new_dl", "new_tries", "next_try", "new_dead_at")


@query(f"WITH {EV} SELECT id, CASE WHEN tries + 1 >= 6 THEN 'dead' ELSE 'error' END AS new_status, CAST({NOW} + least(15 * pow(2, tries), 3600) AS BIGINT) AS next_try FROM ev")
def event_retry(spark, d):
    return messages.event_after_failure(downloads(spark, d), NOW).select("id", "new_status", "next_try")


@query(f"WITH {EV}, w AS (SELECT id, dl FROM ev WHERE dl = 'pending' AND next_try <= {NOW} ORDER BY id LIMIT 30), x AS (SELECT id, dl FROM ev WHERE dl = 'dead' AND next_try <= {NOW} AND tries < 15 AND (msg_id IS NOT NULL OR parent IS NOT NULL) ORDER BY id LIMIT 10) SELECT * FROM (SELECT * FROM w UNION ALL SELECT * FROM x) ORDER BY dl = 'dead', id LIMIT 30")
def backoff_due(spark, d):
    return messages.due(downloads(spark, d), NOW, 30).select("id", "dl")


@query(f"WITH {EV} SELECT id, CASE WHEN dl = 'dead' THEN 'pending' ELSE dl END AS dl, CASE WHEN dl = 'dead' THEN 1 ELSE tries END AS tries, CASE WHEN dl = 'dead' THEN 0 ELSE next_try END AS next_try, CASE WHEN dl <> 'dead' THEN dead_at END AS dead_at FROM ev")
def retry_requeue(spark, d):
    return messages.requeued(downloads(spark, d), NOW).select("id", "dl", "tries", "next_try", "dead_at")


@query(f"WITH {EV}, s AS (SELECT name, arg_min(md5, id) AS md5 FROM ev WHERE dl = 'ok' GROUP BY name) SELECT id, CASE WHEN dl = 'dead' AND s.md5 IS NOT NULL THEN 'ok' ELSE dl END AS dl, CASE WHEN dl = 'dead' AND s.md5 IS NOT NULL THEN s.md5 ELSE ev.md5 END AS md5 FROM ev LEFT JOIN s USING (name)")
def sibling_rescue(spark, d):
    return messages.rescued(downloads(spark, d)).select("id", "dl", "md5")


@query(f"SELECT user_id AS peer, max({T}) AS last_ts FROM events WHERE {T} >= {MIDNIGHT} GROUP BY user_id")
def active_chats(spark, d):
    return messages.active_chats(_t(spark, d, "events").select(F.col("user_id").alias("peer"), scalars.epoch(F.col("ts")).alias("ts")), MIDNIGHT, "peer")


@query(f"WITH {EV} SELECT a.id, 'changed' AS change FROM ev a WHERE a.dl IN ('dead') OR (a.dl = 'busy' AND a.bytes > 500)")
def snapshot_changes(spark, d):
    a = downloads(spark, d)
    b = messages.requeued(a, NOW).withColumn("bytes", F.when((F.col("dl") == "busy") & (F.col("bytes") > 500), F.col("bytes") + 1).otherwise(F.col("bytes")))
    return messages.changed_rows(a, b, ["dl", "bytes"])


@query(f"WITH e AS (SELECT user_id, event_id, event_type <> 'signup' AS known FROM events), r AS (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS run FROM e), s AS (SELECT *, sum(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id DESC) AS k FROM r), x AS (SELECT *, coalesce(sum(CASE WHEN k >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM s) SELECT user_id, event_id, known FROM x WHERE stop = 0")
def backfill_streak(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "signup").alias("known"))
    return messages.known_streak_stop(e, "user_id", F.col("event_id").desc(), 6)


# --- message lists: conversations ---

MSG = """msg AS (SELECT conv_id * 1000000 + turn * 1000 + nth AS id, CASE WHEN turn > 0 THEN conv_id * 1000000 + 1 END AS parent, CASE WHEN turn = 0 THEN 'forward' ELSE 'image' END AS kind,
CASE role WHEN 'user' THEN 'ok' WHEN 'assistant' THEN CASE WHEN turn % 3 = 0 THEN 'busy' ELSE 'none' END ELSE 'dead' END AS dl, turn * 60 + conv_id AS ts, CASE WHEN role = 'user' THEN 1000 + length(text) END AS ok_at, CASE WHEN role = 'system' THEN length(text) END AS dead_at
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS nth FROM conversations))"""
ORDER = "SELECT id, coalesce(parent, id) AS grp, max(CASE WHEN dl = 'busy' THEN 1 ELSE 0 END) OVER g AS hot, max(ok_at) OVER g AS done_at FROM x WHERE {} WINDOW g AS (PARTITION BY coalesce(parent, id))"


def archive(spark: SparkSession, d: str) -> DataFrame:
    """All utterances: those of a turn are numbered."""
    c = _t(spark, d, "conversations").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    base, turn, n = F.col("conv_id") * 1_000_000, F.col("turn"), F.char_length("text").cast("long")
    dl = F.when(F.col("role") == "user", "ok").when(F.col("role") == "assistant", F.when(turn % 3 == 0, "busy").otherwise("none")).otherwise("dead")
    return c.select((base + turn * 1000 + F.col("nth")).alias("id"), F.when(turn > 0, base + 1).alias("parent"), F.when(turn == 0, "forward").otherwise("image").alias("kind"), dl.alias("dl"), (turn * 60 + F.col("conv_id")).alias("ts"), F.when(F.col("role") == "user", 1000 + n).alias("ok_at"), F.when(F.col("role") == "system", n).alias("dead_at"))


@query(f"WITH {MSG}, x AS (SELECT m.* FROM msg m LEFT JOIN msg p ON m.parent = p.id WHERE (coalesce(p.ts, m.ts) >= 1200 OR m.ok_at >= 1200 OR m.dead_at >= 1200 OR m.dl IN ('busy', 'pending') OR p.dl = 'busy') AND m.kind <> 'forward') SELECT * FROM ({ORDER.format('true')})")
def today_list(spark, d):
    m = messages.today_list(archive(spark, d), 1200)
    return m.orderBy(*messages.list_order()).select("id", "grp", F.col("hot"), "done_at")


@query(f"WITH {MSG}, x AS (SELECT * FROM msg ORDER BY coalesce(parent, id) DESC, id LIMIT 200) SELECT * FROM ({ORDER.format('true')}) WHERE id IN (SELECT id FROM msg WHERE kind <> 'forward')")
def history_list(spark, d):
    return messages.history(archive(spark, d), 200).orderBy(*messages.list_order()).select("id", "grp", "hot", "done_at")


@query("SELECT conv_id, arg_max(text, (turn, text)) FILTER (WHERE role = 'user' AND text IS NOT NULL) AS last_user, max(turn) FILTER (WHERE role = 'assistant') AS last_reply FROM conversations GROUP BY conv_id")
def log_fold(spark, d):
    """The last of each kind; of several in one turn the greatest text."""
    c = _t(spark, d, "conversations")
    return folds.latest(c, "conv_id", F.struct("turn", "text"), {"last_user": F.when(F.col("role") == "user", F.col("text")), "last_reply": F.when(F.col("role") == "assistant", F.col("turn"))})


# --- text ---


@query(r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'eau'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'ment'))) > 0")
def fts_prefix(spark, d):
    return _t(spark, d, "documents").where(search.prefix_match([F.col("text")], "Eau MENT")).select("doc_id")


@query("SELECT conv_id * 1000 + turn AS id, turn AS ts, text FROM conversations WHERE contains(lower(text), 'ern') ORDER BY ts DESC, id DESC, text LIMIT 50")
def fts_substring(spark, d):
    c = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("ts"), "text")
    return search.search_messages(c, "ERN")


LINKS = r"raw AS (SELECT page_id AS id, unnest(regexp_extract_all('see ' || url || ', or <' || url || '>. ' || html, 'https?://[A-Za-z0-9\-._~:/?#@!$&*+,;=%()\[\]]+')) AS raw FROM pages), links AS (SELECT id, rtrim(replace(raw, '&amp;', '&'), '.,;:!?)') AS link FROM raw)"


@query(f"WITH {LINKS} SELECT lower(link) AS link_key, min(id) AS first_id, count(*) AS n FROM links GROUP BY 1")
def link_registry(spark, d):
    t = _t(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("see "), "url", F.lit(", or <"), "url", F.lit(">. "), "html").alias("text"))
    return search.link_registry(t).select("link_key", "first_id", "n")


# --- folds over time ---

EVENT_T = f"e AS (SELECT user_id AS key, {T} AS t, event_type FROM events)"


def timed(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("user_id").alias("key"), scalars.epoch(F.col("ts")).alias("t"), "event_type", "value")


@query(f"WITH {EVENT_T}, s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) < 14400 THEN 0 ELSE 1 END AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t) AS run FROM s) SELECT key, min(t) AS first_t, max(t) AS last_t, count(*) AS n, max(t) + 14400 AS fires_at FROM r GROUP BY key, run")
def debounce_sessions(spark, d):
    return folds.sessions(timed(spark, d), 14400)


@query(f"WITH RECURSIVE {EVENT_T}, x AS (SELECT key, t FROM e WHERE event_type = 'error'), m(key, t) AS (SELECT key, min(t) FROM x GROUP BY key UNION ALL SELECT key, t FROM (SELECT m.key, (SELECT min(x.t) FROM x WHERE x.key = m.key AND x.t >= m.t + 86400) AS t FROM m) WHERE t IS NOT NULL) SELECT key, t FROM m")
def cooldown_alerts(spark, d):
    return folds.cooled(timed(spark, d).where("event_type = 'error'"), 86400)


@query()
def speed_windows(spark, d):
    e = timed(spark, d)
    w = Window.partitionBy("key").orderBy("t", "value").rowsBetween(Window.unboundedPreceding, 0)
    s = e.select("key", "t", (F.col("event_type") != "signup").alias("busy"), F.floor(F.sum("value").over(w) * 1000).alias("bytes"))
    return folds.rates(s)


# --- star joins over the other tables ---


@query("SELECT n_name, r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name, r_name")
def star_agg(spark, d):
    l = _t(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))  # noqa: E741
    by = l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    s = by.join(_t(spark, d, "supplier"), by.l_suppkey == F.col("s_suppkey")).join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy("n_name", "r_name").agg(F.sum("n").alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"))

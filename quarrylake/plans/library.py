"""Queries of changes to catalogs, of files on a disk and of composed detection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutations, queue, similarity
from .queries import DOCS, FILES, SIGS, _t, files, query, sigs, videos


@query(f"WITH {DOCS}, u AS (SELECT d.id, (d.id % 11) * 2.0 AS position, d.id % 13 AS w FROM docs d WHERE d.id % 3 = 0 AND d.id % 7 > 0), p AS (SELECT id AS video_id, position, 5 AS w FROM docs WHERE position IS NOT NULL), b AS (SELECT video_id, position, w, 0 AS side FROM p UNION ALL SELECT id, position, w, 1 FROM u) SELECT video_id, arg_max(position, (w, side)) AS position, max(w) AS updated_at FROM b GROUP BY video_id")
def progress_upsert(spark, d):
    v, p = videos(spark, d)
    old = p.where("position is not null").select(F.col("id").alias("video_id"), "position", F.lit(5).cast("long").alias("updated_at"))
    i = F.col("id")
    new = v.where("id % 3 = 0").select(i.alias("video_id"), F.when(i % 7 > 0, (i % 11) * 2.0).otherwise(float("nan")).alias("position"), (i % 13).alias("updated_at"))
    stray = spark.createDataFrame([(-1, 1.0, 1)], "video_id long, position double, updated_at long")
    return mutations.saved_progress(old, new.unionAll(stray), v)


@query("SELECT 'k' || k AS key, CASE WHEN k % 2 = 0 THEN 'v' || (k + 60) ELSE 'old' END AS value FROM unnest(range(20)) AS u(k)")
def settings_upsert(spark, d):
    n = spark.range(20)
    key = F.concat(F.lit("k"), (F.col("id") % 20).cast("string")).alias("key")
    new = spark.range(80).where("id % 2 = 0").select(key, F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), F.col("id").alias("nth"))
    return mutations.saved_settings(n.select(key, F.lit("old").alias("value")), new)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN doc_id * 2 ELSE doc_id END AS anchor, CASE WHEN doc_id % 4 > 0 THEN doc_id END AS mid, CASE WHEN doc_id % 4 > 0 AND doc_id % 6 > 0 THEN doc_id END AS tail FROM documents")
def anchor_write_back(spark, d):
    """New anchors make the frames that were taken after them void; another pass clears by ids."""
    v = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("anchor"), F.col("doc_id").alias("mid"), F.col("doc_id").alias("tail"))
    new = v.where("id % 4 = 0").select("id", (F.col("id") * 2).alias("anchor"))
    return mutations.cleared(mutations.updated(v, new, "id", ["anchor"], ["mid", "tail"]), v.where("id % 6 = 0"), ["tail"])


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 3 > 0) AS n_videos, (SELECT count(*) FROM labels WHERE doc_id % 3 > 0) AS n_progress")
def cascade_delete(spark, d):
    v, p = _t(spark, d, "documents").select(F.col("doc_id").alias("id")), _t(spark, d, "labels").select(F.col("doc_id").alias("video_id"))
    left, kept = mutations.deleted_with_progress(v, p, v.where("id % 3 = 0"))
    return left.agg(F.count(F.lit(1)).alias("n_videos")).join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("n_progress"))))


@query("SELECT path FROM (SELECT doc_id, 'D:\\cache\\' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.tmp' ELSE '.mp4' END AS path FROM documents) WHERE doc_id % 9 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def orphan_files(spark, d):
    docs, i = _t(spark, d, "documents"), F.col("doc_id")
    found = docs.select(F.concat(F.lit("D:\\cache\\"), i.cast("string"), F.when(i % 9 == 0, ".tmp").otherwise(".mp4")).alias("path"))
    return mutations.orphans(found, _t(spark, d, "labels").select(i.alias("id")), docs.where("doc_id % 2 = 0").select(i.alias("id")))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 5 > 0 AND doc_id % 7 = 0")
def gone_from_disk(spark, d):
    """Every seventh file is gone; every fifth folder could not be read."""
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").select(i.alias("id"), F.concat(F.lit("D:\\v"), (i % 5).cast("string"), F.lit("\\F"), i.cast("string"), F.lit(".mp4")).alias("path"))
    disk = rows.where("id % 7 > 0").select(F.lower("path").alias("path"))
    readable = spark.createDataFrame([(f"D:\\v{k}",) for k in range(1, 5)], "dir string")
    return mutations.gone_from_disk(rows, disk, readable).select("id")


@query("SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents")
def known_split(spark, d):
    return mutations.with_presence(_t(spark, d, "documents").select(F.col("doc_id").alias("id")), _t(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT known, count(*) AS n FROM (SELECT doc_id IN (SELECT doc_id FROM labels) AS known FROM documents) GROUP BY known")
def outcome_counts(spark, d):
    return mutations.outcome_counts(known_split(spark, d), "known")


@query("SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.source IS NULL THEN 'removed' ELSE 'added' END AS change FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0) b ON a.source = b.source WHERE a.source IS NULL OR b.source IS NULL")
def watch_changes(spark, d):
    docs = _t(spark, d, "documents")
    return mutations.set_changes(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), "source")


@query(f"WITH {FILES}, r AS (SELECT DISTINCT regexp_replace(path, '[^/]*$', '') AS root FROM files) SELECT root FROM r WHERE starts_with(lower(root), 'https:/')")
def roots_to_forget(spark, d):
    roots = files(spark, d).select(F.regexp_replace("path", r"[^/]*$", "").alias("root")).distinct()
    return mutations.roots_to_forget(roots, "HTTPS:/")


@query(f"WITH {FILES}, r AS (SELECT id, regexp_replace(path, '[^/]*$', '') AS root, rtrim(lower(replace(regexp_replace(path, '[^/]*$', ''), '/', '\\')), '\\') AS dir_key FROM files) SELECT dir_key, arg_min(root, id) AS root, min(id) AS id FROM r GROUP BY dir_key")
def roots_dedupe(spark, d):
    """Folders that differ in case or a closing separator only are one, the first stays."""
    return mutations.deduped_roots(files(spark, d).select("id", F.regexp_replace("path", r"[^/]*$", "").alias("root")), "id")


@query(f"WITH {FILES} SELECT id, count(*) OVER (PARTITION BY lower(path)) > 1 AS taken FROM files")
def path_taken(spark, d):
    f = files(spark, d).select("id", "path")
    return mutations.taken(f, f).select("id", "taken")


@query(r"""WITH RECURSIVE w AS (SELECT id, k, path, row_number() OVER (ORDER BY id) AS pos FROM (SELECT c_custkey AS id, c_custkey % 20 AS k, 'D:\F' || c_custkey % 20 || CASE WHEN c_custkey % 7 = 0 THEN ' (' || 2 + c_custkey % 5 || ')' WHEN c_custkey % 11 = 0 THEN ' (2) (2)' ELSE '' END || '.jpg' AS path FROM customer)),
g(pos, used, id, free_path) AS (SELECT 0::BIGINT, list_concat(['d:\f' || x || '.jpg' FOR x IN range(0, 20, 2)], ['d:\f' || x || ' (3).jpg' FOR x IN range(0, 20, 2)]), NULL::BIGINT, NULL::VARCHAR
 UNION ALL SELECT w.pos, CASE WHEN f.p IS NULL THEN g.used ELSE list_append(g.used, lower(f.p)) END, w.id, f.p FROM g JOIN w ON w.pos = g.pos + 1, LATERAL (SELECT [c FOR c IN [CASE WHEN n = 1 THEN w.path ELSE left(w.path, len(w.path) - 4) || ' (' || n || ').jpg' END FOR n IN range(1, 1000)] IF NOT list_contains(g.used, lower(c))][1] AS p) f)
SELECT id, free_path FROM g WHERE id IS NOT NULL""")
def free_paths(spark, d):
    """Many rows that want twenty names or numbers of them, of which some are taken."""
    i = F.col("c_custkey")
    number = F.when(i % 7 == 0, F.concat(F.lit(" ("), (i % 5 + 2).cast("string"), F.lit(")"))).when(i % 11 == 0, " (2) (2)").otherwise("")
    wanted = _t(spark, d, "customer").select(i.alias("id"), F.concat(F.lit("D:\\F"), (i % 20).cast("string"), number, F.lit(".jpg")).alias("path"))
    have = spark.range(20).where("id % 2 = 0").select(F.explode(F.array(F.lit(".jpg"), F.lit(" (3).JPG"))).alias("e"), F.col("id").cast("string").alias("k")).select(F.concat(F.lit("d:/f"), "k", "e").alias("path"))
    return mutations.free_paths(wanted, have).select("id", "free_path")


@query("SELECT doc_id AS id FROM documents WHERE CASE doc_id % 4 WHEN 0 THEN doc_id % 3 = 0 WHEN 1 THEN TRUE WHEN 2 THEN doc_id % 6 <= 3 ELSE FALSE END")
def short_videos(spark, d):
    i = F.col("doc_id")
    v = _t(spark, d, "documents").select(i.alias("id"), F.when(i % 4 == 1, 0.5).when(i % 4 == 2, 5.0).when(i % 4 == 3, 5.5).alias("duration"), (i % 6).alias("frames"), F.when(i % 3 == 0, "png").alias("image_kind"))
    return mutations.short_videos(v).select("id")


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' AND (n_chars IS NULL OR n_chars <= 3000)")
def equal_and_at_most(spark, d):
    v = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").cast("double").alias("duration"))
    return mutations.at_most(mutations.having(v, lang="en"), 3000.0).select("id")


@query(f"WITH {FILES} SELECT id, CASE WHEN rtrim(lower(regexp_replace(replace(path, '/', '\\'), '\\\\[^\\\\]*$', '')), '\\') IN ('http:\\', 'https:\\\\m.ththth.example.net') THEN 'E:\\all\\' || filename ELSE path END AS path FROM files")
def video_repoint(spark, d):
    return mutations.repointed(files(spark, d).select("id", "path"), ["https://m.ththth.example.net/"], "E:\\all\\")


@query("SELECT array_to_string((SELECT list('dir ' || doc_id ORDER BY doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3)), ',') AS named, count(*) - 3 AS more FROM documents")
def walk_warnings(spark, d):
    w = _t(spark, d, "documents").withColumn("nth", F.col("doc_id"))
    return mutations.capped_warnings(w.select("nth", F.concat(F.lit("dir "), F.col("nth").cast("string")).alias("message")), "nth").select(F.array_join("named", ",").alias("named"), "more")


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN doc_id % 3 > 0 THEN n_chars ELSE 0 END) AS DOUBLE) AS duration, CAST(sum(n_chars) AS BIGINT) AS file_size FROM documents WHERE lang = 'de'")
def view_totals(spark, d):
    v = _t(spark, d, "documents").where("lang = 'de'").select(F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).cast("double").alias("duration"), F.col("n_chars").alias("file_size"))
    return mutations.seen_totals(v)


@query("SELECT count(*) AS n, TRUE AS known FROM (SELECT 1)")
def seeded_pick(spark, d):
    """One row, and the same one in any order of the rows."""
    v = _t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    a, b = mutations.pick(v, v.where("id % 2 = 0"), 3), mutations.pick(v.repartition(3), v.where("id % 2 = 0"), 3)
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.col("id") % 2 == 1), F.lit(False)).alias("known"))


@query("SELECT md5, first_seen FROM (SELECT md5(text) AS md5, max(doc_id) AS first_seen FROM documents GROUP BY 1) WHERE starts_with(md5, 'a') ORDER BY first_seen DESC, md5 LIMIT 20")
def md5_prefix_topk(spark, d):
    m = _t(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("md5")).agg(F.max("doc_id").alias("first_seen"))
    return mutations.by_prefix(m, " A")


# --- groups ---

GROUPS = "g AS (SELECT md5(text) AS grp, doc_id AS id, source AS filename, lang AS path FROM documents)"


def groups(spark, d):
    return _t(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("grp"), F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("lang").alias("path"), F.col("doc_id").alias("created_at"))


@query(f"WITH {GROUPS} SELECT grp, count(*) AS n, min(id) AS keeper_id FROM g GROUP BY grp HAVING count(*) > 1")
def groups_by_size(spark, d):
    return similarity.sized(groups(spark, d))


@query(f"WITH {GROUPS}, l AS (SELECT * FROM g WHERE id % 3 > 0) SELECT grp, id FROM l WHERE grp IN (SELECT grp FROM l GROUP BY grp HAVING count(*) > 1)")
def live_groups(spark, d):
    g = groups(spark, d)
    return similarity.live_groups(g, g.where("id % 3 > 0")).select("grp", "id")


@query(f"WITH {GROUPS} SELECT grp, id FROM g WHERE grp IN (SELECT grp FROM g WHERE contains(lower(filename), '1') OR contains(lower(path), '1'))")
def groups_with_text(spark, d):
    return similarity.groups_with(groups(spark, d), " 1 ").select("grp", "id")


@query(f"WITH {GROUPS} SELECT count(*) AS n FROM g WHERE id IN (SELECT doc_id FROM labels)")
def selected_in_groups(spark, d):
    return queue.selected_in_groups(groups(spark, d), _t(spark, d, "labels").select(F.col("doc_id").alias("id")))


CLOSE = "greatest(bit_count(xor({0}.phash, {1}.phash)), bit_count(xor({0}.dhash, {1}.dhash)))"


@query(f"WITH RECURSIVE {SIGS}, pairs AS (SELECT a.id AS a, b.id AS b FROM sigs a JOIN sigs b ON a.id < b.id WHERE {CLOSE.format('a', 'b')} <= 8), e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), p AS (SELECT a AS id, least(min(b), a) AS pool FROM reach GROUP BY a) SELECT id, pool, max(id) OVER (PARTITION BY pool) AS keeper_id, id = max(id) OVER (PARTITION BY pool) AS kept FROM p")
def image_duplicates_fast(spark, d):
    """Pools by hashes; the youngest id is the oldest picture."""
    return similarity.fast_duplicates(sigs(spark, d).withColumn("created_at", -F.col("id")), 8, 32)


@query()
def image_duplicates_verified(spark, d):
    """Pools by hashes, groups by pixels: an embedding's 64 signs and sizes stand for the grid."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("created_at"), F.expr("unhex(array_join(transform(embedding, x -> lpad(hex(cast(least(255, greatest(0, x * 5 + 128)) as int)), 2, '0')), ''))").alias("pixels"))
    return similarity.verified_duplicates(sigs(spark, d).join(e, "id"), 8, 32)


@query()
def video_duplicates(spark, d):
    """Three frames of each video: the hashes, and what single bits of the id make of them."""
    s, i = sigs(spark, d), F.col("id")
    flip = lambda c, k: c.bitwiseXOR(F.when(i % 3 == k, F.lit(3)).otherwise(0).cast("long"))
    v = s.select("id", (-i).alias("created_at"), *[flip(F.col(h), k).alias(f"{n}_{h[0]}") for k, n in enumerate(("anchor", "mid", "tail")) for h in ("phash", "dhash")])
    return similarity.frame_groups(v, 9, 32)

"""Operators without SQL, and cases that the driver's tables lack."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from quarrylake.functions import image_hash, paths, scalars
from quarrylake.operators import catalog, ingest, search, similarity
from quarrylake.sources import files
from quarrylake.streaming import folds


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_prefix_boundary_and_case(spark):
    rows = [("i1", "C:\\pics\\a.png", 100), ("i2", "C:\\pics\\sub\\b%percent.jpg", 100), ("i3", "C:\\pics\\sub\\c_my.jpg", 100), ("i4", "C:\\other\\d.png", 100), ("i5", "C:/PICS/e.png", 100), ("i6", "C:\\pics2\\f.png", 1)]
    f = spark.createDataFrame(rows, "id string, path string, file_size long").withColumn("filename", paths.basename(F.col("path")))
    assert catalog.totals(catalog.matching(f, "c:/pics")).first() == (4, 400)
    assert values(catalog.matching(f, "C:\\pics\\", " % ").select("id")) == [("i2",)]
    assert values(catalog.matching(f, search="_MY").select("id")) == [("i3",)]
    assert catalog.matching(f, scope=[]).count() == 6 and catalog.matching(f, "C:\\other", scope=["C:\\pics"]).count() == 0
    assert values(catalog.dir_stats(f)) == sorted([("C:\\PICS", 1), ("C:\\other", 1), ("C:\\pics", 1), ("C:\\pics\\sub", 2), ("C:\\pics2", 1)], key=str)
    tree = {r.path: r.item_count for r in catalog.tree_rollup(f).collect()}
    assert tree["C:"] == 6 and tree["C:\\pics"] == 3


def test_bulk_deletes_are_guarded(spark):
    e = spark.createDataFrame([(str(i), f"D:\\v\\{i}.mp4") for i in range(150)], "id string, path string")
    few, many = e.limit(3).select("path"), spark.createDataFrame([(f"d:\\V\\{i}.mp4",) for i in range(148)], "path string")
    assert ingest.tombstones(e, few, "D:\\v", []).count() == 0
    assert values(ingest.tombstones(e, many, "D:\\v", [])) == [("148",), ("149",)]
    assert ingest.tombstones(e, many, "D:\\v", ["D:\\v"]).count() == 0
    assert ingest.tombstones(e, many, "D:\\v", ["x"] * 21).count() == 0


def test_accents_and_prefixes(spark):
    f = spark.createDataFrame([("Café noir.mkv", "D:\\Ghibli 宫崎骏作品\\x"), ("plain.mkv", "D:\\a")], "filename string, path string")
    assert search.search_files(f, "cafe no").count() == 1 and search.search_files(f, "宫崎 CAF").count() == 1 and search.search_files(f, "崎骏").count() == 0
    assert search.search_files(f, 'pl"').count() == 0 and search.search_files(f, "").count() == 2


def planted(n=300, seed=3):
    r = np.random.default_rng(seed)
    rows = [(int(x), int(y)) for x, y in r.integers(-(1 << 63), (1 << 63) - 1, (n, 2))]
    for _ in range(n // 3):
        p, d = rows[int(r.integers(len(rows)))]
        for b in r.choice(64, int(r.integers(0, 6)), replace=False):
            p ^= 1 << int(b) if b < 63 else -(1 << 63)
        rows.append((p, d))
    return [(i, p, d) for i, (p, d) in enumerate([*rows, rows[0], rows[0], (None, 1)])]


def test_banded_join_is_lossless(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "id long, phash long, dhash long")
    count = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {(a[0], b[0]) for a, b in itertools.combinations([r for r in rows if r[1] is not None], 2) if max(count(a[1], b[1]), count(a[2], b[2])) <= 7}
    got = similarity.close_pairs(df)
    assert {(r.a, r.b) for r in got.collect()} == want
    parent = {i: i for i, _, _ in rows}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in want:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    member = {i for p in want for i in p}
    assert values(similarity.pools(df)) == sorted(((i, find(i)) for i in member), key=str)


def test_greedy_groups_are_not_transitive(spark):
    g = lambda v: bytes([v] * 1024)
    rows = [(1, 1, "1", g(100)), (1, 2, "2", g(102)), (1, 3, "3", g(104)), (2, 4, "1", g(100)), (2, 5, "2", g(101)), (2, 6, "3", g(140)), (2, 7, "4", g(141)), (3, 8, "1", b"")]
    assert values(similarity.greedy_groups(spark.createDataFrame(rows, "pool long, id long, created_at string, pixels binary"))) == [(1, 1, 1), (2, 1, 1), (4, 2, 4), (5, 2, 4), (6, 2, 6), (7, 2, 6)]


def test_image_hashes(spark):
    r = np.random.default_rng(1)
    grids = r.integers(0, 256, (5, 32, 32)).astype(np.uint8)
    df = spark.createDataFrame([(i, g.tobytes()) for i, g in enumerate(grids)] + [(5, b"xx"), (6, None)], "id int, px binary")
    got = {x.id: (x.p, x.d) for x in df.select("id", image_hash.phash("px").alias("p"), image_hash.dhash("px").alias("d")).collect()}
    assert got[5] == got[6] == (None, None)
    for i, g in enumerate(grids):
        f = [[sum(g[y, x] * np.cos((2 * y + 1) * v * np.pi / 64) * np.cos((2 * x + 1) * u * np.pi / 64) for y in range(32) for x in range(32)) * 0.5 * (0.5**0.5 if u == 0 else 1) for u in range(8)] for v in range(8)]
        low = [f[v][u] for v in range(8) for u in range(8) if (u, v) != (0, 0)]
        p = int("".join("1" if x > sum(low) / 63 else "0" for x in low), 2)
        d = int("".join("1" if g[v * 31 // 8, u * 31 // 8] < g[v * 31 // 8, (u + 1) * 31 // 8] else "0" for v in range(8) for u in range(8)), 2)
        assert got[i] == (p, d - (1 << 64) if d >> 63 else d)


def test_magic_bytes(spark):
    rows = [("jpg", b"\xff\xd8\xff\xe0"), ("png", b"\x89PNG\r\n\x1a\n"), ("gif", b"GIF89a.."), ("webp", b"RIFF1234WEBP"), ("bmp", b"BM" + b"0" * 30), (None, b"BM"), ("avif", b"1234ftypavif"), (None, b"")]
    assert all(r.want == r.kind for r in spark.createDataFrame(rows, "want string, c binary").select("want", scalars.image_kind(F.col("c")).alias("kind")).collect())


def test_titles_links_and_sizes(spark):
    df = spark.createDataFrame([("Film 1:02:03 cut",), ("12:99:00",)], "t string").select(scalars.time_in_title(F.col("t")))
    assert [r[0] for r in df.collect()] == [3723, None]
    t = spark.createDataFrame([(1, "a https://x.org/A?b=1&amp;c=2). 看https://x.org/a，"), (2, "https://X.org/a!")], "id long, text string")
    assert {(r.link_key, r.first_id, r.n) for r in search.link_registry(t).collect()} == {("https://x.org/a?b=1&c=2", 1, 1), ("https://x.org/a", 1, 2)}


def test_cooldown_in_batch_and_stream(spark, tmp_path):
    rows = [(k, t) for k in (1, 2) for t in (0, 10, 1799, 1800, 3000, 3700)]
    df = spark.createDataFrame(rows, "key long, t long")
    want = [(k, t) for k in (1, 2) for t in (0, 1800, 3700)]
    assert values(folds.cooled(df, 1800)) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = folds.cooled_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 1800)
    q = stream.writeStream.format("memory").queryName("cooled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert values(spark.table("cooled")) == want


def test_rates(spark):
    rows = [(1, 0, True, 0), (1, 3, True, 3000), (1, 10, True, 10_000), (1, 12, True, 11_000), (1, 30, True, 11_000), (1, 31, False, 11_000)]
    got = [r.rate for r in folds.rates(spark.createDataFrame(rows, "key long, t long, busy boolean, bytes long")).orderBy("t").collect()]
    assert got == [0.0, 1000.0, 1000.0, 500.0, 0.0, 0.0]


def test_walk(spark, tmp_path):
    for name in ("a.MP4", "sub/b.mkv", "sub/c.txt", "$Recycle.Bin/d.mp4"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"xy")
    got = files.walk(spark, str(tmp_path), paths.VIDEO_EXTENSIONS)
    assert sorted(r.filename for r in got.collect()) == ["a.MP4", "b.mkv"] and got.first().file_size == 2

"""Operators that SQL does not express, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.functions import display, scalars
from quarrylake.operators import events, logs, mutations, queue, registry, search, similarity
from quarrylake.plans import chat, library, queries
from quarrylake.registry import QUERIES
from quarrylake.streaming import folds

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def naive_groups(items, close):
    """Greedy leaders over items in order; id -> leader, for groups of two and more."""
    left, out = list(items), {}
    while left:
        lead, *left = left
        mine = [x for x in left if close(lead, x)]
        if mine:
            out |= {x["id"]: lead["id"] for x in [lead, *mine]}
        left = [x for x in left if x not in mine]
    return out


def test_greedy_groups_of_documents(spark):
    made = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        t = (r.text or "").lower()
        grid = bytes(min(255, t.count(c) * 2000 // len(t)) for c in queries.LOWER + "0123456789") if t else None
        made.append({"id": r.doc_id, "pixels": grid, "pool": (r.lang, int(np.log2(max(r.n_chars, 1))))})
    want = {}
    for p in {x["pool"] for x in made}:
        want |= naive_groups(sorted((x for x in made if x["pool"] == p), key=lambda x: x["id"]), lambda a, b: similarity.pixels_close(a["pixels"], b["pixels"]))
    got = {r.id: r.leader for r in QUERIES["greedy_groups"](spark, SF).collect()}
    assert got == want and got


def frames(r, n=60):
    base = [r.getrandbits(32) for _ in range(8)]
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(32), r.randint(0, k)))
    return [{"id": i, "created_at": r.randint(0, 9), **{f"{s}_{h}": flip(base[i % 8 if s == "anchor" else (i // 2) % 3], 5) for s in ("anchor", "mid", "tail") for h in "pd"}} for i in range(n)]


def test_video_groups(spark):
    gap = lambda a, b, s: max(bin(a[f"{s}_{h}"] ^ b[f"{s}_{h}"]).count("1") for h in "pd")
    for seed in range(2):
        made = frames(random.Random(seed))
        want = naive_groups(sorted(made, key=lambda x: (x["created_at"], x["id"])), lambda a, b: all(gap(a, b, s) <= 6 for s in ("anchor", "mid", "tail")))
        got = {r.id: r.leader for r in similarity.frame_groups(spark.createDataFrame([{k: int(v) for k, v in x.items()} for x in made]), 6, 32).collect()}
        assert got == want and got


def test_verified_duplicates(spark):
    sig = {r.id: r for r in queries.sigs(spark, SF).collect()}
    grid = {r.vec_id: bytes(int(min(255, max(0, x * 5 + 128))) for x in np.array(r.embedding, np.float32).tolist()) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    pool = {r.id: r.pool for r in similarity.pools(queries.sigs(spark, SF), 8, 32).collect()}
    want = {}
    for p in set(pool.values()):
        want |= naive_groups([{"id": i} for i in sorted(pool) if pool[i] == p], lambda a, b: similarity.pixels_close(grid[a["id"]], grid[b["id"]]))
    assert {r.id: r.leader for r in QUERIES["image_duplicates_verified"](spark, SF).collect()} == want and set(pool) <= set(sig)


def test_rates_against_plain_python(spark):
    r, samples, want = random.Random(2), [], []
    for key in range(4):
        t, n, w = 0, 0, None
        for _ in range(60):
            t, busy = t + r.randint(1, 6), r.random() > 0.1
            n = 0 if r.random() < 0.05 else n + r.choice([0, 0, 3, 5000])
            samples.append((key, t, busy, n))
            speed = 0.0
            if not busy:
                w = None
            elif w is None or n < w["last"]:
                w = {"t0": t, "b0": n, "last": n, "adv": t, "speed": 0.0}
            else:
                w["adv"] = t if n > w["last"] else w["adv"]
                w["last"], span = n, t - w["t0"]
                if span >= 8:
                    w["speed"], w["t0"], w["b0"] = (n - w["b0"]) / span, t, n
                elif span >= 2 and n > w["b0"]:
                    w["speed"] = (n - w["b0"]) / span
            if w and t - w["adv"] <= 15 and w["speed"] >= 1:
                speed = w["speed"]
            want.append((key, t, speed))
    assert rows(folds.rates(spark.createDataFrame(samples, "key long, t long, busy boolean, bytes long"))) == sorted(want)


def test_backed_off(spark):
    r = random.Random(4)
    tries = sorted((k, t, r.random() < 0.7) for k in range(3) for t in r.sample(range(3000), 80))
    want = []
    for k in range(3):
        last, fails = 0, 0
        for _, t, failed in (x for x in tries if x[0] == k):
            if fails and t - last < min(30 * fails, 600):
                continue
            last, fails = t, fails + 1 if failed else 0
            want.append((k, t, failed))
    assert rows(queue.backed_off(spark.createDataFrame(tries, "key long, t long, failed boolean"))) == want


def test_numbers_go_on_where_one_key_is_a_third(spark):
    df = spark.createDataFrame([(1 if i % 3 == 0 else i,) for i in range(300)], "id long")
    got = queue.numbered_from(df, spark.createDataFrame([(41,)], "seq long"), ["id"]).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(42, 342)) and [r.id for r in got] == sorted(r.id for r in got)


def test_prefix_phrases_and_accents(spark):
    df = spark.createDataFrame([(1, "foo plain.mkv"), (2, "a Foo-Bar.mkv"), (3, "Tiếng Việt.mkv"), (4, "foobar")], "id int, name string")
    hit = lambda term: [r.id for r in df.where(search.prefix_match([df.name], term)).orderBy("id").collect()]
    assert hit("foo-bar") == [2] and hit("tieng") == [3] and hit("FOO") == [1, 2, 4] and hit("ối") == []
    assert search.prefix_match([df.name], ' "x" ') is None and search.prefix_match([df.name], "  ") is None


def test_natural_key_of_long_numbers(spark):
    names = ["IMG 20240115123045678", "IMG 20240115123045999", "img 9", "img 10", "img 007"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(scalars.natural_key(F.col("n")))
    assert [r.n for r in got.collect()] == ["img 007", "img 9", "img 10", names[0], names[1]]


def test_log_stage_keeps_the_last_error(spark):
    at = "01-15 10:00:0%d [x] "
    lines = [(1, 0, at % 0 + logs.LOGIN_ERROR), (1, 1, at % 1 + logs.QR_SAVED + " D:\\q.png"), (2, 0, at % 0 + logs.READY), (2, 1, at % 1 + logs.LOGIN_ERROR), (3, 0, "no time"), (4, 0, at % 2 + "hello there")]
    got = {r.log: r for r in logs.log_stages(spark.createDataFrame(lines, "log int, id long, line string"), "log").collect()}
    assert got[1].login_error is None and got[1].qr == "D:\\q.png" and got[2].login_error and got[2].ready and got[3].stamp is None and got[4].stamp == "01-15 10:00:02"


def test_links_and_entities(spark):
    raw = ["https://a.b/?x=1&amp;y=2)。", "https://a.b/&#x41;&#66;&lt;\"'"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(scalars.normal_url(F.col("x"))).collect()]
    assert got == ["https://a.b/?x=1&y=2", "https://a.b/AB<"]
    assert registry.resolved_headers(["No", "网址链接", "序号(新)", "标题/描述"]) == {"seq": 2, "link": 1, "title": 3}
    text = [(1, "private", 5, "ann", 0, "magnet:?xt=urn:btih:0Ab and x\nhttps://a.b/c"), (2, "group", 6, None, 0, None)]
    df = spark.createDataFrame(text, "id long, scope string, peer_id long, sender_nick string, ts long, text string")
    assert [r.link for r in registry.link_rows(df, magnets=True).collect()] == ["magnet:?xt=urn:btih:0Ab"] and [r.gid for r in registry.link_rows(df).collect()] == [""]


def test_payloads_that_are_no_messages(spark):
    df = spark.createDataFrame([(1, "no json"), (2, '{"post_type": "notice"}'), (3, None), (4, '{"post_type":"message","message_type":"private","time":1,"sender":{},"message":[{"type":"record","data":{}},{"type":"mface","data":{"emoji_id":"e"}},{"type":"file","data":{}},{"type":"forward","data":{"id":"f"}},{"type":"share","data":{"title":"t https://x/y","url":"https://x/y"}}]}')], "id long, payload string")
    got = events.segment_rows(events.message_events(df)).orderBy("seg_index").collect()
    assert [(r.kind, r.name, r.ref, r.dl) for r in got] == [("other", "voice_1.mp3", "", "pending"), ("image", "", "e", "pending"), ("file", "file", "", "pending"), ("forward", "", "f", "pending"), ("other", "", "", "none")]
    assert got[4].text == "[分享]\nt\nhttps://x/y" and got[0].sender_nick == "?"


def test_members_of_failures_and_caches(spark, tmp_path):
    m = queries.downloads(spark, SF)
    from quarrylake.operators import messages

    folded, members = messages.collapsed_failures(m).collect(), messages.failure_members(m)
    assert sum(r.n for r in folded) == members.count()
    mutations.write_cache(members, str(tmp_path / "cache"))
    assert spark.read.json(str(tmp_path / "cache")).count() == members.count()
    assert [r[0] for r in spark.range(3).select(mutations.restored_is_stale(F.col("id"), F.lit(1))).collect()] == [False, False, True]
    assert display.UNITS[1] == "KB" and chat.GROUP and library.CLOSE


@pytest.mark.parametrize("hub_least", [256, 3])
def test_components_with_hubs(spark, monkeypatch, hub_least):
    """Stars whose hub is the smallest or the largest node and holds over a third of all edges, a path, a cycle, and repeated edges."""
    monkeypatch.setattr(similarity, "HUB_LEAST", hub_least)
    edges = [*[(0, i) for i in range(1, 40)], *[(i, 199) for i in range(100, 150)], *[(i, i + 1) for i in range(200, 212)], (300, 301), (301, 302), (302, 300), (300, 301)]
    wanted = {i: i for pair in edges for i in pair}
    for _ in wanted:
        for a, b in edges:
            wanted[a] = wanted[b] = min(wanted[a], wanted[b])
    got = [tuple(r) for r in similarity.components(spark.createDataFrame(edges, "a long, b long")).select("node", "label").collect()]
    assert sorted(got) == sorted(wanted.items())

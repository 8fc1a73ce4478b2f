"""Close hashes under all key plans, greedy leaders of long chains, and free paths, against plain Python."""

import random
import time

import numpy as np
import pytest

from quarrylake.operators import mutations, registry, similarity


def close(rows, gate):
    gap = lambda a, b: max(bin(a[k] ^ b[k]).count("1") for k in (1, 2))
    return sorted((a[0], b[0], gap(a, b)) for a in rows for b in rows if a[0] < b[0] and gap(a, b) <= gate)


def signed(x, bits):
    return x - (1 << bits) if bits == 64 and x >> 63 else x


@pytest.mark.parametrize("bits, gate", [(64, 7), (32, 9), (16, 3), (8, 0)])
def test_close_pairs_under_all_plans(spark, bits, gate):
    r = random.Random(bits)
    base = [(r.getrandbits(bits), r.getrandbits(bits)) for _ in range(12)]
    twist = lambda x: x ^ sum(1 << k for k in r.sample(range(bits), r.randint(0, gate + 1)))
    rows = [(i, *map(twist, r.choice(base))) for i in range(90)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(10)]
    want = close(rows, gate)
    df = spark.createDataFrame([(i, signed(p, bits), signed(d, bits)) for i, p, d in rows] + [(300, None, 1), (301, 2, None)], "id long, phash long, dhash long")
    plans = {similarity.key_plan(n, gate, bits) for n in (10, 10_000, 10_000_000, 10**9, 10**12)}
    if bits == 16:
        plans |= {similarity.KeyPlan(similarity.Bands(2, 1), similarity.Bands(4, 0), (0, 0), 0.0), similarity.KeyPlan(similarity.Bands(4, 0), similarity.Bands(2, 1), (0, 0), 0.0)}
    for plan in plans:
        assert sorted(map(tuple, similarity.close_pairs(df, gate, bits, plan).collect())) == want and want


@pytest.mark.parametrize("bits, gate", [(64, 7), (32, 9)])
def test_close_pairs_of_short_hashes_meet_in_units(spark, monkeypatch, bits, gate):
    """All pairs in units of few rows, with partitions that stay few; no row of a candidate is joined. Repeated ids, ids out of order, negative hashes."""
    monkeypatch.setattr(similarity, "UNIT_ROWS", 13)
    monkeypatch.setattr(similarity, "HASH_TILE", (5, 7))
    r = random.Random(bits)
    base = [(r.getrandbits(bits), r.getrandbits(bits)) for _ in range(9)]
    twist = lambda x: x ^ sum(1 << k for k in r.sample(range(bits), r.randint(0, gate + 1)))
    rows = [(i * 37 % 101, *map(twist, r.choice(base))) for i in range(120)]
    df = spark.createDataFrame([(i, signed(p, bits), signed(d, bits)) for i, p, d in rows], "id long, phash long, dhash long")
    got = similarity.close_pairs(df, gate, bits)
    assert sorted(map(tuple, got.collect())) == close(rows, gate)
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and got.rdd.getNumPartitions() == 55


def test_leaders_keep_few_partitions(spark, monkeypatch):
    """Unions of each round used to add up their partitions, and each round met all that was ever settled."""
    seen, kind = [], type(spark.range(1))
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: (lambda x: (seen.append(x.rdd.getNumPartitions()), x)[1])(plain(self, *a, **k)))
    pairs = [(i, i + k) for i in range(10) for k in (1, 2, 5)]
    assert led(spark, pairs) == greedy(15, pairs)
    assert len(seen) > 10 and max(seen) <= max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_plans_widen_with_the_rows():
    """Candidates that are expected by chance grow clearly below the square of the rows."""
    met = {n: similarity.key_plan(n, 7, 64).met * n * n / 2 for n in (2_000, 183_000, 10_000_000, 10**9)}
    keys = {n: sum(similarity.key_plan(n, 7, 64).keys) for n in met}
    assert met[183_000] / met[2_000] < (183_000 / 2_000) ** 1.6 and met[10**9] / met[183_000] < (10**9 / 183_000) ** 1.6
    assert max(keys.values()) <= similarity.KEYS_MOST and keys[2_000] <= keys[10**9]


def greedy(n, pairs):
    """Rows in order; id -> leader of all that are in a pair."""
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    leader = {}
    for i in range(n):
        if near[i]:
            leader[i] = min((j for j in near[i] if j < i and leader.get(j) == j), default=i)
    return leader


def led(spark, pairs):
    links = spark.createDataFrame([(min(p), max(p), min(p)) for p in pairs], "first long, then long, order long")
    return {r.id: r.leader for r in similarity.leaders(links).collect()}


def test_leaders_of_a_long_chain(spark):
    """5,000 rows in a chain: plain greedy takes every second one; a link a round would take thousands of rounds."""
    pairs = [(i, i + 1) for i in range(4999)]
    began = time.time()
    assert led(spark, pairs) == greedy(5000, pairs)
    assert time.time() - began < 180


@pytest.mark.parametrize("seed", range(3))
def test_leaders_of_any_graph(spark, seed):
    """Random graphs, ladders, chains that meet, a hub that a third of all links share, repeated links; with contraction from the first round on."""
    r = random.Random(seed)
    n = 160
    pairs = [tuple(r.sample(range(60), 2)) for _ in range((60, 120, 40)[seed])] + [(60 + i, 61 + i) for i in range(40)] + [(60 + i, 62 + i) for i in range(0, 38, 3)]
    pairs += [(101, r.randrange(102, n)) for _ in range(50)] + [(i, i + 2) for i in range(110, 140, 2)] + pairs[:5] + [(3, 99), (30, 120)]
    links = spark.createDataFrame([(min(p), max(p), min(p)) for p in pairs], "first long, then long, order long")
    assert {x.id: x.leader for x in similarity.leaders(links, plain_rounds=0).collect()} == greedy(n, pairs)


def naive_paths(wanted, files):
    norm = lambda p: p.replace("/", "\\").lower()
    used, out = {norm(f) for f in files}, {}

    def cut(path):
        at = path.rfind(".")
        return (path[:at], path[at:]) if at > 0 and not set(path[at:]) & set("\\/") and path[at - 1] not in "\\/" else (path, "")

    shown = {}
    for _, p in wanted:
        shown[norm(p)] = min(p, shown.get(norm(p), p))
    for i, p in sorted(wanted):
        stem, dot = cut(shown[norm(p)])
        for n in range(1, 1000):
            c = p if n == 1 else f"{stem} ({n}){dot}"
            if norm(c) not in used:
                used.add(norm(c))
                out[i] = c
                break
        else:
            out[i] = None
    return out


def test_free_paths(spark):
    """Names that look numbered, that push one another on, that differ in case and separators, without an extension, and more rows of one name than numbers."""
    r = random.Random(3)
    names = ["x.mp4", "x (2).mp4", "x (2) (2).mp4", "X.MP4", "d/x (3).mp4", "d\\x.mp4", "noext", "noext (2)", ".hidden", "d/.hidden", "a.b.c", "a.b (2).c", "x (1).mp4", "x (02).mp4", "new\nline.mp4", "new\nline (2).mp4"]
    wanted = [(i, r.choice(names)) for i in range(150)] + [(1000 + i, "hot.bin") for i in range(1010)]
    files = ["x (4).mp4", "D/X.mp4", "hot (7).bin", "noext (3)", "other", "new\nline (3).mp4"]
    got = mutations.free_paths(spark.createDataFrame(wanted, "id long, path string"), spark.createDataFrame([(f,) for f in files], "path string")).collect()
    want = naive_paths(wanted, files)
    assert {g.id: g.free_path for g in got} == want and sum(v is None for v in want.values()) == 12
    three = spark.createDataFrame([(1, "x.mp4"), (2, "x.mp4"), (3, "x (2).mp4")], "id long, path string")
    free = {g.id: g.free_path for g in mutations.free_paths(three, spark.createDataFrame([], "path string")).collect()}
    assert free == {1: "x.mp4", 2: "x (2).mp4", 3: "x (2) (2).mp4"}


def test_titles_of_links_that_begin_others(spark):
    text = "first https://a.b/xyz then https://a.b/x\nhttps://a.b/x/1 https://a.b/x/1 again https://a.b/x/"
    df = spark.createDataFrame([(1, "private", 5, "ann", 0, text)], "id long, scope string, peer_id long, sender_nick string, ts long, text string")
    got = {r.link: r.title for r in registry.link_rows(df).collect()}
    assert got["https://a.b/xyz"] == "first" and got["https://a.b/x"] == "first https://a.b/xyz then"
    assert got["https://a.b/x/1"] == "" and got["https://a.b/x/"] == "https://a.b/x/1 https://a.b/x/1 again"


def naive_pixels(items):
    """Plain greedy over items in order: id -> leader, of groups of two and more."""
    left, out = sorted(items, key=lambda x: (x[2], x[1])), {}
    while left:
        lead, *left = left
        mine = [x for x in left if similarity.pixels_close(lead[3], x[3])]
        if mine:
            out |= {x[1]: lead[1] for x in [lead, *mine]}
        left = [x for x in left if x not in mine]
    return out


@pytest.mark.parametrize("thin_rounds", [0, 3])
def test_pixel_groups_where_one_pool_is_a_third(spark, thin_rounds):
    """Chains of grids that drift by steps, near copies of few grids, exact copies, grids of several sizes, empty ones."""
    r = random.Random(8)
    base = [[r.randrange(256) for _ in range(24)] for _ in range(6)]
    grid = lambda b, k: bytes(min(255, max(0, x + r.randint(-k, k))) for x in b)
    items = [(1, i, r.randint(0, 20), grid(r.choice(base), r.choice((0, 2, 3, 5)))) for i in range(160)]
    items += [(1, 300 + i, 30 + i, bytes([i] * 24)) for i in range(14)] + [(1, 400 + i, i, bytes([9, 9, 9])) for i in range(40)]
    items += [(p, 1000 * p + i, i, grid(base[0], 3)) for p in range(2, 30) for i in range(12)] + [(1, 600, 0, b""), (1, 601, 0, b""), (1, 602, 0, None)]
    want = {}
    for p in {x[0] for x in items}:
        want |= naive_pixels([x for x in items if x[0] == p])
    df = spark.createDataFrame(items, "pool long, id long, created_at int, pixels binary").repartition(4)
    got = similarity.greedy_groups(df, thin_rounds)
    assert {x.id: x.leader for x in got.collect()} == want and got.columns == ["id", "pool", "leader"]


def test_pixel_groups_of_a_crowd(spark):
    """One pool of 8,000 grids of which a third of all pairs are close: their links, made row by row, would be ten million."""
    r = np.random.default_rng(5)
    grids = np.clip(60 + r.normal(0, 1.7, (8000, 36)) + r.normal(0, 1, (8000, 1)), 0, 255).astype(np.uint8)
    left, want = np.arange(8000), {}
    while len(left):
        gap = np.abs(grids[left].astype(int) - grids[left[0]])
        close = (gap.mean(1) <= similarity.MEAN_MOST) & ((gap > similarity.LOUD).mean(1) <= similarity.LOUD_SHARE)
        want |= {int(i): int(left[0]) for i in left[close]} if close.sum() > 1 else {}
        left = left[~close]
    began = time.time()
    df = spark.createDataFrame([(1, i, i, bytes(g)) for i, g in enumerate(grids)], "pool long, id long, created_at long, pixels binary")
    assert {x.id: x.leader for x in similarity.greedy_groups(df).collect()} == want and 20 < len(set(want.values()))
    assert time.time() - began < 120

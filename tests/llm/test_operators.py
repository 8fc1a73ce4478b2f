"""The training-data operators against brute force on small corpora, and their defined results on awkward ones."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarrylake.llm import exact_dedup, license_scan, lm_score, mixing, ngram_join, sentencepiece_codec, suffix_dedup, syncmers, toxicity

from .fixtures import SCHEMA, corpus, frame

WS = "[\x20\x09-\x0d]+"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5


@pytest.mark.parametrize("op", [exact_dedup.groups, exact_dedup.deduplicated, mixing.mix, mixing.mixed, license_scan.scan, ngram_join.link_components, ngram_join.representatives, suffix_dedup.without_repeats, lm_score.scored, syncmers.fingerprints, sentencepiece_codec.encode])
def test_empty_and_all_null_tables(spark, op):
    assert rows_of(op(spark.createDataFrame([], SCHEMA))) == []
    nulls = spark.createDataFrame([(None,) * 13] * 3, SCHEMA)
    # null texts are equal: where copies go, one of the three rows stays; a mix of no words takes none
    want = {exact_dedup.deduplicated: 1, mixing.mixed: 0}.get(op, 3)
    assert len(rows_of(op(nulls))) == want


def test_exact_dedup(spark):
    rows = corpus() + [(10_000 + i, " b u l k\n" if i % 7 else "bulk", "en", "a", 4, None, None, None, None, None, None, None, None) for i in range(900)]
    rows.append((None, "bulk", *rows[-1][2:]))
    got = rows_of(exact_dedup.groups(frame(spark, rows), piece_bytes=512))
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(WS, "", r[1] or "")].append(r)
    want = []
    for norm, members in groups.items():
        members.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        want += [(r[0], members[0][0], len(members), k == 0, sha) for k, r in enumerate(members)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = exact_dedup.deduplicated(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if w[3])


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("max_cluster", [1 << 20, 300])
def test_ngram_join(spark, max_cluster):
    rows = corpus(n=80)
    got = rows_of(ngram_join.link_components(frame(spark, rows), max_cluster=max_cluster))
    assert sorted(got) == brute_components(rows)
    links = {r[0]: r[2] for r in got}
    stay = ngram_join.representatives(frame(spark, rows))
    assert {r.doc_id for r in stay.collect()} == {k for k, v in links.items() if k == v}


def test_ngram_join_of_a_large_family(spark):
    """Clusters beyond max_cluster go through rounds against a leader; members at several distances, and texts that only share a passage."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in r.choice(120, int(r.integers(0, 5)), replace=False):
            w[k] = f"x{i}_{k}"
        if i % 3 == 0:
            w = w[:60] + [f"y{i}_{k}" for k in range(int(r.integers(0, 60)))]
        rows.append((i + 1, " ".join(w), *[None] * 11))
    got = rows_of(ngram_join.link_components(frame(spark, rows), max_cluster=400, salts=3))
    assert sorted(got) == brute_components(rows)


def test_chunk_pairs_meet_by_size(spark):
    """Members whose sizes allow a link meet in a unit; a member goes to few units, not to one for each chunk; units stay near max_cluster; small clusters stay out."""
    sizes = [n for n in range(20, 420, 2) for _ in range(3)] + [30] * 200 + [5000]
    name = lambda i: i.to_bytes(16, "big")
    members = [(name(i), name(0), i, 0, 1, n) for i, n in enumerate(sizes)] + [(name(9000 + i), name(1), 9000 + i, 0, 1, 10) for i in range(5)]
    clusters = spark.createDataFrame(members, "sig binary, cluster binary, doc_id long, digest long, copies long, n long")
    large = spark.createDataFrame([(name(0), sum(sizes))], "cluster binary, size long")
    units = {}
    for r in ngram_join.chunk_pairs(clusters, large, 8000).collect():
        units.setdefault(bytes(r.cluster), []).append(r.doc_id)
    of = {i: {u for u, ids in units.items() if i in ids} for i in range(len(sizes))}
    assert sum(map(len, units.values())) == len({(u, i) for u, ids in units.items() for i in ids})
    assert all(of[i] & of[k] for i in of for k in of if sizes[i] <= sizes[k] and 100 * sizes[i] >= 75 * sizes[k])
    n_chunks = -(-2 * sum(sizes) // 8000)
    assert sum(map(len, units.values())) < 0.5 * n_chunks * len(sizes)
    assert all(sum(sizes[i] for i in ids) < 1.5 * 8000 for u, ids in units.items() if len(sizes) - 1 not in ids)


@pytest.mark.parametrize("hub_least", [256, 3])
def test_components_with_hubs(spark, monkeypatch, hub_least):
    """Stars whose hub is the smallest, the largest or a middle node and holds over a third of all edges, a path, a cycle, repeated edges, loops, and no edges."""
    monkeypatch.setattr(ngram_join, "HUB_LEAST", hub_least)
    stars = [(0, i) for i in range(1, 40)] + [(i, 199) for i in range(100, 150)] + [(75, i) for i in range(60, 90) if i != 75]
    edges = [*stars, *[(i, i + 1) for i in range(200, 230)], (300, 301), (301, 302), (302, 300), (300, 301), (301, 300), (310, 310), (39, 75)]
    wanted = {i: i for pair in edges for i in pair if pair[0] != pair[1]}
    for _ in wanted:
        for a, b in edges:
            if a != b:
                wanted[a] = wanted[b] = min(wanted[a], wanted[b])
    name = lambda i: i.to_bytes(2, "big")
    frame_of = lambda rows: spark.createDataFrame([(name(a), name(b)) for a, b in rows], "a binary, b binary")
    got = [(bytes(r.node), bytes(r.root)) for r in ngram_join.components(frame_of(edges)).collect()]
    assert sorted(got) == sorted((name(i), name(r)) for i, r in wanted.items())
    assert ngram_join.components(frame_of([])).count() == 0


def roots_of(edges):
    least = {i: i for pair in edges for i in pair if pair[0] != pair[1]}
    while True:
        now = dict(least)
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
        if now == least:
            return least


@pytest.mark.parametrize("most", [(0, 3), (0, 1 << 19), (1 << 17, 3)])
def test_components_by_shuffle_and_by_broadcast(spark, monkeypatch, most):
    """Random graphs, stars and a path over several partitions, with forests of few edges and hubs of few."""
    for name, value in zip(("BROADCAST_EDGES", "FOREST_EDGES"), most):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "HUB_LEAST", 8)
    rng = np.random.default_rng(11)
    edges = [tuple(x) for x in rng.integers(0, 400, (260, 2)).tolist()] + [(500, i) for i in range(501, 530)] + [(i, 600) for i in range(560, 600)] + [(i, i + 1) for i in range(700, 760)]
    df = spark.createDataFrame([edges[i] for i in rng.permutation(len(edges))], "a long, b long").repartition(7)
    got = dict((r.node, r.root) for r in ngram_join.components(df).collect())
    assert got == roots_of(edges)


def test_components_in_few_stages(spark):
    """Near copies give the same links in every bucket: a round of components, with its plan and tasks in the driver's memory, is taken only while edges are no stars."""
    copies = [(i, i + 1) for i in range(0, 900) if i % 30 != 29]
    df = spark.createDataFrame([e for k in range(6) for e in copies[k:]], "a long, b long").repartition(1)
    sc = spark.sparkContext
    sc.setJobGroup("components", "components")
    try:
        assert dict((r.node, r.root) for r in ngram_join.components(df).collect()) == roots_of(copies)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup("components")
    assert len(jobs) <= 12


def test_forests():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300):
        edges = rng.integers(0, n, (n, 2)).tolist()
        name = lambda i: i.to_bytes(3, "big") + bytes(13)
        t = pa.table({k: pa.array([name(e[j]) for e in edges], pa.binary()) for j, k in enumerate("ab")})
        wanted = {name(i): name(r) for i, r in roots_of(edges).items() if i != r}
        assert dict(zip(ngram_join._forest(t)["b"].to_pylist(), ngram_join._forest(t)["a"].to_pylist())) == wanted
        out = [tuple(r.values()) for b in ngram_join._forests(4)(iter(t.to_batches(2))) for r in b.to_pylist()]
        assert {i: r for i, r in roots_of(out).items() if i != r} == wanted


def test_tree_join_in_blocks_equals_pairs():
    """Blocks of few sets, short steps along a path, sets that are part of others, sizes far apart, and elements that only one set holds."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        universe = int(rng.integers(4, 300))
        bases = [rng.integers(0, universe, int(rng.integers(1, 50))) for _ in range(3)]
        found = {}
        for _ in range(int(rng.integers(2, 60))):
            one = bases[int(rng.integers(3))].copy()
            edited = rng.random(len(one)) < 0.4 * rng.random()
            one[edited] = rng.integers(0, universe, int(edited.sum()))
            kept = np.unique(one).astype(np.uint64)
            found[kept.tobytes()] = kept
        sets = list(found.values())
        label = np.arange(len(sets))
        common = np.sort(rng.choice(universe, universe // 4, replace=False)).astype(np.uint64)
        ngram_join._tree_join(sets, common, label, matrix_bytes=int(rng.integers(1, 4000)), step=int(rng.integers(1, 65)))
        wanted = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                    wanted = [wanted[i] if x == wanted[j] else x for x in wanted]
        assert all((label[i] == label[j]) == (wanted[i] == wanted[j]) for i in range(len(sets)) for j in range(i))


def test_join_cluster_equals_pairs():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 60), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(rng.integers(2, 60))]
        common = np.sort(rng.choice(base, 20, replace=False))
        roots = ngram_join.join_cluster(sets, common)
        parent = list(range(len(sets)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                    parent[find(i)] = find(j)
        same = lambda a, f: {(i, j) for i in range(len(a)) for j in range(i) if f(i) == f(j)}
        assert same(roots, lambda i: roots[i]) == same(sets, find)


@pytest.mark.parametrize("crowd", [1 << 16, 3])
def test_suffix_dedup(spark, crowd):
    rows = corpus()
    got = {r[0]: r[1:] for r in rows_of(suffix_dedup.without_repeats(frame(spark, rows), block_bytes=4000, crowd=crowd))}
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            first.setdefault(texts[d][i : i + 50], d)
    for d, b in texts.items():
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        assert got[d] == (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())


def test_suffix_dedup_of_periodic_texts(spark):
    """One character 100,000 times has one minimizer throughout."""
    n = 100_000
    rows = [(1, "=" * n, *[None] * 11), (2, "z" * 10 + "=" * (n + 5), *[None] * 11), (3, "ab" * n, *[None] * 11)]
    got = {r[0]: r[1:4] for r in rows_of(suffix_dedup.without_repeats(frame(spark, rows)))}
    assert got == {1: (n, 0, 0), 2: (n + 15, n + 5, 1), 3: (2 * n, 0, 0)}


def test_lm_score(spark):
    rows = corpus()
    got = rows_of(lm_score.scored(frame(spark, rows), block_bytes=4000, share=0.002))
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for r in rows if fold(r[0]) != 1 for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = {r[0]: (fold(r[0]) == 1, len(words(r[1])), sum(c[w] > 0 for w in words(r[1])), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(r[1]))) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r[1:5] == want[r[0]][:4]
        assert r[5] == pytest.approx(want[r[0]][4]) and r[6] < 0


def brute_removed(rows):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, sorted; a null id is greater than all others."""
    keyed = [(math.inf if r[0] is None else r[0], (r[1] or "").encode(), r[0]) for r in rows]
    first, out = {}, []
    for key, b, _ in sorted(keyed, key=lambda x: x[0]):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], key)
    for key, b, d in keyed:
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup_of_a_line_that_the_later_document_repeats(spark):
    """All places of a line go, in whichever blocks the documents are."""
    r = np.random.default_rng(3)
    some = lambda n: "".join(chr(97 + int(x)) for x in r.integers(0, 26, n))
    rows = []
    for i in range(12):
        line = some(90)
        rows.append((50 + i, f"{some(70)} {line} {some(60)}", *[None] * 11))
        rows.append((500 + i, f"{line} {some(30)} {line}\n{line} {some(80)}\n{line}", *[None] * 11))
    got = rows_of(suffix_dedup.without_repeats(frame(spark, rows), block_bytes=300))
    assert sorted(got, key=repr) == brute_removed(rows)


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    """What goes from one row stays in another of the same id, or of no id either."""
    r = np.random.default_rng(4)
    some = lambda n: "".join(chr(97 + int(x)) for x in r.integers(0, 26, n))
    rows = []
    for i in range(6):
        line = some(120)
        rows.append((i, some(40) + line + some(50), *[None] * 11))
        for d in (None, 300 + i // 2):
            rows += [(d, some(20 + 9 * i) + line + some(200), *[None] * 11), (d, some(400), *[None] * 11)]
    got = rows_of(suffix_dedup.without_repeats(frame(spark, rows), block_bytes=300))
    assert sorted(got, key=repr) == brute_removed(rows)


def brute_lm(texts, train, discount=0.75):
    """log10 score of each text by a model of all 2- and 3-grams that occur twice."""
    grams = [Counter(), Counter(), Counter(), Counter()]
    for words in train:
        for n in (1, 2, 3):
            grams[n].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    total, types = sum(grams[1].values()), len(grams[1])
    kept = {g: c for n in (2, 3) for g, c in grams[n].items() if c >= 2}
    after = defaultdict(list)
    for g, c in kept.items():
        after[g[:-1]].append(c)
    count = lambda h: grams[len(h)][h]

    def p(g):
        if len(g) == 1:
            return (count(g) - discount) / total if count(g) else discount * types / total
        h = g[:-1]
        gamma = 1 - (sum(after[h]) - discount * len(after[h])) / count(h) if h in after else 1.0
        return (max(0, kept[g] - discount) / count(h) if g in kept else 0.0) + gamma * p(g[1:])

    return [sum(math.log10(p(tuple(words[max(0, i - 2) : i + 1]))) for i in range(len(words))) for words in texts]


def test_lm_score_keeps_rare_sequences_of_a_large_corpus(spark):
    """2- and 3-grams seen twice are kept, also where all tokens are so many (over 40,000) that a share of 5e-5 is more than that."""
    r = np.random.default_rng(5)
    rows = corpus() + [(100_000 + i, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 500) % 5000), *[None] * 11) for i in range(150)]
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    train = [words(x[1]) for x in rows if fold(x[0]) != 1]
    assert sum(map(len, train)) * 5e-5 > 2
    want = dict(zip([x[0] for x in rows], brute_lm([words(x[1]) for x in rows], train), strict=True))
    got = rows_of(lm_score.scored(frame(spark, rows), block_bytes=40_000))
    assert len(got) == len(rows)
    for x in got:
        assert x[6] == pytest.approx(want[x[0]], rel=1e-9)


def test_lm_states_sum_to_one():
    words = [b"a", b"b", b"a", b"c", b"a", b"b", b"\n", b"a", b"b", b"d"] * 5
    c = Counter(words)
    ids = {w: i + 1 for i, w in enumerate(w for w in c if w != b"d")}
    base = len(ids) + 1

    def seqs(n):
        k = Counter()
        for i in range(len(words) - n + 1):
            part = [ids.get(w, 0) for w in words[i : i + n]]
            if all(part):
                s = 0
                for p in part:
                    s = s * base + p
                k[s] += 1
        keys = sorted(k)
        return np.array(keys), np.array([k[x] for x in keys])

    m = lm_score.Automaton(ids, [c[w] for w in ids], [seqs(2), seqs(3)], len(words), len(c), 0.75)
    every = [*c, b"unseen"]
    roots = m.root_weights(np.array([c[w] for w in every])).tolist()
    for context in ([], [b"a"], [b"a", b"b"], [b"b", b"a"], [b"c", b"a", b"b"], [b"d"], [b"d", b"a"]):
        before = m.walk([ids.get(w, 0) for w in context], m.root_weights(np.array([c[w] for w in context])).tolist() if context else [])
        total = sum(10 ** (m.walk([ids.get(w, 0) for w in [*context, x]], [*(m.root_weights(np.array([c[w] for w in context])).tolist() if context else []), r]) - before) for x, r in zip(every, roots, strict=True))
        assert total == pytest.approx(1)


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_mixing(spark):
    rows = corpus()
    got = rows_of(mixing.mix(frame(spark, rows), rows_per_shard=10, block_tokens=4))
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(rows_of(mixing.mix(frame(spark, rows[::-1]), rows_per_shard=10, block_tokens=4)), key=str)
    sizes, order = Counter(), sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    for r in rows:
        sizes[r[3]] += len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for _, source, size, source_size, t, k in got:
        assert source_size == sizes[source] and t == pytest.approx(target[source]) and 0 <= k <= 2 * size
        taken[source] += k
    for s in order:
        assert abs(taken[s] - target[s]) <= 40
    out = mixing.mixed(frame(spark, rows), rows_per_shard=10, block_tokens=4)
    assert out.columns == frame(spark, rows).columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    want = Counter()
    for doc_id, *_, k in got:
        want[doc_id] += k
    assert +words == +want


def test_apportionment(spark):
    from pyspark.sql import functions as F

    for seed in range(6):
        r = np.random.default_rng(seed)
        votes = [float(x) for x in r.integers(0, 1000, 9)]
        seats = int(r.integers(1, 60))
        df = spark.createDataFrame(list(enumerate(votes)), "k int, v double")
        got = {x.k: x.seats for x in mixing.apportioned(df, "v", F.lit(seats), [], [F.col("k")], "seats").collect()}
        assert [got[i] for i in range(9)] == sainte_lague(votes, seats)


def test_license_scan(spark):
    rows = corpus()
    got = {r[0]: r[1:] for r in rows_of(license_scan.scan(frame(spark, rows)))}
    for r in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(x.lower() if x.isascii() else x for x in r[1] or ""))
        places = [(i, label) for phrase, label in license_scan.PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in places]
        base = ",".join(sorted({x for _, x in places}))
        assert got[r[0]][:5] == (len(w), len(at), min(at, default=None), max(at, default=None), base)
        assert set(base.split(",")) <= set(got[r[0]][5].split(",")) | {""}


def test_license_template_with_edits(spark):
    text = license_scan.TEMPLATES[0][1].split()
    changed = ["word"] * 30 + text[:9] + ["quite"] + text[9:15] + text[16:] + ["tail"]
    rows = [(1, " ".join(changed), *[None] * 11), (2, " ".join(text[:10]), *[None] * 11)]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1].labels == "mit" and got[1].n_base == 0 and 0.75 <= got[1].score < 1
    assert got[2].labels == "" and got[2].score == 0


def naive_anchors(raw, k=syncmers.K, s=syncmers.S):
    """(position, bytes) of the closed syncmers of raw, by definition."""
    a, b, mask = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1

    def h(x):
        v = int.from_bytes(x, "little") * a & mask
        v ^= v >> 32
        return v * b & mask

    if len(raw) < k:
        return [(0, raw)] if raw else []
    inner = [h(raw[i : i + s]) for i in range(len(raw) - s + 1)]
    w = k - s + 1
    return [(i, raw[i : i + k]) for i in range(len(raw) - k + 1) if min(inner[i : i + w]) in (inner[i], inner[i + w - 1])]


def naive_likeness(x, y):
    """Positional matching of two anchor lists by plain loops."""
    if x == y:
        return 1.0
    places = defaultdict(list)
    for at, g in y:
        places[g].append(at)
    nth, shifts = Counter(), []
    for at, g in x:
        if nth[g] < len(places[g]):
            shifts.append(places[g][nth[g]] - at)
        nth[g] += 1
    m = sum(s in shifts[max(0, i - 1) : i] + shifts[i + 1 : i + 2] for i, s in enumerate(shifts))
    return m / (len(x) + len(y) - m)


def test_syncmers(spark):
    """Against anchors by definition and matching by plain loops, for long texts, repeats, rows that share an id and rows without one."""
    rows = corpus() + [(None, "no id here, but words enough for an anchor or two", *[None] * 11), (None, None, *[None] * 11)]
    got = Counter(rows_of(syncmers.fingerprints(frame(spark, rows), piece_bytes=2000)))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    text = [r[1] or "" for r in rows]
    mine = [naive_anchors(t.encode()) for t in text]
    want, prints, by_text = Counter(), {}, {}
    for i, r in enumerate(rows):
        following = (i + 1) % len(rows)
        half = len(text[i]) // 2
        new = text[i][: len(text[i]) - half] + text[following][:half]
        anchors = naive_anchors(new.encode())
        sha = hashlib.sha256(new.encode()).hexdigest()
        want[r[0], len(text[i]), sha, naive_likeness(mine[i], anchors), naive_likeness(mine[i], mine[following])] += 1
        prints[sha] = new, anchors
        by_text[r[0], len(text[i]), sha] = text[i]
    assert Counter((*r[:3], *r[5:]) for r in got.elements()) == want
    seen = defaultdict(set)
    for r in got:
        new, anchors = prints[r[2]]
        raw = base64.b64decode(r[4])
        assert r[4] == syncmers.fingerprint(syncmers.marks(new)) and np.cumsum(np.frombuffer(raw, np.uint8, len(raw) // 5)).tolist() == [at for at, _ in anchors]
        seen[by_text[r[:3]]].add(r[3])
    assert all(len(v) == 1 for v in seen.values()) and len(set(map(frozenset, seen.values()))) > len(seen) - 5


def test_closed_syncmers_by_definition():
    raw = "Das ist ein längerer Text, aus dem Anker gewählt werden; er hat keine Wiederholung.".encode()
    at, _ = syncmers.anchors(raw)
    want = [i for i, _ in naive_anchors(raw)]
    assert at.tolist() == want and len(want) > 1 and all(b - a <= syncmers.K - syncmers.S + 1 for a, b in zip(want, want[1:]))


def test_likeness_needs_order():
    r = np.random.default_rng(1)
    some = lambda n: "".join(chr(97 + int(x)) for x in r.integers(0, 26, n))
    a, b, c = some(3000), some(3000), some(150)
    like = lambda x, y: syncmers.likeness(syncmers.marks(x), syncmers.marks(y))
    assert like(a, a) == 1 and like("", "") == 1 and like("", a) == 0 and like(a, b) == 0
    assert like(a, a[:1500] + "x" + a[1500:]) > 0.95 and like(a + b, b + a) > 0.95
    # a passage of two percent shows
    assert 0 < like(a + c + b, some(3000) + c + some(3000)) < 0.05


def test_sentencepiece(spark):
    with open(sentencepiece_codec.MODEL, "rb") as f:
        raw = f.read()
    texts = [r[1] or "" for r in corpus()] + ["", " a  b ", "日本語 テスト 😀", "▁a ▁▁b", "<s> x </s> <unk> <0x41>", "12 345", "tab\there"]
    assert sentencepiece_codec.verify_parity(raw, texts) == 0
    got = sentencepiece_codec.encode(frame(spark)).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got) and len(got) == len(corpus())
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark))).collect()}
    assert back == {r[0]: r[1] or "" for r in corpus()}


def test_unigram_model_parity():
    """A hand-made unigram model, as the library itself writes it."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    for p, s, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("ab", -2.9, 1), ("▁ab", -3.1, 1), ("ba", -4.5, 1)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]:
        x = m.pieces.add()
        x.piece, x.score, x.type = p, s, kind
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    assert sentencepiece_codec.verify_parity(m.SerializeToString(), ["ab ba", "a b  abab", "aß", "", "babab"]) == 0


def test_toxicity(spark):
    bad, fine = "what a vile grunk you are", "the report covers the second quarter of the year"
    docs = [(i, (f"{bad} {i}" if i % 3 == 0 else f"{fine} {i}" if i % 3 == 1 else f"the grunk bridge opened {fine}"), *[None] * 11) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(frame(spark, docs), labels)
    extra = [(1000, "What a v1le GRUNK you are", *[None] * 11), (1001, "whаt а vilе grunk you аre", *[None] * 11), (1002, None, *[None] * 11), (1003, "", *[None] * 11)]
    got = {r.doc_id: r for r in toxicity.scores(frame(spark, docs + extra), lexicon).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(300))
    assert got[1000].predicted == got[1001].predicted == 1 and got[1002].predicted == got[1003].predicted == 0
    assert got[0].held_out == (fold(0) == 0) and all(0 <= r.score <= 1 for r in got.values())
    stay = toxicity.clean(frame(spark, docs), lexicon)
    assert stay.columns == frame(spark, docs).columns and {r.doc_id for r in stay.collect()} == {i for i in range(300) if i % 3}
    none = toxicity.fit(frame(spark, docs), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.entries and rows_of(toxicity.scores(spark.createDataFrame([], SCHEMA), none)) == []


def test_texts_with_odd_stretches_are_decoded_whole():
    from quarrylake.llm import sentencepiece_codec as sp

    with open(sp.MODEL, "rb") as f:
        c = sp.Codec(f.read())
    texts = ["some words here", "", "  two", "words again"]
    ids, same = c.encode_checked(texts)
    c.odd.add("words")
    assert c.encode_checked(texts) == (ids, same) and same == [True] * 4
    c.normalised = lambda text: "another"
    assert c.encode_checked(texts)[1] == [False, True, True, False]

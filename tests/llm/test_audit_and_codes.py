"""MinHash near-dedup, vector codes and the divergence audit against brute force, and their defined results on awkward tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarrylake.llm import divergence, minhash, vector_codes

from .fixtures import SCHEMA, corpus, frame


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, num=85):
    """doc_id, n_shingles, component_id, kept for each row; rows without an id link with nothing."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if None not in (rows[i][0], rows[j][0]) and inter and 100 * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = r[0] if r[0] is None else min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), c := least[find(i)] if sets[i] else r[0], r[0] == c) for i, r in enumerate(rows)), key=str)


def family(seed=3, n=120, words=90):
    """Texts of one mould with few to many edits, so that similarities lie on both sides of the threshold."""
    r = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in r.choice(words, int(r.integers(0, 5)), replace=False):
            w[k] = f"x{i}_{k}" if r.random() < 0.7 else f"x{k}"
        if i % 5 == 0:
            w = w[: words // 2] + [f"y{i}_{k}" for k in range(int(r.integers(0, words)))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunks", [{}, {"chunk_rows": 4, "salt_rows": 3}, {"chunk_shingles": 300}])
def test_minhash(spark, chunks):
    rows = corpus(n=60) + [(20_000 + i, t, *[None] * 11) for i, t in enumerate(family())]
    rows += [(None, rows[20][1], *[None] * 11), (20_001, "another text of one id that is like no other", *[None] * 11)]
    got = sorted(map(tuple, minhash.near_copies(frame(spark, rows), **chunks).collect()), key=str)
    want = [(a, n, c, True if a is None else k) for a, n, c, k in brute_components(rows)]
    assert got == sorted(want, key=str)


def test_minhash_of_a_third_in_one_group(spark):
    """Exact and near copies of one text, rows that repeat, and rows of one id with different texts."""
    words = [f"a{i}" for i in range(60)]
    near = [" ".join(words[:k] + [f"z{k}"] + words[k + 1 :]) for k in range(60)]
    rows = [(i, near[i % 60]) for i in range(300)] + [(5, near[7])] * 40 + [(900 + i // 7, f"{i} b c d e f g h {i}") for i in range(300)]
    rows = [(*r, *[None] * 11) for r in rows]
    got = sorted(map(tuple, minhash.near_copies(frame(spark, rows), chunk_rows=16).collect()), key=str)
    assert got == brute_components(rows)


def test_minhash_of_awkward_tables(spark):
    assert minhash.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    got = minhash.near_copies(spark.createDataFrame([(None,) * 13] * 3, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(None, 0, None, True)] * 3


def test_posterior_bounds():
    """The posterior by adding up its density; the batches' bounds keep what they must."""
    least, most = minhash.bounds()
    x = (np.arange(200_000) + 0.5) / 200_000
    for k, n in enumerate(range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH)):
        for m in (0, n // 2, least[k] - 1, least[k], n):
            density = np.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * np.log(x) + (n - m) * np.log1p(-x)) / 200_000
            assert (density[x >= 0.85].sum() >= minhash.MISS) == (m >= least[k])
            assert most[k][m] == 1.0 or density[x >= most[k][m]].sum() <= minhash.MISS * 1.05


def test_unite_equals_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
        sets = {}
        for _ in range(40):
            s = base.copy()
            s[rng.random(80) < 0.2 * rng.random()] = rng.integers(0, 1 << 62, dtype=np.uint64)
            s = np.unique(s[: int(rng.integers(60, 81))])
            sets[s.tobytes()] = s
        sets = list(sets.values())
        side = rng.integers(0, 2, len(sets)) if rng.random() < 0.5 else None
        labels = np.arange(len(sets))
        found = minhash.unite(sets, labels.copy(), side)
        for a, b in found:
            over = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * over >= 85 * (len(sets[a]) + len(sets[b]) - over) and (side is None or side[a] != side[b])

        def roots(pairs):
            root = list(range(len(sets)))
            for _ in root:
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        overs = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a) if side is None or side[a] != side[b]}
        assert roots(found) == roots([(a, b) for (a, b), o in overs.items() if 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o)])


VECTORS = "vec_id long, embedding array<float>, label int, vec string, codes string, part int, error long"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    vecs = [cut(r[1]) for r in kept]
    book = [[vecs[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(book[p])), key=lambda e: (far(v[p], book[p][e]), e))
    for _ in range(rounds):
        codes = [[nearest(v, p) for p in range(parts)] for v in vecs]
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [v[p] for v, c in zip(vecs, codes, strict=True) if c[p] == e]
                if mine:
                    book[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = [[nearest(v, p) for p in range(parts)] for v in vecs]
    errors = [sum(far(v[p], book[p][c[p]]) for p in range(parts)) for v, c in zip(vecs, codes, strict=True)]
    sums = defaultdict(int)
    for (_, _, label, _), e in zip(kept, errors, strict=True):
        sums[label] += e
    digest = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((r[0], bytes(c).hex(), long(e), long(sums[r[2]]) if all(long(x) is not None for (_, _, l, _), x in zip(kept, errors, strict=True) if l == r[2]) else None, digest) for r, c, e in zip(kept, codes, errors, strict=True)), key=str)


def vectors(n, width=16, seed=0, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in r.normal(size=width) * scale], int(r.integers(3)) if i % 4 else None) for i in range(n)]


def coded(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], VECTORS).repartition(3)
    return sorted(map(tuple, vector_codes.compressed(df).collect()), key=str)


def test_vector_codes(spark):
    rows = vectors(220)
    odd = [None, [], [None] * 16, [float("nan")] + [0.0] * 15, [float("inf")] * 16, [-float("inf")] + [1.0] * 15]
    rows += [(300 + k, v, 1) for k, v in enumerate(odd) if v != []]
    rows += [rows[3], rows[3], (None, [0.5] * 16, None), (None, [0.25] * 16, 2), (7, [0.125] * 16, 2)]
    assert coded(spark, rows) == brute_codes(rows)


@pytest.mark.parametrize("n", [1, 3, 16, 40])
def test_vector_codes_of_ties(spark, n):
    """A grid of few places: equal entries, equal distances, unused entries, fewer rows than entries."""
    r = np.random.default_rng(n)
    rows = [(i, [float(x) / 4096 for x in r.integers(-2, 3, 8)], 0) for i in range(n)]
    assert coded(spark, rows) == brute_codes(rows)


def test_vector_codes_of_large_components(spark):
    rows = vectors(40, scale=1e5) + vectors(3, scale=1e9, seed=4)
    assert coded(spark, rows) == brute_codes(rows)


def test_vector_codes_of_awkward_tables(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 0), (2, [float("nan")] * 8, None)]) == []
    with pytest.raises(ValueError):
        coded(spark, [(1, [0.0] * 8, 0), (2, [0.0] * 16, 0)])
    with pytest.raises(ValueError):
        coded(spark, [(1, [0.0] * 9, 0)])


def test_bounds_save_scans_and_lose_nothing():
    r = np.random.default_rng(9)
    ints = np.concatenate([r.integers(-50, 50, (400, 2, 3)) + 1000 * k for k in range(4)])
    before = ints[::100][:16].swapaxes(0, 1).copy()
    codes, upper, lower = np.zeros((1600, 2), np.int64), np.zeros((1600, 2)), np.zeros((1600, 2))
    scans = [vector_codes.Book(before, None).assign(ints, codes, upper, lower)]
    book = before
    for _ in range(5):
        after = book.copy()
        for p in range(2):
            for e in range(16):
                mine = ints[codes[:, p] == e, p]
                if len(mine):
                    after[p, e] = mine.sum(0) // len(mine)
        scans.append(vector_codes.Book(after, book).assign(ints, codes, upper, lower))
        book = after
        for p in range(2):
            assert (codes[:, p] == np.argmin(((ints[:, p, None] - book[p]) ** 2).sum(-1), 1)).all()
    assert scans[0] == 3200 and scans[-1] < 3200


def brute_audit(rows, least=3, ranks=200):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(fold))) for r in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, k in df[lang].items() if k >= least]
        sources = sorted(s for x, s in n if x == lang)
        share = lambda count, total: 1 + 1_000_000_000 * (count + 1) // (total + len(kept))
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: share(n[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(h, sum(f(p[s][t], p[h][t]) for t in kept)) for h in sources if h != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(items[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("parameters", [{}, {"flush_runs": 40, "salts": 3}, {"chunk_terms": 5, "block_size": 2}, {"term_ranks": 4, "least_docs": 1}])
def test_divergence(spark, parameters):
    rows = [(*r[:2], ("en", "de", None)[k % 3], *r[3:]) for k, r in enumerate(corpus())]
    rows += [(9000 + k, f"Über {'straße' * (k % 3)} x-{k % 5} A\tb 1c2 ç \U0001f600{k % 2}", "fr", f"s{k % 7}", *[None] * 9) for k in range(40)]
    rows += [(1, "lone words", "xx", "only", *[None] * 9), (2, "1 2 3", "yy", "a", *[None] * 9), (3, None, "yy", "b", *[None] * 9), (4, "never kept", "yy", "c", *[None] * 9)]
    want = {"least": parameters.get("least_docs", 3), "ranks": parameters.get("term_ranks", 200)}
    got = sorted(map(tuple, divergence.audit(frame(spark, rows), **parameters).collect()), key=str)
    assert got == brute_audit(rows, **want)


def test_divergence_of_awkward_tables(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    assert divergence.audit(spark.createDataFrame([(None,) * 13] * 3, SCHEMA)).collect() == []


def test_divergence_of_a_hot_group(spark):
    """One term in all rows, one group with most rows, one very long text."""
    rows = [(k, "common " + ("common rare%d" % k if k % 3 else "common"), "en", "big" if k % 10 else f"s{k}", *[None] * 9) for k in range(600)]
    rows.append((601, "long " * 200_000 + "common", "en", "big", *[None] * 9))
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect()), key=str) == brute_audit(rows)


def test_terms_of_texts():
    """Texts end terms, empty texts and those without terms have none, slices of a batch are read from their place."""
    rng = np.random.default_rng(4)
    texts = ["", "A", "b", " c", "d ", "", "1", "\u00e9\u00c9Z", "e f", *["".join(rng.choice(list("aB \t1\u00df\U0001f600"), int(rng.integers(0, 9)))) for _ in range(300)], ""]
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for low in (0, 3):
        terms, places = divergence.terms_of(pa.array(texts).slice(low))
        want = [(k, w.encode()) for k, t in enumerate(texts[low:]) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(fold))]
        assert list(zip(places.tolist(), terms.to_pylist(), strict=True)) == want
    terms, places = divergence.terms_of(pa.array(["", "1 2"]))
    assert len(terms) == len(places) == 0


def test_runs_of_documents():
    """One row a term and group however often it occurs, with an empty term for each group, whatever the batches."""
    rng = np.random.default_rng(9)
    rows = [("en de fr".split()[int(rng.integers(3))], f"s{int(rng.integers(4))}", k, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 12))))) for k in range(200)]
    df, n = Counter(), Counter()
    for lang, source, _, text in rows:
        df.update({(lang, w, source) for w in text.split()})
        n.update((lang, w, source) for w in text.split())
        df[lang, "", source] = n[lang, "", source] = 0
    t = pa.table([pa.array(x) for x in zip(*rows)], ["lang", "source", "document", "text"])
    got = [r for b in divergence._folded()(iter(t.to_batches(7))) for r in b.to_pylist()]
    assert len(got) == len(df)
    assert {(r["lang"], r["term"], r["source"]): (r["df"], r["n"]) for r in got} == {k: (df[k], n[k]) for k in df}


def test_the_scan_is_ordered_by_numbers_first(spark):
    """Languages begin alike: a sort that begins with them compares whole strings."""
    plan = divergence.term_counts(frame(spark, [(1, "a b", "en", "x", *[None] * 9)]))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Sort \[at#\d+L ASC", plan)

"""N-gram Jaccard join: prefix-tree join over globally ordered sets of word shingles.

1. Each text becomes its set of 64-bit shingle hashes; texts with one set are one class (128-bit signature).
2. Global order: by how many classes hold a shingle, then by hash, so that only texts most of which is shared have candidates. All shingles are
   counted: packed by hash range (numpy blocks, deduplicated in each map task), dealt to buckets, and those that occur more than once
   go back to their block. Shingles that a bounded sample finds in many classes are not counted; they come last.
3. Two sets with 100 * intersection >= 75 * union share a shingle among the first n - ceil(0.75 n) + 1 of each (any fixed order is exact). What
   is left of these prefixes is packed and dealt to buckets again; a bucket chains classes that
   share a shingle and whose sizes allow a link: a chain, never all pairs.
4. Chains give candidate clusters (connected components: each task's edges as a spanning forest, then star contraction, distributed). Only their texts are shuffled.
5. Within a cluster the ordered sets stand in a trie. Sets walk it in blocks, sharing the overlap of common paths; a set leaves a subtree
   when overlap + what remains on both sides cannot reach the bound. Links unite labels.
   A cluster beyond max_cluster shingles is first thinned: all members are compared with a leader (salted join). Those that link to it
   are one component, and by the triangle inequality of Jaccard distance a member at distance r_m of it can
   link to a non-member at r_f only if r_m >= r_f - 0.25; whoever cannot matter any more leaves, and the rest are clustered anew. Where
   that leaves more than 0.7 of the shingles, members are dealt by size to chunks of half of max_cluster and each pair of chunks whose sizes allow a link is one trie.
6. Components of links give the result.

Defined results: null or blank text has an empty set, n_shingles 0, links with nothing and is its own component;
fewer than five words: the whole sequence is the one shingle; a very long text is one set like any other; other columns are not looked at, whatever their names; rows that repeat are equal sets, hence linked;
rows of one doc_id and different texts are different sets, each judged for itself;
a row whose doc_id is null takes no part in links and its component_id is null; empty table: empty result.
Hashes of 64 bits stand for shingles and 128 bits for sets: a false link needs a collision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import each_released, forget, pieces_of, released, small_batches, stored, stored_at, table, text_of

WORDS = 5
NUM, DEN = 75, 100
SAMPLE_DOCS = 8000
SAMPLE_LEAST = 3
COMMON_MOST = 1 << 17
MAX_CLUSTER = 8 << 20
BROADCAST_ROWS = 1_000_000
#: Up to so many edges, counted, a round of components broadcasts what nodes know.
BROADCAST_EDGES = 1 << 17
#: Edges that are joined to a forest at once.
FOREST_EDGES = 1 << 19
#: A hub has more than a HUBS-th of all edges, and more than HUB_LEAST.
HUBS, HUB_LEAST = 1024, 256
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles. bytes.lower() folds A-Z only and bytes.split() parts at
    the six ASCII white space characters only."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(one, tokens), np.uint64, len(tokens))
    if len(tokens) < words:
        acc = np.array([len(tokens)], np.uint64)
        for x in h:
            acc = _scramble(acc * _MIX[0] + x)
        return acc
    n = len(tokens) - words + 1
    acc = np.zeros(n, np.uint64)
    for j in range(words):
        acc = _scramble(acc * _MIX[j % 5] + h[j : j + n])
    return np.unique(acc)


def signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def prefix_length(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1 if n else 0


def ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set in global order: those in common (sorted) last, each part by hash."""
    if not len(common) or not len(s):
        return s
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    late = common[at] == s
    return np.concatenate([s[~late], s[late]])


def common_part(s: np.ndarray, common: np.ndarray) -> int:
    """How many of the set are in common (sorted)."""
    return int(np.isin(s, common, assume_unique=True).sum()) if len(common) else 0


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(x.as_py()) for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary())], ["doc_id", "digest", "n", "sig"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(x.as_py()) for x in b.column("text")]
        if sets and (every := np.concatenate(sets)).size:
            h, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def _steps(h: np.ndarray) -> bytes:
    """Sorted integers: the first, then 4-byte steps; 8 bytes each where a step is longer."""
    d = np.diff(h)
    if len(d) and d.max() >> np.uint64(32):
        return b"\x08" + h.tobytes()
    return b"\x04" + h[:1].tobytes() + d.astype(np.uint32).tobytes()


def _unsteps(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        return np.frombuffer(raw, np.uint64, offset=1)
    first = np.frombuffer(raw, np.uint64, 1, 1)
    return np.concatenate([first, first + np.cumsum(np.frombuffer(raw, np.uint32, offset=9), dtype=np.uint64)])


def _bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of 48-bit hashes by range."""
    return ((h >> np.uint64(16)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


PACKED = "bucket long, flush long, hashes binary, owners binary, sigs binary, sizes binary, n_late binary, late binary, late_owners binary"


def _packed_sets(common: np.ndarray, n_buckets: int, flush_at: int = 1_000_000):
    """All shingles (48 bits) of each class of a flush, packed by hash range, without those that are known to be common. One head row
    a flush has the classes, and the common shingles of those whose prefix reaches into them."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_flush = TaskContext.get().partitionId(), 0
        hashes, owners, sigs, sizes, n_late, late, index, held = [], [], [], [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            name = (task << 24) + n_flush
            h, o = np.concatenate(hashes), np.repeat(np.arange(len(hashes), dtype=np.uint16), [len(x) for x in hashes])
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order]
            cuts = np.flatnonzero(np.diff(_bucket_of(h, n_buckets))) + 1
            rows = [(int(_bucket_of(x[:1], n_buckets)[0]), name, _steps(x), y.tobytes(), None, None, None, None, None) for x, y in zip(np.split(h, cuts), np.split(o, cuts), strict=True) if len(x)]
            ends = np.repeat(np.arange(len(late), dtype=np.uint16), [len(x) for x in late])
            rows.append((name % n_buckets, name, None, None, b"".join(sigs), np.array(sizes, np.uint32).tobytes(), np.array(n_late, np.uint32).tobytes(), np.concatenate(late).tobytes(), ends.tobytes()))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]], [x.split()[0] for x in PACKED.split(", ")])

        for b in batches:
            for x in b.column("text"):
                s = shingle_set(x.as_py())
                if not len(s) or (sig := signature(s)) in index:
                    continue
                index[sig] = len(sigs)
                sigs.append(sig)
                sizes.append(len(s))
                in_order = ordered(s, common) >> np.uint64(16)
                early = len(s) - common_part(s, common)
                n_late.append(len(s) - early)
                hashes.append(in_order[:early])
                late.append(in_order[early : max(early, prefix_length(len(s)))])
                held += len(s)
                if held >= flush_at or len(sigs) == 60_000:
                    yield flush()
                    n_flush += 1
                    hashes, owners, sigs, sizes, n_late, late, index, held = [], [], [], [], [], [], {}, 0
        if held:
            yield flush()

    return packed


COUNTED = "flush long, hashes binary, owners binary, counts binary, sigs binary, sizes binary, n_late binary, late binary, late_owners binary"


def _counted(t: pa.Table) -> pa.Table:
    """One hash range: the shingles that occur more than once, with their number (255 at most), for each flush; head rows pass."""
    rows = []
    each = []
    for r in t.select([x.split()[0] for x in PACKED.split(", ")][1:]).to_pylist():
        if r["hashes"] is None:
            rows.append((r["flush"], None, None, None, *(r[k] for k in ("sigs", "sizes", "n_late", "late", "late_owners"))))
        else:
            each.append((r["flush"], _unsteps(r["hashes"]), np.frombuffer(r["owners"], np.uint16)))
    if each:
        _, back, n = np.unique(np.concatenate([h for _, h, _ in each]), return_inverse=True, return_counts=True)
        n, at = np.minimum(n, 255).astype(np.uint8)[back], 0
        for flush, h, o in each:
            mine = n[at : at + len(h)]
            at += len(h)
            if (more := mine > 1).any():
                rows.append((flush, _steps(h[more]), o[more].tobytes(), mine[more].tobytes(), None, None, None, None, None))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
    return pa.table([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=[x.split()[0] for x in COUNTED.split(", ")])


def _fronts(n_buckets: int):
    def fronts(t: pa.Table) -> pa.Table:
        """One flush: the prefix of each class in the order (number of occurrences, hash), without shingles that occur once; packed by
        hash range."""
        head = next(r for r in t.to_pylist() if r["sigs"] is not None)
        hs, os_, ns = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)], [np.empty(0, np.uint8)]
        for h, o, n in zip(t.column("hashes"), t.column("owners"), t.column("counts"), strict=True):
            if h.is_valid:
                hs.append(_unsteps(h.as_py()))
                os_.append(np.frombuffer(o.as_py(), np.uint16))
                ns.append(np.frombuffer(n.as_py(), np.uint8))
        h, o, n = np.concatenate(hs), np.concatenate(os_).astype(np.int64), np.concatenate(ns)
        sizes = np.frombuffer(head["sizes"], np.uint32).astype(np.int64)
        shared = np.bincount(o, minlength=len(sizes))
        single = sizes - np.frombuffer(head["n_late"], np.uint32) - shared
        take = sizes - -(-sizes * NUM // DEN) + 1 - single
        order = np.lexsort((h, n, o))
        h, o = h[order], o[order]
        inside = np.arange(len(o)) - (np.cumsum(shared) - shared)[o] < take[o]
        h = np.concatenate([h[inside], np.frombuffer(head["late"], np.uint64)])
        o = np.concatenate([o[inside], np.frombuffer(head["late_owners"], np.uint16).astype(np.int64)])
        order = np.argsort(h, kind="stable")
        h, o = h[order], o[order]
        cuts = np.flatnonzero(np.diff(_bucket_of(h, n_buckets))) + 1
        sigs = np.frombuffer(head["sigs"], np.uint8).reshape(-1, 16)
        rows = []
        for x, y in zip(np.split(h, cuts), np.split(o, cuts), strict=True):
            if len(x):
                own, local = np.unique(y, return_inverse=True)
                rows.append((int(_bucket_of(x[:1], n_buckets)[0]), x.tobytes(), local.astype(np.uint32).tobytes(), sigs[own].tobytes(), sizes[own].astype(np.uint32).tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "hashes", "owners", "sigs", "sizes"])

    return fronts


def candidate_edges(texts: DataFrame, common: np.ndarray, n_buckets: int) -> DataFrame:
    """Edges (a, b) that connect the classes whose prefixes share a shingle, for all texts; a bucket's are a forest, and buckets may repeat edges."""
    counted = texts.select("text").mapInArrow(released(_packed_sets(common, n_buckets)), PACKED).groupBy("bucket").applyInArrow(each_released(_counted), COUNTED)
    fronts = counted.groupBy("flush").applyInArrow(each_released(_fronts(n_buckets)), "bucket long, hashes binary, owners binary, sigs binary, sizes binary")
    return fronts.groupBy("bucket").applyInArrow(each_released(_chains), "a binary, b binary")


def _chains(t: pa.Table) -> pa.Table:
    """Within one bucket: classes that share a shingle, ordered by size, each with the next if their sizes allow a link; of these chains a spanning forest."""
    hashes, owners, sigs, sizes, base = [], [], [], [], 0
    for h, o, s, z in zip(*(t.column(c) for c in ("hashes", "owners", "sigs", "sizes")), strict=True):
        hashes.append(np.frombuffer(h.as_py(), np.uint64))
        owners.append(np.frombuffer(o.as_py(), np.uint32).astype(np.int64) + base)
        sigs.append(np.frombuffer(s.as_py(), "V16"))
        sizes.append(np.frombuffer(z.as_py(), np.uint32))
        base += len(sizes[-1])
    h, o, sig, n = np.concatenate(hashes), np.concatenate(owners), np.concatenate(sigs), np.concatenate(sizes).astype(np.int64)
    # keep only hashes that occur twice before sorting by size
    order = np.argsort(h, kind="stable")
    h, o = h[order], o[order]
    twice = np.zeros(len(h), bool)
    twice[1:] = h[1:] == h[:-1]
    twice[:-1] |= twice[1:]
    h, o = h[twice], o[twice]
    order = np.lexsort((o, n[o], h))
    h, o = h[order], o[order]
    near = (h[1:] == h[:-1]) & (DEN * n[o[:-1]] >= NUM * n[o[1:]])
    pairs = np.stack([o[:-1][near], o[1:][near]], axis=1)
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    a, b = sig[pairs[:, 0]] if len(pairs) else sig[:0], sig[pairs[:, 1]] if len(pairs) else sig[:0]
    differ = a != b
    a, b = a[differ], b[differ]
    return _forest(pa.table({"a": pa.array([x.tobytes() for x in a], pa.binary()), "b": pa.array([x.tobytes() for x in b], pa.binary())}))


def _forest(edges: pa.Table) -> pa.Table:
    """The least node of each component of the edges (a, b), with each of its other nodes."""
    a, b = (edges.column(k).combine_chunks() for k in ("a", "b"))
    codes = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(codes.dictionary)
    nodes, rank = codes.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    x, y = np.split(rank[codes.indices.to_numpy()], 2)
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        # roots meet at the least root that they have an edge to
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while len(np.flatnonzero(root != root[root])):
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": nodes.take(pa.array(root[below])), "b": nodes.take(pa.array(below))})


def _forests(most: int):
    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's edges as forests of at most so many edges."""
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                one = _forest(pa.Table.from_batches(held))
                # a forest that leaves little room goes out, else the next edges join it
                if one.num_rows > most // 2:
                    yield from one.combine_chunks().to_batches()
                    one = one.slice(0, 0)
                held, n = one.to_batches(), one.num_rows
        if held:
            yield from _forest(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return forests


def _met(edges: DataFrame, key: str, least: DataFrame, n: int) -> DataFrame:
    """The edges (a, b) with m, which least (k, m) holds for their column key, else null. Few edges know few nodes, which are broadcast. Else, of n edges, fewer than HUBS nodes have more than
    n / HUBS: these hubs' m is broadcast, so that no task gets all edges of a hub; other nodes meet theirs by shuffle."""
    if n <= BROADCAST_EDGES:
        return edges.join(F.broadcast(least), F.col(key) == F.col("k"), "left").select("a", "b", "m")
    hubs = edges.groupBy(F.col(key).alias("hub")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(HUB_LEAST, n // HUBS)).select("hub")
    known = F.broadcast(hubs.join(least, F.col("hub") == F.col("k"), "left").select("hub", "m"))
    of_hubs = edges.join(known, F.col(key) == F.col("hub")).select("a", "b", "m")
    rest = edges.join(known, F.col(key) == F.col("hub"), "left_anti")
    return of_hubs.unionAll(rest.join(least, F.col(key) == F.col("k"), "left").select("a", "b", "m"))


def _unsettled(e: DataFrame) -> tuple[int, int]:
    """Of distinct edges a < b: how many there are, and how many nodes still keep them from being stars around the least node of each component."""
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("below")), F.struct(F.col("b").alias("node"), F.lit(1).alias("below")))).alias("s")).select("s.node", "s.below")
    each = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("__n"))
    n, loose = each.agg(F.coalesce(F.sum("below"), F.lit(0)), F.count_if((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("__n") > 1)))).first()
    return int(n), int(loose)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node and the smallest node of its component, for the edges (a, b). Each task's edges become a forest; then large-star and small-star steps alternate until
    all edges are stars. Each step's edges are a table in the shared folder, which goes when the next is written."""
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    e, at = stored_at(edges.select("a", "b").where("a <> b").mapInArrow(released(_forests(FOREST_EDGES)), f"a {kind}, b {kind}").distinct())
    for _ in range(max_rounds):
        n, loose = _unsettled(e)
        if not loose:
            break
        smaller = e.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("m"))
        # large star: a node's larger neighbours meet at its smallest neighbour, or at itself where it has no smaller one
        large, large_at = stored_at(_met(e, "a", smaller, n).select(F.coalesce("m", "a").alias("a"), "b").distinct())
        forget(spark, at)
        # small star: a larger node's smaller neighbours meet at the smallest of them
        least = large.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("m"))
        small = _met(large, "b", least, n).select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        e, at = stored_at(small)
        forget(spark, large_at)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _in_tree_order(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The prefix tree of the sets. Its paths are the elements that two sets or more hold, as ranks in the order (in common, number of sets,
    hash), rare ones first. Returns the order of the sets along the tree's leaves, their paths in that order, and how much of a path its predecessor shares."""
    every = np.concatenate(sets)
    h, back, n = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n, (n > 1) & np.isin(h, common)))] = np.arange(len(h))
    lonely = int((n == 1).sum())
    ranks = rank[back] - lonely
    paths = [np.sort(x[x >= 0]) for x in np.split(ranks, np.cumsum([len(s) for s in sets])[:-1])]
    order = np.array(sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes()))
    paths = [paths[i] for i in order]
    shared = np.zeros(len(paths), np.int64)
    for i, (x, y) in enumerate(zip(paths, paths[1:]), 1):
        k = min(len(x), len(y))
        apart = np.flatnonzero(x[:k] != y[:k])
        shared[i] = apart[0] if len(apart) else k
    return order, paths, shared


def _tree_join(sets: list[np.ndarray], common: np.ndarray, label: np.ndarray, matrix_bytes: int = 64 << 20, step: int = 64) -> None:
    """Joins all sets and writes the components of their links to label (changed in place). A block of sets walks the tree at once: a node's overlap with each set
    of the block is counted once for all paths below it, and a set leaves a subtree when overlap + what remains on both sides cannot reach the
    bound, when the sizes below do not allow a link, or, at a leaf, when both are of one component already. A set looks only at those before it."""
    order, paths, shared = _in_tree_order(sets, common)
    sizes = np.array([len(sets[i]) for i in order])
    lengths = np.array([len(x) for x in paths])
    label_of = label[order]
    width = int(max((x[-1] for x in paths if len(x)), default=-1)) + 1
    block = int(np.clip(matrix_bytes // max(1, width), 8, 512))
    for low in range(0, len(paths), block):
        high = min(low + block, len(paths))
        mine = paths[low:high]
        column = np.repeat(np.arange(high - low), lengths[low:high])
        element = np.concatenate(mine)
        holds = np.zeros((width, high - low), np.uint8)
        holds[element, column] = 1
        # a set's place in the order: how many of its elements come up to a rank
        flat, starts = column * width + element, np.cumsum(lengths[low:high]) - lengths[low:high]
        n, length = sizes[low:high], lengths[low:high]
        everyone = np.arange(high - low)
        stack = [(0, high, 0, everyone, np.zeros(high - low, np.int64))]
        while stack:
            first, end, depth, active, overlap = stack.pop()
            stop = lengths[first] if end - first == 1 else min(lengths[first], int(shared[first + 1 : end].min()))
            least_size, most_size, longest = sizes[first:end].min(), sizes[first:end].max(), lengths[first:end].max()
            keep = (active + low > first) & (DEN * most_size >= NUM * n[active]) & (DEN * n[active] >= NUM * least_size)
            if end - first == 1:
                keep &= label_of[low + active] != label_of[first]
            active, overlap = active[keep], overlap[keep]
            # what a pair of sizes n, m needs: overlap >= 75 (n + m) / 175; the smallest m below needs least
            least = -(-NUM * (n[active] + np.maximum(least_size, -(-NUM * n[active] // DEN))) // (DEN + NUM))
            while len(active) and depth < stop:
                run = paths[first][depth : min(stop, depth + step)]
                depth += len(run)
                overlap = overlap + holds[run].sum(0, dtype=np.uint8)[active]
                passed = np.searchsorted(flat, active * width + run[-1], "right") - starts[active]
                keep = overlap + np.minimum(length[active] - passed, longest - depth) >= least
                active, overlap, least = active[keep], overlap[keep], least[keep]
            if not len(active):
                continue
            at = first
            while at < end and lengths[at] == stop:
                linked = label_of[low + active[(active + low > at) & ((NUM + DEN) * overlap >= NUM * (n[active] + sizes[at]))]]
                others = np.unique(linked[linked != label_of[at]])
                if len(others):
                    label_of[np.isin(label_of, others)] = label_of[at]
                at += 1
            if at < end:
                cuts = [at, *(at + 1 + np.flatnonzero(shared[at + 1 : end] == stop)).tolist(), end]
                stack += [(x, y, stop, active, overlap) for x, y in zip(cuts, cuts[1:])]
    label[order] = label_of


def _linked_to(leader: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Overlap of each (hash-sorted) set with the leader."""
    every = np.concatenate(sets)
    at = np.searchsorted(leader, every)
    at[at == len(leader)] = 0
    hit = leader[at] == every
    ends = np.cumsum([len(s) for s in sets])
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[ends] - total[ends - np.array([len(s) for s in sets])]


def join_cluster(sets: list[np.ndarray], common: np.ndarray) -> list[int]:
    """The root (a set's number) of each of the distinct non-empty sets under links. Members near a leader are united with it and set
    aside as far as the triangle inequality allows; the tree joins the rest."""
    label = np.arange(len(sets))
    left = np.arange(len(sets))
    while len(left) > 16:
        group = [sets[i] for i in left]
        sizes = np.array([len(s) for s in group])
        lead = int(np.argmax(sizes)) if len(left) > 64 else 0
        over = _linked_to(group[lead], group)
        union = sizes + sizes[lead] - over
        near = DEN * over >= NUM * union
        label[np.isin(label, label[left[near]])] = label[left[lead]]
        r = 1 - over / union
        far = r[~near]
        # a little slack keeps rounding from setting a pair aside
        needed = ~near | (r >= (far.min() if len(far) else 9.0) - (1 - NUM / DEN) - 1e-9)
        needed[lead] = False
        few = near.sum() < 4 and needed.sum() > 0.9 * len(left)
        left = left[needed]
        if few:
            break
    if len(left) > 1:
        # components so far, as labels of those that are left; what the tree unites is then united everywhere
        found = label[left].copy()
        _tree_join([sets[i] for i in left], common, found)
        place = np.arange(len(sets))
        place[label[left]] = found
        label = place[label]
    return label.tolist()


def _joined(common: np.ndarray):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cluster; one cluster's sets are held at a time."""
        cluster, sigs, sets = None, [], []

        def out() -> pa.RecordBatch:
            roots = join_cluster(sets, common)
            pairs = [(sigs[i], sigs[r]) for i, r in enumerate(roots) if r != i]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

        for b in batches:
            for c, s, x in zip(b.column("cluster"), b.column("sig"), b.column("text"), strict=True):
                if c.as_py() != cluster:
                    if len(sets) > 1:
                        yield out()
                    cluster, sigs, sets = c.as_py(), [], []
                mine = shingle_set(x.as_py())
                if signature(mine) == s.as_py():  # else the digests of two texts of one doc_id collide
                    sigs.append(s.as_py())
                    sets.append(mine)
        if len(sets) > 1:
            yield out()

    return links


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, lead, r: distance of a member's set to its leader's."""
    leaders: dict[bytes, np.ndarray] = {}
    for b in batches:
        rows = []
        for s, k, x, y in zip(b.column("sig"), b.column("lead"), b.column("text"), b.column("lead_text"), strict=True):
            s, k = s.as_py(), k.as_py()
            if k not in leaders:
                leaders = {k: shingle_set(y.as_py())}
            mine, its = shingle_set(x.as_py()), leaders[k]
            if signature(mine) != s or signature(its) != k:
                continue
            over = int(_linked_to(its, [mine])[0])
            union = len(mine) + len(its) - over
            rows.append((s, k, 1 - over / union, DEN * over >= NUM * union))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], ["sig", "lead", "r", "near"])


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and its digest, which tells apart the texts of one doc_id."""
    return docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("digest"))


def classes(nodes: DataFrame, *more) -> DataFrame:
    """One row for each set, of nodes (doc_id, digest, n, sig): sig, the row that stands for it (doc_id, digest, and its copies of one id and text), n, its rows, and more aggregates."""
    each = nodes.where("n > 0 and doc_id is not null").groupBy("sig", "doc_id", "digest").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), *more)
    kept = [c for c in each.columns if c not in ("sig", "doc_id", "digest", "n", "copies")]
    found = each.groupBy("sig").agg(F.min(F.struct("doc_id", "digest", "copies")).alias("s"), F.first("n").alias("n"), F.sum("copies").alias("rows"), *[F.first(c, True).alias(c) for c in kept])
    return found.select("sig", "s.doc_id", "s.digest", "s.copies", "n", "rows", *kept)


def chunk_pairs(clusters: DataFrame, large: DataFrame, max_cluster: int) -> DataFrame:
    """The members of large clusters (cluster, size), dealt by set size to chunks of half of max_cluster shingles, once for each pair of chunks whose sizes allow a link; cluster then names the pair. A chunk
    that pairs with no other is one by itself. A chunk's sizes are a range, so a member goes to few pairs, not to as many as there are chunks."""
    members = clusters.join(large.select("cluster"), "cluster").select("sig", "doc_id", "digest", "copies", "n", "cluster")
    # a row for each size that occurs, with what stands before it
    sizes = members.groupBy("cluster", "n").agg(F.sum("n").alias("__here"))
    before = F.sum("__here").over(Window.partitionBy("cluster").orderBy("n")) - F.col("__here")
    sizes = sizes.select("cluster", "n", "__here", before.alias("__before"))
    # many sets of one size are dealt by hash
    place = F.col("__before") + F.col("__here") * F.pmod(F.xxhash64("sig", F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    members = stored(members.join(sizes, ["cluster", "n"]).withColumn("chunk", F.floor(2 * place / max_cluster).cast("long")).drop("__here", "__before"))
    chunks = stored(members.groupBy("cluster", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    upper = chunks.select("cluster", F.col("chunk").alias("other"), F.col("low").alias("other_low"))
    pairs = chunks.join(upper, "cluster").where((F.col("chunk") < F.col("other")) & (DEN * F.col("high") >= NUM * F.col("other_low")))
    name = F.concat_ws("-", "chunk", "other").cast("binary")
    pairs = pairs.select("cluster", F.explode(F.array("chunk", "other")).alias("chunk"), name.alias("pair"))
    alone = chunks.join(pairs, ["cluster", "chunk"], "left_anti").select("cluster", "chunk", F.col("chunk").cast("string").cast("binary").alias("pair"))
    return members.join(pairs.unionAll(alone), ["cluster", "chunk"]).select("sig", "doc_id", "digest", "copies", "n", F.concat("cluster", "pair").alias("cluster"))


def link_components(docs: DataFrame, max_cluster: int = MAX_CLUSTER, sample_docs: int = SAMPLE_DOCS, salts: int = 16) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    return linked(docs, max_cluster, sample_docs, salts).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, max_cluster: int = MAX_CLUSTER, sample_docs: int = SAMPLE_DOCS, salts: int = 16) -> DataFrame:
    """One row for each row of docs: doc_id, digest (of its text), n_shingles, component_id, component_digest (of the text of the component's first row)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs)
    nodes = stored(rows.mapInArrow(released(_sets), "doc_id long, digest long, n long, sig binary"))
    n_rows, n_shingles = nodes.agg(F.count(F.lit(1)), F.sum("n")).first()
    # the order's sample: bounded, and of no effect on which pairs link
    part = min(1.0, sample_docs / max(1, n_rows))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    often = sample.mapInArrow(released(_sampled), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_LEAST).orderBy(F.col("n").desc(), "h").limit(COMMON_MOST)
    common = np.sort(np.array([r.h for r in often.select("h").collect()], np.int64).view(np.uint64))
    n_buckets = pieces_of(spark, int(n_shingles or 0) * 8, 12 << 20)
    edges = stored(candidate_edges(rows.where("doc_id is not null"), common, n_buckets))
    # one row stands for each class; written, since each round asks for it
    stand = stored(classes(nodes))
    proven: list[DataFrame] = []
    before = None
    while True:
        clusters = stored(components(edges).select(F.col("node").alias("sig"), F.col("root").alias("cluster")).join(stand, "sig"))
        large = clusters.groupBy("cluster").agg(F.sum("n").alias("size"), F.max(F.struct("n", "sig")).alias("lead")).where(F.col("size") > max_cluster)
        large = stored(large.select("cluster", F.col("lead.sig").alias("lead"), "size"))
        now = large.agg(F.sum("size")).first()[0] or 0
        held = clusters.join(large, "cluster", "left_anti")
        if before is not None and now > 0.7 * before:
            # leaders no longer thin these out: each pair of chunks is one task's work
            held = held.select("sig", "doc_id", "digest", "copies", "n", "cluster").unionAll(chunk_pairs(clusters, large, max_cluster))
            large, now = large.limit(0), 0
        n_held = clusters.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        proven.append(stored(with_text(rows, held).repartition(pieces_of(spark, n_held * 16, 12 << 20), "cluster").sortWithinPartitions("cluster").mapInArrow(released(_joined(common)), "a binary, b binary")))
        if not now:
            break
        before = now
        # one distributed round against a leader; leaders are repeated over salts, members dealt to them
        crowd = stored(with_text(rows, clusters.join(large, "cluster")))
        members = crowd.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(salts)))
        leaders = crowd.where("sig = lead").select("lead", F.col("text").alias("lead_text"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        far = stored(members.join(leaders, ["lead", "salt"]).select("sig", "lead", "text", "lead_text").mapInArrow(released(_distances), "sig binary, lead binary, r double, near boolean"))
        proven.append(far.where("near and sig <> lead").select(F.col("sig").alias("a"), F.col("lead").alias("b")))
        least = far.where("not near").groupBy("lead").agg(F.min("r").alias("r_far"))
        rest = far.join(least, "lead").where(~F.col("near") | (F.col("r") >= F.col("r_far") - (1 - NUM / DEN) - 1e-9)).where("sig <> lead").select("sig")
        rest = stored(rest)
        # written, since the places of its rows name them
        again = stored(with_text(rows, stand.join(rest, "sig")).select("text"))
        edges = stored(candidate_edges(again, common, n_buckets))
    links = proven[0]
    for more in proven[1:]:
        links = links.unionAll(more)
    return by_row(nodes, stand, links)


def by_row(nodes: DataFrame, stand: DataFrame, links: DataFrame) -> DataFrame:
    """The components of links (a, b: signatures) for each row of nodes."""
    roots = components(links)
    # one row a class, until classes meet their rows: a join that Spark can split where a class has many rows
    of_class = stored(stand.join(roots, F.col("sig") == F.col("node")).select("sig", "root", "doc_id", "digest"))
    least = stored(of_class.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first")))
    joined = of_class.join(least, "root").select(F.col("sig").alias("__sig"), "first")
    several = stand.join(joined, F.col("sig") == F.col("__sig"), "left").where("rows > 1 or first is not null").select(F.col("sig").alias("__sig"), F.coalesce("first", F.struct("doc_id", "digest")).alias("first"))
    out = nodes.join(stored(several), (F.col("sig") == F.col("__sig")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    # the empty set is no class: each such row is its own component
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), F.coalesce("first.digest", "digest").alias("component_digest"))


def representatives(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that stand for their component (the smallest doc_id, then the smallest digest of the text), with all columns. Rows go by doc_id and text, so that of the rows of
    one doc_id each text is judged for itself; rows of one doc_id and text stay or go together; rows without a link stay, those with a null doc_id too."""
    links = linked(docs, **parameters)
    gone = links.where("doc_id <> component_id or digest <> component_digest").select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest")).distinct()
    # counted: a small table of ids is broadcast, a large one joined by shuffle
    gone = stored(gone)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.xxhash64(text_of()) == F.col("__digest")), "left_anti")


def with_text(rows: DataFrame, wanted: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """wanted (doc_id, digest, copies, sig, cluster and more) with one text for each row. Ids are broadcast if they are counted to be few, else joined by shuffle. Where
    rows of one doc_id and text repeat, one of them is taken."""
    others = [c for c in wanted.columns if c not in ("doc_id", "digest", "copies", "n", "rows")]
    ids = wanted.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("copies").alias("__copies"), *others)
    n, repeated = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("__copies") > 1, 1)), F.lit(0))).first()

    def found(ids: DataFrame, n: int) -> DataFrame:
        every = rows.where("doc_id is not null").join(F.broadcast(ids) if n <= broadcast_rows else ids, (F.col("doc_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")))
        return every.select("text", *others)

    if not repeated:
        return found(ids, n)
    once = found(ids.where("__copies > 1"), repeated).groupBy(*others).agg(F.first("text").alias("text")).select("text", *others)
    return found(ids.where("__copies = 1"), n).unionAll(once)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))

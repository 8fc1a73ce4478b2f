"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of 64-bit shingle hashes and a signature of HASHES minima; texts with one set are one class.
2. BANDS bands of ROWS minima deal classes to buckets. Two sets at the threshold of 0.85 miss all buckets with a probability of (1 - 0.85^5)^28 < 10^-7.
3. Rounds of leaders: in each bucket one member, the smallest by hash, is the leader, so that candidates are as many as members, never all pairs. A candidate pair's signatures
   are compared batch by batch: after n minima with m matches the posterior of the similarity, from a uniform prior, is Beta(m + 1, n - m + 1), and a pair leaves when P(similarity >= 0.85) is
   below `miss`. Survivors are verified on their full sets: members meet their leader's text in a stream, salted where a leader has many.
4. A member that links to its leader has an exact distance, one that left has a lower bound of it from the same posterior. By the triangle
   inequality of Jaccard distance a linked member at distance r matters only to members at r + 0.15 or nearer, so members that no unlinked one can reach leave their bucket. The leader
   leaves too. Rounds go on while they thin out the buckets.
5. What is left of the buckets is chained to clusters, and the texts of these alone are shuffled. In a cluster all sets, ordered by size, are compared by the same
   batches, those most alike are verified first, and links unite labels, so that components which are known already cost nothing. A large cluster is dealt to chunks, and each pair of chunks
   is one task's work: nothing is capped.
6. Components of links give the result.

Defined results: null or blank text has an empty set, n_shingles 0, links with nothing and is its own component; fewer than five words: the whole sequence is the one
shingle; a very long text is one set like any other; rows that repeat are equal sets, hence linked; rows of one doc_id and different texts are different sets, each judged for itself; a row
whose doc_id is null takes no part in links, its component_id is null and it is kept; empty table: empty result; other columns are not looked at, whatever their names. Every link of
the result is confirmed on full sets; a link is missed only by all bands or by a batch, with the probabilities above.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_of, released, small_batches, stored, table
from .ngram_join import _linked_to, by_row, classes, components, shingle_set, signature, texts, with_text

NUM, DEN = 85, 100
BANDS, ROWS, BATCH, HASHES = 28, 5, 32, 160
#: The chance that a batch drops a pair at the threshold.
MISS = 1e-7
#: Members a leader's salt takes, members and shingles of a chunk, and the part of all members below which another round of leaders is worth its cost.
SALT_ROWS, CHUNK_ROWS, CHUNK_SHINGLES, THINNED = 256, 512, 1 << 20, 0.7
_RNG = np.random.default_rng(20)
_FACTORS, _TERMS = (_RNG.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)), _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
SLACK = 1e-9


def minima(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set of 64-bit hashes, each under a multiplication and an addition of its own."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for low in range(0, len(x), 256):
        part = x[low : low + 256, None] * _FACTORS
        part += _TERMS
        np.minimum(out, part.min(0), out=out)
    return out


@functools.cache
def bounds(miss: float = MISS) -> tuple[list[int], list[np.ndarray]]:
    """For each batch's end n: the fewest matches with which a pair stays, and for each number of matches the similarity that it exceeds with
    probability miss at most. P(similarity >= t | m of n) is that of at most m successes in n + 1 trials of t."""
    least, most = [], []
    grid = np.linspace(0, 1, 2001)[1:-1, None]
    for n in range(BATCH, HASHES + 1, BATCH):
        k = np.arange(n + 2)
        ways = np.array([math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) for i in k])
        tail = np.cumsum(np.exp(ways + k * np.log(grid) + (n + 1 - k) * np.log1p(-grid)), 1)[:, : n + 1]
        t = NUM / DEN
        at = np.cumsum(np.exp(ways + k * math.log(t) + (n + 1 - k) * math.log1p(-t)))[: n + 1]
        least.append(int(np.argmax(at >= miss)))
        below = tail < miss  # for each number of matches from some similarity on
        most.append(np.where(below.any(0), grid[np.argmax(below, 0), 0], 1.0))
    return least, most


def sifted(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, miss: float = MISS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of signatures (rows of a and b) and sizes: which of them stay after all batches, an upper bound of each one's similarity, and the matches counted."""
    least, most = bounds(miss)
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    upper = small / large
    alive = np.flatnonzero(DEN * small >= NUM * large)
    matches = np.zeros(len(na), np.int64)
    for k, (need, bound) in enumerate(zip(least, most, strict=True)):
        if not len(alive):
            break
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        stay = matches[alive] >= need
        out = alive[~stay]
        upper[out] = np.minimum(upper[out], bound[matches[out]])
        alive = alive[stay]
    stays = np.zeros(len(na), bool)
    stays[alive] = True
    return stays, upper, matches


def links_of(overlap: int, n: int, m: int) -> bool:
    return DEN * overlap >= NUM * (n + m - overlap)


@released
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, digest, n, sig, and the minima where this task sees a set for the first time in a while."""
    seen: set[bytes] = set()
    for b in batches:
        n, sigs, mins = [], [], []
        for x in b.column("text"):
            s = shingle_set(x.as_py())
            n.append(len(s))
            sigs.append(signature(s))
            mins.append(minima(s).tobytes() if len(s) and sigs[-1] not in seen else None)
            seen.add(sigs[-1])
        if len(seen) > 100_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(mins, pa.binary())], ["doc_id", "digest", "n", "sig", "mins"])


def _signatures(c: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, HASHES)


SIFTED = "h long, lead long, sig binary, lead_sig binary, stays boolean, upper double"


def _sift(miss: float):
    @released
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays, upper, _ = sifted(_signatures(b.column("mins")), _signatures(b.column("lead_mins")), b.column("n").to_numpy(), b.column("lead_n").to_numpy(), miss)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "lead", "sig", "lead_sig")), pa.array(stays), pa.array(upper)], [x.split()[0] for x in SIFTED.split(", ")])

    return sift


@released
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order (lead_sig, salt, the leader first): the exact distance of each member to its leader, and whether they link."""
    now, its = None, np.empty(0, np.uint64)
    for b in batches:
        found = []
        for lead, sig, text in zip(b.column("lead_sig"), b.column("sig"), b.column("text"), strict=True):
            lead, sig, mine = lead.as_py(), sig.as_py(), shingle_set(text.as_py())
            if signature(mine) != sig:
                continue
            if sig == lead:
                now, its = lead, mine
            elif now == lead:
                over = int(_linked_to(its, [mine])[0])
                found.append((sig, lead, 1 - over / (len(mine) + len(its) - over), links_of(over, len(mine), len(its))))
        cols = list(zip(*found, strict=True)) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.float64(), pa.bool_()), strict=True)], ["sig", "lead_sig", "r", "near"])


def unite(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray | None = None, miss: float = MISS) -> list[tuple[int, int]]:
    """Links (places in sets) that join what labels (changed in place) holds apart: sets in order of size, each against the later ones whose size allows a link, by
    batches of minima; those that stay are verified exactly, the most alike first, while their labels differ. With side, only pairs of both sides."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    mins = np.stack([minima(sets[i]) for i in order])
    n = sizes[order]
    ends = np.searchsorted(NUM * n, DEN * n, "right")
    out = []
    for k, i in enumerate(order):
        others = np.arange(k + 1, ends[k])
        others = others[labels[order[others]] != labels[i]]
        if side is not None:
            others = others[side[order[others]] != side[i]]
        if not len(others):
            continue
        stays, _, matches = sifted(np.broadcast_to(mins[k], (len(others), HASHES)), mins[others], np.full(len(others), n[k]), n[others], miss)
        kept = others[stays][np.argsort(-matches[stays], kind="stable")]
        for j in order[kept]:
            if labels[i] != labels[j]:
                over = int(_linked_to(sets[i], [sets[j]])[0])
                if links_of(over, sizes[i], sizes[j]):
                    out.append((int(i), int(j)))
                    labels[labels == labels[j]] = labels[i]
    return out


def _united(miss: float):
    @released
    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by unit (cluster, i, j); one unit's sets are held at a time."""
        unit, sigs, sets, labels, sides = None, [], [], [], []

        def out() -> pa.RecordBatch:
            names = {x: k for k, x in enumerate(dict.fromkeys(labels))}
            found = unite(sets, np.array([names[x] for x in labels]), None if unit[1] == unit[2] else np.array(sides), miss)
            return pa.RecordBatch.from_arrays([pa.array([sigs[a] for a, _ in found], pa.binary()), pa.array([sigs[b] for _, b in found], pa.binary())], ["a", "b"])

        for b in batches:
            for c, i, j, sig, label, side, text in zip(*(b.column(x) for x in ("cluster", "i", "j", "sig", "label", "side", "text")), strict=True):
                here = (c.as_py(), i.as_py(), j.as_py())
                if here != unit:
                    if len(sets) > 1:
                        yield out()
                    unit, sigs, sets, labels, sides = here, [], [], [], []
                mine = shingle_set(text.as_py())
                if signature(mine) == sig.as_py():
                    sigs.append(sig.as_py())
                    sets.append(mine)
                    labels.append(label.as_py())
                    sides.append(side.as_py())
        if len(sets) > 1:
            yield out()

    return united


def verified(rows: DataFrame, stand: DataFrame, pairs: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """pairs (sig, lead_sig): sig, lead_sig, r (exact distance), near. Members stream past their leader's set, in as many streams as its members need."""
    salts = pairs.groupBy("lead_sig").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("long").alias("salts"))
    ids = stand.select("sig", "doc_id", "digest", "copies")
    members = pairs.join(ids, "sig").join(salts, "lead_sig").withColumn("salt", F.pmod(F.xxhash64("sig"), F.col("salts")))
    leads = salts.join(ids.withColumnRenamed("sig", "lead_sig"), "lead_sig").withColumn("sig", F.col("lead_sig")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    columns = ["sig", "lead_sig", "salt", "doc_id", "digest", "copies"]
    wanted = stored(members.select(columns).unionAll(leads.select(columns)))
    n = wanted.count()
    found = with_text(rows, wanted).withColumn("rest", F.col("sig") != F.col("lead_sig"))
    dealt = found.repartition(pieces_of(rows.sparkSession, n * 4096, 16 << 20), "lead_sig", "salt").sortWithinPartitions("lead_sig", "salt", "rest")
    return stored(dealt.select("lead_sig", "sig", "text").mapInArrow(_verify, "sig binary, lead_sig binary, r double, near boolean"))


def near_links(rows: DataFrame, stand: DataFrame, miss: float = MISS, salt_rows: int = SALT_ROWS, chunk_rows: int = CHUNK_ROWS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """Links (a, b: signatures) whose components are those of all links. stand: sig, doc_id, digest, copies, n, mins of each class."""
    spark = rows.sparkSession
    known = stand.select(F.xxhash64("sig").alias("h"), "sig", "n", "mins")
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("mins", 1 + 4 * ROWS * k, 4 * ROWS)) for k in range(BANDS)])
    dealt = known.select("h", F.explode(keys).alias("key"))
    shared = lambda at: at.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("h").alias("lead")).where("members > 1")
    # what is counted by key is written before it meets the keys' members, so that Spark can split the join where a key has many
    open_ = stored(dealt.join(stored(shared(dealt)), "key").select("key", "h", "lead", "members"))
    links, left = [], None
    while True:
        n, most = open_.agg(F.count(F.lit(1)), F.max("members")).first()
        if not n or (left is not None and (n > THINNED * left or most <= chunk_rows)):
            break
        left = n
        pairs = open_.where("h <> lead").select("h", "lead").distinct()
        side = known.select(F.col("h").alias("lead"), F.col("sig").alias("lead_sig"), F.col("n").alias("lead_n"), F.col("mins").alias("lead_mins"))
        judged = stored(pairs.join(known, "h").join(side, "lead").mapInArrow(_sift(miss), SIFTED))
        exact = verified(rows, stand, judged.where("stays").select("sig", "lead_sig"), salt_rows)
        links.append(exact.where("near").select(F.col("sig").alias("a"), F.col("lead_sig").alias("b")))
        far = judged.where("not stays").select("h", "lead", (1 - F.col("upper")).alias("r"), F.lit(False).alias("near"))
        judged = far.unionAll(exact.select(F.xxhash64("sig").alias("h"), F.xxhash64("lead_sig").alias("lead"), "r", "near"))
        placed = stored(open_.where("h <> lead").join(judged, ["h", "lead"]).select("key", "h", "r", "near"))
        nearest = stored(placed.where("not near").groupBy("key").agg(F.min("r").alias("r_far")))
        rest = placed.join(nearest, "key").where(~F.col("near") | (F.col("r") >= F.col("r_far") - (1 - NUM / DEN) - SLACK)).select("key", "h")
        rest = stored(rest)
        open_ = stored(rest.join(stored(shared(rest)), "key").select("key", "h", "lead", "members"))
    found = functools.reduce(DataFrame.unionAll, links) if links else spark.createDataFrame([], "a binary, b binary")
    if not n:
        return found
    # what is left: buckets chain their members to clusters, whose texts are compared in units
    labels = components(found)
    name = known.select("h", "sig")
    chains = open_.where("h <> lead").select("h", "lead").distinct().join(name, "h").join(name.select(F.col("h").alias("lead"), F.col("sig").alias("lead_sig")), "lead")
    clusters = components(chains.select(F.col("sig").alias("a"), F.col("lead_sig").alias("b"))).select(F.col("node").alias("sig"), F.col("root").alias("cluster"))
    members = clusters.join(stand.select("sig", "doc_id", "digest", "copies", "n"), "sig").join(labels.select(F.col("node").alias("sig"), F.col("root").alias("label")), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    members = stored(members)
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / chunk_rows), F.ceil(F.sum("n") / chunk_shingles)).cast("long")
    sizes = members.groupBy("cluster").agg(chunks.alias("chunks"), F.count_distinct("label").alias("labels")).where("labels > 1").select("cluster", "chunks")
    chunk = F.pmod(F.xxhash64("sig", F.lit(7)), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    units = members.join(sizes, "cluster").withColumn("side", chunk).select("cluster", "sig", "label", "doc_id", "digest", "copies", "n", "side", other)
    units = stored(units.select("cluster", "sig", "label", "doc_id", "digest", "copies", "n", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")))
    n_shingles = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    compared = with_text(rows, units).repartition(pieces_of(spark, n_shingles * 16, 12 << 20), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return found.unionAll(stored(compared.mapInArrow(_united(miss), "a binary, b binary")))


def near_copies(docs: DataFrame, miss: float = MISS, salt_rows: int = SALT_ROWS, chunk_rows: int = CHUNK_ROWS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    rows = texts(docs)
    signed = stored(rows.mapInArrow(_signed, "doc_id long, digest long, n long, sig binary, mins binary"))
    stand = stored(classes(signed, F.first("mins", True).alias("mins")))
    out = by_row(signed.drop("mins"), stand, near_links(rows, stand, miss, salt_rows, chunk_rows, chunk_shingles))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))

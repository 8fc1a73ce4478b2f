"""Perceptual-hash similarity: id, created_at, phash, dhash (64-bit patterns as bigint).

Rows that share both hashes stand for one another before anything is joined, so a group of copies, however large, is one node.
Two hashes within gate g of each other differ by at most g // m bits in one of m bands. The join is on bands of one hash or of both, one side asking for
all variants of a band within that radius; how many bands, and how wide, follows from the number of rows."""

from __future__ import annotations

import functools
import itertools
import json
import math
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import max_distance, sum_distance

GATE, TEMPLATE_MOST = 7, 48
#: A key of more than a HUBS-th of all rows, and more than HUB_LEAST, is joined by broadcast.
HUBS, HUB_LEAST = 1024, 256
#: Fixed values of the pixel comparison.
MEAN_MOST, LOUD, LOUD_SHARE = 2.0, 16, 0.10


def band(c: Column, i: int, n: int, bits: int) -> Column:
    lo, hi = bits * i // n, bits * (i + 1) // n
    return F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def representatives(sigs: DataFrame) -> DataFrame:
    """One row for each pair of hashes: the smallest id."""
    return sigs.where("phash is not null and dhash is not null").groupBy("phash", "dhash").agg(F.min("id").alias("id"))


class Bands(NamedTuple):
    """n bands of a hash (0: it is not in the key), of which one differs by at most radius bits."""

    n: int
    radius: int

    def widths(self, bits: int) -> list[int]:
        return [bits * (i + 1) // self.n - bits * i // self.n for i in range(self.n)]

    def variants(self, width: int) -> int:
        return sum(math.comb(width, k) for k in range(self.radius + 1))


class KeyPlan(NamedTuple):
    """Bands of both hashes; keys a row has on the side that varies the first hash and on the other one; the share of all pairs that meet by chance."""

    p: Bands
    d: Bands
    keys: tuple[int, int]
    met: float

    def cost(self, rows: int) -> float:
        """In candidates."""
        return KEY_COST * rows * sum(self.keys) + rows * rows / 2 * self.met


#: What a key of a row costs, in candidates; keys a row may have; differing bits that a band may have.
KEY_COST, KEYS_MOST, RADIUS_MOST = 20, 700, 2
#: What a joined candidate costs, in pairs compared in numpy; rows that a unit of comparison holds of each side; rows below which there are fewer units; pairs that are compared at once.
JOINED, UNIT_ROWS, UNIT_LEAST, HASH_TILE = 20, 16_384, 512, (64, 4_096)


def key_plan(rows: int, gate: int, bits: int) -> KeyPlan:
    """The plan that makes the least of keys and candidates for so many rows of even hashes: few keys for few rows, wide ones for many, so that candidates do not grow with the square of the rows.
    Any plan finds all pairs."""
    options = [Bands(n, r) for r in range(RADIUS_MOST + 1) if (n := -(-(gate + 1) // (r + 1))) <= bits]
    plans = []
    for p in options or [Bands(0, 0)]:
        for d in [Bands(0, 0), *options]:
            wp, wd = p.widths(bits) if p.n else [0], d.widths(bits) if d.n else [0]
            vp, vd = (sum(x.variants(w) for w in ws) if x.n else 1 for x, ws in ((p, wp), (d, wd)))
            share = lambda x, ws: sum(x.variants(w) / 2**w for w in ws) if x.n else 1.0
            plans.append(KeyPlan(p, d, (vp * len(wd), len(wp) * vd), share(p, wp) * share(d, wd)))
    return min((x for x in plans if sum(x.keys) <= KEYS_MOST or not options), key=lambda x: x.cost(rows))


def _keys(plan: KeyPlan, bits: int, varied: str) -> Column:
    """The places of a row's keys: of each pair of bands where they begin, how long they are and which bits of the varied hash are turned."""
    cuts = lambda b: [(bits * i // b.n, w) for i, w in enumerate(b.widths(bits))] if b.n else [(0, 0)]
    turned = lambda b, w: [sum(1 << x for x in c) for k in range(b.radius + 1) for c in itertools.combinations(range(w), k)] if b.n else [0]
    out = []
    for i, (plo, pw) in enumerate(cuts(plan.p)):
        for j, (dlo, dw) in enumerate(cuts(plan.d)):
            for x in turned(plan.p, pw) if varied == "phash" else turned(plan.d, dw):
                out.append({"pi": i, "di": j, "plo": plo, "pk": (1 << pw) - 1, "dlo": dlo, "dk": (1 << dw) - 1, "px": x if varied == "phash" else 0, "dx": x if varied == "dhash" else 0})
    return F.from_json(F.lit(json.dumps(out)), "array<struct<pi:int,di:int,plo:int,pk:bigint,dlo:int,dk:bigint,px:bigint,dx:bigint>>")


def first_close_band(difference: Column, bands: Bands, bits: int) -> Column:
    """The number of the first band in which at most radius bits differ; 0 without bands."""
    if not bands.n:
        return F.lit(0)
    close = lambda i: F.bit_count(band(difference, i, bands.n, bits)) <= bands.radius
    out = F.when(close(0), 0)
    for i in range(1, bands.n):
        out = out.when(close(i), i)
    return out


def close_candidates(sigs: DataFrame, gate: int = GATE, bits: int = 64, plan: KeyPlan | None = None) -> DataFrame:
    """Pairs (a, b: rows of id, phash, dhash) that meet in a key, a.id < b.id, once for each key."""
    known = sigs.where("phash is not null and dhash is not null").select("id", "phash", "dhash")
    plan = plan or key_plan(known.count(), gate, bits)

    def side(varied: str) -> DataFrame:
        at = known.select("*", F.explode(_keys(plan, bits, varied)).alias("k"))
        part = lambda h: F.expr(f"(shiftrightunsigned({h}hash, k.{h}lo) & k.{h}k) ^ k.{h}x").alias(f"k{h}")
        return at.select("id", "phash", "dhash", "k.pi", "k.di", part("p"), part("d"))

    a, b = side("phash").alias("a"), side("dhash").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("pi", "di", "kp", "kd")]
    return a.join(b, same[0] & same[1] & same[2] & same[3] & (F.col("a.id") < F.col("b.id")))


def close_pairs(sigs: DataFrame, gate: int = GATE, bits: int = 64, plan: KeyPlan | None = None) -> DataFrame:
    """a < b, distance (the larger of both hashes'), for all pairs of different ids within the gate. Of the keys in which two rows meet only that of the first close bands gives the pair, so
    that nothing has to be made distinct. Where hashes are so short, or rows so few, that keys spare little, all pairs are compared in numpy by units of bounded size."""
    if plan is None:
        rows = sigs.where("phash is not null and dhash is not null").count()
        plan = key_plan(rows, gate, bits)
        if rows * rows / 2 <= JOINED * plan.cost(rows):
            return _compared_pairs(sigs, rows, gate, bits)
    p, d = F.col("a.phash").bitwiseXOR(F.col("b.phash")), F.col("a.dhash").bitwiseXOR(F.col("b.dhash"))
    distance = F.greatest(F.bit_count(p), F.bit_count(d))
    first = (F.col("a.pi") == first_close_band(p, plan.p, bits)) & (F.col("a.di") == first_close_band(d, plan.d, bits))
    return close_candidates(sigs, gate, bits, plan).where((distance <= gate) & first).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.alias("distance"))


def _compared_pairs(sigs: DataFrame, rows: int, gate: int, bits: int) -> DataFrame:
    """close_pairs by comparing all pairs: rows are dealt to chunks, and each two chunks meet in a unit of their own."""
    chunks = max(1, -(-rows // UNIT_ROWS), min(16, rows // UNIT_LEAST))
    units = chunks * (chunks + 1) // 2
    whole = np.uint32 if bits <= 32 else np.uint64

    def half(unit: pa.Table, chunk: str) -> list[np.ndarray]:
        mine = unit.filter(pc.equal(unit.column("own"), unit.column(chunk)))
        return [mine.column("id").to_numpy(), *(mine.column(h).to_numpy().astype(np.uint64).astype(whole) for h in ("phash", "dhash"))]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches, ["low", "high"]):
            (ids, p, d), (to_ids, to_p, to_d) = half(unit, "low"), half(unit, "high")
            same = unit.column("low")[0].as_py() == unit.column("high")[0].as_py()
            for i in range(0, len(ids), HASH_TILE[0]):
                for j in range(0, len(to_ids), HASH_TILE[1]):
                    x, y = slice(i, i + HASH_TILE[0]), slice(j, j + HASH_TILE[1])
                    gap = np.bitwise_count(p[x][:, None] ^ to_p[y][None, :])
                    at = np.flatnonzero(gap <= gate)
                    k, m = np.divmod(at, gap.shape[1])
                    gaps = np.maximum(gap.ravel()[at], np.bitwise_count(d[x][k] ^ to_d[y][m]))
                    a, b = ids[x][k], to_ids[y][m]
                    near = (gaps <= gate) & ((a < b) if same else (a != b))
                    if near.any():
                        a, b, gaps = a[near], b[near], gaps[near]
                        yield pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b)), pa.array(np.where(a < b, b, a)), pa.array(gaps.astype(np.int32))], ["a", "b", "distance"])

    at = sigs.where("phash is not null and dhash is not null").select("id", "phash", "dhash", F.pmod(F.xxhash64("id", "phash", "dhash"), F.lit(chunks)).alias("own"))
    # a join, not an explode: Spark's estimate of the pairs then grows with the chunks, so that pairs are not taken for a small table and sent to the driver
    met_ = at.join(F.broadcast(sigs.sparkSession.range(chunks).withColumnRenamed("id", "__x"))).select("id", "phash", "dhash", "own", F.least("own", "__x").alias("low"), F.greatest("own", "__x").alias("high"))
    kind = sigs.schema["id"].dataType.simpleString()
    return met_.repartition(min(units, 1_000), "low", "high").sortWithinPartitions("low", "high").mapInArrow(compared, f"a {kind}, b {kind}, distance int")


def shared_checkpoints(spark: SparkSession) -> None:
    """checkpoint() needs the folder that driver and executors share."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarrylake-"))  # all in one process, as in tests


def met(rows: DataFrame, key: str, found: DataFrame, n: int) -> DataFrame:
    """rows, at most n, with the column m of found (k, m) for their key, else null. Keys of more than a HUBS-th of n are fewer than HUBS, and are
    broadcast, so that no task gets all rows of a large one; the rest join by shuffle."""
    if n <= HUB_LEAST:  # no key can have more
        return rows.join(found, F.col(key) == F.col("k"), "left").select(*rows.columns, "m")
    hubs = rows.groupBy(F.col(key).alias("hub")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(HUB_LEAST, n // HUBS)).select("hub")
    known = F.broadcast(hubs.join(found, F.col("hub") == F.col("k"), "left").select("hub", "m"))
    rest = rows.join(known, F.col(key) == F.col("hub"), "left_anti").join(found, F.col(key) == F.col("k"), "left")
    return rows.join(known, F.col(key) == F.col("hub")).select(*rows.columns, "m").unionAll(rest.select(*rows.columns, "m"))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node and the smallest node of its component. Labels spread along edges and then jump to their label's label; each round is
    checkpointed to the shared folder."""
    shared_checkpoints(edges.sparkSession)
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = edges.select(F.inline(ways)).checkpoint()
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
    before, n = None, both.count()
    named = lambda rows: rows.select(F.col("u").alias("k"), F.col("label").alias("m"))
    for _ in range(most_rounds):
        near = met(both, "v", named(labels), n).select("u", F.col("m").alias("label"))
        spread = near.unionAll(labels).groupBy("u").agg(F.min("label").alias("label"))
        labels = met(spread, "label", named(spread), n).select("u", F.least("label", "m").alias("label")).checkpoint()
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels.select(F.col("u").alias("node"), "label")
        before = now
    raise RuntimeError("components did not settle")


def pools(sigs: DataFrame, gate: int = GATE, bits: int = 64) -> DataFrame:
    """id and pool (its smallest id) of all rows that have company."""
    shared_checkpoints(sigs.sparkSession)
    reps = representatives(sigs).checkpoint()
    roots = components(close_pairs(reps, gate, bits))
    named = reps.join(roots, F.col("id") == F.col("node"), "left").select("phash", "dhash", F.coalesce("label", "id").alias("pool"))
    out = sigs.join(named, ["phash", "dhash"]).select("id", "pool")
    company = out.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("pool").alias("__p"))
    return out.join(company, F.col("pool") == F.col("__p"), "left_semi")


def keepers(groups: DataFrame, by: list[str]) -> DataFrame:
    """groups: grp, id and the columns of by. Adds keeper_id, the group's first row by these columns and id, and kept. Keepers are partial minima; a large group's rows meet
    theirs in a join that Spark can split."""
    first = groups.groupBy("grp").agg(F.min(F.struct(*by, "id")).alias("__k")).select(F.col("grp").alias("__g"), F.col("__k.id").alias("keeper_id"))
    return groups.join(first, F.col("grp") == F.col("__g")).drop("__g").withColumn("kept", F.col("id") == F.col("keeper_id"))


def sized(groups: DataFrame) -> DataFrame:
    """groups: grp, id, created_at. In the order in which groups are shown, the largest first: grp, n, keeper_id."""
    g = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("created_at", "id")).alias("k"))
    return g.where("n > 1").select("grp", "n", F.col("k.id").alias("keeper_id")).orderBy(F.col("n").desc(), "keeper_id")


def live_groups(groups: DataFrame, items: DataFrame) -> DataFrame:
    """groups: grp, id. Members that still exist, of groups that still have two."""
    left = groups.join(items.select("id"), "id", "left_semi")
    company = left.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("grp").alias("__g"))
    return left.join(company, F.col("grp") == F.col("__g"), "left_semi").select(*groups.columns)


def groups_with(groups: DataFrame, needle: str) -> DataFrame:
    """groups: grp, id, filename, path. All members of groups of which some member's name or path has the needle in it."""
    n = needle.strip().lower()
    hit = groups.where(F.contains(F.lower("filename"), F.lit(n)) | F.contains(F.lower("path"), F.lit(n))).select(F.col("grp").alias("__g")).distinct()
    return groups.join(hit, F.col("grp") == F.col("__g"), "left_semi") if n else groups


def fast_duplicates(images: DataFrame, gate: int = GATE, bits: int = 64) -> DataFrame:
    """images: id, created_at, phash, dhash. Groups by hashes alone: id, pool, keeper_id, kept."""
    found = pools(images, gate, bits).withColumnRenamed("pool", "grp").join(images.select("id", "created_at"), "id")
    return keepers(found, ["created_at"]).select("id", F.col("grp").alias("pool"), "keeper_id", "kept")


def verified_duplicates(images: DataFrame, gate: int = GATE, bits: int = 64) -> DataFrame:
    """images: id, created_at, phash, dhash, pixels. Groups by hashes, then by pixels within them: id, pool, leader."""
    found = pools(images, gate, bits)
    return greedy_groups(found.join(images.select("id", "created_at", "pixels"), "id"))


def frame_groups(videos: DataFrame, gate: int, bits: int = 64, slots: tuple[str, ...] = ("anchor", "mid", "tail")) -> DataFrame:
    """videos: id, created_at and for each slot {slot}_p and {slot}_d. Videos whose anchors are close are candidates; in the order of creation the first one left leads all left
    whose every slot is close to its: id, leader, of groups of two and more. Videos that share all hashes are one: whatever leads the first of them leads the others."""
    shared_checkpoints(videos.sparkSession)
    hashes = [f"{s}_{h}" for s in slots for h in "pd"]
    whole = videos.where(" and ".join(f"{h} is not null" for h in hashes))
    firsts = whole.groupBy(*hashes).agg(F.min(F.struct("created_at", "id")).alias("k")).select("k.created_at", "k.id", *hashes).checkpoint()
    pairs = close_pairs(firsts.select("id", F.col(f"{slots[0]}_p").alias("phash"), F.col(f"{slots[0]}_d").alias("dhash")), gate, bits).select("a", "b")
    side = lambda k: firsts.select(F.col("id").alias(k), "created_at", *hashes).alias(k)
    # by shuffle: rows of six hashes each are not sent to the driver
    j = pairs.hint("merge").join(side("a").withColumnsRenamed({h: f"a_{h}" for h in hashes} | {"created_at": "a_at"}), "a").hint("merge").join(side("b").withColumnRenamed("created_at", "b_at"), "b")
    for s in slots[1:]:
        j = j.where(max_distance(F.col(f"a_{s}_p"), F.col(f"a_{s}_d"), F.col(f"{s}_p"), F.col(f"{s}_d")) <= gate)
    earlier = F.struct("a_at", "a") < F.struct("b_at", "b")
    links = j.select(F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("then"), F.least(F.struct(F.col("a_at").alias("t"), F.col("a").alias("i")), F.struct(F.col("b_at").alias("t"), F.col("b").alias("i"))).alias("order"))
    of_first = firsts.select(F.col("id").alias("rep"), *hashes).join(leaders(links).withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select(F.coalesce("leader", "rep").alias("leader"), *hashes)
    return in_company(whole.join(of_first.hint("merge"), hashes).select("id", "leader"))


def in_company(led: DataFrame) -> DataFrame:
    """id, leader: those of groups of two and more."""
    groups = led.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("leader").alias("__l"))
    return led.join(groups, F.col("leader") == F.col("__l"), "left_semi")


def led(links: DataFrame) -> DataFrame:
    """The leaders of links, of groups of two and more."""
    return in_company(leaders(links))


#: Rounds that settle most graphs before chains are contracted.
PLAIN_ROUNDS = 3


def leaders(links: DataFrame, plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """links: first, then, order (of first). Greedy leaders of all rows that links name: a row leads if no earlier neighbour leads; else it follows the earliest that does.

    A row leads if none of its literals holds; at first these are its earlier neighbours. A round puts in what is known, and settles rows of which one literal holds or none is left.
    A row with one open literal equals it or its contrary, so it is a pointer with a sign; pointers double until they end at rows that are no pointers, which halves chains instead of taking a
    link a round, and literals are replaced by where they point. A row that waits for another and for its contrary does not lead. The first open row is
    settled in each round, so rounds go on until none is open: nothing is capped. Chains in which each row waits for one are done in log n rounds; where rows wait for several, a
    round may settle no more than the first few of each chain."""
    shared_checkpoints(links.sparkSession)
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # unions add up the partitions of their sides, round by round
    written = lambda x: x.coalesce(parts).checkpoint()
    links = links.checkpoint()
    wait = links.select(F.col("then").alias("v"), F.col("first").alias("u"), F.lit(False).alias("s")).distinct().checkpoint()
    known = links.select(F.col("first").alias("v")).distinct().join(wait.select("v").distinct(), "v", "left_anti").select("v", F.lit(True).alias("leads")).checkpoint()
    # what is open names no row that was settled before the last round, so a round meets only what was settled in that
    n, rounds, fresh, settled_in = wait.count(), 0, known, [known]
    while n:
        now = met(wait, "u", fresh.select(F.col("v").alias("k"), F.col("leads").alias("m")), n)
        seen = now.groupBy("v").agg(F.max(F.coalesce(F.col("m") != F.col("s"), F.lit(False))).alias("holds"), F.count_if(F.col("m").isNull()).alias("open"))
        settled = seen.where("holds or open = 0").select("v", (~F.col("holds")).alias("leads")).checkpoint()
        fresh, settled_in = settled, [*settled_in, settled]
        if len(settled_in) >= 16:
            settled_in = [written(functools.reduce(DataFrame.unionAll, settled_in))]
        wait = written(now.where("m is null").select("v", "u", "s").join(settled.select("v"), "v", "left_anti"))
        n, rounds = wait.count(), rounds + 1
        if not n or rounds < plain_rounds:
            continue
        # a row with one literal (u, s) leads unless u differs from s: it is u turned by not s
        one = wait.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.first("u").alias("u"), (~F.first("s")).alias("t")).where("n = 1").select("v", "u", "t").checkpoint()
        if not one.limit(1).count():
            continue
        while True:
            hop = written(met(one, "u", one.select(F.col("v").alias("k"), F.struct("u", "t").alias("m")), n))
            if not hop.where("m is not null").limit(1).count():
                break
            one = hop.select("v", F.coalesce("m.u", "u").alias("u"), (F.col("t") != F.coalesce("m.t", F.lit(False))).alias("t"))
        put = met(wait.join(one.select("v"), "v", "left_anti"), "u", one.select(F.col("v").alias("k"), F.struct("u", "t").alias("m")), n)
        put = put.select("v", F.coalesce("m.u", "u").alias("u"), (F.col("s") != F.coalesce("m.t", F.lit(False))).alias("s")).distinct()
        both = put.groupBy("v", "u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v").distinct().checkpoint()
        no = both.select("v", F.lit(False).alias("leads"))
        fresh, settled_in = written(fresh.unionAll(no)), [*settled_in, no]
        wait = written(put.join(both, "v", "left_anti").unionAll(one.select("v", "u", (~F.col("t")).alias("s"))))
        n = wait.count()
    known = functools.reduce(DataFrame.unionAll, settled_in)
    lead = known.where("leads").select(F.col("v").alias("first"))
    follow = links.join(lead, "first").join(lead.withColumnRenamed("first", "then"), "then", "left_anti").groupBy("then").agg(F.min(F.struct("order", "first")).alias("m"))
    return lead.select(F.col("first").alias("id"), F.col("first").alias("leader")).unionAll(follow.select(F.col("then").alias("id"), F.col("m.first").alias("leader")))


def group_totals(groups: DataFrame) -> DataFrame:
    """How many groups, and how many members beyond the first of each."""
    return groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extras"))


def like_template(sigs: DataFrame, template_id: int, most: int = TEMPLATE_MOST) -> DataFrame:
    """Rows by the sum of both distances to one template: id, distance. The template is one row."""
    t = sigs.where((F.col("id") == template_id) & F.col("phash").isNotNull()).select(F.col("phash").alias("__p"), F.col("dhash").alias("__d")).limit(1)
    d = sum_distance(F.col("phash"), F.col("dhash"), F.col("__p"), F.col("__d"))
    return sigs.where(F.col("id") != template_id).join(F.broadcast(t)).select("id", d.alias("distance")).where(F.col("distance") <= most)


def pixel_gap(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    gap = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return float(gap.mean()), float((gap > LOUD).mean())


def pixels_close(a: bytes | None, b: bytes | None) -> bool:
    if not a or not b or len(a) != len(b):
        return False
    mean, loud = pixel_gap(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))
    return mean <= MEAN_MOST and loud <= LOUD_SHARE


#: Projections of a grid; each moves by at most as much as two grids differ in all, so grids that are close lie in cells that touch.
PROJECTIONS = 3
#: Rows, in order, among which leaders are found in the first round; each round goes on to so many times the rows.
PREFIX, PREFIX_GROWS = 2_000, 4
#: Rows of a place that a unit of comparison holds of each side; pairs that are compared at once.
CHUNK, TILE = 4_096, (128, 1_024)
_SUMS, _PLACE = [f"p{k}" for k in range(PROJECTIONS)], ["pool", "size", *[f"c{k}" for k in range(PROJECTIONS)]]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size and the projections of each grid: its sum, and its sum with the sign turned by halves, by quarters and so on."""
    signs: dict[int, np.ndarray] = {}
    for b in batches:
        sizes, sums = [], []
        for x in b.column("pixels"):
            grid = np.frombuffer(x.as_py(), np.uint8).astype(np.int64)
            n = len(grid)
            if n not in signs:
                part = np.arange(n) * (1 << PROJECTIONS) // n
                signs[n] = np.stack([np.ones(n, np.int64), *[1 - 2 * (part >> (PROJECTIONS - k) & 1) for k in range(1, PROJECTIONS)]])
            sizes.append(n)
            sums.append(signs[n] @ grid)
        made = [pa.array(sizes, pa.int64()), *[pa.array([int(c[k]) for c in sums], pa.int64()) for k in range(PROJECTIONS)]]
        yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "size", *_SUMS])


def _cell(k: int, turn: int) -> Column:
    """Cells are twice as wide as close grids may differ in all, so that within this reach of a grid there are at most two."""
    most = F.col("size") * MEAN_MOST
    return F.floor((F.col(f"p{k}") + turn * most) / (2 * most))


def _touching(rows: DataFrame) -> DataFrame:
    """rows, once for each cell within reach."""
    for k in range(PROJECTIONS):
        rows = rows.withColumn(f"c{k}", F.explode(F.array_distinct(F.array(_cell(k, -1), _cell(k, 1)))))
    return rows


def _close_in(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of close grids in a tile: by coordinates over all pairs, and pair by pair as soon as few are left."""
    n = a.shape[1]
    most, step = MEAN_MOST * n, max(8, n // 8)
    gaps = np.zeros((len(a), len(b)), np.uint32 if 255 * n > 65_535 else np.uint16)
    by_a, by_b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for k in range(n):
        x, y = by_a[k][:, None], by_b[k][None, :]
        gaps += np.maximum(x, y) - np.minimum(x, y)
        if k % step == step - 1 and np.count_nonzero(gaps <= most) * 16 <= gaps.size:
            break
    i, j = np.nonzero(gaps <= most)
    close, at_once = np.zeros(len(i), bool), max(1, (1 << 22) // n)
    for low in range(0, len(i), at_once):
        cut = slice(low, low + at_once)
        gap = np.abs(a[i[cut]].astype(np.int16) - b[j[cut]])
        close[cut] = (gap.sum(1, dtype=np.int64) <= most) & ((gap > LOUD).sum(1) / n <= LOUD_SHARE)
    return i[close], j[close]


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    key = lambda b, k: tuple(b.column(c)[k].as_py() for c in by)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = bool(held) and key(held[-1], 0) != key(b, 0)
        for c in by:
            new[1:] |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)
        low = 0
        for high in [*np.flatnonzero(new).tolist(), n]:
            if high > low:
                held.append(b.slice(low, high - low))
            if high < n and held:
                yield pa.Table.from_batches(held)
                held = []
            low = high
    if held:
        yield pa.Table.from_batches(held)


def _compared(every: bool):
    """Of each unit the pairs (first, then) that are close, or only the first one of each."""

    def sides(unit: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, lead = unit.column("at").to_numpy(), unit.column("leads").to_numpy()
        grids = np.frombuffer(b"".join(unit.column("pixels").to_pylist()), np.uint8).reshape(len(at), -1)
        for side in (lead, ~lead):
            mine = np.flatnonzero(side)
            mine = mine[np.argsort(at[mine])]
            yield at[mine], grids[mine]

    def found(unit: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (at, a), (bt, b) = sides(unit)
        for i in range(0, len(at), TILE[0]):
            some, open_ = slice(i, i + TILE[0]), np.ones(len(bt), bool)
            for j in range(int(np.searchsorted(bt, at[i], "right")), len(bt), TILE[1]):
                x, y = _close_in(a[some], b[j : j + TILE[1]])
                later = at[some][x] < bt[j : j + TILE[1]][y]
                x, y = x[later], y[later]
                if not every:  # pairs come in the order of x
                    y, one = np.unique(y, return_index=True)
                    x = x[one]
                    open_[j + y] = False
                yield at[some][x], bt[j : j + TILE[1]][y]
            if not every:
                bt, b = bt[open_], b[open_]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches, [*_PLACE, "ac", "bc"]):
            for first, then in found(unit):
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(then)], ["first", "then"])

    return compared


def _close_to(leads: DataFrame, rows: DataFrame, every: bool) -> DataFrame:
    """Pairs (first, then) of leads and later rows that are close; unless every, of a unit's pairs only the first of each row. Rows of a place are dealt to chunks, and each chunk of leads meets each of
    rows in a unit of its own, so that a crowded place is many units, all of bounded size."""
    a, b = _touching(leads), rows.withColumns({f"c{k}": _cell(k, 0) for k in range(PROJECTIONS)})
    counted = a.select(*_PLACE, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(*_PLACE, F.lit(0), F.lit(1))).groupBy(*_PLACE).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = counted.where("a > 0 and b > 0").select(*_PLACE, F.ceil(F.col("a") / CHUNK).alias("na"), F.ceil(F.col("b") / CHUNK).alias("nb"))
    own, all_of = lambda n: F.pmod(F.xxhash64("at"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    side = lambda x, ac, bc, lead: x.join(both, _PLACE).select(*_PLACE, "at", "pixels", F.lit(lead).alias("leads"), "na", "nb").withColumn("ac", ac).withColumn("bc", bc).drop("na", "nb")
    met_ = side(a, own("na"), all_of("nb"), True).unionAll(side(b, all_of("na"), own("nb"), False))
    unit = [*_PLACE, "ac", "bc"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met_.repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(_compared(every), "first long, then long")


def _prefixes(rows: DataFrame, first: int) -> list[int | None]:
    """Values of at up to which there are first rows, PREFIX_GROWS times as many and so on, and None for all."""
    parts = sorted(rows.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    n, ends = sum(p["count"] for p in parts), []
    while 0 < first < n:
        before = 0
        for p in parts:
            if first < before + p["count"]:
                ends.append((p["part"] << 33) + first - before)
                break
            before += p["count"]
        first *= PREFIX_GROWS
    return [*ends, None]


def greedy_groups(members: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """members: pool, id, created_at, pixels. In the order of creation the first row left leads a group and takes all rows left that are
    close to it; so similarity is not handed on. id, pool, leader of groups of two and more.

    Equal grids of a pool are one row. Grids are placed in cells by projections that differ by no more than the grids do in all, so that a row can be close only to rows of the cells
    within its reach. Rounds go over ever longer beginnings of the order: close rows among those left of the beginning are linked, leaders() settles them, and the new leaders take what is close of all
    later rows. In an order that does not follow the grids, so few rows then stay close to one another that the links of all rounds are about as many as the rows (times a logarithm), however
    crowded the grids are. Rows are compared in numpy by units of bounded size, so a pool that holds a third of all rows is as many tasks' work as others. prefix 0: one round."""
    shared_checkpoints(members.sparkSession)
    own = members.where("pixels is not null and length(pixels) > 0").select("pool", "id", "created_at", "pixels").checkpoint()
    firsts = own.groupBy("pool", "pixels").agg(F.min(F.struct("created_at", "id")).alias("k")).select("pool", "pixels", "k.created_at", "k.id")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = firsts.repartitionByRange(parts, "created_at", "id").sortWithinPartitions("created_at", "id").select("pool", "id", "pixels", F.monotonically_increasing_id().alias("at"))
    added = "".join(f", {c} long" for c in ["size", *_SUMS])
    rows = at.mapInArrow(_placed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in at.schema) + added).checkpoint()
    left, follow = rows.drop("id"), []
    for end in _prefixes(rows, prefix):
        head = left if end is None else left.where(F.col("at") < end)
        mine = leaders(_close_to(head, head, True).withColumn("order", F.col("first"))).where("id <> leader").select(F.col("id").alias("then"), "leader").checkpoint()
        follow.append(mine)
        if end is None:
            break
        new, later = head.join(mine, F.col("at") == F.col("then"), "left_anti"), left.where(F.col("at") >= end)
        taken = _close_to(new, later, False).groupBy("then").agg(F.min("first").alias("leader")).checkpoint()
        follow.append(taken)
        left = later.join(taken, F.col("at") == F.col("then"), "left_anti").checkpoint()
        if not left.limit(1).count():
            break
    all_follow = functools.reduce(DataFrame.unionAll, follow)
    named = all_follow.join(rows.select(F.col("at").alias("leader"), F.col("id").alias("leader_id")), "leader").select("then", "leader_id")
    of_first = rows.join(named, F.col("at") == F.col("then"), "left").select("pool", "pixels", F.coalesce("leader_id", "id").alias("leader"))
    return in_company(own.join(of_first, ["pool", "pixels"]).select("id", "pool", "leader"))

"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Three levels of integers: the mix's blocks of equal token counts go to sources by highest quotients
target / (2 j - 1); a source's blocks go to its shards by the same rule on the shards' sizes; within a shard, documents
lie on a line in seeded order and the shard takes whole rounds of the line and then its first blocks.

A rule for at most 2 n candidates replaces a list of all quotients: seats that even the strictest divisor grants
are given by arithmetic, and only those between the strictest and the most lenient divisor are ranked.

A source is cut into shards of about rows_per_shard documents by a hash of the id, so a source that holds a third of
all rows is many groups. Documents of a shard never count beyond twice their size.

Defined results: null text has size 0 and takes 0; null source is a source of its own and sorts last;
a source without words has target 0; repeated rows are documents of their own; no words at all: all targets 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, table, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_TOKENS = 32
ROWS_PER_SHARD = 4096
SEED = 20


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(F.regexp_extract_all(text_of(), F.lit(f"([^{SPACE}]+)"), F.lit(1))).cast("long").alias("size"))


def targets(by_source: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """by_source: source, source_size, n_docs. Adds weight and target. Filling in the order of size / weight finds in one
    pass the level at which resharing ends: a source is full where its limit lies below the level of those after it."""
    everything = Window.partitionBy(F.lit(0))
    named = everything.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(named) - 1) % len(weights) + 1
    w = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), nth))
    w = w.withColumn("limit", F.col("source_size") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    filling = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose limit is above its level sets the level for itself and all after it
    w = w.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    return w.withColumn("target", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))).drop("limit", "ratio", "level")


def apportioned(rows: DataFrame, votes: str, seats: Column | str, by: list[str], ties: list[Column], out: str) -> DataFrame:
    """Adds out: the seats that Sainte-Laguë gives each row of a group. seats: the group's number of seats, alike in its rows."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    v, total, n = F.col(votes).cast("double"), F.sum(F.col(votes).cast("double")).over(group), F.count(F.lit(1)).over(group)
    s = rows.withColumn("__seats", F.col(seats) if isinstance(seats, str) else seats).withColumn("__v", v).withColumn("__total", total).withColumn("__n", n)
    # seat j needs v / (2 j - 1) >= d, so a divisor d grants floor((v / d + 1) / 2) seats
    granted = lambda most: F.when(most > 0, F.floor((F.col("__v") * most / F.col("__total") + 1) / 2)).otherwise(F.lit(0)).cast("long")
    s = s.withColumn("__sure", F.when(F.col("__total") > 0, granted(2 * F.col("__seats") - F.col("__n"))).otherwise(F.lit(0)).cast("long"))
    s = s.withColumn("__open", F.when((F.col("__total") > 0) & (F.col("__v") > 0), granted(2 * F.col("__seats") + F.col("__n"))).otherwise(F.col("__sure")))
    s = s.withColumn("__left", F.col("__seats") - F.sum("__sure").over(group))
    seat = s.withColumn("__j", F.explode_outer(F.when(F.col("__open") > F.col("__sure"), F.sequence(F.col("__sure") + 1, F.col("__open")))))
    rank = F.row_number().over(group.orderBy((F.col("__v") / (2 * F.col("__j") - 1)).desc_nulls_last(), *ties, "__j"))
    won = seat.withColumn("__won", (F.col("__j").isNotNull() & (rank <= F.col("__left"))).cast("long"))
    keys = [c for c in rows.columns]
    return won.groupBy(*keys).agg((F.first("__sure") + F.sum("__won")).alias(out))


def mix(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED, **shares) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken."""
    sizes = sized(docs)
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = targets(by_source, **shares)
    whole = Window.partitionBy(F.lit(0))
    plan = apportioned(plan, "target", F.round(F.sum("target").over(whole) / block_tokens).cast("long"), [], [F.col("source").asc_nulls_last()], "blocks")
    plan = plan.withColumn("n_shards", F.ceil(F.col("n_docs") / rows_per_shard).cast("long"))
    # as many rows as there are sources: joined null-safe, so that a null source keeps its rows
    at = plan.select(F.col("source").alias("__source"), "source_size", "target", "blocks", "n_shards")
    placed = sizes.join(at, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = placed.withColumn("order_key", F.xxhash64("doc_id", F.lit(seed)))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("order_key", F.lit(seed + 1)), "n_shards"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("source_blocks"))
    quotas = apportioned(shards, "shard_size", "source_blocks", ["source"], [F.col("shard")], "quota").select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "shard_size", "quota")
    lines = placed.join(quotas, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard"))).drop("__source", "__shard")
    line = Window.partitionBy("source", "shard").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.least(F.col("quota") * block_tokens, 2 * F.col("shard_size"))
    lines = lines.withColumn("words", words).withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - rounds * F.col("shard_size") - F.col("start")))
    return lines.select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + more).cast("long").alias("taken"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself, with the columns of docs: a document that is taken twice occurs twice, and one of which
    only some words are taken ends after the last of them."""
    names = docs.columns
    taken = mix(docs, **parameters).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    # rows that agree in id, source and size but not in what is taken share it out by their number
    same = ["__id", "__source", "__size"]
    taken = taken.groupBy(*same).agg(F.sort_array(F.collect_list("__taken")).alias("__each"))
    keyed = docs.withColumn("__words", F.size(F.regexp_extract_all(text_of(), F.lit(f"([^{SPACE}]+)"), F.lit(1))).cast("long"))
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    nth = F.when(F.size("__each") > 1, F.row_number().over(Window.partitionBy("doc_id", "source", "__words").orderBy(F.xxhash64(*names)))).otherwise(1)
    own = joined.withColumn("__nth", nth).withColumn("__taken", F.element_at("__each", F.col("__nth")))
    copies = F.ceil(F.col("__taken") / F.col("__size")).cast("int")
    copied = own.where("__taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    part = F.least(F.col("__size"), F.col("__taken") - (F.col("__copy") - 1) * F.col("__size"))
    words = F.slice(F.regexp_extract_all(text_of(), F.lit(f"([{SPACE}]*[^{SPACE}]+)"), F.lit(1)), F.lit(1), part.cast("int"))
    text = F.when(part == F.col("__size"), F.col("text")).otherwise(F.array_join(words, ""))
    out = copied.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(part == F.col("__size"), F.col("n_chars")).otherwise(F.char_length("text")).cast("long"))
    return out.select(*names)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

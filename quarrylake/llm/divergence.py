"""Source divergence audit: how far the vocabulary of each source lies from the other sources of its language, by sorted streaming.

1. Each map task sorts the occurrences of its documents' terms into runs (lang, term, source, document, df, n): documents are whole there, so a run's document
   frequency is exact, and a word that every document has leaves a task once for each flush and source.
2. Runs are dealt by (lang, term), sorted by (a hash of lang and term, lang, term, source, document), so that few comparisons look at strings, and scanned once: equal
   (lang, term, source) are one run of the scan, whose df and n go out as one row at the end of its term, unless the term is in fewer than LEAST_DOCS documents of the language.
3. With the totals of groups and languages each count has its p.
4. Pairs: terms are dealt to chunks and sources to blocks; a unit (lang, chunk, block, block) gives for each pair of sources the sum of f over its terms, less
   what these terms would add if neither source had them. That share is added for all V terms at the end, so that absent terms cost nothing.
5. Terms: a group's terms above their language's p, the first TERM_RANKS by rank.

Defined results: each row is a document; null text, lang and source are empty strings; a text without terms, or empty, adds its group alone; a language without kept terms
has pairs of value 0 and no terms; a language of one source has no pairs; ties are ranked by item in UTF-8 order; repeated rows are documents of their own; very long
texts are folded whole; empty table: empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import each_released, pieces_of, released, small_batches, stored, table, text_of

LEAST_DOCS, TERM_RANKS, UNIT = 3, 200, 1_000_000_000
BLOCK, CHUNK_TERMS, MOST_CHUNK_TERMS = 512, 1000, 20_000
PIECE_BYTES, PIECES_A_SALT = 64 << 20, 1 << 14
#: A task's occurrences and documents go out as runs when there are so many.
FLUSH_RUNS = 4_000_000
#: Rows of a scan that are looked at together, and of a batch that a flush gives.
SCAN_ROWS = 1 << 16
#: Bytes that make no terms become spaces, A-Z become a-z; bytes outside ASCII stay.
_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
RUNS = "lang string, term string, source string, document long, df long, n long"
SCANNED = "lang string, term string, source string, df long, n long, lang_df long, lang_n long, first boolean"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts (strings without nulls), in order, and the place of each one's text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    raw = np.frombuffer(memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes().translate(_FOLD), np.uint8)
    edges = ends - ends[0]
    inside = raw != 0x20
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    # a text ends its last term, whatever the next one begins with
    cuts = edges[(edges > 0) & (edges < len(raw))]
    starts[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    offsets = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return terms, np.searchsorted(edges, first, "right") - 1


def _runs(held: list[tuple]) -> pa.Table:
    """The runs of held documents: (groups, documents, terms, places) of each batch, groups being (lang, source) of each document. A group goes out with a row of an empty term too, so that
    groups without terms are known."""
    named = pa.concat_tables([pa.table({"lang": g[0], "source": g[1]}) for g, _, _, _ in held]).combine_chunks()
    documents = np.concatenate([d for _, d, _, _ in held])
    codes = [named.column(k).combine_chunks().dictionary_encode() for k in ("lang", "source")]
    pair = codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy()
    every, at, group = np.unique(pair, return_index=True, return_inverse=True)
    # documents numbered along their groups, so that one integer orders occurrences by term, group and document
    order = np.argsort(group, kind="stable")
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order))
    bits, base, places = max(1, int(len(order)).bit_length()), 0, []
    for _, d, _, at_text in held:
        places.append(at_text + base)
        base += len(d)
    terms = pa.concat_arrays([t for _, _, t, _ in held]).dictionary_encode()
    keys = (terms.indices.to_numpy().astype(np.int64) << bits) | nth[np.concatenate(places)]
    keys.sort()
    of = group[order][keys & ((1 << bits) - 1)]
    term = keys >> bits
    other = np.ones(len(keys), bool)
    other[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
    begins = np.flatnonzero(other)
    new = np.ones(len(keys), np.int64)
    new[1:] = keys[1:] != keys[:-1]
    df = np.add.reduceat(new, begins) if len(begins) else np.empty(0, np.int64)
    n = np.diff(np.append(begins, len(keys)))
    empty, rows = len(every), np.concatenate([np.arange(len(every)), of[begins]])
    heads = named.take(pa.array(at)).combine_chunks()
    found = terms.dictionary.take(pa.array(term[begins])).cast(pa.string())
    nothing = np.zeros(empty, np.int64)
    cols = [heads.column("lang").take(pa.array(rows)), pa.chunked_array([pa.array([""] * empty, pa.string()), found]), heads.column("source").take(pa.array(rows))]
    return pa.table([*cols, pa.array(documents[at][rows]), pa.array(np.concatenate([nothing, df])), pa.array(np.concatenate([nothing, n]))], [x.split()[0] for x in RUNS.split(", ")])


def _folded(flush_runs: int = FLUSH_RUNS):
    @released
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of a task's documents."""
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            terms, places = terms_of(b.column("text").cast(pa.string()))
            # copies, so that whole texts are not held with them
            groups = [b.column(k).take(pa.array(np.arange(b.num_rows))) for k in ("lang", "source")]
            held.append((groups, b.column("document").to_numpy().copy(), terms, places))
            size += len(terms) + b.num_rows
            if size >= flush_runs:
                yield from _runs(held).combine_chunks().to_batches(SCAN_ROWS)
                held, size = [], 0
        if held:
            yield from _runs(held).combine_chunks().to_batches(SCAN_ROWS)

    return folded


def _scanned(least_docs: int):
    @released
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition, equal terms of a language together and in the order (source, document): each run of equal (lang, term, source) as one row, with its term's df and n over all sources, and
        whether it is the first of its term. Terms below least_docs go. A term's runs, one a source, are held until the term ends."""
        keys, held = ("lang", "term", "source"), None

        def starts_of(t: pa.Table, names: tuple[str, ...]) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for k in names:
                c = t.column(k)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
            return np.flatnonzero(new)

        def reduced(t: pa.Table) -> pa.Table:
            at = starts_of(t, keys)
            return pa.table([*(t.column(k).take(pa.array(at)) for k in keys), *(pa.array(np.add.reduceat(t.column(k).to_numpy(), at)) for k in ("df", "n"))], [*keys, "df", "n"])

        def ended(t: pa.Table) -> Iterator[pa.RecordBatch]:
            at = starts_of(t, ("lang", "term"))
            df, n = (np.add.reduceat(t.column(k).to_numpy(), at) for k in ("df", "n"))
            sizes = np.diff(np.append(at, t.num_rows))
            first = np.zeros(t.num_rows, bool)
            first[at] = True
            out = t.append_column("lang_df", pa.array(np.repeat(df, sizes))).append_column("lang_n", pa.array(np.repeat(n, sizes))).append_column("first", pa.array(first))
            yield from out.filter(pc.or_(pc.greater_equal(out.column("lang_df"), least_docs), pc.equal(out.column("term"), ""))).to_batches()

        def together() -> Iterator[pa.Table]:
            some, size = [], 0
            for b in batches:
                some.append(b)
                size += b.num_rows
                if size >= SCAN_ROWS:
                    yield pa.Table.from_batches(some)
                    some, size = [], 0
            if size:
                yield pa.Table.from_batches(some)

        for t in together():
            t = reduced((t if held is None else pa.concat_tables([held, t])).combine_chunks())
            last = int(starts_of(t, ("lang", "term"))[-1])
            held = t.slice(last).combine_chunks()
            if last:
                yield from ended(t.slice(0, last))
        if held is not None:
            yield from ended(held)

    return scanned


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, flush_runs: int = FLUSH_RUNS, salts: int | None = None) -> DataFrame:
    """lang, term, source, df, n, lang_df, lang_n and first (one row of each term) of all kept terms that occur; a group has a row of an empty term too. A term leaves a flush once for each
    of its sources, so only tables of very many partitions need salts; what these part is put together by sums."""
    spark = docs.sparkSession
    small_batches(spark)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(named("lang"), named("source"), F.monotonically_increasing_id().alias("document"), text_of().alias("text"))
    runs = rows.mapInArrow(_folded(flush_runs), RUNS)
    pieces = pieces_of(spark, docs.select(F.sum(F.octet_length(text_of()))).first()[0] or 0, PIECE_BYTES)
    salts = salts or -(-pieces // PIECES_A_SALT)
    dealt = runs.repartition(pieces, "lang", "term", *([F.pmod(F.xxhash64("document"), F.lit(salts))] if salts > 1 else []))
    # a sort compares the first column as a number; languages begin alike, hashes do not
    in_order = dealt.withColumn("at", F.xxhash64("lang", "term")).sortWithinPartitions("at", "lang", "term", "source", "document").select("lang", "term", "source", "df", "n")
    found = in_order.mapInArrow(_scanned(least_docs if salts == 1 else 0), SCANNED)
    if salts == 1:
        return found
    parts = found.groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    whole = parts.groupBy("lang", "term").agg(F.sum("df").alias("lang_df"), F.sum("n").alias("lang_n"), F.min("source").alias("least")).where((F.col("lang_df") >= least_docs) | (F.col("term") == ""))
    return parts.join(whole, ["lang", "term"]).select("lang", "term", "source", "df", "n", "lang_df", "lang_n", (F.col("source") == F.col("least")).alias("first"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), in decimals, since the product may pass a long; null where nothing is kept."""
    wide = lambda c: c.cast("decimal(28,0)")
    above, below = wide(count + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + kept)
    return F.when(kept > 0, F.call_function("div", above, below) + 1).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(block_size: int):
    def pair_sums(key, t: pa.Table) -> pa.Table:
        """One unit: for the sources of block bi against those of block bj the sum over its terms of f(p, q) - f(p0, q0), p0 and q0 being those of an absent term."""
        lang, _, bi, bj = (k.as_py() for k in key)
        absent = pc.is_null(t.column("term"))
        heads, counts = t.filter(absent), t.filter(pc.invert(absent))
        codes = counts.column("term").combine_chunks().dictionary_encode()
        n_terms, code = len(codes.dictionary), codes.indices.to_numpy()
        nth, p = counts.column("nth").to_numpy(), counts.column("p").to_numpy()
        head_nth, head_p = heads.column("nth").to_numpy(), heads.column("p").to_numpy()

        def side(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            mine = head_nth // block_size == block
            order = np.argsort(head_nth[mine])
            sources, base = head_nth[mine][order], head_p[mine][order]
            dense = np.broadcast_to(base, (n_terms, len(base))).copy()
            inside = nth // block_size == block
            dense[code[inside], np.searchsorted(sources, nth[inside])] = p[inside]
            return sources, base, dense

        gs, g0, gp = side(bi)
        hs, h0, hp = side(bj)
        sums = np.zeros((len(gs), len(hs)), np.int64)
        step = max(1, (4 << 20) // max(1, len(hs)))
        for low in range(0, n_terms, step):
            q = hp[low : low + step]
            for k in range(len(gs)):
                d = gp[low : low + step, k : k + 1] - q
                d *= d
                sums[k] += (d // q).sum(0)
        off = g0[:, None] - h0[None, :]
        sums -= n_terms * (off * off // h0)
        size = len(gs) * len(hs)
        return pa.table([pa.array([lang] * size, pa.string()), pa.array(np.repeat(gs, len(hs))), pa.array(np.tile(hs, len(gs))), pa.array(sums.ravel())], ["lang", "g", "h", "value"])

    return pair_sums


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS, flush_runs: int = FLUSH_RUNS, salts: int | None = None, chunk_terms: int = CHUNK_TERMS, block_size: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank."""
    counts = stored(term_counts(docs, least_docs, flush_runs, salts))
    used = counts.where("n > 0")
    langs = used.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # a language's sources are numbered: as many rows as its sources, whose pairs the result has anyway
    line = Window.partitionBy("lang").orderBy("source")
    known = counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    known = known.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    known = known.select("*", (F.row_number().over(line) - 1).cast("long").alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources"), share(F.lit(0), F.col("total"), F.col("v")).alias("p0"))
    groups = stored(known)
    placed = used.join(groups, ["lang", "source"]).select("lang", "term", "source", "lang_n", "v", "lang_total", "nth", "sources", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    return pairs(placed, groups, chunk_terms, block_size).unionByName(distinctive(placed, term_ranks))


def pairs(placed: DataFrame, groups: DataFrame, chunk_terms: int = CHUNK_TERMS, block_size: int = BLOCK) -> DataFrame:
    """The divergence of each group from each other source of its language. A count goes to the units of its chunk of terms that hold its block of sources, and so do the
    shares of absent terms; with block_size sources or fewer that is one unit a chunk."""
    n_chunks = F.ceil(F.col("v") / F.least(F.greatest(F.lit(chunk_terms), F.col("sources")), F.lit(MOST_CHUNK_TERMS))).cast("long")
    block = F.floor(F.col("nth") / block_size).cast("long")
    every = F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / block_size).cast("long"))
    meets = F.array_distinct(F.concat(F.transform(every, lambda x: F.struct(block.alias("bi"), x.alias("bj"))), F.transform(every, lambda x: F.struct(x.alias("bi"), block.alias("bj")))))
    of_terms = placed.select("lang", F.pmod(F.xxhash64("term"), n_chunks).alias("chunk"), "nth", "term", "p", F.explode(meets).alias("b"))
    heads = groups.where("v > 0").select("lang", "nth", "p0", meets.alias("bs"), F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("chunk"))
    heads = heads.select("lang", "chunk", "nth", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.explode("bs").alias("b"))
    units = of_terms.unionByName(heads).select("lang", "chunk", "b.bi", "b.bj", "nth", "term", "p")
    sums = units.groupBy("lang", "chunk", "bi", "bj").applyInArrow(each_released(_pair_sums(block_size)), "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("more"))
    g = groups.select("lang", "source", "v", F.col("nth").alias("g"), F.col("p0").alias("g0"))
    h = groups.select("lang", F.col("source").alias("item"), F.col("nth").alias("h"), F.col("p0").alias("h0"))
    both = g.join(h, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left")
    value = F.coalesce(F.col("v") * _gap(F.col("g0"), F.col("h0")) + F.coalesce("more", F.lit(0)), F.lit(0))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"), F.row_number().over(Window.partitionBy("lang", "source").orderBy(value.desc(), "item")).alias("rank"))


def distinctive(placed: DataFrame, term_ranks: int = TERM_RANKS) -> DataFrame:
    """Each group's terms above their language's share, by f, to a rank; partitions cut at the rank before they meet."""
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    above = placed.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    ranked = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= term_ranks)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS df FROM w GROUP BY lang, source, term
), k AS (
  SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, term HAVING sum(df) >= 3
), l AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang
), t AS (
  SELECT c.lang, c.source, CAST(sum(c.n) AS BIGINT) AS total FROM c JOIN k USING (lang, term) GROUP BY c.lang, c.source
), g AS (
  SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(t.total), 0) AS total
  FROM d LEFT JOIN l USING (lang) LEFT JOIN t ON t.lang = d.lang AND t.source = d.source GROUP BY d.lang, d.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
    1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

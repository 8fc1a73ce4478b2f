"""Rows of one id with different texts, rows that repeat, and very long texts: exact results and even work."""

import random
import time
from collections import Counter

import ahocorasick
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import common, lm_score, ngram_join, suffix_dedup, toxicity

from .fixtures import SCHEMA


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 11) for r in rows], SCHEMA).repartition(4)


def test_representatives_keep_unique_texts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text + " more"), (2, "another text that nothing else is like at all"), (3, text), (3, "short"), (None, text)]
    stay = sorted(((r.doc_id, r.text) for r in ngram_join.representatives(frame(spark, rows)).collect()), key=str)
    assert stay == sorted([(1, text), (2, rows[2][1]), (3, "short"), (None, text)], key=str)


def test_texts_of_one_id_are_joined_once(spark):
    """200 texts of one id, and 300 equal rows of another: one text for each class, not all pairs."""
    rows = [(7, f"text {i} of one id and of a kind with words {i} {i + 1} {i + 2}") for i in range(200)] + [(8, "the same text over and over again here")] * 300
    docs = ngram_join.texts(frame(spark, rows))
    nodes = docs.mapInArrow(ngram_join._sets, "doc_id long, digest long, n long, sig binary")
    stand = ngram_join.classes(nodes)
    wanted = stand.select("sig", "doc_id", "digest", "copies", F.col("sig").alias("cluster"))
    got = ngram_join.with_text(docs, wanted)
    assert stand.count() == 201 == got.count() and {r.copies for r in stand.select("copies").distinct().collect()} == {1, 300}
    assert ngram_join.with_text(docs, wanted, broadcast_rows=0).count() == 201
    links = ngram_join.link_components(frame(spark, rows)).collect()
    assert Counter(r.component_id for r in links) == {7: 200, 8: 300}


@pytest.mark.parametrize("hot", [None, 5])
def test_blocks_are_even_where_a_third_shares_an_id(spark, hot):
    rows = [(hot if i % 3 == 0 else i, f"text {i}") for i in range(1500)] + [(4, "again")] * 1500
    docs = frame(spark, rows).select("doc_id", F.lit(True).alias("flag"), F.col("text").cast("binary").alias("text"))
    sizes = Counter()
    for b in common.blocked(docs, 30).toArrow().to_batches():
        for block, doc_id, flag, text in common.unpacked(b):
            sizes[block] += 1
    assert sum(sizes.values()) == 3000 and max(sizes.values()) < 2 * 3000 / 30


@pytest.mark.parametrize("hot", [None, 5])
def test_operators_on_blocks_of_a_hot_id(spark, hot):
    """Results do not hang on how rows of one id are dealt: small blocks and large ones give the same."""
    r = random.Random(1)
    passage = "a passage of more than fifty bytes that many of these documents have in common"
    rows = [(hot if i % 3 == 0 else i, " ".join(r.choice("abcdefgh") * 3 for _ in range(20)) + (passage if i % 4 == 0 else "")) for i in range(120)] + [(hot, passage)] * 40
    df = frame(spark, rows)
    whole = lambda rows: sorted(map(str, rows.collect()))
    assert whole(suffix_dedup.without_repeats(df, block_bytes=200)) == whole(suffix_dedup.without_repeats(df, block_bytes=1 << 24))
    one, other = (sorted((str(x.doc_id), x.n_tokens, round(x.score, 6)) for x in lm_score.scored(df, block_bytes=b).collect()) for b in (500, 1 << 24))
    assert one == other


def naive_hits(entries, exceptions, text):
    """Heaviest entry at each place that no exception covers, by looking everywhere."""
    best = {}
    for e, w in entries.items():
        at = text.find(e)
        while at >= 0:
            best[at] = max(w, best.get(at, 0))
            at = text.find(e, at + 1)
    spared = [(at, at + len(e) - 1) for e in exceptions for at in range(len(text)) if text.startswith(e, at)]
    left = {at: w for at, w in best.items() if not any(s <= at < end for s, end in spared)}
    return sum(left.values()), max(left.values(), default=0), len(left)


def test_hits_and_exceptions_against_looking_everywhere():
    entries, exceptions = {" scum ": 3.0, " scu": 1.0, " idiot ": 2.5, " id": 0.5}, {" pond scum ", " scum of ", " of id card ", " pond scum of id card "}
    lexicon = toxicity.Lexicon(entries, exceptions, (0.0, 1.0, 1.0, 1.0))
    a = lexicon.automaton()
    assert isinstance(a, ahocorasick.Automaton)
    r = random.Random(2)
    for _ in range(200):
        text = toxicity.folded(" ".join(r.choice(("pond", "scum", "of", "id", "card", "idiot", "scumbag", "ѕсum", "1diot", "p0nd", "sc­um", "!")) for _ in range(r.randint(0, 30))))
        got, want = toxicity.hits(a, text), naive_hits(entries, exceptions, text)
        assert got[1:] == want[1:] and abs(got[0] - want[0]) < 1e-9


def test_a_very_long_text_of_exceptions_takes_seconds():
    lexicon = toxicity.Lexicon({" scum ": 3.0}, {" pond scum "}, (0.0, 1.0, 1.0, 1.0))
    began = time.time()
    _, n = toxicity.score_of(lexicon, lexicon.automaton(), "pond scum you scum " * 300_000)
    assert n == 300_000 and time.time() - began < 60

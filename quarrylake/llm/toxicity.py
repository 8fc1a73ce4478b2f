"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded (case, homoglyphs, invisible characters, digits and signs that stand for letters inside words), then one automaton pass finds
all lexicon entries: whole words, or word stems (entries that match at a word's start). Hits inside an exception phrase do not count. The score
is a logistic function of the hits' weight, its density by text length, and the heaviest hit.

Weights, exception phrases and the logistic curve are learnt from labelled rows outside the held-out fold, of which at most `fit_rows` are
taken, by hash order (the documented bound; they also bound the lexicon, which is broadcast). Everything else reads all rows and whole texts.
Neither labels nor lang, source or doc_id enter a score.

Defined results: null or empty text has no hit and gets the curve's value there (under 0.5); a very long text is read whole, and its hits are weighed against its length; entries that start
at one place count once, by the heaviest; without usable labels (none, or one class)
the built-in lexicon alone decides; repeated rows get equal scores; empty table: empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, released, shuffle_partitions, small_batches, stored, table, text_of

FIT_ROWS = 20_000
LEAST_DOCS = 5
LEAST_WEIGHT = 2.5
STEM_LENGTHS = range(4, 9)
CONTEXT_LEAST = 3
#: A base lexicon for corpora without labels; learnt weights replace these where there are any.
BASE_LEXICON = {"idiot": 3.0, "moron": 3.0, "scum": 3.0, "loser": 3.0, "stupid": 2.5, "pathetic": 2.5, "worthless": 2.5, "disgusting": 2.5}
#: Phrases in which an entry is no insult, added to those that are learnt.
BASE_EXCEPTIONS = ("trash can", "trash bin", "pond scum", "circus clown", "clown fish")

#: Homoglyphs: letters of other scripts, by the ASCII letter they look like.
LOOKALIKES = {"a": "аαɑ", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еεє", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ⅼӏ", "m": "м", "n": "ո", "o": "оοσ", "p": "рρ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ѡԝ", "x": "хχ", "y": "уγ", "z": "ᴢ"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = {ord(x): k for k, v in LOOKALIKES.items() for x in v} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {ord(x): None for x in INVISIBLE}
_DIGITS = str.maketrans(DIGITS)
_MIXED = re.compile(r"[0-9@$!]+(?=\w*[^\W\d_])[\w@$!]*|[^\W\d_]+[0-9@$!]+[\w@$!]*")
_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Words of the text in folded form, one space before and after each."""
    t = (text or "").lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    # digits stand for letters only in words that hold letters; a final "!" is punctuation
    if any(c in t for c in "0123456789@$!"):
        t = _MIXED.sub(lambda m: m[0].rstrip("!").translate(_DIGITS) + " " * m[0].endswith("!"), t)
    return " " + _GAP.sub(" ", t).strip() + " "


def features(text: str) -> set[str]:
    """Lexicon candidates in a folded text: " word " and " stem"."""
    out = set()
    for w in set(text.split()):
        if len(w) > 2:
            out.add(f" {w} ")
            out.update(" " + w[:n] for n in STEM_LENGTHS if n < len(w))
    return out


class Lexicon:
    """entries: folded entry -> weight; exceptions: folded phrases " a b "; curve: (bias, weights of the three features)."""

    def __init__(self, entries: dict[str, float], exceptions: set[str], curve: tuple[float, float, float, float]):
        self.entries, self.exceptions, self.curve = entries, exceptions, curve

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for e, w in self.entries.items():
            a.add_word(e, (len(e), w))
        for e in self.exceptions:
            a.add_word(e, (len(e), 0.0))
        a.make_automaton()
        return a if len(a) else None


def hits(a: ahocorasick.Automaton | None, text: str) -> tuple[float, float, int]:
    """Summed weight, heaviest weight and number of hits of a folded text; of the entries that match at one word the heaviest counts."""
    if a is None:
        return 0.0, 0.0, 0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in a.iter(text):
        start = end - n + 1
        if w:
            best[start] = max(w, best.get(start, 0.0))
        else:
            spared.append((start, end))
    if spared and best:
        # exceptions and hits by place: a hit is spared if an exception that begins by then ends after it
        spared.sort()
        reach, k = -1, 0
        for at in sorted(best):
            while k < len(spared) and spared[k][0] <= at:
                reach, k = max(reach, spared[k][1]), k + 1
            if at < reach:
                del best[at]
    return sum(best.values()), max(best.values(), default=0.0), len(best)


def _inputs(total: float, most: float, words: int) -> tuple[float, float, float]:
    return math.log1p(total), min(10.0, 100 * total / max(20, words)) / 10, most


def score_of(lexicon: Lexicon, a: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int]:
    t = folded(text)
    total, most, n = hits(a, t)
    b, *w = lexicon.curve
    z = b + sum(x * y for x, y in zip(w, _inputs(total, most, t.count(" ") - 1), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), n


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _document_counts(keep: frozenset[str] | None):
    @released
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for x in b.column("text"):
                f = features(folded(x.as_py()))
                c.update(f if keep is None else f & keep)
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["feature", "n"])

    return counted


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learns from the labelled rows of docs outside the held-out fold, at most fit_rows of them, the first by hash of doc_id."""
    small_batches(docs.sparkSession)
    base = Lexicon({f" {w} ": v for w, v in BASE_LEXICON.items()}, {f" {e} " for e in BASE_EXCEPTIONS}, (-4.0, 3.0, 1.0, 1.0))
    usable = labels.where("doc_id is not null and toxic is not null").where(fold_of() != held_out_fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    picked = [(r.doc_id, int(r.toxic)) for r in chosen.collect()]
    if len({y for _, y in picked}) < 2:
        return base
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    # written once: the passes below read at most fit_rows texts instead of all
    rows = stored(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").coalesce(max(1, shuffle_partitions(docs.sparkSession))))
    n_toxic, n_clean = sum(y for _, y in picked), sum(1 - y for _, y in picked)
    count = lambda df, keep: df.select("text").mapInArrow(_document_counts(keep), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    toxic = {r.feature: r.n for r in count(rows.where("toxic = 1"), None).where(F.col("n") >= LEAST_DOCS).collect()}
    clean = {r.feature: r.n for r in count(rows.where("toxic = 0"), frozenset(toxic)).collect()}
    weight = {f: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(f, 0) + 0.5) / (n_clean + 1)) for f, n in toxic.items()}
    entries: dict[str, float] = {}
    for f in sorted((f for f, w in weight.items() if w >= LEAST_WEIGHT), key=len):
        stem = next((f[:n] for n in range(5, len(f)) if f[:n] in entries), None)
        # a stem speaks for its extensions unless they are clearly more telling, e.g. because the stem also begins clean words
        if stem is None or weight[f] > entries[stem] + 1.5 and clean.get(stem, 0) > 0.02 * toxic[stem]:
            entries[f] = weight[f]
    for w, v in BASE_LEXICON.items():
        if f" {w} " not in weight and not any(f" {w} ".startswith(e) for e in entries):
            entries[f" {w} "] = v
    a = Lexicon(entries, set(), base.curve).automaton()

    @released
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two-word phrases around hits, with the label's counts."""
        found: Counter = Counter()
        for b in batches:
            for y, x in zip(b.column("toxic").to_pylist(), b.column("text"), strict=True):
                t = folded(x.as_py())
                phrases = set()
                for end, (n, _) in a.iter(t):
                    s = end - n + 1
                    e = t.index(" ", s + 1)
                    before, after = t.rfind(" ", 0, s) if s else -1, t.find(" ", e + 1)
                    if before >= 0:
                        phrases.add(t[before : e + 1])
                    if after >= 0:
                        phrases.add(t[s : after + 1])
                for p in phrases:
                    found[p, y] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["phrase", "toxic", "n"])

    exceptions = set(base.exceptions)
    if a is not None:
        seen = rows.mapInArrow(contexts, "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
        exceptions |= {r.phrase for r in seen.where((F.col("c") >= CONTEXT_LEAST) & (F.col("t") * 20 <= F.col("c"))).collect()}
    lexicon = Lexicon(entries, exceptions, base.curve)
    made = lexicon.automaton()

    @released
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("text"):
                t = folded(x.as_py())
                total, most, _ = hits(made, t)
                out.append(_inputs(total, most, t.count(" ") - 1))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *[pa.array(c, pa.float64()) for c in cols]], ["toxic", "a", "b", "c"])

    sample = rows.mapInArrow(inputs, "toxic int, a double, b double, c double").toPandas()
    return Lexicon(entries, exceptions, _logistic(sample[["a", "b", "c"]].to_numpy(), sample["toxic"].to_numpy(float)))


def _scores(lexicon):
    @released
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lexicon.value
        a = made.automaton()
        for b in batches:
            out = [score_of(made, a, x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([s for s, _ in out], pa.float64()), pa.array([int(s >= 0.5) for s, _ in out], pa.int32()), pa.array([n for _, n in out], pa.int32())], ["doc_id", "held_out", "score", "predicted", "n_hits"])

    return scored


def scores(docs: DataFrame, lexicon: Lexicon, held_out_fold: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, n_hits."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select("doc_id", (fold_of() == held_out_fold).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(_scores(shared), "doc_id long, held_out boolean, score double, predicted int, n_hits int")


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the lexicon does not find toxic, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @released
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        a = made.automaton()
        for b in batches:
            yield b.filter(pa.array([score_of(made, a, x.as_py())[0] < threshold for x in b.column("text")], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))

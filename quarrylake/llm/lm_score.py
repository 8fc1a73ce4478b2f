"""Language-model scores by a weighted backoff automaton.

The automaton: each kept word sequence is a state with arcs to its continuations (log10 weights) and a failure arc to the
state of its longest kept suffix (log10 backoff weight). A text is read once, left to right: the state follows an arc where
there is one, else it adds the failure weight and tries again from the shorter state, down to the root, whose arcs are all words.

Every sequence of two to `order` words that the training texts hold MIN_COUNT times is kept, at every size of the input. So the automaton grows with
the corpus and never sits in one place: blocks of documents ask for the parts that their texts visit.
1. Each block sends its distinct words and sequences with their counts, packed by bucket; a bucket adds up and answers each block.
2. A state's backoff weight needs all its kept continuations. Of each kept sequence one block is told that it is the owner; blocks send the
   sums over the sequences they own by context, packed by bucket, and get back the sums of all blocks.
3. Each block has the arcs and failure weights of its states and reads its texts, all places of a level at once.
Sequences travel as sorted 64-bit hashes; two of N sequences share one with a chance of about N^2 / 2^65 (words travel as they are).

Smoothing: absolute discounting, interpolated weights stored backoff-style: a kept sequence's arcs give
(c - D) / c(h) + gamma(h) p(w | shorter), everything else gamma(h) p(w | shorter), so each state's
distribution sums to one. At the root, D times the number of word types is the mass of the one unknown word.

Defined results: null text is empty; every text ends with one end token, so an empty text has n_tokens 1; rows that repeat
count and are scored each; without any training row N is 0, base_score is sum log10(0.5 / 0.5) = 0 and all words are unknown;
empty table: empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocked, each_released, fold_of, pieces_of, released, small_batches, stored, table, text_of, unpacked

ORDER = 3
MIN_COUNT = 2
DISCOUNT = 0.75
BLOCK_BYTES = 12 << 20
END = b"\n"  # no word holds white space
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens_of(text: str | bytes | None) -> list[bytes]:
    """Words and the end token. bytes.lower() folds A-Z only; bytes.split() parts at the six ASCII white space characters."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    out = raw.lower().split()
    out.append(END)
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.as_py() for x in b.column("text")]
        tokens = sum(len(x.split()) + 1 for x, t in zip(texts, b.column("train").to_pylist(), strict=True) if t)
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, texts))], pa.int64()), pa.array([tokens], pa.int64())], ["n_bytes", "tokens"])


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of sequences, each longer by a word than those of h."""
    z = (h ^ (h >> np.uint64(32))) * _A + w
    z ^= z >> np.uint64(29)
    z *= _B
    return z ^ (z >> np.uint64(32))


def _press(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, their first bytes side by side, then their second ..."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpress(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(b.reshape(8, -1).T).view(np.uint64).ravel()


def _steps(h: np.ndarray) -> bytes:
    return _press(np.diff(h, prepend=np.uint64(0)))


def _walked(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpress(raw), dtype=np.uint64)


def _cuts(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin: buckets are ranges."""
    return np.searchsorted(h, np.array([-(-(b << 64) // n_buckets) for b in range(n_buckets)], np.uint64)).tolist() + [len(h)]


class _Block:
    """The texts of a block as word numbers, and their sequences: for n words, at[n] are the places where they start, seqs[n] the sorted distinct
    hashes, which[n] the number of the sequence at each place and one[n] a place of each sequence."""

    def __init__(self, docs: pa.Table, order: int):
        from xxhash import xxh3_64_intdigest as hash_of

        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        self.doc_ids, self.train, parts = [], [], []
        for _, doc_id, train, text in unpacked(docs):
            words = tokens_of(text)
            self.doc_ids.append(doc_id)
            self.train.append(train)
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.words = list(number)
        self.length = np.array([len(x) for x in parts], np.int64)
        self.w = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.doc = np.repeat(np.arange(len(parts), dtype=np.int32), self.length)
        self.in_train = np.repeat(np.array(self.train, bool), self.length)
        self.word_hash = np.fromiter(map(hash_of, self.words), np.uint64, len(self.words))
        self.at, self.seqs, self.which, self.one = {}, {}, {1: self.w}, {}
        own = self.word_hash[self.w]
        h = own
        for n in range(2, order + 1):
            m = max(0, len(own) - n + 1)
            h = _mixed(h[:m], own[n - 1 :][:m])
            self.at[n] = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :][:m]).astype(np.int32)
            self.seqs[n], one, which = np.unique(h[self.at[n]], return_index=True, return_inverse=True)
            self.one[n], self.which[n] = one.astype(np.int32), which.astype(np.int32)
            del one, which

    def dealt_words(self, n_buckets: int) -> tuple[np.ndarray, list[int]]:
        """The numbers of the words by bucket and hash, and where each bucket begins. The order is the same in all runs."""
        bucket = (self.word_hash % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((self.word_hash, bucket))
        return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1)).tolist()

    def counts(self, n: int) -> np.ndarray:
        at = self.at[n] if n > 1 else np.arange(len(self.w))
        return np.bincount(self.which[n][self.in_train[at]], minlength=len(self.seqs[n]) if n > 1 else len(self.words))

    def context(self, n: int) -> np.ndarray:
        """The number of the first n - 1 words of each sequence of n."""
        place = self.at[n][self.one[n]]
        return self.w[place] if n == 2 else self.which[n - 1][np.searchsorted(self.at[n - 1], place)]


ASKED = "bucket long, block long, words binary, counts binary, seqs array<binary>, seq_counts array<binary>"


def _requests(n_buckets: int, order: int):
    def packed(docs: pa.Table) -> pa.Table:
        """A block's distinct words and sequences and how often its training texts hold them, packed by bucket."""
        b = _Block(docs, order)
        count = b.counts(1)
        by_bucket, edge = b.dealt_words(n_buckets)
        cuts = {n: _cuts(b.seqs[n], n_buckets) for n in b.seqs}
        each = {n: b.counts(n) for n in b.seqs}
        block, rows = docs.column("block")[0].as_py(), []
        for k in range(n_buckets):
            ix = by_bucket[edge[k] : edge[k + 1]]
            parts = [(n, slice(cuts[n][k], cuts[n][k + 1])) for n in b.seqs]
            if len(ix) or any(p.stop > p.start for _, p in parts):
                rows.append((k, block, b" ".join([b.words[i] for i in ix.tolist()]), _press(count[ix]), [_steps(b.seqs[n][p]) for n, p in parts], [_press(each[n][p]) for n, p in parts]))
        return _as_table(rows, ASKED)

    return packed


def _as_table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split(" ") for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table({k: pa.array(c, kinds[t]) for (k, t), c in zip(fields, cols, strict=True)})


def _unpack(words: bytes) -> list[bytes]:
    # the end token is white space itself; the join puts spaces between words, so only a space parts them
    return words.split(b" ")


ANSWER = "block long, kind long, bucket long, counts binary, parts array<binary>, bucket_types long"


def _split(x: np.ndarray, each: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(x, np.cumsum([len(e) for e in each])[:-1])


def _counted(least: float):
    def merged(t: pa.Table) -> pa.Table:
        """Adds up one bucket's words and sequences and answers each block in the order it asked: the counts of words; for a kept sequence twice its count,
        and 1 more for its owner; the bucket's number of word types goes with its first row."""
        total: Counter = Counter()
        each = []
        for words, counts in zip(t.column("words"), t.column("counts"), strict=True):
            w, c = _unpack(words.as_py()), _unpress(counts.as_py())
            w = w if len(c) else []
            each.append(w)
            for x, n in zip(w, c.tolist(), strict=True):
                total[x] += n
        asked, given = t.column("seqs").to_pylist(), t.column("seq_counts").to_pylist()
        answers: list[list[bytes]] = [[] for _ in asked]
        for n in range(len(asked[0])):
            hs = [_walked(x[n]) for x in asked]
            seqs, first, which = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
            count = np.bincount(which, np.concatenate([_unpress(x[n]) for x in given]), len(seqs)).astype(np.int64)
            count[count < least] = 0
            reply = 2 * count[which]
            reply[first] += count > 0
            for row, x in zip(answers, _split(reply, hs), strict=True):
                row.append(_press(x))
        types = sum(1 for n in total.values() if n)
        at, bucket = t.column("block").to_pylist(), t.column("bucket")[0].as_py()
        return _as_table([(at[i], 0, bucket, _press(np.array([total[x] for x in w], np.int64)), answers[i], 0 if i else types) for i, w in enumerate(each)], ANSWER)

    return merged


class _Counts:
    """The answers to a block: count[n] of its words and kept sequences, owned[n] of its sequences."""

    def __init__(self, b: _Block, answers: pa.Table, order: int, n_buckets: int):
        rows = sorted((r for r in answers.to_pylist() if not r["kind"]), key=lambda r: r["bucket"])
        words = np.empty(len(b.words), np.int64)
        words[b.dealt_words(n_buckets)[0]] = np.concatenate([_unpress(r["counts"]) for r in rows])
        self.count, self.owned = {1: words}, {}
        for n in range(2, order + 1):
            reply = np.concatenate([np.empty(0, np.uint64), *[_unpress(r["parts"][n - 2]) for r in rows]]).astype(np.int64)
            self.count[n], self.owned[n] = reply >> 1, (reply & 1) > 0

    def states(self, b: _Block, n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of the n-word contexts that may be states, by hash."""
        ix = np.flatnonzero(self.count[n] >= least)
        h = b.word_hash[ix] if n == 1 else b.seqs[n][ix]
        by_hash = np.argsort(h, kind="stable")
        return ix[by_hash], h[by_hash]


HELD = "bucket long, block long, seqs array<binary>, sums array<binary>, types array<binary>"


def _contexts(n_buckets: int, order: int, least: float):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """The contexts of a block, with the counts and the number of the continuations that it owns."""
        if not docs.num_rows:
            return _as_table([], HELD)
        b = _Block(docs, order)
        c, levels = _Counts(b, answers, order, n_buckets), []
        for n in range(1, order):
            ix, h = c.states(b, n, least)
            mine, size = b.context(n + 1)[c.owned[n + 1]], len(c.count[n])
            sums, types = np.bincount(mine, c.count[n + 1][c.owned[n + 1]], size), np.bincount(mine, minlength=size)
            levels.append((h, sums[ix], types[ix], _cuts(h, n_buckets)))
        block, rows = docs.column("block")[0].as_py(), []
        for k in range(n_buckets):
            own = [(h[e[k] : e[k + 1]], s[e[k] : e[k + 1]], t[e[k] : e[k + 1]]) for h, s, t, e in levels]
            if any(len(h) for h, _, _ in own):
                rows.append((k, block, [_steps(h) for h, _, _ in own], [_press(s) for _, s, _ in own], [_press(t) for _, _, t in own]))
        return _as_table(rows, HELD)

    return cut


def _summed(t: pa.Table) -> pa.Table:
    """Adds up the continuations of a bucket's contexts: each block gets sums and numbers in the order it asked."""
    asked = t.column("seqs").to_pylist()
    answers: list[list[bytes]] = [[] for _ in asked]
    for n in range(len(asked[0])):
        hs = [_walked(x[n]) for x in asked]
        seqs, which = np.unique(np.concatenate(hs), return_inverse=True)
        for column in ("sums", "types"):
            every = np.bincount(which, np.concatenate([_unpress(x[n]) for x in t.column(column).to_pylist()]), len(seqs)).astype(np.int64)
            for row, x in zip(answers, _split(every[which], hs), strict=True):
                row.append(_press(x))
    bucket = t.column("bucket")[0].as_py()
    return _as_table([(block, 1, bucket, _press(np.empty(0, np.int64)), a, 0) for block, a in zip(t.column("block").to_pylist(), answers, strict=True)], ANSWER)


class Automaton:
    """The automaton in one place, read word by word; `scored` gives the same weights (for small models and tests). States are numbers: 0 is the root. arcs: (state, word number) -> (weight, next state); fail: state -> (weight, state).
    Words that occur in no kept sequence have number 0 and lead to the root."""

    def __init__(self, ids: dict[bytes, int], counts: list[int], sequences: list[tuple[np.ndarray, np.ndarray]], tokens: int, types: int, discount: float):
        self.ids, self.tokens, self.types, self.discount = ids, tokens, types, discount
        base = len(ids) + 1
        unigram = [0.0, *[(c - discount) / tokens for c in counts]] if tokens else [0.0]
        state_of: dict[tuple[int, ...], int] = {}
        grams: list[dict[tuple[int, ...], int]] = [{(i + 1,): c for i, c in enumerate(counts)}]
        for n, (seq, count) in enumerate(sequences, 2):
            level = {}
            for s, c in zip(seq.tolist(), count.tolist(), strict=True):
                parts = []
                for _ in range(n):
                    s, r = divmod(s, base)
                    parts.append(r)
                level[tuple(reversed(parts))] = c
            grams.append(level)
        contexts = {g[:-1] for level in grams[1:] for g in level}
        for i, h in enumerate(sorted(contexts, key=lambda h: (len(h), h)), 1):
            state_of[h] = i
        self.count = len(state_of) + 1
        self.fail: list[tuple[float, int]] = [(0.0, 0)] * self.count
        self.arcs: dict[int, tuple[float, int]] = {}
        self.base = base
        # the mass that a state's kept continuations leave to the shorter state
        left = {h: [0.0, 0] for h in state_of}
        for level in grams[1:]:
            for g, c in level.items():
                left[g[:-1]][0] += c
                left[g[:-1]][1] += 1
        total = {h: grams[len(h) - 1][h] for h in state_of}
        gamma = {h: 1 - (left[h][0] - discount * left[h][1]) / total[h] for h in state_of}
        prob: dict[tuple[int, ...], float] = {(i,): p for i, p in enumerate(unigram) if i}
        suffix = lambda g: next((state_of[g[k:]] for k in range(len(g)) if g[k:] in state_of), 0)
        self.start_of = [0] * base
        for i in range(1, base):
            self.start_of[i] = state_of.get((i,), 0)
        for n, level in enumerate(grams[1:], 2):
            for g, c in level.items():
                h = g[:-1]
                short = self._lower(prob, gamma, g[1:], n)
                prob[g] = (c - discount) / total[h] + gamma[h] * short
        for h, i in state_of.items():
            self.fail[i] = (math.log10(gamma[h]) if gamma[h] > 0 else -99.0, suffix(h[1:]) if len(h) > 1 else 0)
        for level in grams[1:]:
            for g in level:
                end = state_of.get(g) if len(g) < len(grams) else None
                self.arcs[state_of[g[:-1]] * base + g[-1]] = (math.log10(prob[g]), end if end is not None else suffix(g[1:]))

    @staticmethod
    def _lower(prob, gamma, g, n):
        """Probability of the last word of g after the rest of g, backing off."""
        if g in prob:
            return prob[g]
        return gamma.get(g[:-1], 1.0) * Automaton._lower(prob, gamma, g[1:], n) if len(g) > 1 else prob.get(g, 0.0)

    def root_weights(self, counts: np.ndarray) -> np.ndarray:
        """log10 weights of the root's arcs for words with these counts; 0: the unknown word."""
        if not self.tokens:
            return np.zeros(len(counts))
        unknown = self.discount * self.types / self.tokens
        return np.log10(np.where(counts > 0, (counts - self.discount) / self.tokens, unknown))

    def walk(self, numbers: list[int], roots: list[float]) -> float:
        """One traversal. numbers: word numbers; roots: the root's weight of each word."""
        state, total, base, arcs, fail, start = 0, 0.0, self.base, self.arcs, self.fail, self.start_of
        for w, r in zip(numbers, roots, strict=True):
            if not w:
                while state:
                    weight, state = fail[state]
                    total += weight
                total += r
                continue
            while True:
                if not state:
                    total += r
                    state = start[w]
                    break
                arc = arcs.get(state * base + w)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                weight, state = fail[state]
                total += weight
        return total


def _scored(n_buckets: int, order: int, least: float, tokens: int, types: int, discount: float):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
        b = _Block(docs, order)
        b.one, b.in_train = {}, None
        c = _Counts(b, answers, order, n_buckets)
        sums = sorted((r for r in answers.to_pylist() if r["kind"]), key=lambda r: r["bucket"])
        n_docs, count = len(b.doc_ids), c.count[1]
        # the root's arcs; D for each word type is the mass of the unknown word
        weight = np.log10(np.where(count > 0, (count - discount) / tokens, discount * types / tokens))[b.w] if tokens else np.zeros(len(b.w))
        for n in range(2, order + 1):
            ix, _ = c.states(b, n - 1, least)
            kept, kinds_of = (np.concatenate([np.empty(0), *[_unpress(r["parts"][2 * (n - 2) + j]) for r in sums]]) for j in (0, 1))
            fail = np.zeros(len(c.count[n - 1]))
            fail[ix] = np.log10(1 - (kept - discount * kinds_of) / c.count[n - 1][ix])
            # at each place: the state before the last word, and the arc from it where there is one
            start = b.at[n]
            state = b.w[start] if n == 2 else b.which[n - 1][np.searchsorted(b.at[n - 1], start)]
            seen, last = c.count[n][b.which[n]], start + n - 1
            short = fail[state] + weight[last]
            arc = seen > 0
            short[arc] = np.log10((seen[arc] - discount) / c.count[n - 1][state[arc]] + 10 ** short[arc])
            weight[last] = short
        base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))[b.w]
        per_doc = lambda x: np.bincount(b.doc, x, n_docs)
        cols = [b.doc_ids, ~np.array(b.train, bool), b.length, per_doc(count[b.w] > 0).astype(np.int64), [tokens] * n_docs, per_doc(base), per_doc(weight)]
        return pa.table({k: pa.array(x, t) for k, x, t in zip(names, cols, kinds, strict=True)})

    return score


def scored(docs: DataFrame, held_out_fold: int = 1, order: int = ORDER, share: float = 0.0, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A share above 0 asks for a smaller model: only
    sequences that make up this share of all tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", (fold_of() != held_out_fold).alias("train"), text_of().cast("binary").alias("text"))
    n_bytes, tokens = rows.mapInArrow(released(_sizes), "n_bytes long, tokens long").agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    least = max(float(MIN_COUNT), share * tokens)
    n = pieces_of(spark, n_bytes, block_bytes)
    dealt = blocked(rows.withColumnRenamed("train", "flag"), n)
    asked = dealt.groupBy("block").applyInArrow(each_released(_requests(n, order)), ASKED)
    counts = stored(asked.groupBy("bucket").applyInArrow(each_released(_counted(least)), ANSWER))
    types = counts.agg(F.coalesce(F.sum("bucket_types"), F.lit(0))).first()[0]
    held = dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(each_released(_contexts(n, order, least)), HELD)
    answers = counts.unionAll(held.groupBy("bucket").applyInArrow(each_released(_summed), ANSWER))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each_released(_scored(n, order, least, tokens, types, discount)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))

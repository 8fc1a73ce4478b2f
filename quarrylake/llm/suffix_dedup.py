"""Removal of repeated 50-byte passages by longest-previous-factor arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Two facts make this a shuffle
of little: any 50-byte window holds the minimizer of its 24-grams, so equal windows share it; and only minimizers that
two documents share matter.

1. Documents are dealt to blocks by id (the one shuffle of texts, read three times). Each block packs its minimizers' hashes by
   hash range and learns which of them occur in more than one document anywhere.
2. For these, a block cuts the runs of windows with one minimizer ("super-grams", about 65 bytes for 14 windows). Equal
   super-grams of a block travel once, with the smallest doc_id and all their places in its text: later documents of the block are covered by it. So a passage
   that a third of all rows hold travels at most once a block.
   A minimizer that `crowd` documents hold is dealt window by window, by the window's own bytes, so that no bucket gets all its contexts.
3. A bucket holds all windows of its minimizers. They are put in suffix order (to depth 50). In that order the previous and the next
   entry of a smaller document are the only candidates for the longest previous factor (windows whose digest is unique are left out of the order, the rest go through in portions); it reaches 50 bytes where no
   boundary of neighbours that differ within 50 bytes lies between. Arrays of running minima find both.
4. Covered intervals go back to the blocks, which unite them and digest what is left.

Defined results: null text is empty; texts under 50 bytes lose nothing; very long texts are treated whole, each in its block; other columns are not looked at, whatever their names; matches within one document do not count, nor do those
between rows that share a doc_id; a null doc_id counts as greater than all ids, and such rows do not cover each other; empty
table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocked, each_released, pieces_of, released, small_batches, stored, table, text_of, unpacked

LENGTH = 50
GRAM = 24
BLOCK_BYTES = 12 << 20
PORTION = 1 << 20
MOST = 80
CROWD = 1 << 16
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)
_NULL = np.iinfo(np.int64).max


def _words8(b: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, as one integer."""
    n = len(b) - 7
    w = np.zeros(n, np.uint64)
    for j in range(8):
        w |= b[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    return w


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), then those from first[1]."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def gram_hashes(w: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings; w: the eight bytes at each place."""
    n = len(w) + 8 - GRAM
    h = w[:n] * _A
    h ^= h >> np.uint64(31)
    for j in range(8, GRAM, 8):
        h = (h + w[j : j + n]) * _B
        h ^= h >> np.uint64(29)
    return h * _A


def minimizers(w: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte window: the smallest hash of its grams."""
    m, have, want = gram_hashes(w), 1, LENGTH - GRAM + 1
    while have < want:
        step = min(have, want - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


def _runs(texts: list[bytes], portion: int = PORTION) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of windows with one minimizer, in portions of about a megabyte: words (the eight bytes at each place), start and end there, text, start in the text,
    minimizer (48 bits). Long texts come in stretches that overlap by a window less one byte."""
    held, parts = 0, []
    for i, t in enumerate(texts):
        for at in range(0, len(t) - LENGTH + 1, portion):
            parts.append((i, at, t[at : at + portion + LENGTH - 1]))
            held += len(parts[-1][2])
            if held >= portion:
                yield _runs_of(parts)
                held, parts = 0, []
    if parts:
        yield _runs_of(parts)


def _runs_of(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    words = _words8(np.frombuffer(b"".join(t for _, _, t in parts), np.uint8))
    m = minimizers(words)
    size = np.array([len(t) for _, _, t in parts], np.int64)
    first = np.cumsum(size) - size
    inside = np.ones(len(m) + 2, bool)
    inside[0] = inside[-1] = False
    # no window reaches into the next part
    inside[1 + _ranges(first[1:] - LENGTH + 1, np.full(len(size) - 1, LENGTH - 1))] = False
    same = np.zeros(len(m) + 1, bool)
    same[1:-1] = m[1:] == m[:-1]
    start = np.flatnonzero(inside[1:-1] & ~(inside[:-2] & same[:-1]))
    end = np.flatnonzero(inside[1:-1] & ~(inside[2:] & same[1:])) + LENGTH
    of = np.searchsorted(first, start, side="right") - 1
    text, at = (np.array([x[k] for x in parts], np.int64)[of] for k in (0, 1))
    return words, start, end, text, start - first[of] + at, _short(m[start])


def _short(m: np.ndarray) -> np.ndarray:
    """48 bits of each minimizer, dealt evenly: minimizers themselves are small numbers, and most of them would fall into the first buckets."""
    z = m * _A
    z ^= z >> np.uint64(32)
    return (z * _B) >> np.uint64(16)


def _press(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpress(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), kind)


def _sent(h: np.ndarray) -> bytes:
    """Sorted hashes: the first, then 4-byte steps; 8 bytes each where a step is longer."""
    steps = np.diff(h)
    if len(steps) and steps.max() >> np.uint64(32):
        return b"\x08" + h.tobytes()
    return b"\x04" + h[:1].tobytes() + steps.astype(np.uint32).tobytes()


def _got(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        return np.frombuffer(raw, np.uint64, offset=1)
    first = np.frombuffer(raw, np.uint64, 1, 1)
    return np.concatenate([first, first + np.cumsum(np.frombuffer(raw, np.uint32, offset=9), dtype=np.uint64)])


def _by_bucket(h: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of 48-bit hashes by range: yields bucket and the indices that fall in it."""
    bucket = ((h * np.uint64(n_buckets)) >> np.uint64(48)).astype(np.int64) if n_buckets < 1 << 16 else (h % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = bucket[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    for ix in np.split(order, cuts):
        if len(ix):
            yield int(bucket[ix[0]]), ix


ANCHORS = "bucket long, block long, hashes binary, often binary, numbers binary"
OFTEN = 8


def _anchors(n_buckets: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct minimizers of each block, those of two documents twice; and how many documents hold those that are frequent."""
        blocks: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for row in range(b.num_rows):
                mine = list(unpacked(b.slice(row, 1)))
                for _, _, _, text, _, h in _runs([t for _, _, _, t in mine]):
                    order = np.lexsort((text, h))
                    h, text = h[order], text[order]
                    fresh = np.ones(len(h), bool)
                    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                    blocks.setdefault(mine[0][0], []).append(h[fresh])
        for block, each in blocks.items():
            h, n = np.unique(np.concatenate(each), return_counts=True)
            rows = []
            for bucket, ix in _by_bucket(h, n_buckets):
                often = ix[n[ix] >= OFTEN]
                rows.append((bucket, block, _sent(np.repeat(h[ix], np.minimum(n[ix], 2))), h[often].tobytes(), n[often].astype(np.int64).tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(cols)], [x.split()[0] for x in ANCHORS.split(", ")])

    return packed


def _shared(crowd: int):
    def shared(t: pa.Table) -> pa.Table:
        """The hashes of a bucket that more than one document holds, for each block that holds them, and those that about `crowd` documents hold."""
        hs = [_got(x.as_py()) for x in t.column("hashes")]
        every = np.sort(np.concatenate(hs))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        often = np.concatenate([every, *[np.frombuffer(x.as_py(), np.uint64) for x in t.column("often")]])
        number = np.concatenate([np.ones(len(every), np.int64), *[np.frombuffer(x.as_py(), np.int64) for x in t.column("numbers")]])
        h, at = np.unique(often, return_inverse=True)
        crowded = h[np.bincount(at, number, len(h)) >= crowd]
        rows = []
        for block, mine in zip(t.column("block").to_pylist(), hs, strict=True):
            own = np.unique(mine)
            if len(own := own[np.isin(own, twice, assume_unique=True)]):
                rows.append((block, _sent(own), crowded[np.isin(crowded, own)].tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.table({k: pa.array(c, pa.int64() if k == "block" else pa.binary()) for k, c in zip(("block", "hashes", "crowded"), cols, strict=True)})

    return shared


SUPER = "bucket long, block long, texts binary, lengths binary, docs binary, n_places binary, rows binary, starts binary, covered_rows binary, covered_starts binary, covered_ends binary"


def _ordered(docs: pa.Table) -> list[tuple[int, bytes, int | None]]:
    """The rows of a block by id and text: a row's number in this order is its key."""
    return sorted(((_NULL if d is None else d, t, d) for _, d, _, t in unpacked(docs)), key=lambda x: x[:2])


def _gram_digests(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """128-bit hashes (two columns) of the byte strings of at most MOST bytes that start here; words: the text's eight bytes at each place."""
    out = np.empty((len(start), 2), np.uint64)
    for k, (a, b) in enumerate(((_A, _B), (_B, _A))):
        h = length.astype(np.uint64) * a
        # from the front up to 48 bytes, then the last 32: together all of a string of 50 to MOST bytes
        for at in (*(start + j for j in range(0, 48, 8)), *(start + length - j for j in (8, 16, 24, 32))):
            h = (h ^ words[at]) * b
            h ^= h >> np.uint64(29 + 2 * k)
        out[:, k] = h * a
    return out


def _pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-grams cut to MOST bytes, so that all their windows stand in one piece (only periodic texts have longer ones): which super-gram, start, end."""
    step = MOST - LENGTH + 1
    n = 1 + np.maximum(0, end - start - MOST + step - 1) // step
    which = np.repeat(np.arange(len(start)), n)
    s = start[which] + step * _ranges(np.zeros(len(n), np.int64), n)
    return which, s, np.minimum(s + MOST, end[which])


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, portion: int = 20_000) -> np.ndarray:
    """Whether the strings of these lengths that start at a and at b are equal."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), portion):
        n = length[lo : lo + portion]
        differ = data[_ranges(a[lo : lo + portion], n)] != data[_ranges(b[lo : lo + portion], n)]
        out[lo : lo + portion] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
    return out


def _supergrams(n_buckets: int):
    def cut(docs: pa.Table, shared: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and shared.num_rows:
            block = docs.column("block")[0].as_py()
            known = np.sort(np.concatenate([_got(x.as_py()) for x in shared.column("hashes")]))
            crowded = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in shared.column("crowded")])
            rows = _ordered(docs)
            size = np.array([len(t) for _, t, _ in rows], np.int64)
            text_at = np.cumsum(size) - size
            found = []
            for words, start, end, text, at, h in _runs([t for _, t, _ in rows]):
                place = np.searchsorted(known, h)
                place[place == len(known)] = 0
                hit = known[place] == h
                which, s, e = _pieces(start[hit], end[hit])
                text, at, h = text[hit][which], (at[hit] - start[hit])[which] + s, h[hit][which]
                if len(crowded) and (many := np.isin(h, crowded)).any():
                    # windows of a crowded minimizer are dealt one by one, each by its own bytes
                    k = e[many] - s[many] - LENGTH + 1
                    w = _ranges(s[many], k)
                    text, at = np.concatenate([text[~many], np.repeat(text[many], k)]), np.concatenate([at[~many], np.repeat(at[many] - s[many], k) + w])
                    h = np.concatenate([h[~many], _digests(words, w) >> np.uint64(16)])
                    s, e = np.concatenate([s[~many], w]), np.concatenate([e[~many], w + LENGTH])
                found.append((text.astype(np.int32), at, e - s, h, _gram_digests(words, s, e - s)))
            if not found:
                return _as_table(out)
            row_of, shift, length, mini, digest = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            texts = np.frombuffer(b"".join(t for _, t, _ in rows), np.uint8)
            start, doc = text_at[row_of] + shift, np.array([k for k, _, _ in rows], np.int64)[row_of]
            # equal super-grams of a block travel once: rows come by doc_id, so the first place is one of the smallest document
            order = np.lexsort((row_of, digest[:, 1], digest[:, 0]))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (digest[order[1:]] != digest[order[:-1]]).any(axis=1)
            del digest
            first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
            again = ~fresh
            again[again] = _same_bytes(texts, start[order[again]], start[first[again]], length[order[again]])
            head = np.empty(len(order), np.int64)
            head[order] = np.where(again, first, order)
            del fresh, first, again, order
            covered = doc[head] < doc
            cov = np.stack([row_of[covered], shift[covered], shift[covered] + length[covered]], axis=1).astype(np.int64)
            # the places of a super-gram in the documents that no smaller one of the block covers
            stay = np.flatnonzero(~covered)
            stay = stay[np.argsort(head[stay], kind="stable")]
            leads = np.flatnonzero(head == np.arange(len(head)))
            n_places = np.bincount(np.searchsorted(leads, head[stay]), minlength=len(leads))
            begin = np.cumsum(n_places) - n_places
            row, shift = row_of[stay].astype(np.int32), shift[stay].astype(np.int32)
            for bucket, ix in _by_bucket(mini[leads], n_buckets):
                own = cov if not out else cov[:0]  # travels with the block's first row
                g = leads[ix]
                places = _ranges(begin[ix], n_places[ix])
                out.append((bucket, block, _press(texts[_ranges(start[g], length[g])]), _press(length[g].astype(np.uint32)), _press(doc[g]), _press(n_places[ix].astype(np.uint32)), _press(row[places]), _press(shift[places]), *(_press(np.ascontiguousarray(own[:, k])) for k in range(3))))
        return _as_table(out)

    return cut


def _as_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
    names = [x.split()[0] for x in SUPER.split(", ")]
    return pa.table({n: pa.array(c, pa.int64() if n in ("bucket", "block") else pa.binary()) for n, c in zip(names, cols, strict=True)})


def previous_factors(windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """windows: byte strings of one length; docs: their documents. True where that string also starts in a smaller
    document: in suffix order, the previous smaller or the next smaller document is reached before a neighbour differs."""
    if len(windows) < 2:
        return np.zeros(len(windows), bool)
    order = np.argsort(windows, kind="stable")
    w, d = windows[order], np.unique(docs, return_inverse=True)[1].astype(np.int64)[order]
    lcp_short = np.concatenate([[True], w[1:] != w[:-1]])
    run = np.cumsum(lcp_short)
    big = int(d.max()) + 2
    # running minima that start anew with each run: a later run's values all lie below an earlier one's
    down = np.minimum.accumulate(d - run * big)
    previous = np.concatenate([[False], (down[:-1] < (d - run * big)[1:]) & ~lcp_short[1:]])
    back = (d - (run[-1] - run) * big)[::-1]
    up = np.minimum.accumulate(back)
    following = np.concatenate([[False], (up[:-1] < back[1:]) & (run[::-1][1:] == run[::-1][:-1])])[::-1]
    out = np.empty(len(w), bool)
    out[order] = previous | following
    return out


def _digests(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows that start at these places; w: the eight bytes at each place."""
    h = np.zeros(len(at), np.uint64)
    for j in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        h += w[at + j]
        h *= _B
        h ^= h >> np.uint64(29)
    return h * _A


def _alike(digest: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """Indices of the windows whose digest occurs twice, in portions that keep equal ones together; the others have no earlier match."""
    order = np.argsort(digest, kind="stable")
    d = digest[order]
    twice = np.zeros(len(d), bool)
    twice[1:] = d[1:] == d[:-1]
    twice[:-1] |= twice[1:]
    order, d = order[twice], d[twice]
    start = 0
    while start < len(order):
        end = min(start + most, len(order))
        end = int(np.searchsorted(d, d[end - 1], side="right"))
        yield order[start:end]
        start = end


def _factors(t: pa.Table) -> pa.Table:
    """Intervals of covered windows in one bucket, by block."""
    data = np.concatenate([_unpress(x, np.uint8) for x in t.column("texts")])
    lengths = [_unpress(x, np.uint32).astype(np.int64) for x in t.column("lengths")]
    docs = np.concatenate([_unpress(x, np.int64) for x in t.column("docs")])
    n_places = np.concatenate([_unpress(x, np.uint32) for x in t.column("n_places")])
    block_of = np.repeat(np.array(t.column("block").to_pylist(), np.int64), [len(x) for x in lengths])
    length = np.concatenate(lengths)
    n = length - LENGTH + 1
    first = np.cumsum(length) - length
    digests, owns, places = [], [], []
    cuts = np.searchsorted(first, np.arange(PORTION, len(data), PORTION))
    for part in np.split(np.arange(len(n), dtype=np.int32), np.unique(cuts)):
        if len(part):
            lo, k = int(first[part[0]]), n[part]
            own = np.repeat(part, k)
            at = first[own] - lo + np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
            digests.append(_digests(_words8(data[lo : lo + int(length[part].sum())]), at))
            owns.append(own)
            places.append((at + lo).astype(np.int32))
    digest, own, at = np.concatenate(digests), np.concatenate(owns), np.concatenate(places)
    del digests, owns, places
    hit = np.zeros(len(own), bool)
    for ix in _alike(digest):
        windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at[ix]]
        hit[ix] = previous_factors(_sortable(windows), docs[own[ix]])
    del digest
    # neighbouring covered windows of one super-gram make one interval
    h = np.flatnonzero(hit)
    new = np.ones(len(h), bool)
    new[1:] = (own[h][1:] != own[h][:-1]) | (h[1:] != h[:-1] + 1)
    new_at = np.flatnonzero(new)
    last = np.append(new_at[1:], len(h)) - 1 if len(new_at) else new_at
    gram = own[h[new_at]]
    start, end = at[h[new_at]] - first[gram], at[h[last]] + LENGTH - first[gram]
    # an interval of a super-gram holds at each of its places
    k = n_places[gram].astype(np.int64)
    places = _ranges((np.cumsum(n_places, dtype=np.int64) - n_places)[gram], k)
    row, shift = (np.concatenate([_unpress(x, np.int32) for x in t.column(c)])[places].astype(np.int64) for c in ("rows", "starts"))
    start, end, block = np.repeat(start, k) + shift, np.repeat(end, k) + shift, np.repeat(block_of[gram], k)
    rows = []
    for b in np.unique(block).tolist():
        mine = block == b
        rows.append((b, *(_press(x[mine]) for x in (row, start, end))))
    for b, d, s, e in zip(t.column("block").to_pylist(), *(t.column(f"covered_{k}") for k in ("rows", "starts", "ends")), strict=True):
        if len(_unpress(d, np.int64)):
            rows.append((b, d.as_py(), s.as_py(), e.as_py()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table({"block": pa.array(cols[0], pa.int64()), **{k: pa.array(c, pa.binary()) for k, c in zip(("rows", "starts", "ends"), cols[1:], strict=True)}})


def _sortable(windows: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed strings that numpy sorts in byte order. A zero byte would end such a string early, so bytes move up
    by one where any is zero (0xFF never occurs in UTF-8)."""
    w = np.ascontiguousarray(windows)
    if (w == 0).any():
        w = w + np.uint8(1)
    return w.view(f"S{w.shape[1]}").ravel()


def _removed(docs: pa.Table, covered: pa.Table) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    d, s, e = (np.concatenate([np.empty(0, np.int64), *[_unpress(x, np.int64) for x in covered.column(k)]]) if covered.num_rows else np.empty(0, np.int64) for k in ("rows", "starts", "ends"))
    order = np.lexsort((s, d))
    d, s, e = d[order], s[order], e[order]
    rows = []
    for at_row, (_, text, doc_id) in enumerate(_ordered(docs)):
        data = np.frombuffer(text, np.uint8)
        lo, hi = np.searchsorted(d, at_row), np.searchsorted(d, at_row, side="right")
        if lo == hi:
            rows.append((doc_id, len(data), 0, 0, hashlib.sha256(text).hexdigest()))
            continue
        mark = np.zeros(len(data) + 1, np.int32)
        np.add.at(mark, s[lo:hi], 1)
        np.add.at(mark, e[lo:hi], -1)
        gone = np.cumsum(mark)[:-1] > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        rows.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({k: pa.array(c, t) for k, c, t in zip(names, cols, types, strict=True)})


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, crowd: int = CROWD) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    n_bytes = docs.select(F.sum(F.octet_length(text_of()))).first()[0] or 0
    n = pieces_of(spark, n_bytes, block_bytes)
    dealt = blocked(docs.select("doc_id", F.lit(False).alias("flag"), text_of().cast("binary").alias("text")), n)
    blobs = dealt.mapInArrow(released(_anchors(n)), ANCHORS)
    shared = blobs.groupBy("bucket").applyInArrow(each_released(_shared(crowd)), "block long, hashes binary, crowded binary")
    # windows take many times the room of their super-grams: smaller buckets
    grams = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(each_released(_supergrams(4 * n)), SUPER)
    covered = stored(grams.groupBy("bucket").applyInArrow(each_released(_factors), "block long, rows binary, starts binary, ends binary"))
    return dealt.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(each_released(_removed), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))

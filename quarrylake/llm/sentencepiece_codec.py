"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format, the few fields that matter) and rebuilt as a tokenizers pipeline: the
normaliser (precompiled character map, white space rules), the metaspace marker, and either unigram scores or, for
BPE models, merges ranked by piece scores; byte fallback in both. Batches are encoded on all threads that the task may use.

Texts are cut before each run of markers that follows another character, provided that no piece of the vocabulary crosses such a place; then
no merge can, so the cut changes nothing and each distinct stretch is encoded once, and decoded once: a text decodes back to
itself if all its stretches do. Texts with a stretch that does not are decoded whole. Cutting and looking up stretches is Arrow's work, and the
ids of a slice of texts are one gather from the ids of its stretches.

verify_parity holds a tokenizer against the sentencepiece library itself; every row is checked by a round trip.

Defined results: null text is empty and has no tokens; repeated rows give equal rows; a very long text is a slice of its own and gets all its ids
in one row; other columns are not looked at, whatever their names; empty table: empty result. Texts are
Unicode, so that decoding gives the normalised text back exactly (the model's normaliser may itself change text).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, released, small_batches, table, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    suffix_marker: bool = False


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers, 4- and 8-byte values and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n = varint()
            yield number, raw[at : at + n]
            at += n


def parse(raw: bytes) -> Model:
    m = Model()
    for number, value in _fields(raw):
        if number == 1:  # a piece: text 1, score 2, type 3
            p = dict(_fields(value))
            m.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:  # trainer: model type 3, suffix marker 24, byte fallback 35, unknown id 40
            t = dict(_fields(value))
            m.model_type, m.suffix_marker, m.byte_fallback, m.unk_id = t.get(3, UNIGRAM), bool(t.get(24, 0)), bool(t.get(35, 0)), t.get(40, 0)
        elif number == 3:  # normaliser: character map 2, dummy prefix 3, extra white space 4, escape 5
            t = dict(_fields(value))
            m.charsmap, m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = t.get(2, b""), bool(t.get(3, 1)), bool(t.get(4, 1)), bool(t.get(5, 1))
    if m.model_type not in (UNIGRAM, BPE) or m.suffix_marker or not m.escape_whitespaces:
        raise ValueError("unigram and BPE models with prefix markers are supported")
    return m


def build(m: Model):
    """The tokenizers pipeline for the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        usable = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}
        # SentencePiece joins the neighbours whose union scores best, so a pair's rank is its union's score
        pairs = [(-score, vocab[p], p[:k], p[k:]) for p, score in usable.items() for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab]
        merges = [(a, b) for _, _, a, b in sorted(pairs, key=lambda x: x[:2])]
        core = models.BPE(vocab, merges, unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    steps.append(normalizers.Replace(" ", MARKER))
    tok.normalizer = normalizers.Sequence(steps)
    if separable(m):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+"), "isolated")
    tok.add_tokens([AddedToken(p, normalized=False, special=False) for p, _, kind in m.pieces if kind == USER_DEFINED])
    tok.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else [])])
    return tok


def separable(m: Model) -> bool:
    """No usable piece has a marker after another character, so texts fall apart before such markers."""
    return not any(MARKER in p.lstrip(MARKER) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


class Codec:
    """Encodes and decodes batches. Stretches that it has met stay known, their ids side by side in one array, until their text passes known_bytes."""

    def __init__(self, raw: bytes, known_bytes: int = 2 << 20):
        self.model = parse(raw)
        self.plain = separable(self.model) and not self.model.charsmap and not self.model.remove_extra_whitespaces and not any(k == USER_DEFINED for _, _, k in self.model.pieces)
        self.prefix = MARKER if self.model.add_dummy_prefix else ""
        self.known_bytes = known_bytes
        self._tok = None
        if self.plain:
            import regex
            from tokenizers import decoders, normalizers

            self.bare = build(self.model)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()])
            self.cut = regex.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+").findall
            # what each piece decodes to; what stands for no text of its own has none, and so never passes for one
            each = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARKER, " ").encode() if kind == NORMAL else b"" for p, _, kind in self.model.pieces]
            self.piece_bytes, self.piece_ends = np.frombuffer(b"".join(each), np.uint8), np.cumsum([len(x) for x in each], dtype=np.int64)
            del each
            release()  # what the building took
            self.forget()

    @property
    def tok(self):
        """The whole pipeline; plain models seldom need it."""
        if self._tok is None:
            self._tok = build(self.model)
        return self._tok

    def forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.empty(0, np.int32), np.zeros(1, np.int64)
        self.odd: set[str] = set()

    def encode_arrow(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts side by side, where each text's ids end, and whether they decode to what they stand for."""
        if not self.plain:
            texts = column.to_pylist()
            each = [e.ids if t else [] for t, e in zip(texts, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
            same = [self.normalised(t) == d for t, d in zip(texts, self.decode(each), strict=True)]
            return np.fromiter(chain.from_iterable(each), np.int32), np.cumsum([len(x) for x in each], dtype=np.int64), np.array(same, bool)
        lists = self._stretch_lists(column)
        parts = lists.flatten().dictionary_encode()
        at = self._places(parts.dictionary)
        stretch = at[parts.indices.to_numpy(zero_copy_only=False)]
        size = np.diff(self.ends)[stretch]
        total = np.concatenate([[0], np.cumsum(size)])
        of_text = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        ids = self.ids[np.repeat(self.ends[stretch] - total[:-1], size) + np.arange(total[-1])]
        ends = total[of_text[1:]]
        same = np.ones(len(column), bool)
        if self.odd:
            strange = np.concatenate([[0], np.cumsum(pc.is_in(parts.dictionary, pa.array(self.odd, pa.string())).to_numpy(zero_copy_only=False)[parts.indices.to_numpy(zero_copy_only=False)])])
            for i in np.flatnonzero(strange[of_text[1:]] > strange[of_text[:-1]]).tolist():
                same[i] = self.normalised(column[i].as_py()) == self.decode([ids[ends[i - 1] if i else 0 : ends[i]].tolist()])[0]
        return ids, ends, same

    def encode_checked(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text as 32-bit integers, and whether they decode to what they stand for."""
        ids, ends, same = self.encode_arrow(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])][: len(texts)], same.tolist()

    def _places(self, wanted: pa.Array) -> np.ndarray:
        """The numbers of these stretches. Those that are not known yet are encoded, and decoded: the ones that do not give themselves back are odd."""
        if self.known.nbytes > self.known_bytes:
            self.forget()
        at = pc.index_in(wanted, value_set=self.known)
        if at.null_count:
            new = wanted.filter(at.is_null())
            easy = pc.invert(pc.or_(pc.equal(pc.binary_length(new), 0), pc.match_substring(new, MARKER))) if self.prefix else pa.array([False] * len(new))
            for part, encoded in ((new.filter(easy), self._side_by_side), (new.filter(pc.invert(easy)), self._one_by_one)):
                if len(part):
                    ids, ends = encoded(part)
                    self.known = pa.concat_arrays([self.known, part])
                    self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + ends])
            at = pc.index_in(wanted, value_set=self.known)
        return at.to_numpy(zero_copy_only=False)

    def _side_by_side(self, words: pa.Array, together: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without markers, and where each word's ids end. Words stand one after another in a few long texts, for no merge crosses the marker between
        them; the bytes that the ids stand for must be these texts again, and their lengths tell where a word ends."""
        cuts = pa.array([*range(0, len(words), together), len(words)], pa.int32())
        joined = pc.binary_join_element_wise("", pc.binary_join(pa.ListArray.from_arrays(cuts, words), MARKER), MARKER)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(joined.to_pylist(), add_special_tokens=False)])
        size = np.diff(self.piece_ends, prepend=0)[ids]
        reached = np.cumsum(size)
        meant = np.frombuffer("".join(joined.to_pylist()).replace(MARKER, " ").encode(), np.uint8)
        stops = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        ends = np.searchsorted(reached, stops) + 1
        if reached[-1] == len(meant) and (reached[ends - 1] == stops).all() and (self.piece_bytes[np.repeat(self.piece_ends[ids] - reached, size) + np.arange(len(meant))] == meant).all():
            return ids, ends
        return self._one_by_one(words)

    def _one_by_one(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = stretches.to_pylist()
        marked = [s if s.startswith(MARKER) or not self.prefix else MARKER + s for s in words]
        ids = [e.ids for e in self.bare.encode_batch_fast(marked, add_special_tokens=False)]
        self.odd.update(s for s, m, d in zip(words, marked, self.bare.decode_batch(ids, skip_special_tokens=False), strict=True) if m.replace(MARKER, " ") != d)
        return np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([len(x) for x in ids], dtype=np.int64)

    def _stretch_lists(self, column: pa.Array) -> pa.Array:
        """The stretches of each text. Texts with single spaces alone are split at these in Arrow."""
        if self.prefix:
            rare = pc.or_(pc.or_(pc.equal(pc.binary_length(column), 0), pc.starts_with(column, " ")), pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, MARKER)))
            rare = np.flatnonzero(rare.to_numpy(zero_copy_only=False)).tolist()
            lists = pc.split_pattern(column, " ")
        else:
            rare, lists = range(len(column)), None
        out, start = [], 0
        for i in rare:
            if start < i:
                out.append(lists.slice(start, i - start))
            out.append(pa.array([self._stretches(column[i].as_py())], pa.list_(pa.string())))
            start = i + 1
        if start < len(column):
            out.append(lists.slice(start))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    def _stretches(self, text: str) -> list[str]:
        """The text's parts, each from a run of markers to the next; a single marker in front is left out, if the model puts one there."""
        if not text:
            return []
        parts = self.cut(self.prefix + text.replace(" ", MARKER))
        return [p[1:] if p[:1] == MARKER and p[1:2] != MARKER else p for p in parts] if self.prefix else parts

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_checked(texts)[0]]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def normalised(self, text: str) -> str:
        """What decoding must give back."""
        if self.plain or not text:
            return text.replace(MARKER, " ")
        out = self.tok.normalizer.normalize_str(text).replace(MARKER, " ")
        return out[1:] if self.model.add_dummy_prefix and out.startswith(" ") else out


_CODECS: dict[bytes, Codec] = {}


def codec(raw: bytes) -> Codec:
    """The codec of a Python worker: its size is the vocabulary's."""
    if raw not in _CODECS:
        # a task has one of its executor's cores; a second thread fills the gaps
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        _CODECS.clear()
        _CODECS[raw] = Codec(raw)
    return _CODECS[raw]


def verify_parity(raw: bytes, texts: list[str]) -> int:
    """How many of the texts the sentencepiece library encodes otherwise."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return sum(a != b for a, b in zip(Codec(raw).encode(texts), sp.encode(texts), strict=True))


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters each, so that long texts never add up in a worker's memory."""
    start = held = 0
    for i, n in enumerate(lengths):
        held += n
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def _encoded(shared, slice_chars: int):
    @released
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            column = b.column("text")
            for lo, hi in _slices(pc.utf8_length(column).to_pylist(), slice_chars):
                ids, ends, same = c.encode_arrow(column.slice(lo, hi - lo))
                ends = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), lists, pa.array(np.diff(ends)), pa.array(same)], ["doc_id", "ids", "n_tokens", "round_trip"])
        if c.plain:
            c.forget()

    return encoded


def encode(docs: DataFrame, model_path: str = MODEL, slice_chars: int = 1_000_000) -> DataFrame:
    """One row for each row of docs: doc_id, ids, n_tokens, round_trip. The model file is read once, on the driver, and broadcast (its size is
    the vocabulary's, not the input's)."""
    with open(model_path, "rb") as f:
        raw = f.read()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(_encoded(shared, slice_chars), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """tokens: doc_id, ids. One row for each: doc_id, text."""
    with open(model_path, "rb") as f:
        raw = f.read()
    small_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(raw)

    @released
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(c.decode([x or [] for x in b.column("ids").to_pylist()]), pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))

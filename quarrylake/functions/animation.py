"""Whether an image file moves: a GIF with two frames, a PNG with an animation header, an animated WebP, or an image sequence."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def _chunks(raw: bytes, start: int, little: bool) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the data, its size) of the chunks of a WebP (little) or PNG file; the caller sees to truncated data."""
    at = start
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<4sI", raw, at) if little else struct.unpack_from(">I4s", raw, at)[::-1]
        yield kind, at + 8, size
        at += 8 + size + (size % 2 if little else 4)


def _png(raw: bytes) -> bool:
    for kind, at, _ in _chunks(raw, 8, False):
        if kind == b"acTL":
            return int.from_bytes(raw[at : at + 4].ljust(4, b"\0"), "big") > 1
        if kind in (b"IDAT", b"IEND"):
            return False
    return False


def _webp(raw: bytes) -> bool:
    for kind, at, _ in _chunks(raw, 12, True):
        if kind == b"ANIM" or kind == b"VP8X" and raw[at : at + 1] and raw[at] & 2:
            return True
        if kind in (b"VP8 ", b"VP8L"):
            return False
    return False


def _palette(flags: int) -> int:
    return 3 << (flags % 8 + 1) if flags >= 128 else 0


def _gif(raw: bytes) -> bool:
    """Reading beyond the end raises IndexError: such a file is truncated."""
    at = 13 + _palette(raw[10])
    frames = 0
    while frames < 2 and raw[at] in (0x21, 0x2C):
        # an extension has a label before its blocks; a frame has ten bytes, perhaps a palette, and the code size
        frame = raw[at] == 0x2C
        at += 11 + _palette(raw[at + 9]) if frame else 2
        while raw[at]:
            at += 1 + raw[at]
        at += 1
        frames += frame
    return frames == 2


def moves(raw: bytes | None) -> bool | None:
    """None if there is no content to read; False for truncated and unknown files."""
    if raw is None:
        return None
    try:
        if raw[:4] == b"GIF8":
            return _gif(raw)
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            return _webp(raw)
    except IndexError:
        return False
    if raw[4:8] == b"ftyp" and len(raw) >= 12:
        # the version between major and compatible brands is looked at too, as one more brand
        end = 12 + min(max(0, int.from_bytes(raw[:4], "big") - 12), 512)
        return any(raw[k : k + 4] == b"avis" for k in (8, *range(12, end, 4)))
    return False


@F.pandas_udf(BooleanType())
def is_animated(content: pd.Series) -> pd.Series:
    return content.map(moves, na_action=None).astype(object)

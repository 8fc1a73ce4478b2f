"""Scalar expressions: hashes, labels, links, times and sizes."""

from __future__ import annotations

import json
import unicodedata
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of links.
URL = r"https?://[A-Za-z0-9\-._~:/?#@!$&*+,;=%()\[\]]+"
MAGNET = r"magnet:\?xt=urn:btih:[0-9A-Za-z]+"


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def max_distance(p1: Column, d1: Column, p2: Column, d2: Column) -> Column:
    return F.greatest(hamming(p1, p2), hamming(d1, d2))


def sum_distance(p1: Column, d1: Column, p2: Column, d2: Column) -> Column:
    return hamming(p1, p2) + hamming(d1, d2)


def watch_state(position: Column, duration: Column) -> Column:
    return F.when(F.coalesce(position, F.lit(0.0)) <= 0, "unwatched").when((duration > 0) & (position / duration >= 0.95), "finished").otherwise("in_progress")


def download_status(dl: Column, kind: Column, dedup: Column) -> Column:
    return F.when(dl.isin("busy", "pending"), "downloading").when(dl == "dead", "dead").when((dl == "none") | (kind == "forward"), "archived").when(dedup > 0, "dedup").otherwise("ok")


def backoff(tries: Column, base: int, most: int) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), tries), F.lit(float(most))).cast("long")


@cache
def _accents() -> tuple[str, str]:
    """Latin letters with accents, and without: all that decompose to an ASCII letter and marks."""
    pairs = [(chr(c), base) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(base := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(c: Column) -> Column:
    """Lower case without the accents of Latin letters, composed or combining."""
    return F.translate(F.lower(F.regexp_replace(c, r"\p{Mn}+", "")), *_accents())


def search_tokens(c: Column) -> Column:
    return F.filter(F.split(unaccented(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Fixed value: closing marks that do not belong to a link.
CLOSING = ".,;:!?、。，；！？：）)】》»\"'"
#: What may follow an ampersand that begins an entity.
_ENTITY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _lookup(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


#: Names in XML cards: its five, and the hard space.
XML_NAMES = {k: html5[k] for k in ("lt;", "gt;", "quot;", "apos;", "amp;", "nbsp;")}


def unescaped(c: Column, names: dict[str, str] = html5) -> Column:
    """HTML entities, named and numbered, undone in one pass from left to right, as browsers read them: names are those of HTML 5, some of which need no semicolon and may begin a longer
    word; numbers of the C1 range are Windows-1252, those that are no characters go, those beyond Unicode are replaced."""
    shown = {str(k): bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)} | {"0": "�", "13": "\r"}
    named, numbered = _lookup(names), _lookup(shown)

    def undone(part: Column) -> Column:
        m = F.regexp_extract(part, _ENTITY, 1)
        rest = F.substring(part, F.length(m) + 1, F.length(part))
        hexed = F.regexp_extract(m, r"^#[xX]0*([0-9a-fA-F]*)", 1)
        decimal = F.regexp_extract(m, r"^#0*([0-9]*)", 1)
        is_hex = m.rlike("^#[xX]")
        digits = F.when(is_hex, hexed).otherwise(decimal)
        code = F.when(F.length(digits) > 8, F.lit(0x110000)).when(is_hex, F.conv(hexed, 16, 10)).otherwise(F.when(decimal == "", "0").otherwise(decimal)).cast("long")
        code = F.coalesce(code, F.lit(0))
        none = code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        number = F.coalesce(F.try_element_at(numbered, code.cast("string")), F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "�").when(none, "").otherwise(letter))
        # the whole name, or the longest that it begins with of those that need no semicolon, which have two to six letters
        lengths = F.concat(F.array(F.length(m)), F.array(*[F.lit(k) for k in range(6, 1, -1)]))
        known = F.filter(F.transform(lengths, lambda k: F.struct(k.alias("k"), F.try_element_at(named, F.left(m, k)).alias("v"))), lambda x: x["v"].isNotNull() & (x["k"] <= F.length(m)))
        name = F.coalesce(F.get(F.transform(known, lambda x: F.concat(x["v"], F.substr(m, x["k"] + 1))), F.lit(0)), F.concat(F.lit("&"), m))
        return F.concat(F.when(m == "", "&").when(m.startswith("#"), number).otherwise(name), rest)

    parts = F.split(c, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), undone), ""))
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def normal_url(c: Column) -> Column:
    """Entities undone, white space of any kind and closing punctuation cut off."""
    return F.rtrim(F.regexp_replace(unescaped(c), r"(?U)^\s+|\s+$", ""), F.lit(CLOSING))


def natural_key(c: Column) -> Column:
    """Lower case, with each run of digits in front of which its length stands (without leading zeros), so that numbers of any length compare as numbers."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 8, "0"), bare(x))).otherwise(x)), "")


def natural_order(c: Column) -> list[Column]:
    """Order keys of file names: numbers as numbers, Chinese by the collation of the language."""
    return [F.collate(natural_key(c), "zh").asc(), c.asc()]


def day_label(day: Column, today: Column) -> Column:
    ago = F.datediff(today, day)
    return F.when(ago == 0, "today").when(ago == 1, "yesterday").when((ago > 1) & (ago < 7), F.concat(ago.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))


def time_in_title(c: Column) -> Column:
    """Seconds of the first H:MM:SS in a title."""
    part = lambda k: F.regexp_extract(c, r"(?<!\d)(\d{1,2}):([0-5]\d):([0-5]\d)(?!\d)", k).try_cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3)


def image_kind(content: Column) -> Column:
    """The image format that the first bytes show, else null."""
    h = F.hex(F.substring(content, 1, 16))
    return (
        F.when(h.startswith("FFD8FF"), "jpg").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("474946383761") | h.startswith("474946383961"), "gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").when(h.startswith("424D") & (F.octet_length(content) >= 26), "bmp")
        .when((F.substring(h, 9, 8) == "66747970") & F.substring(h, 17, 8).isin("61766966", "61766973"), "avif")
    )

"""Text search and link extraction."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ascii_lower
from ..functions.scalars import URL, normal_url, unaccented


def prefix_match(columns: list[Column], term: str) -> Column | None:
    """All words of the term are found in some column: a word's tokens follow each other, the last one as the beginning of a token. None if the term is blank
    or holds a quotation mark. The columns are folded once and each word is one pattern on token boundaries."""
    words = [[t for t in re.split(r"[^\w]|_", plain(w)) if t] for w in term.split()]
    if not words or '"' in term:
        return None
    folded = unaccented(F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in columns]))
    found = [folded.rlike(r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}|]+".join(w)) for w in words if w]
    return reduce(lambda a, b: a & b, found) if len(found) == len(words) else F.lit(False)


def plain(term: str) -> str:
    """A term folded as the columns are."""
    return "".join(x for x in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(x))


def search_files(files: DataFrame, term: str) -> DataFrame:
    """By tokens of filename and path, else by a part of the filename."""
    hit = prefix_match([F.col("filename"), F.col("path")], term)
    return files.where(hit if hit is not None else F.contains(ascii_lower(F.col("filename")), ascii_lower(F.lit(term.strip()))))


def search_messages(messages: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """By a part of the text; terms of three characters and more fold all letters, shorter ones ASCII letters."""
    fold = F.lower if len(term) >= 3 else ascii_lower
    return messages.where(F.contains(fold(F.col("text")), fold(F.lit(term)))).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def links(texts: DataFrame) -> DataFrame:
    """texts: id, text. One row for each link: id, nth, link."""
    found = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({URL})"), F.lit(1))).alias("nth", "raw"))
    return found.select("id", "nth", normal_url(F.col("raw")).alias("link"))


def link_registry(texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links that are not known, each with its first message: link_key, link, first_id, n. Equal without case."""
    g = links(texts).groupBy(F.lower("link").alias("link_key")).agg(F.min_by("link", F.struct("id", "nth")).alias("link"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return g.join(known.select("link_key"), "link_key", "left_anti") if known is not None else g

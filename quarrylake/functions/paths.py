"""Path columns: both separators count, comparisons fold ASCII letters only."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of the two catalogs, and the prefix of temporary files.
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "avif")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def norm_path(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("\\"))


def parent_dir(c: Column) -> Column:
    """Null where there is no separator."""
    return F.when(c.rlike(r"[\\/]"), F.regexp_extract(norm_path(c), r"^(.*)\\[^\\]*$", 1))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, r"[\\/]"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^.\\/]+)$", 1))


def under_dir(path: Column, folder: Column | str) -> Column:
    """Strictly below the folder; a sibling whose name begins alike is not. With a literal folder the predicate is a prefix test."""
    if isinstance(folder, str):
        return ascii_lower(norm_path(path)).startswith(folder.replace("/", "\\").rstrip("\\").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) + "\\")
    return F.startswith(ascii_lower(norm_path(path)), F.concat(F.regexp_replace(ascii_lower(norm_path(folder)), r"\\+$", ""), F.lit("\\")))


def in_scope(path: Column, folders: list[str]) -> Column:
    """No folders: no restriction."""
    return reduce(lambda a, b: a | b, [under_dir(path, f) for f in folders]) if folders else F.lit(True)


def ancestors(path: Column) -> Column:
    """All folders above the file, from the top."""
    parts = F.split(norm_path(path), r"\\")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))).otherwise(F.array().cast("array<string>"))


def dedupe_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(norm_path(c)), r"\\+$", "")


def moved(path: Column, old: str, new: str) -> Column:
    """The path with its folder old replaced by new, where it lies below old; one separator between."""
    old, new = old.rstrip("\\/"), new.rstrip("\\/")
    return F.when(under_dir(path, old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)

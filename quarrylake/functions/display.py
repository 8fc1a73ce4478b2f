"""Text that is shown, and what is read back from names, headers and stamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ascii_lower, basename, norm_path, stem

#: Units, labels of kinds, extensions by content type, extensions that a link may tell.
UNITS = ("B", "KB", "MB", "GB", "TB")
KIND_LABELS = {"forward": "合并转发", "reply": "引用回复", "image": "图片", "video": "视频", "file": "文件", "record": "语音"}
OTHER_LABEL = "消息"
TYPE_EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp", "image/avif": "avif", "video/mp4": "mp4", "video/webm": "webm", "video/quicktime": "mov"}
LINK_IMAGES, LINK_VIDEOS = ("jpg", "jpeg", "png", "gif", "bmp", "webp"), ("mp4", "webm", "mov", "mkv", "avi")
#: Fixed value: a media tag that no saved file follows.
BARE_MEDIA = r"(?i)\[(?:图片|视频)\](?!\s+\S+\.(?:jpe?g|png|webp|gif|bmp|mp4|mov|webm))"


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda made, kv: made.when(c == kv[0], kv[1]), list(table.items())[1:], F.when(c == next(iter(table)), table[next(iter(table))]))


def time_text(seconds: Column) -> Column:
    """65 -> 1:05, 3661 -> 1:01:01; what is no time or negative is 0:00."""
    s = F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds < 0) | (F.abs(seconds.cast("double")) == float("inf")), 0).otherwise(F.floor(seconds)).cast("long")
    h, rest = F.expr("0") + F.floor(s / 3600), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0")
    m = F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), F.lpad(m.cast("string"), 2, "0"), rest)).otherwise(F.concat_ws(":", m.cast("string"), rest))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("double")
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), "--:--").otherwise(time_text(seconds))


def resolution_text(width: Column, height: Column) -> Column:
    return F.when((F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0), "").otherwise(F.concat(width.cast("string"), F.lit("×"), height.cast("string")))


def _scaled(n: Column) -> tuple[Column, Column]:
    """The number in its largest unit, and the unit."""
    step = lambda values: reduce(lambda made, k: made.when(n < 1024 ** (k + 1), values(k)), range(1, 4), F.when(n < 1024, values(0))).otherwise(values(4))
    return step(lambda k: n / float(1024**k)), step(lambda k: F.lit(UNITS[k]))


def _fixed(value: Column, digits: int) -> Column:
    """Rounded half up, with all digits."""
    return F.round(value, digits).cast(f"decimal(20,{digits})").cast("string")


def bytes_text(n: Column, empty: str = "-") -> Column:
    """1 KB, 1.5 KB, 123.4 MB: one digit, left out where it is zero."""
    value, unit = _scaled(n)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, empty).otherwise(F.concat_ws(" ", F.regexp_replace(_fixed(value, 1), r"\.0$", ""), unit))


def file_size_text(n: Column) -> Column:
    return bytes_text(n, "0 B")


def download_size_text(n: Column) -> Column:
    """1.0 KB, 99.9 KB, 123 KB, 512 B: no digit from 100 on, nor for bytes."""
    value, unit = _scaled(n)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "-").otherwise(F.concat_ws(" ", F.when((value >= 100) | (n < 1024), _fixed(value, 0)).otherwise(_fixed(value, 1)), unit))


def clock_text(t: Column, now: Column) -> Column:
    """Of a day its time, of other days the date as well; no time: a dash."""
    return F.when(t.isNull(), "-").when(F.to_date(t) == F.to_date(now), F.date_format(t, "HH:mm")).otherwise(F.date_format(t, "MM-dd HH:mm"))


def midnight(now: Column) -> Column:
    """Seconds since 1970 of the day's beginning in the session's zone; where the day has no midnight, a day before now."""
    start = F.date_trunc("day", now)
    return F.when(F.date_format(start, "HH:mm:ss") == "00:00:00", F.unix_timestamp(start)).otherwise(F.unix_timestamp(now) - 86400)


def utc_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parsed_utc(c: Column) -> Column:
    """A stamp with a space or a T between date and time, with or without a Z; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.replace(F.trim(c), F.lit("T"), F.lit(" ")), r"(\.\d+)?Z?$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))


def date_and_time(t: Column) -> tuple[Column, Column]:
    return F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "HH:mm:ss")


def log_stamp(line: Column) -> Column:
    """MM-DD HH:MM:SS at a log line's beginning, else null."""
    found = F.regexp_extract(line, r"^(\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    return F.when(found != "", found)


def sample_times(duration: Column) -> dict[str, Column]:
    """Where a video's three frames are taken: within the first ten seconds, at a half, near the end."""
    known = F.coalesce(duration, F.lit(0.0)) > 0
    return {"anchor": F.when(known, F.least(duration * 0.1, F.lit(10.0))).otherwise(0.0), "mid": F.when(known, duration * 0.5).otherwise(5.0), "tail": F.when(known, duration * 0.85).otherwise(15.0)}


def percent(done: Column, total: Column, state: Column) -> Column:
    """Only of rows at work with a known total."""
    return F.when((state == "busy") & (total > 0), F.least(F.lit(100), F.round(done / total * 100)).cast("long"))


def reconnect_wait(fails: Column, spread: Column) -> Column:
    """spread: from 0 to 1, in place of a random number."""
    return F.least(F.lit(5.0) * F.pow(F.lit(2.0), fails), F.lit(120.0)) + spread * 3


def same_folder(a: Column, b: Column) -> Column:
    key = lambda c: F.regexp_replace(ascii_lower(norm_path(c)), r"\\+$", "")
    return key(a) == key(b)


def valid_target(folder: Column) -> Column:
    """Not blank, and no way up in it."""
    return (F.trim(folder) != "") & ~F.exists(F.split(folder, r"[\\/]"), lambda p: p == "..")


def extensions_agree(a: Column, b: Column) -> Column:
    one = lambda c: F.when(F.lower(c) == "jpeg", "jpg").otherwise(F.lower(c))
    return one(a) == one(b)


def md5_hint(name: Column) -> Column:
    """The digest that a file name is, else null."""
    s = stem(F.coalesce(name, F.lit("")))
    return F.when(s.rlike(r"^[0-9a-fA-F]{32}$"), F.lower(s))


def is_hash_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(r"^[0-9a-fA-F]{32}\.[A-Za-z0-9]{1,8}$")


def media_extension(content_type: Column, url: Column, kind: Column) -> Column:
    """By content type, else by the link's end if that may be, else the kind's usual one."""
    end = F.lower(F.element_at(F.split(F.split_part(url, F.lit("?"), F.lit(1)), r"\."), -1))
    image = kind == "image"
    return F.coalesce(_lookup(content_type, TYPE_EXTENSIONS), F.when(image & end.isin(*LINK_IMAGES) | ~image & end.isin(*LINK_VIDEOS), end), F.when(image, "jpg").otherwise("mp4"))


def full_size(content_range: Column) -> Column:
    """bytes 0-99/1234 -> 1234."""
    return F.regexp_extract(content_range, r"/\s*(\d+)\s*$", 1).try_cast("long")


def port_of(url: Column, fallback: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1).try_cast("int"), F.lit(fallback))


def row_label(name: Column, text: Column, path: Column, kind: Column) -> Column:
    """The first that is not blank: name, the text's beginning, the path's last part, what the kind is called."""
    filled = lambda c: F.when(F.regexp_replace(c, r"\s+", "") != "", c)
    return F.coalesce(filled(name), F.substring(filled(text), 1, 80), filled(basename(filled(path))), _lookup(kind, KIND_LABELS), F.lit(OTHER_LABEL))


def sender_prefix(scope: Column, peer: Column, sender: Column, nick: Column) -> Column:
    nick, scope = F.coalesce(F.when(nick != "", nick), F.lit("?")), F.coalesce(F.when(scope != "", scope), F.lit("private"))
    group = F.concat(F.lit("["), F.coalesce(peer.cast("string"), F.lit("")), F.lit("/"), nick, F.lit("] "))
    return F.when(scope == "group", group).otherwise(F.concat(F.lit("["), nick, F.lit("("), F.coalesce(sender.cast("string"), F.lit("")), F.lit(")] ")))


def has_bare_media(kind: Column, text: Column, state: Column) -> Column:
    """A forward at rest whose text has a media tag without a saved file."""
    return (kind == "forward") & (state != "busy") & F.coalesce(text, F.lit("")).rlike(BARE_MEDIA)


def stage_of(login_error: Column, qr: Column, ready: Column, ports: Column, stamp: Column) -> Column:
    return (
        F.when(login_error.isNotNull(), "waiting_qr").when(qr.isNotNull() & ~ready, "waiting_qr").when(ports & ready, "ready")
        .when(ready, "initializing").when(stamp.isNotNull(), "starting").otherwise("not_running")
    )

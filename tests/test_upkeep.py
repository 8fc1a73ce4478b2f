"""Bursts, layout, animation, logs and upkeep against plain versions."""

import random
import struct

from quarrylake.functions.animation import is_animated, moves
from quarrylake.operators import layout, logs, upkeep
from quarrylake.streaming import folds


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_bursts_are_capped(spark):
    r = random.Random(4)
    events = [(k, t) for k in (1, 2, 3) for t in sorted(r.randrange(40_000) for _ in range(80))]
    want = []
    for k in (1, 2, 3):
        left = [t for q, t in events if q == k]
        while left:
            burst, fires = [left.pop(0)], None
            while fires is None:
                if not left or left[0] - burst[-1] >= 500:
                    fires = burst[-1] + 500
                else:
                    burst.append(left.pop(0))
                    if burst[-1] - burst[0] >= 1000:
                        fires = burst[-1]
            want.append((k, burst[0], burst[-1], len(burst), fires))
    got = folds.capped_sessions(spark.createDataFrame(events, "key long, t long"), 500, 1000)
    assert values(got) == sorted(want, key=str)
    assert folds.capped_sessions(spark.createDataFrame([], "key long, t long"), 500, 1000).count() == 0


def test_rows_fill_the_width(spark):
    r = random.Random(5)
    items = [(k, i, r.choice([0.1, 0.7, 1.0, 1.5, 9.0])) for k in (1, 2) for i in range(40)] + [(3, 0, 1.0)]
    want = []
    for k in (1, 2, 3):
        a = [min(4.0, max(0.4, x)) for q, _, x in items if q == k]
        rows = [[]]
        for i, x in enumerate(a):
            row = rows[-1]
            if row and (1000 - 10 * len(row)) / (sum(a[j] for j in row) + x) < 200:
                rows.append([])
            rows[-1].append(i)
        top = 0.0
        for n, row in enumerate(rows):
            h = min((1000 - 10 * (len(row) - 1)) / sum(a[j] for j in row), 200 if n == len(rows) - 1 else 400)
            want.append((k, n, row[0], len(row), round(top, 6), round(h, 6), round(top + h + 30, 6)))
            top += h + 30 + 10
    made = layout.justified_rows(spark.createDataFrame(items, "key long, nth long, aspect double"), 1000.0, 200.0, 10.0, 30.0, 0.4, 4.0)
    got = [tuple(round(x, 6) if isinstance(x, float) else x for x in v) for v in values(made)]
    assert sorted(got) == sorted(want)
    assert values(layout.visible(made.where("key = 1"), 0, 1).select("row")) == [(0,)]


def gif(frames: int, palette: bool = False) -> bytes:
    head = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80 if palette else 0, 0, 0) + (b"\0" * 6 if palette else b"")
    one = b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + b"\0" * 9 + b"\x02" + b"\x02\x4c\x01\0"
    return head + one * frames + b"\x3b"


def png(*chunks: tuple[bytes, bytes]) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I4s", len(x), k) + x + b"crc!" for k, x in chunks)


def webp(*chunks: tuple[bytes, bytes]) -> bytes:
    return b"RIFF\0\0\0\0WEBP" + b"".join(k + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for k, x in chunks)


def test_animation(spark):
    head = (b"IHDR", b"\0" * 13)
    cases = [
        (gif(1), False), (gif(2), True), (gif(3, True), True), (gif(2)[:-20], False), (b"GIF8", False),
        (png(head, (b"acTL", struct.pack(">II", 4, 0)), (b"IDAT", b"x")), True), (png(head, (b"acTL", struct.pack(">II", 1, 0))), False), (png(head, (b"IDAT", b"x"), (b"acTL", struct.pack(">II", 4, 0))), False), (png(head)[:20], False),
        (webp((b"VP8X", b"\x02" + b"\0" * 9), (b"VP8 ", b"x")), True), (webp((b"VP8X", b"\0" * 10), (b"ICCP", b"abc"), (b"ANIM", b"x")), True), (webp((b"VP8 ", b"x"), (b"ANIM", b"x")), False),
        (b"\0\0\0\x18ftypavis\0\0\0\0mif1avif", True), (b"\0\0\0\x18ftypavif\0\0\0\0mif1avis", True), (b"\0\0\0\x14ftypavif\0\0\0\0mif1avis", False), (b"", False), (None, None),
    ]
    assert [moves(x) for x, _ in cases] == [y for _, y in cases]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "id int, content binary")
    assert [r[1] for r in sorted(df.select("id", is_animated("content")).collect())] == [y for _, y in cases]


def test_upkeep_edges(spark):
    rows = spark.createDataFrame([(1, " AB "), (2, "ab"), (3, None), (4, " "), (5, "\tAb")], "n int, hash string")
    assert values(upkeep.keep_first(rows, "hash", "n").select("n")) == [(1,), (3,), (4,)]
    polls = [("s", t, "playing", "live" if t in (1, 2, 3, 20) else "title", {1: 5.0, 2: 5.0, 3: 99.0}.get(t, 7.0), 60.0) for t in range(1, 21)] + [("z", 1, "stopped", "live", 3.0, None), ("y", 1, None, "live", float("nan"), 1.0), ("y", 2, None, "live", 3.0, None)]
    got = upkeep.tracked_positions(spark.createDataFrame(polls, "session string, t long, state string, source string, position double, duration double"))
    assert values(got) == [("s", 1, 5.0), ("s", 3, 60.0), ("y", 2, 3.0)]
    m = spark.createDataFrame([(1, "busy", "image", "a", None, 2, None, None, 5, 10**12, 7), (2, "dead", "image", "b", None, 3, 9, None, 5, 10**12, 7), (3, "ok", "image", "c", "m", 3, 9, None, 5, 1, 7), (4, "dead", "video", "c", None, 3, 9, None, 5, 1, 7)], "id long, dl string, kind string, name string, md5 string, tries int, dead_at long, msg_id string, parent long, next_try long, dl_bytes long")
    once = upkeep.recovered(m, 1000)
    assert values(once.select("id", "dl", "tries", "dead_at", "next_try", "dl_bytes", "md5")) == [(1, "pending", 2, None, 10**12, 0, None), (2, "dead", 3, 9, 1000, 7, None), (3, "ok", 0, None, 1, 7, "m"), (4, "ok", 0, None, 1, 0, "m")]
    assert values(upkeep.recovered(once, 1000)) == values(once)


def test_backups(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        upkeep.backup({"a": df}, str(tmp_path), "2024-01-30")
    assert spark.read.parquet(f"{tmp_path}/2024-01-30/a").count() == 3


def test_log_lines(spark):
    lines = spark.createDataFrame([(1, "\x1b[31m01-02 03:04:05 [error] boom\x1b[0m"), (2, ""), (3, None), (4, "[error] boom"), (5, "01-02 03:04:05 [warn] 正在快速登录"), (6, "01-02 03:04:05 [info] 二维码已保存到 ")], "id long, line string")
    assert values(logs.log_events(lines)) == [(1, "diagnostic", "01-02 03:04:05 [error] boom"), (5, "diagnostic", "01-02 03:04:05 [warn] 正在快速登录")]
    assert values(logs.risk_signals(spark.createDataFrame([(1, "login error; errcode: 3; 强制下线"), (2, None)], "id long, line string"))) == [(1, "登录拒绝", "CRIT"), (1, "频繁下线", "WARN")]

"""Logs that grow, are cut off and start anew; sinks that fail half-way."""

import json

import pytest

from quarrylake.operators import logs
from quarrylake.sources import tail
from quarrylake.streaming import ledger


def once(stream, tmp_path, name):
    """Runs over what is there, from the query's checkpoint."""
    stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start().awaitTermination()


def test_tail_of_growing_and_truncated_logs(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    a, b = folder / "a.log", folder / "b.log"
    a.write_bytes(b"old line that is out of reach\n" * 3 + b"01-15 10:00:00 [x] \x1b[31mfirst\x1b[0m\nsecond\nhalf of")
    (folder / "c.txt").write_text("no log\n")
    read = lambda: tail.log_lines(spark, str(folder), "*.log", first_bytes=60)
    rows = lambda: [(r.path.rsplit("/", 1)[-1], r.line) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("path", "at").collect()]
    once(read(), tmp_path, "out")
    seen = rows()
    assert seen[-2:] == [("a.log", "01-15 10:00:00 [x] first"), ("a.log", "second")] and "half" not in str(seen) and len(seen) == 3
    with a.open("ab") as f:
        f.write("third \u00e9\n".encode() + b"\xff bad\r\n")
    b.write_text("new file\n")
    once(read(), tmp_path, "out")
    assert {x for x in rows() if x not in seen} == {("a.log", "half ofthird \u00e9"), ("a.log", "\ufffd bad"), ("b.log", "new file")}
    a.write_text("anew\n")  # shorter than before: read from its beginning
    once(read(), tmp_path, "out")
    assert ("a.log", "anew") in rows() and len(rows()) == 7
    once(read(), tmp_path, "out")
    assert len(rows()) == 7


def test_stages_of_a_tailed_log(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    at = "01-15 10:00:0%d [x] "
    (folder / "n.log").write_text(at % 0 + logs.LOGIN_ERROR + "\n" + at % 1 + logs.QR_SAVED + " D:\\q.png\n")
    once(tail.log_lines(spark, str(folder)), tmp_path, "out")
    with (folder / "n.log").open("a") as f:
        f.write(at % 2 + logs.READY + "\n")
    once(tail.log_lines(spark, str(folder)), tmp_path, "out")
    lines = spark.read.parquet(str(tmp_path / "out")).selectExpr("path as log", "at as id", "line")
    (r,) = logs.log_stages(lines, "log").collect()
    assert r.ready and r.qr == "D:\\q.png" and r.login_error is None and r.stamp == "01-15 10:00:02"


def test_slices_hold_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SLICE", 7)
    monkeypatch.setattr(tail, "STEP", 3)
    text = "a\n\nlonger line\nb\r\n" * 5 + "x" * 30 + "\n"
    (tmp_path / "l").write_bytes(text.encode())
    r = tail.TailReader(str(tmp_path), "*", 1000)
    end = r.latestOffset()
    parts = r.partitions({}, end)
    assert [x[2] for p in parts for x in r.read(p)] == text.replace("\r", "").split("\n")[:-1] and len(parts) > 10
    assert r.partitions(end, end) == []


class Failing(ledger.Ledger):
    """Fails the first time that a batch is to be entered, after its rows have been written."""

    failed: set = set()

    def enter(self, batch, told):
        if batch not in self.failed:
            self.failed.add(batch)
            raise OSError("out of space")
        super().enter(batch, told)


def test_links_are_neither_lost_nor_doubled(spark, tmp_path):
    Failing.failed = set()
    source, folder = tmp_path / "in", str(tmp_path / "registry")
    source.mkdir()
    schema = "id long, scope string, peer_id long, sender_nick string, ts long, text string"
    batches = [[(1, "see https://a.b/1 and https://a.b/2"), (2, "none")], [(3, "again https://A.b/1 new https://a.b/3")], [(2, "changed: https://a.b/4"), (4, "https://a.b/3")]]
    for rows in batches:
        spark.createDataFrame([(i, "private", 5, "ann", 0, t) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        for _ in range(2):  # the first try fails between write and cursor
            sink = ledger.link_sink(spark, folder, ledger=Failing)
            q = spark.readStream.schema(schema).parquet(str(source)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception:
                assert len(Failing.failed) == 1 + len([b for b in batches if batches.index(b) < batches.index(rows)])
    book = ledger.Ledger(spark, folder)
    got = book.read("links", ledger.LINKS).orderBy("seq").collect()
    assert [(r.link, r.seq) for r in got] == [("https://a.b/1", 1), ("https://a.b/2", 2), ("https://a.b/3", 3), ("https://a.b/4", 4)] and book.last("cursor", 0) == 4
    ledger.link_sink(spark, folder)(spark.createDataFrame([(9, "private", 5, "ann", 0, "https://a.b/9")], schema), 0)
    assert book.read("links", ledger.LINKS).count() == 4 and book.last("cursor", 0) == 4


def test_events_and_answers_are_parted(spark, tmp_path):
    lines = [json.dumps({"post_type": "message", "id": 1}), json.dumps({"status": "ok", "echo": "7"}), "no json", None]
    sink = ledger.event_sink(spark, str(tmp_path / "e"))
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    sink(df, 0)
    sink(df, 0)
    book = ledger.Ledger(spark, str(tmp_path / "e"))
    assert book.read("events", "payload string").count() == 1 and [r.echo for r in book.read("answers", "payload string, echo string").collect()] == ["7"]
    assert book.last("lines", 0) == 4 and book.last("read", 0) == 2
    with pytest.raises(Exception):
        ledger.Ledger(spark, str(tmp_path / "e")).write(1, {"events": df.selectExpr("no_such")}, {})

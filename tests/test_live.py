"""Streams against the batch operators: shuffled micro-batches, and a query that is stopped and started again."""

import random

import pytest

from quarrylake.operators import queue
from quarrylake.streaming import folds, live


def shuffled_files(folder, rows, files, late, seed):
    """Rows in files, in an order in which none comes more than `late` seconds after a younger one of an earlier file."""
    r = random.Random(seed)
    rows = sorted(rows, key=lambda x: x[1] + r.uniform(0, late * 0.8))
    size = -(-len(rows) // files)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def run(spark, tmp_path, parts, schema, made, stops=(None,)):
    """Writes parts bit by bit; the query runs over what is there and stops, again and again, from one checkpoint."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    at = 0
    for stop in stops:
        for k, rows in enumerate(parts[at:stop], at):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        at = stop or len(parts)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        made(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(out).collect()))


@pytest.mark.parametrize("name", ["cooled", "capped", "backed_off"])
def test_stream_equals_batch(spark, tmp_path, name):
    r = random.Random(6)
    rows, t = [], 0
    for _ in range(90):
        t += r.choice((0, 1, 4, 9, 30, 70))
        rows.append((r.choice((1, 1, 2, 3)), t, r.random() < 0.7))
    if name == "backed_off":
        rows = sorted({(k, t): (k, t, f) for k, t, f in rows}.values(), key=lambda x: x[1])
    schema = "key long, t long, failed boolean"
    parts = shuffled_files(tmp_path, rows, 4, 60, 1)
    # a key of its own moves the watermark past all others
    parts.append([(99, t + 100_000, False)])
    batch = spark.createDataFrame(rows, schema)
    stream, whole = {
        "cooled": (lambda s: live.cooled(s, 20), lambda: folds.cooled(batch, 20)),
        "capped": (lambda s: live.capped_sessions(s, 25, 40), lambda: folds.capped_sessions(batch, 25, 40)),
        "backed_off": (live.backed_off, lambda: queue.backed_off(batch)),
    }[name]
    got = run(spark, tmp_path, parts, schema, stream, stops=(2, 3, None))
    assert [g for g in got if g[0] != 99] == sorted(map(tuple, whole().collect()))

"""Chains by jumps against plain loops, with keys that are split over many pieces."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from quarrylake.operators import queue
from quarrylake.streaming import folds, jumps


def hot(seed, n=700, keys=9, step=8):
    """Times of several keys, of which one has half of all rows; many ties."""
    r, out, t = random.Random(seed), [], dict.fromkeys(range(keys), 0)
    for _ in range(n):
        k = 0 if r.random() < 0.5 else r.randrange(keys)
        t[k] += r.choice((0, 1, 1, 2, step, 5 * step)) if r.random() > 0.02 else 40 * step
        out.append((k, t[k]))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def by_key(pairs):
    out = {}
    for k, *x in sorted(pairs):
        out.setdefault(k, []).append(tuple(x))
    return out


@pytest.mark.parametrize("rows_a_piece", [10_000, 23])
@pytest.mark.parametrize("seconds", [0, 5, 60, 10_000])
def test_cooled(spark, rows_a_piece, seconds):
    made, want = hot(seconds), []
    for k, times in by_key(made).items():
        last = None
        for (t,) in times:
            if last is None or t - last >= seconds:
                last = t
                want.append((k, t))
    assert rows(folds.cooled(spark.createDataFrame(made, "key long, t long").repartition(3), seconds, rows_a_piece)) == sorted(want)


@pytest.mark.parametrize("rows_a_piece", [10_000, 23])
@pytest.mark.parametrize("quiet, most", [(30, 50), (8, 5), (1000, 40), (5000, 100_000)])
def test_capped_sessions(spark, rows_a_piece, quiet, most):
    made, want = hot(quiet), []
    for k, times in by_key(made).items():
        burst = []
        for (t,) in [*times, (10**12,)]:
            if burst and (t - burst[-1] >= quiet or burst[-1] - burst[0] >= most):
                want.append((k, burst[0], burst[-1], len(burst), burst[-1] if burst[-1] - burst[0] >= most else burst[-1] + quiet))
                burst = []
            burst.append(t)
    assert rows(folds.capped_sessions(spark.createDataFrame(made, "key long, t long").repartition(3), quiet, most, rows_a_piece)) == sorted(want)


@pytest.mark.parametrize("rows_a_piece", [10_000, 37])
def test_backed_off_of_hot_keys(spark, rows_a_piece):
    r, want = random.Random(2), []
    made = sorted({(k, 20 * t): (k, 20 * t, r.random() < 0.8) for k, t in hot(5, 900)}.values())
    for k, tries in by_key(made).items():
        last, fails = 0, 0
        for t, failed in tries:
            if not fails or t - last >= min(30 * fails, 600):
                last, fails = t, fails + 1 if failed else 0
                want.append((k, t, failed))
    assert rows(queue.backed_off(spark.createDataFrame(made, "key long, t long, failed boolean").repartition(3), rows_a_piece)) == sorted(want)


@pytest.mark.parametrize("rows_a_piece", [10_000, 41])
def test_rates_of_a_long_run(spark, rows_a_piece):
    """The mean since the window's start by looking back over all samples of the run, for each sample anew."""
    r, samples, want = random.Random(4), [], []
    for key in range(5):
        t, n = 0, 0
        for _ in range(300 if key == 0 else 60):
            t, busy = t + r.choice((1, 1, 2, 3, 9, 20)), r.random() > 0.03
            n = 0 if r.random() < 0.02 else n + r.choice((0, 0, 0, 3, 5000))
            samples.append((key, t, busy, n))
    for key in range(5):
        run = []
        for _, t, busy, n in [s for s in samples if s[0] == key]:
            if not busy or (run and n < run[-1][1]):
                run = []
            if not busy:
                want.append((key, t, 0.0))
                continue
            run.append((t, n))
            start, rate = run[0], 0.0
            for x in run[1:]:
                span = x[0] - start[0]
                if span >= 8 or (span >= 2 and x[1] > start[1]):
                    rate = (x[1] - start[1]) / span
                start = x if span >= 8 else start
            moved = max(x[0] for k, x in enumerate(run) if k == 0 or x[1] > run[k - 1][1])
            want.append((key, t, 0.0 if t - moved > 15 or rate < 1 else rate))
    assert rows(folds.rates(spark.createDataFrame(samples, "key long, t long, busy boolean, bytes long").repartition(3), rows_a_piece)) == sorted(want)


def test_many_small_keys_are_worked_on_together(spark):
    """120,000 rows of 40,000 keys: a frame for each key took about a millisecond a key and pass."""
    began = time.time()
    df = spark.range(120_000).selectExpr("id % 40000 as key", "id div 40000 * 10 as t", "true as busy", "id div 40000 * 100 as bytes")
    got = {tuple(r) for r in folds.capped_sessions(df.select("key", "t"), 30, 15).collect()}
    assert got == {(k, 0, 20, 3, 20) for k in range(40_000)}
    got = folds.rates(df).groupBy("t", "rate").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0.0, 40_000), (10, 10.0, 40_000), (20, 10.0, 40_000)]
    assert time.time() - began < 60


@pytest.mark.parametrize("rows_a_block", [1, 4, 7, 1000])
def test_blocks_cut_no_key(rows_a_block):
    keys = np.repeat(np.arange(9), [1, 5, 2, 1, 1, 12, 3, 1, 2])
    frame = pd.DataFrame({"key": keys, "x": np.arange(len(keys))})
    made = list(jumps.blocks((frame.iloc[i : i + 3] for i in range(0, len(keys), 3)), ["key"], rows_a_block))
    assert pd.concat([rows for rows, _ in made])["x"].tolist() == list(range(len(keys)))
    assert [int(rows["key"].iloc[k]) for rows, starts in made for k in starts] == list(range(9))

"""Ordered folds: per key, rows in time order, state carried from row to row. A partition's rows are sorted by Spark and stream
through, so a key that holds a third of all rows needs no more memory than another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import jumps


def fold(rows: DataFrame, key: str, order: list[str], schema: str, step: Callable[[dict, tuple], tuple | None]) -> DataFrame:
    """step(state, row) changes the key's state and gives an output row or None."""
    names = rows.columns
    at = names.index(key)

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), {}
        columns = [f.strip().split(" ")[0] for f in schema.split(",")]
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                if row[at] != current:
                    current, state = row[at], {}
                if (made := step(state, row)) is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=columns)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(folded, schema)


def cooled(alerts: DataFrame, seconds: int, rows_a_piece: int = jumps.ROWS_A_PIECE) -> DataFrame:
    """alerts: key, t. Those that come at least so many seconds after the last one that was let through."""
    t = lambda rows: rows["t"].to_numpy()
    chain = jumps.Chain(t, lambda rows, _: t(rows) + seconds, lambda rows, _: np.zeros(len(rows), np.int64))
    let = lambda rows, _, at, __: rows.iloc[at][["key", "t"]]
    return jumps.taken(alerts.select("key", "t"), ["key"], ["t"], chain, let, "key long, t long", rows_a_piece)


#: Fixed values of displayed speed, in seconds and bytes a second: a window's length, from when on it shows, how long without progress counts as moving, the least shown.
WINDOW, SHOWN_FROM, STALLED, LEAST_RATE = 8, 2, 15, 1


def rates(samples: DataFrame, rows_a_piece: int = jumps.ROWS_A_PIECE) -> DataFrame:
    """samples: key, t, busy, bytes. Bytes a second at each sample: the mean since the window's start, from two seconds on while bytes come in; after eight seconds the window starts anew. 0 at
    rest, after more than fifteen seconds without progress, and below 1. Fewer bytes than before are a new start.

    Samples fall into runs (busy ones whose bytes do not shrink). A run's windows are a greedy chain, so that each sample knows where its window began; its mean is shown if it may be, else
    the last one shown in the run."""

    def starts(rows: pd.DataFrame, before: dict | None) -> np.ndarray:
        busy, n = rows["busy"].to_numpy(bool), rows["bytes"].to_numpy()
        was, least = (before["busy"], before["bytes"]) if before else (False, 0)
        return ~busy | ~np.append(was, busy[:-1]) | (n < np.append(least, n[:-1]))

    at = jumps.runs(samples.select("key", "t", "busy", "bytes"), ["key"], ["t", "bytes"], starts, rows_a_piece).drop("prior_t")
    moving = at.where("busy").select("key", "run", "t", "bytes", (F.col("prior_bytes").isNull() | (F.col("bytes") > F.col("prior_bytes"))).alias("moves"))
    t = lambda rows: rows["t"].to_numpy()
    chain = jumps.Chain(t, lambda rows, _: t(rows) + WINDOW, lambda rows, _: np.zeros(len(rows), np.int64))

    def windows(rows: pd.DataFrame, keys: np.ndarray, places: np.ndarray, bound: float | None) -> pd.DataFrame:
        """Each sample's window: the last start of its run before it, by time; null for a run's first."""
        n = len(rows)
        begun = np.searchsorted(places, np.arange(n), "left") - 1
        start = places[np.maximum(begun, 0)] if len(places) else np.zeros(n, np.int64)
        of = np.repeat(keys, np.diff(np.append(keys, n)))
        came = np.where(of == 0, np.nan if bound is None else bound - WINDOW, np.nan)
        full = np.zeros(n, bool)
        full[places] = True
        since = np.where((begun < 0) | (start < of), came, t(rows)[start])
        return rows[["key", "run", "t", "bytes", "moves"]].assign(since=since, starts=full)

    placed = jumps.taken(moving, ["key", "run"], ["t", "bytes"], chain, windows, "key long, run long, t long, bytes long, moves boolean, since double, starts boolean", rows_a_piece).checkpoint()
    # a window starts at the first sample at its time that does
    begins = placed.where("starts").groupBy("key", "run", F.col("t").cast("double").alias("since")).agg(F.min("bytes").alias("b0"))
    span, more = F.col("t") - F.col("since"), F.col("bytes") - F.col("b0")
    mean = F.when((span >= WINDOW) | ((span >= SHOWN_FROM) & (more > 0)), more / span)
    known = placed.join(begins, ["key", "run", "since"], "left").select("key", "run", "t", "bytes", F.when(F.col("since").isNull(), F.lit(0.0)).otherwise(mean).alias("mean"), F.when(F.col("moves"), F.col("t")).alias("moved"))
    last = lambda part, c, then: (lambda x: float(x.iloc[-1]) if len(x) else then)(part[c].dropna())

    def shown(part: pd.DataFrame, keys: np.ndarray, carry: list | None) -> pd.DataFrame:
        of = np.repeat(np.arange(len(keys)), np.diff(np.append(keys, len(part))))
        begin = np.where(of == 0, 1.0 if carry else 0.0, 0.0)
        filled = (part[c].astype("float64").groupby(of).ffill().fillna(pd.Series(begin * (carry[k] if carry else 0.0), part.index)).to_numpy() for k, c in enumerate(("mean", "moved")))
        mean, moved = filled
        rate = np.where((part["t"].to_numpy() - moved > STALLED) | (mean < LEAST_RATE), 0.0, mean)
        return part[["key", "t"]].assign(rate=rate)

    after = lambda carry, s: [s[k] if s[k] is not None else carry[k] for k in range(2)]
    out = jumps.scanned(known, ["key", "run"], ["t", "bytes"], lambda part: [last(part, c, None) for c in ("mean", "moved")], after, shown, "key long, t long, rate double", rows_a_piece)
    return out.unionAll(samples.where("not busy").select("key", "t", F.lit(0.0).alias("rate")))


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """events: key, t. Runs without a silence of gap seconds: key, first_t, last_t, n, fires_at."""
    w = Window.partitionBy("key").orderBy("t")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) >= gap).cast("int"), F.lit(1))
    runs = events.select("key", "t").withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("key", "run").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n")).select("key", "first_t", "last_t", "n", (F.col("last_t") + gap).alias("fires_at"))


def capped_sessions(events: DataFrame, quiet: int, most: int, rows_a_piece: int = jumps.ROWS_A_PIECE) -> DataFrame:
    """events: key, t. Bursts that end with a silence of quiet, or with the first event at least `most` after their first: key, first_t, last_t, n,
    fires_at. Silences cut runs; in a run the next burst begins after the first event that is `most` beyond this one's beginning."""

    def starts(rows: pd.DataFrame, before: dict | None) -> np.ndarray:
        t = rows["t"].to_numpy()
        return np.diff(t, prepend=before["t"] if before else t[0]) >= quiet

    at = jumps.runs(events.select("key", "t"), ["key"], ["t"], starts, rows_a_piece)
    chain = jumps.Chain(lambda rows: rows["prior_t"].fillna(-np.inf).to_numpy(), lambda rows, _: rows["t"].to_numpy() + most, lambda rows, _: np.zeros(len(rows), np.int64))

    def parts(rows: pd.DataFrame, keys: np.ndarray, places: np.ndarray, bound: float | None) -> pd.DataFrame:
        t = rows["t"].to_numpy()
        cuts = np.union1d(keys, places).astype(np.int64)
        first = np.where(np.isin(cuts, places), t[cuts], 0 if bound is None else bound - most)
        ends = np.append(cuts[1:], len(t))
        return pd.DataFrame({"key": rows["key"].to_numpy()[cuts], "run": rows["run"].to_numpy()[cuts], "first_t": first.astype(np.int64), "last_t": t[ends - 1], "n": ends - cuts})

    made = jumps.taken(at, ["key", "run"], ["t"], chain, parts, "key long, run long, first_t long, last_t long, n long", rows_a_piece)
    out = made.groupBy("key", "run", "first_t").agg(F.max("last_t").alias("last_t"), F.sum("n").alias("n"))
    fires = F.when(F.col("last_t") - F.col("first_t") >= most, F.col("last_t")).otherwise(F.col("last_t") + quiet)
    return out.select("key", "first_t", "last_t", "n", fires.alias("fires_at"))


def latest(rows: DataFrame, key: str, order: Column, values: dict[str, Column]) -> DataFrame:
    """For each key the last non-null value of each expression."""
    return rows.groupBy(key).agg(*[F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), order)).alias(k) for k, v in values.items()])


def cooled_stream(alerts: DataFrame, seconds: int) -> DataFrame:
    """The same as cooled for a streaming frame: the state is the time of the last alert that went through."""

    def let_through(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for b in batches for x in b["t"]):
            if last is None or t - last >= seconds:
                last = int(t)
                out.append((key[0], last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "t"])

    return alerts.groupBy("key").applyInPandasWithState(let_through, "key long, t long", "last long", "append", GroupStateTimeout.NoTimeout)

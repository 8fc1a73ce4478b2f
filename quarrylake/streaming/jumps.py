"""Orders of time that are split within a key: scans with a small carry, and greedy chains by jumps.

In a greedy chain, what a row lets through next depends on the row alone (and on a small state), so a key's chain need not be followed row by row. Rows are sorted into pieces of bounded size, whatever their keys. In a piece each row's next one is a binary search, and jumps doubled in place give the last row of its chain there; where that
goes on in another piece, it asks for a place there. Asked places answer with the place where they leave in turn: these links between pieces are doubled as a table, so that a key of n
pieces is done in log n rounds. What is reached enters each piece at one place at most, and pieces are then walked side by side. A key that holds a third of all rows is as
many tasks' work as its rows make pieces; what meets on the driver is two rows a piece."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import shared_checkpoints

ROWS_A_PIECE = 1_000_000
#: Asked places that one task answers at a time.
ASKED_A_TASK = 1_000_000
NOWHERE = -1


class Chain(NamedTuple):
    """coordinate(rows): what grows along a key's rows; demand(rows, state): the coordinate that the next row must reach after a row is taken in this state; after(rows, state): the state then.
    rows is the frame of a key in a piece; states are 0 to n_states - 1, and a key begins in state 0."""

    coordinate: Callable[[pd.DataFrame], np.ndarray]
    demand: Callable[[pd.DataFrame, int], np.ndarray]
    after: Callable[[pd.DataFrame, int], np.ndarray]
    n_states: int = 1


class Segments:
    """The rows of whole keys, or of a key's part in a piece: key k has the rows from starts[k] on. Nodes are row * n_states + state; those beyond a key's rows are the way out."""

    def __init__(self, chain: Chain, rows: pd.DataFrame, starts: np.ndarray):
        self.k, n, self.starts = chain.n_states, len(rows), starts
        self.ends = np.append(starts[1:], n)
        self.coordinate = chain.coordinate(rows)
        self.bound = np.stack([chain.demand(rows, s) for s in range(self.k)], 1)
        self.state = np.stack([chain.after(rows, s) for s in range(self.k)], 1)
        end, after = np.repeat(self.ends, self.ends - starts), np.arange(1, n + 1)
        at = [self.reach(self.bound[:, s], after, end) for s in range(self.k)]
        self.next = np.stack([np.where(x < end, x * self.k + self.state[:, s], NOWHERE) for s, x in enumerate(at)], 1).ravel()

    def reach(self, bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first places from low to high whose coordinates reach their bounds: binary searches side by side."""
        low, high, last = low.copy(), high.copy(), len(self.coordinate) - 1
        while (low < high).any():
            middle = (low + high) // 2
            below = (low < high) & (self.coordinate[np.minimum(middle, last)] < bounds)
            high = np.where(below, high, np.minimum(middle, high))
            low = np.where(below, middle + 1, low)
        return low

    def last(self) -> np.ndarray:
        """Of each node the last of its chain here."""
        out = np.where(self.next == NOWHERE, np.arange(len(self.next)), self.next)
        while True:
            further = out[out]
            if (further == out).all():
                return out
            out = further

    def enter(self, bounds: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Nodes of the first key."""
        return np.searchsorted(self.coordinate[: self.ends[0]], bounds) * self.k + states

    def walk(self, nodes: np.ndarray) -> np.ndarray:
        """The rows that are taken from nodes on, in order: all keys step side by side, and the last few one by one."""
        out = []
        while len(nodes) > 16:
            out.append(nodes // self.k)
            nodes = self.next[nodes]
            nodes = nodes[nodes != NOWHERE]
        for node in nodes.tolist():
            one = []
            while node != NOWHERE:
                one.append(node // self.k)
                node = int(self.next[node])
            out.append(np.array(one, np.int64))
        return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


#: Rows of whole keys that are worked on together.
ROWS_A_BLOCK = 50_000


def blocks(batches: Iterator[pd.DataFrame], by: list[str], rows_a_block: int = ROWS_A_BLOCK) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches put together so that no key is cut, with the places where keys begin."""
    held: list[pd.DataFrame] = []
    n = 0

    def begins(rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for c in by:
            x = rows[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    wanted = rows_a_block
    for b in batches:
        held.append(b)
        n += len(b)
        if n < wanted:
            continue
        rows = pd.concat(held, ignore_index=True)
        starts = begins(rows)
        cut = int(starts[-1])  # the last key may go on
        if cut:
            yield rows.iloc[:cut].reset_index(drop=True), starts[:-1]
        held, n = [rows.iloc[cut:]], len(rows) - cut
        wanted = max(rows_a_block, 2 * n)  # a long key is not put together anew with each batch
    if n:
        rows = pd.concat(held, ignore_index=True)
        yield rows, begins(rows)


def edges(batches: Iterator[pd.DataFrame], by: list[str]) -> list[tuple[tuple, pd.DataFrame]]:
    """The first and the last key of a piece, with their rows; the others have all their rows here."""
    first = last = None
    for rows, starts in blocks(batches, by):
        key = lambda k: tuple(_plain(rows[c].iloc[k]) for c in by)  # noqa: B023, E731
        if first is None:
            first = (key(0), rows.iloc[: starts[1] if len(starts) > 1 else len(rows)])
            if len(starts) == 1:
                continue
        last = (key(int(starts[-1])), rows.iloc[int(starts[-1]) :].reset_index(drop=True))
    return [x for x in (first, last) if x is not None]


def pieces(rows: DataFrame, by: list[str], order: list[str], rows_a_piece: int = ROWS_A_PIECE) -> tuple[DataFrame, int]:
    """rows with their piece and rid (a number that grows with the order), sorted, and how many pieces; written, so that pieces stay what they are. Equal rows can be parted too."""
    shared_checkpoints(rows.sparkSession)
    n = max(1, -(-rows.count() // rows_a_piece))
    told = rows.withColumn("__nth", F.monotonically_increasing_id())
    # so few rows need not be split: keys stay whole
    dealt = told.repartitionByRange(n, *by, *order, "__nth") if n > 1 else told.repartition(*by)
    at = dealt.sortWithinPartitions(*by, *order, "__nth").drop("__nth")
    return at.withColumns({"piece": F.spark_partition_id().cast("long"), "rid": F.monotonically_increasing_id()}).checkpoint(), n


def scanned(rows: DataFrame, by: list[str], order: list[str], summary: Callable[[pd.DataFrame], Any], after: Callable[[Any, Any], Any], emit: Callable[..., pd.DataFrame], schema: str, rows_a_piece: int = ROWS_A_PIECE) -> DataFrame:
    """A scan over each key's rows in order: emit(rows, starts, carry) for blocks of keys, which begin at starts; only the first key of a piece can have a carry. It comes from the key's pieces before: after(carry, summary of a piece), None at first. Summaries are small
    (JSON); only those of keys that go on in another piece are made, two a piece, and put together on the driver."""
    at, n = pieces(rows, by, order, rows_a_piece)
    carries: dict[tuple, dict[int, Any]] = {}
    if n > 1:
        kinds = {f.name: f.dataType.simpleString() for f in at.schema}

        def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = [(*key, int(part["piece"].iloc[0]), json.dumps(summary(part))) for key, part in edges(batches, by)]
            yield pd.DataFrame(seen, columns=[*by, "piece", "summary"])

        found = at.mapInPandas(ends, ", ".join(f"{c} {kinds[c]}" for c in by) + ", piece long, summary string").toPandas().sort_values("piece")
        for key, part in found.groupby(by, sort=False):
            carry = None
            if len(part) > 1:
                mine = carries.setdefault(tuple(_plain(x) for x in key), {})
                for p, said in zip(part["piece"], part["summary"], strict=True):
                    mine[int(p)] = carry
                    carry = after(carry, json.loads(said))
    shared = rows.sparkSession.sparkContext.broadcast(carries)

    def scans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in blocks(batches, by):
            yield emit(rows, starts, shared.value.get(tuple(_plain(rows[c].iloc[0]) for c in by), {}).get(int(rows["piece"].iloc[0])))

    return at.mapInPandas(scans, schema)


def runs(rows: DataFrame, by: list[str], order: list[str], starts: Callable[[pd.DataFrame, dict | None], np.ndarray], rows_a_piece: int = ROWS_A_PIECE) -> DataFrame:
    """rows (numbers and booleans) with run, a number for each run of a key, and prior_{c} for each column of order: the row before, in its run, else null. starts(rows, the row before the
    first one or None) says which rows begin a run; a key's first row does."""
    columns = rows.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    row = lambda part, k: {c: _plain(part[c].iloc[k]) for c in columns}

    def summary(part: pd.DataFrame) -> dict:
        inside = np.flatnonzero(np.asarray(starts(part, None), bool)[1:])
        return {"first": row(part, 0), "rid": int(part["rid"].iloc[0]), "last": row(part, -1), "run": int(part["rid"].iloc[inside[-1] + 1]) if len(inside) else None}

    def after(carry: dict | None, s: dict) -> dict:
        run = s["run"]
        if run is None:
            new = carry is None or bool(starts(pd.DataFrame([s["first"]]), carry["last"])[0])
            run = s["rid"] if new else carry["run"]
        return {"last": s["last"], "run": run}

    def emit(part: pd.DataFrame, keys: np.ndarray, carry: dict | None) -> pd.DataFrame:
        new = np.asarray(starts(part, carry and carry["last"]), bool).copy()
        new[keys[1:] if carry else keys] = True
        at = np.maximum.accumulate(np.where(new, np.arange(len(part)), -1))
        rid = part["rid"].to_numpy()
        out = part[columns].assign(run=np.where(at < 0, carry["run"] if carry else 0, rid[at]))
        for c in order:
            before = part[c].shift().astype("float64")
            if carry:
                before.iloc[0] = carry["last"][c]
            out[f"prior_{c}"] = before.mask(new)
        return out

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", run long" + "".join(f", prior_{c} double" for c in order)
    return scanned(rows, by, order, summary, after, emit, schema, rows_a_piece)


def _plain(x):
    return x.item() if isinstance(x, np.generic) else x


def taken(rows: DataFrame, by: list[str], order: list[str], chain: Chain, emit: Callable[..., pd.DataFrame], schema: str, rows_a_piece: int = ROWS_A_PIECE, asked_a_task: int = ASKED_A_TASK) -> DataFrame:
    """rows (numbers and booleans, none null in by) in the order of each key: emit(rows, starts, taken places, bound) for blocks of keys, which begin at starts. bound is what the chain of the first
    key brought into the piece, or None where it begins there; with no place of that key taken, bound is what passes over the piece. All other keys begin in the piece."""
    at, n = pieces(rows, by, order, rows_a_piece)
    if n == 1:

        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, starts in blocks(batches, by):
                yield emit(part, starts, Segments(chain, part, starts).walk(starts * chain.n_states), None)

        return at.mapInPandas(alone, schema)
    kinds = {f.name: f.dataType.simpleString() for f in at.schema}
    key_schema = ", ".join(f"{c} {kinds[c]}" for c in by)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first and the last key of a piece: the others have all their rows here."""
        seen = [(*key, int(part["piece"].iloc[0]), float(chain.coordinate(part)[-1])) for key, part in edges(batches, by)]
        yield pd.DataFrame(seen, columns=[*by, "piece", "reach"])

    # two rows a piece
    found = at.mapInPandas(ends, f"{key_schema}, piece long, reach double").toPandas().sort_values("piece")
    spans: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for key, part in found.groupby(by, sort=False):
        if len(part) > 1:
            spans[tuple(_plain(x) for x in key)] = (part["piece"].to_numpy(), part["reach"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(spans)
    node = [*by, "piece", "bound", "state"]
    node_schema = f"{key_schema}, piece long, bound double, state long"

    def target(key: tuple, piece: int, bounds: np.ndarray) -> np.ndarray:
        """The pieces where chains that leave a piece go on: the first later ones of the key that reach their bounds; else one beyond its last."""
        numbers, reach = shared.value[key]
        place = np.maximum(np.searchsorted(reach, bounds), np.searchsorted(numbers, piece, "right"))
        return np.where(place < len(numbers), numbers[np.minimum(place, len(numbers) - 1)], numbers[-1] + 1)

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where the chains of a piece's rows go on, and of a key's first piece where the key's own chain does."""
        for key, part in edges(batches, by):
            if key not in shared.value:
                continue
            s, piece = Segments(chain, part, np.zeros(1, np.int64)), int(part["piece"].iloc[0])
            out = np.flatnonzero(s.next == NOWHERE)
            bound, state = s.bound.ravel()[out], s.state.ravel()[out]
            first = np.zeros(len(out), bool)
            if shared.value[key][0][0] == piece:
                first = out == s.last()[0]
                out, bound, state, first = out[first], bound[first], state[first], first[first]
            made = pd.DataFrame({"piece": target(key, piece, bound), "bound": bound.astype(float), "state": state, "first": first})
            for k, c in zip(key, by, strict=True):
                made[c] = k
            yield made.drop_duplicates()[[*node, "first"]]

    asked = at.mapInPandas(asks, f"{node_schema}, first boolean").groupBy(*node).agg(F.max("first").alias("first")).checkpoint()
    loads = asked.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / asked_a_task).cast("long").alias("loads"))
    split = asked.join(loads.withColumnRenamed("loads", "__n"), "piece").withColumn("load", F.pmod(F.xxhash64(*node), F.col("__n")))

    def spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, part in edges(batches, by):
            if key in shared.value:
                yield part

    rows_of = at.mapInPandas(spanning, at.schema).join(loads, "piece").withColumn("load", F.explode(F.sequence(F.lit(0).cast("long"), F.col("loads") - 1)))

    def answers(_, part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Asked places of one piece, with where their chains leave it."""
        out = []
        wanted = {k: g for k, g in asked.groupby(by, sort=False)}
        for key, rows in edges(iter([part.sort_values("rid", ignore_index=True)]), by):
            g = wanted.get(key if len(by) > 1 else key[0], wanted.get(key))
            if g is None or not len(g):
                continue
            s = Segments(chain, rows, np.zeros(1, np.int64))
            end = s.last()[s.enter(g["bound"].to_numpy(), g["state"].to_numpy())]
            bound, state = s.bound.ravel()[end].astype(float), s.state.ravel()[end]
            out.append(g[node].assign(to_piece=target(key, int(g["piece"].iloc[0]), bound), to_bound=bound, to_state=state))
        return pd.concat(out) if out else pd.DataFrame(columns=[*node, "to_piece", "to_bound", "to_state"])

    jump = rows_of.groupBy("piece", "load").cogroup(split.groupBy("piece", "load")).applyInPandas(answers, f"{node_schema}, to_piece long, to_bound double, to_state long").checkpoint()
    to = [F.col(c).alias(f"__{c}") for c in node]
    ahead = [*by, *(F.col(f"to_{c}").alias(c) for c in ("piece", "bound", "state"))]
    reached = asked.where("first").select(*node).checkpoint()
    count = reached.count()
    while True:
        reached = reached.unionAll(jump.join(reached, node, "left_semi").select(*ahead)).distinct().checkpoint()
        if (now := reached.count()) == count:
            break
        count = now
        step = jump.select(*to, *(F.col(f"to_{c}").alias(f"next_{c}") for c in ("piece", "bound", "state")))
        same = [F.col(c) == F.col(f"__{c}") for c in by] + [F.col(f"to_{c}") == F.col(f"__{c}") for c in ("piece", "bound", "state")]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        jump = jump.join(step, condition).select(*node, *(F.col(f"next_{c}").alias(f"to_{c}") for c in ("piece", "bound", "state"))).checkpoint()
    # at most one place for each key and piece
    entries: dict[tuple, dict[int, tuple[float, int]]] = {}
    for r in reached.collect():
        entries.setdefault(tuple(r[c] for c in by), {})[r["piece"]] = (r["bound"], r["state"])
    doors = rows.sparkSession.sparkContext.broadcast({k: (np.array(sorted(v)), [v[p] for p in sorted(v)]) for k, v in entries.items()})

    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, starts in blocks(batches, by):
            s, piece, nodes, bound = Segments(chain, part, starts), int(part["piece"].iloc[0]), starts * chain.n_states, None
            key = tuple(_plain(part[c].iloc[0]) for c in by)
            if key in shared.value and shared.value[key][0][0] != piece:
                at_pieces, places = doors.value[key]
                k = int(np.searchsorted(at_pieces, piece))
                bound, state = places[k]  # the chain's next place is here, or its bound passes over this piece
                nodes = nodes[1:] if at_pieces[k] != piece else np.append(s.enter(np.array([bound]), np.array([state])), nodes[1:])
            yield emit(part, starts, s.walk(nodes), bound)

    return at.mapInPandas(walks, schema)

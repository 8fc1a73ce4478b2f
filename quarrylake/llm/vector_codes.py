"""Vector code compression: product codes of integer vectors, trained by Lloyd's rounds with Hamerly's bounds.

Each part of a vector keeps its entry, one upper bound (of its distance to that entry) and one lower bound (of its distance to the second nearest), written
with the vector to the shared folder after each round; so a lost executor costs one task of one round. When entries have moved, the upper bound grows by
the move of its entry and the lower one shrinks by the largest other move. Only if the upper bound is not strictly below the lower one, nor below half of the
entry's distance to its next entry, the upper bound is made exact, and only if that fails too all entries are compared in integers, the
lower index winning ties. Bounds are rounded outwards, so that float arithmetic never hides a tie. A round's sums leave each task as one row an entry; the driver sees
the codebooks alone (parts x entries x width integers, whatever the number of vectors).

Defined results: vectors that are null or hold null, NaN or infinite components are dropped; vec_id may be null (last in order) or repeat (a row each; ties of the first
entries go by the vector); fewer rows than entries: as many entries as rows; equal vectors have equal codes; entries that are equal all stay, the lowest is used; label
may be null, which is one label; no vectors left, or an empty table: empty result; other columns are not looked at, whatever their names. All kept vectors must have one length, a
multiple of the parts, and components below 2^50, else a ValueError says so. An error, or a label's sum of errors, that passes a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, released, small_batches, stored, stored_at, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Within this, squares of differences of up to 512 components a part fit a long; beyond it Python's integers take over.
NARROW, WIDE = 1 << 26, 1 << 62
LONG = (1 << 63) - 1
STATE = "vec_id long, label {label}, vec array<double>, codes binary, bounds binary, part int, entry int, count long, sums string"


def integers(vecs: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width) of floor(SCALE * x)."""
    flat = np.asarray(vecs.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vecs), parts, -1)
    scaled = np.floor(flat * SCALE)
    most = np.abs(scaled).max(initial=0)
    if most >= WIDE:
        raise ValueError("a component is 2^50 or more")
    ints = scaled.astype(np.int64)
    return ints if most < NARROW else ints.astype(object)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of integers, rounded outwards."""
    root = np.sqrt(squares.astype(np.float64))
    return np.nextafter(root * (1 + 1e-15), np.inf) if up else np.maximum(np.nextafter(root * (1 - 1e-15), -np.inf), 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, in integers; a and b broadcast."""
    d = a - b
    return (d * d).sum(-1)


class Book:
    """The codebooks of a round: entries, how far each has come since the last round, and half of each one's distance to its next."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries, self.first = entries, before is None  # (parts, entries, width)
        if before is not None:
            self.moves = _root(squared(entries, before), True)
            largest = np.argmax(self.moves, 1)[:, None]
            rest = self.moves.copy()
            np.put_along_axis(rest, largest, -np.inf, 1)
            self.others = np.where(np.arange(entries.shape[1]) == largest, np.maximum(rest.max(1), 0)[:, None], self.moves.max(1)[:, None])
            between = _root(squared(entries[:, :, None], entries[:, None]), False)
            between[:, np.arange(entries.shape[1]), np.arange(entries.shape[1])] = np.inf
            self.half = np.nextafter(between.min(2) / 2, -np.inf)

    def assign(self, ints: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Changes codes and bounds (rows, parts) in place to the nearest entries; returns how many parts were compared with all entries."""
        scans = 0
        for p in range(ints.shape[1]):
            entries, code, up, low = self.entries[p], codes[:, p], upper[:, p], lower[:, p]
            if self.first:
                todo = np.arange(len(ints))
            else:
                up[:] = np.nextafter(up + self.moves[p][code], np.inf)
                low[:] = np.nextafter(low - self.others[p][code], -np.inf)
                safe = np.maximum(low, self.half[p][code])
                todo = np.flatnonzero(~(up < safe))
                up[todo] = _root(squared(ints[todo, p], entries[code[todo]]), True)
                todo = todo[~(up[todo] < safe[todo])]
            if len(todo):
                far = squared(ints[todo, p, None], entries[None])
                code[todo] = best = np.argmin(far, 1)
                up[todo] = _root(far[np.arange(len(todo)), best], True)
                if far.shape[1] > 1:
                    low[todo] = _root(np.partition(far, 1, 1)[:, 1], False)
                else:
                    low[todo] = np.inf
                scans += len(todo)
        return scans


def _columns(b: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes, upper and lower bounds of a batch."""
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
    bounds = np.frombuffer(b"".join(b.column("bounds").to_pylist()), np.float64).reshape(-1, 2, parts)
    return codes, bounds[:, 0].copy(), bounds[:, 1].copy()


def _round(book: Book, parts: int, label: pa.DataType):
    """Rows with new codes and bounds; at a task's end one row for each entry used, with the number and the sum of its parts."""

    @released
    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = book.entries.shape[1]
        counts = np.zeros((parts, k), np.int64)
        sums = np.zeros(book.entries.shape, object)
        none = lambda n, kind: pa.nulls(n, kind)
        names = ["vec_id", "label", "vec", "codes", "bounds", "part", "entry", "count", "sums"]
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ints = integers(b.column("vec"), parts)
            codes, upper, lower = (np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))) if book.first else _columns(b, parts)
            book.assign(ints, codes, upper, lower)
            for p in range(parts):
                one = np.zeros((k, n), np.int64)
                one[codes[:, p], np.arange(n)] = 1
                counts[p] += one.sum(1)
                sums[p] += one.astype(ints.dtype) @ ints[:, p]
            packed = [pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), pa.array([r.tobytes() for r in np.stack([upper, lower], 1)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("vec"), *packed, none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.string())], names)
        used = np.argwhere(counts)
        if len(used):
            n = len(used)
            said = [",".join(map(str, sums[p, e])) for p, e in used]
            yield pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, label), none(n, pa.list_(pa.float64())), none(n, pa.binary()), none(n, pa.binary()), pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)), pa.array(counts[tuple(used.T)]), pa.array(said)], names)

    return rounds


def _coded(book: Book, parts: int):
    @released
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The final codes, with the exact error of each row."""
        for b in batches:
            if not b.num_rows:
                continue
            ints = integers(b.column("vec"), parts)
            codes, upper, lower = (np.zeros((b.num_rows, parts), np.int64), np.zeros((b.num_rows, parts)), np.zeros((b.num_rows, parts))) if book.first else _columns(b, parts)
            book.assign(ints, codes, upper, lower)
            near = book.entries[np.arange(parts), codes]  # (rows, parts, width)
            errors = [e if e <= LONG else None for e in squared(ints, near).sum(1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in codes.astype(np.uint8)], pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return coded


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The entries after a round: floor(sum / count) of each component; entries without parts stay."""
    rows = state.where("part is not null").select("part", "entry", "count", F.posexplode(F.split("sums", ",")).alias("at", "sum"))
    sums = rows.groupBy("part", "entry", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("count").alias("count")).collect()  # parts x entries x width rows at most
    after = book.astype(object)
    for r in sums:
        after[r["part"], r["entry"], r["at"]] = int(r["sum"]) // r["count"]
    return _narrow(after)


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if max((abs(int(x)) for x in book.ravel()), default=0) < NARROW else book.astype(object)


def usable(vectors: DataFrame, column: str = "embedding", parts: int = PARTS) -> DataFrame:
    """vec_id, label and vec (array<double>) of the vectors that are kept."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(column).cast("array<double>").alias("vec"))


def train(vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray | None, str | None]:
    """The state after the last round, the final codebooks, those before them, and where the state is written."""
    spark = vectors.sparkSession
    small_batches(spark)
    kept = usable(vectors, column, parts)
    lengths = kept.select(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if lengths[0] != lengths[1] or (lengths[0] or 0) % parts:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} components; {parts} parts need one length, a multiple of {parts}")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    if not first:
        return kept, np.zeros((parts, 0, 0), np.int64), None, None
    book = _narrow(integers(pa.array([r.vec for r in first], pa.list_(pa.float64())), parts).swapaxes(0, 1))
    before, state, path = None, kept, None
    kind = kept.schema["label"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    label = to_arrow_type(kind)
    schema = STATE.format(label=kind.simpleString())
    for _ in range(rounds):
        wanted = ["vec_id", "label", "vec"] + ([] if before is None else ["codes", "bounds"])
        after, written = stored_at(state.select(wanted).mapInArrow(_round(Book(book, before), parts, label), schema))
        if path:
            forget(spark, path)  # what stood there is written anew
        state, path = after.where("part is null"), written
        before, book = book, _moved(after, book)
    return state, book, before, path


def compressed(vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    state, book, before, path = train(vectors, column, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for x in book.ravel()).encode()).hexdigest()
    kind = state.schema["label"].dataType.simpleString()
    if not book.shape[1]:
        coded = state.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    else:
        wanted = ["vec_id", "label", "vec"] + ([] if before is None else ["codes", "bounds"])
        coded = stored(state.select(wanted).mapInArrow(_coded(Book(book, before), parts), f"vec_id long, label {kind}, code string, error long"))
        if path:
            forget(state.sparkSession, path)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when((F.count_if(F.col("error").isNull()) == 0) & (total <= LONG), total.cast("long"))
    sums = coded.groupBy(F.col("label").alias("__label")).agg(total.alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _oracle(rounds: int = ROUNDS) -> str:
    square = "list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) for i in range(1, len(x.v) + 1)])"
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    ctes = [
        "e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT) for y in embedding] AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len([y for y in embedding if y IS NULL OR isnan(y) OR isinf(y)]) = 0)",
        "x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v FROM e, range(8) t(p))",
        "c0 AS MATERIALIZED (SELECT p, r - 1 AS k, v FROM x WHERE r <= 16)",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT x.r, x.p, min({square} * 16 + c.k) AS best FROM x JOIN c{n} c ON x.p = c.p GROUP BY x.r, x.p)")
        if n < rounds:
            ctes.append(f"s{n} AS MATERIALIZED (SELECT p, k, i, sum(y) AS s, count(*) AS n FROM (SELECT x.p, a.best % 16 AS k, unnest(range(1, len(x.v) + 1)) AS i, unnest(x.v) AS y FROM x JOIN a{n} a ON x.r = a.r AND x.p = a.p) GROUP BY p, k, i)")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT p, k, list({floor} ORDER BY i) AS v FROM s{n} GROUP BY p, k) m ON c.p = m.p AND c.k = m.k)")
    return (
        f"WITH {', '.join(ctes)}, f AS (SELECT r, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY r), "
        "j AS (SELECT e.vec_id, e.label, f.code, f.error FROM e JOIN f USING (r)) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        f"(SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, i)) FROM (SELECT p, k, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS y FROM c{rounds})) AS codebooks_sha256 FROM j"
    )


ORACLE = _oracle()

"""Vector code compression: product codes by Lloyd rounds with norm-of-sum bounds.

Components become integers ``floor(scale * x)``; a vector is cut into ``parts``
equal parts, each with a codebook of ``entries`` entries that starts as that
part of the vectors with the smallest ids.  Each round assigns every part to its
nearest entry (exact squared distances, ties to the lower index) and moves
each entry to the floor of its parts' mean; unused entries stay.  After the last
round parts are assigned once more.

*Bounds.*  A part keeps its code, an upper bound of the distance to that entry
and a lower bound of the distance to every other one, each with a stamp: the
round in which it was worked out.  All earlier codebooks are retained, so a
bound of round s is corrected at round t by how far entries really are from
where they were, ``|c_t - c_s|`` (the norm of the summed moves), which is never
more than the sum of the norms of the moves.  Where the upper bound stays below the lower
one the code can't have changed.  Otherwise the upper bound is worked out
anew, and only if that doesn't help either all distances are, exactly.  Bounds
are rounded outwards and comparisons leave a margin, so results are those of
plain rounds.

*Data flow.*  A round reads vectors with their state and writes them with the
new state: narrow, no vector is shuffled or joined.  A task adds one row a
changed (part, entry): how sums and counts change.  These are summed by Spark
and ``parts x entries x width`` numbers reach the driver.  State is 13 bytes a
part; only the table of the last round is kept.  Rows, sums and counters of a task
are committed together, so a lost executor repeats its tasks and no sum counts
twice.

Defined cases: a vector that is NULL or holds a NULL or non-finite component is
dropped.  Vectors that can't be cut like the others (another length than the
most common one that ``parts`` divides, or a component of 2**70 or more) stay, with a
NULL code and error; so do errors over 2**63 - 1 (code given, error NULL).
Rows with equal ids are ordered by vector, NULL ids come last; fewer vectors
than ``entries`` make smaller codebooks; equal entries: the lowest is used.
Labels are compared as text, NULL with NULL; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.llm.common import discard, join_groups, named, schema_of, ship, stage, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 2.0**70
MARGIN = 1e-9
_EXACT = 2.0**53  # whole numbers below it are exact in a double
STATE = np.dtype([("code", "u1"), ("near", "<f4"), ("far", "<f4"), ("near_at", "<u2"), ("far_at", "<u2")])


# --- exact arithmetic ---------------------------------------------------------


def whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers as Python integers, for what doubles can't hold exactly."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def fitting(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every squared distance is exact in doubles, else both as Python integers."""
    most = max((float(np.abs(a).max()) for a in (x, c) if a.size), default=0.0)
    if 4.0 * x.shape[1] * most * most < _EXACT:
        return x.astype(np.float64), c.astype(np.float64)
    return tuple(a if a.dtype == object else whole(a) for a in (x, c))


def all_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, exact (see ``fitting``)."""
    if x.dtype == object:
        return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def own_distances(x: np.ndarray, c: np.ndarray, code: np.ndarray) -> np.ndarray:
    gap = x - c[code]
    return (gap * gap).sum(axis=1)


def _up(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _down(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


# --- one round -----------------------------------------------------------------


def displacements(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry of the last codebooks is from where it was at each round,
    and the most that any entry but this one is: both (round, part, entry)."""
    now = history[-1]
    moved = np.zeros((len(history), *now.shape[:2]))
    for s, then in enumerate(history):
        for p, e in np.ndindex(*now.shape[:2]):
            moved[s, p, e] = math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(now[p, e], then[p, e])))
    most = np.zeros_like(moved)
    for e in range(now.shape[1]):
        others = np.delete(moved, e, axis=2)
        most[:, :, e] = others.max(axis=2) if others.shape[2] else 0.0
    return moved, most


@dataclass
class Round:
    """Assigns the parts of vectors to the last codebooks of ``history`` (part, entry, position)."""

    history: list[np.ndarray]

    def __post_init__(self) -> None:
        self.moved, self.most = displacements(self.history)
        self.asked = self.tightened = self.rescanned = 0

    def part(self, p: int, x: np.ndarray, state: np.ndarray | None) -> np.ndarray:
        """The new state of part ``p`` of vectors, whose old state is given (None: there is none)."""
        t = len(self.history) - 1
        x, c = fitting(x, self.history[-1][p])
        if state is None:
            out, open_ = np.zeros(len(x), STATE), np.arange(len(x))
        else:
            out = state.copy()
            code = state["code"].astype(np.int64)
            near = state["near"].astype(np.float64) + self.moved[state["near_at"], p, code]
            far = state["far"].astype(np.float64) - self.most[state["far_at"], p, code]
            open_ = np.flatnonzero(near * (1 + MARGIN) >= far * (1 - MARGIN))
            self.tightened += len(open_)
            if len(open_):
                out["near"][open_] = _up(own_distances(x[open_], c, code[open_]))
                out["near_at"][open_] = t
                open_ = open_[out["near"][open_] * (1 + MARGIN) >= far[open_] * (1 - MARGIN)]
        self.asked += len(x)
        self.rescanned += len(open_)
        if len(open_):
            d = all_distances(x[open_], c)
            code = np.array(d.argmin(axis=1), np.int64)
            at = np.arange(len(open_))
            out["code"][open_], out["near"][open_] = code, _up(d[at, code])
            if d.shape[1] > 1:
                d[at, code] = d.max() + 1
                out["far"][open_] = _down(d.min(axis=1))
            else:
                out["far"][open_] = np.inf
            out["near_at"][open_] = out["far_at"][open_] = t
        return out


def changes(x: np.ndarray, code: np.ndarray, old: np.ndarray | None, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """How the parts' change of code changes each entry's sums (entry, position) and count, in Python integers."""
    d = x.shape[1]
    sums, counts = np.zeros((entries, d), dtype=object), np.zeros(entries, dtype=object)
    at = np.arange(len(x)) if old is None else np.flatnonzero(code != old)
    if not len(at):
        return sums, counts
    most = float(np.abs(x).max()) if x.size else 0.0
    for sign, to in ((1, code[at]),) if old is None else ((1, code[at]), (-1, old[at])):
        counts += sign * np.bincount(to, minlength=entries).astype(object)
        if most * len(at) < _EXACT:
            by = np.zeros((entries, len(at)))
            by[to, np.arange(len(at))] = 1.0
            sums += sign * whole(by @ x[at])
        else:
            np.add.at(sums, to, sign * whole(x[at]))
    return sums, counts


# --- the rounds on Spark -----------------------------------------------------------

_STEP = "id {id}, label string, vector {vector}, state binary, part int, entry int, n decimal(38,0), sums array<decimal(38,0)>"


def _integers(column: pa.Array, length: int, scale: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length) * scale)


def _assign(rows: DataFrame, history: list[np.ndarray], length: int, scale: int, first: bool) -> DataFrame:
    """Vectors with their new state, and a row per entry whose parts changed in a task."""
    parts, entries, width = history[-1].shape
    kinds = dict(rows.dtypes)
    schema = schema_of(_STEP.format(id=kinds["id"], vector=kinds["vector"]))
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Round(history)
        sums, counts = np.zeros((parts, entries, width), dtype=object), np.zeros((parts, entries), dtype=object)
        for batch in filter(len, batches):
            x = _integers(batch.column(2), length, scale).reshape(-1, parts, width)
            old = None if first else np.frombuffer(b"".join(batch.column(3).to_pylist()), STATE).reshape(-1, parts)
            new = np.zeros((len(x), parts), STATE)
            for p in range(parts):
                before = None if old is None else old[:, p]
                new[:, p] = step.part(p, x[:, p], before)
                s, n = changes(x[:, p], new["code"][:, p].astype(np.int64), None if before is None else before["code"].astype(np.int64), entries)
                sums[p] += s
                counts[p] += n
            state = pa.array([r.tobytes() for r in new], pa.binary())
            empty = [pa.nulls(len(x), f.type) for f in list(target)[4:]]
            yield pa.RecordBatch.from_arrays([*(a.cast(f.type) for a, f in zip(batch.columns[:3], target)), state, *empty], schema=target)
        found = [(p, e) for p, e in np.ndindex(parts, entries) if counts[p, e] or any(sums[p, e])]
        if found:
            blank = [pa.nulls(len(found), f.type) for f in list(target)[:4]]
            n = pa.array([Decimal(int(counts[f])) for f in found], target.field("n").type)
            totals = pa.array([[Decimal(int(v)) for v in sums[f]] for f in found], target.field("sums").type)
            p, e = (pa.array(v, pa.int32()) for v in zip(*found))
            yield pa.RecordBatch.from_arrays([*blank, p, e, n, totals], schema=target)

    return rows.mapInArrow(run, schema)


def _encode(rows: DataFrame, history: list[np.ndarray], length: int, scale: int, first: bool) -> DataFrame:
    """``id, label, code, error`` by the last codebooks."""
    parts, _, width = history[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Round(history)
        for batch in filter(len, batches):
            x = _integers(batch.column(2), length, scale).reshape(-1, parts, width)
            old = None if first else np.frombuffer(b"".join(batch.column(3).to_pylist()), STATE).reshape(-1, parts)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), dtype=object)
            for p in range(parts):
                codes[:, p] = step.part(p, x[:, p], None if old is None else old[:, p])["code"]
                error += whole(own_distances(*fitting(x[:, p], history[-1][p]), codes[:, p].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in codes]), pa.array([e if e < 1 << 63 else None for e in error], pa.int64())],
                names=["id", "label", "code", "error"],
            )

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, label string, code string, error long")


@dataclass(frozen=True)
class Codebooks:
    """Integer entries (part, entry, position) and the scale that made components integers."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Digest of all entries' components, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """(``id, label, code, error``, staged; the final codebooks); labels as text."""
    spark = vectors.sparkSession
    ship(spark)
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(named(id).alias("id"), named(label).cast("string").alias("label"), named(vector).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull()).where(finite)
    small = F.forall("vector", lambda v: F.abs(v) < LARGEST)
    size = F.size("vector")
    sizes = rows.where(small & (size > 0) & (size % parts == 0)).groupBy(size.alias("size")).count()
    common = sizes.orderBy(F.desc("count"), "size").first()
    length = common["size"] if common else 0
    fits = (size == length) & small if length else F.lit(False)
    rest = rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = rows.where(fits)
    start = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    if not start:
        return stage(rest, "codes")[0], Codebooks(np.zeros((parts, 0, 0), dtype=object), scale)

    width = length // parts
    book = whole(np.floor(np.array([r.vector for r in start], np.float64) * scale)).reshape(len(start), parts, width).transpose(1, 0, 2)
    history = [book]
    sums, counts = np.zeros(book.shape, dtype=object), np.zeros(book.shape[:2], dtype=object)
    path = None
    for r in range(rounds):
        done, new = stage(_assign(rows, history, length, scale, r == 0), f"round-{r}")
        if path:
            discard(spark, path)
        path, rows = new, done.where("part is null").select("id", "label", "vector", "state")
        told = done.where("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
        for t in told.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect():
            sums[t.part, t.entry, t["at"]] += int(t["sum"])
            if t["at"] == 0:
                counts[t.part, t.entry] += int(t.n)
        book = history[-1].copy()
        for p, e in np.ndindex(*counts.shape):
            if counts[p, e]:
                book[p, e] = [s // counts[p, e] for s in sums[p, e]]
        history.append(book)
    codes, _ = stage(_encode(rows, history, length, scale, rounds == 0).unionByName(rest), "codes")
    if path:
        discard(spark, path)
    return codes, Codebooks(history[-1], scale)


def decode(codes: DataFrame, books: Codebooks, code: str = "code", column: str = "vector") -> DataFrame:
    """``codes`` plus the vector (array<double>) that a code stands for: its entries over the scale; NULL for a NULL code."""
    flat = [[F.array(*[F.lit(float(v) / books.scale) for v in e]) for e in part] for part in books.entries]
    if not books.entries.size:
        return codes.withColumn(column, F.lit(None).cast("array<double>"))
    at = [F.conv(F.substring(named(code), 2 * p + 1, 2), 16, 10).cast("int") + 1 for p in range(len(flat))]
    made = F.concat(*[F.element_at(F.array(*part), i) for part, i in zip(flat, at)])
    return codes.withColumn(column, F.when(named(code).isNotNull(), made))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes(id, label, code, error)`` plus ``label_error``, the errors summed over equal labels (NULLs together)."""
    key = F.coalesce(F.concat(F.lit("+"), "label"), F.lit("")).alias("key")
    keyed = codes.select("id", key, "code", "error")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    totals, _ = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), total.try_cast("long").alias("label_error")), "label-errors")
    return join_groups(keyed, totals, ["key"], "n").drop("key", "n")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``, 8 parts of 16 entries, 6 rounds: vec_id, code, error, label_error, codebooks_sha256."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def _rounds_sql() -> str:
    """Plain rounds: every distance to every entry, in every round."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, d * 100 + e) AS e, min(d) AS d FROM (
    SELECT x.vec_id, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts x JOIN c{r} c ON c.p = x.p) GROUP BY vec_id, p)"""
    move = """c{n} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS v FROM (
      SELECT x.p, a.e, i, floor(sum(x.v[i])::DOUBLE / count(*))::BIGINT AS m
      FROM parts x JOIN a{r} a ON a.vec_id = x.vec_id AND a.p = x.p, unnest(range(1, len(x.v) + 1)) AS u(i) GROUP BY x.p, a.e, i
    ) GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)"""
    steps = []
    for r in range(ROUNDS):
        steps += [nearest.format(r=r), move.format(r=r, n=r + 1)]
    return ",\n".join([*steps, nearest.format(r=ROUNDS)])


#: The same in DuckDB, without bounds.
OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM v, range({PARTS}) AS r(p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})
), {_rounds_sql()},
codes AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN codes USING (vec_id), books
"""

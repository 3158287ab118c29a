"""Embedding near-duplicates: an exact metric range join over pivot cells.

Links join vectors of one label (not NULL) whose cosine is ``threshold`` or
more, in double precision.  On unit vectors that is a range join of radius
``eps = sqrt(2 - 2 * threshold)`` in Euclidean distance.

* Equal vectors of a label are one class with a count, so copies cost one row.
* A label of over ``cell`` classes is cut into cells by pivots (a bounded
  sample of its vectors, ``max_pivots`` over all labels); a vector's home is
  its nearest pivot's cell.  By the triangle inequality a vector y of cell b
  can be within ``eps`` of a vector of cell a only if
  ``d(y, a) - d(y, b) <= 2 * eps``, and only if y is within ``eps`` of the
  plane halfway between the pivots.  Where both hold y is replicated to a, for
  a < b alone, so each pair meets in exactly one cell.
* Cells join independently.  A cell of over ``block`` rows (``block_bytes`` of
  vectors, if that is more) is dealt into chunks, each pair of chunks being one
  task's work: exact at any cell size, with memory bounded by two chunks.  A task returns each vector's number of
  links and a spanning set of links, never the pairs.

Pivots decide the cost, never the result.  Defined cases: a vector that is
NULL, empty, all zeros or holds a NULL or non-finite component, or whose label
is NULL, links with nothing; vectors of different lengths don't link; rows
with equal or NULL ids are vectors of their own, and a component's id is its
smallest id that isn't NULL; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodging.llm.common import named, schema_of, ship, stage, table
from lodging.llm.components import components

THRESHOLD = 0.93
CELL = 2000  # classes of a label up to which one cell is enough
MAX_PIVOTS = 4096  # over all labels: the pivots' size is bounded, whatever the data
BLOCK = 1000  # rows of a chunk, at least
BLOCK_BYTES = 4 << 20  # of vectors in a chunk: short vectors make larger chunks, so a row meets fewer of them
SLACK = 1e-9  # over the rounding of distances


def _usable(vector: str, label: str) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pivots(classes: DataFrame, cell: int, max_pivots: int) -> dict[tuple, np.ndarray]:
    """Pivots by (label, length), for labels of more than ``cell`` classes.

    The largest ``max_pivots`` labels at most are looked at, and a sample of
    their vectors of about twice the number of pivots wanted is collected.
    """
    sizes = classes.groupBy("label", F.size("vector").alias("dim")).count()
    large = sizes.where(F.col("count") > cell).orderBy(F.desc("count"), "label", "dim").limit(max_pivots).collect()
    want = {(r.label, r.dim): -(-r["count"] // cell) for r in large}
    scale = min(1.0, max_pivots / max(1, sum(want.values())))
    want = {k: max(1, int(n * scale)) for k, n in want.items()}
    if not want:
        return {}
    share = classes.sparkSession.createDataFrame(
        [(r.label, r.dim, min(1.0, 2.0 * (want[r.label, r.dim] + 8) / r["count"])) for r in large],
        classes.select("label", F.size("vector").alias("dim"), F.lit(0.0).alias("share")).schema,
    )
    chance = F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keyed = classes.withColumn("dim", F.size("vector")).join(F.broadcast(share), ["label", "dim"])
    rows = keyed.where(chance < F.col("share")).select("label", "dim", "cid", "vector").orderBy("cid").limit(4 * max_pivots)
    found: dict[tuple, list] = {}
    for r in rows.collect():
        found.setdefault((r.label, r.dim), []).append(r.vector)
    return {k: _unit(np.array(v[: want[k]])) for k, v in found.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares can't overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(units: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is its home) of every membership of unit vectors."""
    squares = np.maximum(2.0 - 2.0 * (units @ pivots.T), 0.0)
    home = squares.argmin(axis=1)
    distance = np.sqrt(squares)
    near, own = distance[np.arange(len(units)), home], squares[np.arange(len(units)), home]
    between = np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0))[home]
    reach = distance - near[:, None] <= 2 * eps + SLACK
    reach &= squares - own[:, None] <= 2 * between * (eps + SLACK) + SLACK
    reach &= np.arange(len(pivots))[None, :] < home[:, None]
    reach[np.arange(len(units)), home] = True
    row, cell = np.nonzero(reach)
    return row, cell, cell == home[row]


def _members(classes: DataFrame, pivots: dict[tuple, np.ndarray], eps: float) -> DataFrame:
    """Each class once per cell that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vectors = batch.column("label").to_pylist(), batch.column("vector").to_pylist()
            by: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(labels, map(len, vectors))):
                by.setdefault(k, []).append(i)
            take, cells, homes = [], [], []
            for k, rows in by.items():
                at = np.array(rows)
                if k in pivots:
                    row, cell, home = cells_of(_unit(np.array([vectors[i] for i in rows])), pivots[k], eps)
                else:
                    row, cell, home = np.arange(len(at)), np.zeros(len(at), int), np.ones(len(at), bool)
                take.append(at[row])
                cells.append(cell)
                homes.append(home)
            if take:
                index = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.take(index) for c in batch.columns),
                        pa.array(np.concatenate(cells), pa.int64()),
                        pa.array(np.concatenate(homes)),
                    ],
                    names=[*batch.schema.names, "cell", "home"],
                )

    schema = T.StructType([*classes.schema.fields, *schema_of("cell long, home boolean").fields])
    return classes.mapInArrow(run, schema)


def _join_chunks(threshold: float):
    """One pair of chunks of one cell: rows (u, v, n): n links of u, or a link u - v."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])
        pdf = pdf.sort_values("cid", kind="stable").reset_index(drop=True)
        x = np.array(pdf["vector"].tolist(), dtype=np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        cid, copies, home, chunk = (pdf[c].to_numpy() for c in ("cid", "copies", "home", "chunk"))
        a, b = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        links = np.zeros(len(x), np.int64)
        root = np.arange(len(x))
        step = max(1, 4_000_000 // max(1, len(b)))
        for at in range(0, len(a), step):
            rows = a[at : at + step]
            linked = (x[rows] @ x[b].T) / (norm[rows][:, None] * norm[b][None, :]) >= threshold
            linked &= home[rows][:, None] | home[b][None, :]
            if i == j:
                linked &= rows[:, None] < b[None, :]
            p, q = np.nonzero(linked)
            p, q = rows[p], b[q]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            while len(p):
                old = root.copy()
                np.minimum.at(root, p, root[q])
                np.minimum.at(root, q, root[p])
                root = root[root]
                if (root == old).all():
                    break
        some, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
        return pd.DataFrame(
            {
                "u": np.concatenate((cid[some], cid[joined])),
                "v": pd.array([None] * len(some) + cid[root[joined]].tolist(), dtype="Int64"),
                "n": np.concatenate((links[some], np.zeros(len(joined), np.int64))),
            }
        )

    return run


def near_duplicates(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    cell: int = CELL,
    max_pivots: int = MAX_PIVOTS,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``."""
    ship(vectors.sparkSession)
    eps = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    rows = vectors.select(named(id).alias("id"), named(vector).alias("raw"), named(label).alias("label"))
    rows = rows.withColumn("ok", _usable("raw", "label"))
    grouped = rows.where("ok").groupBy("label", "raw").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    classes, _ = stage(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    plain = classes.select("cid", "label", F.col("raw").cast("array<double>").alias("vector"), "copies")
    members, _ = stage(_members(plain, _pivots(plain, cell, max_pivots), eps), "cells")

    place = ["label", "dim", "cell"]
    members = members.withColumn("dim", F.size("vector"))
    rows_of = F.greatest(F.lit(block), F.floor(F.lit(block_bytes) / (F.col("dim") * 8)))
    sizes = members.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / rows_of)).drop("n")
    dealt = members.join(sizes, place).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    pairs = dealt.withColumn("other", other).select(
        *place, F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"),
        "chunk", "cid", "vector", "copies", "home",
    )
    found, _ = stage(
        pairs.groupBy(*place, "left", "right").applyInPandas(_join_chunks(threshold), "u long, v long, n long"), "links"
    )

    counts = found.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(found.where("v is not null").select("u", "v")).select(F.col("node").alias("cid"), "root")
    of = classes.join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(least, "root").select(
        "label", "raw", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = rows.where("ok").join(of, ["label", "raw"]).select("id", "n_links", "component_id")
    rest = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(rest)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id), "n_links", "component_id", kept.alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.93 over all ``embeddings``, within equal labels: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: The same in DuckDB, over all pairs of a label.
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN l ON r.w = l.u
), c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

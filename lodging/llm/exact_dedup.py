"""Exact dedup by two-pass Bloom filtering.

Texts are equal when they are identical after lower-casing A-Z only.  Of equal
texts the row with the largest id stays.

1. Every text becomes a 256-bit digest, in the JVM and without a shuffle.
2. *First pass.*  A Bloom filter whose cells count to two: each digest touches
   ``probes`` cells, and a cell knows whether none, one or more have touched
   it.  A task keeps two bit planes ("once", "again") and hands on the parts
   that aren't empty, compressed; parts of the same cells are merged, with
   "again" also where both tasks have "once".
3. *Second pass.*  A digest all of whose cells were touched again may repeat.
   Any other is certainly alone: its row passes straight through.
4. Only rows that may repeat are shuffled, by digest: their largest row and
   their number.  Filter errors (about one row in 200) are groups of one.

*Bounds.*  A filter has ``max_cells`` cells at most (two planes of 32 MB in a
task; the second one, 32 MB, goes to the driver and out by broadcast).  More
rows than it is good for (``max_cells / cells_per_row``, 22 million) are taken
in slices of the digests, one filter after the other, each reading only the
staged digests: no slice is skipped, and the filter never fills up.  A group's
facts are an aggregate with map-side combine joined back (``join_groups``), so
a text that a third of all rows hold is never gathered in a task.

Defined cases: a NULL text is an empty one; a NULL id is smaller than any id,
so it stays only among NULLs; of rows equal in text and id the one with the
largest hash over all columns stays, and any one of rows equal throughout;
other columns are carried by ``drop_copies`` and ignored by ``exact_groups``;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodging.llm.common import discard, join_groups, map_arrow, named, row_hash, ship, spare, stage, table

CELLS_PER_ROW = 12
MAX_CELLS = 1 << 28
PROBES = 5
CHUNKS = 64  # parts of a filter that are merged apart
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z in lower case; NULL counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), 256))


def cells_of(digests: list[bytes], cells: int, probes: int) -> np.ndarray:
    """The cells (rows x probes) that each digest touches; ``cells`` is a power of two."""
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
    step = halves[:, 1:2] | np.uint64(1)
    return (halves[:, :1] + step * np.arange(probes, dtype=np.uint64)[None, :]) & np.uint64(cells - 1)


def touch(once: np.ndarray, again: np.ndarray, at: np.ndarray) -> None:
    """Mark cells in the two bit planes, in place."""
    cell, times = np.unique(at, return_counts=True)
    byte, bit = (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8)
    more = (times > 1) | ((once[byte] & bit) != 0)
    np.bitwise_or.at(again, byte[more], bit[more])
    np.bitwise_or.at(once, byte, bit)


def all_again(again: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all cells of each row were touched again."""
    byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
    return ((again[byte] & bit) != 0).all(axis=1)


def _filter(digests: DataFrame, cells: int, probes: int) -> np.ndarray:
    """The "again" plane over all rows of ``digests(digest)``."""
    width = cells // 8 // CHUNKS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        for batch in filter(len, batches):
            touch(once, again, cells_of(batch.column(0).to_pylist(), cells, probes))
        some = [i for i in range(CHUNKS) if once[i * width : (i + 1) * width].any()]
        for i in some:
            planes = (zlib.compress(p[i * width : (i + 1) * width].tobytes(), 1) for p in (once, again))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([p], pa.binary()) for p in planes)], names=["chunk", "once", "again"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, again = (np.frombuffer(zlib.decompress(row[k]), np.uint8) for k in ("once", "again"))
                have = found.setdefault(row["chunk"], (np.zeros(width, np.uint8), np.zeros(width, np.uint8)))
                np.bitwise_or(have[1], again | (have[0] & once), out=have[1])
                np.bitwise_or(have[0], once, out=have[0])
        for chunk, (_, again) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([again.tobytes()], pa.binary())], names=["chunk", "again"])

    built = digests.select("digest").mapInArrow(build, "chunk int, once binary, again binary")
    merged = built.repartition("chunk").mapInArrow(merge, "chunk int, again binary")
    out = np.zeros(cells // 8, np.uint8)
    for row in merged.collect():  # CHUNKS rows, cells / 8 bytes in all
        out[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(row.again, np.uint8)
    return out


def _flag(rows: DataFrame, digest: str, column: str, again: np.ndarray, cells: int, probes: int) -> DataFrame:
    """``rows`` plus ``column``: whether its digest may repeat.  Narrow."""
    sent = rows.sparkSession.sparkContext.broadcast(again.tobytes())
    at = rows.columns.index(digest)  # by place: names may repeat in another case

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = None
        for batch in filter(len, batches):
            if plane is None:
                plane = np.frombuffer(sent.value, np.uint8)
            maybe = all_again(plane, cells_of(batch.column(at).to_pylist(), cells, probes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=[*batch.schema.names, column])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField(column, T.BooleanType())]))


def filter_size(rows: int, cells_per_row: int = CELLS_PER_ROW, max_cells: int = MAX_CELLS) -> tuple[int, int]:
    """(cells of a filter, number of slices) for so many rows."""
    slices = max(1, -(-rows * cells_per_row // max_cells))
    wanted = max(8 * CHUNKS, -(-rows // slices) * cells_per_row)
    return min(max(8 * CHUNKS, max_cells), 1 << (wanted - 1).bit_length()), slices


def _may_repeat(rows: DataFrame, cells_per_row: int, max_cells: int, probes: int) -> DataFrame:
    """``rows(digest, ...)``, staged, plus ``maybe``, staged: a slice of the digests at a time."""
    cells, slices = filter_size(rows.count(), cells_per_row, max_cells)
    out = None
    for s in range(slices):
        part = rows.where(F.pmod(F.crc32("digest"), F.lit(slices)) == s) if slices > 1 else rows
        flagged, _ = stage(_flag(part, "digest", "maybe", _filter(part, cells, probes), cells, probes), "flagged")
        out = flagged if out is None else out.unionByName(flagged)
    return out


def exact_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    cells_per_row: int = CELLS_PER_ROW,
    max_cells: int = MAX_CELLS,
    probes: int = PROBES,
) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, text_sha256``."""
    ship(docs.sparkSession)
    rows = docs.select(named(id).alias("id"), row_hash(docs).alias("tie"), digest_of(named(text)).alias("digest"))
    rows, path = stage(rows.withColumn("at", F.monotonically_increasing_id()), "digests")
    flagged = _may_repeat(rows, cells_per_row, max_cells, probes)
    discard(docs.sparkSession, path)
    alone = flagged.where("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    some = flagged.where("maybe").select("digest", "id", "tie", "at")
    groups, _ = stage(some.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "tie", "at")).alias("best")), "groups")
    met = join_groups(some, groups, ["digest"], "n").select(
        "id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("best.at")).alias("kept"), "digest"
    )
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    return alone.unionByName(met).select(F.col("id").alias(id), "keep_id", "group_size", "kept", sha)


def drop_copies(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    cells_per_row: int = CELLS_PER_ROW,
    max_cells: int = MAX_CELLS,
    probes: int = PROBES,
) -> DataFrame:
    """``docs`` with one whole row of each group of equal texts; columns and their order stay.

    A row that the filter knows to be alone is neither shuffled nor copied;
    the others are cut down to their group's best row before they are.
    """
    ship(docs.sparkSession)
    columns = docs.columns
    digest, tie, maybe, n, best = spare(docs, "digest", "tie", "maybe", "n", "best")
    keyed = docs.withColumns({tie: row_hash(docs), digest: digest_of(named(text))})
    digests, path = stage(keyed.select(F.col(digest).alias("digest")), "digests")
    cells, slices = filter_size(digests.count(), cells_per_row, max_cells)
    out = None
    for s in range(slices):
        mine = lambda d: d.where(F.pmod(F.crc32(d.columns[-1]), F.lit(slices)) == s) if slices > 1 else d
        flagged = _flag(mine(keyed), digest, maybe, _filter(mine(digests), cells, probes), cells, probes)
        some = flagged.where(F.col(maybe))
        order = F.struct(named(id).alias("id"), F.col(tie).alias("tie"))
        groups, _ = stage(some.groupBy(digest).agg(F.count(F.lit(1)).alias(n), F.max(order).alias(best)), "groups")
        first = join_groups(some, groups, [digest], n).where((F.col(tie) == F.col(f"{best}.tie")) & named(id).eqNullSafe(F.col(f"{best}.id")))
        part = flagged.where(~F.col(maybe)).select(*map(named, columns)).unionByName(first.dropDuplicates([digest]).select(*map(named, columns)))
        out = part if out is None else out.unionByName(part)
    discard(docs.sparkSession, path)
    return out


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies over all ``documents``: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same in DuckDB.
OP12_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""

"""SimHash near-duplicates by pivot distance tables.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``shingle`` words joined by one space (a text with fewer words is one
shingle), each hashed by XXH64 (seed 42); a bit is 1 where over half of the
hashes have it.  A text without words has fingerprint zero.

Links: fingerprints at ``max_bits`` or fewer differing bits.  Equal
fingerprints are one row from the start, so copies cost nothing further.

1. *Deal.*  The 64 bits are cut into ``max_bits + 1`` blocks; two linked
   fingerprints agree in one whole block at least, so each fingerprint goes to
   one bucket per block.  A bucket of over ``bucket`` fingerprints (a hot
   group, or simply a larger corpus) is dealt again by blocks of the bits
   that are still open, by the same argument, until it is small enough; when
   12 bits are left open it can't hold more than 4096.  Nothing is capped or
   dropped, and no task holds more than one bucket.
2. *Pivot table.*  In a bucket, each fingerprint's Hamming distances to
   ``pivots`` reference fingerprints are worked out once.  A pair whose
   distances to any one reference differ by more than ``max_bits`` can't be a
   link (triangle inequality) and is discarded by that maximum coordinate
   difference; survivors are verified bit by bit.
3. A bucket returns each linked fingerprint with the smallest one of its
   group in the bucket: rows in proportion to its size, not to its pairs.
4. Components are found over all buckets' rows, and each gets its smallest
   document id.

Defined cases: NULL text is an empty text; NULL ids are carried along and
count as larger than any id, so a component's id is NULL only where all its
ids are; repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.llm.common import named, per_text, row_hash, ship, spare, stage, table
from lodging.llm.components import components

SHINGLE = 3
MAX_BITS = 3
PIVOTS = 16
BUCKET = 2000
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text, as a signed 64-bit number."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in spans])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    if len(rows) < 64:
        ones = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(rows[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, column: str = "fp") -> DataFrame:
    """``docs`` without ``text`` but with its fingerprint as a long."""

    def make():
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return per_text(docs.withColumn(text, F.col(text).cast("binary")), make, f"{column} long", text, keep_text=False)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def references(n: int) -> np.ndarray:
    """``n`` fixed reference fingerprints, from a mixing function of their number."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=None)
def _open_bits(path: int, blocks: int) -> tuple[int, ...]:
    """The bits not yet fixed in a bucket; ``path`` numbers the blocks chosen so far."""
    if path == 0:
        return tuple(range(64))
    before = _open_bits((path - 1) // blocks, blocks)
    gone = set(_cut(before, blocks)[(path - 1) % blocks])
    return tuple(b for b in before if b not in gone)


def _cut(bits: tuple[int, ...], blocks: int) -> list[tuple[int, ...]]:
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def open_after(level: int, blocks: int) -> int:
    """The most bits that are open in a bucket after so many levels of dealing."""
    n = 64
    for _ in range(level):
        n -= n // blocks
    return n


def _deal(rows: DataFrame, blocks: int) -> DataFrame:
    """Each row of (fp, key, path) once per block of its open bits; equal blocks get equal keys.

    A key is a hash: two buckets that share one are compared together, which
    costs time but changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, path = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p in np.unique(path):
                at = path == p
                bits, parent = fp[at].view(np.uint64), key[at].view(np.uint64)
                for i, block in enumerate(_cut(_open_bits(int(p), blocks), blocks)):
                    mask = np.uint64(sum(1 << b for b in block))
                    child = int(p) * blocks + i + 1
                    to = _mix(_mix(parent + np.uint64(child)) ^ (bits & mask))
                    n = len(bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bits.view(np.int64)), pa.array(to.view(np.int64)), pa.array(np.full(n, child, np.int64))],
                        names=["fp", "key", "path"],
                    )

    return rows.mapInArrow(run, "fp long, key long, path long")


def pairs_in_buckets(fps: np.ndarray, ends: np.ndarray, max_bits: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked fingerprints; ``ends[i]`` is where the bucket of row i ends."""
    distances = np.bitwise_count(fps[:, None] ^ references(pivots)[None, :]).astype(np.int8)
    left, right = [], []
    i, k = np.arange(len(fps)), 0
    while len(i):
        k += 1
        i = i[ends[i] > i + k]
        j = i
        for p in range(pivots):
            j = j[np.abs(distances[j, p] - distances[j + k, p]) <= max_bits]
            if not len(j):
                break
        j = j[np.bitwise_count(fps[j] ^ fps[j + k]) <= max_bits]
        left.append(j)
        right.append(j + k)
    return (np.concatenate(left), np.concatenate(right)) if left else (i, i)


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that it is linked to by a chain of pairs."""
    label = np.arange(n)
    while len(a):
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == old).all():
            break
    return label


def _link(rows: DataFrame, max_bits: int, pivots: int) -> DataFrame:
    """Rows (fp, key) sorted by key in each partition -> links (u, v), one per linked fingerprint and bucket."""

    def found(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        ends = np.repeat(np.append(cut, len(key)), np.diff(np.concatenate(([0], cut, [len(key)]))))
        group = _groups(len(fp), *pairs_in_buckets(fp.view(np.uint64), ends, max_bits, pivots))
        at = np.flatnonzero(group != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[group[at]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = key = np.zeros(0, np.int64)
        for batch in batches:
            fp = np.concatenate((fp, batch.column(0).to_numpy(zero_copy_only=False)))
            key = np.concatenate((key, batch.column(1).to_numpy(zero_copy_only=False)))
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            if whole:
                yield found(fp[:whole], key[:whole])
                fp, key = fp[whole:], key[whole:]
        if len(fp):
            yield found(fp, key)

    return rows.select("fp", "key").mapInArrow(run, "u long, v long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect what links of ``max_bits`` connect; ``distinct(fp)``: each fingerprint once."""
    ship(distinct.sparkSession)
    blocks = max_bits + 1
    open_rows = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("path"))
    parts, level = [], 0
    while True:
        level += 1
        dealt = _deal(open_rows, blocks)
        if open_after(level, blocks) <= 12:
            parts.append(dealt)
            break
        large = dealt.groupBy("key").count().where(F.col("count") > bucket).select("key")
        large, _ = stage(large, "buckets")
        if large.isEmpty():
            parts.append(dealt)
            break
        parts.append(dealt.join(large, "key", "left_anti"))
        # Staged, so that deeper levels don't deal the rows of earlier ones again.
        open_rows, _ = stage(dealt.join(large, "key", "left_semi").select("fp", "key", "path"), "open")
    found = [_link(p.repartition("key").sortWithinPartitions("key"), max_bits, pivots) for p in parts]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    pivots: int = PIVOTS,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: ``id``, ``fp`` (long) and ``component_id``, its group's smallest id."""
    prints, _ = stage(fingerprints(docs.select(id, text), text, shingle), "fingerprints")
    return prints.join(_components(prints, id, max_bits, pivots, bucket), "fp").select(id, "fp", "component_id")


def _components(prints: DataFrame, id: str, max_bits: int, pivots: int, bucket: int) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint; root names its group."""
    distinct, _ = stage(prints.groupBy("fp").agg(F.min(id).alias("first")), "distinct")
    roots = components(links(distinct, max_bits, pivots, bucket)).select(F.col("node").alias("fp"), "root")
    joined = distinct.join(roots, "fp", "left")
    linked = joined.where("root is not null")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    alone = joined.where("root is null").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    return linked.join(least, "root").select("fp", "root", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Where several rows of a group share that id, the one with the smallest text
    hash stays, of rows equal in both the one with the smallest hash over all
    columns, and any one of rows equal throughout; a group whose ids are all
    NULL keeps one row likewise.  Columns and their order stay.
    """
    keyed = docs.select(named(id).alias("id"), named(text).alias("text"), row_hash(docs).alias("whole")).withColumn("row", F.xxhash64("text"))
    prints, _ = stage(fingerprints(keyed, "text", shingle), "fingerprints")
    group = _components(prints, "id", max_bits, PIVOTS, BUCKET)
    # Of a group's rows, those that hold its smallest id; of those, the smallest hashes.
    first = prints.join(group, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    i, best = spare(docs, "id", "best")
    kept = first.groupBy("root", "id").agg(F.min(F.struct("row", "whole")).alias(best)).select(F.col("id").alias(i), best)
    same = named(id).eqNullSafe(F.col(i)) & (F.xxhash64(named(text)) == F.col(f"{best}.row")) & (row_hash(docs) == F.col(f"{best}.whole"))
    return docs.join(kept, same).dropDuplicates([i, best]).select(*map(named, docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups over all ``documents``: doc_id, fingerprint (16 hex digits), component_id.

    Shingles of 3 words, links at 3 or fewer differing bits; see the module.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

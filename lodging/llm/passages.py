"""Substring dedup: windows of words that repeat across documents, by doubling.

A window is ``min_words`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one
document.  A word goes if a window covers it whose word sequence also starts
in a document with a smaller id; windows are judged on the input.

1. *Copies.*  Documents with the same whole word sequence are one class; all
   but the one with the smallest id lose every word (if they have a window at
   all), and only that one goes on.
2. *First length* (``min_words`` halved ``levels`` times).  In every window of
   ``min_words`` words the short window with the smallest hash is its anchor: equal
   windows have equal anchors, so counting anchors alone (about one word in
   twenty) misses nothing.
3. *Doubling.*  Windows that repeat in another document at one length alone are
   extended to twice that length (to the right, or as far left as the window of
   ``min_words`` words that they belong to needs), hashed anew (128 bits), and
   counted again; the rest are out.  So every window that is counted at one
   length holds one that repeated at the length before.  It ends at
   ``min_words`` or when no candidate survives.
4. Windows of the last length whose smallest document differs from their own
   mark the words to remove.

Every count is an aggregate with map-side combine joined back to the windows:
a passage that a third of all documents share is never gathered into a task
(AQE splits the join), and a document that repeats a window counts once.  The
text is shuffled once, by document, to meet its repeated anchors; after that
only documents that hold some are carried on.

Defined cases: a NULL text has no words; a document with a NULL id loses
nothing and takes nothing from others; rows that share an id don't take from
one another; equal rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.llm.common import discard, named, per_text, ship, spare, stage, table

MIN_WORDS = 50
LEVELS = 2

# Odd multipliers of the two window hashes.  Fixed values.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor**(i+1) and its inverse modulo 2**64, for i < n at least."""
    have = _POWERS.get(factor)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(factor, -1, 1 << 64)
        have = tuple(np.cumprod(np.full(size, f, np.uint64)) for f in (factor, inverse))
        _POWERS[factor] = have
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` words, from prefix sums: O(1) a window."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(_FACTORS[which], n)
    values = hashes if which == 0 else _mix(hashes + np.uint64(_FACTORS[1]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:n])))
    return _mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest of every ``span`` consecutive hashes (the first of equal ones)."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    at = sliding_window_view(hashes, span).argmin(axis=1) + np.arange(len(hashes) - span + 1)
    return np.unique(at)


def lengths(min_words: int, levels: int) -> list[int]:
    """The doubling's window lengths, the last being ``min_words``."""
    return [-(-min_words // 2**k) for k in range(levels, -1, -1)]


def chain(hashes: np.ndarray, steps: list[int], level: int) -> np.ndarray:
    """For each window of the last length: where the window of length ``steps[level]`` starts that it grew from.

    The first is its anchor; each next one holds the one before, and all lie in
    the window itself, so equal windows have equal chains.
    """
    whole = steps[-1]
    n = len(hashes) - whole + 1
    if n < 1:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    start = sliding_window_view(window_hashes(hashes, steps[0]), whole - steps[0] + 1).argmin(axis=1) + at
    for length in steps[1 : level + 1]:
        start = np.minimum(start, at + whole - length)
    return start


def extended(hashes: np.ndarray, steps: list[int], level: int, marks: np.ndarray) -> np.ndarray:
    """Starts of the windows of the next length that grow from windows of length ``steps[level]`` that repeat.

    ``marks`` are positions of those (one for each of equal ones).
    """
    start = chain(hashes, steps, level)
    if not len(start):
        return start
    h = window_hashes(hashes, steps[level])
    alive = np.isin(h[start], h[marks])
    return np.unique(chain(hashes, steps, level + 1)[alive])


def remove(words: list[bytes], length: int, marks: np.ndarray) -> list[bytes]:
    """The words that no marked window covers (nor a window equal to a marked one)."""
    h = window_hashes(word_hashes(words), length)
    starts = np.flatnonzero(np.isin(h, h[marks]))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + length, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return [w for w, c in zip(words, covered.tolist()) if not c]


def _first(min_words: int, short: int):
    """Per text: its number of words, digests of its word sequence, and its anchors."""

    def make():
        def run(texts):
            count, s1, s2, sha, found = [], [], [], [], []
            for t in texts:
                words = (t or b"").split()
                joined = b" ".join(words)
                digest = xxhash.xxh3_128_digest(joined)
                count.append(len(words))
                s1.append(int.from_bytes(digest[:8], "big", signed=True))
                s2.append(int.from_bytes(digest[8:], "big", signed=True))
                sha.append(hashlib.sha256(joined).hexdigest())
                if len(words) < min_words:
                    found.append(None)
                    continue
                h = window_hashes(word_hashes(words), short)
                at = anchors(h, min_words - short + 1)
                values, first = np.unique(h[at], return_index=True)
                found.append([{"h": a, "at": b} for a, b in zip(values.view(np.int64).tolist(), at[first].tolist())])
            return [count, s1, s2, sha, found]

        return run

    return make


def _windows(carried: DataFrame, steps: list[int], level: int) -> DataFrame:
    """(id, key, text, marks) -> one row (h1, h2, id, key, at) per distinct window of a document that grows from a marked one."""
    long = steps[level + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            texts, marks = batch.column("text").to_pylist(), batch.column("marks").to_pylist()
            rows, h1, h2, places = [], [], [], []
            for i, (t, m) in enumerate(zip(texts, marks)):
                hashes = word_hashes(t.split())
                at = extended(hashes, steps, level, np.array(m, np.int64))
                a, first = np.unique(window_hashes(hashes, long)[at], return_index=True)
                places.append(at[first])
                h1.append(a)
                h2.append(window_hashes(hashes, long, 1)[at[first]])
                rows.append(np.full(len(a), i))
            index = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(h1).view(np.int64)),
                    pa.array(np.concatenate(h2).view(np.int64)),
                    batch.column("id").take(index),
                    batch.column("key").take(index),
                    pa.array(np.concatenate(places), pa.int32()),
                ],
                names=["h1", "h2", "id", "key", "at"],
            )

    return carried.mapInArrow(run, "h1 long, h2 long, id long, key long, at int")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """``docs(id, text)`` -> (documents, changed).

    documents: ``id, key, n_words, sha`` (of all its words joined by a space)
    and ``copied`` (every word goes), a row per row of docs; changed:
    ``id, key, kept`` (bytes: the words left, joined by a space), a row per
    document that loses some words otherwise.  ``key`` is the text's hash.
    """
    spark = docs.sparkSession
    ship(spark)
    steps = lengths(min_words, levels)
    keyed = docs.select("id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    first = "n_words long, s1 long, s2 long, sha string, anchors array<struct<h:long,at:int>>"
    told, _ = stage(per_text(keyed, _first(min_words, steps[0]), first, keep_text=False), "words")

    sequence = ["s1", "s2", "n_words"]
    long_enough = told.where((F.col("n_words") >= min_words) & F.col("id").isNotNull())
    least = long_enough.groupBy(*sequence).agg(F.min("id").alias("least"))
    joined = told.join(least, sequence, "left")
    documents = joined.select(
        "id", "key", "n_words", "sha", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("copied")
    )
    alone = long_enough.join(least, sequence).where(F.col("id") == F.col("least"))

    # The first length: anchors that stand in two documents at least.
    seen = alone.select("id", "key", F.explode("anchors").alias("a")).select("id", "key", "a.h", "a.at")
    repeated = seen.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")
    marks = seen.join(repeated, "h").groupBy("id", "key").agg(F.collect_list("at").alias("marks"))
    carried, path = stage(keyed.join(marks, ["id", "key"]).dropDuplicates(["id", "key"]), "carried")
    for level, long in enumerate(steps[1:]):
        windows, used = stage(_windows(carried, steps, level), "windows")
        counted = windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
        hits = windows.join(counted, ["h1", "h2"])
        if long == min_words:
            hits = hits.where("id > least")
        marks = hits.groupBy("id", "key").agg(F.collect_list("at").alias("marks"))
        carried, new = stage(carried.drop("marks").join(marks, ["id", "key"]), "carried")
        discard(spark, path, used)
        path = new
        if carried.isEmpty():
            break
    return documents, _removed(carried, min_words)


def _removed(carried: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column("text").to_pylist(), batch.column("marks").to_pylist()
            kept = [remove(t.split(), min_words, np.array(m, np.int64)) for t, m in zip(texts, marks)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("key"),
                    pa.array([b" ".join(k) for k in kept], pa.binary()),
                    pa.array(map(len, kept), pa.int64()),
                ],
                names=["id", "key", "kept", "n_kept"],
            )

    return carried.mapInArrow(run, "id long, key long, kept binary, n_kept long")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``.

    A text that loses words becomes the kept words joined by one space (an
    empty text if none is left); any other text, NULL too, stays as it is.
    Rows, columns and their order stay.
    """
    rows = docs.select(named(id).cast("long").alias("id"), named(text).alias("text"))
    documents, changed = repeats(rows, min_words)
    copied = documents.where("copied").select("id", "key", F.lit("").alias("kept"))
    new = changed.select("id", "key", F.col("kept").cast("string").alias("kept")).unionByName(copied.distinct())
    i, k, t = spare(docs, "id", "key", "kept")
    new = new.select(F.col("id").alias(i), F.col("key").alias(k), F.col("kept").alias(t))
    same = (named(id).cast("long") == F.col(i)) & (F.xxhash64(named(text)) == F.col(k))
    out = docs.join(new, same, "left")
    return out.select(*(F.coalesce(F.col(t), named(c)).alias(c) if c == text else named(c) for c in docs.columns))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words repeated across all ``documents``: doc_id, n_words, n_removed, kept_sha256."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    documents, changed = repeats(docs)
    digests = changed.select("id", "key", "n_kept", F.sha2("kept", 256).alias("kept_sha"))
    rows = documents.join(digests, ["id", "key"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    n_kept = F.when(F.col("copied"), 0).otherwise(F.coalesce("n_kept", "n_words"))
    sha = F.when(F.col("copied"), empty).otherwise(F.coalesce("kept_sha", "sha"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", (F.col("n_words") - n_kept).alias("n_removed"), sha.alias("kept_sha256")
    )


#: The same in DuckDB, over every window.
OP5_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM s
), f AS (SELECT k, min(doc_id) AS a FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (
  SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS j FROM h JOIN f ON f.k = h.k WHERE h.doc_id > f.a
), r AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(
    list_filter(range(1, len(d.w) + 1), lambda j: r.js IS NULL OR NOT list_contains(r.js, j)),
    lambda j: d.w[j]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

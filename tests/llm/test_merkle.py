"""The manifest against a recomputation in plain Python."""

import glob
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodging.llm import common
from lodging.llm import merkle as M
from lodging.llm.common import table

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, arity):
    """(root, path of each node): a path is a list of (left, right)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // arity * arity : k // arity * arity + arity]
            paths[i].append(("".join(run[: k % arity]), "".join(run[k % arity + 1 :])))
        level = [h(*level[k : k + arity]) for k in range(0, len(level), arity)]
        at = [k // arity for k in at]
    return level[0], paths


def brute(rows, arity=16, tampered=lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, kept = [], []
    for s in order:
        group = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = climb([leaf(r) for r in group], arity)
        subs.append(sub)
        kept.append((group, paths))
    root, tops = climb(subs, arity)
    out = []
    for (group, paths), sub, top in zip(kept, subs, tops):
        for r, p in zip(group, paths):
            lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None
            now = leaf((*r[:4], lower)) if tampered(r[0]) else leaf(r)
            for a, b in p + top:
                now = h(a, now, b)
            out.append((r[0], leaf(r), sub, root, h(*(x for step in p + top for x in step)), now, now == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made():
    rows = [(i, f"s{i % 3}" if i % 7 else None, "en", i, f"Text {i}") for i in range(600)]
    rows += [(1000 + i, "one", None, None, None) for i in range(1)]
    rows += [(2000 + i, "Ünï", "", 0, "") for i in range(17)] + [(3000, "Z", "e", 1, "É" * 50_000)]
    rows += [(None, "s1", None, None, "no id"), (None, "s1", None, None, None), (5, "s2", "en", 5, "Text 5"), (5, "s2", "en", 5, "Text 5")]
    return rows + [(4000 + i, f"t{i:02d}", "x", 1, "Upper") for i in range(20)] + [(5000, "", "x", 1, "Empty source")]


def tamper():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@pytest.mark.parametrize("arity", [16, 2, 3])
def test_manifest_equals_recomputation(spark, arity):
    df = spark.createDataFrame(made(), SCHEMA).repartition(7)
    assert result(M.manifest(df, arity=arity, tamper=tamper())) == brute(made(), arity)


def test_given_documents(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert result(M.op13_merkle(spark, SF)) == brute(rows)


def test_small_tables_and_other_columns(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    for rows in ([(1, "a", None, None, "Only")], [(1, "a", None, None, "x"), (2, "a", None, None, "y")], [(1, None, None, None, "x"), (1, "b", None, None, None)]):
        df = spark.createDataFrame(rows, SCHEMA)
        for extra in ("tree", "place", "node", "a.b", "HASH"):
            df = df.withColumn(extra, F.lit(1))
        assert result(M.manifest(df, tamper=tamper())) == brute(rows)
        assert all(r.verified for r in M.manifest(df).collect())


def test_any_change_shows(spark):
    rows = made()[:100]
    before = M.manifest(spark.createDataFrame(rows, SCHEMA)).first().root
    rows[50] = (*rows[50][:4], rows[50][4] + " ")
    assert M.manifest(spark.createDataFrame(rows, SCHEMA)).first().root != before


@pytest.mark.parametrize("rows_a_file", [None, 40])
def test_scratch_tables_are_few_files_however_many_partitions_shuffles_have(spark, monkeypatch, rows_a_file):
    files = {}

    def counted(df, name):
        out, path = common.stage(df, name)
        files[name] = max(files.get(name, 0), len(glob.glob(f"{path}/part-*")))
        return out, path

    monkeypatch.setattr(M, "stage", counted)
    monkeypatch.setattr(common, "FILE_ROWS", rows_a_file or common.FILE_ROWS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(made(), SCHEMA).repartition(3)
        out = M.manifest(df, tamper=tamper())
        most = -(-len(made()) // common.FILE_ROWS)
        assert result(out) == brute(made()) and out.rdd.getNumPartitions() <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 8 and max(n for name, n in files.items() if name != "merkle-leaves") <= most, files

"""SimHash groups against brute force over all pairs."""

import re

import numpy as np
import xxhash

from lodging.llm import simhash as S
from lodging.llm.common import table
from lodging.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=3):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(ids))]


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "oNE"), (6, "one two three"), (7, "one  two\x0bthree"), (8, "É é Å"),
    (9, "é é å"), (10, "a b c d e f g h " * 3000), (11, "a b c d e f g h " * 3000 + "x"), (12, "one two three"), (12, "one two three"),
    (None, "one two three"), (None, "something else entirely here"), (13, "a b c"), (12, "another row of the same id"),
]


def test_fingerprint_equals_brute_force():
    for _, t in ODD:
        t = t[:3000] if t else t
        assert S.fingerprint(t.encode() if t is not None else None) % 2**64 == brute_fingerprint(t)
    assert S.fingerprint(b"") == 0


def test_links_equal_brute_force_even_in_hot_buckets(spark):
    r = np.random.default_rng(5)
    center = r.integers(0, 2**63, 4, dtype=np.uint64)
    fps = []
    for c in center:
        for _ in range(150):
            x = int(c)
            for b in r.integers(0, 64, r.integers(0, 9)):
                x ^= 1 << int(b)
            fps.append(x)
    fps += [int(x) for x in r.integers(0, 2**63, 300, dtype=np.uint64)]
    fps = sorted(set(fps))
    want = brute_components(fps, fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bucket in (2000, 20, 1):
        roots = {r.node: r.root for r in components(S.links(df, bucket=bucket)).collect()}
        got = [roots.get(x, x) for x in signed]
        groups = lambda labels: sorted(tuple(i for i, x in enumerate(labels) if x == l) for l in set(labels))
        assert groups(got) == groups(want), bucket


def test_components_of_a_long_chain(spark):
    n = 60
    rows = [(i, i + 1) for i in range(n)] + [(3, 3), (None, 4), (5, 4), (100, 200), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows_and_kept_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, fp string")
    fps = [brute_fingerprint(t[:500_000] if t else t) for _, t in ODD]
    want = brute_components([i for i, _ in ODD], fps)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((i, f, c) for (i, _), f, c in zip(ODD, fps, want)), key=str)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    groups = brute_components(range(len(ODD)), fps)
    assert sorted((r.doc_id for r in rows), key=str) == sorted((want[g] for g in set(groups)), key=str)
    assert len({groups[ODD.index((r.doc_id, r.text))] for r in rows}) == len(rows)  # each group once
    assert S.keep_one(docs.limit(0)).count() == 0 and S.near_duplicates(docs.limit(0)).count() == 0


def test_op9_whole_table(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    want = brute_components([d.doc_id for d in docs], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op9_simhash(spark, SF).collect()}
    assert got == {d.doc_id: (f"{f:016x}", c) for d, f, c in zip(docs, fps, want)}


def test_ties_and_names_of_other_columns_in_keep_one(spark):
    rows = [(1, "same words here", k, k % 2) for k in range(6)] + [(None, "no id", 1, 1), (None, "no id", 2, 1), (3, "other words there now", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, __row int").selectExpr("*", "1 AS row", "2 AS ID", "3 AS best")
    once = S.keep_one(df)
    assert once.columns == df.columns
    want = sorted(map(str, once.collect()))
    assert len(want) == 3
    for n in (1, 5):
        assert sorted(map(str, S.keep_one(df.orderBy(df.ID, df["`a.b`"].desc()).repartition(n)).collect())) == want

"""Repeated passages against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from lodging.llm import passages as P
from lodging.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows, size=50):
    """(id, text) rows -> {(id, text): (n_words, kept words)}."""
    split = [(i, t, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, _, w in split:
        if i is not None:
            for s in range(len(w) - size + 1):
                k = tuple(w[s : s + size])
                least[k] = min(i, least.get(k, i))
    out = {}
    for i, t, w in split:
        gone = set()
        for s in range(len(w) - size + 1):
            if i is not None and least[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        out[i, t] = (len(w), [x for j, x in enumerate(w) if j not in gone])
    return out


def corpus(seed=4, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "ñandú", "x" * 300]
    shared = [" ".join(r.choice(words) for _ in range(k)) for k in (49, 50, 51, 75, 130, 400)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randrange(70))) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(r.randrange(4), r.choice(shared))
        if r.random() < 0.2:
            parts.insert(0, r.choice(shared))
        rows.append((i * 3, r.choice([" ", "\n", "  \t"]).join(parts)))
    copy = rows[7][1]
    loop = "SE!! CI!! " * 400
    rows += [(500, copy), (501, copy.replace(" ", "\x0b")), (501, copy), (501, copy), (2, copy), (None, copy), (600, None), (601, ""), (602, "short")]
    rows += [(700, loop), (701, loop + "end"), (699, "start " + loop), (None, shared[-1]), (800, shared[-1]), (800, "a b " + shared[-1])]
    rows += [(900, " ".join(f"u{i}" for i in range(60_000))), (901, " ".join(f"u{i}" for i in range(100, 59_000)))]
    return rows


def test_windows_and_anchors():
    r = np.random.default_rng(1)
    h = r.integers(0, 5, 400).astype(np.uint64)
    for length in (1, 7, 25, 50, 399, 400, 401):
        got = P.window_hashes(h, length)
        keys = [tuple(h[i : i + length]) for i in range(len(h) - length + 1)]
        assert len(got) == len(keys)
        assert len(set(got.tolist())) == len(set(keys)) == len(set(zip(got.tolist(), keys)))
    at = P.anchors(h, 26)
    assert all(any(s <= a < s + 26 for a in at) for s in range(len(h) - 25))
    assert P.lengths(50, 1) == [25, 50] and P.lengths(50, P.LEVELS) == [13, 25, 50] and P.lengths(50, 3) == [7, 13, 25, 50]


def test_every_window_grows_from_a_repeated_one_within_the_same_window():
    r = np.random.default_rng(2)
    h, steps = r.integers(0, 9, 500).astype(np.uint64), [7, 13, 25, 50]
    chains = [P.chain(h, steps, k) for k in range(4)]
    assert (chains[3] == np.arange(451)).all()
    for (a, b), (m, n) in zip(zip(chains, chains[1:]), zip(steps, steps[1:])):
        assert (b <= a).all() and (a + m <= b + n).all()  # the longer one holds the shorter one
    by = {}
    for w in range(451):  # equal windows have equal chains
        assert by.setdefault(h[w : w + 50].tobytes(), tuple(int(c[w]) - w for c in chains)) == tuple(int(c[w]) - w for c in chains)
    marks = chains[1][[3, 200]]
    again = np.isin(P.window_hashes(h, 13)[chains[1]], P.window_hashes(h, 13)[marks])
    assert P.extended(h, steps, 1, marks).tolist() == sorted(set(chains[2][again].tolist()))
    assert len(P.extended(h, steps, 1, np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("levels", [1, P.LEVELS, 3])
def test_repeats_equal_brute_force(spark, levels):
    rows = corpus()
    want = brute(rows)
    docs = spark.createDataFrame(rows, "id long, text string")
    documents, changed = P.repeats(docs, levels=levels)
    key = {(r.id, r.key): r.text for r in docs.selectExpr("id", "text", "xxhash64(text) key").collect()}
    kept = {(r.id, key[r.id, r.key]): bytes(r.kept).decode().split(" ") if r.n_kept else [] for r in changed.collect()}
    got = documents.collect()
    assert len(got) == len(rows)
    for d in got:
        t = key[d.id, d.key]
        n, left = want[d.id, t]
        assert d.n_words == n
        if d.copied:
            assert left == []
        elif (d.id, t) in kept:
            assert kept[d.id, t] == left
        else:
            assert len(left) == n


def test_without_repeats_keeps_rows_and_columns(spark):
    rows = corpus(seed=9, n=20)
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, key string, kept int")
    out = P.without_repeats(docs)
    assert out.columns == docs.columns
    want = brute(rows)
    expected = sorted((str(i), t if len(want[i, t][1]) == want[i, t][0] else " ".join(want[i, t][1])) for i, t in rows if t is not None)
    assert sorted((str(r.doc_id), r.text) for r in out.collect() if r.text is not None) == expected
    assert [r.doc_id for r in out.where("text is null").collect()] == [600]
    assert P.without_repeats(docs.limit(0)).count() == 0


def test_other_columns_may_have_any_name(spark):
    rows = corpus(seed=9, n=20)
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, id string, Kept int")
    docs = docs.selectExpr("*", "1 AS __key", "2 AS __kept", "3 AS `a.b`", "4 AS key", "5 AS __id")
    out = P.without_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    plain = P.without_repeats(docs.select("doc_id", "text")).collect()
    assert sorted(map(str, plain)) == sorted(map(str, out.select("doc_id", "text").collect()))
    assert {(r["a.b"], r["__key"]) for r in out.collect()} == {(3, 1)}


def test_op5_whole_table(spark):
    docs = [(d.doc_id, d.text) for d in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = brute(docs)
    got = P.op5_passages(spark, SF).collect()
    assert len(got) == len(docs)
    by = dict(docs)
    for r in got:
        n, left = want[r.doc_id, by[r.doc_id]]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    assert any(r.n_removed for r in got)
